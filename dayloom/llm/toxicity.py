"""Toxicity grades from a cumulative-link (proportional odds) model over sparse text features.

P(grade <= k) = sigmoid(cut_k - w.x): all thresholds share the weights w, and the expected severity is
the sum of P(grade >= k). Features are words and word beginnings, as log(1 + count): those that
occur in toxic documents more often than in others beyond chance (SURE standard errors), the most
telling ones first.

The labels say toxic or not. Grade 0 is not toxic; toxic documents become grade 1 or 2 by how
much they use toxic-only features (the sum of log(1 + count)), below or from the median of the toxic
sample. The
model is fitted on at most ``sample`` labelled documents of either label (those of the smallest hashed
ids) and ``top`` features; both bounds are parameters, and every document is scored on its whole text.

Defined results: null or wordless texts have severity 0 and grade 0; labels that are null, or of no
document, teach nothing; where one label is missing altogether, nothing can be learned and every
severity is 0; a document labelled twice counts as toxic if any label says so.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.rows import chunks, with_arrow_columns
from dayloom.session import clear_staged, stage

SAMPLE = 4000
TOP = 512
LEAST, LEAST_SHARE = 3, 0.005  # toxic documents of the sample that a feature must occur in
SURE = 5  # standard errors between a feature's shares of toxic and of other documents
MEMO_WORDS = 1 << 17
REJECT = 0.25  # expected severity from which a document is rejected
_WORDS = re.compile(r"[^\W\d_]+")
_BEGINNINGS = (3, 4, 5, 6)


def words(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def features_of(word: str) -> list[str]:
    return [word, *[f"{word[:n]}*" for n in _BEGINNINGS if len(word) >= n]]


def feature_counts(text: str | None, chosen: dict[str, int] | None = None, memo: dict | None = None):
    """Counts by feature; with ``chosen`` by the numbers of those features only."""
    counts: Counter = Counter()
    memo = {} if memo is None else memo
    for word, n in Counter(words(text)).items():
        found = memo.get(word)
        if found is None:
            found = features_of(word)
            if chosen is not None:
                found = tuple(chosen[f] for f in found if f in chosen)
            if len(memo) >= MEMO_WORDS:
                memo.clear()
            memo[word] = found
        for f in found:
            counts[f] += n
    return counts


@dataclass
class OrdinalModel:
    features: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def at_least(self, text: str | None, memo: dict) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...; zeros where there is no word or no model."""
        if not len(self.cuts) or not text or not _WORDS.search(text):
            return np.zeros(len(self.cuts))
        score = sum(
            self.weights[f] * math.log1p(n) for f, n in feature_counts(text, self.features, memo).items()
        )
        return 1 / (1 + np.exp(np.clip(self.cuts - score, -60, 60)))


def fit_ordinal(
    x: np.ndarray, grades: np.ndarray, weight: np.ndarray, *, ridge: float = 1e-5, steps: int = 800
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered cuts of the cumulative-link model by Adam over the whole sample.

    The cuts are a first one and positive gaps, which keeps them in order.
    """
    levels = int(grades.max())
    parameters = np.zeros(x.shape[1] + levels)
    parameters[x.shape[1]] = 1.0
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)
    share = weight / weight.sum()
    for step in range(1, steps + 1):
        w, first_cut, gaps = parameters[: x.shape[1]], parameters[x.shape[1]], parameters[x.shape[1] + 1 :]
        cuts = first_cut + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        score = x @ w.astype(np.float32)
        below = _sigmoid(edges[grades + 1] - score)
        above = _sigmoid(edges[grades] - score)
        p = np.maximum(below - above, 1e-12)
        slope_below, slope_above = below * (1 - below), above * (1 - above)
        by_score = share * (slope_below - slope_above) / p  # of -log p
        by_cut = np.zeros(levels)
        np.add.at(by_cut, np.minimum(grades, levels - 1), np.where(grades < levels, -share * slope_below / p, 0))
        np.add.at(by_cut, np.maximum(grades - 1, 0), np.where(grades > 0, share * slope_above / p, 0))
        tails = np.cumsum(by_cut[::-1])[::-1]
        slope = np.concatenate([x.T @ by_score.astype(np.float32) + ridge * w, [tails[0]], tails[1:] * np.exp(gaps)])
        first = 0.9 * first + 0.1 * slope
        second = 0.95 * second + 0.05 * slope**2
        pace = 0.03 * (1 - step / (steps + 1))
        parameters -= pace * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.95**step)) + 1e-9)
    gaps = parameters[x.shape[1] + 1 :]
    return parameters[: x.shape[1]], parameters[x.shape[1]] + np.concatenate([[0], np.cumsum(np.exp(gaps))])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label by feature, summed within chunks."""
    memo: dict = {}
    for table in chunks(batches, "text", 4 << 20):
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(table.column("text").to_pylist(), table.column("toxic").to_pylist(), strict=True):
            for f in feature_counts(text, memo=memo):
                counts.setdefault(f, [0, 0])[toxic] += 1
        names = list(counts)
        for at in range(0, len(names), 1 << 16):
            part = names[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), *(pa.array([counts[f][k] for f in part], pa.int64()) for k in (0, 1))],
                names=["feature", "clean", "toxic"],
            )


def fit_toxicity(documents: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, top: int = TOP) -> OrdinalModel:
    known = (
        labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    )
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return OrdinalModel()
    order = F.xxhash64(F.col("doc_id"))
    picked = [known.filter(F.col("toxic") == k).orderBy(order, "doc_id").limit(sample) for k in (0, 1)]
    # 2 * sample rows of two numbers: bounded by the parameter, so they can be sent to every task.
    chosen = F.broadcast(picked[0].unionByName(picked[1]))
    taught = stage(
        documents.select("doc_id", "text").filter("text IS NOT NULL").join(chosen, "doc_id").select("text", "toxic"),
        "labelled",
    )
    sizes = {r["toxic"]: r["count"] for r in taught.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return OrdinalModel()
    counts = taught.mapInArrow(_counted, "feature string, clean long, toxic long").groupBy("feature")
    counts = counts.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    p1, p0 = F.col("toxic") / sizes[1], F.col("clean") / sizes[0]
    both = (F.col("toxic") + F.col("clean")) / (sizes[0] + sizes[1])
    spread = F.sqrt(both * (1 - both) * (1 / sizes[0] + 1 / sizes[1])) + 1e-9
    z = (p1 - p0) / spread
    best = (
        counts.filter(F.col("toxic") >= max(LEAST, LEAST_SHARE * sizes[1]))
        .withColumn("z", z)
        .filter(F.col("z") >= SURE)
        .orderBy(F.desc("z"), "feature")
        .limit(top)
        .collect()
    )
    features = {r["feature"]: i for i, r in enumerate(best)}
    marks = {i for i, r in enumerate(best) if r["toxic"] > 20 * r["clean"] * sizes[1] / sizes[0]}
    if not features:
        return OrdinalModel()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for table in chunks(batches, "text", 4 << 20):
            rows = [feature_counts(t, features, memo) for t in table.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("toxic").combine_chunks(),
                    pa.array([list(r) for r in rows], pa.list_(pa.int32())),
                    pa.array([list(r.values()) for r in rows], pa.list_(pa.int32())),
                ],
                names=["toxic", "at", "counts"],
            )

    rows = taught.mapInArrow(vectors, "toxic int, at array<int>, counts array<int>").collect()
    clear_staged(documents.sparkSession, taught)
    rows.sort()
    x = np.zeros((len(rows), len(features)), np.float32)
    toxic = np.array([r["toxic"] for r in rows])
    for i, r in enumerate(rows):
        x[i, r["at"]] = np.log1p(r["counts"])
    heavy = x[:, sorted(marks)].sum(axis=1)
    middle = np.median(heavy[toxic == 1])
    grades = np.where(toxic == 1, np.where(heavy >= middle, 2, 1), 0)
    if not (grades == 1).any():
        grades = np.minimum(grades, 1)
    weight = np.array([totals[t] / sizes[t] for t in toxic])
    weights, cuts = fit_ordinal(x, grades, weight)
    return OrdinalModel(features, weights, cuts)


def toxicity(documents: DataFrame, model: OrdinalModel, *, keep: list[str] | None = None) -> DataFrame:
    """``documents`` with severity (expected grade), grade (most likely) and toxic (severity from REJECT)."""
    memo: dict = {}

    def score(table: pa.Table):
        severity, grade = [], []
        for text in table.column("text").to_pylist():
            above = model.at_least(text, memo)
            severity.append(float(above.sum()))
            chances = -np.diff(np.concatenate([[1.0], above, [0.0]]))
            grade.append(int(chances.argmax()))
        return [
            pa.array(severity, pa.float64()),
            pa.array(grade, pa.int32()),
            pa.array([s >= REJECT for s in severity], pa.bool_()),
        ]

    return with_arrow_columns(
        documents, score, "severity double, grade int, toxic boolean", size_of="text", keep=keep
    )
