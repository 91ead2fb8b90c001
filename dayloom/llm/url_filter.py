"""URL verdicts: rules on hosts and paths, then logistic regression on hashed character n-grams.

A rule names a host and the beginning of a path; the longest fitting one decides. The other URLs are
judged by a model over the n-grams of host and path, hashed apart. It is fitted with MLlib on a small
labelled table of (url, blocked); ``ruled`` gives such a table from the URLs that rules decide, at
most SAMPLE distinct ones of either verdict, those with the smallest hashes.

Defined results: a null URL and one without ``://`` have an empty host and path, no rule, and the
verdict of the model's intercept; without labelled rows every verdict is ``allow``, with labels of one
kind only it is that kind; equal rule lengths go to the longer host; repeated rows give repeated rows;
columns of the result replace those of the same name.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.rows import with_arrow_columns

# The rules of the query: fixed values.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

GRAMS = (2, 3, 4, 5)
BUCKETS = 1 << 18
SAMPLE = 4000  # labelled URLs of either verdict
STRENGTH = 1e-3  # of the quadratic penalty
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame) -> DataFrame:
    """``pages`` with host (lower-cased A-Z) and path of their url."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def with_rules(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``pages`` (with host and path) with the longest fitting rule and its verdict, both null if none fits."""
    fits = None
    order = sorted(rules, key=lambda r: (-len(r[1]), -r[1].index("/")))
    for verdict, rule in order:
        host, path = rule.split("/", 1)
        one = (F.col("host") == host) | F.endswith("host", F.lit("." + host))
        one = one & F.startswith("path", F.lit("/" + path))
        both = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(one, both) if fits is None else fits.when(one, both)
    if fits is None:
        fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    return pages.withColumn("_fit", fits).withColumns({"rule": F.col("_fit.rule"), "verdict": F.col("_fit.verdict")}).drop("_fit")


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, *, rows: int = SAMPLE) -> DataFrame:
    """(url, blocked): at most ``rows`` distinct URLs that rules block and as many that they allow."""
    decided = with_rules(with_parts(pages.select("url")), rules).filter("rule IS NOT NULL").select("url", "verdict").distinct()
    picked = [
        decided.filter(F.col("verdict") == v).orderBy(F.xxhash64("url"), "url").limit(rows) for v in ("allow", "block")
    ]
    both = picked[0].unionByName(picked[1])
    return both.select("url", (F.col("verdict") == "block").alias("blocked"))


def buckets(host: str, path: str) -> np.ndarray:
    """Distinct hashed n-grams of host and path, with marks at both ends."""
    found = []
    for seed, text in ((1, host), (2, path)):
        codes = np.frombuffer(f"\x02{text}\x03".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        for n in GRAMS:
            if len(codes) < n:
                continue
            h = np.full(len(codes) - n + 1, seed * 16 + n, np.uint64)
            for k in range(n):
                h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
            found.append(h % np.uint64(BUCKETS))
    return np.unique(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64)


class UrlModel:
    """Weights of the n-grams and the intercept; a positive sum means block."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def score(self, parts: Iterable[tuple[str, str]]) -> np.ndarray:
        total = np.array([self.weights[buckets(h, p)].sum() for h, p in parts], float)
        return 1 / (1 + np.exp(-(total + self.intercept)))


def fit_urls(labelled: DataFrame, *, strength: float = STRENGTH) -> UrlModel:
    """The model of a small table (url, blocked); rows with a null in either column are left out.

    The table is small by contract (``ruled`` bounds it), so its URLs pass through the driver once.
    """
    rows = with_parts(labelled.filter("url IS NOT NULL AND blocked IS NOT NULL")).select("host", "path", "blocked").collect()
    kinds = {r["blocked"] for r in rows}
    if len(kinds) < 2:
        return UrlModel(np.zeros(BUCKETS), 1.0 if kinds == {True} else -1.0)
    found = [(float(r["blocked"]), buckets(r["host"], r["path"])) for r in rows]
    used = np.unique(np.concatenate([b for _, b in found]))
    vectors = [(y, Vectors.sparse(len(used), np.searchsorted(used, b), np.ones(len(b)))) for y, b in found]
    data = labelled.sparkSession.createDataFrame(vectors, ["label", "features"])
    fitted = LogisticRegression(regParam=strength, standardization=False, maxIter=50).fit(data)
    weights = np.zeros(BUCKETS)
    weights[used] = fitted.coefficients.toArray()
    return UrlModel(weights, fitted.intercept)


def judged(
    pages: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str]] = RULES, *, keep: list[str] | None = None
) -> DataFrame:
    """``pages`` (columns ``keep``, default all) with host, path, rule, verdict and the model's score."""
    known = with_rules(with_parts(pages), rules)
    used = np.flatnonzero(model.weights)
    small = (used, model.weights[used], model.intercept)  # what the labelled table holds, no more

    def judge(table: pa.Table):
        weights = np.zeros(BUCKETS)
        weights[small[0]] = small[1]
        score = UrlModel(weights, small[2]).score(zip(table["host"].to_pylist(), table["path"].to_pylist(), strict=True))
        verdict = [v or ("block" if s > 0.5 else "allow") for v, s in zip(table["verdict"].to_pylist(), score, strict=True)]
        return [pa.array(verdict, pa.string()), pa.array(score, pa.float64())]

    own = ["host", "path", "rule"]
    kept = [c for c in (keep if keep is not None else pages.columns) if c.lower() not in own] + own
    return with_arrow_columns(known, judge, "verdict string, score double", size_of="path", keep=kept)
