"""Language identification by compression.

Every language has a Zstandard dictionary of raw training text. A text is encoded whole with each
dictionary, and the language whose dictionary gives the smallest result wins. Texts and dictionaries
are lower-cased first and what is no letter becomes one space, so that digits and symbols weigh
nothing. The score is the margin to the runner-up, relative to it; a margin below ``narrow`` marks
the answer as rejected.

Dictionaries hold at most ``rows`` training texts and ``dictionary_bytes`` bytes a language: texts of
the smallest hashed ids among those that fit whole, both bounds being parameters; what does not fit is
cut before it reaches the driver. Languages are taken as given and all are learned: TOGETHER of them
are tried in one pass over the documents, further ones in further passes, and the driver holds the
dictionaries of one pass.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is every text
where nothing was learned; equal sizes go to the language with more training rows, then the first by
name; with a single language the score is 1.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dayloom.llm.rows import with_arrow_columns
from dayloom.session import stage

ROWS = 64
DICTIONARY_BYTES = 96 << 10
TOGETHER = 256  # languages tried in one pass over the documents
LEVEL = 9
NARROW = 0.005
FOLDS = 5
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def held_out(doc_id: str = "doc_id"):
    """The fold that nothing is learned from: crc32 of the id's digits divisible by FOLDS."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def language_order(documents: DataFrame) -> list[str]:
    """All languages that have a training text, in the order in which ties are decided."""
    usable = documents.filter("text IS NOT NULL AND lang IS NOT NULL")
    return [r["lang"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").select("lang").collect()]


def learn_languages(
    documents: DataFrame,
    wanted: list[str] | None = None,
    *,
    rows: int = ROWS,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> list[tuple[str, bytes]]:
    """(language, dictionary content) of the languages ``wanted``, by default of all."""
    usable = documents.filter("text IS NOT NULL AND lang IS NOT NULL")
    wanted = language_order(documents) if wanted is None else wanted
    if not wanted:
        return []
    names = documents.sparkSession.createDataFrame([(w,) for w in wanted], "lang string")
    order = W.partitionBy("lang").orderBy("late", F.xxhash64("doc_id"), F.xxhash64("text"))
    # Texts too long for the dictionary come last, shortest first, for languages that have no other.
    late = F.greatest(F.octet_length("text") - dictionary_bytes // 4, F.lit(0)).alias("late")
    picked = (
        usable.join(F.broadcast(names), "lang")
        .select("lang", "text", "doc_id", late)
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= rows)
        .select("lang", "place", F.substring("text", 1, dictionary_bytes).alias("text"))
    )
    before = F.sum(F.octet_length("text")).over(W.partitionBy("lang").orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    bounded = picked.withColumn("_before", before).filter(F.coalesce("_before", F.lit(0)) <= 2 * dictionary_bytes)
    texts: dict[str, list] = {}
    for r in bounded.drop("_before").collect():
        texts.setdefault(r["lang"], []).append((r["place"], normalised(r["text"])))
    learned = []
    for lang in wanted:
        content = b""
        for _, text in sorted(texts[lang]):
            if not content or len(content) + len(text) + 1 <= dictionary_bytes:
                content += text + b"\n"
        learned.append((lang, content))
    return learned


def normalised(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).encode()


class Compressors:
    """One encoder a language; ``best`` names the language of a text and its margin."""

    def __init__(self, learned: list[tuple[str, bytes]], level: int = LEVEL):
        self.names = [name for name, _ in learned]
        self.encoders = []
        for _, content in learned:
            data = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=level)
            self.encoders.append(
                zstandard.ZstdCompressor(
                    level=level, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False
                )
            )

    def two_best(self, text: str | None) -> tuple[str | None, int | None, int | None]:
        """The language of the smallest encoding, its size and the size of the next one."""
        if not text or not self.names or not _LETTER.search(text):
            return None, None, None
        data = normalised(text)
        sizes = sorted((len(e.compress(data)), i) for i, e in enumerate(self.encoders))
        return self.names[sizes[0][1]], sizes[0][0], sizes[1][0] if len(sizes) > 1 else None

    def best(self, text: str | None) -> tuple[str, float]:
        return answer(*self.two_best(text))


def answer(name: str | None, size: int | None, next_size: int | None) -> tuple[str, float]:
    if name is None:
        return UNDETERMINED, 0.0
    return name, 1 - size / next_size if next_size is not None else 1.0


def better(one: tuple, other: tuple) -> tuple:
    """Of two results of ``two_best``, over different languages, the one over all; ``one`` wins ties."""
    if one[0] is None or other[0] is None:
        return other if one[0] is None else one
    first, second = (one, other) if one[1] <= other[1] else (other, one)
    rest = [s for s in (first[2], second[1]) if s is not None]
    return first[0], first[1], min(rest)


_READY: dict[tuple[str, int], Compressors] = {}


def _compressors(mark: str, level: int, shared: Broadcast) -> Compressors:
    """The encoders of one set of dictionaries, made once a worker: tasks share this module."""
    if (mark, level) not in _READY:
        _READY.clear()
        _READY[mark, level] = Compressors(shared.value, level)
    return _READY[mark, level]


def identify(
    documents: DataFrame,
    blocks: Iterable[list[tuple[str, bytes]]],
    *,
    level: int = LEVEL,
    narrow: float = NARROW,
    keep: list[str] | None = None,
) -> DataFrame:
    """``documents`` (columns ``keep``) with lang_pred, score and rejected (a narrow margin).

    ``blocks`` are lists of learned languages, one pass each; passes are staged, so that workers hold
    the encoders of one.
    """
    found = "_lang string, _size long, _next long"
    kept = list(keep if keep is not None else documents.columns)
    tried, passes = documents, 0
    for learned in blocks:
        digest = hashlib.sha256()
        for name, content in learned:
            digest.update(f"{len(name)} {len(content)} {name}".encode() + content)
        mark = digest.hexdigest()
        shared = documents.sparkSession.sparkContext.broadcast(learned)
        if passes:
            tried = stage(tried, "languages")

        def predict(table: pa.Table, mark=mark, shared=shared, first=not passes):
            ready = _compressors(mark, level, shared)
            own = [ready.two_best(t) for t in table.column("text").to_pylist()]
            if not first:
                was = zip(*(table.column(c).to_pylist() for c in ("_lang", "_size", "_next")), strict=True)
                own = [better(a, b) for a, b in zip(was, own, strict=True)]
            columns = list(zip(*own, strict=True))
            return [pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])]

        tried = with_arrow_columns(tried, predict, found, size_of="text", keep=[*kept, *([] if "text" in kept else ["text"])])
        passes += 1
    if not passes:
        tried = documents.withColumns({"_lang": F.lit(None).cast("string"), "_size": F.lit(1), "_next": F.lit(1)})
    margin = F.when(F.col("_lang").isNull(), 0.0).otherwise(
        F.coalesce(1 - F.col("_size") / F.col("_next"), F.lit(1.0))
    )
    own = ("lang_pred", "score", "rejected")
    return tried.withColumns({"_pred": F.coalesce("_lang", F.lit(UNDETERMINED)), "_score": margin}).select(
        *[c for c in kept if c.lower() not in own],
        F.col("_pred").alias("lang_pred"),
        F.col("_score").alias("score"),
        (F.col("_score") < narrow).alias("rejected"),
    )


def learned_blocks(documents: DataFrame, together: int = TOGETHER) -> Iterator[list[tuple[str, bytes]]]:
    """All languages of ``documents``, ``together`` of them at a time."""
    order = language_order(documents)
    for at in range(0, len(order), together):
        yield learn_languages(documents, order[at : at + together])


def language_report(documents: DataFrame, *, together: int = TOGETHER) -> DataFrame:
    """Predictions for all documents, learned from the folds that are not held out."""
    blocks = learned_blocks(documents.filter(~held_out()), together)
    found = identify(documents.select("doc_id", "text"), blocks, keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
