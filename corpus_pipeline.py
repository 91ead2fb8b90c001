"""Cleaning a corpus in stages, each written as Parquet and read again as the next one's documents.

Every stage works on all rows it is given and returns the columns of documents, the last one the
pieces of the packed sequences. Columns besides doc_id, text, lang, source and n_chars pass through
unchanged, also where a stage has a column of that name of its own.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.llm.decontaminate import decontaminate
from dayloom.llm.near_dedup import one_of_each
from dayloom.llm.packing import TOKENIZER, pack
from dayloom.llm.pseudonyms import pseudonyms
from dayloom.llm.rows import read
from dayloom.llm.toxicity import fit_toxicity
from dayloom.llm.toxicity import toxicity as graded
from dayloom.session import stage

OWN = ("doc_id", "text", "lang", "source", "n_chars")
NEAR_PERCENT = 80  # of five-word shingles; op10 has 85 of its own


def _stage(step: Callable[[DataFrame, SparkSession, str], DataFrame]):
    """Run ``step`` on documents whose further columns carry names that nothing else uses."""

    def run(spark: SparkSession, documents: DataFrame, folder: str) -> DataFrame:
        names = documents.columns
        safe = [c if c in OWN else f"_carried_{i}" for i, c in enumerate(names)]
        done = step(documents.toDF(*safe), spark, folder)
        return done.select(*safe).toDF(*names)

    run.__name__, run.__doc__ = step.__name__, step.__doc__
    return run


def _with_text(changed: DataFrame, text: str) -> DataFrame:
    """``changed`` with the column ``text`` as its text, and its length where it differs."""
    fresh = F.col(text)
    length = F.char_length(fresh).cast(changed.schema["n_chars"].dataType)
    same = F.col("text").eqNullSafe(fresh)
    return changed.withColumns({"n_chars": F.when(same, F.col("n_chars")).otherwise(length), "text": fresh})


@_stage
def toxicity(documents: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose expected severity rejects them go."""
    return graded(documents, fit_toxicity(documents, read(spark, folder, "labels"))).filter("NOT toxic")


@_stage
def near_dedup(documents: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return one_of_each(documents, NEAR_PERCENT)


@_stage
def decontamination(documents: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; a document of nothing else goes."""
    found = decontaminate(documents, read(spark, folder, "benchmark"))
    hit = F.size("hit_words")
    return _with_text(found.filter((hit == 0) | (hit < F.col("n_words"))), "clean_text")


@_stage
def pii(documents: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Personal data become pseudonyms of the same format."""
    return _with_text(pseudonyms(documents), "clean_text")


def packing(spark: SparkSession, documents: DataFrame, folder: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack(documents, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]

# Learned models, a tokenizer and keyed permutations are beyond SQL: tests/llm/test_pipeline.py
# holds the stages against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    for name, step in STAGES[:-1]:
        documents = stage(step(spark, documents, folder), name)
    return STAGES[-1][1](spark, documents, folder)
