"""The training-data operators as queries over whole tables, and the SQL stating their results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from dayloom.llm.chat import chat_report, with_hostile
from dayloom.llm.decontaminate import decontamination_report
from dayloom.llm.exact_topk import top_k
from dayloom.llm.html_text import main_texts
from dayloom.llm.language import language_report
from dayloom.llm.near_dedup import near_duplicates
from dayloom.llm.oracles import ORACLES
from dayloom.llm.packing import TOKENIZER, pack
from dayloom.llm.periodic_runs import runs_report
from dayloom.llm.pseudonyms import pseudonyms
from dayloom.llm.rows import read
from dayloom.llm.sharding import shard_report
from dayloom.llm.spelling import spelling_variants
from dayloom.llm.toxicity import fit_toxicity, toxicity
from dayloom.llm.url_filter import fit_urls, judged, ruled


def op1_ring_sharding(spark, folder):
    """40 shards of counts at most one apart, from a ring with bounded loads."""
    return shard_report(read(spark, folder, "documents"))


def op2_pivot_topk(spark, folder):
    return top_k(read(spark, folder, "embeddings"))


def op3_feistel_pseudonyms(spark, folder):
    """Every document with its values permuted, and how many there were by kind."""
    found = pseudonyms(read(spark, folder, "documents").select("doc_id", "text"), keep=["doc_id"])
    kinds = F.array_join(
        F.transform(F.array_sort(F.map_entries("kinds")), lambda e: F.concat_ws("=", e["key"], e["value"])), ","
    )
    return found.select("doc_id", F.col("clean_text").alias("text"), "n_values", kinds.alias("kinds"))


def op4_zstd_language(spark, folder):
    return language_report(read(spark, folder, "documents"))


def op5_fm_decontamination(spark, folder):
    return decontamination_report(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op6_dp_packing(spark, folder):
    return pack(read(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


def op7_chat_windows(spark, folder):
    return chat_report(with_hostile(read(spark, folder, "conversations")))


def op8_ordinal_toxicity(spark, folder):
    """Expected severity, grade and rejection of every document."""
    documents = read(spark, folder, "documents").select("doc_id", "text")
    model = fit_toxicity(documents, read(spark, folder, "labels"))
    return toxicity(documents, model, keep=["doc_id"])


def op9_url_difference_text(spark, folder):
    return main_texts(read(spark, folder, "pages"))


def op10_minhash_near_dedup(spark, folder):
    return near_duplicates(read(spark, folder, "documents"), 85)


def op11_url_filter(spark, folder):
    """Verdicts by rule, else by a model learned from URLs that the rules decide."""
    pages = read(spark, folder, "pages").select("page_id", "url")
    return judged(pages, fit_urls(ruled(pages)), keep=["page_id"])


def op12_spelling_variants(spark, folder):
    return spelling_variants(read(spark, folder, "documents"))


def op13_periodic_runs(spark, folder):
    return runs_report(read(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ring_sharding,
        op2_pivot_topk,
        op3_feistel_pseudonyms,
        op4_zstd_language,
        op5_fm_decontamination,
        op6_dp_packing,
        op7_chat_windows,
        op8_ordinal_toxicity,
        op9_url_difference_text,
        op10_minhash_near_dedup,
        op11_url_filter,
        op12_spelling_variants,
        op13_periodic_runs,
    )
}

__all__ = ["ORACLES", "QUERIES"]
