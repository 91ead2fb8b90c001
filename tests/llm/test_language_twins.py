"""Languages against a plain loop over all encoders, more languages than one pass, shared encoders."""

import random
import re

import zstandard
from pyspark.sql import functions as F

from dayloom.llm import language, packing
from dayloom.llm.rows import read
from tests.conftest import SMALL
from tests.llm.data import prose


def plain_answer(text, learned):
    if not text or not learned or not re.search(r"[^\W\d_]", text):
        return "und", 0.0
    data = re.sub(r"[\W\d_]+", " ", text.lower()).encode()
    sizes = []
    for name, content in learned:
        dictionary = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        coder = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=dictionary, write_content_size=False, write_dict_id=False)
        sizes.append((len(coder.compress(data)), name))
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i][0], i))
    best = sizes[order[0]]
    return best[1], 1 - best[0] / sizes[order[1]][0] if len(sizes) > 1 else 1.0


def test_predictions_equal_a_plain_loop(spark):
    documents = read(spark, SMALL, "documents").select("doc_id", "text", "lang")
    learned = language.learn_languages(documents.filter(~language.held_out()))
    rows = language.language_report(documents).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert len(rows) == len(texts)
    for r in rows[::3]:
        assert (r["lang_pred"], r["score"]) == plain_answer(texts[r["doc_id"]], learned)


def many(spark, languages):
    rng = random.Random(1)
    rows = []
    for k in range(languages):
        letters = [chr(0x4E00 + 40 * k + j) for j in range(40)]
        for _ in range(2):
            rows.append((len(rows), "".join(rng.choice(letters) for _ in range(200)), f"l{k:03d}"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_three_hundred_languages_are_all_learned(spark):
    documents = many(spark, 300)
    learn = documents.filter("doc_id % 2 = 0")
    blocks = language.learned_blocks(learn, 256)
    found = language.identify(documents, blocks, keep=["doc_id", "lang"]).collect()
    assert len(found) == 600 and all(r["lang"] == r["lang_pred"] for r in found)


def test_passes_do_not_change_the_answer(spark):
    documents = read(spark, SMALL, "documents").select("doc_id", "text", "lang")
    key = ["doc_id", "lang_pred", "score", "rejected"]
    one, three = (
        sorted(map(tuple, language.language_report(documents, together=k).select(key).collect())) for k in (256, 1)
    )
    assert one == three


def test_training_text_reaches_the_driver_bounded(spark):
    long = spark.createDataFrame([(i, prose(i, 60_000), "en") for i in range(4)], "doc_id long, text string, lang string")
    learned = language.learn_languages(long, dictionary_bytes=5000)
    assert [n for n, _ in learned] == ["en"] and 0 < len(learned[0][1]) <= 5001


def test_tasks_of_a_worker_share_tokenizer_and_encoders(spark):
    import public_tokenizers

    documents = spark.createDataFrame([(i, prose(i, 30), "en" if i % 2 else "fr") for i in range(40)], "doc_id long, text string, lang string")
    packing.pack(documents.repartition(12), public_tokenizers.path(packing.TOKENIZER)).count()
    language.language_report(documents.repartition(12)).count()

    def look(batches):
        import os

        import pyarrow as pa

        for batch in batches:
            made = packing._tokens.cache_info()
            row = [os.getpid(), made.misses, made.hits, len(language._READY)]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["pid", "made", "used", "ready"])

    seen = spark.range(0, 40, 1, 40).repartition(12).mapInArrow(look, "pid long, made long, used long, ready long")
    rows = seen.groupBy("pid").agg(F.max("made").alias("made"), F.max("used").alias("used"), F.max("ready").alias("ready")).collect()
    assert all(r["made"] <= 1 and r["ready"] <= 1 for r in rows)
    assert any(r["used"] > 0 for r in rows)
