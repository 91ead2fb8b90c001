"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random

WORDS = "red green blue stone river cloud ember quiet signal harbor meadow lantern copper winter orbit".split()


def prose(seed: int, words: int = 40) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(words))


def awkward_documents(spark, clash=()):
    """Documents with every awkward case; ``clash`` names further columns (all strings)."""
    long = prose(7, 30_000)
    texts = [prose(1), prose(1), None, "", "  \n\t ", "one", "one two three", long, prose(2), prose(2) + " tail", "ÀÉ ß 中文", "!!! ---"]
    rows = [(i, t, "en" if i % 2 else None, "src0", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], rows[2], (None, prose(3), "en", None, None), (None, None, None, None, None)]
    extra = "".join(f", `{c}` string" for c in clash)
    rows = [(*r, *("kept" for _ in clash)) for r in rows]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long{extra}")


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
