"""Every page is differenced against its nearest one by URL, and marks are checked afterwards."""

import random
import time

from dayloom.llm import html_text

SITE = "<body><div>Site name</div><h1>{0} title</h1><article><p>{0} text</p><p>shared by all</p></article><div>Imprint</div>"
PLAIN = "<body><div>Menu</div><p>{0} first</p><p>{0} second</p><div>Imprint</div>"


def texts(spark, rows):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_text.main_texts(frame.coalesce(1)).collect()}


def test_pages_with_an_article_are_differenced(spark):
    """Lines that nothing declares are template where the neighbour has them, and text where it has not."""
    rows = [(i, f"http://h.example/a/{i}", SITE.format(f"n{i}")) for i in range(4)]
    got = texts(spark, [*rows, (9, "http://alone.example/", SITE.format("lone"))])
    assert got == {i: f"n{i} title n{i} text shared by all" for i in range(4)} | {9: "lone text shared by all"}


def test_copies_are_no_neighbours(spark):
    rows = [(i, f"http://h.example/a/{u}", PLAIN.format(x)) for i, (u, x) in enumerate(["1x", "1x", "2x", "3y", "4y", "4z", "5w"])]
    rows = [(i, u.rstrip("wxyz"), h) for i, u, h in rows]
    rows += [(10, "http://copies.example/1", PLAIN.format("c")), (11, "http://copies.example/2", PLAIN.format("c"))]
    got = texts(spark, rows)
    for i, x in enumerate("xxxyyzw"):
        assert got[i] == f"{x} first {x} second"
    assert got[10] == got[11] == "Menu c first c second Imprint"


def test_shared_lines_of_longer_pages():
    rng = random.Random(3)
    for size in (9, 40, 130):
        for _ in range(30):
            a, b = ([rng.randrange(7) for _ in range(rng.randrange(size))] for _ in range(2))
            best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
            kept = [x for x, keep in zip(a, html_text.shared_lines(a, b), strict=True) if keep]
            rest = iter(b)
            assert len(kept) == best[-1][-1] and all(x in rest for x in kept)


def test_long_pages_are_differenced_in_bounded_time():
    own = [f"line {i}" for i in range(20_000)]
    other = ["new", *(x for i, x in enumerate(own) if i % 3), "end"]
    begun = time.process_time()
    shared = html_text.shared_lines(own, other)
    assert shared.tolist() == [bool(i % 3) for i in range(20_000)] and time.process_time() - begun < 30
