"""Markup that is broken, closed in itself or hidden; long broken pages stay linear."""

import time

import pytest

from dayloom.llm.html_text import main_texts, page_lines

PAGES = {
    '<article><p>One <svg class="i"/> two</p><p>three</p></article>': "One two three",
    '<article><p>One <iframe src="x"> two</p><p>three</p></article>': "One two three",
    "<article><p>One <textarea/> two</p><p>three</p></article>": "One two three",
    '<article><p>One <span class="advert">buy <span>now</span> x</span> two</p></article>': "One two",
    "<article><p>One</p><div hidden>no</div><div data-hidden='1'>two</div><p class='x' HIDDEN>no</p></article>": "One two",
    '<article><p>a < b &amp; <b>c</b></p><script>var t="</p>";</script><p title="x > y">d</p></article>': "a < b & c d",
    '<article><p>One</p><svg><text>no</text></svg><p>two</p><script>all the rest': "One two",
    "<article><p>1<2 <a href=>x</a></p><!-- no": "1<2 x",
    '<article><p>One</p><p title="open>two</p></article>': "One two",
}


def test_texts(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(PAGES)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in main_texts(pages).collect()}
    assert got == dict(enumerate(PAGES.values()))


@pytest.mark.parametrize("part", ["<a ", '<a "', '<a href="x', "<!", "<svg>", "</svg ", "<iframe ", "<!--", "<p '>", '<a "><'])
def test_a_megabyte_of_open_markup_is_linear(part):
    took = []
    for size in (1 << 18, 1 << 20):
        begun = time.process_time()
        page_lines(part * (size // len(part)))
        took.append(time.process_time() - begun)
    assert took[1] < max(12 * took[0], 1)
