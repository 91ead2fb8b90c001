"""Articles inside elements that a page declares to be template."""

import time

import pytest

from dayloom.llm import html_text

BODY = "<article><header><h1>Title</h1></header><p>text</p><aside>see also</aside><p>end</article>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><form id='aspnetForm'><nav>a</nav>{BODY}<footer>f</footer></form>",
        f"<body><div>skip</div><form><div class='page'>{BODY}</div></form><div>last</div>",
        f"<body><div>skip</div><nav><ul><li>a<li>b</ul>{BODY}",
        f"<body><div class='ad'>buy{BODY}",
        f"<body><div>skip</div><div class='widget text'>{BODY}</div>",
        f"<body><div class='modal'><form>{BODY}</form></div>",
        f"<body><aside>{BODY}</aside>",
        f"<body><div>skip</div><aside><nav>a</nav><main>{BODY}</main></aside>",
        f"<body><main><form><nav>a</nav>{BODY}</form></main>",
    ],
)
def test_enclosed_article_is_text(page):
    found = html_text.page_lines(page)
    assert [x for kind, x in found if kind == html_text.ARTICLE] == ["Title", "text", "end"]


@pytest.mark.parametrize(
    "page",
    [
        "<body>{0}<section id='comments'><article><p>reader</article></section>",
        "<body>{0}<div class='widget'><article><p>teaser</article></div>",
        "<body><article><p>Title<p>text<p>end<aside>more<article><p>teaser</article></article>",
        "<body>{0}<form class='comment-form'><article><p>reader</article></form>",
    ],
)
def test_other_articles_stay_template(page):
    found = html_text.page_lines(page.format(BODY))
    assert [x for kind, x in found if kind == html_text.ARTICLE] == ["Title", "text", "end"]


def test_teasers_do_not_replace_undeclared_text():
    found = html_text.page_lines("<body><p>text</p><aside><article>teaser</article></aside>")
    assert found == [(html_text.OTHER, "text"), (html_text.TEMPLATE, "teaser")]


def test_deep_nesting_is_linear():
    start = time.perf_counter()
    found = html_text.page_lines("<div class=widget><article>x" * 50_000)
    assert len(found) == 50_000 and time.perf_counter() - start < 30
