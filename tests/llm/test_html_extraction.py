"""Main text: what the clusters decide, what markup decides, odd pages."""

import pytest

from daybook.llm import html_extraction
from daybook.llm.html_extraction import extract_pages, main_text

LONG = "This sentence stands in the article and says something at length, as articles do. " * 6
PAGE = f"""<html><body><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="ad">Buy now.</div><article><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></article><footer>Imprint</footer></body></html>"""
BARE = f"""<body><div><a href="/x">Home</a> <a href="/y">News</a> <a href="/z">More</a></div><div><h2>Title</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>
<div><a href="/1">Terms</a> <a href="/2">Privacy</a> <a href="/3">Jobs</a> <a href="/4">Press</a></div></body>"""
ARTICLE = "\n\n".join(x.strip() for x in ("Title", LONG, "Short.", LONG))


@pytest.mark.parametrize("page", [PAGE, BARE], ids=["with article", "without"])
def test_clusters_choose_the_regions(monkeypatch, page):
    assert main_text(page) == ARTICLE
    monkeypatch.setattr(html_extraction, "two_clusters", lambda values: -1.0)
    assert main_text(page) != ARTICLE


def test_clusters_choose_on_the_generated_pages(spark, sf_dir, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    with_clusters = [main_text(p) for p in pages]
    monkeypatch.setattr(html_extraction, "two_clusters", lambda values: -1.0)
    changed = sum(main_text(p) != t for p, t in zip(pages, with_clusters, strict=True))
    assert changed > len(pages) * 0.9


def test_classes_inside_an_article_drop_nothing():
    inner = f'<h2 id="related-work">Related work</h2><p class="search-terms">Some terms.</p><label>A label.</label><section id="discussion"><h3 class="header">On files</h3><p>{LONG}</p></section>'
    want = ["Related work", "Some terms.", "A label.", "On files", LONG.strip()]
    assert main_text(f"<body><article>{inner}</article></body>").split("\n\n") == want
    assert main_text(f"<body><div>{inner}</div></body>").split("\n\n")[-1] == LONG.strip()


def test_marked_parts_of_an_article_need_the_clusters():
    page = f'<article><p>{LONG}</p><p>{LONG}</p><div class="comments"><ul><li><b>Ann</b> <i>said</i> <a href="#">Nice</a></li><li><b>Bo</b> <i>said</i> <a href="#">No</a></li></ul></div></article>'
    assert main_text(page).split("\n\n") == [LONG.strip()] * 2


def test_teasers_do_not_replace_the_main_text():
    teaser = f'<article class="teaser"><p>{LONG[:400]}</p></article>'
    assert main_text(f"<body><div>{f'<p>{LONG}</p>' * 6}</div><div>{teaser * 3}</div></body>").split("\n\n") == [LONG.strip()] * 6


def test_title_before_the_article():
    page = f'<body><main><div class="entry-header"><h1>Title</h1></div><div><p>{LONG}</p></div></main></body>'
    assert main_text(page).split("\n\n") == ["Title", LONG.strip()]


def test_odd_pages(spark):
    """Null, empty, markup only, broken, very deep and very long pages; repeated rows; clashing columns; empty tables."""
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    long = "<article>" + "<p>word &amp; word</p>" * 20000 + "</article>"
    rows = [(1, None), (2, ""), (3, "<p>"), (4, "<nav>menu</nav><div class=\"ad\">ad</div>"), (5, "<p>a<p>b &lt;c&gt;</i>"), (6, deep), (7, long), (7, long), (None, "text only")]
    pages = spark.createDataFrame([(i, h, "old") for i, h in rows], "page_id long, html string, text string")
    got = [(r["page_id"], r["text"]) for r in extract_pages(pages).collect()]
    whole = "\n\n".join(["word & word"] * 20000)
    assert sorted(got, key=str) == sorted([(1, ""), (2, ""), (3, ""), (4, ""), (5, "a\n\nb <c>"), (6, "deep"), (7, whole), (7, whole), (None, "text only")], key=str)
    assert extract_pages(pages.limit(0)).columns == pages.columns and extract_pages(pages.limit(0)).count() == 0


def test_articles_of_one_rank_stay_together():
    """Two articles beside a teaser, and four of which one has shorter blocks."""
    sentence = "This sentence stands in the article and says something at length, as articles do. "
    two = f'<body><article><h2>One</h2><p>{sentence * 3}</p></article><article><h2>Two</h2><p>{sentence * 3}</p></article><article class="teaser"><p>Read.</p></article></body>'
    assert main_text(two).split("\n\n") == ["One", (sentence * 3).strip(), "Two", (sentence * 3).strip()]
    four = "<body>" + "".join(f"<article><p>{sentence * (2 if k == 0 else 4)}</p></article>" for k in range(4)) + "</body>"
    assert len(main_text(four).split("\n\n")) == 4


def test_ids_name_other_parts():
    for part in ('<div id="comments"><p>I liked it a lot.</p></div>', '<section id="cookie-notice"><p>We use cookies.</p></section>', '<div class="comments"><p>Nice.</p></div>'):
        assert main_text(f"<article><p>{LONG}</p><p>{LONG}</p>{part}</article>").split("\n\n") == [LONG.strip()] * 2


def test_stray_end_tags_cost_nothing():
    import time

    began = time.perf_counter()
    assert main_text("<p>text</p>" + "<b>" * 100_000 + "</x>" * 100_000) == "text"
    assert time.perf_counter() - began < 20
