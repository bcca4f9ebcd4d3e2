"""Articles in wrappers whose names speak of something else, and pages with more comments than article."""

import pytest

from facetmill.llm import html_extract, warc

ARTICLE = ["A title of it", ("Some words of an article that goes on and on, so that it reads well. " * 4).strip(), ("A second paragraph with more words than the first one has. " * 6).strip()]
COMMENTS = "<div class='comments'><p>" + "I think that this is a comment by a reader who liked it very much indeed. " * 3 + "</p></div>"
AROUND = "<nav><a href=x>Home</a> <a href=y>About us</a></nav><div class='cookie-notice'><p>We use cookies to make this site work for you and for everyone else who comes here.</p></div>"
FOOT = "<footer><p>Copyright 2024 by someone who owns all of the words on this page and others.</p></footer>"
WRAPPERS = [
    "article class='post comments-open'", "article id='comment-policy-2024'", "div class='post comments-open'", "div class='entry promoted'",
    "div class='story related-links-on'", "main class='ad-free'", "article class='post'", "div class='article'",
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("inside", [0, 1, 6])
def test_wrappers_keep_their_article(wrapper, inside):
    """However the wrapper is called and however many comments it holds, the article stays and nothing else does."""
    body = f"<h1>{ARTICLE[0]}</h1><p>{ARTICLE[1]}</p><p>{ARTICLE[2]}</p>" + COMMENTS * inside
    page = f"<html><body>{AROUND}<{wrapper}>{body}</{wrapper.split()[0]}>{COMMENTS}{FOOT}</body></html>"
    assert html_extract.main_text(page) == "\n\n".join(ARTICLE)


def test_very_long_pages_in_parts(spark):
    """Batches are cut by their size; a page of many MB is read whole."""
    page = "<article>" + "<p>" + "word " * 40 + "</p>\n"
    rows = [(k, "u", page * n) for k, n in enumerate((1, 9000, 2, 9000))]
    got = {r.page_id: r.n_chars for r in html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got == {k: 199 * n + 2 * (n - 1) for k, n in enumerate((1, 9000, 2, 9000))}


def test_record_ids_are_unique(spark):
    """Rows that come again are records of their own; revisits name the response."""
    pages = spark.createDataFrame([(1, "u", "x")] * 5 + [(2, "u", "x"), (3, "v", "y"), (None, None, None), (None, None, None)], "page_id long, url string, html string")
    paths = [r.path for r in warc.write_archives(pages).collect()]
    heads = [warc.parsed(record)[0] for path in paths for record in warc.read_archive(path)]
    ids = [h["WARC-Record-ID"] for h in heads]
    assert len(ids) == len(set(ids)) == 9
    assert {h["WARC-Refers-To"] for h in heads if h["WARC-Type"] == "revisit"} <= {h["WARC-Record-ID"] for h in heads if h["WARC-Type"] == "response"}
