"""No article text is lost by depth, beside the content or after an open notice."""

import time

import pytest

from spanweave.llm import html_density

LONG = "A sentence of the article with a good number of words in it, and no links at all, that goes on. " * 6


def paragraphs(name, n=3):
    return "".join(f"<p>{name} {k} {LONG}</p>" for k in range(n))


def test_depth_changes_nothing():
    page = lambda depth: "<section>" + paragraphs("beside", 1) + "</section>" + "<div>" * depth + paragraphs("inside")
    shallow, deep = html_density.main_text(page(5)), html_density.main_text(page(600))
    assert "beside 0" in shallow and deep == shallow


def test_loose_text_beside_the_content():
    text = html_density.main_text(f"<div id=main>Intro {LONG}<br><div>{paragraphs('inside')}</div>Closing {LONG}</div>")
    lines = text.split("\n")
    assert lines[0].startswith("Intro") and lines[-1].startswith("Closing") and sum(x.startswith("inside") for x in lines) == 3


def test_loose_text_keeps_its_inline_elements_and_breaks():
    text = html_density.main_text(f"<div id=main>Intro <b>bold</b> {LONG}<br>more<div>{paragraphs('inside')}</div></div>")
    lines = text.split("\n")
    assert lines[0].startswith("Intro bold A") and lines[1] == "more" and len(lines) == 5


def test_open_notice_ends_where_a_paragraph_ends():
    for notice in ("<p class=notice>short", "<div><p class=notice>short</div>"):
        text = html_density.main_text(f"<article>{notice}{paragraphs('kept')}</article>")
        assert "kept 0" in text and "kept 2" in text and "short" not in text


ARTICLE = "<p>First long paragraph of the article text that goes on and on.</p><p>Second paragraph, as long as the first one is, and plain.</p>"
PLAIN = "First long paragraph of the article text that goes on and on.\nSecond paragraph, as long as the first one is, and plain."


@pytest.mark.parametrize("wrapper", ["<div class='has-sidebar'>{}</div>", "<div id=page class=nav-open><div class='layout sidebar'>{}</div></div>"])
def test_layout_names_on_wrappers_of_the_article(wrapper):
    side = "<div class=sidebar><p>Side text that nobody wants to read here at all.</p></div>"
    comments = "<div class=comments><article class=comment-body><p>A reader says that all of this is wrong.</p></article><h1>Replies</h1></div>"
    assert html_density.main_text("<html><body>" + wrapper.format(f"<article>{ARTICLE}</article>{side}") + comments + "</body></html>") == PLAIN


@pytest.mark.parametrize("piece,end", [("<div>", ""), ("<a", ""), ("<a ", ""), ("<a \"", ""), ("<!", ""), ("<div class=nav>", ""), ("<b>", "<li>x</li>"), ("<p>", "</b>"), ("</script", ""), ("<!-", ""), ("<td><p>", "</p>")])
def test_time_follows_length(piece, end):
    def seconds(n):
        page, began = piece * n + end * n, time.perf_counter()
        html_density.main_text(page)
        return time.perf_counter() - began

    assert seconds(16_000) < 12 * max(seconds(4_000), 0.02)


def test_rows_are_extracted_each_for_itself(spark):
    pages = spark.createDataFrame([(1, "u", f"<article>{ARTICLE}</article>", "clash", 5)] * 2 + [(None, None, None, None, None), (2, "v", "plain & simple", None, None)], "page_id bigint, url string, html string, text string, n_chars int")
    rows = [tuple(r) for r in html_density.extract_text(pages).collect()]
    assert sorted(rows, key=repr) == sorted([(1, "u", PLAIN, len(PLAIN))] * 2 + [(None, None, "", 0), (2, "v", "plain & simple", 14)], key=repr)
    assert html_density.extract_text(pages.filter("false")).count() == 0
