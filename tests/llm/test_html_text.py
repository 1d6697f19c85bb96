import html
import re
import time

import pytest

from stagepath.llm import html_text
from tests.conftest import TESTDATA

LONG = "This is the text of a page and it has all the words that are to be found in it. " * 4
LONG = LONG.strip()


def test_pages_give_exactly_their_article(spark):
    pages = spark.read.parquet(f"{TESTDATA}/sf0.01/pages.parquet")
    by_id = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.extract(pages).collect():
        article = re.search(r"<article>(.*?)</article>", by_id[r.page_id], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", article)
        texts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in parts]
        assert r.text == "\n".join(x for x in texts if x)
        assert r.n_chars == len(r.text)


@pytest.mark.parametrize(
    "beside",
    [
        "<nav><a href=/>Home</a> {}</nav>", "<header><h2>{}</h2></header>", "<footer>{}</footer>",
        "<aside>{}</aside>", '<div class="sidebar left">{}</div>', "<div id='cookie-notice'>{}</div>",
        "<div class=ad>{}</div>", "<form><label>{}</label></form>", "<script>var t='<p>{}</p>'</script>",
        "<style>{}</style>", "<!-- <p>{}</p> -->", '<section class="comments"><p>{}</p></section>',
        "<ul class=menu><li>{}</ul>", "<noscript>{}</noscript>", "<p><a href=/x>{}</a></p>",
    ],
)
@pytest.mark.parametrize("frame", ["<article>{}</article>", "<div>{}</div>"])
def test_leaves_out_what_stands_beside(beside, frame):
    other = beside.replace("{}", "Other words that are of the page and in it. " * 6)
    page = f"<html><body>{other}" + frame.replace("{}", f"<p>{LONG}</p>{other}<p>{LONG}</p>") + other
    assert html_text.main_text(page) == f"{LONG}\n{LONG}"


def test_short_blocks_follow_their_neighbours():
    page = f"<div><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div><div><a href=/>One</a> <a href=/>Two</a></div>"
    assert html_text.main_text(page) == f"{LONG}\nYes.\n{LONG}"


def test_long_blocks_without_stop_words_or_article_are_bad():
    junk = "zxq vbn " * 40
    assert html_text.main_text(f"<p>{junk}</p><p>{LONG}</p>") == LONG
    assert html_text.main_text(f"<article><p>{junk}</p></article>") == junk.strip()


def test_markup_references_and_blanks():
    page = "<article><p>a&amp;b &lt;i&gt; caf&eacute;\n\t x&nbsp;y<br>z <b>bo</b>ld</article>"
    assert html_text.main_text(page) == "a&b <i> café x y z bold"


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("   ", ""), ("<p>", ""), ("plain words", "plain words"), ("a < b", "a < b"),
        ("<script>never closed <p>x", ""), ("<article><p>one<p>two<div>three", "one\ntwo\nthree"),
        ('<div class="ad">x<article><p>in</p></article>', "in"), ("</div></p>x", "x"),
        ('<p title="a>b">x</p>', "x"), ("<p title='never closed>x</p>", "x"),
    ],
)
def test_odd_pages(page, text):
    assert html_text.main_text(page) == text


def test_rows_are_kept_as_they_are(spark):
    rows = [(None, None, None, "z"), (1, "u", "<p>a</p>", "z"), (1, "u", "<p>a</p>", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in html_text.extract(pages).collect())
    assert found == [(0, "", "", 0), (1, "u", "a", 1), (1, "u", "a", 1)]
    assert html_text.extract(pages.limit(0)).collect() == []


def test_very_long_page():
    page = "<article>" + f"<p>{LONG}</p>" * 5000 + "</article>"
    assert html_text.main_text(page).count("\n") == 4999


OTHER = "Other words that are of the page and in it. " * 6
FOREIGN = "Вчера вечером жители города собрались возле старой площади ради праздника урожая. " * 4


@pytest.mark.parametrize(
    "page, text",
    [
        (f'<body class="has-sidebar"><p>{LONG}</p><aside>{OTHER}</aside></body>', LONG),
        (f'<div id="page" class="no-sidebar"><p>{LONG}</p><div class="sidebar">{OTHER}</div></div>', LONG),
        (f'<div id="page" class="comments-open"><p>{LONG}</p></div>', LONG),
        (f'<div id="page" class="comments-open"><article><p>{LONG}</p></article></div>', LONG),
        (f'<p>{LONG}</p><div class="comments"><p>{LONG} {LONG}</p></div>', LONG),
        (f'<article><p>{LONG}</p></article><div class="sidebar">{OTHER * 4}</div>', LONG),
    ],
)
def test_names_of_wrappers_do_not_condemn_the_text(page, text):
    assert html_text.main_text(page) == text


def test_pages_in_other_languages_are_kept():
    page = f"<div><p>{FOREIGN}</p><p>{FOREIGN}</p><nav>{FOREIGN}</nav></div>"
    assert html_text.main_text(page) == f"{FOREIGN.strip()}\n{FOREIGN.strip()}"


@pytest.mark.parametrize(
    "comments",
    [
        "<section class=comments><article><p>{}</p></article></section>",
        '<article class="comment even"><p>{}</p></article>',
        '<div id="post-comments"><ol><li><article id="comment-7">{}</article></ol></div>',
    ],
)
@pytest.mark.parametrize("frame", ["<article>{}</article>", "<div>{}</div>", "<main>{}</main>"])
def test_articles_of_comments_stay_beside(comments, frame):
    said = comments.replace("{}", OTHER)
    assert html_text.main_text(frame.replace("{}", f"<p>{LONG}</p>{said}")) == LONG
    assert html_text.main_text(frame.replace("{}", f"<p>{LONG}</p>") + said) == LONG


@pytest.mark.parametrize(
    "unit",
    ["<a ", "<script ", "<i></b>", "<!", "<style>", "<a \"", "<a \"'\"'", "<p>&", "</a ", "<a x=\">\"", "<b", "<", "<p <",
     "<div><p>x", "class ", "<a class", "</script ", "<!--x-->", "<p class='ad ", "&#"],
)
def test_odd_pages_of_a_megabyte_take_seconds(unit):
    page = unit * (1_000_000 // len(unit))
    start = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - start < 15


def test_many_open_and_unknown_elements_take_seconds():
    start = time.process_time()
    html_text.main_text("<i>" * 60_000 + "</b>" * 60_000 + "x")
    assert time.process_time() - start < 10


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>one</p><SCRIPT>a <p>b</SCRIPT ><p>two</p>", "one\ntwo"),
        ("<p>one<script src='x'>if (a < b) {}</script>two</p>", "onetwo"),
        ("<p>a <b and c</p>", "a <b and c"),
        ('<p>one<a href="x" <b>two</b></p>', "onetwo"),
        ("<p>one <br class='x' / >two</p><!DOCTYPE x>", "one two"),
        ('<p data-x="<b>">in</p>', "in"),
    ],
)
def test_markup_is_told_from_text(page, text):
    assert html_text.main_text(page) == text
