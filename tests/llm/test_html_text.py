"""Main text of pages: areas, ambiguous blocks, broken markup."""

import pytest

from tapeworks.llm.html_text import OPEN, extract, first_pass, main_text, second_pass

LONG = "The quick fox and the lazy dog are in the field with all of their friends for the day."
SCHEMA = "page_id long, url string, html string, text string, `key` string, _html string, c0 string, n_chars string"


def text(html):
    return main_text(html)[0]


@pytest.mark.parametrize("html,expect", [
    (None, ""), ("", ""), ("  \n ", ""), ("plain words", "plain words"), ("<", "<"), ("a < b &amp;&lt; c", "a < b &< c"),
    (f"<nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>{LONG}<p>Short.</article><footer>Foot.</footer>", f"Title {LONG} Short."),
    (f"<header>Site</header><article><header><h1>Title</h1></header><p>{LONG}</article>", f"Title {LONG}"),
    (f"<article><p>{LONG}</p><div class='ad box'>{LONG}</div><p>End</p></article>", f"{LONG} End"),
    (f"<article><p>{LONG}</p></article><section id=comments><p>{LONG}</p></section>", LONG),
    (f"<body><div class=userComments><p>{LONG}</p></div><div><p>{LONG}</p><p>By me</p></div>", f"{LONG} By me"),
    (f"<aside>{LONG}</aside><form>{LONG}<button>Go</button></form><main><p>{LONG}</main>", LONG),
    (f"<script>var a = '<p>{LONG}</p>';</script><style>p{{}}</style><!-- <p>{LONG}</p> --><p>{LONG}</p>", LONG),
    (f"<article><p><b>Lead.<br><p>{LONG}</p></article>", f"Lead. {LONG}"),
    ("<article><p>%%% $$$ ***</p><p>x</p></article>", "%%% $$$ *** x"),
    (f"<article><p>{LONG}</p><ul><li><a href=1>More</a><li><a href=2>Links</a></ul><p>Caf&eacute;&nbsp;&#8211; ok&copy</p></article>", f"{LONG} Café – ok©"),
    (f"<article><div style='display:none'>{LONG}</div><p hidden>{LONG}</p><p>in<i>li</i>ne</p></article>", "inline"),
    (f"<article><p>{LONG}</article><footer>cut off <a hr", LONG),
    (f"<DIV CLASS=Sidebar>{LONG}</DIV><P>{LONG}", LONG),
    (f"<table><tr><td>{LONG}<td>cell</table>", f"{LONG} cell"),
])
def test_pages(html, expect):
    assert text(html) == expect


def test_passes():
    assert first_pass(LONG, 0.0, False, False) == "good" and first_pass(LONG, 0.9, False, True) == "bad" and first_pass("Short.", 0.0, False, True) == OPEN
    labels = ["good", OPEN, OPEN, OPEN, "bad", OPEN]
    assert second_pass(labels, [0] * 6, [False] * 6) == [True, True, False, False, False, False]
    assert second_pass(labels, [0] * 6, [True] * 6) == [True, True, True, True, False, True]
    assert second_pass(["bad", OPEN, "bad"], [0] * 3, [True] * 3) == [False] * 3
    assert second_pass([OPEN] * 2, [0, 1], [False, True]) == [False, True]
    assert second_pass([OPEN], [0], [False]) == [True]


def test_long_page_is_linear():
    many = "<article>" + "<p>word</p>" * 50_000 + f"<p>{LONG}</p></article>"
    out, n, kept = main_text(many)
    assert n == kept == 50_001 and out.endswith(LONG)
    deep = "<div>" * 3000 + LONG
    assert text(deep) == LONG


def test_table(spark):
    data = [(None, None, None, *"abcde"), (1, "u", f"<article>{LONG}", *"abcde"), (1, "u", f"<article>{LONG}", *"abcde"), (2, "v", "", *"abcde")]
    pages = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = sorted(map(tuple, extract(pages).select("page_id", "url", "text", "n_chars", "n_kept").collect()), key=repr)
    assert got == sorted([(None, None, "", 0, 0), (1, "u", LONG, len(LONG), 1), (1, "u", LONG, len(LONG), 1), (2, "v", "", 0, 0)], key=repr)
    assert extract(pages.limit(0)).count() == 0
    assert extract(pages, keep=("page_id", "key", "_html", "c0")).columns[:4] == ["page_id", "key", "_html", "c0"]
