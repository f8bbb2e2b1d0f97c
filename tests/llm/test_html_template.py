"""Operator 6: what counts decide, and what stays."""

import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lorevane.llm import html_template

SF = "/root/testdata/sf0.01"


def extracted(spark, pages):
    rows = html_template.digest(spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    return {r["page_id"]: r["text"] for r in rows}


def plain(page):
    """The text of a page's article, for pages whose article has headings, paragraphs, b and br only."""
    body = re.search("<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split("</?(?:h1|p)>", body.replace("<br>", " "))
    said = [" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in blocks]
    return "\n\n".join(s for s in said if s)


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_given_pages(spark, monkeypatch, broadcast):
    monkeypatch.setattr(html_template, "BROADCAST_ROWS", broadcast)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_template.digest(pages).collect()}
    assert got == {r["page_id"]: plain(r["html"]) for r in pages.collect()}


def test_counts_alone_take_out_what_recurs_on_the_given_pages(spark):
    """Without any class word the counts of subtrees leave the article of every page; without counts as well, of none."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    template = {}
    for r in html_template.templates(pages.select("html", html_template.host(F.col("url")).alias("host"))).where("subtree IS NOT NULL").collect():
        template.setdefault(r["host"], {})[r["subtree"]] = r["share"]
    rows = pages.where("page_id % 5 = 0").collect()
    with pytest.MonkeyPatch.context() as m:
        for words in ("_BOILERPLATE", "_OUTSIDE"):
            m.setattr(html_template, words, frozenset())
        assert all(html_template.main_text(r["html"], template[r["url"].split("/")[2].lower()]) == plain(r["html"]) for r in rows)
        assert all(html_template.main_text(r["html"], {}) != plain(r["html"]) for r in rows)


def test_neutral_names_beside_an_article(spark):
    """Menus and slots under names that say nothing, their texts different on each page."""
    menu = lambda i: "".join(f"<li><a href='/{k}'>Topic {k if k != i % 5 else i}</a>" for k in range(6))
    page = lambda i: (f"<body><div class=x1><ul>{menu(i)}</ul></div><div class=x2>Slot number {i}</div><main><p>Lead {i}.</p><article><h1>Title {i}</h1>"  # noqa: E731
                      f"<p>Body {i}.</p><p>Read our other texts</p></article></main><div class=x3>Made by us</div></body>")
    got = extracted(spark, [(f"http://h/{i}", page(i)) for i in range(12)])
    assert got == {i: f"Lead {i}.\n\nTitle {i}\n\nBody {i}." for i in range(12)}
    assert all(html_template.main_text(page(i), {}) != got[i] for i in range(12))


@pytest.mark.parametrize("name", ["discussion", "related", "search", "alert", "x"])
def test_sections_of_articles_stay(spark, name):
    page = lambda i: f"<nav>n</nav><article><h1>T{i}</h1><section class='{name}'><p>Said {i}.</p></section></article>"
    pages = [(f"http://h/{i}", page(i)) for i in range(8)] + [("http://lonely/", page(8))]
    assert extracted(spark, pages) == {i: f"T{i}\n\nSaid {i}." for i in range(9)}


def test_comments_and_adverts_in_articles_go(spark):
    page = lambda i: (f"<article><p>Text {i}.</p><div class='ad'>Buy {i}</div><section class='comments'><p>I think {i}</p></section></article>"  # noqa: E731
                      f"<article class=comment><p>So do I {i}</p></article><div>Beside</div>")
    assert extracted(spark, [(f"http://h/{i}", page(i)) for i in range(7)] + [("http://lonely/", page(7))]) == {i: f"Text {i}." for i in range(8)}


def test_class_words_do_not_wait_for_counts(spark):
    """A sidebar and comments that only one page has, on a host of one page and among twelve others."""
    page = lambda i: f"<main><p>Main {i}</p></main>"
    odd = "<main><div class='sidebar'>Side 50</div><p>Main 50</p><div class='comments'>reader says</div><p class=share>Shared by few</p></main>"
    got = extracted(spark, [(f"http://h/{i}", page(i)) for i in range(12)] + [("http://h/50", odd), ("http://lonely/50", odd)])
    assert got == {i: f"Main {i}" for i in range(12)} | {12: "Main 50\n\nShared by few", 13: "Main 50\n\nShared by few"}


HOSTILE = ["<script ", "<a ", '<a "', "<a '\"", "<a<a", "<!x", "</", "<!--", '<a "x" ', "<p><table><span><div>", "<td>", "<li><b>", "&", "<b><div></b>", "class=\"", "<a class=' "]


@pytest.mark.parametrize("tail", ["", ">", "\"'>"])
@pytest.mark.parametrize("part", HOSTILE)
def test_hostile_markup_takes_no_longer_than_its_length(part, tail):
    page = lambda n: part * (n // len(part)) + tail
    began = time.process_time()
    html_template.main_text(page(500_000))
    assert time.process_time() - began < 10


def test_tags_are_found_as_a_pattern_finds_them():
    """The scanner against one regular expression over small pages of broken markup."""
    raw = "|".join(html_template._RAW)
    pattern = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{raw})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*>|(?P<text>[^<]+|<)", re.S | re.I)
    parts = ["<p>", "</p>", "<a href=x>", "</a>", "text ", "<", "<!--", "-->", "<script>", "</script >", "<script src='a>b'>", "'", '"', ">", "<br/>", "<img alt=\"a>b\">", "<!doctype x>", "</ x>", "<?php ?>", "<p ", "<STYLE>", "</style>", "<style-x>", "\n"]
    rng = random.Random(3)
    for _ in range(4000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        want = [(m["text"], None, False) if m["text"] is not None else (m["attrs"], m["name"].lower(), m["close"] == "/") for m in pattern.finditer(page) if m["text"] is not None or m["name"] is not None]
        assert list(html_template.tokens(page)) == want, page


def test_copied_articles_stay(spark):
    same = "<article><h1>News</h1><p>Copied everywhere</p><ul><li>Point</ul></article>"
    pages = [("http://h/", f"<div>Menu {i}</div>{same}<footer>f</footer>") for i in range(9)] + [("http://g/", f"<div>Menu</div>{same}")] * 9
    got = extracted(spark, pages)
    assert set(got.values()) == {"News\n\nCopied everywhere\n\nPoint"}


def test_pages_without_article(spark):
    pages = [(f"http://h/{i}", f"<div><div>Our shop <i>sells</i></div><div>Text number {i}</div></div>") for i in range(8)] + [(None, None), ("http://other/", "<div>Our shop <i>sells</i></div>")]
    got = extracted(spark, pages)
    assert got[3] == "Text number 3" and got[8] == "" and got[9] == "Our shop sells"


def test_odd_markup():
    text = html_template.main_text
    page = ("<body><header>site<h1>X</h1></header><main><article><header><h1>T &amp; U</h1></header><p>a  b<br>c&nbsp;d<div class='sidebar'>no</div><p>e"
            "<script>x='</p>'</script><section id='comments'><article class='comment'>reader</article></section><form>f</form></article></main><div class=ad>buy</div><p>out")
    assert text(page) == "T & U\n\na b c d\n\ne"
    assert text("<p>only<p>two <b>x</b>y") == "only\n\ntwo xy" and text("a < b") == "a < b" and text("") == ""
    assert text("<div>" * 100_000 + "deep") == "deep" and text("<p>" * 50_000 + "x") == "x" and text("</p>" * 9 + "<b>y") == "y"
    assert text("<article><p hidden>kept</p><div href=/a/>also</div></article>") == "kept\n\nalso"
    assert text("<p>" + "long text " * 500_000) == " ".join(["long text"] * 500_000)


def test_rows_of_every_kind(spark):
    rows = [(1, None, None, "c", 0), (1, None, None, "c", 0), (None, "x", "<p>a</p>", "c", 1), (2, "//HOST:80/p", "<p>b</p>", None, 2), (2, "//HOST:80/p", "<p>b</p>", None, 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, template int")
    got = html_template.digest(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r["page_id"] or 0, r["url"] or "", r["text"]) for r in got.collect()) == [(0, "x", "a"), (1, "", ""), (1, "", ""), (2, "//HOST:80/p", "b"), (2, "//HOST:80/p", "b")]
