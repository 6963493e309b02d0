"""Main text of pages of many forms, against texts written by hand and, on the tables, against a rule for their one form."""

from __future__ import annotations

import html
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm import main_text as m
from skyledger.llm.main_text import main_text
from skyledger.llm.queries import op13_main_text

A = "The harbour was closed for three days, and no ship left until the wind had turned to the south."
B = "On the fourth morning two ferries sailed; their captains said that the sea was still high &amp; grey."
C = "Nobody was hurt, but the pier lost its lamps."
TEXT = f"{A} {html.unescape(B)} {C}"
MENU = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>World news</a></li><li><a href='/c'>Sport</a></li></ul>"

PAGES = {
    "article": f"<html><head><title>T</title></head><body><nav>{MENU}</nav><article><h1>Storm</h1><p>{A}</p><p>{B}<p>{C}</article><footer>&copy; 2024</footer></body></html>",
    "short lines stay": f"<body><article><h1>Storm</h1><p>{A}</p><p>{B}</p><p>{C}</p><p>End.</p></article></body>",
    "main": f"<body><div id='header'>The Daily Sea</div><main><h1>Storm</h1><p>{A}</p><p>{B}</p><p>{C}</p></main><div class='sidebar'><p>Most read this week: the long history of our lighthouse keepers and their families.</p></div></body>",
    "divs": f"<body><div>{MENU}</div><div><div><h2>Storm</h2><p>{A}</p><p>{B}</p><p>{C}</p></div></div><div><a href='/x'>Imprint</a> <a href='/y'>Contact</a></div></body>",
    "no containers": f"<h1>Storm</h1>{A}<br>{B}<br><br>{C}",
    "reader comments": f"<body><article><h1>Storm</h1><p>{A}</p><p>{B}</p><p>{C}</p><section class='comments'><h3>2 comments</h3><article class='comment'><p>{A}</p></article><p>{B} {B} {B}</p></section></article></body>",
    "comment articles apart": f"<body><article><h1>Storm</h1><p>{A}</p><p>{B}</p><p>{C}</p></article><div id='disqus_thread'><article class='comment'><p>{A} {A} {A} {A} {A} {A}</p></article></div></body>",
    "notice and advert inside": f"<body><div class='cookie-notice'>We use cookies to give you the best experience on our site and ask for your consent to do so.</div><article><h1>Storm</h1><p>{A}</p><div class='ad'>Buy boots now, half price until Sunday.</div><p>{B}</p><aside>Related: the great flood of 1953 and what we learned.</aside><p>{C}</p></article></body>",
    "forms": f"<body><form action='/s'><label>Search</label><input><p>{A}</p></form><article><h1>Storm</h1><p>{A}</p><p>{B}</p><form><p>Subscribe to our letter and never miss a storm again.</p><button>Go</button></form><p>{C}</p></article></body>",
    "form around the page": f"<body><form><div><h1>Storm</h1><p>{A}</p><p>{B}</p><p>{C}</p></div></form></body>",
    "header of the article": f"<body><header><h2>The Daily Sea</h2></header><article><header><h1>Storm</h1><p>By our reporter</p></header><p>{A}</p><p>{B}</p><p>{C}</p><footer>Filed under: weather</footer></article></body>",
    "scripts and styles": f"<body><article><style>p {{ color: red }}</style><h1>Storm</h1><script>var t = '</p>'; if (a < b) x('<p>no</p>');</script><p>{A}</p><noscript>Turn on scripts</noscript><p>{B}</p><p>{C}</p><svg><text>x</text></svg></article></body>",
    "class names that deny": f"<body class='has-sidebar'><div class='no-comments with-sidebar'><article class='post no-sidebar'><h1>Storm</h1><p>{A}</p><p>{B}</p><p>{C}</p></article></div></body>",
    "hinted wrapper of an article": f"<body><div class='header-widgets'><article><h1>Storm</h1><p>{A}</p><p>{B}</p><p>{C}</p></article></div></body>",
    "upper case, no quotes": f"<BODY><NAV>{MENU}</NAV><ARTICLE ID=x><H1>Storm</H1><P>{A}<P>{B}<P>{C}</ARTICLE><FOOTER>x</FOOTER></BODY>",
    "inline tags and spaces": f"<body><article><h1>St<b>or</b>m</h1><p>\n {A.replace('ship', '<i>sh</i>ip')} </p>\t<div><p>{B}</p></div><pre>Nobody was hurt,\n   but the pier&nbsp;lost its lamps.</pre></article></body>",
    "unfinished": f"<body><article><h1>Storm</h1><p>{A}</p><p>{B}</p><p>{C}</p><p",
    "unfinished comment": f"<body><article><h1>Storm</h1><p>{A}</p><!-- ok --><p>{B}</p><p>{C}</p><!-- never closed <p>{A}</p>",
    "hidden": f"<body><article><h1>Storm</h1><p>{A}</p><p hidden>Hidden</p><p style='display: none'>Also hidden</p><p>{B}</p><p>{C}</p></article></body>",
    "table of numbers inside": f"<body><article><h1>Storm</h1><p>{A}</p><table><tr><td>On the fourth</td><td>morning two ferries sailed;</td></tr></table>{B.split(';', 1)[1]}<p>{C}</p></article></body>",
    "list of links inside": f"<body><article><h1>Storm</h1><p>{A}</p><p>{B}</p><p>{C}</p><ul><li><a href='/1'>Flood</a></li><li><a href='/2'>Wind</a></li><li><a href='/3'>Rain</a></li></ul></article></body>",
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    want = {"short lines stay": f"Storm {TEXT} End."}.get(name, f"Storm {TEXT}")
    assert main_text(PAGES[name]) == want


def test_plain_and_nothing():
    assert main_text("just words, no tags") == "just words, no tags"
    assert [main_text(x) for x in (None, "", " \n", "<nav>a</nav>", "<p></p>", "<script>x")] == [""] * 6
    assert main_text("<title>t</title>") == ""


def test_smoothing_and_threshold():
    flat = m.smoothed(np.full(9, 4.0))
    assert np.allclose(flat, 4.0) and m.threshold(flat) == 0.0
    bump = m.smoothed(np.array([0, 0, 0, 10.0, 0, 0, 0]))
    assert bump.argmax() == 3 and 0 < bump[2] < bump[3] and np.allclose(bump, bump[::-1])
    assert 2 < m.threshold(np.array([1.0, 1.2, 0.9, 80.0, 95.0])) < 80


def test_portions_change_nothing(monkeypatch):
    whole = [main_text(p) for p in PAGES.values()]
    for size in (1, 7, 50):
        monkeypatch.setattr(m, "PORTION", size)
        assert [main_text(p) for p in PAGES.values()] == whole


def test_all_pages_of_the_table(spark, sf):
    """The table's pages have one form, so that a rule of their own can say what is right."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = op13_main_text(spark, sf).collect()
    assert len(found) == len(pages)
    for r in found:
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id].html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(p|br|h1)>", " ", inner))).split())
        assert (r.text, r.n_chars, r.url) == (want, len(want), pages[r.page_id].url)


@pytest.mark.parametrize("page", ["<a" * 300_000, "<!--" * 300_000, "<div>" * 50_000 + "x", "</div>" * 50_000, "<![CDATA[" * 50_000, "<a href='" * 50_000, "<script>" * 50_000, "x" * 3_000_000, "<ul><li>" * 20_000, "<p>word</p>" * 30_000])
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 10


def test_awkward_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "v", PAGES["article"]), (3, "w", PAGES["article"]), (3, "w", PAGES["article"]), (4, "x", "<article>" + "long words " * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("id", "text", "n_chars")})
    got = sorted((r.id or 0, r.url or "", r.n_chars) for r in m.extract(df).collect())
    n = len(f"Storm {TEXT}")
    assert got == [(0, "v", n), (1, "u", 0), (2, "", 0), (3, "w", n), (3, "w", n), (4, "x", 2_199_999)]
    assert m.extract(df.limit(0)).count() == 0
