"""Main text and metadata of pages written by hand."""

import pytest
from pyspark.sql import functions as F

from newsloom.functions import page

LONG = "The council voted on Monday to rebuild the old bridge over the river after years of debate and delay."
ALSO = "Engineers said that the work would take two summers and that traffic would be led over the northern road."
NAV = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("home", "world", "sport"))
PAGES = {
    "plain": (f"<html><head><title>T</title></head><body><nav><ul>{NAV}</ul></nav><article><h1>Bridge vote</h1><p>{LONG}</p><p>{ALSO}</p></article><footer>© all</footer></body></html>", ["Bridge vote", LONG, ALSO]),
    "links without nav": (f"<body><ul>{NAV}</ul><p>{LONG}</p><p>{ALSO}</p><div><a href='/a'>{ALSO}</a></div></body>", [LONG, ALSO]),
    "unclosed": (f"<body><p>{LONG}<p>{ALSO}", [LONG, ALSO]),
    "inline tags and entities": (f"<p>A <b>bold</b> word &amp; a <a href='/x'>link</a> in a line.<br/>{LONG}</p><p>{ALSO}</p>", [f"A bold word & a link in a line. {LONG}", ALSO]),
    "markup in scripts": (f"<script>var t='<p>{ALSO}</p>'</script><p>{LONG}</p><!-- <p>{ALSO}</p> --><style>p{{}}</style><p>{ALSO}</p>", [LONG, ALSO]),
    "header is no head": (f"<header>Site</header><p>{LONG}</p>", ["Site", LONG]),
    "link list at the end": (f"<p>{LONG}</p><p>{ALSO}</p><ul>{NAV * 9}</ul>", [LONG, ALSO]),
    "advert of few words": (f"<div>Buy this now</div><div>Or that</div><div>Nothing</div><p>{LONG}</p>", ["Nothing", LONG]),
    "upper case and spaces": (f"<P CLASS='x'\n>{LONG}</P\n><DIV>{ALSO}</DIV>", None),
    "nothing": ("<body><nav><a href='/'>x</a></nav></body>", []),
    "empty": ("", []),
    "null": (None, []),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(k, v[0]) for k, v in PAGES.items()], "name string, html string")
    return {r.name: r.text for r in rows.select("name", page.main_text(F.col("html")).alias("text")).collect()}


@pytest.mark.parametrize("name", [k for k, v in PAGES.items() if v[1] is not None])
def test_main_text(found, name):
    assert found[name].split("\n") == (PAGES[name][1] or [""])


def test_tags_in_upper_case(found):
    assert LONG in found["upper case and spaces"] and ALSO in found["upper case and spaces"] and "CLASS" not in found["upper case and spaces"]


def test_a_very_long_page(spark):
    html = f"<body><ul>{NAV * 2000}</ul>" + f"<p>{LONG}</p>" * 20_000
    text = spark.createDataFrame([(html,)], "html string").select(page.main_text(F.col("html")).alias("t")).first().t
    assert text.count("\n") == 19_999 and text.startswith(LONG)


def test_metadata(spark):
    ld = '{"@type":"NewsArticle","headline":"From the object","author":{"name":"A. Writer"},"datePublished":"2024-01-02","publisher":{"name":"Paper"}}'
    cases = {
        "tags": '<meta property="og:title" content="Title &amp; more"><meta content=\'B. Other\' name=\'author\'><meta property="article:published_time" content="2024-01-03"><meta property="og:image" content="http://x/y.png"><title>no</title>',
        "object": f'<script type="application/ld+json">{ld}</script><title>no</title>',
        "title": "<title>\n Only  <b>this</b></title><h1>H</h1>", "heading": "<h1>H <i>1</i></h1>", "broken": '<script type="application/ld+json">{"headline": </script><meta name="author" content="">', "null": None,
    }
    rows = spark.createDataFrame(list(cases.items()), "name string, html string").select("name", page.metadata(F.col("html")).alias("m")).select("name", "m.*")
    got = {r.name: (r.title, r.author, r.published, r.image, r.site) for r in rows.collect()}
    assert got == {
        "tags": ("Title & more", "B. Other", "2024-01-03", "http://x/y.png", None), "object": ("From the object", "A. Writer", "2024-01-02", None, "Paper"),
        "title": ("Only this", None, None, None, None), "heading": ("H 1", None, None, None, None), "broken": (None,) * 5, "null": (None,) * 5,
    }
