"""Markup and header signals: literal cases, a second parser, hostile input."""

from __future__ import annotations

import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from sitegauge.functions import markup, url
from sitegauge.functions.text import WHITESPACE, half_even, number, split_lines, strip, unescape_sql
from sitegauge.operators import attribution, content, signals, structured
from sitegauge.operators import issues as rules
from sitegauge.plans.audit import audit, issues_table
from sitegauge.sources.overlay import overlay_pages
from sitegauge.sources.tables import PAGES_SCHEMA, SITE_FILES_SCHEMA, pages_scan
from tests.helpers import crawl

HEAD = "<html><head>{}</head><body></body></html>"
# html or headers -> (severity, title) of the crawlability issues
ISSUES = [
    ({"html": ""}, []),
    ({"html": "  \n "}, []),
    ({"html": HEAD.format("<title>T</title>")}, []),
    ({"html": HEAD.format('<meta name="robots" content="noindex">')}, [("high", "meta robots: noindex directive found")]),
    ({"html": HEAD.format('<meta name="robots" content="nofollow">')}, [("medium", "meta robots: nofollow directive found")]),
    ({"html": HEAD.format('<meta name="robots" content="noindex, nofollow">')},
     [("high", "meta robots: noindex directive found"), ("medium", "meta robots: nofollow directive found")]),
    ({"html": HEAD.format('<meta name="robots" content="noai">')}, [("medium", "meta robots: noai directive found")]),
    ({"html": HEAD.format('<meta name="robots" content="noimageai">')}, [("medium", "meta robots: noimageai directive found")]),
    ({"html": HEAD.format('<meta name="googlebot" content="noindex">')}, [("high", "meta googlebot: noindex directive found")]),
    ({"html": HEAD.format('<meta name="ROBOTS" content="noindex">')}, [("high", "meta robots: noindex directive found")]),
    ({"html": HEAD.format('<meta name="robots" content="none">')}, []),
    ({"html": HEAD.format('<meta name="robots" content="index"><meta name="robots" content="noindex">')}, []),
    ({"html": HEAD.format('<!-- <meta name="robots" content="noindex"> -->')}, []),
    ({"html": HEAD.format("<script>'<meta name=\"robots\" content=\"noindex\">'</script>")}, []),
    ({"html": HEAD.format('<meta data-name="robots" content="noindex">')}, []),
    ({"html": HEAD.format("<meta content='say name=\"robots\"' name=other>")}, []),
    ({"html": HEAD.format("<META\n NAME = robots\tCONTENT = NoIndex />")}, [("high", "meta robots: noindex directive found")]),
    ({"html": HEAD.format('<meta name="x" name="robots" content="noindex">')}, [("high", "meta robots: noindex directive found")]),
    ({"html": HEAD.format('<meta-x name="robots" content="noindex">')}, []),
    ({}, []),
    ({"headers": {"X-Robots-Tag": "noindex"}}, [("high", "X-Robots-Tag: noindex header found")]),
    ({"headers": {"X-Robots-Tag": "noai"}}, [("medium", "X-Robots-Tag: noai header found")]),
    ({"headers": {"x-robots-tag": "noindex"}}, [("high", "X-Robots-Tag: noindex header found")]),
    ({"headers": {"X-Robots-Tag": "noindex, noai"}},
     [("high", "X-Robots-Tag: noindex header found"), ("medium", "X-Robots-Tag: noai header found")]),
    ({"headers": {"X-Robots-Tag": "nosnippet"}}, []),
    ({"headers": {"X-Robots-Tag": "nofollow"}}, []),
    ({"headers": {"X-Robots-Tag": "googlebot: noindex"}}, []),
]


def test_page_issues(spark):
    pages, files = crawl(spark, [{"robots": "User-agent: *\nAllow: /", **c} for c, _ in ISSUES])
    rows = issues_table(audit(pages, files, "crawlability")).orderBy("page_id", "ord").collect()
    for i, (case, want) in enumerate(ISSUES):
        assert [(r.severity, r.title) for r in rows if r.page_id == i] == want, case
    assert {r.category for r in rows} == {"crawlability"}


# header value / meta markup -> signals as (source, policy, raw value)
SIGNALS = [
    ({"headers": {"TDM-Reservation": "1"}}, [("http_header", "reserved", "1")]),
    ({"headers": {"TDM-Reservation": "0"}}, [("http_header", "not_reserved", "0")]),
    ({"headers": {"TDM-Reservation": "yes"}}, [("http_header", "not_declared", "yes")]),
    ({"headers": {"TDM-Reservation": " 1 "}}, [("http_header", "reserved", "1")]),
    ({"headers": {"TDM-Reservation": ""}}, [("http_header", "not_declared", "")]),
    ({"headers": {"tdm-reservation": "1"}}, [("http_header", "reserved", "1")]),
    ({"headers": {"Content-Type": "text/html"}}, []),
    ({"html": HEAD.format('<meta name="tdm-reservation" content="1">')}, [("meta_tag", "reserved", "1")]),
    ({"html": HEAD.format('<meta name="tdm-reservation" content="0">')}, [("meta_tag", "not_reserved", "0")]),
    ({"html": HEAD.format('<meta name="tdm-reservation" content="true">')}, [("meta_tag", "not_declared", "true")]),
    ({"html": HEAD.format('<meta name="TDM-Reservation" content="1">')}, [("meta_tag", "reserved", "1")]),
    ({"html": HEAD.format('<meta name="tdm-reservation">')}, [("meta_tag", "not_declared", "")]),
    ({"html": HEAD.format('<link rel="tdm-policy" href="/tdmrep.json">')}, [("link_tag", "reserved", "/tdmrep.json")]),
    ({"html": HEAD.format('<link rel="tdm-policy">')}, []),
    ({"html": HEAD.format('<link rel="tdm-policy" href=" "><link rel="tdm-policy" href="/b">')}, []),
    ({"html": HEAD.format('<link rel="TDM-policy" href="/b">')}, []),
    ({"html": HEAD.format('<link rel="x  tdm-policy" href="/a&amp;b">')}, [("link_tag", "reserved", "/a&b")]),
    ({"html": HEAD.format('<meta name="tdm-reservation" content="1"><link rel="tdm-policy" href="/p">')},
     [("meta_tag", "reserved", "1"), ("link_tag", "reserved", "/p")]),
]


def test_signals(spark):
    pages, _ = crawl(spark, [c for c, _ in SIGNALS])
    rows = signals.tdm_facts(signals.with_head(pages_scan(pages))).select("page_id", "page_signals").collect()
    for r in rows:
        case, want = SIGNALS[r.page_id]
        assert [(s.source, s.policy, s.raw_value) for s in r.page_signals] == want, case


class Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = []

    def handle_starttag(self, tag, attrs):
        if tag in ("meta", "link"):
            d = {k: (v or "") for k, v in attrs}
            self.found.append((tag, *[d.get(f) for f in markup.HEAD_FIELDS]))


def read(html):
    reader = Reader()
    reader.feed(html)
    reader.close()
    return reader.found


def head_of(df):
    got = df.select("page_id", "html", markup.head_tags("html").alias("head")).collect()
    return {r.page_id: (r.html, [tuple(t) for t in r.head]) for r in got}


def test_second_parser_agrees_on_all_pages(spark):
    df = overlay_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    for page, (html, head) in head_of(df).items():
        assert head == read(html or ""), page


ODD = [
    '<meta name="a" content="x > y"><link rel=b href=c/>',
    "<meta name='a' content='it is \"q\"'>",
    '<meta name=a content="un&amp;b">',
    "<meta\n\tname = 'a'\r\n content = b >",
    "<!-- <meta name=a> --><meta name=b>",
    "<script>var a = '<meta name=a>';</script><meta name=b>",
    "<style>/* <link rel=a> */</style><link rel=b>",
    '<meta name="a" name="b" content="c">',
    "<metadata name=a><meta/name=b>",
    '<p title="<meta name=a>">x</p>',
    "<SCRIPT type=x>1</SCRIPT ><META NAME=B>",
]


def test_odd_markup(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "page_id long, html string")
    for page, (html, head) in head_of(df).items():
        if page == 9:  # a tag inside a quoted value of another element is taken for a tag; accepted
            continue
        assert head == read(html), html


def test_hostile_input(spark):
    """Long quoted values, unclosed tags and many attributes are read whole, without recursion."""
    long = "x" * 400_000
    cases = [
        f'<meta name="robots" content="{long}">',
        f"<meta name=robots content={long}>",
        "<meta " + " ".join(f"a{i}=1" for i in range(20_000)) + ' name="robots" content="noindex">',
        f"<!-- {long} --><meta name=robots content=noindex>",
        f"<script>{long}",
        '<meta name="robots" content="' + long,
        "<" * 100_000 + "<meta name=robots content=noindex>",
        "<meta " * 3_000,
    ]
    df = spark.createDataFrame(list(enumerate(cases)), "page_id long, html string")
    tag = F.expr(markup.meta_first_sql("'robots'", "head"))
    got = df.withColumn("head", markup.head_tags("html")).select("page_id", tag["content"].alias("c")).collect()
    found = {r.page_id: r.c for r in got}
    assert found[0] == long and found[1] == long
    assert found[2] == found[3] == found[6] == "noindex"
    assert found[4] is None


def test_work_grows_with_the_page(spark):
    """Constructs that are opened over and over and never closed: 1 MB each through all five dimensions."""
    starts = ["<meta ", "<a ", "<h1>x", "<script ", "<main>", "<article>", "<head>", "<i itemprop=author", "<main ", "<h2 ", "<style>", "<!-- "]

    def run(size):
        pages = spark.createDataFrame([(i, f"https://a.x/{i}", s * (size // len(s)), {}) for i, s in enumerate(starts)], PAGES_SCHEMA)
        began = time.monotonic()
        assert audit(pages, spark.createDataFrame([], SITE_FILES_SCHEMA), None).count() == len(starts)
        audit(pages, spark.createDataFrame([], SITE_FILES_SCHEMA), None).write.format("noop").mode("overwrite").save()
        return time.monotonic() - began

    run(1_000)
    small, large = run(100_000), run(1_000_000)
    assert large < 10 * small + 2 * len(starts), (small, large)


def test_control_characters_make_no_sections(spark):
    df = spark.createDataFrame([(1, "ab\x01cd<h2>T</h2>one\x01two<h2>open<p>end")], "page_id long, html string")
    rows = content.section_blocks(df).orderBy("pos").collect()
    assert [(r.level, r.heading, r.text) for r in rows] == [(2, "T", "one\x01two"), (2, "open end", "")]
    assert content.h1_check(spark.createDataFrame([(1, "<h1>One"), (2, None)], "page_id long, html string")).collect()[0].page_id == 2


def test_comments_are_not_read(spark):
    html = '<!-- <a href="/c">Contact</a><i itemprop="author">Dr. No</i> --><i itemprop="author">Kim SIMBA, MBA</i><a href="/x">Home</a>'
    df = spark.createDataFrame([(1, "https://a.x/", html)], "page_id long, url string, html string")
    assert not attribution.contact_info(df).first().has_contact_link
    assert attribution.eeat_markers(df).first().credentials == "MBA"


def test_jsonld_repeated_keys_types_and_nesting(spark):
    blocks = ['{"a":1,"a":2}', "{'a':1}", '{"a":1} x', "", "[1,2]", '{"@type":"schema:Article"}', '{"@type":"T","mainEntity":[{"name":"q"}],"author":{"@type":"P","address":{"x":1}}}']
    html = "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks)
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    valid = [r.valid for r in structured.jsonld_valid(structured.jsonld_blocks(df)).orderBy("pos").collect()]
    assert valid == [True, False, False, False, True, True, True]
    assert "Article" in {r.type for r in structured.jsonld_types(df).collect()}
    assert {r.property for r in structured.schema_nesting(df).collect()} == {"mainEntity", "author.address"}


def test_character_references_as_the_standard_library_reads_them(spark):
    import html as std

    cases = ["&#49;", "&#x27;", "&eacute;&Uuml;", "&amp;lt;", "a &#039;b&#39; c", "&#128512;", "&#xD800;", "&#0;", "&#1114112;", "&hellip;&nbsp;x", "&nosuch;", "& ;", "R&D", "&#;", "&lt;&gt;&quot;"]
    df = spark.createDataFrame([(c,) for c in cases], "t string").select("t", F.expr(unescape_sql("t")).alias("u"))
    assert {r.t: r.u for r in df.collect()} == {c: std.unescape(c) for c in cases}


@pytest.mark.parametrize(
    ("address", "want"),
    [
        ("https://A.example:8080/x?q=1#f", ("https", "https://a.example:8080", "a.example", "/x?q=1")),
        ("HTTP://u:p@h.example", ("http", "http://u:p@h.example", "h.example", "/")),
        ("//h.example/p", ("", "://h.example", "h.example", "/p")),
        (" https://h.example/a b", ("https", "https://h.example", "h.example", "/a b")),
        ("", ("", "://", "", "/")),
    ],
)
def test_url(spark, address, want):
    c = F.lit(address)
    row = spark.range(1).select(url.scheme(c), url.origin(c), url.host(c), url.path(c)).first()
    assert tuple(row) == want


def test_text(spark):
    odd = [f"{c}x{c}" for c in WHITESPACE] + ["a\r\nb\x0bc d", " 1e3 ", "-.5", "1__0", "0x1", "nan", "1_000.5", "é"]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    c = F.col("t")
    for r in df.select("t", strip(c).alias("s"), split_lines(c).alias("l"), number(strip(c)).alias("n")).collect():
        assert r.s == r.t.strip()
        assert [x for x in r.l if x] == [x for x in r.t.splitlines() if x]
        try:
            want = float(r.t.strip())
        except ValueError:
            want = None
        assert r.n == want or (want != want and r.n != r.n), r.t
    got = spark.createDataFrame([(66.5,), (67.5,), (0.5,), (1.5,)], "x double").select(half_even(F.col("x")).alias("y")).collect()
    assert [r.y for r in got] == [66, 68, 0, 2]


def test_every_rule_has_texts():
    assert set(rules.TITLES) == set(rules.ADVICE) == set(rules.CATEGORY)
    with pytest.raises(ValueError, match="severity"):
        rules.issue("fatal", "tdm", "t", "d", "r")


def held(spark, html, name, first=False):
    from sitegauge.functions.markup import outermost_sql

    df = spark.createDataFrame([(html,)], "html string")
    return df.select(F.expr(outermost_sql("html", name, first))).first()[0]


@pytest.mark.parametrize(
    "html, name, first, want",
    [
        ("<main>a<main>b</main>c</main>d", "main", True, " a<main>bc"),
        ("<article>a</article>x<article>b<article>c</article></article>", "article", False, " a b<article>c"),
        ("</article><article>a</article></article>b", "article", False, " a"),
        ("<article>a<article>b</article>c", "article", False, " a<article>b"),
        ("<article>a</article><article>b", "article", False, " a"),
        ("<MAIN class='x'>a</Main >b<main>c</main>", "main", True, " a"),
        ("<main>a", "main", True, ""),
        ("<mainly>a</mainly>", "main", True, ""),
        ("<main></main>", "main", True, " "),
        (None, "main", True, ""),
    ],
)
def test_outermost_elements(spark, html, name, first, want):
    got = held(spark, html, name, first)
    assert " ".join(got.replace("</main>", "").replace("</article>", "").split()) == " ".join(want.split())


def test_very_many_nested_elements(spark):
    depth = 20_000
    assert held(spark, "<main>x" * depth + "</main>" * depth, "main", True).count("x") == depth
    assert held(spark, "<main>x</main>" * depth, "main").count("x") == depth
