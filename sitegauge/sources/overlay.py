"""Inputs derived from a bare ``pages`` table (page_id, url, html).

A bare table has no headers, no site files and hardly any head markup, so most audits would
come out constant on it. The overlay adds markup, headers and site files to **every** row by
plain CASE expressions on the page and site number. The texts below are in the SQL that both
Spark and other engines read, so the same inputs can be rebuilt elsewhere.

``{n}`` is the page number (``page_id`` plus a shift, which gives a second snapshot);
``{s}`` the site number (smallest page number of the origin).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.url import origin

# ---- addresses: some pages name their host in capitals or with the default port ----------
URL = r"""CASE page_id % 17 WHEN 3 THEN regexp_replace(url, '^(https?://[^/]*)', upper(regexp_extract(url, '^(https?://[^/]*)', 1)))
 WHEN 5 THEN regexp_replace(url, '^(https://[^/:]*)(/|$)', concat(regexp_extract(url, '^(https://[^/:]*)', 1), ':443/')) ELSE url END"""

# ---- markup put right after </title> -------------------------------------------------
HEAD = (
    """CASE {n} % 11
 WHEN 0 THEN '<meta name="robots" content="noindex, nofollow">'
 WHEN 1 THEN '<META NAME="GoogleBot" CONTENT="NoAI">'
 WHEN 2 THEN '<meta content="noimageai, noai" name="bingbot"><meta name="bingbot" content="noindex">'
 WHEN 3 THEN '<!-- <meta name="robots" content="noindex"> -->'
 WHEN 4 THEN '<meta name="robots" content="none">'
 WHEN 5 THEN '<meta name=robots content=noindex><meta name="googlebot-news" content=" NOFOLLOW , noimageai ">'
 ELSE '' END""",
    """CASE {n} % 7
 WHEN 0 THEN '<meta name="TDM-Reservation" content=" 1 ">'
 WHEN 1 THEN '<meta name="tdm-reservation" content="0"/>'
 WHEN 2 THEN '<meta name="tdm-reservation" content="banana">'
 WHEN 3 THEN '<meta name="tdm-reservation">'
 WHEN 4 THEN '<meta name="tdm-reservation" content="&#49;">'
 ELSE '' END""",
    """CASE {n} % 5
 WHEN 0 THEN '<link rel="alternate tdm-policy" href="/tdm/policy.json">'
 WHEN 1 THEN '<link rel="tdm-policy"><link rel="tdm-policy" href="/second.json">'
 WHEN 2 THEN '<link rel="TDM-Policy" href="/upper.json">'
 ELSE '' END""",
    """CASE {n} % 9
 WHEN 0 THEN '<script type="application/ld+json">{{"@context":"https://schema.org","@type":"Organization","name":"Acme","url":"https://acme.example","logo":"https://acme.example/l.png"}}</script>'
 WHEN 1 THEN '<script type="application/ld+json">{{"@type":"Article","headline":</script>'
 WHEN 2 THEN '<script type="application/ld+json">{{"@context":"https://schema.org","@graph":[{{"@type":"Article","headline":"H","author":{{"@type":"Person","name":"Ann Lee"}},"datePublished":"2025-03-01"}},{{"@type":"Organization","name":"Acme"}}]}}</script>'
 WHEN 3 THEN '<script type="application/ld+json">{{"@type":["Article","NewsArticle"],"headline":"H","author":{{"name":"No Type"}},"image":"i.png"}}</script>'
 WHEN 4 THEN '<script type="application/ld+json">{{"@type":"FAQPage","mainEntity":[{{"@type":"Question","name":"Q"}}]}}</script>'
 WHEN 5 THEN '<script type="application/ld+json">{{"@type":"HowTo","name":"N","publisher":{{"name":"P"}}}}</script><script type="application/ld+json">{{"@type":"https://schema.org/Organization","name":"B","address":[{{"city":{{"x":1}}}}]}}</script>'
 WHEN 6 THEN '<!-- <script type="application/ld+json">{{"@type":"Article"}}</script> -->'
 WHEN 7 THEN '<script type="application/ld+json">[{{"@type":"Article","headline":"L","datePublished":"2024-12-24","dateModified":"2025-01-02"}},{{"@type":"HowTo","name":"M","step":[]}}]</script>'
 ELSE '' END""",
    """CASE {n} % 10
 WHEN 0 THEN '<meta name="author" content="Dr. Jane Smith">'
 WHEN 1 THEN '<link rel="author" href="/people/sam">'
 WHEN 3 THEN '<meta name="author" content="Sam Lee">'
 WHEN 4 THEN '<meta name="author" content="Jos&eacute; O&#x27;Hara, MBA">'
 ELSE '' END""",
    """CASE {n} % 13
 WHEN 0 THEN '<meta property="article:published_time" content="2025-01-15">'
 WHEN 1 THEN '<meta property="article:published_time" content="2024-11-05T08:30:00"><meta property="article:modified_time" content="2025-02-01T12:00:00">'
 WHEN 3 THEN '<meta property="article:published_time" content="soon">'
 ELSE '' END""",
    """CASE {n} % 14
 WHEN 0 THEN concat('<link rel="canonical" href="', url, '">')
 WHEN 1 THEN '<link rel="canonical" href="https://www.example.org/other">'
 WHEN 2 THEN '<link rel="canonical" href="/same-host">'
 WHEN 3 THEN '<link rel="canonical" href="//cdn.example.net/x">'
 WHEN 4 THEN '<link rel="canonical" href="?q=1&amp;p=2#part">'
 WHEN 5 THEN '<link rel="canonical" href="../up/./x/../y?z">'
 WHEN 6 THEN '<link rel="canonical" href="./%2E%2e/a/..">'
 WHEN 7 THEN '<link rel="canonical" href="#part">'
 WHEN 8 THEN concat('<link rel="canonical" href="', upper(regexp_extract(url, '^(https?://[^/?#]*)', 1)), ':443/../a//b/">')
 WHEN 9 THEN concat('<link rel="canonical" href="', regexp_replace(url, '#.*$', ''), '#section">')
 ELSE '' END""",
    """CASE {n} % 6
 WHEN 0 THEN '<meta property="og:title" content="T"><meta property="og:description" content="D"><meta property="og:image" content="i.png"><meta property="og:url" content="/u"><meta name="twitter:card" content="summary">'
 WHEN 1 THEN '<meta property="og:title" content="T">'
 WHEN 2 THEN '<meta name="twitter:card" content="summary"><meta property="OG:Title" content="">'
 ELSE '' END""",
)
# ---- canonical links from page to page: chains of up to ten, which end, lead out, meet at page 0 or run in a circle
NEXT_PAGE = """CASE WHEN page_id % 10 < 9 THEN page_id + 1
 WHEN page_id % 40 = 19 THEN page_id - 6 WHEN page_id % 40 = 39 THEN 0 END"""
NEXT_LINK = """concat('<link rel="canonical" href="', CASE WHEN page_id % 40 = 29 THEN 'https://outside.example/x' ELSE replace(next_url, '&', '&amp;') END, '">')"""

# ---- markup put after every <br> ------------------------------------------------------
AFTER_BREAK = """CASE {n} % 3
 WHEN 0 THEN '<h3>Deep point</h3>'
 WHEN 1 THEN '<h2 class="s">Main <em>point</em></h2>'
 ELSE '' END"""
# ---- markup put before </article> -------------------------------------------------------
ARTICLE_END = (
    """CASE {n} % 5
 WHEN 0 THEN '<a href="mailto:desk@acme.example">Mail us</a>'
 WHEN 1 THEN '<a href="tel:+4930123">Call</a><a href="/contact">Contact</a>'
 WHEN 2 THEN '<a href="/privacy">Privacy policy</a> <a href="/legal/terms">Terms of use</a>'
 WHEN 3 THEN '<a href="https://study.example.edu/a">A study</a><a href="https://Study.example.edu/b">More</a><a href="/tdmrep.json">TDM</a>'
 ELSE '<a rel="author nofollow" href="//people.example.org/ann">Ann</a>' END""",
    """CASE {n} % 12
 WHEN 0 THEN '<div itemscope itemtype="https://schema.org/Person"><span itemprop="name">Jo</span><i itemprop="jobTitle">Cook</i></div>'
 WHEN 1 THEN '<div vocab="https://schema.org/" typeof="Article Thing"><span property="headline">Hi</span></div>'
 WHEN 2 THEN '<p>By <span itemprop="author">Max Roe, PhD</span></p>'
 WHEN 3 THEN '<!-- <i itemprop="author">Dr. Gone</i> <a href="/x">Kontakt</a> --><i itemprop="author">Kim SIMBA</i>'
 WHEN 4 THEN '<h2>Open heading<p>and its text.</p>'
 ELSE '' END""",
    """CASE {n} % 4
 WHEN 1 THEN '<section><table><tr><td>1</td></tr></table><ol><li>one</li></ol></section><time datetime="2024-06-30">June</time>'
 WHEN 2 THEN '<aside>See also</aside><h1>Second title</h1>'
 ELSE '' END""",
    """CASE {n} % 8
 WHEN 3 THEN '<article><p>A comment.</p><article class="reply">Its reply.</article></article><p>Words after the comments.</p>'
 WHEN 4 THEN '</article></article><article>Never <main>closed <article>part</article> here'
 WHEN 6 THEN '<MAIN >Inner <main id="x">main</main > text</main><article'
 ELSE '' END""",
)
MAIN_OPEN = "CASE {n} % 4 WHEN 0 THEN '<main>Lead in ' ELSE '' END"
MAIN_CLOSE = "CASE {n} % 4 WHEN 0 THEN '</main>' ELSE '' END"

# ---- response headers ---------------------------------------------------------------
XRT_NAME = "CASE {n} % 4 WHEN 0 THEN 'X-Robots-Tag' WHEN 1 THEN 'x-robots-tag' END"
XRT_VALUE = (
    "CASE {n} % 8 WHEN 0 THEN 'noindex, noai' WHEN 1 THEN 'NoImageAI' WHEN 4 THEN 'nofollow' "
    "WHEN 5 THEN 'googlebot: noindex' END"
)
TDM_VALUE = "CASE {n} % 6 WHEN 0 THEN '1' WHEN 1 THEN ' 0 ' WHEN 2 THEN 'yes' WHEN 3 THEN '' END"

# ---- site files -----------------------------------------------------------------------
_NL = "', chr(10), '"


def _lines(*lines: str) -> str:
    return "concat('" + _NL.join(lines) + "')"


ROBOTS_BODY = f"""CASE {{s}} % 12
 WHEN 0 THEN {_lines('User-agent: *', 'Disallow: /', '')}
 WHEN 1 THEN {_lines('User-agent: GPTBot', 'Disallow: /', '')}
 WHEN 2 THEN {_lines('User-agent: *', 'Allow: /', 'Disallow: /de/', 'Allow: /de/6', 'Disallow: /en/1', '')}
 WHEN 3 THEN {_lines('User-agent: *', 'Disallow: /', '', 'User-agent: GPTBot', 'Allow: /', 'User-agent: GoogleOther', 'Disallow: /fr/')}
 WHEN 4 THEN {_lines('User-agent: PerplexityBot', 'User-agent: Bytespider', 'Disallow: /de', 'Disallow: /', 'Allow: /en/', '', 'User-agent: *', 'Disallow: /fr/', '')}
 WHEN 5 THEN {_lines('user-agent : gptbot # no training', 'User-Agent: ChatGPT-User', 'Disallow: / # all of it', 'Sitemap: https://x.example/s.xml')}
 WHEN 6 THEN {_lines('User-agent: *', 'Crawl-delay: 10', 'Disallow:', 'User-agent: ClaudeBot', 'Disallow: /')}
 WHEN 7 THEN {_lines('This is no rule', 'Disallow: /early', 'User-agent: CCBot', 'Disallow: /', 'User-agent: CCBot', 'Allow: /', 'Crawl-delay: 2.5', 'Crawl-delay: 4')}
 WHEN 8 THEN {_lines('User-agent: *', 'TDM-Reservation: 1', 'Disallow: /', 'Allow: /', 'User-agent: cohere-ai', 'Allow: /', 'Disallow: /')}
 WHEN 9 THEN '# nothing here'
 WHEN 10 THEN {_lines('User-agent: *', 'Allow:', 'Crawl-delay: soon', 'User-agent: Bytespider', 'Disallow: /en/', 'Disallow: /de/')}
 ELSE {_lines('User-agent: *', 'Disallow: /')} END"""
ROBOTS_STATUS = "CASE {s} % 12 WHEN 11 THEN 404 ELSE 200 END"
TDMREP_BODY = "CASE {s} % 5 WHEN 0 THEN '[]' WHEN 1 THEN concat(' ', chr(123), '}}') WHEN 2 THEN '[1]' ELSE '[]' END"
TDMREP_TYPE = "CASE {s} % 5 WHEN 0 THEN 'application/json' WHEN 4 THEN 'application/json' ELSE 'text/plain' END"
TDMREP_STATUS = "CASE {s} % 5 WHEN 4 THEN 404 ELSE 200 END"
HAS_TDMREP = "{s} % 3 < 2"
HAS_AI_TXT = "{s} % 4 = 0"


def html_sql(n: str) -> str:
    """SQL for the html with its overlay."""
    head = "concat('</title>', " + ", ".join(h.format(n=n) for h in HEAD) + ")"
    end = "concat(" + ", ".join(a.format(n=n) for a in ARTICLE_END) + f", '</article>', {MAIN_CLOSE.format(n=n)})"
    out = f"replace(html, '<br>', concat('<br>', {AFTER_BREAK.format(n=n)}))"
    out = f"replace({out}, '<article>', concat({MAIN_OPEN.format(n=n)}, '<article>'))"
    out = f"replace({out}, '</article>', {end})"
    return f"CASE {n} % 19 WHEN 7 THEN concat(chr(10), ' ', chr(9)) WHEN 11 THEN NULL ELSE replace({out}, '</title>', {head}) END"


def overlay_pages(pages: DataFrame, shift: int = 0) -> DataFrame:
    """Pages with derived markup and response headers; batch or stream."""
    n = f"(page_id + {shift})"
    xrt_name, xrt_value, tdm = (t.format(n=n) for t in (XRT_NAME, XRT_VALUE, TDM_VALUE))
    entries = F.array(
        F.struct(F.lit("Content-Type").alias("k"), F.lit("text/html").alias("v")),
        F.struct(F.expr(xrt_name).alias("k"), F.expr(xrt_value).alias("v")),
        F.struct(F.lit("TDM-Reservation").alias("k"), F.expr(tdm).alias("v")),
    )
    headers = F.map_from_entries(F.filter(entries, lambda e: e["k"].isNotNull() & e["v"].isNotNull()))
    named = pages.select("page_id", F.expr(URL).alias("url"), "html")
    return named.select("page_id", "url", F.expr(html_sql(n)).alias("html"), headers.alias("headers"))


def overlay_chains(pages: DataFrame) -> DataFrame:
    """Pages whose first canonical link leads to another page of the table."""
    named = pages.select("page_id", F.expr(NEXT_PAGE).alias("next_page"), F.expr(URL).alias("url"), "html")
    others = pages.select(F.col("page_id").alias("next_page"), F.col("url").alias("next_url"))
    linked = named.join(others, "next_page", "left")
    return linked.select("page_id", "url", F.expr(f"concat(coalesce({NEXT_LINK}, ''), coalesce(html, ''))").alias("html"))


# Items of five kinds by page number, nested ones, void elements and text in parts among them; SQL of both engines.
ITEMS = """CASE page_id % 5
 WHEN 0 THEN concat('<div itemscope itemtype="https://schema.org/Article"><h2 itemprop="headline">Page <b>', CAST(page_id AS VARCHAR(20)), '</b></h2><p>x<div itemprop="author creator" itemscope itemtype="https://schema.org/Person"><span itemprop="name">Ann &amp; Co</span><a itemprop="url" href="/a/', CAST(page_id % 7 AS VARCHAR(20)), '">me</a></div><meta itemprop="datePublished" content="2025-01-0', CAST(page_id % 9 + 1 AS VARCHAR(20)), '"></div>')
 WHEN 1 THEN concat('<ol vocab="https://schema.org/" typeof="BreadcrumbList"><li property="itemListElement" typeof="ListItem"><a property="item" typeof="WebPage" href="/x"><span property="name">Start</span></a><meta property="position" content="', CAST(page_id AS VARCHAR(20)), '"></li><li property="itemListElement" typeof="ListItem Thing"><span property="name alternateName">Two</span></li></ol><meta property="og:title" content="T">')
 WHEN 2 THEN concat('<!-- <div itemscope> --><section itemscope><time itemprop="start" datetime="2025">now</time><time itemprop="end">later <i>on</i></time><img itemprop="image" src="/', CAST(page_id AS VARCHAR(20)), '.png"><div itemscope itemtype="A  B"></div><script>"<div itemscope>"</script></section><b itemprop="lost">z</b>')
 WHEN 3 THEN concat('<div itemscope><div><div itemprop="a"><div>in', CAST(page_id AS VARCHAR(20)), '</div> out</div></div><data itemprop="n" value="5">five</data><link itemprop="no-address"></div><div typeof="Thing"><time property="at">1</time><a property="to" resource="#r" href="/h">x</a></div>')
 ELSE '' END"""


# JSON-LD whose nodes refer to each other: across blocks, in circles, to nowhere, to several nodes of one name.
REFERENCES = """CASE page_id % 4
 WHEN 0 THEN concat('<script type="application/ld+json">{"@type":"Article","@id":"#a","author":{"@id":"#p', CAST(page_id AS VARCHAR(20)), '"},"publisher":{"@id":"#gone"},"image":{"url":"i.png"}}</script><script type="application/ld+json">{"@type":["Person","Thing"],"@id":"#p', CAST(page_id AS VARCHAR(20)), '","worksFor":{"@type":"Organization","@id":"#o","member":{"@id":"#a"}}}</script>')
 WHEN 1 THEN '<script type="application/ld+json">{"@graph":[{"@id":"#x","@type":"https://schema.org/WebPage","isPartOf":[{"@id":"#x"},{"@id":"#y"}]},{"@id":"#y","@type":"WebSite"},{"@id":"#y","@type":"CreativeWork"},{"@id":"#z","name":"bare"},{"@type":"Thing","about":{"@id":"#z"}}]}</script>'
 WHEN 2 THEN '<script type="application/ld+json">{"@type":"Thing","a":{"b":{"@id":"#deep"},"@id":"#deep"},"c":{"@type":"Place","@id":"#deep"}}</script>'
 ELSE '' END"""


def overlay_references(pages: DataFrame) -> DataFrame:
    """Pages that begin with JSON-LD whose nodes refer to each other."""
    return pages.select("page_id", F.concat(F.expr(REFERENCES.replace("VARCHAR(20)", "STRING")), F.coalesce("html", F.lit(""))).alias("html"))


def overlay_items(pages: DataFrame) -> DataFrame:
    """Pages that begin with items of Microdata or RDFa."""
    return pages.select("page_id", F.concat(F.expr(ITEMS.replace("VARCHAR(20)", "STRING")), F.coalesce("html", F.lit(""))).alias("html"))


def overlay_site_files(pages: DataFrame, shift: int = 0) -> DataFrame:
    """Up to three files per origin, from one narrow aggregate over the page addresses."""
    sites = pages.groupBy(origin(F.expr(URL)).alias("origin")).agg(F.min("page_id").alias("site_no"))
    s = f"(site_no + {shift})"

    def file(path: str, status: str, kind: str, body: str):
        return F.struct(
            F.lit(path).alias("path"),
            F.expr(status.format(s=s)).cast("int").alias("status"),
            F.expr(kind.format(s=s)).alias("content_type"),
            F.expr(body.format(s=s)).alias("body"),
        )

    files = F.array(
        file("/robots.txt", ROBOTS_STATUS, "'text/plain'", ROBOTS_BODY),
        F.when(F.expr(HAS_TDMREP.format(s=s)), file("/tdmrep.json", TDMREP_STATUS, TDMREP_TYPE, TDMREP_BODY)),
        F.when(F.expr(HAS_AI_TXT.format(s=s)), file("/ai.txt", "200", "'text/plain'", "'ok'")),
    )
    return sites.select("origin", F.inline(F.array_compact(files)))
