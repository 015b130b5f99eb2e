"""Page-level signals: robots directives in markup and headers, mining-reservation signals.

Each function adds columns to a row; nothing here shuffles, and all of it runs on a stream.
Values used more than once are columns of their own, so that they are worked out once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.headers import header
from sitegauge.functions.markup import head_tags, link_first_sql, meta_first_sql, project_tags
from sitegauge.functions.rows import keep_where
from sitegauge.functions.sqltext import lit, struct
from sitegauge.functions.text import split_trimmed_sql, strip, strip_sql

# Meta names that carry robots directives, in the order they are reported.
META_ROBOTS_NAMES = ("robots", "googlebot", "googlebot-news", "bingbot")
# Channels and outcomes of a mining policy.
HTTP_HEADER, META_TAG, LINK_TAG, TDMREP_JSON = "http_header", "meta_tag", "link_tag", "tdmrep_json"
RESERVED, NOT_RESERVED, NOT_DECLARED = "reserved", "not_reserved", "not_declared"

_FLAGS = {
    "noindex": "array_contains({d}, 'noindex')",
    "nofollow": "array_contains({d}, 'nofollow')",
    "ai_word": "CASE WHEN array_contains({d}, 'noai') THEN 'noai' WHEN array_contains({d}, 'noimageai') THEN 'noimageai' END",
}


def with_head(pages: DataFrame) -> DataFrame:
    """Read the head tags once; all later operators share them."""
    return pages.withColumn("head", head_tags("html"))


def meta_robots() -> Column:
    """``array<struct<ord, meta_name, content, noindex, nofollow, ai_word>>`` of the names present."""
    names = "array(" + ", ".join(lit(n) for n in META_ROBOTS_NAMES) + ")"
    found = f"transform({names}, (n, i) -> {struct(ord='i', meta_name='n', tag=meta_first_sql('n'))})"
    content = struct(ord="f.ord", meta_name="f.meta_name", content="coalesce(lower(f.tag.content), '')")
    present = f"transform(filter({found}, f -> f.tag IS NOT NULL), f -> {content})"
    split = f"transform({present}, c -> {struct(c='c', d=split_trimmed_sql('c.content'))})"
    flags = {k: v.format(d="s.d") for k, v in _FLAGS.items()}
    out = struct(ord="s.c.ord", meta_name="s.c.meta_name", content="s.c.content", **flags)
    return F.expr(f"transform({split}, s -> {out})")


def crawl_facts(df: DataFrame) -> DataFrame:
    """Adds ``meta_robots`` and ``x_robots`` (null without the header; nofollow is not looked at there)."""
    df = df.withColumn("_xrt", header(F.col("headers"), "x-robots-tag"))
    df = df.withColumn("_d", F.expr(f"transform({split_trimmed_sql('_xrt')}, x -> lower(x))"))
    flags = {k: _FLAGS[k].format(d="_d") for k in ("noindex", "ai_word")}
    x_robots = F.expr(f"CASE WHEN _xrt IS NOT NULL THEN {struct(value='_xrt', **flags)} END")
    return df.withColumns({"meta_robots": meta_robots(), "x_robots": x_robots}).drop("_xrt", "_d")


def crawl_penalty() -> Column:
    """Points lost to robots directives: 10/5 per high/medium tag issue, 5/3 per header issue."""
    return F.expr(
        "aggregate(meta_robots, 0, (acc, m) -> acc + if(m.noindex, 10, 0) + if(m.nofollow, 5, 0)"
        " + if(m.ai_word IS NOT NULL, 5, 0))"
        " + if(coalesce(x_robots.noindex, false), 5, 0) + if(x_robots.ai_word IS NOT NULL, 3, 0)"
    )


def tdm_header_value(headers: Column) -> Column:
    return strip(header(headers, "tdm-reservation"))


def tdm_meta_value() -> Column:
    """Trimmed content of the first tag; empty without content, null without the tag."""
    tag = meta_first_sql("'tdm-reservation'")
    content_or_empty = "coalesce(t.content, '')"
    content = f"transform(array({tag}), t -> if(t IS NULL, NULL, {strip_sql(content_or_empty)}))"
    return F.expr(f"get({content}, 0)")


def tdm_link_value() -> Column:
    """Address in the first policy link; a later link is not tried when the first has none."""
    link = link_first_sql("tdm-policy")
    return F.expr(strip_sql(f"coalesce({link}.href, '')"))


def _valued(source: str, value: str, where: str) -> str:
    policy = f"CASE {value} WHEN '1' THEN '{RESERVED}' WHEN '0' THEN '{NOT_RESERVED}' ELSE '{NOT_DECLARED}' END"
    details = (
        f"CASE {value} WHEN '1' THEN '{where} reserves mining rights' WHEN '0' THEN '{where} permits mining' "
        f"ELSE concat('{where} holds neither 0 nor 1: ', {value}) END"
    )
    made = struct(source=lit(source), policy=policy, raw_value=value, details=details)
    return f"CASE WHEN {value} IS NOT NULL THEN {made} END"


def header_signal_sql(value: str) -> str:
    return _valued(HTTP_HEADER, value, "header")


def meta_signal_sql(value: str) -> str:
    return _valued(META_TAG, value, "meta tag")


def link_signal_sql(href: str) -> str:
    """A policy link counts as a reservation."""
    made = struct(source=lit(LINK_TAG), policy=lit(RESERVED), raw_value=href, details=f"concat('link to policy ', {href})")
    return f"CASE WHEN {href} <> '' THEN {made} END"


def tdmrep_signal_sql(origin: str, present: str) -> str:
    made = struct(
        source=lit(TDMREP_JSON), policy=lit(RESERVED), raw_value=f"concat({origin}, '/tdmrep.json')",
        details="'policy file is served'",
    )
    return f"CASE WHEN {present} THEN {made} END"


def tdm_facts(df: DataFrame) -> DataFrame:
    """Signals of the page itself; the site's policy file comes with the site join."""
    df = df.withColumns(
        {"_header": tdm_header_value(F.col("headers")), "_meta": tdm_meta_value(), "_link": tdm_link_value()}
    )
    signals = f"array_compact(array({header_signal_sql('_header')}, {meta_signal_sql('_meta')}, {link_signal_sql('_link')}))"
    return df.withColumn("page_signals", F.expr(signals)).drop("_header", "_meta", "_link")


def all_signals() -> Column:
    """Header, meta, link, policy file: in this order. ``site_address`` is the page's origin as written."""
    site = tdmrep_signal_sql("site_address", "coalesce(tdmrep, false)")
    return F.expr(f"array_compact(concat(page_signals, array({site})))")


VALID = f"filter(signals, s -> s.policy <> '{NOT_DECLARED}')"
INVALID = f"filter(signals, s -> s.policy = '{NOT_DECLARED}')"
CONFLICT = f"(exists(signals, s -> s.policy = '{RESERVED}') AND exists(signals, s -> s.policy = '{NOT_RESERVED}'))"


def sources_sql(policy: str) -> str:
    """Channels that state a policy, in signal order."""
    return f"transform(filter(signals, s -> s.policy = '{policy}'), s -> s.source)"


def valid_signals() -> Column:
    return F.expr(VALID)


def invalid_signals() -> Column:
    return F.expr(INVALID)


def policy_set() -> Column:
    """Distinct declared policies of the page."""
    return F.expr(f"array_distinct(transform({VALID}, s -> s.policy))")


def tdm_status() -> Column:
    """One plain label per page."""
    return F.expr(
        f"CASE WHEN size(signals) = 0 THEN 'undeclared' WHEN {CONFLICT} THEN 'conflicting' "
        f"WHEN size({VALID}) = 0 THEN 'invalid' "
        f"WHEN exists(signals, s -> s.policy = '{RESERVED}') THEN 'reserved' ELSE 'open' END"
    )


def tdmrep_references(pages: DataFrame) -> DataFrame:
    """Pages that link to a tdmrep.json, with the number of links; comments and scripts are not read."""
    hits = project_tags("html", "a|link|area", ["href"], where="(?i)tdmrep")
    found = F.size(F.filter(hits, lambda t: t["href"].rlike(r"(?i)tdmrep\.json"))).alias("n_references")
    return keep_where(pages, ["page_id", found], "n_references > 0")
