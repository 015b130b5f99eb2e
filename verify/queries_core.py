"""Registered queries for access, signals, issues and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.functions import markup, text, url
from sitegauge.functions.headers import header
from sitegauge.functions.rows import inline_rows, keep_where, posexplode_rows
from sitegauge.functions.sqltext import lit
from sitegauge.operators import access, issues, robots, scores, signals
from sitegauge.plans import audit as plan
from sitegauge.sources import overlay, tables
from sitegauge.sources.bots import bot_rows


def raw_pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").withColumn("url", F.expr(overlay.URL))


def pages(spark: SparkSession, d: str, shift: int = 0) -> DataFrame:
    return overlay.overlay_pages(raw_pages(spark, d), shift)


def files(spark: SparkSession, d: str, shift: int = 0) -> DataFrame:
    return overlay.overlay_site_files(raw_pages(spark, d), shift)


def lines(spark: SparkSession, d: str) -> DataFrame:
    return robots.robots_lines(tables.robots_scan(files(spark, d)))


def policies(spark: SparkSession, d: str) -> DataFrame:
    return robots.site_policies(tables.site_scan(files(spark, d)))


def facts(spark: SparkSession, d: str) -> DataFrame:
    return access.site_facts(policies(spark, d))


def head(spark: SparkSession, d: str) -> DataFrame:
    return signals.with_head(tables.pages_scan(pages(spark, d)))


def joined(spark: SparkSession, d: str, dims="crawlability,tdm", shift: int = 0) -> DataFrame:
    p = pages(spark, d, shift)
    chosen = plan.select_dimensions(dims)
    return plan.with_site(plan.page_facts(p, chosen), raw_pages(spark, d), plan.site_table(files(spark, d, shift)))


def audited(spark: SparkSession, d: str, dims=plan.DEFAULT, shift: int = 0, brief: bool = False) -> DataFrame:
    p = pages(spark, d, shift)
    return plan.audit(p, files(spark, d, shift), dims, brief=brief)


def with_signals(spark: SparkSession, d: str) -> DataFrame:
    return joined(spark, d, "tdm").withColumn("signals", signals.all_signals())


def _long(*cols: str):
    return [F.col(c).cast("long").alias(c) for c in cols]


def crawl_readiness(spark, d):
    """Which crawlers are kept out, and how well can each page be crawled?"""
    return joined(spark, d, "crawlability").select(
        "page_id", "origin", F.when(F.col("blocked").isNull(), 0).otherwise(F.size("blocked")).cast("long").alias("blocked_bots"),
        scores.crawl_score(F.col("allowed_weight"), signals.crawl_penalty()).alias("crawl_score"),
    )


def q_pages_scan(spark, d):
    return tables.pages_scan(pages(spark, d)).select(
        "page_id", "url", "origin", F.length("html").cast("long").alias("n_html"),
        F.size("headers").cast("long").alias("n_headers"),
    )


def q_url_origin(spark, d):
    u = F.col("url")
    return raw_pages(spark, d).select(
        "page_id", url.scheme(u).alias("scheme"), url.origin(u).alias("origin"), url.host(u).alias("host"),
        url.path(u).alias("path"),
    )


def q_robots_groups(spark, d):
    return robots.robots_groups(lines(spark, d)).select(
        "origin", *_long("group_id"), F.array_join("user_agents", ",").alias("user_agents"), *_long("n_rules"), "crawl_delay"
    )


def q_bot_group_match(spark, d):
    m = policies(spark, d).select("origin", F.inline_outer(access.group_match()))
    return m.select("origin", "request.bot", *_long("specific_id", "wildcard_id"))


def q_bot_directive(spark, d):
    names = "array(" + ", ".join(lit(b) for b in [*(r[1] for r in bot_rows()), "*", "UnknownBot"]) + ")"
    return access.access_for(policies(spark, d).select("origin", "groups"), names).select(
        "origin", "bot", "operator", "allowed", "reason", "matching_rule"
    )


def _path_access(spark, d, bots=None):
    p = tables.pages_scan(raw_pages(spark, d)).select("page_id", "origin", url.path(F.col("url")).alias("path"))
    return plan.path_access(p, policies(spark, d).select("origin", "groups"), bots)


def q_longest_path_rule(spark, d):
    return _path_access(spark, d, "array('*')").select("page_id", "path", "allowed", "matching_rule")


def q_bot_access_path(spark, d):
    return _path_access(spark, d).select("page_id", "path", "bot", "allowed", "reason")


def q_page_site_join(spark, d):
    p = tables.pages_scan(raw_pages(spark, d)).select("page_id", "origin")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("robots_found", "tdmrep", "ai_txt")]
    return plan.with_site(p, raw_pages(spark, d), plan.site_table(files(spark, d))).select(
        "page_id", "origin", *flags, F.coalesce("allowed_weight", F.lit(100)).cast("long").alias("allowed_weight")
    )


def q_html_tags(spark, d):
    t = posexplode_rows(head(spark, d), ["page_id"], "head", "pos", "t")
    return t.select("page_id", *_long("pos"), "t.*")


def q_meta_first(spark, d):
    names = ("robots", "author", "tdm-reservation")
    staged = head(spark, d).select("page_id", *[F.expr(markup.meta_first_sql(lit(n))).alias(n) for n in names])
    found = F.array_compact(
        F.array(*[
            F.when(F.col(f"`{n}`").isNotNull(),
                   F.struct(F.lit(n).alias("meta_name"), F.coalesce(F.col(f"`{n}`.content"), F.lit("")).alias("content")))
            for n in names
        ])
    )
    return inline_rows(staged, ["page_id"], found, "meta_name")


def q_meta_robots(spark, d):
    df = signals.crawl_facts(head(spark, d))
    return inline_rows(df, ["page_id"], "meta_robots", "meta_name").drop("ord")


def _one_signal(df, value, signal_sql):
    df = df.select("page_id", value.alias("v"))
    return keep_where(df, ["page_id", F.expr(signal_sql("v")).alias("s")], "s IS NOT NULL").select("page_id", "s.source", "s.policy", "s.raw_value")


def q_tdm_header(spark, d):
    df = tables.pages_scan(pages(spark, d))
    return _one_signal(df, signals.tdm_header_value(F.col("headers")), signals.header_signal_sql)


def q_tdm_meta(spark, d):
    return _one_signal(head(spark, d), signals.tdm_meta_value(), signals.meta_signal_sql)


def q_tdm_link(spark, d):
    return _one_signal(head(spark, d), signals.tdm_link_value(), signals.link_signal_sql)


def q_header_lookup(spark, d):
    names = {"x_robots_tag": "x-robots-tag", "tdm_reservation": "tdm-reservation", "content_type": "content-type"}
    return pages(spark, d).select("page_id", *[header(F.col("headers"), n).alias(c) for c, n in names.items()])


def q_x_robots(spark, d):
    df = signals.crawl_facts(tables.pages_scan(pages(spark, d)).withColumn("head", F.array().cast(markup.HEAD_TYPE)))
    return keep_where(df, ["page_id", "x_robots"], "x_robots IS NOT NULL").select("page_id", "x_robots.*")


def q_select_dimensions(spark, d):
    a = audited(spark, d, "tdm")
    return a.select(
        "page_id", "overall_score", *_long("issue_count"),
        F.array_join(F.transform("scores", lambda s: s["category"]), ",").alias("categories"),
    )


def q_blank_html(spark, d):
    """Tags and signals of every page; some pages of the overlay are blank or null."""
    df = pages(spark, d)
    df = signals.tdm_facts(signals.crawl_facts(signals.with_head(tables.pages_scan(df))))
    return df.select(
        "page_id", F.size("head").cast("long").alias("n_tags"), F.size("meta_robots").cast("long").alias("n_meta_robots"),
        F.size("page_signals").cast("long").alias("n_signals"),
    )


def q_valid(spark, d, valid=True):
    f = signals.valid_signals if valid else signals.invalid_signals
    return inline_rows(with_signals(spark, d), ["page_id"], f(), "source").drop("details")


def q_signals_union(spark, d):
    return posexplode_rows(with_signals(spark, d), ["page_id"], "signals", "ord", "s").select(
        "page_id", *_long("ord"), "s.source", "s.policy", "s.raw_value"
    )


def q_policy_set(spark, d):
    return with_signals(spark, d).select(
        "page_id", F.array_join(F.array_sort(signals.policy_set()), ",").alias("policies")
    )


def q_issues(spark, d):
    return plan.issues_table(audited(spark, d)).select(
        "page_id", *_long("ord"), "severity", "category", "rule", "key", "title"
    )


def _json_list(col):
    return F.array_join(F.from_json(col, "array<string>"), ", ")


_DETAILS = {
    "bot_blocked": ["bot", "operator", "reason", "matching_rule"],
    "robots_conflict": ["specifically_allowed[]"],
    "meta_noindex": ["meta_name", "content"],
    "meta_nofollow": ["meta_name", "content"],
    "meta_noai": ["meta_name", "content"],
    "xrt_noindex": ["header_value"],
    "xrt_noai": ["header_value"],
    "tdm_header_invalid": ["raw_value"],
    "tdm_meta_invalid": ["raw_value"],
    "tdm_conflict": ["reserved_by[]", "allowed_by[]"],
    "tdm_declared": ["policy", "sources[]"],
}


def issue_query(rule: str):
    def run(spark, d):
        dims = issues.CATEGORY[rule]
        a = audited(spark, d, dims).withColumn("issues", F.filter("issues", lambda i: i["rule"] == rule))
        rows = plan.issues_table(a)
        extra = []
        for name in _DETAILS.get(rule, []):
            key = name.removesuffix("[]")
            value = F.try_element_at("details", F.lit(key))
            extra.append((_json_list(value) if name.endswith("[]") else value).alias(key))
        return rows.select("page_id", "severity", "title", *extra)

    return run


def q_scores(category):
    def run(spark, d):
        a = audited(spark, d, category, brief=True)
        return a.select("page_id", F.get("scores", F.lit(0))["value"].alias("value"))

    return run


def q_issue_count(spark, d):
    a = audited(spark, d, brief=True)
    n = lambda i: F.get("scores", F.lit(i))["issue_count"].cast("long")
    return a.select("page_id", *_long("issue_count"), n(0).alias("n_crawl"), n(1).alias("n_tdm"))


def q_score_summary(spark, d):
    s = plan.scores_table(audited(spark, d, brief=True))
    return s.select(
        "page_id", scores.label(F.col("category")).alias("label"), scores.bar(F.col("value")).alias("bar"),
        F.concat_ws("/", "value", "max_value").alias("score"), F.col("issue_count").cast("long").alias("issues"),
    )


def q_group_concat(spark, d):
    joined_text = lambda items: F.expr(f"array_join({items}, ', ')")
    return with_signals(spark, d).select(
        "page_id",
        joined_text(f"transform({signals.VALID}, s -> s.source)").alias("sources"),
        joined_text(signals.sources_sql(signals.RESERVED)).alias("reserved_by"),
        joined_text(signals.sources_sql(signals.NOT_RESERVED)).alias("allowed_by"),
    )


def q_first_by_position(spark, d):
    named = F.filter(
        F.transform("head", lambda t, i: F.struct(t.alias("t"), i.alias("i"))),
        lambda x: (x["t"]["el"] == "meta") & x["t"]["name"].isNotNull(),
    )
    df = keep_where(head(spark, d), ["page_id", F.get(named, F.lit(0)).alias("x")], "x IS NOT NULL")
    return df.select("page_id", F.coalesce("x.t.content", F.lit("")).alias("first_meta_content"), F.col("x.i").cast("long").alias("first_pos"))


def q_last_group_wins(spark, d):
    """Agents with the number of the last group that names them."""
    agents = robots.robots_state(lines(spark, d)).filter("kind = 'agent'")
    return agents.groupBy("origin", F.lower("value").alias("agent")).agg(F.max("group_id").cast("long").alias("group_id"))


def q_issue_order(spark, d):
    a = audited(spark, d, brief=True)
    return a.select("page_id", F.array_join(F.transform("issues", lambda i: i["rule"]), ">").alias("rules"))


def q_scalar_functions(spark, d):
    """The text helpers over whole pages: lines, trimming, splitting, numbers, rounding, labels."""
    html, path = F.col("html"), url.path(F.col("url"))
    n = F.col("page_id")
    shown = F.expr(
        "CASE page_id % 9 WHEN 0 THEN concat('-', page_id) WHEN 1 THEN concat('+', page_id, '.5') WHEN 2 THEN concat(page_id, 'e2') "
        "WHEN 3 THEN concat('1_', page_id) WHEN 4 THEN 'inf' WHEN 5 THEN concat(page_id, 'd') WHEN 6 THEN '' WHEN 7 THEN concat('.', page_id) ELSE concat(page_id, '.') END"
    )
    return pages(spark, d).select(
        "page_id",
        F.size(text.split_lines(F.coalesce(html, F.lit("")))).cast("long").alias("n_lines"),
        text.strip(F.concat(F.lit("\u2003\t "), path, F.lit("\x85\n"))).alias("stripped"),
        F.substring_index("url", "#", 1).alias("before_hash"),
        F.expr(f"array_join({text.split_trimmed_sql(chr(39) + ' a ,b,' + chr(39) + ' || page_id')}, '|')").alias("parts"),
        text.number(shown).alias("number"),
        text.half_even(n / 2).cast("long").alias("half_even"),
        text.clamp(n - 50).cast("long").alias("clamped"),
        text.title_case(F.when(n % 2 == 0, "structured_data").otherwise(F.concat(F.lit("page_"), n))).alias("label"),
        F.expr(text.unescape_sql("concat('&lt;', page_id, '&amp;gt;&#', 65 + page_id % 26, ';&#x', hex(97 + page_id % 26), ';&eacute;&zz;&')")).alias("unescaped"),
    )


def q_ai_txt(spark, d):
    p = tables.pages_scan(raw_pages(spark, d)).select("page_id", "origin")
    ai = tables.ai_txt_scan(files(spark, d)).withColumn("ai_txt", F.lit(True))
    return plan.with_site(p, raw_pages(spark, d), ai).select("page_id", "origin", F.coalesce("ai_txt", F.lit(False)).alias("ai_txt"))


def q_issue_ai_txt(spark, d):
    return issues.ai_txt_issues(q_ai_txt(spark, d)).select("page_id", "severity", "rule", "title")


def q_tdmrep_reference(spark, d):
    return signals.tdmrep_references(pages(spark, d)).select("page_id", *_long("n_references"))


def core_queries():
    q = {
        "crawl_readiness": crawl_readiness,
        "pages_scan": q_pages_scan,
        "robots_scan": lambda s, d: tables.robots_scan(files(s, d)),
        "tdmrep_scan": lambda s, d: tables.tdmrep_scan(files(s, d)),
        "url_origin": q_url_origin,
        "robots_lines": lambda s, d: lines(s, d).select("origin", *_long("pos"), "directive", "value"),
        "robots_state": lambda s, d: robots.robots_state(lines(s, d)).select("origin", *_long("pos"), "kind", *_long("group_id")),
        "robots_groups": q_robots_groups,
        "robots_rules": lambda s, d: robots.robots_rules(lines(s, d)).select("origin", *_long("group_id", "pos"), "path", "allow"),
        "robots_crawl_delay": lambda s, d: robots.robots_crawl_delay(lines(s, d)).select("origin", *_long("group_id"), "crawl_delay"),
        "robots_tdm_fields": lambda s, d: robots.robots_tdm_fields(lines(s, d)).select("origin", *_long("pos"), "directive", "value"),
        "bot_group_match": q_bot_group_match,
        "longest_path_rule": q_longest_path_rule,
        "bot_directive": q_bot_directive,
        "bot_access_matrix": lambda s, d: access.bot_access(facts(s, d)).select("origin", "bot", "operator", *_long("weight"), "allowed"),
        "bot_access_path": q_bot_access_path,
        "wildcard_access": lambda s, d: access.wildcard_access(policies(s, d)).drop("bot"),
        "page_site_join": q_page_site_join,
        "html_tags": q_html_tags,
        "meta_first": q_meta_first,
        "meta_robots": q_meta_robots,
        "tdm_meta_signal": q_tdm_meta,
        "tdm_link_signal": q_tdm_link,
        "tdm_header_signal": q_tdm_header,
        "header_lookup": q_header_lookup,
        "x_robots_tag": q_x_robots,
        "select_dimensions": q_select_dimensions,
        "blank_html_guard": q_blank_html,
        "valid_signals": q_valid,
        "invalid_signals": lambda s, d: q_valid(s, d, False),
        "high_issues": lambda s, d: plan.high_issues(audited(s, d)).select("page_id", *_long("ord"), "rule", "title"),
        "tdm_signals_union": q_signals_union,
        "issues_union": q_issues,
        "policy_set": q_policy_set,
        **{f"issue_{rule}": issue_query(rule) for rule, c in issues.CATEGORY.items() if c in ("crawlability", "tdm")},
        "allowed_weight": lambda s, d: facts(s, d).select("origin", *_long("allowed_weight")),
        "crawl_penalty": lambda s, d: signals.crawl_facts(head(s, d)).select("page_id", signals.crawl_penalty().cast("long").alias("penalty")),
        "crawl_score": q_scores("crawlability"),
        "tdm_score": q_scores("tdm"),
        "overall_score": lambda s, d: audited(s, d, brief=True).select("page_id", "overall_score"),
        "issue_count": q_issue_count,
        "score_percentage": lambda s, d: plan.scores_table(audited(s, d, brief=True)).select("page_id", "category", "percentage"),
        "score_summary": q_score_summary,
        "group_concat": q_group_concat,
        "first_by_position": q_first_by_position,
        "last_group_wins": q_last_group_wins,
        "issue_order": q_issue_order,
        "tdm_status": lambda s, d: with_signals(s, d).select("page_id", signals.tdm_status().alias("status")),
        "scalar_functions": q_scalar_functions,
        "ai_txt": q_ai_txt,
        "issue_ai_txt": q_issue_ai_txt,
        "over_restrictive": lambda s, d: access.over_restrictive(facts(s, d)).select("origin", *_long("allowed_weight", "n_blocked")),
        "vendor_conflict": lambda s, d: access.vendor_conflict(facts(s, d)),
        "tdmrep_reference": q_tdmrep_reference,
    }
    return q
