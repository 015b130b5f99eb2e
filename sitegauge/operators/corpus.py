"""Roll-ups, rankings and comparisons over a whole crawl.

Pages are first reduced to their codes and counted per site and code pattern, with map-side
combining. A site with a third of all pages shrinks to a few hundred counted rows before
anything is shuffled, so no roll-up below ever moves or joins single pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.functions.rows import inline_rows
from sitegauge.functions.sqltext import struct
from sitegauge.operators.signals import VALID, all_signals, tdm_status
from sitegauge.plans.audit import evaluate, page_facts, select_dimensions, site_table
from sitegauge.plans.skew import join_one_per_key
from sitegauge.plans.stored import shared_folder, store
from sitegauge.sources.bots import bot_array_sql
from sitegauge.sources.tables import pages_scan

DIMENSIONS = ("crawlability", "tdm")


def page_patterns(pages: DataFrame) -> DataFrame:
    """(origin, meta_robots, x_robots, page_signals, n_pages): pages counted by what decides their audit.

    Free text (header values, tag contents) is blanked, so that only codes are left to group by.
    """
    facts = page_facts(pages, select_dimensions(DIMENSIONS))
    tag = struct(ord="m.ord", meta_name="m.meta_name", content="''", noindex="m.noindex", nofollow="m.nofollow", ai_word="m.ai_word")
    header = struct(value="''", noindex="x_robots.noindex", ai_word="x_robots.ai_word")
    signal = struct(source="s.source", policy="s.policy", raw_value="''", details="''")
    codes = facts.select(
        "origin",
        F.expr(f"transform(meta_robots, m -> {tag})").alias("meta_robots"),
        F.expr(f"CASE WHEN x_robots IS NOT NULL THEN {header} END").alias("x_robots"),
        F.expr(f"transform(page_signals, s -> {signal})").alias("page_signals"),
    )
    return codes.groupBy("origin", "meta_robots", "x_robots", "page_signals").agg(F.count("*").alias("n_pages"))


def audited_patterns(pages: DataFrame, site_files: DataFrame) -> DataFrame:
    """Patterns with their issues and scores: the audit, done once per pattern instead of per page."""
    joined = page_patterns(pages).join(site_table(site_files), "origin", "left").withColumn("site_address", F.col("origin"))
    return evaluate(joined, select_dimensions(DIMENSIONS), brief=True, keep=("origin", "n_pages"))


def issue_rollup(patterns: DataFrame) -> DataFrame:
    """Issues and affected pages by category, severity and rule, with subtotals (null = all).

    A pattern lists each of its roll-up keys once, so affected pages are a plain sum: no
    distinct count over pages.
    """
    levels = []
    for depth in range(4):
        names = ("category", "severity", "rule")[:depth]
        key = struct(
            **{n: (f"i.{n}" if n in names else "CAST(NULL AS STRING)") for n in ("category", "severity", "rule")},
        )
        levels.append(f"array_distinct(transform(issues, i -> {key}))")
    same = " AND ".join(f"(k.{n} IS NULL OR k.{n} = i.{n})" for n in ("category", "severity", "rule"))
    counted = struct(
        category="k.category", severity="k.severity", rule="k.rule", n=f"size(filter(issues, i -> {same}))"
    )
    keys = patterns.select("n_pages", F.expr(f"transform(concat({', '.join(levels)}), k -> {counted})").alias("keys"))
    rows = inline_rows(keys, ["n_pages"], "keys", "n")
    return rows.groupBy("category", "severity", "rule").agg(
        F.sum(F.col("n") * F.col("n_pages")).alias("n_issues"), F.sum("n_pages").alias("n_pages")
    )


def page_counts(pages: DataFrame) -> DataFrame:
    return pages_scan(pages).groupBy("origin").agg(F.count("*").alias("n_pages"))


def bot_block_rate(pages: DataFrame, site_files: DataFrame) -> DataFrame:
    """Share of sites and of pages that keep each bot out."""
    sites = page_counts(pages).join(site_table(site_files).select("origin", "blocked"), "origin", "left")
    bot = struct(ord="b.ord", bot="b.bot", blocked="coalesce(exists(blocked, x -> x.bot = b.bot), false)")
    rows = sites.select("n_pages", F.inline_outer(F.expr(f"transform({bot_array_sql()}, b -> {bot})")))
    out = rows.groupBy("bot").agg(
        F.count("*").alias("n_sites"),
        F.count_if("blocked").alias("n_sites_blocking"),
        F.sum("n_pages").alias("n_pages"),
        F.sum(F.when(F.col("blocked"), F.col("n_pages")).otherwise(0)).alias("n_pages_blocking"),
    )
    return out.withColumns(
        {
            "site_rate": F.col("n_sites_blocking") / F.col("n_sites"),
            "page_rate": F.col("n_pages_blocking") / F.col("n_pages"),
        }
    )


def policy_mix(pages: DataFrame, site_files: DataFrame) -> DataFrame:
    """Pages by mining-policy outcome and the channels that state it."""
    joined = page_patterns(pages).join(site_table(site_files).select("origin", "tdmrep"), "origin", "left")
    joined = joined.withColumn("site_address", F.col("origin"))
    signals = joined.select("n_pages", all_signals().alias("signals"))
    return (
        signals.select(
            "n_pages", tdm_status().alias("status"),
            F.expr(f"array_join(transform({VALID}, s -> s.source), '+')").alias("channels"),
        )
        .groupBy("status", "channels")
        .agg(F.sum("n_pages").alias("n_pages"))
    )


def site_means(patterns: DataFrame) -> DataFrame:
    """(origin, n_pages, mean_score): mean overall score of each site, not rounded."""
    sums = patterns.groupBy("origin").agg(
        F.sum("n_pages").alias("n_pages"), F.sum(F.col("overall_score") * F.col("n_pages")).alias("total")
    )
    return sums.select("origin", "n_pages", (F.col("total") / F.col("n_pages")).alias("mean_score"))


def _level() -> Column:
    """Hundredths of the mean: 10,001 ascending levels, each small enough for a window of its own."""
    return F.floor(F.col("mean_score") * 100).cast("int")


def _once(means: DataFrame) -> DataFrame:
    """The narrow table of means, stored: what follows reads it several times, and the crawl must be audited only once."""
    return store(means, f"{shared_folder(means.sparkSession)}/means")


def site_ranking(means: DataFrame) -> DataFrame:
    """Sites ranked by mean score (dense, best first).

    The distinct means are ranked within levels of a hundredth, and the levels (10,001 at most)
    are added up before them, so no window holds all sites and no mean is rounded. The ranks go
    back to the sites by a join that splits means which many sites share.
    """
    means = _once(means)
    values = means.select("mean_score").distinct().withColumn("level", _level())
    above = Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    starts = values.groupBy("level").agg(F.count("*").alias("n")).select(
        "level", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("start")
    )
    inside = F.dense_rank().over(Window.partitionBy("level").orderBy(F.desc("mean_score")))
    ranks = values.withColumn("rank", inside).join(starts, "level").select(
        "mean_score", (F.col("start") + F.col("rank")).cast("int").alias("site_rank")
    )
    return join_one_per_key(means, ranks, "mean_score", "origin").select("origin", "n_pages", "mean_score", "site_rank")


def worst_sites(means: DataFrame, k: int) -> DataFrame:
    """The k sites with the lowest mean; ties by name."""
    return means.orderBy("mean_score", "origin").limit(k)


def best_sites(means: DataFrame, k: int) -> DataFrame:
    """The k sites with the highest mean; ties by name."""
    return means.orderBy(F.desc("mean_score"), "origin").limit(k)


def peer_compare(means: DataFrame) -> DataFrame:
    """Each site against its peers (same top-level domain): gap to the peer mean, percent rank.

    Sites are counted by peer group and mean; below each count stand the counts of lower means in
    the same level and those of lower levels. No window holds more than one level of one group.
    The gap is rounded to millionths for display.
    """
    means = _once(means)
    host = F.lower(F.regexp_extract("origin", r"://(?:[^@/]*@)?([^:/]*)", 1))
    sites = means.withColumn("peer", F.regexp_extract(host, r"([^.]+)$", 1))
    bars = sites.groupBy("peer", "mean_score").agg(F.count("*").alias("n")).withColumn("level", _level())
    levels = bars.groupBy("peer", "level").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("mean_score")).alias("s"))
    group = Window.partitionBy("peer")
    below = group.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.select(
        "peer", "level", F.coalesce(F.sum("m").over(below), F.lit(0)).alias("start"),
        F.sum("m").over(group).alias("n_peers"), (F.sum("s").over(group) / F.sum("m").over(group)).alias("peer_mean"),
    )
    inside = Window.partitionBy("peer", "level").orderBy("mean_score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = bars.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(levels, ["peer", "level"])
    key = F.concat_ws("|", "peer", F.col("mean_score").cast("string"))
    stats = ranked.select(key.alias("bar"), (F.col("start") + F.col("inside")).alias("below"), "n_peers", "peer_mean")
    out = join_one_per_key(sites.withColumn("bar", key), stats, "bar", "origin")
    return out.select(
        "origin", "peer", "n_peers", "mean_score", F.round(F.col("mean_score") - F.col("peer_mean"), 6).alias("gap"),
        F.when(F.col("n_peers") > 1, F.col("below") / (F.col("n_peers") - 1)).otherwise(F.lit(0.0)).alias("percent_rank"),
    )


def issue_codes(audited: DataFrame) -> DataFrame:
    """(url, codes): the distinct (rule, key) codes of each audited page, for ``audit_diff``."""
    return audited.select("url", F.expr("array_distinct(transform(issues, i -> struct(i.rule AS rule, i.key AS key)))").alias("codes"))


OUTCOME_SQL = "concat(" + ", ".join(
    f"transform({codes}, x -> struct(x.rule AS rule, x.key AS key, '{status}' AS status))"
    for codes, status in (("array_except(n, o)", "new"), ("array_except(o, n)", "fixed"), ("array_intersect(o, n)", "kept"))
) + ")"


def audit_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Issues of two snapshots, each (url, codes): new, fixed or kept.

    Codes go one by one into a set per url and snapshot, first within each task: the shuffle carries
    one row per url and task, and no set outgrows the codes there are, as many as the audit has
    rules and bots, even if all pages share a url or have none. The sets are compared in place and
    only the outcome is exploded.
    """
    sides = [snapshot.select("url", F.lit(side).alias("side"), F.explode_outer("codes").alias("code")) for side, snapshot in (("o", old), ("n", new))]
    pooled = [F.collect_set(F.when(F.col("side") == side, F.col("code"))).alias(side) for side in ("o", "n")]
    both = sides[0].unionByName(sides[1]).groupBy("url").agg(*pooled)
    return both.select("url", F.inline(F.expr(OUTCOME_SQL)))
