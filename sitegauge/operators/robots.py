"""robots.txt as rows: lines, groups, rules, crawl delays.

The grouping of lines is a running state over a file. It is written as two window functions
partitioned by origin, so a file may have any number of lines and the work spills like any
window. ``site_scan`` has already brought each origin to one place: line split, windows and
both aggregations reuse that partitioning, and the plan has a single exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.functions.text import number, split_lines, strip

GROUP_TYPE = (
    "array<struct<group_id:int,agents:array<string>,"
    "rules:array<struct<pos:int,path:string,allow:boolean>>,crawl_delay:double>>"
)


def robots_lines(robots: DataFrame) -> DataFrame:
    """(origin, body, ...) -> one row per directive line: pos, directive, value."""
    keep = [c for c in robots.columns if c != "body"]
    raw = robots.select(*keep, F.posexplode(split_lines(F.col("body"))).alias("pos", "raw"))
    line = strip(F.substring_index("raw", "#", 1))
    lines = raw.select(*keep, "pos", line.alias("line")).filter(F.contains("line", F.lit(":")))
    return lines.select(*keep, "pos", *_directive())


def _directive():
    head = F.substring_index("line", ":", 1)
    return (
        F.lower(strip(head)).alias("directive"),
        strip(F.expr("substring(line, length(substring_index(line, ':', 1)) + 2)")).alias("value"),
    )


def _kind():
    d, v = F.col("directive"), F.col("value")
    return (
        F.when(d == "user-agent", "agent")
        .when((d == "allow") | ((d == "disallow") & (v != "")), "rule")
    )


def robots_state(lines: DataFrame) -> DataFrame:
    """Number the group each line belongs to; 0 before the first user-agent line.

    A user-agent line opens a group unless the current group has no rule yet.
    """
    w = Window.partitionBy("origin").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kinds = lines.withColumn("kind", _kind())
    previous = F.coalesce(F.last("kind", ignorenulls=True).over(before), F.lit("rule"))
    opens = (F.col("kind") == "agent") & (previous == "rule")
    return kinds.withColumn("opens", F.coalesce(opens, F.lit(False)).cast("int")).withColumn(
        "group_id", F.sum("opens").over(upto).cast("int")
    ).drop("opens")


def robots_groups(lines: DataFrame) -> DataFrame:
    """One row per group: agents in file order, rule count, crawl delay."""
    state = robots_state(lines).filter("group_id > 0")
    agent = F.when(F.col("kind") == "agent", F.struct("pos", F.col("value").alias("text")))
    return state.groupBy("origin", "group_id").agg(
        F.transform(F.array_sort(F.collect_list(agent)), lambda a: a["text"]).alias("user_agents"),
        F.count_if(F.col("kind") == "rule").alias("n_rules"),
        _last_delay().alias("crawl_delay"),
    )


def robots_rules(lines: DataFrame) -> DataFrame:
    """One row per rule; rules before the first group are dropped."""
    state = robots_state(lines).filter("group_id > 0 AND kind = 'rule'")
    return state.select(
        "origin", "group_id", "pos", F.col("value").alias("path"), (F.col("directive") == "allow").alias("allow")
    )


def _last_delay():
    value = F.when(F.col("directive") == "crawl-delay", number(F.col("value")))
    return F.max_by(value, F.when(value.isNotNull(), F.col("pos")))


def robots_crawl_delay(lines: DataFrame) -> DataFrame:
    """Groups that declare a crawl delay; the last readable number counts."""
    state = robots_state(lines).filter("group_id > 0")
    return (
        state.groupBy("origin", "group_id").agg(_last_delay().alias("crawl_delay")).filter("crawl_delay IS NOT NULL")
    )


def robots_tdm_fields(lines: DataFrame) -> DataFrame:
    """Mining-related fields some sites put into robots.txt."""
    return lines.filter(F.startswith("directive", F.lit("tdm-"))).select("origin", "pos", "directive", "value")


def site_policies(sites: DataFrame) -> DataFrame:
    """``site_scan`` rows -> one row per origin with the parsed groups nested.

    An origin without a robots file keeps a row with ``robots_found`` false and no groups.
    The nested arrays are as long as the file itself, which was one value on input.
    """
    found = F.col("body").isNotNull().alias("robots_found")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("tdmrep", "ai_txt")]
    raw = sites.select(
        "origin", found, *flags, F.posexplode(split_lines(F.coalesce("body", F.lit("")))).alias("pos", "raw")
    )
    lines = raw.select(
        "origin", "robots_found", "tdmrep", "ai_txt", "pos", strip(F.substring_index("raw", "#", 1)).alias("line")
    )
    # The first line stays whatever it holds, so that every origin keeps a row.
    lines = lines.filter(F.contains("line", F.lit(":")) | (F.col("pos") == 0))
    lines = lines.select("origin", "robots_found", "tdmrep", "ai_txt", "pos", *_directive())
    state = robots_state(lines)
    rule = F.when(
        F.col("kind") == "rule",
        F.struct("pos", F.col("value").alias("path"), (F.col("directive") == "allow").alias("allow")),
    )
    agent = F.when(F.col("kind") == "agent", F.lower(F.col("value")))
    groups = state.groupBy("origin", "group_id").agg(
        F.collect_list(agent).alias("agents"),
        F.collect_list(rule).alias("rules"),
        _last_delay().alias("crawl_delay"),
        *[F.max(c).alias(c) for c in ("robots_found", "tdmrep", "ai_txt")],
    )
    group = F.when(F.col("group_id") > 0, F.struct("group_id", "agents", "rules", "crawl_delay"))
    return groups.groupBy("origin").agg(
        *[F.max(c).alias(c) for c in ("robots_found", "tdmrep", "ai_txt")],
        F.collect_list(group).alias("groups"),
    )
