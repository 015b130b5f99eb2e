"""The audit: pages and site files in, one audited row per page out.

html is read once, turned into narrow columns in the first projection and dropped before the
only page-level shuffle, the join to the site facts. Scores, issues and reports of a page are
expressions over that one row: no further shuffle, join or aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.rows import inline_rows
from sitegauge.functions.url import written_origin
from sitegauge.operators import access, attribution, content, issues, robots, scores, signals, structured
from sitegauge.plans.skew import ROWS_PER_TASK, join_one_per_key
from sitegauge.sources.tables import pages_scan, site_scan


class Dimension(NamedTuple):
    """One part of the audit.

    ``facts`` adds columns to the page row (html, headers and head tags are there; the site is
    not yet). ``issues(brief)`` and ``score(n)`` are columns over the joined row.
    """

    name: str
    category: str
    facts: Callable[[DataFrame], DataFrame]
    issues: Callable[[bool], Column]
    score: Callable[[], Column]
    fact_columns: Sequence[str]


_DIMENSIONS: dict[str, Dimension] = {}


def register_dimension(dimension: Dimension) -> None:
    """Add a dimension; audits run dimensions in the order they were registered.

    ``facts`` may use any row-local step, ``mapInPandas`` included, if built-ins cannot say it.
    """
    _DIMENSIONS[dimension.name] = dimension


def _tdm_score() -> Column:
    return scores.tdm_score_from(
        F.expr(f"size({signals.VALID})"), F.expr(f"size({signals.INVALID})"), F.expr(signals.CONFLICT)
    )


register_dimension(
    Dimension(
        "crawlability", "crawlability", signals.crawl_facts, issues.crawl_issues,
        lambda: scores.crawl_score(F.col("allowed_weight"), signals.crawl_penalty()),
        ("meta_robots", "x_robots"),
    )
)
register_dimension(
    Dimension("tdm", "tdm", signals.tdm_facts, issues.tdm_issues, _tdm_score, ("page_signals",))
)

register_dimension(
    Dimension(
        "structured-data", "structured_data", structured.structured_facts, structured.structured_issues,
        structured.structured_score, ("sd",),
    )
)
register_dimension(
    Dimension(
        "extractability", "extractability", content.content_facts, content.content_issues, content.content_score, ("ex",)
    )
)
register_dimension(
    Dimension(
        "attribution", "attribution", attribution.attribution_facts, attribution.attribution_issues,
        attribution.attribution_score, ("at",),
    )
)


def select_dimensions(only: str | Sequence[str] | None = None) -> list[Dimension]:
    """Names (or a comma-separated text, not trimmed) to dimensions, in fixed order; none means all."""
    names = only.split(",") if isinstance(only, str) and only else list(only or _DIMENSIONS)
    unknown = [n for n in names if n not in _DIMENSIONS]
    if unknown:
        raise ValueError(f"unknown dimension {unknown[0]!r}; available: {', '.join(_DIMENSIONS)}")
    return [d for n, d in _DIMENSIONS.items() if n in names]


# The two dimensions with fixed results; the others follow definitions of our own.
DEFAULT = ("crawlability", "tdm")


def site_table(site_files: DataFrame) -> DataFrame:
    """Narrow site facts, one row per origin."""
    facts = access.site_facts(robots.site_policies(site_scan(site_files)))
    return facts.select(
        "origin", "robots_found", "tdmrep", "ai_txt", "allowed_weight", "specifically_allowed",
        F.expr("filter(bots, b -> NOT b.allowed)").alias("blocked"),
    )


def page_facts(pages: DataFrame, dimensions: Sequence[Dimension]) -> DataFrame:
    """Narrow page row: everything the dimensions read from html and headers."""
    df = signals.with_head(pages_scan(pages))
    for d in dimensions:
        df = d.facts(df)
    address = written_origin(F.col("url")).alias("site_address")
    return df.select("page_id", "url", "origin", address, *[c for d in dimensions for c in d.fact_columns])


def with_site(facts: DataFrame, pages: DataFrame, sites: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Attach the site facts; hot sites are found from the page addresses alone."""
    keys = pages_scan(pages).select("origin")
    return join_one_per_key(facts, sites, "origin", "page_id", keys, rows_per_task)


def path_access(
    paths: DataFrame, policies: DataFrame, bots: str | None = None, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Access of each page (page_id, origin, path) for the registry's bots, or for ``bots`` (SQL array of names).

    Each site's groups are cut down to those that some bot is held to, before they meet any path.
    Rules are resolved once per distinct path of a site; pages get back the narrow answer only.
    """
    key = F.concat_ws(" ", "origin", "path").alias("_key")
    pairs = paths.select("origin", "path").distinct()
    ruled = join_one_per_key(pairs, access.needed_groups(policies, bots), "origin", "path", rows_per_task=rows_per_task)
    answers = access.access_for(ruled, bots, "path", nested=True).select(key, "access")
    joined = join_one_per_key(paths.select("page_id", "origin", "path", key), answers, "_key", "page_id", rows_per_task=rows_per_task)
    return joined.select("page_id", "origin", "path", F.inline_outer("access"))


def evaluate(
    joined: DataFrame,
    dimensions: Sequence[Dimension],
    brief: bool = False,
    keep: Sequence[str] = ("page_id", "url", "origin"),
) -> DataFrame:
    """Issues and scores over joined rows. Runs on batches and streams."""
    if any(d.name == "tdm" for d in dimensions):
        joined = joined.withColumn("signals", signals.all_signals())
    df = joined.withColumns({f"_i_{d.category}": d.issues(brief) for d in dimensions})
    parts = [scores.score(d.category, d.score(), F.size(f"_i_{d.category}")) for d in dimensions]
    df = df.select(
        *keep, F.array(*parts).alias("scores"), F.concat(*[F.col(f"_i_{d.category}") for d in dimensions]).alias("issues")
    )
    return df.select(
        *keep, scores.overall_score().alias("overall_score"), F.size("issues").alias("issue_count"), "scores", "issues"
    )


def audit(
    pages: DataFrame,
    site_files: DataFrame,
    dimensions: str | Sequence[str] | None = DEFAULT,
    *,
    brief: bool = False,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """(page_id, url, origin, overall_score, issue_count, scores, issues), one row per page."""
    chosen = select_dimensions(dimensions)
    joined = with_site(page_facts(pages, chosen), pages, site_table(site_files), rows_per_task)
    return evaluate(joined, chosen, brief)


def scores_table(audited: DataFrame) -> DataFrame:
    return inline_rows(audited, ["page_id"], "scores", "category").withColumn(
        "percentage", scores.percentage(F.col("value"), F.col("max_value"))
    )


def issues_table(audited: DataFrame) -> DataFrame:
    return inline_rows(audited, ["page_id"], "issues", "rule")


def high_issues(audited: DataFrame) -> DataFrame:
    return issues_table(audited.withColumn("issues", F.expr("filter(issues, i -> i.severity = 'high')")))
