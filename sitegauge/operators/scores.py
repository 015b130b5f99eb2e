"""Scores from per-page columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegauge.functions.text import clamp, half_even, title_case


def crawl_score(allowed_weight: Column, penalty: Column) -> Column:
    """Share of crawler weight let in, less the penalties. A site without rules lets all in."""
    return clamp(F.coalesce(allowed_weight, F.lit(100)) - penalty)


def tdm_score_from(n_valid: Column, n_invalid: Column, conflict: Column) -> Column:
    # 30 without any signal; 20/70/90/100 by valid signals; -15 each invalid; -30 conflict.
    base = F.when(n_valid == 0, 20).when(n_valid == 1, 70).when(n_valid == 2, 90).otherwise(100)
    penalty = n_invalid * 15 + F.when(conflict, 30).otherwise(0)
    return F.when(n_valid + n_invalid == 0, F.lit(30)).otherwise(clamp(base - penalty))


def score(category: str, value: Column, n_issues: Column) -> Column:
    return F.struct(
        F.lit(category).alias("category"),
        value.cast("int").alias("value"),
        F.lit(100).alias("max_value"),
        n_issues.cast("int").alias("issue_count"),
    )


def overall_score(scores: str = "scores") -> Column:
    """Mean of the selected scores, rounded half to even; 0 if there are none."""
    return F.expr(
        f"if(size({scores}) = 0, 0, CAST(bround(aggregate({scores}, 0, (acc, s) -> acc + s.value) / size({scores}), 0) AS INT))"
    )


def percentage(value: Column, max_value: Column) -> Column:
    return F.when(max_value != 0, value / max_value * 100).otherwise(F.lit(0.0))


def label(category: Column) -> Column:
    return title_case(category)


def bar(value: Column) -> Column:
    """Ten-step text bar."""
    filled = half_even(value / 10)
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(10) - filled))
