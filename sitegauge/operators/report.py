"""Reports over audited pages: one JSON document per page, and tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.functions.sqltext import lit, struct
from sitegauge.plans.audit import issues_table, scores_table

# Values that are lists inside the string-valued details; they become lists again in JSON.
LIST_DETAILS = ("specifically_allowed", "reserved_by", "allowed_by", "sources", "signals")


def _issues() -> str:
    keys = ", ".join(f"'{k}'" for k in LIST_DETAILS)
    details = f"transform_values(i.details, (k, v) -> if(k IN ({keys}), parse_json(v), CAST(v AS VARIANT)))"
    fields = {f: f"i.{f}" for f in ("severity", "category", "title", "description", "recommendation")}
    return f"transform(issues, i -> {struct(**fields, details=details)})"


def report_json(audited: DataFrame) -> DataFrame:
    """(page_id, report): url, overall score, scores, issues."""
    scores = f"transform(scores, s -> {struct(category='s.category', value='s.value', max_value='s.max_value')})"
    doc = struct(url="url", overall_score="overall_score", scores=scores, issues=_issues())
    return audited.select("page_id", F.expr(f"to_json({doc})").alias("report"))


def _utc_text(moment: datetime | None) -> Column:
    if moment is None:
        now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
        return F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return F.lit((moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).isoformat())


def report_json_full(audited: DataFrame, version: str, generated_at: datetime | None = None) -> DataFrame:
    """As above plus version, time of the run in UTC, issue count per score, metadata.

    Pass ``generated_at`` (taken as UTC without a zone) to make reruns equal.
    """
    fields = {f: f"s.{f}" for f in ("category", "value", "max_value", "issue_count")}
    doc = struct(
        version=lit(version), generated_at="_now", url="url", overall_score="overall_score",
        scores=f"transform(scores, s -> {struct(**fields)})", issues=_issues(),
        metadata="CAST(map() AS MAP<STRING, STRING>)",
    )
    return audited.withColumn("_now", _utc_text(generated_at)).select("page_id", F.expr(f"to_json({doc})").alias("report"))


def write_reports(reports: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON documents as text files, one document per line."""
    reports.select("report").write.mode(mode).text(path)


def write_tables(audited: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Pages, scores and issues as parquet under ``path``.

    The audited pages are written once and the other two tables are read off that copy, so the
    html is read and parsed a single time however many tables are asked for.
    """
    spark: SparkSession = audited.sparkSession
    audited.write.mode(mode).parquet(f"{path}/pages")
    stored = spark.read.parquet(f"{path}/pages")
    scores_table(stored).write.mode(mode).partitionBy("category").parquet(f"{path}/scores")
    issues_table(stored).write.mode(mode).partitionBy("category").parquet(f"{path}/issues")
