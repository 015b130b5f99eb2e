"""Input tables: crawled pages and site files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegauge.functions.text import WHITESPACE
from sitegauge.functions.url import origin

PAGES_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    ]
)
SITE_FILES_SCHEMA = T.StructType(
    [
        T.StructField("origin", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)
# Where the site files live under an origin.
ROBOTS_PATH, TDMREP_PATH, AI_TXT_PATH = "/robots.txt", "/tdmrep.json", "/ai.txt"


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """Read a crawl table in any Spark format; a given schema saves the inference pass."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def pages_scan(pages: DataFrame) -> DataFrame:
    """Pages with their origin. A failed fetch is a row with empty html and no headers."""
    if "headers" not in pages.columns:
        pages = pages.withColumn("headers", F.lit(None).cast("map<string,string>"))
    return pages.select(
        "page_id",
        "url",
        origin(F.col("url")).alias("origin"),
        F.coalesce("html", F.lit("")).alias("html"),
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"),
    )


def _keyed(site_files: DataFrame) -> DataFrame:
    """Site files under the normalised origin; the time of the fetch is null where the table has none."""
    fetched = F.col("fetched_at").cast("timestamp") if "fetched_at" in site_files.columns else F.lit(None).cast("timestamp")
    return site_files.select(
        origin(F.col("origin")).alias("origin"), "path", "status", "content_type", "body", fetched.alias("fetched_at")
    )


def _is_tdmrep() -> Column:
    jsonish = F.contains(F.coalesce("content_type", F.lit("")), F.lit("json")) | F.startswith(
        F.ltrim("body", F.lit(WHITESPACE)), F.lit("{")
    )
    return (F.col("path") == TDMREP_PATH) & jsonish


def _latest(value: Column, when: Column) -> Column:
    """``value`` of the latest fetch with ``when``; ties, and tables without times, go to the smallest value."""
    age = -F.coalesce(F.unix_micros("fetched_at"), F.lit(0))
    return F.min(F.when(when, F.struct(age.alias("age"), value.alias("value"))))["value"]


def robots_scan(site_files: DataFrame) -> DataFrame:
    """One robots.txt per origin; only status 200 counts."""
    return (
        _keyed(site_files).filter((F.col("path") == ROBOTS_PATH) & (F.col("status") == 200))
        .groupBy("origin")
        .agg(_latest(F.coalesce("body", F.lit("")), F.lit(True)).alias("body"))
    )


def tdmrep_scan(site_files: DataFrame) -> DataFrame:
    """Origins that serve a tdmrep.json, with its address."""
    return (
        _keyed(site_files).filter((F.col("status") == 200) & _is_tdmrep())
        .select("origin", F.concat("origin", F.lit(TDMREP_PATH)).alias("raw_value"))
        .distinct()
    )


def ai_txt_scan(site_files: DataFrame) -> DataFrame:
    """Origins that serve an ai.txt."""
    return _keyed(site_files).filter((F.col("path") == AI_TXT_PATH) & (F.col("status") == 200)).select("origin").distinct()


def site_scan(site_files: DataFrame) -> DataFrame:
    """All site files of an origin in one row: one shuffle instead of one per kind of file.

    Every origin keeps its row, whatever the status of its files. Of several fetches of one
    robots.txt the latest counts (column ``fetched_at``, if there is one), then the smallest body.
    """
    ok = F.col("status") == 200
    narrow = _keyed(site_files)
    return narrow.groupBy("origin").agg(
        _latest(F.coalesce("body", F.lit("")), ok & (F.col("path") == ROBOTS_PATH)).alias("body"),
        F.max(ok & _is_tdmrep()).alias("tdmrep"),
        F.max(ok & (F.col("path") == AI_TXT_PATH)).alias("ai_txt"),
    )
