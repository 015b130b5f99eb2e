"""Snapshots of a crawl's issue codes, laid out so that any two of them are compared without a shuffle.

A snapshot is a Parquet table bucketed and sorted by address, with one row per address. It is shuffled
once, when it is written; each later comparison reads bucket against bucket. Two snapshots with different numbers
of buckets still compare rightly, at the price of a shuffle of one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.functions.sqltext import lit
from sitegauge.operators.corpus import OUTCOME_SQL

SNAPSHOT_TYPE = "address STRING, codes ARRAY<STRUCT<rule: STRING, key: STRING>>"


def store_snapshot(codes: DataFrame, name: str, path: str, buckets: int = 1024) -> DataFrame:
    """Write (url, codes) as the bucketed table ``name`` below ``path`` and return it.

    Codes of pages that share a url are pooled, first within each task, as in ``audit_diff``: no row outgrows
    the codes there are. Addresses are stored with a letter before them, so that pages without one (the empty address)
    join like all others and are not taken for pages whose url is empty. An empty snapshot is a table without rows. The folder must be
    new and one that driver and executors share; ``buckets`` should make files of some 100 MB.
    """
    address = F.coalesce(F.concat(F.lit("u"), F.col("url")), F.lit("")).alias("address")
    pooled = codes.select(address, F.explode_outer("codes").alias("code")).groupBy("address").agg(F.collect_set("code").alias("codes"))
    placed = pooled.repartition(buckets, "address")
    placed.write.bucketBy(buckets, "address").sortBy("address").option("path", path).mode("errorifexists").format("parquet").saveAsTable(name)
    return codes.sparkSession.table(name)


def open_snapshot(spark: SparkSession, name: str, path: str, buckets: int = 1024) -> DataFrame:
    """A snapshot written by an earlier session; ``buckets`` must be the number it was written with.

    Needed only where the catalog does not outlive the session.
    """
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({SNAPSHOT_TYPE}) USING parquet "
        f"CLUSTERED BY (address) SORTED BY (address) INTO {int(buckets)} BUCKETS LOCATION {lit(path)}"
    )
    return spark.table(name)


def diff_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """(url, rule, key, status) as ``audit_diff`` gives them, from two stored snapshots; bucket meets bucket."""
    sides = [snapshot.select("address", F.col("codes").alias(side)) for side, snapshot in (("o", old), ("n", new))]
    both = sides[0].join(sides[1], "address", "full")
    filled = both.select(
        F.expr("CASE WHEN address <> '' THEN substring(address, 2) END").alias("url"),
        *[F.coalesce(side, F.expr("CAST(array() AS ARRAY<STRUCT<rule: STRING, key: STRING>>)")).alias(side) for side in ("o", "n")],
    )
    return filled.select("url", F.inline(F.expr(OUTCOME_SQL)))
