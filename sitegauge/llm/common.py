"""Helpers that several operators share: stored intermediate tables, running totals, components."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a table of a few numbers per row may be broadcast (16 MB).
BROADCAST_ROWS = 1_000_000


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="sitegauge-")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only on a single machine where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _own_folder()
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows allow it; otherwise the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def join_one_per_key(big: DataFrame, small: DataFrame, keys: list[str], rows_per_task: int = 2_000_000) -> DataFrame:
    """``big`` left join ``small``, which has one row per key; safe for keys that hold a large share of ``big``.

    A small side is broadcast by its counted rows. Beyond that, the entries of keys with more than
    ``rows_per_task`` rows (at most rows / ``rows_per_task`` of them) are broadcast and the others shuffled.
    """
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), keys, "left")
    hot = stored(big.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > rows_per_task).select(*keys, F.lit(True).alias("_hot")))
    marked = big.join(F.broadcast(hot), keys, "left")
    often = marked.filter("_hot").drop("_hot").join(F.broadcast(small.join(F.broadcast(hot), keys, "left_semi")), keys, "left")
    return often.unionByName(marked.filter("_hot is null").drop("_hot").join(small, keys, "left"))


def row_key(*names: str) -> list[Column]:
    """Two independent 64-bit hashes of some columns, as ``_h1`` and ``_h2``."""
    columns = [F.col(n) for n in names]
    return [F.xxhash64(*columns).alias("_h1"), F.xxhash64(F.lit("second"), *columns).alias("_h2")]


def running_total(
    df: DataFrame, value: str, order: list[str], into: str, by: list[str] | None = None, slices: int = 4096, first: Column | None = None
) -> DataFrame:
    """Adds ``into``: the sum of ``value`` over earlier rows, within each ``by``, without one task per ``by``.

    The order is: the small integer ``first`` if given, a hash slice of the ``order`` columns, then these columns themselves. Totals of
    the slices are summed first, so a window only ever holds one slice of one group; rows that are
    equal in all ``order`` columns lie in one slice in no fixed order.
    """
    by = by or []
    hashed = F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int")
    sliced = df.withColumn("_slice", hashed if first is None else first * slices + hashed)
    totals = sliced.groupBy(*by, "_slice").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sliced.join(starts, [*by, "_slice"])
        .withColumn(into, (F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long"))
        .drop("_slice", "_before")
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node of its component.

    Alternates large-star and small-star steps until no edge changes. Every step is a pair of
    grouped minima; nothing is gathered per node.
    """
    links = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = links.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
