"""Left join of a big table to a table with one row per key, safe for hot keys.

One site may hold a third of all pages. The keys with more rows than one task should take are
counted first, from the key column alone and with map-side combining; only those get salted.
The list of hot keys is broadcast: it has at most ``rows / rows_per_task`` entries by
construction. Whether the small side itself is broadcast is left to the engine, which compares
its size with ``spark.sql.autoBroadcastJoinThreshold`` and shuffles beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 2_000_000
NULL_SLICES = 4096


def hot_keys(keys: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keys with more than ``rows_per_task`` rows and the number of slices each needs."""
    counts = keys.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") > rows_per_task).select(
        key, F.ceil(F.col("n") / rows_per_task).cast("int").alias("slices")
    )


def join_one_per_key(
    big: DataFrame,
    small: DataFrame,
    key: str,
    spread_by: str,
    keys: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """``big`` left join ``small`` on ``key``; hot keys are cut into slices by ``spread_by``.

    ``keys`` is a cheap table with the same keys as ``big`` (defaults to ``big`` itself).
    """
    hot = F.broadcast(hot_keys((big if keys is None else keys).select(key), key, rows_per_task))
    salted = big.join(hot, key, "left").withColumn(
        "_slice",
        # rows without a key match nothing; they only must not meet in one task
        F.when(F.col(key).isNull(), F.pmod(F.xxhash64(spread_by), F.lit(NULL_SLICES)).cast("int"))
        .when(F.col("slices").isNull(), F.lit(0))
        .otherwise(F.pmod(F.xxhash64(spread_by), F.col("slices")).cast("int")),
    ).drop("slices")
    copies = small.join(hot, key, "left").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))
    ).drop("slices")
    return salted.join(copies, [key, "_slice"], "left").drop("_slice")


def join_in_slices(big: DataFrame, small: DataFrame, key: str, spread_by: str, slices: int) -> DataFrame:
    """The same join with every key cut into ``slices``: for streams, whose keys cannot be counted first."""
    number = F.pmod(F.xxhash64(spread_by), F.lit(slices)).cast("int")
    copies = small.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return big.withColumn("_slice", number).join(copies, [key, "_slice"], "left").drop("_slice")
