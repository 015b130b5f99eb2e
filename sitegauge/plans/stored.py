"""Tables written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="sitegauge-")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's checkpoint folder, which all executors share.

    Only a session on a single machine (``local[n]``) makes do with a temporary folder where that is unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local["):
        base = _own_folder()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def store(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it back: cuts the lineage and survives lost executors."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
