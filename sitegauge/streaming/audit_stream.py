"""The page audit over a stream of crawled pages.

Pages are independent of each other, so the stream is stateless: append mode, no watermark,
no state store. Site facts are a static table; store it first, or every micro-batch would parse
all robots files again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from sitegauge.plans.audit import DEFAULT, evaluate, page_facts, select_dimensions
from sitegauge.plans.skew import join_in_slices
from sitegauge.plans.stored import shared_folder, store

__all__ = ["audit_stream", "run_available", "shared_folder", "store"]


def audit_stream(
    pages: DataFrame, sites: DataFrame, dimensions: str | Sequence[str] | None = DEFAULT, slices: int = 16
) -> DataFrame:
    """Audited pages from a streaming ``pages`` table and a stored ``site_table``.

    Each site's pages are joined in ``slices`` parts, so that one site does not make one task.
    """
    chosen = select_dimensions(dimensions)
    return evaluate(join_in_slices(page_facts(pages, chosen), sites, "origin", "page_id", slices), chosen)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process everything that has arrived, then stop; returns the stored result."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
