"""The audit over a stream of pages while site files change, with roll-ups that follow it.

Each micro-batch is joined to the site facts as they are when it runs, so a newer robots file counts
for the pages that come after it. Site facts are worked out again only if the site files have
changed. Every batch leaves three tables under its number: its audited pages, its code patterns by site with page counts,
and its part of the issue roll-up. Counts of different batches add up, since a page is in one batch
only; so roll-ups over all that has come so far read these few rows and no page.

A batch that runs again after a failure writes over its own tables: results count once.
Pages of one site may be most of a batch: the join finds hot sites in the batch, as in the plain audit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.operators import corpus
from sitegauge.plans.audit import DEFAULT, evaluate, page_facts, select_dimensions, site_table
from sitegauge.plans.skew import join_one_per_key


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class LiveAudit:
    """An audit that keeps its results below ``folder``, which driver and executors share.

    ``site_files`` gives the current table of site files (``sources.tables.SITE_FILES_SCHEMA``) whenever it is called.
    """

    def __init__(self, folder: str, site_files: Callable[[], DataFrame], dimensions: str | Sequence[str] | None = DEFAULT):
        self.folder, self.site_files = folder.rstrip("/"), site_files
        self.chosen = select_dimensions(dimensions)
        self._seen: tuple | None = None
        self._sites: DataFrame | None = None

    def sites(self, number: int) -> DataFrame:
        """Site facts for batch ``number``; stored anew if a site file came, went or changed."""
        files = self.site_files()
        content = F.xxhash64(*files.columns).cast("decimal(20,0)")
        seen = tuple(files.agg(F.count("*"), F.sum(content)).first())
        if seen != self._seen:
            self._sites, self._seen = _written(site_table(files), f"{self.folder}/sites/from={number}"), seen
        return self._sites

    def audit_batch(self, pages: DataFrame, number: int) -> None:
        """Audits one micro-batch. Html is read once; what follows reads its narrow facts."""
        sites = self.sites(number)
        facts = _written(page_facts(pages, self.chosen), f"{self.folder}/facts/batch={number}")
        audited = evaluate(join_one_per_key(facts, sites, "origin", "page_id"), self.chosen)
        _written(audited, f"{self.folder}/pages/batch={number}")
        narrow = audited.select("origin", "overall_score", F.expr("transform(issues, i -> struct(i.rule AS rule, i.key AS key, i.category AS category, i.severity AS severity))").alias("issues"))
        counted = narrow.groupBy("origin", "overall_score", "issues").agg(F.count("*").alias("n_pages"))
        patterns = _written(counted, f"{self.folder}/patterns/batch={number}")
        _written(corpus.issue_rollup(patterns), f"{self.folder}/rollup/batch={number}")

    def run_available(self, pages: DataFrame) -> None:
        """Audits everything that has arrived in the stream ``pages`` since the last run, then stops."""
        query = (
            pages.writeStream.foreachBatch(self.audit_batch)
            .option("checkpointLocation", f"{self.folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def _batches(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}")


def live_pages(spark: SparkSession, folder: str) -> DataFrame:
    """All audited pages so far, with the number of their ``batch``."""
    return _batches(spark, folder, "pages")


def live_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """``corpus.issue_rollup`` of all pages so far, from the parts of the batches."""
    parts = _batches(spark, folder, "rollup")
    return parts.groupBy("category", "severity", "rule").agg(F.sum("n_issues").alias("n_issues"), F.sum("n_pages").alias("n_pages"))


def live_site_means(spark: SparkSession, folder: str) -> DataFrame:
    """``corpus.site_means`` of all pages so far: input of the rankings."""
    return corpus.site_means(_batches(spark, folder, "patterns"))
