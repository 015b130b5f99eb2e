"""The live audit: changing site files, roll-ups that follow, batches that run again, restarts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sitegauge import audit
from sitegauge.operators import corpus
from sitegauge.plans.stored import shared_folder
from sitegauge.sources.tables import PAGES_SCHEMA, SITE_FILES_SCHEMA
from sitegauge.streaming import live_audit
from sitegauge.streaming.live_audit import LiveAudit, live_pages, live_rollup, live_site_means

OPEN, SHUT = "User-agent: *\nAllow: /\n", "User-agent: GPTBot\nDisallow: /\n"


def pages_of(spark, numbers):
    rows = [(i, f"https://{'hot' if i % 3 else f's{i % 5}'}.example/{i}", '<meta name="robots" content="noai">' if i % 2 else None, {}) for i in numbers]
    return spark.createDataFrame([*rows, *((10_000 + i, None, "<p>", None) for i in numbers[:2])], PAGES_SCHEMA)


def files_of(spark, robots):
    hosts = ["hot", *(f"s{i}" for i in range(4))]
    return spark.createDataFrame([(f"https://{h}.example", "/robots.txt", 200, "text/plain", robots) for h in hosts], SITE_FILES_SCHEMA)


def sortable(df, *columns):
    return sorted((repr(r) for r in df.select(*columns).collect()))


PAGE = ("page_id", "url", "overall_score", "issue_count", "issues")


class Crawl:
    def __init__(self, spark):
        self.spark, self.folder, self.robots = spark, shared_folder(spark), OPEN
        self.audited = []

    def live(self):
        return LiveAudit(f"{self.folder}/live", lambda: files_of(self.spark, self.robots))

    def arrive(self, numbers):
        new = pages_of(self.spark, numbers)
        new.coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        self.audited.append((new, self.robots))

    def stream(self):
        return self.spark.readStream.schema(PAGES_SCHEMA).parquet(f"{self.folder}/in")

    def batch_audits(self):
        out = None
        for new, robots in self.audited:
            one = audit(new, files_of(self.spark, robots))
            out = one if out is None else out.unionByName(one)
        return out


@pytest.fixture
def crawl(spark):
    return Crawl(spark)


def check(crawl):
    want, folder = crawl.batch_audits(), f"{crawl.folder}/live"
    assert sortable(live_pages(crawl.spark, folder), *PAGE) == sortable(want, *PAGE)
    rolled = corpus.issue_rollup(want.withColumn("n_pages", F.lit(1)))
    assert sortable(live_rollup(crawl.spark, folder), "category", "severity", "rule", "n_issues", "n_pages") == sortable(rolled, "category", "severity", "rule", "n_issues", "n_pages")
    means = want.groupBy("origin").agg(F.count("*").alias("n_pages"), F.avg("overall_score").alias("mean_score"))
    assert sortable(live_site_means(crawl.spark, folder), "origin", "n_pages", F.round("mean_score", 9)) == sortable(means, "origin", "n_pages", F.round("mean_score", 9))


def test_site_files_change_between_triggers_and_restart(spark, crawl):
    live = crawl.live()
    crawl.arrive(list(range(30)))
    live.run_available(crawl.stream())
    check(crawl)
    crawl.robots = SHUT
    crawl.arrive(list(range(30, 70)))
    live.run_available(crawl.stream())
    check(crawl)
    blocked = live_pages(spark, f"{crawl.folder}/live").filter("exists(issues, i -> i.rule = 'bot_blocked')")
    assert blocked.filter("page_id < 30").count() == 0 and blocked.filter("page_id BETWEEN 30 AND 69").count() > 0
    # a new process goes on where the last one stopped; nothing new changes nothing
    again = crawl.live()
    again.run_available(crawl.stream())
    check(crawl)
    crawl.arrive([200, 201, 202])
    again.run_available(crawl.stream())
    check(crawl)


def test_a_batch_that_runs_again_counts_once(spark, crawl):
    live = crawl.live()
    crawl.arrive(list(range(20)))
    for _ in range(2):
        live.audit_batch(pages_of(spark, list(range(20))), 0)
    check(crawl)


def test_unchanged_site_files_are_read_once(spark, crawl, monkeypatch):
    made = []
    real = live_audit.site_table
    monkeypatch.setattr(live_audit, "site_table", lambda files: (made.append(1), real(files))[1])
    live = crawl.live()
    for number in range(3):
        live.sites(number)
    crawl.robots = SHUT
    live.sites(3)
    assert len(made) == 2


def test_empty_batch_and_no_site_files(spark, crawl):
    none = spark.createDataFrame([], SITE_FILES_SCHEMA)
    live = LiveAudit(f"{crawl.folder}/live", lambda: none)
    live.audit_batch(spark.createDataFrame([], PAGES_SCHEMA), 0)
    live.audit_batch(pages_of(spark, [1, 2, 3]), 1)
    assert live_pages(spark, f"{crawl.folder}/live").count() == 5
