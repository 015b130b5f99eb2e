"""Hand-made crawls: one origin per case, so that many cases run in one Spark job."""

from __future__ import annotations

from sitegauge.sources.tables import PAGES_SCHEMA, SITE_FILES_SCHEMA


def crawl(spark, cases):
    """cases: list of dicts with robots, html, headers, tdmrep (content type, body), url path."""
    pages, files = [], []
    for i, c in enumerate(cases):
        origin = f"https://case{i}.example"
        pages.append((i, origin + c.get("path", "/"), c.get("html", "<html></html>"), c.get("headers", {})))
        if c.get("robots") is not None:
            files.append((origin, "/robots.txt", c.get("status", 200), "text/plain", c["robots"]))
        if "tdmrep" in c:
            kind, body = c["tdmrep"]
            files.append((origin, "/tdmrep.json", c.get("tdmrep_status", 200), kind, body))
    return spark.createDataFrame(pages, PAGES_SCHEMA), spark.createDataFrame(files, SITE_FILES_SCHEMA)
