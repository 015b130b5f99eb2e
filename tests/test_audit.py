"""Whole audits: exact scores, issue lists, reports, selection, extension, skew, stream, reruns."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sitegauge import audit, register_dimension, select_dimensions
from sitegauge.operators import corpus, issues, report
from sitegauge.plans import audit as plan
from sitegauge.plans.skew import hot_keys, join_one_per_key
from sitegauge.sources.overlay import overlay_pages, overlay_site_files
from sitegauge.sources.tables import PAGES_SCHEMA, SITE_FILES_SCHEMA
from sitegauge.streaming import audit_stream as stream
from tests.helpers import crawl

ALLOW = "User-agent: *\nAllow: /\n"
BLOCK = "User-agent: *\nDisallow: /\n"
SHOP = (
    "User-agent: Bytespider\nUser-agent: cohere-ai\nDisallow: /\n\nUser-agent: *\nDisallow: /basket\nAllow: /\n\n"
    "User-agent: PerplexityBot\nDisallow: /\n"
)
META = '<html><head><meta name="{}" content="{}"></head></html>'
CRAWL = [
    ({"robots": ALLOW}, 100), ({"robots": BLOCK}, 0), ({"robots": "User-agent: GPTBot\nDisallow: /\n"}, 88),
    ({"robots": ALLOW, "html": META.format("robots", "noindex")}, 90),
    ({"robots": ALLOW, "headers": {"X-Robots-Tag": "noindex"}}, 95),
    ({"robots": None}, 100), ({"robots": "nope", "status": 404}, 100),
    ({"robots": BLOCK + "\nUser-agent: GPTBot\nAllow: /\n"}, 12),
    ({"robots": BLOCK, "html": META.format("robots", "noindex, nofollow"), "headers": {"X-Robots-Tag": "noindex, noai"}}, 0),
    ({"robots": SHOP}, 82), ({"robots": "# nothing"}, 100),
]
TDM_META = META.format("tdm-reservation", "1")
LINK = '<html><head><meta name="tdm-reservation" content="1"><link rel="tdm-policy" href="/p"></head></html>'
REP = ("application/json", "[]")
TDM = [
    ({}, 30, ["tdm_none"]),
    ({"headers": {"TDM-Reservation": "1"}}, 70, ["tdm_declared"]),
    ({"headers": {"TDM-Reservation": "1"}, "html": TDM_META}, 90, ["tdm_declared"]),
    ({"headers": {"TDM-Reservation": "1"}, "html": TDM_META, "tdmrep": REP}, 100, ["tdm_declared"]),
    ({"headers": {"TDM-Reservation": "banana"}}, 5, ["tdm_header_invalid"]),
    ({"headers": {"TDM-Reservation": "1"}, "html": META.format("tdm-reservation", "0")}, 60, ["tdm_conflict"]),
    ({"headers": {"TDM-Reservation": "1"}, "html": LINK, "tdmrep": REP}, 100, ["tdm_declared"]),
    ({"headers": {"TDM-Reservation": "1"}, "html": META.format("tdm-reservation", "x")}, 55, ["tdm_meta_invalid", "tdm_declared"]),
    ({"tdmrep": ("text/plain", ' \n{"a": 1}')}, 70, ["tdm_declared"]),
    ({"tdmrep": ("text/plain", "[1]")}, 30, ["tdm_none"]),
    ({"tdmrep": ("application/JSON", "[1]")}, 30, ["tdm_none"]),
    ({"tdmrep": REP, "tdmrep_status": 404}, 30, ["tdm_none"]),
    ({"tdmrep": REP, "html": META.format("tdm-reservation", "0")}, 60, ["tdm_conflict"]),
]


def test_crawl_scores(spark):
    pages, files = crawl(spark, [c for c, _ in CRAWL])
    rows = {r.page_id: r for r in audit(pages, files, "crawlability").collect()}
    for i, (case, want) in enumerate(CRAWL):
        assert rows[i].scores[0].value == want == rows[i].overall_score, case
    named = {i: [x.rule for x in r.issues] for i, r in rows.items()}
    assert named[5] == named[6] == ["robots_missing"] and named[10] == []
    assert named[7].count("robots_conflict") == 1 and named[7].count("bot_blocked") == 11
    first = rows[2].issues[0]
    assert (first.severity, first.title) == ("high", "GPTBot blocked — OpenAI (ChatGPT training data)")
    assert first.details == {
        "bot": "GPTBot", "operator": "OpenAI (ChatGPT training data)", "reason": "specific block (path: /)",
        "matching_rule": "Disallow: /",
    }
    assert "{" not in "".join(x.title + x.description + x.recommendation for r in rows.values() for x in r.issues)


def test_tdm_scores(spark):
    pages, files = crawl(spark, [c for c, _, _ in TDM])
    rows = {r.page_id: r for r in audit(pages, files, "tdm").collect()}
    for i, (case, want, rules) in enumerate(TDM):
        assert rows[i].scores[0].value == want, case
        assert [x.rule for x in rows[i].issues] == rules, case
    info = rows[3].issues[0]
    assert info.severity == "info" and info.title == "TDM policy declared: reserved (opt-out)"
    assert json.loads(info.details["sources"]) == ["http_header", "meta_tag", "tdmrep_json"]
    assert json.loads(info.details["signals"])[2]["value"] == "https://case3.example/tdmrep.json"
    clash = rows[5].issues[0]
    assert clash.severity == "high" and json.loads(clash.details["reserved_by"]) == ["http_header"]


def test_selection():
    names = [d.name for d in select_dimensions(None)]
    assert names[:5] == ["crawlability", "tdm", "structured-data", "extractability", "attribution"]
    assert [d.name for d in select_dimensions("tdm,crawlability")] == ["crawlability", "tdm"]
    for bad in ("tdm, crawlability", "nope"):
        with pytest.raises(ValueError, match="unknown dimension"):
            select_dimensions(bad)


def test_own_dimension(spark):
    """A dimension of one's own, with arbitrary Python per batch."""

    def facts(df):
        def count(batches):
            for b in batches:
                b["shouts"] = b["html"].str.count("!").astype("int32")
                yield b

        return df.mapInPandas(count, schema=StructType([*df.schema, StructField("shouts", IntegerType())]))

    def found(brief):
        one = issues.issue("low", "tone", "Loud", "Too loud.", "Calm down.", shouts=F.col("shouts"))
        empty = F.array().cast("array<struct<ord:int,severity:string,category:string,rule:string,key:string,title:string,"
                               "description:string,recommendation:string,details:map<string,string>>>")
        return F.when(F.col("shouts") > 2, F.array(one)).otherwise(empty)

    register_dimension(plan.Dimension("tone", "tone", facts, found, lambda: F.lit(100) - F.col("shouts"), ("shouts",)))
    try:
        pages, files = crawl(spark, [{"html": "a!!!"}, {"html": "b"}])
        rows = {r.page_id: r for r in audit(pages, files, "tone").collect()}
        assert rows[0].overall_score == 97 and rows[0].issues[0].details == {"shouts": "3"}
        assert rows[1].issues == []
        both = audit(pages, files, ["tone", "tdm"]).filter("page_id = 0").first()
        assert [s.category for s in both.scores] == ["tdm", "tone"] and both.issue_count == 2
    finally:
        del plan._DIMENSIONS["tone"]


def overlaid(spark, sf="0.001", shift=0):
    raw = spark.read.parquet(f"/root/testdata/sf{sf}/pages.parquet")
    return overlay_pages(raw, shift), overlay_site_files(raw, shift)


def flat(df):
    return sorted(map(str, df.drop("headers").collect()))


def test_hot_sites_give_the_same_result(spark):
    pages, files = overlaid(spark, "0.01")
    assert hot_keys(plan.pages_scan(pages), "origin", 3).count() > 5
    assert flat(audit(pages, files, rows_per_task=3)) == flat(audit(pages, files))


def test_hot_keys_are_split(spark):
    big = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 1000, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("key"))
    small = big.select("key").distinct().withColumn("v", F.length("key"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = join_one_per_key(big, small.filter("key <> 'k2000'"), "key", "id", rows_per_task=100)
        parts = joined.filter("key = 'hot'").groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) > 3 and joined.count() == 3000
        assert joined.filter("v IS NULL").select("key").collect() == [("k2000",)]
        assert joined.filter("v <> length(key)").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_same_result_on_one_and_many_partitions(spark):
    pages, files = overlaid(spark)
    assert flat(audit(pages.coalesce(1), files.coalesce(1), None)) == flat(audit(pages.repartition(8), files.repartition(5), None))


def test_repeated_fetches_of_a_site_file_do_not_multiply_pages(spark):
    pages, files = overlaid(spark)
    assert flat(audit(pages, files.unionAll(files))) == flat(audit(pages, files))


def test_invariants(spark):
    pages, files = overlaid(spark, "0.01")
    for r in audit(pages, files, None).collect():
        assert len(r.scores) == 5 and all(0 <= s.value <= 100 for s in r.scores)
        assert r.issue_count == len(r.issues) == sum(s.issue_count for s in r.scores)
        assert r.overall_score == round(sum(s.value for s in r.scores) / 5)
        assert [i.ord for i in r.issues] == sorted(i.ord for i in r.issues)


def test_brief_audit_has_the_same_codes(spark):
    pages, files = overlaid(spark)
    codes = lambda df: sorted(
        (r.page_id, i.ord, i.rule, i.key, i.severity) for r in df.collect() for i in r.issues
    )
    assert codes(audit(pages, files, None)) == codes(audit(pages, files, None, brief=True))


def test_reports(spark, tmp_path):
    pages, files = crawl(spark, [{"robots": BLOCK + "User-agent: GPTBot\nAllow: /", "headers": {"TDM-Reservation": "0"}}])
    audited = audit(pages, files)
    doc = json.loads(report.report_json(audited).first().report)
    assert list(doc) == ["url", "overall_score", "scores", "issues"] and doc["overall_score"] == 41
    by_title = {i["title"]: i for i in doc["issues"]}
    assert by_title["Conflicting directives: wildcard block with specific allows"]["details"] == {"specifically_allowed": ["GPTBot"]}
    assert by_title["TDM policy declared: not reserved (opt-in)"]["details"]["signals"][0]["value"] == "0"
    full = json.loads(report.report_json_full(audited, "9.9", datetime(2026, 1, 2, 3, 4)).first().report)
    assert full["generated_at"] == "2026-01-02T03:04:00+00:00" and full["version"] == "9.9" and full["metadata"] == {}
    assert [s["issue_count"] for s in full["scores"]] == [12, 1]
    report.write_tables(audited, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/issues")).count() == 13
    report.write_reports(report.report_json(audited), str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r")).first().value) == doc


def test_stream_equals_batch(spark, tmp_path):
    raw = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    sites = stream.store(plan.site_table(overlay_site_files(raw)), str(tmp_path / "sites"))
    source = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live = stream.audit_stream(overlay_pages(source), sites)
    got = stream.run_available(live, str(tmp_path / "out"), str(tmp_path / "chk"))
    assert flat(got) == flat(audit(overlay_pages(raw), overlay_site_files(raw)))


def test_rollup_equals_counting_rows(spark):
    pages, files = overlaid(spark)
    rows = plan.issues_table(audit(pages, files))
    got = {(r.category, r.severity, r.rule): (r.n_issues, r.n_pages) for r in corpus.issue_rollup(corpus.audited_patterns(pages, files)).collect()}
    want = rows.rollup("category", "severity", "rule").agg(F.count("*").alias("a"), F.countDistinct("page_id").alias("b")).collect()
    assert got == {(r.category, r.severity, r.rule): (r.a, r.b) for r in want}


def test_shared_folder_comes_from_the_cluster():
    class Session:
        conf = {"spark.checkpoint.dir": "hdfs://shared/here"}

    assert stream.shared_folder(Session()).startswith("hdfs://shared/here/")
    assert stream.shared_folder(Session()) != stream.shared_folder(Session())


def test_shared_folder_is_not_made_up():
    class Session:
        conf = {}

        class sparkContext:  # noqa: N801
            master = "yarn"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stream.shared_folder(Session())


def test_worst_best_and_ranks(spark):
    means = spark.createDataFrame([("a", 1, 50.0), ("b", 2, 50.0), ("c", 3, 72.5)], "origin string, n_pages long, mean_score double")
    assert [r.origin for r in corpus.worst_sites(means, 2).collect()] == ["a", "b"]
    assert [r.origin for r in corpus.best_sites(means, 2).collect()] == ["c", "a"]
    assert {(r.origin, r.mean_score, r.site_rank) for r in corpus.site_ranking(means).collect()} == {
        ("a", 50.0, 2), ("b", 50.0, 2), ("c", 72.5, 1)
    }


def test_ranks_tell_close_means_apart(spark):
    rows = [("x", 3, 67), ("x", 1, 66), ("y", 751, 67), ("y", 250, 66), ("z", 1, 10)]
    patterns = spark.createDataFrame(rows, "origin string, n_pages long, overall_score int")
    means = corpus.site_means(patterns)
    assert {r.origin: r.site_rank for r in corpus.site_ranking(means).collect()} == {"y": 1, "x": 2, "z": 3}


def test_peers_in_many_levels(spark):
    rows = [(f"https://s{i}.{'com' if i % 3 else 'org'}", 1, (i * 37 % 101) + i / 1000) for i in range(120)] + [("https://t.net", 1, 5.0)]
    means = spark.createDataFrame(rows, "origin string, n_pages long, mean_score double")
    got = {r.origin: r for r in corpus.peer_compare(means).collect()}
    for o, _, m in rows:
        peers = [x for p, _, x in rows if p.rsplit(".", 1)[1] == o.rsplit(".", 1)[1]]
        below = sum(x < m for x in peers) / (len(peers) - 1) if len(peers) > 1 else 0.0
        assert (got[o].n_peers, got[o].percent_rank) == (len(peers), below)
        assert abs(got[o].gap - (m - sum(peers) / len(peers))) < 1e-6


def test_origins_without_a_readable_file_stay(spark):
    files = spark.createDataFrame(
        [("https://a.x", "/robots.txt", 404, "text/plain", "User-agent: *\nDisallow: /"), ("https://b.x", "/robots.txt", 200, "text/plain", BLOCK)],
        SITE_FILES_SCHEMA,
    )
    sites = {r.origin: r for r in plan.site_table(files).collect()}
    assert not sites["https://a.x"].robots_found and sites["https://a.x"].allowed_weight == 100
    assert sites["https://b.x"].robots_found and sites["https://b.x"].allowed_weight == 0


def test_spellings_of_one_server_meet(spark):
    files = spark.createDataFrame([("https://A.x:443", "/robots.txt", 200, "text/plain", BLOCK), ("https://A.x", "/tdmrep.json", 200, "application/json", "[]")], SITE_FILES_SCHEMA)
    urls = ["https://a.x/", "https://A.X/", "https://a.x:443/", "https://a.x:8443/"]
    pages = spark.createDataFrame([(i, u, "", {}) for i, u in enumerate(urls)], PAGES_SCHEMA)
    got = {r.page_id: r for r in audit(pages, files).collect()}
    assert [got[i].scores[0].value for i in range(4)] == [0, 0, 0, 100]
    raw = [[i.details["signals"] for i in got[n].issues if i.rule == "tdm_declared"] for n in range(3)]
    assert [r[0].count(u + "tdmrep.json") for r, u in zip(raw, urls)] == [1, 1, 1]


def test_latest_fetch_counts(spark):
    from datetime import datetime

    from sitegauge.sources.tables import site_scan

    rows = [("https://a.x", "/robots.txt", 200, "", body, day and datetime(2026, 1, day)) for body, day in (("old", 1), ("new", 3), ("aaa", 2), ("zzz", 3), ("none", None))]
    files = spark.createDataFrame(rows, "origin string, path string, status int, content_type string, body string, fetched_at timestamp")
    assert site_scan(files).first().body == "new"
    assert site_scan(files.drop("fetched_at")).first().body == "aaa"


def test_pages_without_address_do_not_meet_in_one_task(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        big = spark.range(2000).selectExpr("id AS page_id", "CAST(NULL AS STRING) AS origin")
        small = spark.createDataFrame([("https://a.x", 1)], "origin string, w int")
        joined = join_one_per_key(big, small, "origin", "page_id", None, 100)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 2000 and len(sizes) > 4 and max(sizes) < 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sliced_join_equals_the_plain_one(spark):
    from sitegauge.plans.skew import join_in_slices

    big = spark.range(50).selectExpr("id AS page_id", "IF(id % 7 = 0, NULL, concat('k', id % 4)) AS origin")
    small = spark.createDataFrame([("k0", 1), ("k1", 2), ("k9", 3)], "origin string, w int")
    assert flat(join_in_slices(big, small, "origin", "page_id", 5)) == flat(big.join(small, "origin", "left"))


def test_audit_diff_pools_pages_of_one_address(spark):
    def snap(rows):
        return spark.createDataFrame(rows, "url string, codes array<struct<rule:string,key:string>>")

    old = snap([("u", [("a", ""), ("b", "x")]), ("u", [("c", "")]), ("gone", [("a", "")]), ("same", [])])
    new = snap([("u", [("b", "x"), ("d", "")]), ("came", [("a", "")]), ("came", [("a", "")])])
    assert {tuple(r) for r in corpus.audit_diff(old, new).collect()} == {
        ("u", "a", "", "fixed"), ("u", "c", "", "fixed"), ("u", "b", "x", "kept"), ("u", "d", "", "new"), ("gone", "a", "", "fixed"), ("came", "a", "", "new"),
    }


def shuffled_bytes(df):
    """Result rows, and the bytes that all exchanges of the plan wrote for them."""
    rows, todo, total = df.collect(), [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            total += node.metrics().apply("dataSize").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows, total


def test_audit_diff_of_pages_without_address_stays_small(spark):
    def snap(first):
        code = "struct(concat('r', (id + {0}) % 20) AS rule, '' AS key)"
        codes = ", ".join(code.format(first + i) for i in range(5))
        return spark.range(0, 40_000, 1, 4).selectExpr("IF(id % 4000 = 1, concat('u', id), NULL) AS url", f"array({codes}) AS codes")

    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows, size = shuffled_bytes(corpus.audit_diff(snap(0), snap(1)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert {(r.rule, r.status) for r in rows if r.url is None} == {(f"r{i}", "kept") for i in range(20)}
    assert len(rows) == 20 + 10 * 6 and size < 100_000  # 80,000 pages of 5 codes come down to sets of 20
