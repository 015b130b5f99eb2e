"""Stored snapshots: equal to the diff of tables, no shuffle, awkward addresses."""

from __future__ import annotations

import uuid

from sitegauge.operators.corpus import audit_diff
from sitegauge.operators.snapshots import diff_snapshots, open_snapshot, store_snapshot

CODES = "url string, codes array<struct<rule:string,key:string>>"
OLD = [
    ("https://a/", [("r1", ""), ("r2", "Bot")]), ("https://a/", [("r3", "")]), ("https://gone/", [("r1", "")]),
    (None, [("r1", "")]), (None, None), ("", [("r9", None)]), ("https://clean/", []), ("https://null/", None),
]
NEW = [
    ("https://a/", [("r2", "Bot"), ("r4", "")]), ("https://fresh/", [("r5", "")]), (None, [("r2", "")]),
    ("", [("r9", None)]), ("https://clean/", [("r1", "")]), ("u", [("r1", "")]),
]


def stored(spark, tmp_path, rows, buckets=4):
    name = f"snap_{uuid.uuid4().hex}"
    return name, store_snapshot(spark.createDataFrame(rows, CODES), name, f"{tmp_path}/{name}", buckets)


def sort(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_equals_the_diff_of_tables(spark, tmp_path):
    tables = [spark.createDataFrame(rows, CODES) for rows in (OLD, NEW)]
    kept = [stored(spark, tmp_path, rows)[1] for rows in (OLD, NEW)]
    out = diff_snapshots(*kept)
    assert out.columns == ["url", "rule", "key", "status"] and sort(out) == sort(audit_diff(*tables))
    assert ("", "r9", None, "kept") in sort(out) and (None, "r1", "", "fixed") in sort(out)


def test_no_shuffle(spark, tmp_path):
    kept = [stored(spark, tmp_path, rows)[1] for rows in (OLD, NEW)]
    plan = diff_snapshots(*kept)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_different_buckets_and_empty(spark, tmp_path):
    tables = [spark.createDataFrame(rows, CODES) for rows in (OLD, NEW, [])]
    old, new, none = (stored(spark, tmp_path, rows, n)[1] for rows, n in ((OLD, 3), (NEW, 5), ([], 4)))
    assert sort(diff_snapshots(old, new)) == sort(audit_diff(tables[0], tables[1]))
    assert sort(diff_snapshots(old, none)) == sort(audit_diff(tables[0], tables[2]))
    assert sort(diff_snapshots(none, new)) == sort(audit_diff(tables[2], tables[1]))


def test_opened_by_a_later_session(spark, tmp_path):
    name, old = stored(spark, tmp_path, OLD)
    new = stored(spark, tmp_path, NEW)[1]
    again = open_snapshot(spark, f"{name}_again", f"{tmp_path}/{name}", 4)
    out = diff_snapshots(again, new)
    assert sort(out) == sort(diff_snapshots(old, new))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_hot_url_is_pooled(spark, tmp_path):
    many = spark.range(20000).selectExpr("CAST(NULL AS STRING) AS url", "array(named_struct('rule', concat('r', id % 7), 'key', '')) AS codes")
    name = f"snap_{uuid.uuid4().hex}"
    rows = store_snapshot(many, name, f"{tmp_path}/{name}", 4).collect()
    assert len(rows) == 1 and rows[0].address == "" and len(rows[0].codes) == 7
