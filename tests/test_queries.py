"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry
from verify.compare import compare, connect
from verify.oracle_content import content_oracles
from verify.oracle_core import core_oracles
from verify.oracle_corpus import corpus_oracles
from verify.queries_content import content_queries
from verify.queries_core import core_queries
from verify.queries_corpus import corpus_queries

SF = "/root/testdata/sf0.001"
QUERIES = {**core_queries(), **corpus_queries(), **content_queries()}
SQL = {**core_oracles(), **corpus_oracles(), **content_oracles()}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["page_id", "origin", "blocked_bots", "crawl_score"] and df.count() == 50


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF, QUERIES[name], SQL.get(name))
    assert ok, note


@pytest.mark.parametrize("hidden", ["sitegauge.llm", "public_tokenizers", "corpus_pipeline"])
def test_entry_without_the_training_data_operators(monkeypatch, hidden):
    import sys

    import __spark_entry__

    for name in [n for n in sys.modules if n.split(".")[0] in ("corpus_pipeline", "public_tokenizers") or n.startswith("sitegauge.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, hidden, None)
    found = __spark_entry__.queries()
    assert set(QUERIES) <= set(found) and "pipeline" not in found and set(SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", ["site_ranking", "peer_compare"])
def test_rankings_audit_the_crawl_once(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "html" not in plan
