"""The registered queries: columns and types of their contracts, whole tables, and SQL where there is some."""

from __future__ import annotations

import pytest

from sitegauge.llm.queries import llm_oracles, llm_queries
from verify.compare import compare, connect

SF = "/root/testdata/sf0.001"
CONTRACT = {
    "op2_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op3_repeated_bytes": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op4_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op5_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op8_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op9_nearest_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op10_simhash_near_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op11_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, removed_words bigint, removed_lines bigint",
    "op12_vector_codes": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
    "op13_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
}


def test_one_query_of_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in llm_queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", list(llm_queries()))
def test_columns_and_rows(spark, name):
    found = llm_queries()[name](spark, SF)
    if name in CONTRACT:
        assert ", ".join(f"{c} {t}" for c, t in found.dtypes) == CONTRACT[name]
    documents = spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = found.count()
    if name in ("op1_toxicity", "op2_sharding", "op3_repeated_bytes", "op4_pii", "op5_token_counts", "op10_simhash_near_dedup", "op11_quality_rules"):
        assert rows == documents
    else:
        assert rows > 0


@pytest.mark.parametrize("name", list(llm_oracles()))
def test_sql_agrees(spark, name):
    ok, note = compare(spark, connect(SF), SF, llm_queries()[name], llm_oracles()[name])
    assert ok, note
