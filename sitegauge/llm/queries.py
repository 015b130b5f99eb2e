"""The registered queries of this subpackage: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm.chat import fit, raw_transcripts, recover
from sitegauge.llm.decontamination import matches
from sitegauge.llm.line_quality import judge
from sitegauge.llm.nearest import search
from sitegauge.llm.oracles import ORACLES
from sitegauge.llm.packing import pack
from sitegauge.llm.phrases import collocations, frequent_phrases
from sitegauge.llm.pii import find_pii, pii_digest
from sitegauge.llm.repeats import find_repeats
from sitegauge.llm.sharding import shard
from sitegauge.llm.simhash_dedup import fingerprint_hex, near_duplicates
from sitegauge.llm.token_counts import token_counts
from sitegauge.llm.toxicity import fit_severity, severity
from sitegauge.llm.vector_codes import compress


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return severity(docs, fit_severity(docs, _table(spark, sf_dir, "labels")))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_table(spark, sf_dir, "documents"))


def op3_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(_table(spark, sf_dir, "documents")).drop("spans")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(find_pii(_table(spark, sf_dir, "documents")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumn("n_words", F.col("n_words").cast("long"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_transcripts(_table(spark, sf_dir, "conversations"))
    return recover(raw.drop("role"), fit(raw))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "embeddings"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", fingerprint_hex().alias("fingerprint"), "component_id")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(_table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(frequent_phrases(_table(spark, sf_dir, "documents")))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_toxicity, op2_sharding, op3_repeated_bytes, op4_pii, op5_token_counts, op6_decontamination, op7_chat_formatting, op8_packing,
        op9_nearest_neighbours, op10_simhash_near_dedup, op11_quality_rules, op12_vector_codes, op13_collocations,
    )
    return {f.__name__: f for f in found}


def llm_oracles() -> dict[str, str]:
    """SQL where it can say the same; tests/llm compares the others with brute force."""
    return dict(ORACLES)
