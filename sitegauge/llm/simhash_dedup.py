"""SimHash near-dedup (10): fingerprints, linked by a self-join of the binary trie of fingerprints.

Null and empty texts have fingerprint zero and link like any other; repeated rows are rows of the
same fingerprint. Null ids are kept and never become a component's id unless the whole component
has none. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import components, row_key, stored

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BLOCK = 1 << 16


def simhash(text: str | None, shingle: int = 3) -> int:
    """64-bit fingerprint of a text as a signed long; bit set if set in over half the shingles' XXH64."""
    words = _WORD.findall((text or "").encode().translate(_LOWER))
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    votes = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _BLOCK):
        spans = zip(starts[at : at + _BLOCK].tolist(), ends[at : at + _BLOCK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], 42) for a, b in spans], dtype="<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprint_column(text: str, shingle: int = 3) -> Column:
    @F.pandas_udf("long")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([simhash(t, shingle) for t in batch], dtype="int64")

    return fingerprint(F.col(text))


def _flips(width: int, most: int) -> str:
    """SQL array of (mask, number of bits) for all masks of ``width`` bits with up to ``most`` set."""
    masks = [(sum(1 << b for b in bits), n) for n in range(most + 1) for bits in combinations(range(width), n)]
    return "array(" + ", ".join(f"named_struct('mask', {m}L, 'n', {n})" for m, n in masks) + ")"


def trie_links(fingerprints: DataFrame, max_bits: int = 3, strides: tuple[int, ...] = (16, 8, 8)) -> DataFrame:
    """Pairs (u, v), u < v, of distinct fingerprints (column ``fp``) that differ in at most ``max_bits`` bits.

    Two tries are walked: over the fingerprints, and over them with their halves exchanged. Of two
    linked fingerprints one half differs in at most ``max_bits // 2`` bits, so that is the error
    budget of the first 32 levels of either trie: a pair of nodes beyond it is pruned with all
    below it. A pair of nodes goes down ``strides`` levels at a time: the children of the first
    node, and for each the children of the second that the remaining budget can still reach, if
    they exist. At level 32 the fingerprints below both nodes are compared in full.
    """
    assert sum(strides) == 32
    budget = max_bits // 2
    turned = F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
    leaves = fingerprints.select(F.explode(F.array(F.struct(F.lit(0).alias("half"), F.col("fp").alias("key")), F.struct(F.lit(1).alias("half"), turned.alias("key")))).alias("x"), "fp").select("x.*", "fp")

    def nodes(depth: int) -> DataFrame:
        return leaves.select("half", F.shiftrightunsigned("key", 64 - depth).alias("node")).distinct()

    depth, pairs = strides[0], None
    for stride in strides:
        if pairs is None:
            first = nodes(depth).select("half", F.col("node").alias("a"), F.lit(0).alias("err"), F.col("node").alias("b0"))
        else:
            depth += stride
            child = nodes(depth).select("half", F.shiftrightunsigned("node", stride).alias("a"), F.col("node").alias("c"))
            low = F.col("c").bitwiseAND(F.lit((1 << stride) - 1))
            first = pairs.join(child, ["half", "a"]).select("half", F.col("c").alias("a"), "err", F.shiftleft("b", stride).bitwiseOR(low).alias("b0"))
        reach = first.select("half", "a", "err", "b0", F.explode(F.expr(_flips(stride, budget))).alias("f")).select(
            "half", "a", F.col("b0").bitwiseXOR(F.col("f.mask")).alias("b"), (F.col("err") + F.col("f.n")).alias("err")
        ).filter((F.col("err") <= budget) & (F.col("a") <= F.col("b")))
        pairs = reach.join(nodes(depth).withColumnRenamed("node", "b"), ["half", "b"], "left_semi")
    ends = leaves.select("half", F.shiftrightunsigned("key", 32).alias("node"), "fp")
    met = pairs.join(ends.select("half", F.col("node").alias("a"), F.col("fp").alias("x")), ["half", "a"]).join(
        ends.select("half", F.col("node").alias("b"), F.col("fp").alias("y")), ["half", "b"]
    )
    near = (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= max_bits) & (F.col("x") != F.col("y"))
    return met.filter(near).select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, ``_h1``, ``_h2`` (of id and text), fp (long), component_id."""
    rows = stored(docs.select(F.col(id_column).alias("doc_id"), *row_key(id_column, text), fingerprint_column(text, shingle).alias("fp")))
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(trie_links(classes.select("fp"), max_bits))
    placed = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    lookup = stored(placed.join(ids, "root").select("fp", "component_id", "root"))
    return rows.join(lookup, "fp")


def fingerprint_hex(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``docs`` with one row of each component: the smallest id (nulls last), ties by hash of id and text.

    Of rows that agree in id and text one stays, whatever their other columns hold.
    """
    found = near_duplicates(docs, shingle=shingle, max_bits=max_bits)
    least = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_h1", "_h2")).alias("k"))
    kept = found.groupBy("root", "doc_id", "_h1", "_h2").agg(F.count("*").alias("copies")).join(least, "root").filter(
        (F.col("_h1") == F.col("k._h1")) & (F.col("_h2") == F.col("k._h2")) & F.col("doc_id").eqNullSafe(F.col("k.doc_id"))
    ).select("_h1", "_h2", "copies")
    packed = docs.select(F.struct("*").alias("_row"), *row_key("doc_id", "text"))
    survivors = packed.join(kept, ["_h1", "_h2"])
    once = survivors.filter("copies = 1").unionByName(survivors.filter("copies > 1").dropDuplicates(["_h1", "_h2"]))
    return once.select("_row.*")
