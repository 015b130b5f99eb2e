"""Benchmark decontamination (6): item-sized windows of documents that repeat a benchmark item.

A window passes if the multisets of word shingles of window and item have a weighted Jaccard
similarity (weights: how often a shingle occurs) of at least ``similarity``. In order:

1. Lossless screen. A passing window holds at least s / (1 + s) of both sides' shingles in common,
   so only windows with that many hits on the item's shingles are looked at. Of those, the ones
   that begin with a hit, or end the text, are enough: moving right to the next hit loses none.
2. The words of each such window are hashed to a 64-bit SimHash, and so is every item.
3. Multi-index Hamming search. With a radius of r bits, fingerprints are cut into r + 1 blocks; two
   within the radius agree in one block at least, so a join on (item size, block, value) finds all.
   Windows that pass mostly lie within 20 bits, but not where repeated words outweigh the others.
4. Exact weighted similarity of every pair found, and of the pairs of the screen that lie outside
   the radius, so nothing is lost.

Words are runs of letters and digits in lower case. Items of fewer than five words have the whole
item as their one shingle; items and texts without words match nothing; a text shorter than an
item is one window. Null texts count as empty. Equal texts are searched once. Only DataFrame
functions are used; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import row_key, small_side, stored

TEXT = ["_h1", "_h2"]
WINDOW = [*TEXT, "n", "start"]


def words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(array: str, k: int) -> str:
    """SQL: array of (k, pos, sh) over the word array ``array``."""
    parts = ", ".join(f"{array}[i + {j}]" for j in range(k))
    made = f"transform(sequence(0, size({array}) - {k}), i -> named_struct('k', {k}, 'pos', i, 'sh', xxhash64({parts})))"
    return f"if(size({array}) >= {k}, {made}, cast(array() as array<struct<k:int,pos:int,sh:bigint>>))"


def _all_shingles(array: str, lengths: list[int]) -> Column:
    return F.expr("concat(" + ", ".join(shingles(array, k) for k in lengths) + ")")


def _simhash(by: list[str], exploded: DataFrame) -> DataFrame:
    """Fingerprint ``fp`` of the words ``x`` of each group: bit set if set in over half of them."""
    hashed = exploded.withColumn("h", F.xxhash64("x"))
    bits = [F.sum(F.shiftright("h", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(64)]
    sums = hashed.groupBy(*by).agg(F.count("*").alias("votes"), *bits)
    set_bits = [F.when(2 * F.col(f"b{b}") > F.col("votes"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")) for b in range(64)]
    return sums.select(*by, reduce(lambda x, y: x.bitwiseOR(y), set_bits).alias("fp"))


def _blocks(radius: int) -> Column:
    """(block, value) of fp cut into radius + 1 blocks of nearly equal width."""
    count = radius + 1
    edges = [64 * i // count for i in range(count + 1)]
    return F.array(*[
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value"))
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
    ])


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, shingle: int = 5, radius: int = 20) -> DataFrame:
    """(_h1, _h2, item_id, n_words, similarity) per distinct text and item: the best window's similarity."""
    items = stored(
        benchmark.select("item_id", words("text").alias("w")).distinct().filter("size(w) > 0")
        .withColumn("n", F.size("w")).withColumn("k", F.least("n", F.lit(shingle)))
    )
    lengths = sorted(r["k"] for r in items.select("k").distinct().collect()) or [shingle]  # at most five numbers
    of_items = items.select("item_id", "n", "k", F.explode(_all_shingles("w", lengths)).alias("x")).filter("x.k = k")
    item_shingles = stored(of_items.groupBy("item_id", "n", "k", F.col("x.sh").alias("sh")).agg(F.count("*").alias("ci")))
    source = docs.select(*row_key("text"), words("text").alias("w"))
    exploded = source.select(*TEXT, F.size("w").alias("len"), F.explode(_all_shingles("w", lengths)).alias("x")).select(*TEXT, "len", "x.pos", "x.sh", "x.k")
    known = item_shingles.select("sh", "k").distinct()
    met = exploded.join(small_side(known, item_shingles.count()), ["sh", "k"], "left_semi").distinct()
    hits = met.join(item_shingles.select("sh", "k", "item_id", "n"), ["sh", "k"])
    grouped = hits.groupBy(*TEXT, "len", "item_id", "n", "k").agg(F.sort_array(F.collect_set("pos")).alias("hits"))
    share = similarity / (1 + similarity)
    screened = (
        grouped.withColumn("size", F.least("n", "len")).withColumn("last", F.col("len") - F.col("size"))
        .withColumn("need", F.greatest(F.lit(1), F.ceil(share * (F.col("n") + F.col("size") - 2 * F.col("k") + 2) - 1e-9)).cast("int"))
        .filter("size(hits) >= need")
    )
    starts = F.expr("""array_union(
        filter(transform(hits, (h, i) -> if(h <= last and get(hits, i + need - 1) <= h + size - k, h, -1)), h -> h >= 0),
        if(get(hits, size(hits) - need) >= last, array(last), cast(array() as array<int>)))""")
    asked = stored(screened.select(*TEXT, "n", "k", "size", "item_id", F.explode(starts).alias("start")).distinct())
    windows = stored(asked.drop("item_id").distinct())
    texts = windows.select(*TEXT).distinct()
    found = source.join(small_side(texts, windows.count()), TEXT, "left_semi").dropDuplicates(TEXT)
    cut = stored(windows.join(found, TEXT).select(*WINDOW, "k", "size", F.slice("w", F.col("start") + 1, F.col("size")).alias("w")))
    prints = _simhash(WINDOW, cut.select(*WINDOW, F.explode("w").alias("x")))
    item_prints = _simhash(["item_id", "n"], items.select("item_id", "n", F.explode("w").alias("x")))
    left = prints.select(*WINDOW, "fp", F.explode(_blocks(radius)).alias("b")).select(*WINDOW, "fp", "b.*")
    right = item_prints.select("item_id", "n", F.col("fp").alias("item_fp"), F.explode(_blocks(radius)).alias("b")).select("item_id", "n", "item_fp", "b.*")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius
    within = left.join(right, ["n", "block", "value"]).filter(near).select(*WINDOW, "item_id")
    pairs = within.unionByName(asked.select(*WINDOW, "item_id")).distinct()
    window_shingles = cut.select(*WINDOW, "k", "size", F.explode(_all_shingles("w", lengths)).alias("x")).filter("x.k = k").groupBy(
        *WINDOW, "k", "size", F.col("x.sh").alias("sh")
    ).agg(F.count("*").alias("cw"))
    shared = pairs.join(window_shingles, WINDOW).join(item_shingles.drop("n"), ["item_id", "k", "sh"])
    common = shared.groupBy(*WINDOW, "k", "size", "item_id").agg(F.sum(F.least("cw", "ci")).alias("c"))
    scored = common.withColumn("similarity", F.col("c") / (F.col("n") + F.col("size") - 2 * F.col("k") + 2 - F.col("c")))
    return scored.groupBy(*TEXT, "item_id", F.col("n").alias("n_words")).agg(F.max("similarity").alias("similarity")).filter(F.col("similarity") >= similarity - 1e-12)


def matches(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, n_words, similarity) for every row of ``docs`` and item that it repeats."""
    found = stored(contaminated(docs, benchmark, **options))
    return docs.select("doc_id", *row_key("text")).join(small_side(found, found.count()), TEXT).select("doc_id", "item_id", "n_words", "similarity")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that repeat a benchmark item."""
    found = stored(contaminated(docs, benchmark, **options).select(*TEXT).distinct())
    packed = docs.select(F.struct("*").alias("_row"), *row_key("text"))
    return packed.join(small_side(found, found.count()), TEXT, "left_anti").select("_row.*")
