"""Phrase collocations (13): mergeable Misra-Gries summaries find the candidates, a second pass counts exactly.

First pass. Every run of one to four words inside a piece of text (an n-gram of a language) is hashed,
and the hash names one of P partitions and a key inside it. Tasks count keys in batches of bounded
size; a count above the threshold says no more than the threshold, so it is cut to it. Summaries of
one partition meet in one task, which first adds up their mass M and then merges them one after
another: counters are added, and when there are more than K = M / threshold of them (rounded down,
plus one), the (K+1)-th largest count is taken off all and what falls to zero is dropped. Each unit
taken off removes more than K + 1 units of mass, so less than the threshold is taken off in all, and
every n-gram that occurs ``threshold`` times keeps a counter. Two n-grams with one key add up, which
can only let more through.

Second pass. What survives sets bits in a table of fixed size, which all tasks get. N-grams whose bits
are set, and whose parts' bits are, are counted exactly, as text; the rest cannot be frequent. A bit
set by another n-gram costs a row, not a result. ``table_bits`` is the only thing to raise with very
large inputs: a fuller table lets more rows through.

Scores compare a phrase with the two parts of its weakest cut. Null texts count as empty, a null
language is ``und``; repeated rows count as often as they occur; extra columns are ignored; ties are
in the order of count and phrase; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.llm.common import stored

LONGEST = 4
_LOWER = bytes(b"\n"[0] if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_FACTOR, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LOW32, _32 = np.uint64(0xFFFFFFFF), np.uint64(32)
_SLICES = 256


def tokens(text: str | None) -> list[bytes]:
    """Words in order, ``\\n`` between pieces; may hold empty strings."""
    return (text or "").encode().translate(_LOWER).replace(b"\n", b" \n ").split(b" ")


class Batch:
    """Words of texts of one language as numbers, in one row, with -1 between pieces."""

    def __init__(self, lang: str):
        self.lang, self.parts, self.size = lang, [], 0
        self.ids: defaultdict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.ids[b""], self.ids[b"\n"]  # noqa: B018  numbers 0 and 1

    def add(self, text: str | None) -> None:
        found = tokens(text)
        row = np.fromiter(map(self.ids.__getitem__, found), dtype=np.int32, count=len(found))
        self.parts.append(np.append(row[row > 0], np.int32(1)))
        self.size += len(found) + 1

    def closed(self) -> tuple[np.ndarray, list[bytes]]:
        row = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)
        return np.where(row == 1, np.int32(-1), row), list(self.ids)


def batches(rows: Iterator[tuple[str, str | None]], most: int) -> Iterator[Batch]:
    """Texts (language, text) in batches of one language; all open ones together hold about ``most`` words."""
    opened: dict[str, Batch] = {}
    held = 0
    for lang, text in rows:
        if lang not in opened:
            opened[lang] = Batch(lang)
        before = opened[lang].size
        opened[lang].add(text)
        held += opened[lang].size - before
        if held >= most:
            yield from opened.values()
            opened, held = {}, 0
    yield from opened.values()


def hashed(row: np.ndarray, words: list[bytes], lang: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length from one word on: a hash of the n-gram at every place, and whether there is one."""
    seed = xxhash.xxh64_intdigest(lang.encode())
    one = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))
    single, there = one[row], row >= 0
    chain, valid = single, there
    for n in range(1, LONGEST + 1):
        if n > 1:
            chain = (chain[:-1] ^ (chain[:-1] >> np.uint64(29))) * _FACTOR + single[n - 1 :]
            valid = valid[:-1] & there[n - 1 :]
        mixed = (chain ^ (chain >> _32)) * _OTHER + np.uint64(n)
        yield mixed ^ (mixed >> np.uint64(31)), valid


def place(hashes: np.ndarray, partitions: int) -> tuple[np.ndarray, np.ndarray]:
    """Partition of each hash, and its 32-bit place inside the partition."""
    p = np.uint64(partitions)
    high = ((hashes >> _32) * p + (((hashes & _LOW32) * p) >> _32)) >> _32
    return high, (hashes * p) >> _32


def _count_type(threshold: int) -> type:
    return np.uint8 if threshold < 256 else np.uint32


def _texts(arrow: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str | None]]:
    for batch in arrow:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


def _summaries(partitions: int, threshold: int, most: int):
    """Maps (lang, text) to rows of each partition: first its mass (kind 0), then keys and counts (kind 1)."""

    def made(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("p", pa.int32()), ("kind", pa.int32()), ("mass", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
        for batch in batches(_texts(arrow), most):
            row, words = batch.closed()
            found, counts = [], []
            for h, valid in hashed(row, words, batch.lang):
                f, c = np.unique(h[valid], return_counts=True)
                found.append(f)
                counts.append(np.minimum(c, threshold).astype(_count_type(threshold)))
            found, counts = np.concatenate(found), np.concatenate(counts)
            if not len(found):
                continue
            order = np.argsort(found)  # by hash, hence by partition and place
            found, counts = found[order], counts[order]
            del order
            parts, keys = place(found, partitions)
            ps, at = np.unique(parts, return_index=True)
            ends = np.append(at[1:], len(parts))
            rows = []
            for p, a, b in zip(ps.tolist(), at.tolist(), ends.tolist(), strict=True):
                rows.append((p, 0, int(counts[a:b].sum(dtype=np.int64)), None, None))
                rows.append((p, 1, 0, keys[a:b].astype("<u4").tobytes(), counts[a:b].tobytes()))
                if len(rows) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return made


class Summary:
    """Misra-Gries counters of one partition; ``capacity`` must exceed mass / threshold."""

    def __init__(self, mass: int, threshold: int):
        self.threshold, self.capacity = threshold, mass // threshold + 1
        self.keys, self.counts, self.taken = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts.astype(np.int64)))
        self.held += len(keys)
        if self.held > self.capacity:
            self._settle()

    def _settle(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        self.keys = keys[first]
        self.counts = np.minimum(np.add.reduceat(counts, first), self.threshold) if len(first) else counts
        if len(self.keys) > self.capacity:
            less = int(np.partition(self.counts, -self.capacity - 1)[-self.capacity - 1])
            self.taken += less
            left = self.counts > less
            self.keys, self.counts = self.keys[left], self.counts[left] - less
        self.waiting, self.held = [], 0

    def survivors(self) -> np.ndarray:
        """Keys that may have reached the threshold."""
        self._settle()
        return self.keys[self.counts + self.taken >= self.threshold]


def _survivor_bits(threshold: int, slice_bits: int):
    """Maps sorted rows of ``_summaries`` to (p, bits): one bit for every surviving key, by its place."""

    def closed(p: int, summary: Summary) -> pa.RecordBatch:
        bits = np.zeros(slice_bits, np.uint8)
        bits[((summary.survivors().astype(np.uint64) * np.uint64(slice_bits)) >> _32).astype(np.int64)] = 1
        return pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["p", "bits"])

    def made(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, mass, summary = None, 0, None
        for batch in arrow:
            for q, kind, m, keys, counts in zip(*(batch.column(i) for i in range(5)), strict=True):
                if q.as_py() != p:
                    if summary is not None:
                        yield closed(p, summary)
                    p, mass, summary = q.as_py(), 0, None
                if kind.as_py() == 0:
                    mass += m.as_py()
                    continue
                summary = summary or Summary(mass, threshold)
                summary.merge(np.frombuffer(keys.as_py(), "<u4"), np.frombuffer(counts.as_py(), _count_type(threshold)))
        if summary is not None:
            yield closed(p, summary)

    return made


def _exact_counts(partitions: int, slice_bits: int, table, most: int):
    """Maps (lang, text) to exact counts (lang, phrase, words, a) of each batch's n-grams with set bits; words 0: all words."""

    def made(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table.value, np.uint8)
        for batch in batches(_texts(arrow), most):
            row, words = batch.closed()
            phrases, sizes, counts = [""], [0], [int((row >= 0).sum())]
            before = rank = None
            for n, (h, valid) in enumerate(hashed(row, words, batch.lang), 1):
                at = np.flatnonzero(valid if n == 1 else valid & before[:-1] & before[1:])
                p, key = place(h[at], partitions)
                bit = p.astype(np.int64) * slice_bits + ((key * np.uint64(slice_bits)) >> _32).astype(np.int64)
                at = at[(bits[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1]
                # numbers of n-grams: the number of all but the last word, and the last word
                last = row[at + n - 1].astype(np.int64)
                found, first, number, many = np.unique(last if n == 1 else (rank[at] << 32) | last, return_index=True, return_inverse=True, return_counts=True)
                before, rank = np.zeros(len(h), bool), np.zeros(len(h), np.int64)
                before[at], rank[at] = True, number
                starts = at[first].tolist()
                phrases += [b" ".join([words[i] for i in row[s : s + n].tolist()]).decode() for s in starts]
                sizes += [n] * len(starts)
                counts += many.tolist()
            for low in range(0, len(phrases), 1 << 16):
                some = slice(low, low + (1 << 16))
                size = len(phrases[some])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.lang] * size, pa.string()), pa.array(phrases[some], pa.string()), pa.array(sizes[some], pa.int32()), pa.array(counts[some], pa.int64())],
                    ["lang", "phrase", "words", "a"],
                )

    return made


def frequent_phrases(
    docs: DataFrame, threshold: int = 30, text: str = "text", lang: str = "lang", partition_bytes: int = 1 << 25, table_bits: int = 1 << 27, batch_words: int = 1_000_000
) -> DataFrame:
    """(lang, phrase, words, a): exact counts of all n-grams that occur ``threshold`` times; words 0: all words of the language."""
    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(total // partition_bytes) + 1
    slice_bits = max(8, table_bits // partitions // 8 * 8)
    summaries = source.mapInArrow(_summaries(partitions, threshold, batch_words), "p int, kind int, mass long, keys binary, counts binary")
    met = summaries.repartition(partitions, "p").sortWithinPartitions("p", "kind")
    found = met.mapInArrow(_survivor_bits(threshold, slice_bits), "p int, bits binary")
    table = bytearray(partitions * slice_bits // 8)  # partitions x slices: table_bits, whatever the input
    for row in found.toLocalIterator():
        table[row["p"] * slice_bits // 8 : (row["p"] + 1) * slice_bits // 8] = row["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(bytes(table))
    counted = source.mapInArrow(_exact_counts(partitions, slice_bits, shared, batch_words), "lang string, phrase string, words int, a long")
    exact = counted.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a"))
    return stored(exact.filter((F.col("a") >= threshold) | (F.col("words") == 0)))


def collocations(found: DataFrame, top: int = 2000, cover: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases, from ``frequent_phrases``.

    Parts of a frequent phrase are frequent, so all counts are in ``found``. A phrase is dropped if a
    longer candidate that holds its words has ``cover`` percent of its count or more.
    """
    totals = found.filter("words = 0").select("lang", F.col("a").alias("n"))
    counts = found.filter("words > 0")
    candidates = counts.filter("words > 1").withColumn("w", F.split("phrase", " "))
    inner = candidates.filter("words > 2").select("lang", "a", "words", "w", F.explode(F.expr("sequence(2, words - 1)")).alias("size"))
    inner = inner.select("lang", "a", "w", "size", F.explode(F.expr("sequence(1, words - size + 1)")).alias("at"))
    longest = inner.groupBy("lang", F.expr("array_join(slice(w, at, size), ' ')").alias("phrase")).agg(F.max("a").alias("longer"))
    covered = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * cover
    kept = candidates.join(longest, ["lang", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False)))
    cuts = kept.select("lang", "phrase", "a", "w", F.explode(F.expr("sequence(1, words - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("head"), F.expr("array_join(slice(w, k + 1, size(w) - k), ' ')").alias("tail")
    )
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn(
        "score", F.expr("cast((cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + r) as long)")
    )
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each slice first: no window holds a whole language
    sliced = weakest.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(_SLICES)))
    some = sliced.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))).filter(F.col("_rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
