"""Token counts (5) by overlap resynchronisation, for a lower-casing word BPE that drops white space.

Texts of up to ``chunk`` code points are counted where they are. Longer ones are cut into chunks
that overlap, the chunks are dealt over all tasks, their overlaps are encoded with offsets, and two
neighbours are spliced at a boundary inside their overlap. A boundary is proven stable if it is a
plain white-space character: the encoder splits there before any merge, no added token holds one,
and neither normalisation nor lower-casing looks across it; so what stands on either side is encoded
alike in the chunk and in the whole text. The offsets of both chunks must also show no token there.
Between its splices a chunk is counted like a short text, part by part. Texts for which an overlap
holds no such boundary are cut again with chunks and overlaps four times as wide, until all
neighbours align or the text is one chunk.

Parts seen before are remembered in two generations, so that a full memory forgets only what was not
met lately. New parts are encoded together, with a character between them that is a token of its own.

Null counts as empty: zero bytes, zero tokens. Rows with equal texts count alike. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import row_key, stored

_STABLE = " \t\n\r"
_PARTS = re.compile(rf"[^{_STABLE}]+")
_MARK = "\x01"
_KEPT, _LONGEST, _AT_ONCE = 150_000, 64, 256


@lru_cache(maxsize=1)
def _encoder(path: str):
    """The encoder of this worker process; its tasks are the parallelism, so it starts no threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def word_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Token counts of texts; parts between proven boundaries are encoded once and remembered."""
    encoder = _encoder(path)
    between = encoder.encode(f"a {_MARK} b", add_special_tokens=False).ids[1:-1]
    known: dict[str, int] = {}
    older: dict[str, int] = {}

    def sizes_of(new: list[str]) -> dict[str, int]:
        alone = [p for p in new if len(between) != 1 or _MARK in p]
        out = {p: len(e) for p, e in zip(alone, encoder.encode_batch_fast(alone, add_special_tokens=False), strict=True)}
        together = [p for p in new if p not in out]
        for low in range(0, len(together), _AT_ONCE):
            some = together[low : low + _AT_ONCE]
            joined = f" {_MARK} ".join([*some, ""])
            ids = np.array(encoder.encode_batch_fast([joined], add_special_tokens=False)[0].ids)
            ends = np.flatnonzero(ids == between[0])
            out |= zip(some, (np.diff(ends, prepend=-1) - 1).tolist(), strict=True)
        return out

    def count(texts: list[str]) -> list[int]:
        nonlocal known, older
        out = []
        for text in texts:
            if len(known) > _KEPT:
                known, older = {}, known
            parts = _PARTS.findall(text)
            new = {p for p in parts if p not in known}
            known |= {p: older[p] for p in new if p in older}
            known |= sizes_of([p for p in new if p not in older])
            out.append(sum(map(known.__getitem__, parts)))
            for p in new:
                if len(p) > _LONGEST:
                    del known[p]
        return out

    return count


def count_column(path: str, text: str):
    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = word_counter(path)
        for batch in batches:
            yield pd.Series(counter(["" if t is None else t for t in batch]), dtype="int64")

    return count(F.col(text))


def splice(text: str, middle: int, low: int, high: int) -> int | None:
    """The proven boundary in [low, high) that is nearest to ``middle``, the left one of two."""
    left = max(text.rfind(c, low, middle + 1) for c in _STABLE)
    right = min((i for c in _STABLE if (i := text.find(c, middle, high)) >= 0), default=-1)
    if left < 0 or right < 0:
        return max(left, right) if max(left, right) >= 0 else None
    return left if middle - left <= right - middle else right


def cut(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, bool, str]]:
    """(number, last, piece) with ``overlap`` code points more on either side of each chunk."""
    for k, low in enumerate(range(0, len(text), chunk)):
        yield k, low + chunk >= len(text), text[max(0, low - overlap) : low + chunk + overlap]


def trusted(encoder, piece: str, middle: int, low: int, high: int) -> int | None:
    """The splice in [low, high), if the offsets of that stretch show no token on it."""
    at = splice(piece, middle, low, high)
    if at is None or encoder.encode(piece[low:high], add_special_tokens=False).char_to_token(at - low) is not None:
        return None
    return at


def spliced_count(encoder, counter: Callable[[list[str]], list[int]], k: int, last: bool, piece: str, chunk: int, overlap: int) -> tuple[int | None, int | None, int]:
    """Both splices of a piece as places in the whole text (None: no boundary both sides can trust), and the tokens between."""
    start = max(0, k * chunk - overlap)
    at = (k + 1) * chunk - start
    left = 0 if k == 0 else trusted(encoder, piece, overlap, 1, min(2 * overlap, len(piece) - 1))
    right = len(piece) if last else trusted(encoder, piece, at, at - overlap + 1, min(at + overlap, len(piece) - 1))
    if left is None or right is None:
        return None, None, 0
    return start + left, start + right, counter([piece[left:right]])[0]


def huge_counts(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(_h1, _h2, n_tokens) for distinct texts (_h1, _h2, text) of more than ``chunk`` code points."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_h1", "_h2", "k", "last", "piece"]
        for batch in batches:
            for h1, h2, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows, held = [], 0
                for k, last, piece in cut(text, chunk, overlap):
                    rows.append((h1, h2, k, last, piece))
                    held += len(piece)
                    if held > 1 << 22 or last:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
                        rows, held = [], 0

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, counter = _encoder(path), word_counter(path)
        for batch in batches:
            h1, h2, k, last, piece = (batch.column(i).to_pylist() for i in range(5))
            found = [spliced_count(encoder, counter, *x, chunk, overlap) for x in zip(k, last, piece, strict=True)]
            left, right, n = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(k, pa.int64()), pa.array(last, pa.bool_()), *(pa.array(c, pa.int64()) for c in (left, right, n))], ["_h1", "_h2", "k", "last", "lo", "hi", "n"])

    cuts = texts.select("_h1", "_h2", "text").mapInArrow(pieces, "_h1 long, _h2 long, k long, last boolean, piece string")
    dealt = cuts.repartition(F.col("_h1"), F.col("_h2"), F.col("k"))
    counted = dealt.mapInArrow(counts, "_h1 long, _h2 long, k long, last boolean, lo long, hi long, n long")
    # a splice belongs to the piece before and the piece after it: their places must be the same
    ends = F.sum(F.when(F.col("last"), F.lit(0)).otherwise(F.col("hi") * (F.col("k") + 1)))
    starts = F.sum(F.col("lo") * F.col("k"))
    return counted.groupBy("_h1", "_h2").agg(F.sum("n").alias("n"), (F.coalesce(ends == starts, F.lit(False)) & (F.count("lo") == F.count("*"))).alias("aligned")).select(
        "_h1", "_h2", F.when(F.col("aligned"), F.col("n")).alias("n_tokens")
    )


def token_counts(docs: DataFrame, path: str, limit: int = 2048, chunk: int = 16_384, overlap: int = 256, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""
    source = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sized = source.withColumn("n_bytes", F.octet_length("text").cast("long"))
    short = sized.filter(F.char_length("text") <= chunk).select("doc_id", "n_bytes", count_column(path, "text").alias("n_tokens"))
    long_rows = sized.filter(F.char_length("text") > chunk).select("doc_id", "n_bytes", *row_key("text"), "text")
    todo, done = long_rows.dropDuplicates(["_h1", "_h2"]).select("_h1", "_h2", "text"), None
    while True:
        found = stored(huge_counts(todo, path, chunk, overlap))
        good = found.filter("n_tokens is not null")
        done = good if done is None else done.unionByName(good)
        rest = found.filter("n_tokens is null").select("_h1", "_h2")
        if rest.isEmpty():
            break
        chunk, overlap = 4 * chunk, 4 * overlap
        todo = todo.join(rest, ["_h1", "_h2"], "left_semi")
    counted = long_rows.select("doc_id", "n_bytes", "_h1", "_h2").join(done, ["_h1", "_h2"]).select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(counted).withColumn("over_limit", F.col("n_tokens") > limit)
