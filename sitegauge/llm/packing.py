"""Packing (8), concatenate and cut: all token ids in one long row, cut every ``size`` ids.

The place of a document in that row follows from two passes: the tokenising tasks number their
documents and add up their ids, and the totals of the tasks are then summed over all tasks. No id
is moved for it; cutting is a projection. Null texts count as empty and still carry the closing id;
repeated rows are packed like others; extra columns are ignored; an empty table gives no piece.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.llm.common import small_side, stored

#: Runs of characters without, or of nothing but, white space that the fast encoder is spared.
_LONG_RUN = re.compile(r"\S{1000}|\s{200}")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def byte_bpe(path: str) -> Callable[[str], np.ndarray]:
    """Ids as ``tokenizers`` gives them for a byte-level BPE file whose ids are in merge order.

    The same vocabulary runs in ``tiktoken``, which is several times faster; texts with very long
    runs, on which its pattern matching is slow, go to ``tokenizers`` itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    @lru_cache(maxsize=1)
    def exact() -> Tokenizer:
        return Tokenizer.from_file(path)

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    letter = _byte_of()
    ranks = {bytes(letter[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("packing", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        if _LONG_RUN.search(text):
            return np.array(exact().encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(fast.encode_to_numpy(text, allowed_special="all"), dtype="<u4")

    return encode


def tokenised(docs: DataFrame, path: str, end_id: int = 1, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored (part, start, doc_id, n, ids): ids as little-endian unsigned 32-bit, start within the task's own row."""
    kind = docs.schema[id_column].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, at = byte_bpe(path), TaskContext.get().partitionId(), 0
        last = np.array([end_id], dtype="<u4")
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                ids = [np.concatenate((ids_of(t or ""), last)) for t in some.column(1).to_pylist()]
                sizes = np.array([len(x) for x in ids], dtype=np.int64)
                starts = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ids), pa.int32()), pa.array(starts), some.column(0), pa.array(sizes), pa.array([x.tobytes() for x in ids], pa.binary())],
                    ["part", "start", "doc_id", "n", "ids"],
                )

    return stored(docs.select(id_column, F.col(text).cast("string")).mapInArrow(encode, f"part int, start long, doc_id {kind}, n long, ids binary"))


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset.

    Only the last sequence can be shorter than ``size``.
    """
    tokens = tokenised(docs, path, end_id, id_column, text)
    totals = stored(tokens.groupBy("part").agg(F.sum("n").alias("total")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = tokens.join(small_side(bases, totals.count()), "part").withColumn("at", F.col("base") + F.col("start"))
    pieces = F.expr(f"""
        transform(sequence(at div {size}, (at + n - 1) div {size}), k -> named_struct(
            'start', greatest(k * {size} - at, 0L),
            'length', least((k + 1) * {size}, at + n) - greatest(k * {size}, at),
            'ids', substring(ids, cast(greatest(k * {size} - at, 0L) * 4 + 1 as int), cast((least((k + 1) * {size}, at + n) - greatest(k * {size}, at)) * 4 as int)),
            'doc_tokens', n, 'sequence_id', k, 'offset', greatest(at - k * {size}, 0L)))""")
    return placed.select("doc_id", F.explode(pieces).alias("p")).select("doc_id", "p.*")
