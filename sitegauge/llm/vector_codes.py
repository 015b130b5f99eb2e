"""Vector codes (12): product quantisation in whole numbers, nearest entries found by Orchard's search.

A vector is cut into equal consecutive parts; each part position has a codebook, and a code names the
nearest entry of each. The search keeps, for every entry, the other entries sorted by distance from
it. From the best entry so far the search walks down that entry's list, passes over entries already
looked at, jumps to the list of any better entry it meets, and stops when the list is beyond twice
the current distance: by the triangle inequality nothing there can be as near. It runs for all
vectors of a batch at once; those that have stopped leave.

Codebooks start as the parts of the vectors with the smallest ids, and each round moves an entry to
the rounded-down mean of its parts. Tasks add up parts per entry and send the sums; the driver holds
one sum per entry and component, whatever the number of vectors. All arithmetic is exact: batches
with components too large for 64 bits are worked out with Python's integers.

Vectors that are null or empty or hold null or non-finite components are left out, and so are those of another
length than the kept vector with the smallest id. A length that the number of parts does not divide
is filled up with zeros. Null ids come last in order; rows that share an id are ordered by
components. Repeated rows give repeated rows. Errors beyond a long are null. Fewer vectors than entries give smaller codebooks; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import join_one_per_key, stored

_LIMB = 40  # sums travel in pieces of so many bits, which add up as longs
_SMALL, _WIDEST = 1 << 25, 256  # bounds below which squares and their sums fit 64 bits
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Codebooks:
    """``entries[p]``: the entries of part position p, one row each; ``size``: length of the vectors."""

    entries: list[np.ndarray]
    size: int
    scale: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for book in self.entries for x in book.ravel()).encode()).hexdigest()


def whole_parts(flat: np.ndarray, size: int, parts: int, scale: int) -> np.ndarray:
    """Rows of ``size`` components as whole numbers, rounded down, cut into parts: (rows, parts, width)."""
    width = -(-size // parts)
    x = flat.reshape(-1, size)
    if np.abs(x).max(initial=0.0) * scale < _SMALL and width <= _WIDEST:
        whole = np.floor(x * scale).astype(np.int64)
    else:
        whole = np.empty(x.shape, dtype=object)
        for at, v in np.ndenumerate(x):
            top, bottom = float(v).as_integer_ratio()
            whole[at] = top * scale // bottom
    if width * parts > size:
        whole = np.concatenate((whole, np.zeros((len(whole), width * parts - size), whole.dtype)), axis=1)
    return whole.reshape(len(whole), parts, width)


def neighbour_lists(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the others by (distance, number), and these squared distances."""
    k = len(entries)
    gaps = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)
    ranked = np.array([sorted((j for j in range(k) if j != i), key=lambda j, i=i: (gaps[i, j], j)) for i in range(k)], dtype=np.int64).reshape(k, k - 1)
    return ranked, np.take_along_axis(gaps, ranked, axis=1)


def orchard(points: np.ndarray, entries: np.ndarray, ranked: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each point's nearest entry, the lower of ties, and the squared distance."""
    n, k = len(points), len(entries)
    best, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
    distance = ((points - entries[0]) ** 2).sum(1)
    seen = np.zeros((n, k), bool)
    seen[:, 0] = True
    going = np.arange(n)
    while k > 1 and len(going):
        entry, step = best[going], at[going]
        go = step < k - 1
        going, entry, step = going[go], entry[go], step[go]
        go = (gaps[entry, step] <= 4 * distance[going]).astype(bool)  # squares: not beyond twice the distance
        going, other = going[go], ranked[entry[go], step[go]]
        at[going] += 1
        new = ~seen[going, other]
        look, other = going[new], other[new]
        seen[look, other] = True
        d = ((points[look] - entries[other]) ** 2).sum(1)
        better = ((d < distance[look]) | ((d == distance[look]) & (other < best[look]))).astype(bool)
        jump = look[better]
        best[jump], distance[jump], at[jump] = other[better], d[better], 0
    return best, distance


def _lists(books: Codebooks) -> list[tuple[np.ndarray, ...]]:
    return [(e, *neighbour_lists(e)) for e in books.entries]


def _matching(whole: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Both sides in 64 bits or both in Python's integers."""
    return whole if whole.dtype == entries.dtype else whole.astype(object)


def _sums(books: Codebooks):
    """Maps (v) to sums over the task: slot of (part, entry, component or count), piece of 40 bits, its value."""
    parts, width = len(books.entries), books.entries[0].shape[1]
    most = max(len(e) for e in books.entries)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = _lists(books)
        total = np.zeros((parts, most, width + 1), dtype=object)
        for batch in batches:
            whole = whole_parts(batch.column(0).flatten().to_numpy(zero_copy_only=False), books.size, parts, books.scale)
            for p, (entries, ranked, gaps) in enumerate(lists):
                x = _matching(whole[:, p], entries)
                code, _ = orchard(x, entries, ranked, gaps)
                for e in np.unique(code).tolist():
                    mine = x[code == e]
                    total[p, e, :width] += mine.sum(0).astype(object)
                    total[p, e, width] += len(mine)
        rows = []
        for slot, value in enumerate(total.ravel().tolist()):
            piece = 0
            while value:
                low = value if -(1 << 62) < value < 1 << 62 else value & ((1 << _LIMB) - 1)
                rows.append((slot, piece, low))
                value, piece = (value - low) >> _LIMB, piece + 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64()), strict=True)], ["slot", "piece", "value"])

    return made


def usable(vectors: DataFrame, id_column: str = "vec_id", embedding: str = "embedding", label: str | None = "label") -> DataFrame:
    """(vec_id, label, v array<double>) of the vectors that take part, whatever their length."""
    tag = F.lit(None).cast("string") if label is None else F.col(label)
    rows = vectors.select(F.col(id_column).alias("vec_id"), tag.alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    return rows.filter("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


def fit(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks | None:
    """Codebooks of ``usable`` rows; None if there are none."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not first:
        return None
    size = len(first[0]["v"])
    start = [whole_parts(np.array(r["v"]), size, parts, scale)[0] for r in first if len(r["v"]) == size]
    kind = object if any(s.dtype == object for s in start) else np.int64
    books = Codebooks([np.array([s[p] for s in start], dtype=kind) for p in range(parts)], size, scale)
    for _ in range(rounds):
        found = rows.filter(F.size("v") == size).select("v").mapInArrow(_sums(books), "slot int, piece int, value long")
        added = found.groupBy("slot", "piece").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
        books = moved(books, [(r["slot"], r["piece"], int(r["value"])) for r in added])
    return books


def moved(books: Codebooks, added: list[tuple[int, int, int]]) -> Codebooks:
    """Each entry at the rounded-down mean of its parts; unused ones stay."""
    width, most = books.entries[0].shape[1], max(len(e) for e in books.entries)
    total = [0] * (len(books.entries) * most * (width + 1))
    for slot, piece, value in added:
        total[slot] += value << (_LIMB * piece)
    out = []
    for p, book in enumerate(books.entries):
        new = book.astype(object)
        for e in range(len(book)):
            at = (p * most + e) * (width + 1)
            if total[at + width]:
                new[e] = [s // total[at + width] for s in total[at : at + width]]
        small = max((abs(x) for x in new.ravel()), default=0) < _SMALL and width <= _WIDEST
        out.append(new.astype(np.int64) if small else new)
    return Codebooks(out, books.size, books.scale)


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (a number for each part), error (null beyond a long) of ``usable`` rows."""
    kept = rows.filter(F.size("v") == books.size)
    id_type, tag_type = (kept.schema[c].dataType for c in ("vec_id", "label"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = _lists(books)
        for batch in batches:
            whole = whole_parts(batch.column(2).flatten().to_numpy(zero_copy_only=False), books.size, len(lists), books.scale)
            found = [orchard(_matching(whole[:, p], entries), entries, ranked, gaps) for p, (entries, ranked, gaps) in enumerate(lists)]
            codes = np.stack([c for c, _ in found], axis=1)
            errors = [e if e <= _LONG else None for e in sum(d.astype(object) for _, d in found).tolist()]
            values, ends = pa.array(codes.ravel(), pa.int32()), pa.array(np.arange(len(codes) + 1) * len(lists), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, values), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    return kept.select("vec_id", "label", "v").mapInArrow(made, f"vec_id {id_type.simpleString()}, label {tag_type.simpleString()}, code array<int>, error long")


def decode(code: list[int], books: Codebooks) -> list[float]:
    """The vector that a code stands for: the entries it names, half a step up, since components were rounded down."""
    whole = [int(x) for book, c in zip(books.entries, code, strict=True) for x in book[c]]
    return [(x + 0.5) / books.scale for x in whole[: books.size]]


def compress(vectors: DataFrame, id_column: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code (hex), error, label_error (errors summed over equal labels, nulls together), codebooks_sha256."""
    rows = usable(vectors, id_column, embedding, label)
    books = fit(rows)
    if books is None:
        empty = rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return empty.withColumn("codebooks_sha256", F.lit("")).limit(0)
    tag = F.when(F.col("label").isNull(), F.lit("none")).otherwise(F.concat(F.lit("is "), F.col("label").cast("string")))
    coded = stored(encode(rows, books).select("vec_id", F.expr("lower(array_join(transform(code, c -> lpad(hex(c), 2, '0')), ''))").alias("code"), "error", tag.alias("_label")))
    whole = F.when(F.count("error") == F.count("*"), F.expr("try_cast(sum(cast(error as decimal(38,0))) as long)")).alias("label_error")
    out = join_one_per_key(coded, coded.groupBy("_label").agg(whole), ["_label"])
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
