"""Repeated byte strings (3) by prefix-free parsing of the corpus.

Every byte covered by a string of ``length`` bytes that also starts elsewhere, in the same or
another document, is removed.

Parsing. A rolling hash runs over the text; the trigger of a string of ``length`` bytes is the place
of its least hash, the left one of ties. The strings with the same trigger start next to each other,
and together they span one phrase. Phrases overlap, no phrase is a proper prefix of another with the
same trigger, and which phrase a string belongs to, and where in it, depends on the string alone.
So two equal strings lie at the same distance from the triggers of their phrases, and every string
in question lies in whole inside one phrase: it is a suffix of that phrase, cut to ``length``.

Dictionary. Equal phrases are one entry. A phrase that occurs twice is repeated with all its
strings, without looking at them. The others can share strings only with entries that agree with
them on a stretch at the trigger, to its right or to its left, which all strings of that side hold;
only those are opened. Their cut suffixes, in blocks where many are alike, are grouped over the whole
corpus by 128-bit fingerprints, where equal ones meet. They are not sorted, and no suffix array of
dictionary or parse is built: equality is all that is asked.

Texts that occur in several rows are repeated in full if they have ``length`` bytes. Null counts as
empty; texts shorter than ``length`` lose nothing. Extra columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import row_key, small_side, stored

TEXT, PHRASE = ["_h1", "_h2"], ["d1", "d2"]
GRAM = 32
BLOCK = 16  # places by distance to the trigger that are first looked at together
_PART = 1 << 20


def rolling(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the ``GRAM`` bytes from every place on."""
    x, step, factor = data.astype(np.uint32), 1, np.uint32(0x01000193)
    with np.errstate(over="ignore"):
        while step < GRAM:
            x = x[:-step] * factor + x[step:]
            factor, step = factor * factor, 2 * step
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(12)
    return x


def parse(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, trigger) of each phrase: its strings start at first to last."""
    count = len(data) - length + 1
    if count <= 0:
        return (np.zeros(0, np.int64),) * 3
    span = length - GRAM + 1
    firsts, triggers, seen = [], [], -1
    for low in range(0, count, _PART):
        high = min(count, low + _PART)
        hashes = rolling(data[low : high + length - 1])
        least = (hashes.astype(np.uint64) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64) + low
        new = np.flatnonzero(np.concatenate(([at[0] != seen], at[1:] != at[:-1])))
        firsts.append(new + low)
        triggers.append(at[new])
        seen = at[-1]
    first, trigger = np.concatenate(firsts), np.concatenate(triggers)
    return first, np.concatenate((first[1:], [count])) - 1, trigger


def _digests(parts: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(p) for p in parts]), dtype="<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _screens(parts: Iterator[bytes], seed: int) -> np.ndarray:
    digest = xxhash.xxh3_64_digest
    return np.frombuffer(b"".join([digest(p, seed)[::-1] for p in parts]), dtype="<i8")


def _phrase_rows(length: int):
    """Maps (_h1, _h2, text) to phrases with digests of the whole, and of what stands right and left of the trigger."""
    half = (length - GRAM) // 2

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h1, h2, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = (text or "").encode()
                first, last, trigger = parse(np.frombuffer(data, dtype=np.uint8), length)
                for low in range(0, len(first), 1 << 16):
                    some = slice(low, low + (1 << 16))
                    a, b, t = first[some].tolist(), last[some].tolist(), trigger[some].tolist()
                    n = len(a)
                    d1, d2 = _digests(data[x : y + length] for x, y in zip(a, b, strict=True))
                    right = _screens((data[z : z + length - half] for z in t), 1)
                    left = _screens((data[max(0, z - half - 1) : z + GRAM] for z in t), 2)
                    no_right, no_left = trigger[some] - last[some] > half, trigger[some] - first[some] <= half
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, h1)), pa.array(np.full(n, h2)), *(pa.array(x[some], pa.int32()) for x in (first, last, trigger)),
                         pa.array(d1), pa.array(d2), pa.array(right, mask=no_right), pa.array(left, mask=no_left)],
                        ["_h1", "_h2", "first", "last", "trigger", "d1", "d2", "right", "left"],
                    )

    return made


def _opened_rows(length: int):
    """Maps (_h1, _h2, text, opened: array of (d1, d2, side, once, low, high, trigger)) to rows with the bytes around."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["d1", "d2", "side", "once", "_h1", "_h2", "low", "high", "trigger", "base", "s"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            for h1, h2, text, opened in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                data = (text or "").encode()
                for at in range(0, len(opened), 4096):
                    rows = []
                    for o in opened[at : at + 4096]:
                        base = max(0, o["low"] - BLOCK)
                        rows.append((o["d1"], o["d2"], o["side"], o["once"], h1, h2, o["low"], o["high"], o["trigger"], base, data[base : o["high"] + length + BLOCK]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return made


def _met(rows: DataFrame, keys: list[str], *more) -> DataFrame:
    """Keys that two different phrases share."""
    pair = F.struct(*PHRASE)
    return rows.groupBy(*keys).agg(F.min(pair).alias("a"), F.max(pair).alias("b"), *more).filter(F.col("a") != F.col("b")).drop("a", "b")


def shared_strings(opened: DataFrame, length: int) -> DataFrame:
    """(_h1, _h2, low, high): strings of phrases that occur once which another opened phrase holds too.

    The places of a side are taken in blocks by their distance to the trigger. If all that the
    strings of a block cover together is shared, so are all of them; if what they have in common is
    not, none is. Only blocks in between are looked at string by string, against one phrase of each
    kind that shares the common part.
    """

    def digest(kind: int, sub: str) -> str:
        return ", ".join(f"'{n}{i}', xxhash64({kind + i}, k, {sub})" for n, i in (("f", 1), ("f", 2)))

    first = f"(trigger - {BLOCK} * k - {BLOCK - 1})"
    whole = f"substring(s, {first} - base + 1, {length + BLOCK - 1})"
    common = f"substring(s, trigger - {BLOCK} * k - base + 1, {length - BLOCK + 1})"
    there = f"{first} >= base and {first} + {length + BLOCK - 1} <= base + octet_length(s)"
    blocks = opened.select("d1", "d2", "side", "once", *TEXT, "low", "high", "trigger", F.expr(f"""explode(transform(
        sequence((trigger - high) div {BLOCK}, (trigger - low) div {BLOCK}), k -> named_struct('k', k,
        'u', if({there}, named_struct({digest(10, whole)}), null), 'c', named_struct({digest(20, common)}))))""").alias("x"))
    blocks = stored(blocks.select("d1", "d2", "side", "once", *TEXT, "low", "high", "trigger", "x.*"))
    unions = _met(blocks.filter("u is not null"), ["u"])
    # blocks at the ends of texts have no u; they would all meet in one task of the join
    inner, ends = blocks.filter("u is not null"), blocks.filter("u is null").withColumn("all", F.lit(False))
    inner = inner.join(unions.withColumn("all", F.lit(True)), "u", "left").withColumn("all", F.coalesce("all", F.lit(False)))
    marked = stored(inner.unionByName(ends))
    clipped = [F.greatest("low", F.expr(first)).alias("low"), F.least("high", F.expr(f"trigger - {BLOCK} * k")).alias("high")]
    whole_blocks = marked.filter("once and all").select(*TEXT, *clipped)
    cores = stored(_met(marked, ["c"], F.bool_or(F.expr("once and not all")).alias("ask")).filter("ask").drop("ask"))
    near = marked.join(small_side(cores, cores.count()), "c", "left_semi")
    ask = near.filter("once and not all").select("d1", "d2", "side", "k", F.lit(True).alias("asks"))
    # phrases that share a whole block stand for each other; at the ends of texts there is no whole block
    own = F.when(F.col("u").isNull(), F.struct(*PHRASE)).alias("own")
    known = near.filter("not once or all").groupBy("c", "u", "side", own).agg(F.min(F.struct("d1", "d2", "side", "k")).alias("r"))
    wanted = ask.unionByName(known.select("r.*", F.lit(False).alias("asks")))
    strings = wanted.join(opened, [*PHRASE, "side"]).select("d1", "d2", "asks", *TEXT, "s", "base", *clipped)
    places = strings.select("d1", "d2", "asks", *TEXT, F.expr(f"""explode(transform(sequence(low, high), k -> named_struct('at', k,
        'f', named_struct({digest(30, f'substring(s, k - base + 1, {length})').replace(', k, ', ', ')}))))""").alias("x"))
    places = stored(places.select("d1", "d2", "asks", *TEXT, "x.*"))
    single = places.filter("asks").join(_met(places, ["f"]), "f").select(*TEXT, F.col("at").alias("low"), F.col("at").alias("high"))
    return whole_blocks.unionByName(single)


def covered(starts: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs [a, b) covered by the strings that start at low to high."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(starts):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high + length))
        else:
            out.append((low, high + length))
    return out


def _cut_rows(length: int):
    """Maps (_h1, _h2, text, starts) to what is removed and a digest of what is left."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h1, h2, text, starts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                data, left, at = (text or "").encode(), hashlib.sha256(), 0
                runs = covered([(s["low"], s["high"]) for s in starts], length)
                for a, b in runs:
                    left.update(data[at:a])
                    at = b
                left.update(data[at:])
                rows.append((h1, h2, sum(b - a for a, b in runs), len(runs), left.hexdigest(), [{"start": a, "end": b} for a, b in runs]))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), strict=True)],
                    ["_h1", "_h2", "n_removed", "n_spans", "kept_sha256", "spans"],
                )

    return made


def find_repeats(docs: DataFrame, length: int = 400, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (byte offsets) of every row."""
    half = (length - GRAM) // 2
    source = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    source = source.select("doc_id", *row_key("text"), "text")
    rows = source.select("doc_id", *TEXT, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    copies = stored(rows.groupBy(*TEXT).agg(F.count("*").alias("copies"), F.max("n_bytes").alias("size")).filter((F.col("copies") > 1) & (F.col("size") >= length)).select(*TEXT))
    schema = "_h1 long, _h2 long, first int, last int, trigger int, d1 long, d2 long, right long, left long"
    phrases = stored(source.select(*TEXT, "text").filter(F.octet_length("text") >= length).mapInArrow(_phrase_rows(length), schema))

    # dictionary: one entry per distinct phrase, with one place where it stands
    place = F.struct(*TEXT, "first", "last", "trigger", "right", "left")
    entries = phrases.groupBy(*PHRASE).agg(F.min(place).alias("at"), F.max(F.struct(*TEXT, "first")).alias("other"))
    once = (F.col("at._h1") == F.col("other._h1")) & (F.col("at._h2") == F.col("other._h2")) & (F.col("at.first") == F.col("other.first"))
    dictionary = stored(entries.select(*PHRASE, "at.*", once.alias("once")))

    # sides of entries that agree with another entry on the stretch at the trigger
    right = F.struct(F.lit(1).alias("side"), F.col("right").alias("key"), F.greatest("first", F.col("trigger") - half).alias("low"), F.col("last").alias("high"))
    left = F.struct(F.lit(2).alias("side"), F.col("left").alias("key"), F.col("first").alias("low"), F.least("last", F.col("trigger") - half - 1).alias("high"))
    sides = dictionary.select(*PHRASE, *TEXT, "once", "trigger", F.explode(F.array(right, left)).alias("s")).select(*PHRASE, *TEXT, "once", "trigger", "s.*").filter("key is not null")
    met = stored(_met(sides, ["side", "key"], F.bool_or("once").alias("open")).filter("open").drop("open"))
    found = sides.join(small_side(met, met.count()), ["side", "key"], "left_semi")
    by_text = stored(found.groupBy(*TEXT).agg(F.collect_list(F.struct(*PHRASE, "side", "once", "low", "high", "trigger")).alias("opened")))
    texts = source.select(*TEXT, "text").join(small_side(by_text.select(*TEXT), by_text.count()), TEXT, "left_semi").groupBy(*TEXT).agg(F.first("text").alias("text"))
    opened = stored(
        texts.join(by_text, TEXT).select(*TEXT, "text", "opened").mapInArrow(
            _opened_rows(length), "d1 long, d2 long, side int, once boolean, _h1 long, _h2 long, low int, high int, trigger int, base int, s binary"
        )
    )
    single = shared_strings(opened, length)
    repeated = dictionary.filter("not once").select(*PHRASE)
    known = phrases.join(small_side(repeated, repeated.count()), PHRASE, "left_semi").select(*TEXT, F.col("first").alias("low"), F.col("last").alias("high"))
    starts = single.unionByName(known).join(copies, TEXT, "left_anti").distinct()
    grouped = stored(starts.groupBy(*TEXT).agg(F.collect_list(F.struct("low", "high")).alias("starts")))
    some = source.select(*TEXT, "text").join(small_side(grouped.select(*TEXT), grouped.count()), TEXT, "left_semi")
    cut = some.join(grouped, TEXT).select(*TEXT, "text", "starts").mapInArrow(
        _cut_rows(length), "_h1 long, _h2 long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    )
    partly = stored(cut)
    out = rows.join(partly, TEXT, "left").join(copies.withColumn("copied", F.lit(True)), TEXT, "left")
    copied, zero = F.col("copied").isNotNull(), F.lit(0).cast("long")
    whole_span = F.expr("array(named_struct('start', 0L, 'end', n_bytes))")
    return out.select(
        "doc_id", "n_bytes", F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(copied, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(copied, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        F.when(copied, whole_span).otherwise(F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"))).alias("spans"),
    )
