"""Sharding (2): balanced label propagation over groups of equal texts, sizes kept near equal.

Documents with equal texts are linked. Every linked document starts in a hash shard. In each round
the copies of a text that lie in one shard look at their neighbours' shards and move to the one
that holds most of them (first of all one with room for the whole group), as far as the quota of that shard (an even share of all bytes) has room;
moves with more neighbours come first. A move larger than the room is not asked for and takes none
of it, so the copies of a hot text do not block others. Rounds go on until no move fits; each move
leaves a text in one shard less, so they end. Copies that outgrow one shard gather in several, each
filled in turn. Documents without links cut no edge wherever they lie, so they even out the sizes: they
fill the shards up to a common level, the long ones first and the short ones last.

Only DataFrame functions are used. Rows move as numbers; no text is shuffled. Null texts count zero
bytes and are linked to each other; empty texts likewise; repeated rows are copies. Null ids are
placed like others. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.llm.common import running_total, stored

GROUP = ["g", "crc", "size"]


def _loads(df: DataFrame, shards: int, weight: str = "size") -> list[int]:
    found = {r["shard"]: int(r["n"]) for r in df.groupBy("shard").agg(F.sum(weight).alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _by_shard(values: list[int], shard: str = "shard") -> Column:
    """The value of each shard, looked up in an array of ``shards`` numbers."""
    return F.get(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col(shard))


def propagate(cells: DataFrame, shards: int, share: int) -> DataFrame:
    """Cells (group, home shard, n copies) with the shard that each ends in, as ``shard``."""
    state = stored(cells.withColumn("shard", F.col("home")))
    while True:
        units = state.groupBy(*GROUP, "shard").agg(F.sum("n").alias("w")).withColumn("bytes", F.col("w") * F.col("size"))
        units = stored(units)
        room = [share - x for x in _loads(units, shards, "bytes")]
        # a shard with room for all the rest of the group, else for the least move, else none; ties spread over the shards
        whole = Window.partitionBy(*GROUP)
        rest, least = F.sum("bytes").over(whole) - F.col("bytes"), F.min("bytes").over(whole)
        units = units.withColumn("fit", F.when(_by_shard(room) >= rest, 2).when(_by_shard(room) >= least, 1).otherwise(0)).withColumn("tie", F.xxhash64("g", "shard"))
        leaders = [F.desc("fit"), F.desc("w"), "tie", "shard"]
        order = whole.orderBy(*leaders)
        before = F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # neighbours that fit one shard together; the first of them leads
        placed = units.withColumn("block", F.floor(before / F.lit(max(1, share))))
        lead = Window.partitionBy(*GROUP, "block").orderBy(*leaders)
        moves = placed.withColumn("to", F.first("shard").over(lead)).withColumn("gain", F.col("w") * F.first("w").over(lead)).filter("to <> shard").filter(F.col("bytes") <= _by_shard(room, "to"))
        asked = running_total(moves, "bytes", [*GROUP, "shard"], "asked", by=["to"], first=F.lit(63) - F.floor(F.log2(F.col("gain"))).cast("int"))
        accepted = stored(asked.filter(F.col("asked") + F.col("bytes") <= _by_shard(room, "to")).select(*GROUP, "shard", "to"))
        if accepted.isEmpty():
            break
        state = stored(state.join(accepted, [*GROUP, "shard"], "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"))
    return state.select(*GROUP, "home", "shard")


def _level(loads: list[int], more: int) -> list[int]:
    """What each shard takes of ``more`` bytes so that all reach a common level where they can."""
    low, high = min(loads), max(loads) + more
    while low < high:
        middle = (low + high) // 2
        if sum(max(0, middle - x) for x in loads) >= more:
            high = middle
        else:
            low = middle + 1
    return [max(0, low - x) for x in loads]


def fill_up(free: DataFrame, loads: list[int], parts: tuple[float, ...] = (0.5, 0.8, 0.95)) -> DataFrame:
    """Gives every free document a shard, in passes over ever smaller sizes."""
    classes = free.groupBy(F.floor(F.log2("size")).cast("int").alias("c")).agg(F.sum("size").alias("n")).orderBy(F.desc("c")).collect()
    total, seen, passes = sum(int(r["n"]) for r in classes), 0, {}
    for r in classes:  # at most 64 size classes
        passes.setdefault(sum(seen >= p * total for p in parts), []).append(r["c"])
        seen += int(r["n"])
    out = None
    for _, some in sorted(passes.items()):
        part = free.filter(F.floor(F.log2("size")).cast("int").isin(some))
        takes = _level(loads, int(part.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]))
        edges, at = [], 0
        for t in takes[:-1]:
            at += t
            edges.append(at)
        ranked = running_total(part, "size", ["crc", "g", "doc_id"], "at")
        middle = F.col("at") + F.col("size") / 2
        shard = sum((F.when(middle >= e, 1).otherwise(0) for e in edges), F.lit(0))
        placed = stored(ranked.withColumn("shard", shard.cast("int")).drop("at"))
        loads = [a + b for a, b in zip(loads, _loads(placed, len(loads)), strict=True)]
        out = placed if out is None else out.unionByName(placed)
    return free.withColumn("shard", F.lit(0)) if out is None else out


def shard(docs: DataFrame, shards: int = 40, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) for every row."""
    raw = F.col(text).cast("binary")
    rows = stored(
        docs.select(
            F.col(id_column).alias("doc_id"), (F.coalesce(F.octet_length(raw), F.lit(0)) + 16).cast("long").alias("size"),
            F.coalesce(F.crc32(raw), F.lit(0)).alias("crc"), F.xxhash64(text).alias("g"),
        ).withColumn("home", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    )
    share = int(rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]) // shards
    counted = rows.groupBy(*GROUP, "home").agg(F.count("*").alias("n"))
    cells = stored(counted.withColumn("copies", F.sum("n").over(Window.partitionBy(*GROUP))).filter("copies > 1").drop("copies"))
    linked = propagate(cells, shards, share)
    placed = stored(rows.join(linked, [*GROUP, "home"], "left"))
    alone, tied = placed.filter("shard is null").drop("shard"), placed.filter("shard is not null")
    loads = _loads(tied, shards)
    if max(loads) > share:  # more linked bytes than an even share: what exceeds it is placed like single documents
        ranked = stored(running_total(tied, "size", ["g", "crc", "doc_id"], "at", by=["shard"]).withColumn("over", F.col("at") + F.col("size") > share).drop("at"))
        alone = alone.unionByName(ranked.filter("over").drop("over", "shard"))
        tied = ranked.filter("not over").drop("over")
        loads = _loads(tied, shards)
    full = stored(tied.unionByName(fill_up(alone, loads)))
    slots = running_total(full.withColumn("one", F.lit(1)), "one", ["doc_id", "g", "crc"], "slot", by=["shard"])
    return slots.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
