"""Approximate nearest neighbours (9): probed lists, scanned by dimension with early abandoning.

An index of lists (k-means centres, fitted on a bounded sample) takes every vector. A query looks at
the lists whose centres are nearest. There the vectors are rotated at random and read in blocks of
columns: after each block a candidate whose partial distance, scaled to all dimensions, exceeds
(1 + epsilon / sqrt(d)) times the current k-th distance is given up. What survives is ranked by the
exact distance of the original vectors in double precision.

Lists are cut into blocks of at most twice the mean list and of ``most_rows`` rows, and their queries
likewise, so a crowded list is many tasks and no group grows with the table. Vectors that are null or zero, hold null or non-finite components, have no id,
or have another length than most take no part. Repeated rows are candidates each; repeated query
rows are searched once. A query for which the probed lists hold fewer than k candidates is searched
in all lists. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.llm.common import stored

KEYS = ["list", "block", "part"]


def usable(vectors: DataFrame, id_column: str, embedding: str) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    sound = rows.filter(F.expr("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"))
    sound = stored(sound)
    sizes = sound.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return sound if sizes is None else sound.filter(F.size("v") == sizes["d"])


def centres(sample: np.ndarray, count: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means centres of a sample."""
    rng = np.random.default_rng(seed)
    found = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(rounds):
        near = nearest_lists(sample, found, 1)[:, 0]
        sums = np.zeros_like(found)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(found))
        found = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], found)
    return found


def nearest_lists(x: np.ndarray, to: np.ndarray, count: int) -> np.ndarray:
    """Numbers of the ``count`` nearest centres of each row, nearest first."""
    d = (to * to).sum(1)[None, :] - 2 * x @ to.T
    if count == 1:
        return d.argmin(1)[:, None]
    return np.argsort(d, axis=1, kind="stable")[:, :count]


def scan(q: np.ndarray, x: np.ndarray, turned_q: np.ndarray, turned: np.ndarray, ids: np.ndarray, k: int, step: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, distances) of the k nearest rows of x found, by distance, then id."""
    head = min(len(x), max(4 * k, 32))
    best = np.sort(((turned[:head] - turned_q) ** 2).sum(1))
    limit = best[k - 1] if head >= k else math.inf
    alive, partial, dims = np.arange(head, len(x)), np.zeros(len(x) - head), turned.shape[1]
    for low in range(0, dims, step):
        if not len(alive):
            break
        high = min(low + step, dims)
        partial = partial + ((turned[alive, low:high] - turned_q[low:high]) ** 2).sum(1)
        if high < dims:
            keep = partial * (dims / high) <= (1 + epsilon / math.sqrt(high)) ** 2 * limit
            alive, partial = alive[keep], partial[keep]
    rows = np.concatenate((np.arange(head), alive))
    exact = np.sqrt(((x[rows] - q) ** 2).sum(1))
    order = np.lexsort((ids[rows], exact))[:k]
    return rows[order], exact[order]


def search(vectors: DataFrame, k: int = 10, every: int = 100, probe_share: float = 0.65, least_probes: int = 8, sample_rows: int = 20_000,
           most_lists: int = 1024, step: int = 16, epsilon: float = 2.1, most_rows: int = 16_384,
           id_column: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id is divisible by ``every``."""
    data = usable(vectors, id_column, embedding)
    total = data.count()
    sample = data.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(total, 1))) < sample_rows).limit(sample_rows + sample_rows // 4).toPandas() if total else None
    points = np.stack(sample["v"].to_numpy()) if total else np.zeros((1, 1))
    wanted = int(min(most_lists, max(1, math.sqrt(total))))
    middle = centres(points, wanted)
    lists, dims = middle.shape
    rotation = np.linalg.qr(np.random.default_rng(11).standard_normal((dims, dims)))[0]
    kind = dict(data.dtypes)["vec_id"]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = 0
        for b in batches:
            if len(b):
                near = nearest_lists(np.stack(b["v"].to_numpy()), middle, 1)[:, 0]
                yield b.assign(list=near.astype("int32"), row=np.arange(row, row + len(b), dtype="int64"))
                row += len(b)

    placed = stored(data.mapInPandas(place, f"vec_id {kind}, v array<double>, list int, row long"))
    filled = {r["list"]: (r["n"], r["q"]) for r in placed.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.when(F.col("vec_id") % every == 0, 1).otherwise(0)).alias("q")).collect()}
    block = min(most_rows, max(64, math.ceil(2 * total / lists)))
    held = np.array([filled.get(i, (0, 0))[0] for i in range(lists)])
    blocks = np.maximum(1, -(-held // block))
    queries = placed.filter(F.col("vec_id") % every == 0).select("vec_id", "v").distinct().withColumn("of", F.xxhash64("v"))

    def run(asked: DataFrame, probes: int) -> DataFrame:
        # each part of a list's queries is of about a block's size as well
        parts = max(1, math.ceil(sum(q for _, q in filled.values()) * probes / lists / block))

        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            row = 0
            for b in batches:
                for low in range(0, len(b), 500):
                    some = b.iloc[low : low + 500]
                    near = nearest_lists(np.stack(some["v"].to_numpy()), middle, probes)
                    at, to = np.repeat(np.arange(len(some)), near.shape[1]), near.ravel()
                    times = blocks[to]
                    at, to = np.repeat(at, times), np.repeat(to, times)
                    number = np.arange(len(to)) - np.repeat(np.cumsum(times) - times, times)
                    out = some.iloc[at].reset_index(drop=True)
                    yield out.assign(list=to.astype("int32"), block=number.astype("int32"), part=((row + low + at) % parts).astype("int32"))
                row += len(b)

        sides = placed.withColumn("block", F.pmod(F.col("row"), F.get(F.array(*[F.lit(int(n)) for n in blocks]), F.col("list"))).cast("int"))
        sides = sides.select("list", "block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "vec_id", "v")
        sought = asked.mapInPandas(probe, f"vec_id {kind}, v array<double>, of long, list int, block int, part int")

        def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out, ids = [], left["vec_id"].to_numpy(dtype="int64")
            if len(left) and len(right):
                x = np.stack(left["v"].to_numpy())
                turned = x @ rotation
                for own, v, of in zip(right["vec_id"], right["v"], right["of"], strict=True):
                    q, other = np.asarray(v), ids != own
                    some = (x, turned, ids) if other.all() else (x[other], turned[other], ids[other])
                    if len(some[0]):
                        rows, far = scan(q, some[0], q @ rotation, some[1], some[2], k, step, epsilon)
                        out.append(pd.DataFrame({"query_id": own, "of": of, "vec_id": some[2][rows], "score": far}))
            return pd.concat(out) if out else pd.DataFrame({"query_id": ids[:0], "of": ids[:0], "vec_id": ids[:0], "score": np.zeros(0)})

        met = sides.groupBy(*KEYS).cogroup(sought.groupBy(*KEYS)).applyInPandas(look, f"query_id {kind}, of long, vec_id {kind}, score double")
        order = Window.partitionBy("query_id", "of").orderBy("score", "vec_id")
        return stored(met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))

    found = run(queries, min(lists, max(least_probes, math.ceil(probe_share * lists))))
    counts = found.groupBy(F.col("query_id").alias("vec_id"), "of").count()
    short = queries.join(counts, ["vec_id", "of"], "left").filter(F.coalesce("count", F.lit(0)) < min(k, total - 1))
    again = stored(short.select("vec_id", "v", "of"))
    if not again.isEmpty():
        names = again.select(F.col("vec_id").alias("query_id"), "of")
        found = found.join(names, ["query_id", "of"], "left_anti").unionByName(run(again, lists))
    return found.select("query_id", "rank", "vec_id", "score")
