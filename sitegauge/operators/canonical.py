"""Canonical addresses over a whole crawl: where the links of pages to their own address lead in the end.

A page names one address as its own; the page there may name another. Following the links from
page to page would take as many joins as the longest chain has steps. Instead every address points
to where it gets in one step, then two, four and so on: pointers are joined to each other, so a
logarithmic number of joins is enough, and chains that have ended take no part in later ones.
Addresses that do not end after more steps than there are of them run into a cycle; its smallest address
then stands for it.

Only (address, target) rows move, never pages. Many pages may name one address: the joins on targets are salted by counted
keys. Each round's pointers are stored below ``spark.checkpoint.dir``, so the plan of a round does
not hold the rounds before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.functions import url as U
from sitegauge.operators.attribution import with_canonical
from sitegauge.operators.signals import with_head
from sitegauge.plans import skew
from sitegauge.plans.skew import join_one_per_key
from sitegauge.plans.stored import shared_folder, store

_POINTER = ("address", "pointer", "hops", "outside", "done", "low")


def canonical_links(pages: DataFrame) -> DataFrame:
    """(page_id, address, target) of every page: its own address and the one it names, without fragments; null if it names none."""
    named = with_canonical(with_head(pages))
    return named.select("page_id", U.address("url").alias("address"), F.substring_index("canonical", "#", 1).alias("target"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _jump(first: DataFrame, folder: str, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Pointers of all addresses: tables of those that have ended, and the rest, which run into cycles.

    ``first`` holds the first step. Open pointers have made 2 to the power of the round steps each. While chains are left, some
    end in every round; when none does, the open pointers run into cycles, and none of these is longer than their number.
    """
    state = store(first, f"{folder}/{name}0")
    ended, open_ = [state.filter("done")], state.filter("NOT done")
    left, before, steps = open_.count(), 0, 1
    while left and (left != before or steps < left):
        known = _union([*ended, open_]).select(
            F.col("address").alias("pointer"), F.col("pointer").alias("to"), F.col("hops").alias("more"), F.col("outside").alias("out"), F.col("done").alias("end"), F.col("low").alias("least"),
        )
        # no key is hot in a table that one task could take
        near = open_.select("address", "pointer", "hops", "low")
        joined = join_one_per_key(near, known, "pointer", "address") if left > skew.ROWS_PER_TASK else near.join(known, "pointer", "left")
        stepped = joined.select("address", F.col("to").alias("pointer"), (F.col("hops") + F.col("more")).alias("hops"), F.col("out").alias("outside"), F.col("end").alias("done"), F.least("low", "least").alias("low"))
        steps *= 2
        state = store(stepped, f"{folder}/{name}{steps}")
        ended.append(state.filter("done"))
        open_ = state.filter("NOT done")
        left, before = open_.count(), left
    return ended, open_


def canonical_chains(links: DataFrame) -> DataFrame:
    """address, target, final, hops, in_cycle, outside for every address of ``canonical_links``.

    If pages of one address name several others, the smallest counts. ``final`` is where the chain ends: an address that names none or itself,
    or one that was not crawled (``outside``), or the smallest address of the cycle it runs into (``in_cycle``); ``hops`` is the number of
    steps to it. Rows without an address are left out.
    """
    folder = shared_folder(links.sparkSession)
    named = links.filter("address IS NOT NULL").groupBy("address").agg(F.min(F.when(F.col("target") != F.col("address"), F.col("target"))).alias("target"))
    nodes = store(named, f"{folder}/nodes")
    crawled = nodes.select(F.col("address").alias("target"), F.lit(True).alias("crawled"))
    found = join_one_per_key(nodes, crawled, "target", "address")
    stays, leaves = F.col("target").isNull(), F.col("target").isNotNull() & F.col("crawled").isNull()
    first = found.select(
        "address", F.coalesce("target", "address").alias("pointer"), F.when(stays, 0).otherwise(1).cast("long").alias("hops"),
        leaves.alias("outside"), (stays | leaves).alias("done"), F.col("address").alias("low"),
    )
    ended, cyclic = _jump(first, folder, "step")
    out = [e.select("address", F.col("pointer").alias("final"), "hops", F.lit(False).alias("in_cycle"), "outside") for e in ended]
    if not cyclic.isEmpty():
        # the pointer lies on the cycle, and its own steps went all around it
        standing = cyclic.select(F.col("address").alias("pointer"), F.col("low").alias("final"))
        ends = store(join_one_per_key(cyclic.select("address", "pointer"), standing, "pointer", "address").select("address", "final"), f"{folder}/cycles")
        # cut the links of the standing addresses: what is left are chains
        cut = ends.join(nodes, "address").select(
            "address", F.when(F.col("address") == F.col("final"), F.col("address")).otherwise(F.col("target")).alias("pointer"),
            F.when(F.col("address") == F.col("final"), 0).otherwise(1).cast("long").alias("hops"), F.lit(False).alias("outside"), (F.col("address") == F.col("final")).alias("done"), F.col("address").alias("low"),
        )
        chains, _ = _jump(cut, folder, "cut")
        out += [c.select("address", F.col("pointer").alias("final"), "hops", F.lit(True).alias("in_cycle"), "outside") for c in chains]
    return _union(out).join(nodes, "address").select("address", "target", "final", "hops", "in_cycle", "outside")


def page_canonicals(pages: DataFrame) -> DataFrame:
    """page_id, address, final, hops, in_cycle, outside of every page; a page without an address has no final one."""
    links = store(canonical_links(pages), f"{shared_folder(pages.sparkSession)}/links")
    chains = canonical_chains(links).drop("target")
    joined = join_one_per_key(links.select("page_id", "address"), chains, "address", "page_id")
    return joined.select("page_id", "address", "final", "hops", "in_cycle", "outside")


def canonical_clusters(pages: DataFrame) -> DataFrame:
    """One row per final address: pages and addresses that lead to it, the longest chain, whether it stands for a cycle."""
    found = page_canonicals(pages).filter("final IS NOT NULL")
    by_address = found.groupBy("final", "address").agg(F.count("*").alias("n"), F.max("hops").alias("hops"), F.max("in_cycle").alias("in_cycle"))
    return by_address.groupBy("final").agg(
        F.sum("n").alias("n_pages"), F.count("*").alias("n_addresses"), F.max("hops").alias("max_hops"), F.max("in_cycle").alias("in_cycle"),
    )
