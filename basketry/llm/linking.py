"""Linking nodes that share a band key, without ever writing all pairs of a bucket, and distributed union-find.

Nodes are 16-byte digests of distinct contents, so copies of any number are one node before anything is joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.tables import discard, stored

#: A bucket of at most this many nodes may write its pairs; a larger one goes on by centers.
SMALL_BUCKET = 16
#: In each further round a larger bucket takes this many times as many centers.
CENTERS_GROW = 4


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots, which are the smallest nodes of their components.

    Alternating large and small stars: each round hangs every node's neighbours under the smallest one, first the larger
    neighbours, then the smaller. The minimum is a partial aggregate joined back, so a hub is never gathered in one row.
    Every round is written to the shared folder. A self-loop or an empty table gives no row.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        earlier, edges = edges, stored(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        discard(earlier, large)
        before, state = state, _state(edges)
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def linked(members: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of all nodes linked by a verified pair that shares a key.

    ``members`` is a written table of (key bigint, node binary), rows may repeat; ``verify`` keeps the pairs (a, b) that
    are similar. Keys of one row alone are dropped by a count that moves no nodes. First all nodes of a bucket meet its smallest node. What then still lies in several components of one
    bucket meets further centers, the smallest node of each of 4, 16, 64 ... hash parts of the bucket, or, in small buckets,
    all nodes of the other components at once. So no pair between different components is left undecided, a bucket of n
    similar nodes costs n pairs, and the rounds grow with the logarithm of the largest bucket.
    """
    repeated = stored(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeated-keys")
    shared = stored(members.join(repeated, "key", "left_semi").distinct(), "shared-keys")
    centers = shared.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("last")).where("center < last").drop("last")
    buckets = stored(shared.join(centers, "key"), "buckets")
    pairs = buckets.where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    edges = stored(verify(pairs), "links")
    used = buckets.where("node <> center").select("key", "node")
    n_centers = 1
    while True:
        roots = components(edges)
        named = used.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        open_keys = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
        left = stored(named.join(open_keys.where("low <> high").drop("low", "high"), "key"), "open-buckets")
        if left.isEmpty():
            return roots
        n_centers *= CENTERS_GROW
        part = F.pmod(F.xxhash64("node", F.lit(n_centers)), F.lit(n_centers)).alias("part")
        large = left.where(F.col("n") > SMALL_BUCKET)
        heads = large.groupBy("key", part).agg(F.min(F.struct("node", "root")).alias("center"))
        heads = stored(heads.select("key", F.col("center.node").alias("b"), F.col("center.root").alias("other_root")), "centers")
        small = left.where(F.col("n") <= SMALL_BUCKET)
        other = small.select("key", F.col("node").alias("b"), F.col("root").alias("other_root"))
        ends = [F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")]
        pairs = large.join(heads, "key").where("root <> other_root").select(*ends).union(
            small.join(other, "key").where("b < node and root <> other_root").select(*ends)
        )
        edges = edges.union(stored(verify(pairs.distinct()), "links"))
        used = large.join(heads.select("key", F.col("b").alias("node")), ["key", "node"], "left_anti").select("key", "node")
