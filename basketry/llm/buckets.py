"""Links between contents that share a band key, without a row per pair of a bucket.

1. In every bucket each node meets one center, the node that shares the most keys with others: among edited copies that is
   the text they were made from, so most of a group is settled by as many pairs as it has nodes. A byte sketch of the signature
   leaves out pairs that are clearly unlike; contents are moved and judged exactly for the others alone.
2. Nodes of a bucket that then lie in several components are compared in blocks. First only sketches meet, and nodes without a
   partner that they might join go no further. Contents of the rest of two blocks meet in one task, are judged exactly, and only
   links that join two components are written. A crowded bucket has many blocks, each bounded in nodes and in characters, so no
   bucket is gathered in a task. A pair that shares several keys is compared in the first of them alone.

Nothing is dropped but pairs whose sketches agree in less than ``least``; the callers state how seldom a pair at their threshold is
among them. An empty table gives no links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.linking import components
from basketry.llm.tables import discard, stored

#: A block holds about this many nodes and characters; a single longer content is a block by itself.
BLOCK_NODES = 512
BLOCK_CHARS = 1 << 21
#: Characters of the pairs that are judged at once.
JUDGED_CHARS = 1 << 20

#: From contents to owner, hash and weight of every distinct shingle, by owner and hash.
Features = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]


def pair_similarities(left: pa.Array, right: pa.Array, features: Features) -> np.ndarray:
    """Exact weighted Jaccard of the contents at equal places."""
    n = len(left)
    owner, grams, weight = (np.concatenate(x) for x in zip(features(left), features(right), strict=True))
    order = np.lexsort((grams, owner))
    owner, grams, weight = owner[order], grams[order], weight[order]
    twice = np.flatnonzero((owner[1:] == owner[:-1]) & (grams[1:] == grams[:-1]))
    shared = np.bincount(owner[twice], np.minimum(weight[twice], weight[twice + 1]), n)
    return shared / np.maximum(np.bincount(owner, weight, n) - shared, 1e-12)


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def block_links(rows: dict[str, list], features: Features, similar: float, least: float) -> list[tuple[bytes, bytes]]:
    """Links between the nodes of two blocks of a bucket (or of one with itself) that join different components."""
    n, key = len(rows["node"]), rows["key"][0]
    names = {root: i for i, root in reversed(list(enumerate(rows["root"])))}
    parent = list(range(n))
    for i, root in enumerate(rows["root"]):
        parent[i] = names[root]
    keys = np.array(rows["keys"])
    first = np.argmax(keys == key, axis=1)
    block = np.array(rows["block"])
    one = rows["low"][0] == rows["high"][0]
    sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(n, -1)
    found = []
    owner = None
    for i in range(n - 1):
        roots = np.array([_root(parent, j) for j in range(i, n)])
        open_ = (roots[1:] != roots[0]) if one else (roots[1:] != roots[0]) & (block[i + 1 :] != block[i])
        at = np.flatnonzero(open_) + i + 1
        at = at[(sketch[at] == sketch[i]).mean(axis=1) >= least]
        at = at[~((keys[at, : first[i]] == keys[i, : first[i]]).any(axis=1))]
        if not len(at):
            continue
        if owner is None:
            owner, grams, weight = features(pa.array(rows["content"], pa.string()))
            _, ids = np.unique(grams, return_inverse=True)
            bounds = np.searchsorted(owner, np.arange(n + 1))
            total = np.bincount(owner, weight, n)
            dense = np.zeros(len(ids) + 1)
        mine = slice(bounds[i], bounds[i + 1])
        dense[ids[mine]] = weight[mine]
        at = at[np.minimum(total[at], total[i]) >= (similar - 1e-9) * np.maximum(total[at], total[i])]
        sizes = bounds[at + 1] - bounds[at]
        ends = np.cumsum(sizes)
        if len(at):
            places = np.arange(ends[-1]) + np.repeat(bounds[at] - ends + sizes, sizes)
            shared = np.bincount(np.repeat(np.arange(len(at)), sizes), np.minimum(dense[ids[places]], weight[places]), len(at))
            for j in at[shared >= (similar - 1e-9) * np.maximum(total[at] + total[i] - shared, 1e-12)].tolist():
                a, b = _root(parent, i), _root(parent, j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    found.append((rows["node"][i], rows["node"][j]))
        dense[ids[mine]] = 0
    return found


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def with_partners(part: pa.RecordBatch, least: float) -> np.ndarray:
    """Which rows of whole groups (same key, low and high) have a row of another component there whose sketch might be of a similar content."""
    n = part.num_rows
    key, block, low, high = (part.column(c).to_numpy() for c in ("key", "block", "low", "high"))
    root = part.column("root").dictionary_encode().indices.to_numpy()
    sketch = _sketches(part.column("sketch"))
    new = np.append(True, (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))[:n]
    end = np.append(np.flatnonzero(new)[1:], n)[np.cumsum(new) - 1]
    found, at = np.zeros(n, bool), np.arange(n)
    for shift in range(1, n):
        at = at[at + shift < end[at]]
        if not len(at):
            break
        other = at + shift
        open_ = (root[at] != root[other]) & ((low[at] == high[at]) | (block[at] != block[other])) & ~(found[at] & found[other])
        left, right = at[open_], other[open_]
        alike = (sketch[left] == sketch[right]).mean(axis=1) >= least
        found[left[alike]] = found[right[alike]] = True
    return found


def linked_contents(signatures: DataFrame, contents: DataFrame, features: Features, similar: float, least: float) -> DataFrame:
    """(node, root) of all nodes linked to another, but the roots.

    ``signatures`` is a table (node binary, keys array of bigint, sketch binary) that ``stored`` wrote; it is deleted once it was
    read. ``contents`` gives (node, content); both may repeat a node. All nodes have the same number of keys and of sketch bytes.

    Contents are joined by sorting whatever their size, so that a large input takes the same steps as a small one.
    """
    members = signatures.select("node", F.explode("keys").alias("key"))
    mark = F.xxhash64("node")
    several = members.groupBy("key").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).where("low <> high").select("key")
    several = stored(several, "shared-keys")
    shared = stored(members.join(several, "key", "left_semi").distinct(), "members")
    discard(several)
    sized = shared.join(shared.groupBy("key").agg(F.count("*").alias("n")), "key")
    degrees = stored(sized.groupBy("node").agg(F.sum(F.col("n") - 1).alias("degree")), "degrees")
    signed = signatures.join(degrees, "node", "left_semi").groupBy("node").agg(F.first(F.struct("keys", "sketch")).alias("s"))
    signed = stored(signed.select("node", "s.keys", "s.sketch"), "signed")
    discard(signatures)
    placed = shared.join(degrees, "node")
    centers = placed.groupBy("key").agg(F.max(F.struct("degree", "node")).alias("center")).select("key", F.col("center.node").alias("center"))
    others = stored(shared.join(centers, "key").where("node <> center"), "others")
    discard(shared)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = pa.array((_sketches(batch.column(2)) == _sketches(batch.column(3))).mean(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([c.filter(same) for c in batch.columns[:2]], ["a", "b"])

    pairs = others.select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    left, right = (signed.select(F.col("node").alias(c), F.col("sketch").alias(s)) for c, s in (("a", "x"), ("b", "y")))
    pairs = stored(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(alike, "a binary, b binary"), "pairs")
    others = others.drop("center")

    needed = contents.join(degrees.hint("merge"), "node", "left_semi").groupBy("node").agg(F.first("content").alias("content"))
    needed = stored(needed.withColumn("chars", F.length("content")), "contents")
    discard(degrees)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars = np.cumsum([len(x.as_py()) + len(y.as_py()) for x, y in zip(batch.column(2), batch.column(3), strict=True)])
            cuts = np.flatnonzero(np.diff(chars // JUDGED_CHARS)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                part = batch.slice(lo, hi - lo)
                same = pa.array(pair_similarities(part.column(2), part.column(3), features) >= similar - 1e-9)
                yield pa.RecordBatch.from_arrays([c.filter(same) for c in part.columns[:2]], ["a", "b"])

    left = needed.select(F.col("node").alias("a"), F.col("content").alias("x")).hint("merge")
    right = needed.select(F.col("node").alias("b"), F.col("content").alias("y")).hint("merge")
    links = stored(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(judge, "a binary, b binary"), "links")
    discard(pairs)

    roots = components(links)
    named = others.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    named = named.join(needed.select("node", "chars"), "node")
    sizes = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.sum("chars").alias("chars"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("chars") / BLOCK_CHARS)).cast("int")
    still = stored(named.drop("chars").join(sizes.where("low <> high").select("key", blocks.alias("blocks")), "key"), "open-buckets")
    discard(others, links)
    if still.isEmpty():
        discard(signed, needed, still)
        return roots
    rows = still.join(signed.select("node", "sketch"), "node")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("node", "root", "key", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "sketch")
    place = ["key", "low", "high"]

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # of a group that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            here = batch if rest is None else pa.concat_batches([rest, batch])
            last = [here.column(c).to_numpy() for c in place]
            cut = int(np.flatnonzero(np.any([c != c[-1] for c in last], axis=0)).max(initial=-1)) + 1
            part, rest = here.slice(0, cut), here.slice(cut)
            if cut:
                yield part.drop_columns(["sketch"]).filter(pa.array(with_partners(part, least)))
        if rest is not None:
            yield rest.drop_columns(["sketch"]).filter(pa.array(with_partners(rest, least)))

    sorted_rows = rows.repartition(*place).sortWithinPartitions(*place)
    met = stored(sorted_rows.mapInArrow(partners, "node binary, root binary, key bigint, block int, low int, high int"), "partners")
    discard(still)
    rows = met.join(signed, "node").join(needed.select("node", "content").hint("merge"), "node")
    columns = ["node", "root", "key", "block", "low", "high", "keys", "sketch", "content"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[str, list] = {}
        here = None

        def links_of(rows_: dict[str, list]) -> pa.RecordBatch:
            found = block_links(rows_, features, similar, least) if len(set(rows_["root"])) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                place = (row[2], row[4], row[5])
                if place != here:
                    if here is not None:
                        yield links_of(group)
                    here, group = place, {c: [] for c in columns}
                for c, value in zip(columns, row, strict=True):
                    group[c].append(value)
        if here is not None:
            yield links_of(group)

    rows = rows.select(*columns).repartition(*place).sortWithinPartitions(*place)
    more = stored(rows.mapInArrow(meet, "a binary, b binary"), "more-links")
    discard(signed, needed, met)
    final = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    discard(more)
    return final
