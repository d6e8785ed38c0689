"""Exact k-nearest-neighbour join over sparse rows, pruned by the triangle inequality.

A bounded number of training rows are pivots. Every training row belongs to the cell of its nearest pivot; a cell is known by its size and by the least and
greatest distance of its rows from the pivot. A query first visits its home cells, the nearest ones that hold k rows together.
Its k-th neighbour there bounds the search: a further cell is visited only if the triangle inequality lets it hold something nearer. What the
two visits keep, at most k rows per query and block, is merged to the k best.

Crowded cells are split: training rows into blocks, and the queries that visit a cell into blocks too, so a task holds two blocks
whatever the size of the tables and wherever the rows lie, and pairs of rows are never written. Rows travel as positions and
values; a task works through the columns that its two blocks use a slice at a time, so its memory does not grow with the number of features.

``approximate_neighbours`` is the cheaper, inexact search by random projections.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.session import materialize

BLOCK_ROWS = 4096
QUERY_BLOCKS = 8  # a block of queries is this many times larger: a task takes 256 of them at a time, and training rows are sent once per block of queries
ROUND_VISITS = 20_000_000  # rows of queries that are sent to blocks of training rows at once; more than these take turns, the nearest cells first
PIVOTS = 256
CELL_ROWS = 256  # training rows per pivot, while there are fewer than PIVOTS
COLUMNS = 2048  # columns a task makes dense at once
CELLS = 8_000_000  # and cells (training row, column) of them
RARE = 32  # a column that fewer than one training row in so many has is not made dense
NEIGHBOURS = "query_id bigint, distance2 double, neighbour_id bigint, label int"


def sparse_parts(vec: str = "vec") -> tuple[Column, Column]:
    """Positions and values of the entries of an array that are not zero."""
    cells = F.filter(F.transform(vec, lambda v, i: F.struct(i.cast("int").alias("i"), v.cast("double").alias("v"))), lambda e: e["v"] != 0)
    return F.transform(cells, lambda e: e["i"]), F.transform(cells, lambda e: e["v"])


def as_sparse(rows: DataFrame, *also: str) -> DataFrame:
    """id, idx, val and further columns of rows that have a ``vec`` or are sparse already."""
    idx, val = (F.col("idx"), F.col("val")) if "idx" in rows.columns else sparse_parts()
    return rows.select("id", *also, idx.alias("idx"), val.alias("val"))


class Rows:
    """Sparse rows of one block: all entries behind one another."""

    def __init__(self, idx, val):
        lengths = np.array([len(i) for i in idx], np.int64)
        self.n, self.first = len(lengths), np.concatenate(([0], np.cumsum(lengths)))
        self.row = np.repeat(np.arange(self.n), lengths)
        self.idx = np.concatenate([np.zeros(0, np.int64), *(np.asarray(i, np.int64) for i in idx)])
        self.val = np.concatenate([np.zeros(0), *(np.asarray(v, float) for v in val)])
        self.squares = np.bincount(self.row, self.val**2, self.n)
        self.whole = bool((self.val == np.floor(self.val)).all()) and self.squares.max(initial=0) < 2**48  # sums of products are exact

        self._by_column: ByColumn | None = None

    def by_column(self) -> ByColumn:
        if self._by_column is None:
            self._by_column = ByColumn(self)
        return self._by_column

    def dense(self, columns: np.ndarray) -> np.ndarray:
        """The rows over some columns, given in ascending order."""
        at = np.searchsorted(columns, self.idx)
        known = at < len(columns)
        known[known] = columns[at[known]] == self.idx[known]
        out = np.zeros((self.n, len(columns)))
        out[self.row[known], at[known]] = self.val[known]
        return out


class ByColumn:
    """Rows ready for products with many others: dense in the columns that many of them have, by column in the others."""

    def __init__(self, rows: Rows):
        columns, counts = np.unique(rows.idx, return_counts=True)
        often = counts * RARE >= rows.n
        common = columns[often]
        entry = np.flatnonzero(~often[np.searchsorted(columns, rows.idx)])
        entry = entry[np.argsort(rows.idx[entry], kind="stable")]
        self.rare, self.row, self.val = columns[~often], rows.row[entry], rows.val[entry]
        self.first = np.concatenate((np.searchsorted(rows.idx[entry], self.rare), [len(entry)]))
        step = max(1, min(COLUMNS, CELLS // max(rows.n, 1)))
        self.slices = [common[at : at + step] for at in range(0, len(common), step)]
        self.dense = rows.dense(common) if len(self.slices) == 1 else None


def products(a: Rows, b: Rows) -> np.ndarray:
    """All inner products of the rows of two blocks."""
    out, known = np.zeros((a.n, b.n)), b.by_column()
    for some in known.slices:
        out += a.dense(some) @ (b.dense(some) if known.dense is None else known.dense).T
    if len(known.rare):
        at = np.minimum(np.searchsorted(known.rare, a.idx), len(known.rare) - 1)
        mine = np.flatnonzero(known.rare[at] == a.idx)
        first, size = known.first[at[mine]], np.diff(known.first)[at[mine]]
        pair = np.repeat(mine, size)
        entry = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        np.add.at(out.reshape(-1), a.row[pair] * b.n + known.row[entry], a.val[pair] * known.val[entry])
    return out


def exact_distances(a: Rows, b: Rows, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Squared distances of listed pairs, summed in the order of the positions: the same for the same two rows in any block."""
    found = np.empty(len(rows))
    size = np.diff(a.first)[rows] + np.diff(b.first)[cols]
    edges = np.concatenate(([0], np.cumsum(size)))
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + 2_000_000, "right")) - 1)
        parts = []
        for block, which, sign in ((a, rows[at:to], 1.0), (b, cols[at:to], -1.0)):
            lengths = np.diff(block.first)[which]
            pair = np.repeat(np.arange(len(which)), lengths)
            entry = np.arange(len(pair)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(block.first[which], lengths)
            parts.append((pair, block.idx[entry], sign * block.val[entry]))
        pair, idx, val = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((idx, pair))
        pair, idx, val = pair[order], idx[order], val[order]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (idx[1:] != idx[:-1])
        first = np.flatnonzero(new)
        gap = np.add.reduceat(val, first) if len(first) else np.zeros(0)
        found[at:to] = np.bincount(pair[first], gap**2, to - at)
        at = to
    return found


def _best(queries: pd.DataFrame, train: pd.DataFrame, k: int) -> pd.DataFrame:
    """The work of one task: two blocks of rows in, at most k neighbours per query out.

    Queries that know k neighbours already say how far the last of them is (``reach2``, and ``reach_id`` among equally near ones); only nearer ones count.
    """
    if queries.empty or train.empty:
        return pd.DataFrame({"query_id": [], "distance2": [], "neighbour_id": [], "label": []})
    train = train.sort_values("id", ignore_index=True)
    known, ids = Rows(train["idx"], train["val"]), train["id"].to_numpy()
    kept, result, bounded = min(k, known.n), [], "reach2" in queries.columns
    for at in range(0, len(queries), 256):
        some = Rows(queries["idx"].iloc[at : at + 256], queries["val"].iloc[at : at + 256])
        # A matrix product gives all distances up to rounding. Whatever the rounding could have put among the first k is measured again exactly.
        rough = products(some, known)
        rough *= -2.0
        rough += known.squares[None, :]
        rough += some.squares[:, None]
        whole = some.whole and known.whole
        rounding = 0.0 if whole else 1e-13 * (64 + max(np.diff(some.first).max(), np.diff(known.first).max())) * (some.squares + known.squares.max())
        if bounded:
            reach2, reach_id = (queries[c].iloc[at : at + 256].to_numpy() for c in ("reach2", "reach_id"))
            limit = reach2 + 2 * rounding
        else:
            limit = np.partition(rough, kept - 1, axis=1)[:, kept - 1] + 2 * rounding
        rows, cols = np.nonzero(rough <= limit[:, None])
        distance = rough[rows, cols] if whole else exact_distances(some, known, rows, cols)
        if bounded:
            nearer = (distance < reach2[rows]) | ((distance == reach2[rows]) & (ids[cols] < reach_id[rows]))
            rows, cols, distance = rows[nearer], cols[nearer], distance[nearer]
        order = np.lexsort((cols, distance, rows))  # columns are in id order
        rows, cols, distance = rows[order], cols[order], distance[order]
        best = np.arange(len(rows)) - np.searchsorted(rows, np.arange(some.n))[rows] < kept
        result.append((rows[best] + at, cols[best], distance[best]))
    rows, cols, distance = (np.concatenate(part) for part in zip(*result, strict=True))
    return pd.DataFrame({"query_id": queries["id"].to_numpy()[rows], "distance2": distance, "neighbour_id": ids[cols], "label": train["label"].to_numpy()[cols]})


@dataclass
class NeighbourJoin:
    """``neighbours``: query_id, distance2, neighbour_id, label, place. ``report``: rows, cells and visits of the search."""

    neighbours: DataFrame
    report: dict[str, int]


def _pivot_distances(pivots: Rows, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distances to all pivots, and by how much each may be off."""
    mine = Rows(rows["idx"], rows["val"])
    scale = mine.squares[:, None] + pivots.squares[None, :]
    return np.sqrt(np.maximum(scale - 2 * products(mine, pivots), 0)), 1e-6 * np.sqrt(scale)


def _place(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance2", "neighbour_id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def neighbour_join(train: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS, cell_rows: int = CELL_ROWS) -> NeighbourJoin:
    """The k nearest training rows of each query row, ties by id, and how much was visited for them.

    ``train``: id, label and ``vec`` (array of double) or ``idx`` and ``val``; ``queries``: id and the same. Ids are unique within each table.
    """
    train, queries = as_sparse(train, "label"), as_sparse(queries)
    n = train.count()
    if not n:
        return NeighbourJoin(queries.sparkSession.createDataFrame([], NEIGHBOURS + ", place int"), {})
    wanted = min(pivots, ceil(n / cell_rows))
    chosen = train.select("idx", "val", "id").orderBy(F.xxhash64("id"), "id").limit(wanted).collect()  # at most ``pivots`` rows
    pivot_idx, pivot_val = [list(r["idx"]) for r in chosen], [list(r["val"]) for r in chosen]

    def located(batches):
        centers = Rows(pivot_idx, pivot_val)
        for rows in batches:
            for at in range(0, len(rows), 4096):
                some = rows.iloc[at : at + 4096]
                distance, slack = _pivot_distances(centers, some)
                cell, every = distance.argmin(axis=1), np.arange(len(some))
                low, high = (distance[every, cell] + s * slack[every, cell] for s in (-1, 1))
                yield some.assign(cell=cell.astype(np.int32), low=low, high=high)

    cells = materialize(train.mapInPandas(located, "id bigint, label int, idx array<int>, val array<double>, cell int, low double, high double"), "neighbour-cells")
    stats = {r["cell"]: r for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    used = np.array(sorted(stats))
    size, nearest, farthest = (np.array([stats[c][f] for c in used.tolist()], float) for f in ("n", "low", "high"))

    def routed(batches):
        centers = Rows(pivot_idx, pivot_val)
        for rows in batches:
            for at in range(0, len(rows), 4096):
                some = rows.iloc[at : at + 4096]
                distance, slack = _pivot_distances(centers, some)
                distance, slack = distance[:, used], slack[:, used]
                order = np.argsort(distance, axis=1, kind="stable")
                enough = np.cumsum(size[order], axis=1) - size[order] < k  # cells before this one hold fewer than k rows
                home = [used[o[e]].tolist() for o, e in zip(order, enough, strict=True)]
                bound = np.maximum(np.maximum(distance - slack - farthest, nearest - distance - slack), 0)
                more = [[(int(c), float(b)) for c, b in zip(used[o[~e]], bs[o[~e]], strict=True)] for o, e, bs in zip(order, enough, bound, strict=True)]
                yield some.assign(home=home, more=more)

    schema = "id bigint, idx array<int>, val array<double>, home array<int>, more array<struct<cell:int,bound:double>>"
    routes = materialize(queries.mapInPandas(routed, schema), "neighbour-routes")
    blocks_of = {int(c): ceil(s / block_rows) for c, s in zip(used, size, strict=True)}

    def count_of(counts: dict[int, int]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for item in counts.items() for x in item]), F.col("cell"))

    def visit(visits: DataFrame) -> tuple[DataFrame | None, int]:
        """Queries in the cells listed for them: the best k of every pair of blocks, and the number of pairs of query and cell."""
        asked = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        if not asked:
            return None, 0
        query_blocks = {c: ceil(m / (QUERY_BLOCKS * block_rows)) for c, m in asked.items()}
        train_blocks = {c: blocks_of[c] for c in asked}

        def block(counts: dict[int, int]) -> Column:
            return F.pmod(F.xxhash64("id"), count_of(counts)).cast("int")

        def every(counts: dict[int, int]) -> Column:
            return F.explode(F.sequence(F.lit(0), count_of(counts).cast("int") - 1))

        left = visits.withColumn("qb", block(query_blocks)).withColumn("tb", every(train_blocks))
        right = cells.where(F.col("cell").isin(list(asked))).withColumn("tb", block(train_blocks)).withColumn("qb", every(query_blocks))

        def work(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
            return _best(mine, theirs, k)

        keys = ["cell", "qb", "tb"]
        found = left.groupBy(*keys).cogroup(right.select("id", "label", "idx", "val", *keys).groupBy(*keys))
        return found.applyInPandas(work, NEIGHBOURS), sum(asked.values())

    first, home_visits = visit(routes.select("id", "idx", "val", F.explode("home").alias("cell")))
    n_queries = routes.count()
    report = {"train_rows": n, "cells": len(used), "home_visits": home_visits, "more_visits": 0, "all_visits": n_queries * len(used), "rounds": 0}
    if first is None:  # no queries
        return NeighbourJoin(queries.sparkSession.createDataFrame([], NEIGHBOURS + ", place int"), report | {"all_visits": 0})
    best = materialize(_place(first, k).drop("place"), "neighbours-home", free_shuffles=True)
    # the further cells of a query, nearest first, so many at a time that few enough rows are sent; each time the neighbours known so far close some more
    at_once = max(1, ROUND_VISITS // max(1, round(n_queries * sum(blocks_of.values()) / len(used))))
    for start in range(1, len(used), at_once):
        last = F.max(F.struct("distance2", "neighbour_id"))
        reached = best.groupBy(F.col("query_id").alias("id")).agg(last.alias("last")).select("id", F.col("last.distance2").alias("reach2"), F.col("last.neighbour_id").alias("reach_id"))
        these = F.slice("more", start, at_once)
        open_cells = F.filter(these, lambda e: e["bound"] * e["bound"] <= F.col("reach2") * (1 + 1e-9))
        further = routes.join(reached, "id").select("id", "idx", "val", "reach2", "reach_id", F.explode(open_cells).alias("e"))
        found, visits = visit(further.select("id", "idx", "val", "reach2", "reach_id", F.col("e.cell").alias("cell")))
        report["rounds"] += 1
        report["more_visits"] += visits
        if found is not None:
            best = materialize(_place(best.unionByName(found), k).drop("place"), "neighbours", free_shuffles=True)
    return NeighbourJoin(_place(best, k), report)


def nearest_neighbours(train: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest training rows of each query row, ties by id; see ``neighbour_join``.

    Training rows that are one block anyway have no cells to leave out: every block of queries meets them directly.
    """
    if train.count() > block_rows:
        return neighbour_join(train, queries, k, block_rows).neighbours
    blocks = max(1, ceil(queries.count() / block_rows))
    mine = as_sparse(queries).withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    known = as_sparse(train, "label").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def work(some: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        return _best(some, theirs, k)

    return _place(mine.groupBy("qb").cogroup(known.groupBy("qb")).applyInPandas(work, NEIGHBOURS), k)


def approximate_neighbours(train: DataFrame, queries: DataFrame, k: int, width: float, tables: int = 8, projections: int = 4, seed: int = 1) -> DataFrame:
    """k near rows of each query among those that share a bucket of random projections; distances are exact, some neighbours may be missing.

    ``width`` is the bucket width in the units of the distance: larger finds more and costs more. The projections are drawn from
    hashes of the positions, so they need no number of features and are the same in every task. Buckets of many rows are split by
    a hash of the training id; every part meets the bucket's queries. ``recall`` measures the result.
    """

    def keyed(batches):
        for rows in batches:
            mine = Rows(rows["idx"], rows["val"])
            positions, at = np.unique(mine.idx, return_inverse=True)
            total = np.zeros((mine.n, tables * projections))
            for j, random in enumerate(np.random.default_rng([seed, s]) for s in range(tables * projections)):
                shift, salt = random.random(), int(random.integers(1 << 62))
                draws = np.array([np.random.default_rng([salt, int(p)]).normal() for p in positions])
                total[:, j] = np.floor(np.bincount(mine.row, draws[at] * mine.val, mine.n) / width + shift)
            keys = total.astype(np.int64).reshape(mine.n, tables, projections)
            yield rows.assign(buckets=[[f"{t}:" + ",".join(map(str, key)) for t, key in enumerate(row)] for row in keys.tolist()])

    train, queries = as_sparse(train, "label"), as_sparse(queries)
    left = queries.mapInPandas(keyed, "id bigint, idx array<int>, val array<double>, buckets array<string>")
    right = train.mapInPandas(keyed, "id bigint, label int, idx array<int>, val array<double>, buckets array<string>")
    right = materialize(right.withColumn("bucket", F.explode("buckets")).drop("buckets"), "neighbour-buckets")
    left = materialize(left.withColumn("bucket", F.explode("buckets")).drop("buckets"), "neighbour-lookups")
    sizes = right.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("tbs"))
    asked = left.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("qbs"))
    plan = sizes.join(asked, "bucket")

    def block(n: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def work(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        return _best(mine, theirs, k)

    keys = ["bucket", "qb", "tb"]
    l_rows = left.join(plan, "bucket").withColumn("qb", block("qbs")).withColumn("tb", every("tbs")).select("id", "idx", "val", *keys)
    r_rows = right.join(plan, "bucket").withColumn("tb", block("tbs")).withColumn("qb", every("qbs")).select("id", "label", "idx", "val", *keys)
    found = l_rows.groupBy(*keys).cogroup(r_rows.groupBy(*keys)).applyInPandas(work, NEIGHBOURS)
    return _place(found.dropDuplicates(["query_id", "neighbour_id"]), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours that were found."""
    pairs = exact.select("query_id", "neighbour_id")
    total, hits = pairs.count(), pairs.join(found.select("query_id", "neighbour_id"), ["query_id", "neighbour_id"]).count()
    return hits / total if total else 1.0


def neighbour_votes(neighbours: DataFrame) -> DataFrame:
    """Share of each label among a query's neighbours; labels without a vote have no row."""
    votes = neighbours.groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("query_id"))
    return votes.select("query_id", "label", (F.col("n") / total).alias("p"))
