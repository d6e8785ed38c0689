"""Extremely randomised trees: every node draws its own cut points.

A node draws features that are not constant in it, and for each one cut point between the least and the greatest value that its visits have;
the draw with the purest halves splits it. Trees see all visits. A level of many trees takes two passes over the visits, which are written
once: one for the ranges of all features in the open nodes, one for the classes on both sides of the drawn cuts. Sums meet in the JVM by (tree, node, ...);
tasks hold tables of a fixed number of cells, and trees are grown a group at a time. There are no bins, shared or not. Only draws and
results per node reach the driver, which holds the trees.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.functions.columns import vector_parts
from basketry.models.softmax_boosting import Trees, _rows, asked, spread
from basketry.operators.labels import class_index, class_values
from basketry.session import materialize, over_all_cores

TREES_AT_ONCE = 64
CELLS = 4_000_000

Nodes = list[tuple[int, int]]


def _parts(batch: pa.RecordBatch, used: np.ndarray, idx: int, val: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a batch with their entries, and dense in the ``used`` features, the only ones that the trees at hand ask for."""
    step = max(32, 4_000_000 // max(len(used), 1))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        positions, row = _rows(part.column(idx))
        values, _ = _rows(part.column(val))
        yield part, spread(used, np.zeros(len(used)), part.num_rows, row, positions, values), positions, row, values


def _slots(trees: Trees, nodes: Nodes) -> np.ndarray:
    slot_of = np.full(trees.feature.shape, -1)
    for slot, (t, node) in enumerate(nodes):
        slot_of[t, node] = slot
    return slot_of


def _extremes(key: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Least, greatest and number per key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    if not len(key):
        return key, low, high, n
    return key[first], np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first), np.add.reduceat(n[order], first)


def _ranges(rows: DataFrame, trees: Trees, nodes: Nodes, size: int) -> DataFrame:
    """slot, feature, low, high of every feature that is not zero throughout a node. Tasks hold what their visits have, not all features."""
    slot_of, used = _slots(trees, nodes), sorted({t for t, _ in nodes})
    split = asked([trees])
    walked = trees.over(split)

    def listed(key: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(key // max(size, 1), pa.int32()), pa.array(key % max(size, 1), pa.int32()), pa.array(low), pa.array(high), pa.array(n)]
        return pa.RecordBatch.from_arrays(columns, ["slot", "feature", "low", "high", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kept, held = np.zeros(len(nodes), np.int64), [], 0
        for batch in batches:
            for _, x, idx, row, val in _parts(batch, split, 1, 2):
                place = walked.places(x)
                for t in used:
                    slot = slot_of[t, place[:, t]]
                    total += np.bincount(slot[slot >= 0], minlength=len(nodes))
                    inside = slot[row] >= 0
                    val_in = val[inside]
                    kept.append(_extremes(slot[row[inside]] * size + idx[inside], val_in, val_in, np.ones(len(val_in), np.int64)))
                    held += len(kept[-1][0])
                    if held > CELLS:
                        kept = [_extremes(*map(np.concatenate, zip(*kept, strict=True)))]
                        held = len(kept[0][0])
                        if held > CELLS // 2:  # mostly unlike keys: these meet in the JVM
                            yield listed(*kept[0])
                            kept, held = [], 0
        if kept:
            yield listed(*_extremes(*map(np.concatenate, zip(*kept, strict=True))))
        # n counts entries; the visits of a node, as feature -1, tell whether one of them has a zero there
        counted = np.flatnonzero(total)
        columns = [pa.array(counted, pa.int32()), pa.array(np.full(len(counted), -1), pa.int32()), *(pa.array(np.zeros(len(counted))) for _ in range(2)), pa.array(total[counted])]
        yield pa.RecordBatch.from_arrays(columns, ["slot", "feature", "low", "high", "n"])

    found = rows.mapInArrow(work, "slot int, feature int, low double, high double, n long")
    found = found.groupBy("slot", "feature").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    whole = F.max(F.when(F.col("feature") < 0, F.col("n"))).over(Window.partitionBy("slot"))
    found = found.withColumn("whole", whole).where(F.col("feature") >= 0)
    zero = F.col("n") < F.col("whole")
    return found.select("slot", "feature", F.when(zero, F.least("low", F.lit(0.0))).otherwise(F.col("low")).alias("low"), F.when(zero, F.greatest("high", F.lit(0.0))).otherwise(F.col("high")).alias("high"))


def _drawn(ranges: DataFrame, nodes: Nodes, draws: int, seed: int, first_tree: int) -> dict[int, list[tuple[int, float]]]:
    """Per slot the features drawn and their cut points, from hashes of seed, tree, node and feature."""
    spark = ranges.sparkSession
    named = spark.createDataFrame([(s, first_tree + t, node) for s, (t, node) in enumerate(nodes)], "slot int, tree int, node int")
    varied = ranges.where("low < high").join(F.broadcast(named), "slot")
    order = Window.partitionBy("slot").orderBy(F.xxhash64(F.lit(seed), "tree", "node", "feature"), "feature")
    chosen = varied.withColumn("place", F.row_number().over(order)).where(F.col("place") <= draws)
    share = F.pmod(F.xxhash64("feature", "node", "tree", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    found: dict[int, list[tuple[int, float]]] = {}
    for r in chosen.select("slot", "feature", (F.col("low") + share * (F.col("high") - F.col("low"))).alias("cut")).collect():
        found.setdefault(r["slot"], []).append((r["feature"], r["cut"]))
    return {s: sorted(c) for s, c in found.items()}


def _sides(rows: DataFrame, trees: Trees, nodes: Nodes, drawn: dict[int, list[tuple[int, float]]], size: int, classes: int, least: int) -> dict[int, tuple]:
    """Per slot the best draw: its number, the visits on both sides and whether each side is pure."""
    slot_of, used = _slots(trees, nodes), sorted({t for t, _ in nodes})
    split = asked([trees])
    walked = trees.over(split)
    width = max(len(c) for c in drawn.values())
    feature, cut = np.full((len(nodes), width), -1), np.full((len(nodes), width), np.inf)
    for s, cuts in drawn.items():
        feature[s, : len(cuts)], cut[s, : len(cuts)] = [f for f, _ in cuts], [c for _, c in cuts]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = np.zeros(len(nodes) * width * classes, np.int64)
        whole = np.zeros(len(nodes) * classes, np.int64)
        keys = []  # per tree: (slot, feature) of its draws in order, and where they are
        for t in used:
            slots = np.array([s for s, (tree, _) in enumerate(nodes) if tree == t])
            s, d = np.nonzero(feature[slots] >= 0)
            key = slots[s] * size + feature[slots[s], d]
            order = np.argsort(key)
            keys.append((key[order], (slots[s] * width + d)[order]))
        zero_left = (cut >= 0).ravel()
        for batch in batches:
            for part, x, idx, row, val in _parts(batch, split, 1, 2):
                y, place = part.column(0).to_numpy(), walked.places(x)
                for t, (key, draw) in zip(used, keys, strict=True):
                    slot = slot_of[t, place[:, t]]
                    mine = slot >= 0
                    whole += np.bincount(slot[mine] * classes + y[mine], minlength=len(whole))
                    if not len(key):
                        continue
                    entry = np.flatnonzero(mine[row])
                    wanted = slot[row[entry]] * size + idx[entry]
                    at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
                    known = key[at] == wanted
                    entry, at = entry[known], draw[at[known]]
                    # zeros are on one side of a cut; only entries on the other side are counted
                    below = val[entry] <= cut.ravel()[at]
                    moved = below != zero_left[at]
                    np.add.at(left, at[moved] * classes + y[row[entry[moved]]], np.where(below[moved], 1, -1))
        left += (np.repeat(whole.reshape(-1, 1, classes), width, axis=1) * zero_left.reshape(len(nodes), width, 1)).ravel()
        right = np.repeat(whole.reshape(-1, 1, classes), width, axis=1).ravel() - left
        found = np.flatnonzero(left + right)
        slot, rest = np.divmod(found, width * classes)
        columns = [pa.array(v, pa.int32()) for v in (slot, *np.divmod(rest, classes))] + [pa.array(left[found]), pa.array(right[found])]
        yield pa.RecordBatch.from_arrays(columns, ["slot", "draw", "class", "l", "r"])

    counts = rows.mapInArrow(work, "slot int, draw int, class int, l long, r long").groupBy("slot", "draw", "class").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    l, r = F.col("l").cast("double"), F.col("r").cast("double")
    halves = counts.groupBy("slot", "draw").agg(
        F.sum("l").alias("nl"), F.sum("r").alias("nr"), F.sum(l * l).alias("ll"), F.sum(r * r).alias("rr"), F.max("l").alias("lm"), F.max("r").alias("rm")
    )
    halves = halves.where((F.col("nl") >= least) & (F.col("nr") >= least))
    purity = F.col("ll") / F.col("nl") + F.col("rr") / F.col("nr")  # least gini where this is greatest
    best = halves.groupBy("slot").agg(F.max_by(F.struct("draw", "nl", "nr", (F.col("lm") == F.col("nl")).alias("lp"), (F.col("rm") == F.col("nr")).alias("rp")), F.struct(purity, -F.col("draw"))).alias("b"))
    return {row["slot"]: (feature[row["slot"], row["b"]["draw"]], cut[row["slot"], row["b"]["draw"]], *row["b"][1:]) for row in best.collect()}


def _leaves(rows: DataFrame, trees: Trees, size: int, classes: int) -> np.ndarray:
    """Class shares per tree and node; zero for inner nodes."""
    count, nodes = trees.feature.shape
    split = asked([trees])
    walked = trees.over(split)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(count * nodes * classes, np.int64)
        for batch in batches:
            for part, x, *_ in _parts(batch, split, 1, 2):
                key = ((np.arange(count) * nodes)[None, :] + walked.places(x)) * classes + part.column(0).to_numpy()[:, None]
                total += np.bincount(key.ravel(), minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found])], ["cell", "n"])

    shares = np.zeros(count * nodes * classes)
    for r in rows.mapInArrow(work, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        shares[r["cell"]] = r["n"]
    shares = shares.reshape(count, nodes, classes)
    return shares / np.maximum(shares.sum(axis=2, keepdims=True), 1)


@dataclass
class RandomTreesModel:
    """Groups of trees, each with the class shares of its leaves."""

    classes: list[int]
    size: int
    groups: list[tuple[Trees, np.ndarray]]

    @property
    def n_trees(self) -> int:
        return sum(len(t.feature) for t, _ in self.groups)

    def walked(self) -> tuple[np.ndarray, list[tuple[Trees, np.ndarray]]]:
        """The features that any tree asks for, and the groups over rows of these."""
        used = asked([t for t, _ in self.groups])
        return used, [(t.over(used), shares) for t, shares in self.groups]

    def votes(self, x: np.ndarray) -> np.ndarray:
        """Sum of the class shares of all trees, for dense rows."""
        return self.votes_of(self.groups, x)

    def votes_of(self, groups: list[tuple[Trees, np.ndarray]], x: np.ndarray) -> np.ndarray:
        total = np.zeros((len(x), len(self.classes)))
        for trees, shares in groups:
            place = trees.places(x)
            for t in range(len(shares)):
                total += shares[t, place[:, t]]
        return total

    def with_probability(self, matrix: DataFrame, out: str = "probability") -> DataFrame:
        model = self

        @F.arrow_udf("array<double>")
        def probability(positions: pa.Array, values: pa.Array) -> pa.Array:
            batch = pa.RecordBatch.from_arrays([positions, values], ["idx", "val"])
            used, groups = model.walked()
            parts = [model.votes_of(groups, x) / model.n_trees for _, x, *_ in _parts(batch, used, 0, 1)]
            p = np.concatenate([np.zeros((0, len(model.classes))), *parts])
            return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))

        positions, values = vector_parts()
        return matrix.withColumn(out, probability(positions, values))

    def importances(self) -> list[float]:
        """Share of each feature in the splits of all trees, weighted by the visits they split."""
        total = np.zeros(self.size)
        for trees, _ in self.groups:
            inner = trees.feature >= 0
            np.add.at(total, trees.feature[inner], trees.gain[inner])
        return (total / total.sum() if total.sum() else total).tolist()

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(g, json.dumps({n: v.tolist() for n, v in vars(t).items()}), json.dumps(s.tolist())) for g, (t, s) in enumerate(self.groups)]
        spark.createDataFrame([(self.size, *r) for r in rows], "size int, part int, trees string, shares string").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, classes: list[int]) -> RandomTreesModel:
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["part"])
        groups = [(Trees(**{n: np.array(v) for n, v in json.loads(r["trees"]).items()}), np.array(json.loads(r["shares"]))) for r in rows]
        return RandomTreesModel(classes, rows[0]["size"], groups)


def fit_random_trees(train: DataFrame, n_trees: int, depth: int, min_rows: int = 3, seed: int = 1, draws: int | None = None) -> RandomTreesModel:
    """``draws`` features are tried per node, the root of their number unless given. Visits without a label are left out."""
    classes = class_values(train)
    if not classes:
        raise ValueError("no labelled visits to learn from")
    positions, values = vector_parts()
    first = train.select(F.unwrap_udt("features").alias("v")).select(F.coalesce(F.col("v.size"), F.size("v.values"))).first()
    size = first[0] if first else 0
    labelled = train.where(F.col("trip_type").isNotNull()).select(class_index("trip_type", classes).alias("y"), positions.alias("idx"), values.alias("val"))
    rows = over_all_cores(materialize(labelled, "random-trees"), lambda df: materialize(df, "random-trees"))
    n = rows.count()
    draws = draws or max(1, isqrt(size))
    groups = []
    for first_tree in range(0, n_trees, TREES_AT_ONCE):
        count = min(TREES_AT_ONCE, n_trees - first_tree)
        trees = Trees.roots(count)
        trees.cut = trees.cut.astype(float)
        frontier: Nodes = [(t, 0) for t in range(count)] if n >= 2 * min_rows and len(classes) > 1 else []
        used = [1] * count
        at_once = max(1, CELLS // max(draws * len(classes), 1))  # entries, not features, fill the ranges
        for _ in range(depth):
            frontier.sort()
            opened: Nodes = []
            for at in range(0, len(frontier), at_once):
                nodes = frontier[at : at + at_once]
                drawn = _drawn(_ranges(rows, trees, nodes, size), nodes, draws, seed, first_tree)
                if not drawn:
                    continue
                found = _sides(rows, trees, nodes, drawn, size, len(classes), min_rows)
                for slot in sorted(found):
                    t, node = nodes[slot]
                    feature, cut, nl, nr, l_pure, r_pure = found[slot]
                    left, right = used[t], used[t] + 1
                    used[t] += 2
                    trees.widened(used[t])
                    trees.feature[t, node], trees.cut[t, node], trees.left[t, node], trees.right[t, node] = feature, cut, left, right
                    trees.gain[t, node] = nl + nr
                    opened += [(t, child) for child, m, pure in ((left, nl, l_pure), (right, nr, r_pure)) if m >= 2 * min_rows and not pure]
            frontier = opened
            if not frontier:
                break
        groups.append((trees, _leaves(rows, trees, size, len(classes))))
    return RandomTreesModel(classes, size, groups)
