"""Trees with shared cut points, grown level by level over sparse rows and handed over as Spark ML models.

Spark's own learner keeps one bin per visit and feature, also of features that a visit lacks: with a vocabulary that grows with the tables its
work and its disk grow with their product. Here a row keeps the entries of the splitting features (``Cuts.splitting``) alone. A level of all trees is one pass:
tasks count classes per (tree, node, drawn feature, bin), the counts meet by (tree, node), and zeros are what a node has beyond its entries.
The driver holds trees only. They are written in the form in which Spark ML saves a forest, and loaded as such.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.models.softmax_boosting import Cuts, Trees, _rows, asked, spread
from basketry.session import fresh_path

CELLS = 4_000_000  # counts a task holds at once; more nodes than fit take another pass
TREES_AT_ONCE = 64
BINNED = "y int, w double, idx array<int>, bin array<int>"
NODE = (
    "id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,leftChild:int,rightChild:int,"
    "split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>"
)
COUNTS = "slot int, part int, cell array<int>, n array<double>, w array<double>, whole_n array<double>, whole_w array<double>"


@dataclass
class Grown:
    """Trees over the splitting features, with rows and weight per class in every node."""

    trees: Trees
    n: list[dict[int, float]] = field(default_factory=list)
    stats: list[dict[int, np.ndarray]] = field(default_factory=list)


def class_counts(rows: DataFrame, classes: int) -> tuple[int, np.ndarray]:
    """Rows, and their weight per class. A missing label is refused."""
    found = {r["y"]: (r["n"], r["w"]) for r in rows.groupBy("y").agg(F.count("*").alias("n"), F.sum("w").alias("w")).collect()}
    if any(y is None or y < 0 for y in found):
        raise ValueError("labels must not be missing")
    return sum(n for n, _ in found.values()), np.array([found.get(c, (0, 0.0))[1] for c in range(classes)])


def _drawn(features: int, draws: int, seed: int, tree: int, node: int) -> np.ndarray:
    if draws >= features:
        return np.arange(features)
    return np.sort(np.random.default_rng([seed, tree, node]).choice(features, draws, replace=False, shuffle=False))


def _layout(cuts: Cuts, drawn: np.ndarray) -> np.ndarray:
    """First cell of each drawn feature of a node, and behind the last."""
    return np.concatenate(([0], np.cumsum(np.diff(cuts.first_bin)[drawn]))).astype(np.int64)


def _counts(rows: DataFrame, cuts: Cuts, trees: Trees, nodes: list[tuple[int, int]], drawn: list[np.ndarray], classes: int) -> DataFrame:
    """Rows and weight per drawn feature's bin and class of the listed (tree, node) pairs: one row per task and pair, without empty cells."""
    slot_of = np.full(trees.feature.shape, -1)
    for slot, (t, node) in enumerate(nodes):
        slot_of[t, node] = slot
    used = sorted({t for t, _ in nodes})
    split = asked([trees])
    walked = trees.over(split)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        layouts = [_layout(cuts, d) for d in drawn]
        first = np.concatenate(([0], np.cumsum([x[-1] for x in layouts]))).astype(np.int64)
        base = np.full((len(nodes), cuts.size), -1, np.int64)
        for s, (d, layout) in enumerate(zip(drawn, layouts, strict=True)):
            base[s, d] = first[s] + layout[:-1]
        cells, whole = np.zeros((2, first[-1] * classes)), np.zeros((2, len(nodes) * classes))
        for _, y, w, binned, idx, row, bins in _parts(batches, cuts, split):
            place = walked.places(binned)
            keys, weights = [], []
            for t in used:
                slot = slot_of[t, place[:, t]]
                mine = slot >= 0
                for i, v in enumerate((None, w[mine])):
                    whole[i] += np.bincount(slot[mine] * classes + y[mine], v, whole.shape[1])
                entry = np.flatnonzero(mine[row])
                start = base[slot[row[entry]], idx[entry]]
                entry, start = entry[start >= 0], start[start >= 0]
                keys.append((start + bins[entry]) * classes + y[row[entry]])
                weights.append(w[row[entry]])
            if keys:
                key = np.concatenate(keys)
                for i, v in enumerate((None, np.concatenate(weights))):
                    cells[i] += np.bincount(key, v, cells.shape[1])
        whole = whole.reshape(2, len(nodes), classes)
        found = np.flatnonzero(whole[0].sum(axis=1))
        context = TaskContext.get()
        listed = [np.flatnonzero(cells[0, first[s] * classes : first[s + 1] * classes]) for s in found]
        columns = [
            pa.array(found, pa.int32()), pa.array([context.partitionId() if context else 0] * len(found), pa.int32()),
            pa.array(listed, pa.list_(pa.int32())),
            *(pa.array([cells[i, first[s] * classes + c] for s, c in zip(found, listed, strict=True)], pa.list_(pa.float64())) for i in range(2)),
            *(pa.array([whole[i, s] for s in found], pa.list_(pa.float64())) for i in range(2)),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["slot", "part", "cell", "n", "w", "whole_n", "whole_w"])

    return rows.select("y", "w", "idx", "bin").mapInArrow(count, COUNTS)


def _parts(batches: Iterator[pa.RecordBatch], cuts: Cuts, used: np.ndarray) -> Iterator[tuple]:
    """Slices of batches of binned rows, dense in the ``used`` features."""
    zero = cuts.zeros()[used]
    step = max(32, 8_000_000 // max(len(used), 1))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            y, w = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            idx, row = _rows(part.column(2))
            bins, _ = _rows(part.column(3))
            yield part, y, w, spread(used, zero, part.num_rows, row, idx, bins), idx, row, bins


def best_cut(cuts: Cuts, drawn: np.ndarray, n: np.ndarray, w: np.ndarray, whole_n: np.ndarray, whole_w: np.ndarray, min_rows: int) -> tuple:
    """feature, cut and gini gain of the purest halves, with the rows and the weights per class on the left; feature -1 if none gains.

    ``n`` and ``w`` are (cell, class) for the drawn features one behind the other.
    """
    layout, zero = _layout(cuts, drawn), cuts.zeros()[drawn]
    none = (-1, 0, 0.0, 0.0, np.zeros(len(whole_w)))
    if not len(drawn):
        return none
    owner = np.repeat(np.arange(len(drawn)), np.diff(layout))
    sides = []
    for cells, whole in ((n, whole_n), (w, whole_w)):
        cells = cells.astype(float)  # no entries at all count as integers
        cells[layout[:-1] + zero] += whole - np.add.reduceat(cells, layout[:-1], axis=0)
        running = np.cumsum(cells, axis=0)
        before = np.concatenate((np.zeros((1, cells.shape[1])), running))[layout[:-1]]
        sides.append(running - before[owner])
    left_n, left = sides[0].sum(axis=1), np.maximum(sides[1], 0)
    right = np.maximum(whole_w - left, 0)
    total, nl, nr = whole_w.sum(), left.sum(axis=1), right.sum(axis=1)
    last = np.zeros(len(owner), bool)
    last[layout[1:] - 1] = True
    ok = ~last & (np.minimum(left_n, whole_n.sum() - left_n) >= max(min_rows, 1) - 0.5) & (nl > 0) & (nr > 0)
    purity = (left**2).sum(axis=1) / np.where(nl > 0, nl, 1) + (right**2).sum(axis=1) / np.where(nr > 0, nr, 1)
    gain = np.where(ok, (purity - (whole_w**2).sum() / total) / total, -np.inf)
    top = int(gain.argmax())
    if not gain[top] > 1e-12:
        return none
    return int(drawn[owner[top]]), int(top - layout[owner[top]]), float(gain[top]), float(left_n[top]), left[top]


def _cuts_of(counts: DataFrame, cuts: Cuts, drawn: list[np.ndarray], classes: int, min_rows: int) -> list:
    """The best cut of every slot that has one."""

    def choose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        mine = drawn[int(key[0])]
        width = int(_layout(cuts, mine)[-1]) * classes
        rows = rows.sort_values("part")  # always in the same order, so retried runs add up to the same sums
        cell = np.concatenate(rows["cell"].to_numpy()).astype(np.int64)
        n, w = (np.bincount(cell, np.concatenate(rows[c].to_numpy()), width).reshape(-1, classes) for c in ("n", "w"))
        whole = [np.sum(np.stack(rows[c].to_numpy()), axis=0) for c in ("whole_n", "whole_w")]
        feature, cut, gain, left_n, left = best_cut(cuts, mine, n, w, *whole, min_rows)
        return pd.DataFrame([(key[0], feature, cut, gain, left_n, left)], columns=["slot", "feature", "cut", "gain", "left_n", "left_w"])

    found = counts.groupBy("slot").applyInPandas(choose, "slot int, feature int, cut int, gain double, left_n double, left_w array<double>")
    return sorted(found.where("feature >= 0").collect(), key=lambda r: r["slot"])


def grow_trees(rows: DataFrame, cuts: Cuts, classes: int, n_trees: int, depth: int, min_rows: int, draws: int, seed: int) -> list[Grown]:
    """``rows`` (y, w, idx, bin) hold bins of ``cuts``; each node tries ``draws`` of its features."""
    n, weights = class_counts(rows, classes)
    per_node = min(draws, cuts.size) * -(-int(cuts.first_bin[-1]) // max(cuts.size, 1)) * classes
    at_once = max(1, CELLS // max(cuts.size, per_node, 1))
    groups = []
    for first in range(0, n_trees, TREES_AT_ONCE):
        count = min(TREES_AT_ONCE, n_trees - first)
        grown = Grown(Trees.roots(count), [{0: n} for _ in range(count)], [{0: weights} for _ in range(count)])
        trees, used = grown.trees, [1] * count
        open_root = cuts.size and n >= 2 * min_rows and (weights > 0).sum() > 1
        frontier = [(t, 0) for t in range(count)] if open_root else []
        for _ in range(depth):
            opened = []
            for at in range(0, len(frontier), at_once):
                nodes = frontier[at : at + at_once]
                drawn = [_drawn(cuts.size, draws, seed, first + t, node) for t, node in nodes]
                for r in _cuts_of(_counts(rows, cuts, trees, nodes, drawn, classes), cuts, drawn, classes, min_rows):
                    t, node = nodes[r["slot"]]
                    left, right = used[t], used[t] + 1
                    used[t] += 2
                    trees.widened(max(used[t], 2 * trees.feature.shape[1] if used[t] > trees.feature.shape[1] else 0))
                    trees.feature[t, node], trees.cut[t, node], trees.left[t, node], trees.right[t, node] = r["feature"], r["cut"], left, right
                    trees.gain[t, node] = r["gain"]
                    left_w = np.array(r["left_w"])
                    both = ((left, r["left_n"], left_w), (right, grown.n[t][node] - r["left_n"], np.maximum(grown.stats[t][node] - left_w, 0)))
                    for child, m, w in both:
                        grown.n[t][child], grown.stats[t][child] = m, w
                        if m >= 2 * max(min_rows, 1) and (w > 0).sum() > 1:
                            opened.append((t, child))
            frontier = sorted(opened)
            if not frontier:
                break
        groups.append(grown)
    return groups


def missed_rows(rows: DataFrame, cuts: Cuts, grown: Grown) -> DataFrame:
    """The rows with 1 in ``missed`` where the one tree gives another class."""
    split = asked([grown.trees])
    walked = grown.trees.over(split)
    answer = np.zeros(grown.trees.feature.shape[1], np.int64)
    for node, w in grown.stats[0].items():
        answer[node] = w.argmax()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, y, _, binned, *_ in _parts(batches, cuts, split):
            missed = (answer[walked.places(binned)[:, 0]] != y).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(missed)], ["y", "w", "idx", "bin", "missed"])

    return rows.select("y", "w", "idx", "bin").mapInArrow(work, f"{BINNED}, missed double")


def spark_forest(spark: SparkSession, groups: list[Grown], cuts: Cuts, splitting: np.ndarray, features: int, params: dict) -> RandomForestClassificationModel:
    """The trees as a Spark ML forest, by way of its saved form. ``splitting`` are the features' places in the vectors."""
    classes = len(groups[0].stats[0][0])
    data, tree = [], 0
    for grown in groups:
        t = grown.trees
        for i in range(len(t.feature)):
            for node, w in grown.stats[i].items():
                total, f = float(w.sum()), int(t.feature[i, node])
                impurity = 1 - float(((w / total) ** 2).sum()) if total else 0.0
                inner = f >= 0
                split = (int(splitting[f]), [float(cuts.value[cuts.start[f] + t.cut[i, node]])], -1) if inner else (-1, [], -1)
                ends = (float(t.gain[i, node]), int(t.left[i, node]), int(t.right[i, node])) if inner else (-1.0, -1, -1)
                data.append((tree, (node, float(w.argmax()), impurity, w.tolist(), int(grown.n[i][node]), *ends, split)))
            tree += 1
    path, prefix = fresh_path(spark, "forest"), "org.apache.spark.ml.classification."
    about = {"timestamp": 0, "sparkVersion": spark.version}
    shared = {"featuresCol": "features", "labelCol": "class_idx", "predictionCol": "prediction", "probabilityCol": "probability", "rawPredictionCol": "rawPrediction", "leafCol": "", "impurity": "gini"}
    own = {k: v for k, v in params.items() if k not in ("numTrees", "bootstrap", "featureSubsetStrategy")}
    forest = {"class": f"{prefix}RandomForestClassificationModel", **about, "uid": "RandomForestClassifier_sparse", "paramMap": params, "defaultParamMap": shared, "numFeatures": features, "numClasses": classes, "numTrees": tree}
    one = [json.dumps({"class": f"{prefix}DecisionTreeClassificationModel", **about, "uid": f"dtc_{i}", "paramMap": own, "defaultParamMap": shared}) for i in range(tree)]
    spark.createDataFrame([(json.dumps(forest),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame([(i, m, 1.0) for i, m in enumerate(one)], "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(data, f"treeID int, nodeData struct<{NODE}>").write.parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)


def root_draws(features: int) -> int:
    return max(1, ceil(sqrt(features)))
