"""Boosting of one joint softmax model: in every round one tree per class, all classes' trees grown together.

Visits are binned once and written, with one margin per class. A level of the trees of all classes is one pass: tasks sum first and second derivatives of the
softmax loss per (class, node, feature bin), the sums meet by (class, node), and each node keeps its best split. So a round costs ``depth + 1``
passes whatever the number of classes, the driver holds trees only, and no pass sorts or shuffles visits. The last pass of
a round moves the margins, with the loss before and after; the table of the round before it is overwritten (two folders take turns).
Visits that one task can hold are grown there, all rounds at once: the same trees without a pass per level.

Cut points come from the values of all visits. Only features with a cut point can split a node, so rows keep the entries of these features alone, and a row is made dense only for the features that the trees at hand ask for.

Two ways of growing:

* Newton steps: gains and leaf values from both derivatives, leaf values bounded by ``max_delta_step``, splits that gain less than
  ``gamma`` cut back from the leaves upwards, rows and features sampled per round and per tree.
* Gradient steps: splits by the variance of the residuals, leaf values by one Newton step, features sampled per node; the rows a round leaves
  out give its out-of-bag gain.

With held-out visits the multiclass loss on them is known after every round from the same table. Fitting stops after ``patience``
rounds without gain in that loss (in the training loss where nothing is held out) and the model ends with its best round.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from basketry.functions.columns import vector_parts
from basketry.operators.labels import class_index, class_values
from basketry.session import fresh_path, materialize, over_all_cores

CELLS = 4_000_000  # histogram cells a task holds at once; more nodes than fit take another pass
LANES = 64  # partial sums that meet in one group; more tasks than this are added up in two steps
ONE_TASK = 1_000_000  # entries of visits that one task holds and grows all rounds from, without a pass per level
ONE_TASK_CELLS = 128_000_000  # and cells (visit, splitting feature) of them
STATE = "visit_number long, y int, held boolean, idx array<int>, bin array<int>, margin array<double>, before double, after double"


@dataclass(frozen=True)
class Growth:
    """How trees are grown; see the module text for the two ways."""

    rounds: int
    depth: int
    rate: float
    newton: bool = True
    subsample: float = 1.0
    feature_share: float = 1.0
    min_rows: int = 1
    min_hessian: float = 0.0
    penalty: float = 1.0
    gamma: float = 0.0
    max_delta_step: float = 0.0  # 0: no bound
    max_bins: int = 32
    patience: int | None = 50
    seed: int = 1
    row_gain: float = 0.0  # least gain of a split per row of its node

    def leaf(self, g, h, classes: int):
        """The value of a leaf with these sums of derivatives, before the learning rate."""
        if not self.newton:
            return np.where(h > 1e-150, -(classes - 1) / classes * g / np.maximum(h, 1e-150), 0.0)
        w = -g / (h + self.penalty)
        return np.clip(w, -self.max_delta_step, self.max_delta_step) if self.max_delta_step else w

    def score(self, g, h, n, classes: int):
        """Twice the loss a node saves; the gain of a split is the children's less the parent's."""
        if not self.newton:
            return g * g / np.maximum(n, 1)
        w = self.leaf(g, h, classes)
        return -(2 * g * w + (h + self.penalty) * w * w)

    def slopes(self, margin: np.ndarray, y: np.ndarray, turn: int) -> Callable[[int], tuple[np.ndarray, np.ndarray]]:
        """The first and second derivatives of the loss of each row by the margin of a class, given the class."""
        p = _softmax(margin)

        def of(c: int) -> tuple[np.ndarray, np.ndarray]:
            return p[:, c] - (y == c), np.maximum((2 if self.newton else 1) * p[:, c] * (1 - p[:, c]), 1e-16)

        return of


@dataclass(frozen=True)
class Cuts:
    """Cut points of all features behind one another; value <= cut i of its feature means bin <= i."""

    start: np.ndarray
    value: np.ndarray

    @property
    def size(self) -> int:
        return len(self.start) - 1

    @property
    def first_bin(self) -> np.ndarray:
        return self.start + np.arange(self.size + 1)

    def bins(self, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        low, high = self.start[feature], self.start[feature + 1]
        base = low
        while len(low) and (low < high).any():
            middle = (low + high) // 2
            right = (low < high) & (self.value[np.minimum(middle, len(self.value) - 1)] < value)
            low, high = np.where(right, middle + 1, low), np.where(right | (low >= high), high, middle)
        return (low - base).astype(np.int32)

    def zeros(self) -> np.ndarray:
        every = np.arange(self.size)
        return self.bins(every, np.zeros(self.size))

    @property
    def splitting(self) -> np.ndarray:
        """The features that have a cut point; no other can split a node."""
        return np.flatnonzero(np.diff(self.start))

    def narrowed(self) -> Cuts:
        """The cuts of the splitting features alone, numbered from 0."""
        return Cuts(np.concatenate(([0], np.cumsum(np.diff(self.start)[self.splitting]))).astype(np.int64), self.value)


def find_cuts(size: int, feature: np.ndarray, value: np.ndarray, rows: int, max_bins: int) -> Cuts:
    """Middles between neighbouring values of each feature, or between quantiles where there are more than ``max_bins`` values.

    Entries that are not listed are zeros.
    """
    order = np.lexsort((value, feature))
    feature, value = feature[order], value[order]
    edge = np.searchsorted(feature, np.arange(size + 1))
    found = [np.zeros(0)] * size
    for f in np.flatnonzero(np.diff(edge)):
        mine = value[edge[f] : edge[f + 1]]
        mine = np.sort(np.concatenate((mine, np.zeros(max(rows - len(mine), 0)))))
        unlike = np.unique(mine)
        if len(unlike) > max_bins:
            unlike = np.unique(np.quantile(mine, np.linspace(0, 1, max_bins), method="nearest"))
        found[f] = (unlike[1:] + unlike[:-1]) / 2
    return Cuts(np.concatenate(([0], np.cumsum([len(c) for c in found]))).astype(np.int64), np.concatenate(found) if found else np.zeros(0))


@dataclass
class Trees:
    """The trees of one round, one per class: arrays (class, node); feature -1 marks a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    weight: np.ndarray
    gain: np.ndarray

    @staticmethod
    def roots(classes: int) -> Trees:
        return Trees(np.full((classes, 1), -1), *(np.zeros((classes, 1), int) for _ in range(3)), np.zeros((classes, 1)), np.zeros((classes, 1)))

    def widened(self, nodes: int) -> None:
        extra = nodes - self.feature.shape[1]
        if extra > 0:
            for name in vars(self):
                fill = -1 if name == "feature" else 0
                setattr(self, name, np.pad(getattr(self, name), ((0, 0), (0, extra)), constant_values=fill))

    def places(self, binned: np.ndarray) -> np.ndarray:
        """The node of each row in the tree of each class; ``binned`` is dense (row, feature)."""
        classes = np.arange(len(self.feature))[None, :]
        rows = np.arange(len(binned))[:, None]
        node = np.zeros((len(binned), len(self.feature)), np.int64)
        while True:
            feature = self.feature[classes, node]
            inner = feature >= 0
            if not inner.any():
                return node
            goes_left = binned[rows, np.maximum(feature, 0)] <= self.cut[classes, node]
            node = np.where(inner, np.where(goes_left, self.left[classes, node], self.right[classes, node]), node)

    def values(self, binned: np.ndarray) -> np.ndarray:
        return self.weight[np.arange(len(self.feature))[None, :], self.places(binned)]

    def over(self, used: np.ndarray) -> Trees:
        """The same trees for rows that hold the ``used`` features alone."""
        return replace(self, feature=np.where(self.feature >= 0, np.searchsorted(used, self.feature), -1))


def asked(trees: list[Trees]) -> np.ndarray:
    """The features that trees split on, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.int64), *(t.feature[t.feature >= 0] for t in trees)]))


def spread(used: np.ndarray, fill: np.ndarray, rows: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Rows that are dense in the ``used`` features alone; ``fill`` is the value of entries that are not listed."""
    dense = np.tile(fill, (rows, 1))
    place = np.searchsorted(used, feature)
    known = np.flatnonzero(place < len(used))
    known = known[used[place[known]] == feature[known]]
    dense[row[known], place[known]] = value[known]
    return dense


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each."""
    lengths = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), lengths)


def _softmax(margin: np.ndarray) -> np.ndarray:
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _losses(margin: np.ndarray, y: np.ndarray) -> np.ndarray:
    p = _softmax(margin)[np.arange(len(y)), np.clip(y, 0, margin.shape[1] - 1)]
    return -np.log(np.clip(p, 1e-15, 1))


def _uniform(ids: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """A number in [0, 1) per visit, the same in every task and attempt."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + turn + 1) * 0x632BE59BD9B4E019 % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / 2**53


def left_out(growth: Growth, turn: int, visit: str = "visit_number"):
    """True for the visits that a round (from 0) does not learn from."""
    if growth.subsample >= 1:
        return F.lit(False)

    @F.arrow_udf("double")
    def uniform(ids: pa.Array) -> pa.Array:
        return pa.array(_uniform(ids.fill_null(0).to_numpy(), growth.seed, turn))

    return uniform(F.col(visit).cast("long")) >= growth.subsample


def _allowed(growth: Growth, turn: int, of_class: int, node: int, size: int) -> np.ndarray:
    """Features a tree (Newton) or a node (gradient) may split on."""
    if growth.feature_share >= 1:
        return np.ones(size, bool)
    random = np.random.default_rng([growth.seed, turn, of_class, 0 if growth.newton else node + 1])
    chosen = np.zeros(size, bool)
    chosen[random.permutation(size)[: max(1, int(growth.feature_share * size))]] = True
    return chosen


def _blocks(batch: pa.RecordBatch, cuts: Cuts, used: np.ndarray) -> Iterator[tuple]:
    """Slices of a state batch with dense bins of the ``used`` features: few enough rows that they stay small for any number of them."""
    zero = cuts.zeros()[used]
    step = max(32, 8_000_000 // max(len(used), 1))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        ids = part.column(0).fill_null(0).to_numpy()
        y, held = (part.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        idx, row = _rows(part.column(3))
        bins, _ = _rows(part.column(4))
        binned = spread(used, zero, part.num_rows, row, idx, bins)
        margin = part.column(5).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
        yield part, ids, y, held, binned, margin, idx, row, bins


def _histograms(state: DataFrame, cuts: Cuts, trees: Trees, growth: Growth, turn: int, nodes: list[tuple[int, int]]) -> DataFrame:
    """Sums of derivatives and rows per bin for the listed (class, node) pairs, one row per task and pair."""
    width, first_bin = int(cuts.first_bin[-1]), cuts.first_bin
    slot_of = np.full(trees.feature.shape, -1)
    for slot, (c, node) in enumerate(nodes):
        slot_of[c, node] = slot
    used = sorted({c for c, _ in nodes})
    split = asked([trees])
    walked = trees.over(split)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cells, whole = np.zeros((3, len(nodes), width)), np.zeros((3, len(nodes)))
        for batch in batches:
            for _, ids, y, held, binned, margin, idx, row, bins in _blocks(batch, cuts, split):
                bag = ~held.astype(bool) & (y >= 0) & (_uniform(ids, growth.seed, turn) < growth.subsample)
                slopes, place = growth.slopes(margin, y, turn), walked.places(binned)
                for c in used:
                    slot = np.where(bag, slot_of[c, place[:, c]], -1)
                    if not (slot >= 0).any():
                        continue
                    g, h = slopes(c)
                    mine, entry = slot >= 0, slot[row] >= 0
                    key = slot[row][entry] * width + first_bin[idx[entry]] + bins[entry]
                    # the slots of one class are neighbours, so only their stretch of the table is counted
                    low, high = slot[mine].min(), slot[mine].max() + 1
                    for i, v in enumerate((g, h, np.ones(len(g)))):
                        whole[i, low:high] += np.bincount(slot[mine] - low, v[mine], high - low)
                        cells[i, low:high] += np.bincount(key - low * width, v[row][entry], (high - low) * width).reshape(high - low, width)
        context = TaskContext.get()
        found = np.flatnonzero(whole[2])
        columns = [
            pa.array([nodes[s][0] for s in found], pa.int32()), pa.array([nodes[s][1] for s in found], pa.int32()),
            pa.array([context.partitionId() if context else 0] * len(found), pa.int32()),
            *(pa.array([cells[i, s] for s in found], pa.list_(pa.float64())) for i in range(3)),
            pa.array([whole[:, s] for s in found], pa.list_(pa.float64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["class", "node", "part", "g", "h", "n", "whole"])

    return state.mapInArrow(sums, HISTOGRAM)


HISTOGRAM = "class int, node int, part int, g array<double>, h array<double>, n array<double>, whole array<double>"


def _added(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    rows = rows.sort_values("part")  # always in the same order, so retried runs add up to the same sums
    return tuple(np.sum(np.stack(rows[c].to_numpy()), axis=0) for c in ("g", "h", "n", "whole"))


def best_splits(cuts: Cuts, growth: Growth, classes: int, allowed: np.ndarray, sums: np.ndarray, whole: np.ndarray) -> list[tuple]:
    """feature, cut, gain and the sums on the left of the best split of each node; feature -1 if none is allowed or gains.

    ``sums`` are g, h and n by (node, bin), ``whole`` the same by node, ``allowed`` the features by node.
    """
    first, zero, size = cuts.first_bin, cuts.zeros(), cuts.size
    nodes, sums = sums.shape[1], sums.copy()
    unlisted = whole[:, :, None] - (np.add.reduceat(sums, first[:-1], axis=2) if size else np.zeros((3, nodes, 0)))
    sums[:, :, first[:-1] + zero] += unlisted
    running = np.cumsum(sums, axis=2)
    before = np.concatenate((np.zeros((3, nodes, 1)), running), axis=2)[:, :, first[:-1]]
    owner = np.repeat(np.arange(size), np.diff(first))
    left = running - before[:, :, owner]
    right = whole[:, :, None] - left
    gain = growth.score(*left, classes) + growth.score(*right, classes) - growth.score(*whole, classes)[:, None]
    last = np.zeros(len(owner), bool)
    last[first[1:] - 1] = True
    ok = allowed[:, owner] & ~last & (np.minimum(left[2], right[2]) >= growth.min_rows - 1e-9)
    if growth.newton:
        ok &= np.minimum(left[1], right[1]) >= growth.min_hessian
    gain = np.where(ok, gain, -np.inf)
    found = []
    for i, top in enumerate(gain.argmax(axis=1).tolist() if len(owner) else [0] * nodes):
        if not len(owner) or not gain[i, top] > 1e-6 or gain[i, top] < growth.row_gain * whole[2, i]:
            found.append((-1, 0, 0.0, 0.0, 0.0, 0.0))
        else:
            found.append((int(owner[top]), int(top - first[owner[top]]), float(gain[i, top]), *left[:, i, top].tolist()))
    return found


def best_split(cuts: Cuts, growth: Growth, classes: int, allowed: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray, whole: np.ndarray) -> tuple:
    """The best split of one node."""
    return best_splits(cuts, growth, classes, allowed[None], np.stack([g, h, n])[:, None], whole[:, None])[0]


def _splits(histograms: DataFrame, tasks: int, cuts: Cuts, growth: Growth, classes: int, turn: int, allowed: Callable) -> list:
    """One row per (class, node) with its sums and best split among the features that ``allowed`` names."""
    if tasks > LANES:

        def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([(key[0], key[1], key[2], *_added(rows))], columns=["class", "node", "part", "g", "h", "n", "whole"])

        histograms = histograms.groupBy("class", "node", (F.col("part") % LANES).alias("lane")).applyInPandas(add, HISTOGRAM)

    def choose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        g, h, n, whole = _added(rows)
        split = best_split(cuts, growth, classes, allowed(growth, turn, int(key[0]), int(key[1])), g, h, n, whole)
        return pd.DataFrame([(*key, *whole, *split)], columns=["class", "node", "g", "h", "n", "feature", "cut", "gain", "lg", "lh", "ln"])

    schema = "class int, node int, g double, h double, n double, feature int, cut int, gain double, lg double, lh double, ln double"
    return histograms.groupBy("class", "node").applyInPandas(choose, schema).collect()


def _pruned(trees: Trees, c: int, gamma: float) -> None:
    """Cuts splits that gain less than gamma and lead to two leaves, from the leaves upwards."""

    def cut_back(node: int) -> bool:
        """Whether the node is a leaf in the end."""
        if trees.feature[c, node] < 0:
            return True
        both = [cut_back(int(trees.left[c, node])), cut_back(int(trees.right[c, node]))]
        if all(both) and trees.gain[c, node] < gamma:
            trees.feature[c, node], trees.gain[c, node] = -1, 0.0
            return True
        return False

    cut_back(0)


def grow(state: DataFrame, tasks: int, cuts: Cuts, growth: Growth, classes: int, turn: int, allowed: Callable, chosen: list[int] | None = None) -> Trees:
    """The trees of one round over a state of so many tasks. ``allowed`` gives the features a node may split on, as a mask.

    Only the ``chosen`` classes get a tree, all if none are named; the others get a root that gives 0.
    """

    def splits(trees: Trees, nodes: list[tuple[int, int]]) -> list:
        return _splits(_histograms(state, cuts, trees, growth, turn, nodes), tasks, cuts, growth, classes, turn, allowed)

    return grown(splits, cuts, growth, classes, chosen)


def grown(splits: Callable, cuts: Cuts, growth: Growth, classes: int, chosen: list[int] | None = None) -> Trees:
    """The trees of one round; ``splits`` gives the sums and best splits of some nodes of the trees so far."""
    trees = Trees.roots(classes)
    frontier = [(c, 0) for c in (range(classes) if chosen is None else chosen)]
    used = [1] * classes
    at_once = max(1, CELLS // max(int(cuts.first_bin[-1]), 1))
    for _ in range(growth.depth):
        if not frontier:
            break
        frontier.sort()
        rows = []
        for at in range(0, len(frontier), at_once):
            rows += splits(trees, frontier[at : at + at_once])
        frontier = []
        for r in sorted(rows):
            c, node = r["class"], r["node"]
            trees.weight[c, node] = growth.rate * growth.leaf(np.float64(r["g"]), np.float64(r["h"]), classes)
            if r["feature"] < 0:
                continue
            left, right = used[c], used[c] + 1
            used[c] += 2
            trees.widened(used[c])
            trees.feature[c, node], trees.cut[c, node], trees.left[c, node], trees.right[c, node] = r["feature"], r["cut"], left, right
            trees.gain[c, node] = r["gain"]
            for child, g, h, n in ((left, r["lg"], r["lh"], r["ln"]), (right, r["g"] - r["lg"], r["h"] - r["lh"], r["n"] - r["ln"])):
                trees.weight[c, child] = growth.rate * growth.leaf(np.float64(g), np.float64(h), classes)
                if n >= 2 * growth.min_rows:
                    frontier.append((c, child))
    if growth.newton and growth.gamma:
        for c in range(classes):
            _pruned(trees, c, growth.gamma)
    return trees


def _moved(state: DataFrame, cuts: Cuts, trees: Trees) -> DataFrame:
    """The state with the margins after a round."""
    split = asked([trees])
    walked = trees.over(split)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, y, _, binned, margin, *_ in _blocks(batch, cuts, split):
                new = margin + walked.values(binned)
                edges = pa.array(np.arange(len(y) + 1) * margin.shape[1], pa.int32())
                columns = [pa.ListArray.from_arrays(edges, pa.array(new.ravel())), pa.array(_losses(margin, y)), pa.array(_losses(new, y))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(5)), *columns], ["visit_number", "y", "held", "idx", "bin", "margin", "before", "after"])

    return state.mapInArrow(move, STATE)


SPLIT = Row("class", "node", "g", "h", "n", "feature", "cut", "gain", "lg", "lh", "ln")


class OneTable:
    """A state that one task holds whole. The visits keep their places in the trees, so a level only moves them one step."""

    def __init__(self, batches: Iterator[pa.RecordBatch], cuts: Cuts, growth: Growth, classes: int, allowed: Callable):
        self.cuts, self.growth, self.classes, self.allowed = cuts, growth, classes, allowed
        batches = list(batches)
        ids = np.concatenate([b.column(0).fill_null(0).to_numpy() for b in batches])
        y, held = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in batches]) for i in (1, 2))
        idx, row = (np.concatenate(p) for p in zip(*(_rows(b.column(3)) for b in batches), strict=True))
        row += np.repeat(np.cumsum([0, *(b.num_rows for b in batches)])[:-1], [len(_rows(b.column(3))[0]) for b in batches])
        bins = np.concatenate([_rows(b.column(4))[0] for b in batches])
        # sorted by all that a visit holds, so that sums do not depend on how the visits arrive
        weight = np.bincount(row, np.sin(idx + 1.0) * (bins + 1), len(ids))
        order = np.lexsort((weight, held, y, ids))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids, self.y, self.held = ids[order], y[order], held[order].astype(bool)
        entry = np.argsort(place[row], kind="stable")
        self.row, self.idx, bins = place[row][entry], idx[entry], bins[entry]
        self.key = cuts.first_bin[self.idx] + bins
        small = np.uint8 if np.diff(cuts.start).max(initial=0) < 256 else np.int32
        self.dense = np.tile(cuts.zeros().astype(small), (len(ids), 1))
        self.dense[self.row, self.idx] = bins
        self.margin = np.zeros((len(ids), classes))

    def started(self, base: np.ndarray) -> OneTable:
        self.margin += base
        return self

    def _step(self, trees: Trees) -> None:
        for c, place in enumerate(self.place):
            rows = np.flatnonzero(trees.feature[c][place] >= 0)
            while len(rows):
                node = place[rows]
                feature = trees.feature[c][node]
                place[rows] = np.where(self.dense[rows, feature] <= trees.cut[c][node], trees.left[c][node], trees.right[c][node])
                rows = rows[trees.feature[c][place[rows]] >= 0]

    def round(self, turn: int) -> tuple[Trees, tuple]:
        """The trees of a round; mean losses after it on training and held-out visits, and what it saved on those left out."""
        growth, classes = self.growth, self.classes
        width = int(self.cuts.first_bin[-1])
        self.place = np.zeros((classes, len(self.ids)), np.int32)
        drawn = _uniform(self.ids, growth.seed, turn) < growth.subsample
        known = ~self.held & (self.y >= 0)
        bag = np.flatnonzero(known & drawn)
        number = np.full(len(self.ids), -1)
        number[bag] = np.arange(len(bag))
        mine = number[self.row] >= 0
        row, key = number[self.row[mine]], self.key[mine]
        of_class = growth.slopes(self.margin[bag], self.y[bag], turn)
        slopes = [of_class(c) for c in range(classes)]

        def splits(trees: Trees, nodes: list[tuple[int, int]]) -> list:
            self._step(trees)
            found = []
            for c in sorted({c for c, _ in nodes}):
                listed = [node for of, node in nodes if of == c]
                slot_of = np.full(trees.feature.shape[1], -1)
                slot_of[listed] = np.arange(len(listed))
                slot = slot_of[self.place[c][bag]]
                inside, entries = slot >= 0, np.flatnonzero(slot[row] >= 0)
                rows, size = row[entries], len(listed)
                cell = slot[rows] * width + key[entries]
                g, h = slopes[c]
                sums = np.stack([np.bincount(cell, v, size * width) for v in (g[rows], h[rows], None)]).astype(float).reshape(3, size, width)
                whole = np.stack([np.bincount(slot[inside], v, size) for v in (g[inside], h[inside], None)]).astype(float)
                may = np.stack([self.allowed(growth, turn, c, node) for node in listed])
                best = best_splits(self.cuts, growth, classes, may, sums, whole)
                found += [SPLIT(c, node, *whole[:, i].tolist(), *split) for i, (node, split) in enumerate(zip(listed, best, strict=True)) if whole[2, i]]
            return found

        trees = grown(splits, self.cuts, growth, classes)
        self._step(trees)
        before = _losses(self.margin, self.y)
        for c in range(classes):
            self.margin[:, c] += trees.weight[c][_kept_nodes(trees, c)[self.place[c]]]
        after = _losses(self.margin, self.y)
        out = known & ~drawn
        parts = ((after, known), (after, self.held & (self.y >= 0)), (before - after, out))
        return trees, tuple(float(v[rows].mean()) if rows.any() else None for v, rows in parts)


def _kept_nodes(trees: Trees, c: int) -> np.ndarray:
    """For each node of a class's tree the node at which its rows end: itself, or the one that was cut back above it."""
    kept = np.arange(trees.feature.shape[1])
    for node in np.flatnonzero(trees.left[c] > 0):
        if trees.feature[c, node] < 0 or kept[node] != node:
            kept[[trees.left[c, node], trees.right[c, node]]] = kept[node]
    return kept


@dataclass
class Round:
    """Mean losses after a round; ``oob_gain`` is the mean loss saved on the training visits that the round left out."""

    train_loss: float | None
    held_loss: float | None
    oob_gain: float | None


@dataclass
class SoftmaxBoostedModel:
    classes: list[int]
    cuts: Cuts
    base: np.ndarray
    trees: list[Trees]
    history: list[Round] = field(default_factory=list)

    @property
    def best_round(self) -> int | None:
        """The round, from 1, with the least held-out loss, or training loss where nothing was held out."""
        losses = [r.train_loss if r.held_loss is None else r.held_loss for r in self.history]
        return None if not losses or losses[0] is None else int(np.argmin(losses)) + 1

    @property
    def best_score(self) -> float | None:
        best = self.best_round
        return None if best is None else (lambda r: r.train_loss if r.held_loss is None else r.held_loss)(self.history[best - 1])

    def staged(self, rounds: int) -> SoftmaxBoostedModel:
        """The model as it was after so many rounds."""
        return SoftmaxBoostedModel(self.classes, self.cuts, self.base, self.trees[:rounds], self.history)

    def walked(self) -> tuple[np.ndarray, list[Trees]]:
        """The features that any tree asks for, and the trees over rows of these."""
        used = asked(self.trees)
        return used, [t.over(used) for t in self.trees]

    def binned(self, used: np.ndarray, feature: np.ndarray, value: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Dense bins of the ``used`` features."""
        mine = np.isin(feature, used)
        feature = feature[mine].astype(np.int64)
        return spread(used, self.cuts.zeros()[used], rows, row[mine], feature, self.cuts.bins(feature, value[mine]))

    @staticmethod
    def shares(margin: np.ndarray) -> np.ndarray:
        """Class probabilities."""
        return _softmax(margin)

    def probabilities(self, feature: np.ndarray, value: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        used, trees = self.walked()
        binned = self.binned(used, feature, value, row, rows)
        margin = np.tile(self.base, (rows, 1))
        for t in trees:
            margin += t.values(binned)
        return self.shares(margin)

    def with_probability(self, matrix: DataFrame, out: str = "probability") -> DataFrame:
        model = type(self)(self.classes, self.cuts, self.base, self.trees)

        @F.arrow_udf("array<double>")
        def probability(positions: pa.Array, values: pa.Array) -> pa.Array:
            parts = []
            step = max(32, 8_000_000 // max(len(asked(model.trees)), 1))
            for at in range(0, max(len(positions), 1), step):
                some = positions.slice(at, step)
                feature, row = _rows(some)
                parts.append(model.probabilities(feature, _rows(values.slice(at, step))[0], row, len(some)))
            p = np.concatenate(parts)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))

        positions, values = vector_parts()
        return matrix.withColumn(out, probability(positions, values))

    def importances(self) -> list[float]:
        """Share of each feature in the gains of all splits."""
        total = np.zeros(self.cuts.size)
        for t in self.trees:
            inner = t.feature >= 0
            np.add.at(total, t.feature[inner], t.gain[inner])
        return (total / total.sum() if total.sum() else total).tolist()

    def rounds(self) -> list[tuple[int, float | None, float | None, float | None]]:
        return [(i, r.train_loss, r.held_loss, r.oob_gain) for i, r in enumerate(self.history, 1)]

    def save(self, spark: SparkSession, path: str) -> None:
        names = ("feature", "cut", "left", "right", "weight", "gain")
        rows = [(i, *(json.dumps(getattr(t, n).tolist()) for n in names)) for i, t in enumerate(self.trees)]
        spark.createDataFrame(rows, "round int, " + ", ".join(f"{n} string" for n in names)).write.mode("overwrite").parquet(f"{path}/trees")
        about = {"start": self.cuts.start.tolist(), "value": self.cuts.value.tolist(), "base": self.base.tolist(), "history": [list(vars(r).values()) for r in self.history]}
        spark.createDataFrame([(json.dumps(about),)], "value string").write.mode("overwrite").parquet(f"{path}/cuts")

    @staticmethod
    def load(spark: SparkSession, path: str, classes: list[int]) -> SoftmaxBoostedModel:
        about = json.loads(spark.read.parquet(f"{path}/cuts").first()[0])
        rows = sorted(spark.read.parquet(f"{path}/trees").collect(), key=lambda r: r["round"])
        trees = [Trees(*(np.array(json.loads(r[n])) for n in ("feature", "cut", "left", "right", "weight", "gain"))) for r in rows]
        cuts = Cuts(np.array(about["start"], np.int64), np.array(about["value"], float))
        return SoftmaxBoostedModel(classes, cuts, np.array(about["base"]), trees, [Round(*r) for r in about["history"]])


def feature_cuts(train: DataFrame, max_bins: int) -> Cuts:
    """Cut points from the values of all visits, as ``find_cuts`` gives them for one table.

    Equal values of a feature are counted first, so ranks come from counts; only values that are a cut's neighbour reach the driver, at most
    ``max_bins`` per feature.
    """
    positions, values = vector_parts()
    size = train.select(F.unwrap_udt("features").alias("v")).select(F.coalesce(F.col("v.size"), F.size("v.values"))).first()
    entries = train.select(F.explode(F.arrays_zip(positions.alias("i"), values.alias("v"))).alias("e")).select("e.i", "e.v").where("v <> 0")
    listed = materialize(entries.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")), "feature-values")
    rows = train.count()
    zeros = listed.groupBy("i").agg((F.lit(rows) - F.sum("n")).alias("n")).where("n > 0").select("i", F.lit(0.0).alias("v"), "n")
    of_feature = Window.partitionBy("i")
    before = F.coalesce(F.sum("n").over(of_feature.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = listed.unionByName(zeros).select("i", "v", "n", before.alias("before"), F.count(F.lit(1)).over(of_feature).alias("values"))
    places = F.array(*[F.lit(int(t)).cast("long") for t in nearest_places(rows, max_bins)])
    holds_one = F.exists(places, lambda t: (t >= F.col("before")) & (t < F.col("before") + F.col("n")))
    chosen = placed.where((F.col("values") <= max_bins) | holds_one).select("i", "v").collect()
    found: dict[int, list[float]] = {}
    for r in chosen:
        found.setdefault(r["i"], []).append(r["v"])
    cuts = [np.zeros(0)] * (size[0] if size else 0)
    for i, unlike in found.items():
        unlike = np.sort(np.array(unlike))
        cuts[i] = (unlike[1:] + unlike[:-1]) / 2
    return Cuts(np.concatenate(([0], np.cumsum([len(c) for c in cuts]))).astype(np.int64), np.concatenate(cuts) if cuts else np.zeros(0))


def nearest_places(rows: int, max_bins: int) -> np.ndarray:
    """The places that ``np.quantile(..., method="nearest")`` takes in a sorted table for ``max_bins`` equally spaced quantiles."""
    return np.rint((rows - 1) * np.linspace(0, 1, max_bins)).astype(np.int64)


sampled_cuts = feature_cuts  # the former name


def binned_rows(train: DataFrame, holdout: DataFrame | None, classes: list[int], cuts: Cuts, base: np.ndarray) -> DataFrame:
    """The state before the first round: bins of the splitting features, numbered among these."""
    positions, values = vector_parts()
    splitting = cuts.splitting

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        narrow = np.full(cuts.size + 1, -1)
        narrow[splitting] = np.arange(len(splitting))
        for batch in batches:
            feature, row = _rows(batch.column(3))
            mine = narrow[np.minimum(feature, cuts.size)] >= 0
            feature, row, value = feature[mine].astype(np.int64), row[mine], _rows(batch.column(4))[0][mine]
            edges = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            lists = (pa.ListArray.from_arrays(edges, pa.array(v, pa.int32())) for v in (narrow[feature], cuts.bins(feature, value)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *lists], ["visit_number", "y", "held", "idx", "bin"])

    def rows(part: DataFrame, held: bool) -> DataFrame:
        y = F.coalesce(class_index("trip_type", classes), F.lit(-1))
        return part.select(F.col("visit_number").cast("long"), y.alias("y"), F.lit(held).alias("held"), positions.alias("idx"), values.alias("v"))

    every = rows(train, False) if holdout is None else rows(train, False).unionByName(rows(holdout, True))
    start = F.array(*[F.lit(float(b)) for b in base])
    found = every.mapInArrow(bins, "visit_number long, y int, held boolean, idx array<int>, bin array<int>")
    return found.select("*", start.alias("margin"), F.lit(0.0).alias("before"), F.lit(0.0).alias("after"))


def fit_softmax(train: DataFrame, growth: Growth, holdout: DataFrame | None = None) -> SoftmaxBoostedModel:
    """A joint model of all classes of ``train`` (visit_number, trip_type, features). Held-out visits of unknown classes are not scored.

    Visits that fit into one task are grown there, all rounds at once; more than that take a pass per level.
    """
    spark, classes = train.sparkSession, class_values(train)
    if not classes:
        raise ValueError("no labelled visits to learn from")
    cuts = feature_cuts(train, growth.max_bins)
    base = np.zeros(len(classes))
    if not growth.newton:  # gradient steps start from the class shares
        counts = {r[0]: r[1] for r in train.where(F.col("trip_type").isNotNull()).groupBy("trip_type").count().collect()}
        base = np.log([counts[c] / sum(counts.values()) for c in classes])
    folders = [fresh_path(spark, "boosting-a"), fresh_path(spark, "boosting-b")]

    turns = count()

    def kept(df: DataFrame) -> DataFrame:
        path = folders[next(turns) % 2]
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(STATE).parquet(path)

    narrow, splitting, size = cuts.narrowed(), cuts.splitting, cuts.size

    def allowed(growth: Growth, turn: int, of_class: int, node: int) -> np.ndarray:
        return _allowed(growth, turn, of_class, node, size)[splitting]

    model = SoftmaxBoostedModel(classes, cuts, base, [])
    if len(classes) == 1:
        return model
    state = kept(binned_rows(train, holdout, classes, cuts, base))
    rows, entries = state.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("idx")), F.lit(0))).first()
    if entries <= ONE_TASK and rows * len(splitting) <= ONE_TASK_CELLS:
        found = _fitted_in_one_task(state, narrow, growth, len(classes), base, allowed)
    else:
        found = _rounds(growth, _distributed(over_all_cores(state, kept), kept, narrow, growth, len(classes), allowed))
    for trees, losses in found:
        model.trees.append(replace(trees, feature=np.where(trees.feature >= 0, splitting[trees.feature], -1) if len(splitting) else trees.feature))
        model.history.append(Round(*losses))
    if growth.patience and model.best_round is not None:
        model.trees = model.trees[: model.best_round]
    return model


def _rounds(growth: Growth, step: Callable) -> list[tuple[Trees, tuple]]:
    """The trees and losses of all rounds until one lies ``patience`` rounds behind the best."""
    found, so_far = [], SoftmaxBoostedModel([], Cuts(np.array([0]), np.zeros(0)), np.zeros(0), [])
    for turn in range(growth.rounds):
        found.append(step(turn))
        so_far.history.append(Round(*found[-1][1]))
        best = so_far.best_round
        if growth.patience and best is not None and turn + 1 - best >= growth.patience:
            break
    return found


def _distributed(state: DataFrame, kept: Callable, cuts: Cuts, growth: Growth, classes: int, allowed: Callable) -> Callable:
    """A round over a state of any size: a pass per level, and one that moves the margins."""
    now, tasks = [state], state.rdd.getNumPartitions()

    def step(turn: int) -> tuple[Trees, tuple]:
        trees = grow(now[0], tasks, cuts, growth, classes, turn, allowed)
        now[0] = kept(_moved(now[0], cuts, trees))
        known = F.col("y") >= 0
        out = ~F.col("held") & known & left_out(growth, turn)
        loss = now[0].agg(
            F.avg(F.when(~F.col("held") & known, F.col("after"))), F.avg(F.when(F.col("held") & known, F.col("after"))), F.avg(F.when(out, F.col("before") - F.col("after")))
        ).first()
        return trees, tuple(loss)

    return step


def _fitted_in_one_task(state: DataFrame, cuts: Cuts, growth: Growth, classes: int, base: np.ndarray, allowed: Callable) -> list[tuple[Trees, tuple]]:
    """All rounds in one task; the trees alone reach the driver."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = OneTable(batches, cuts, growth, classes, allowed).started(base)
        for trees, losses in _rounds(growth, table.round):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((trees, losses))], pa.binary())], ["round"])

    rows = state.select("visit_number", "y", "held", "idx", "bin").coalesce(1).mapInArrow(fit, "round binary").collect()
    return [pickle.loads(r[0]) for r in rows]
