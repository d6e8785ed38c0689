"""Quality by a sparse ensemble of rules.

``statistics`` describes every whole text by a few numbers. Shallow trees, each grown on a bootstrap sample of the labelled rows
and on a part of the statistics, are cut into rules: every path from a root to a node is a conjunction of comparisons
(``mean_word <= 9.5 and upper > 0.4``). A logistic regression with a lasso penalty over all rules keeps the few that matter; the
strength of the penalty is chosen by cross-validation inside the learning rows. The kept rules are compiled into one Spark column expression over the
statistics, so scoring a corpus is a scan, a batch of vectorised counts and a projection: no shuffle and nothing learnt per row.

Learning uses labelled rows that are not held out, ``MAX_ROWS`` at most (a documented bound, chosen by a hash of the id, every row where fewer are
labelled); only their ids are broadcast and only their statistics reach the driver. Labels, language, source and ids are never inputs.

A document with several different labels teaches nothing; of documents with equal ids one teaches (the smallest statistics). A
null id is neither held out nor learnt from. Null and empty texts have the statistics of zero words and get a score like any
other; a very long text is one row of counts. Repeated rows are scored alike. If only one class is labelled the score is that class, without labels 0.5. An empty table
gives no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm import vectors
from basketry.llm.tables import id_and_text

MAX_ROWS = 20_000
TREES = 60
DEPTH = 3
LEAST_LEAF = 10
BINS = 32
STRENGTHS = (0.03, 0.01, 0.003, 0.001)
FOLDS = 3
STEPS = 400
THRESHOLD = 0.5
SHORT = 3  # letters of a short word
WINDOW = 5

STATISTICS = (
    "words", "mean_word", "short_words", "long_words", "distinct_words", "top_word", "repeated_windows", "repeated_lines", "words_a_line",
    "upper", "digits", "symbols", "stops", "marks", "bars", "single_marks",
)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


UPPER, DIGIT, SYMBOL = _table(bytes(range(65, 91))), _table(b"0123456789"), _table(b"#*$%&<>@^~_=+\\/")
STOP, MARK, BAR, LEAD = _table(b".,;:"), _table(b"!?"), _table(b"|"), ~_table(bytes(range(128, 192)))


def _repeats(key: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: different keys, entries whose key stands elsewhere in the text too, and the count of the most frequent key."""
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    counts, of = np.diff(np.concatenate((first, [len(key)]))), owner[first]
    top = np.zeros(n, np.int64)
    np.maximum.at(top, of, counts)
    return np.bincount(of, minlength=n), np.bincount(of, np.where(counts > 1, counts, 0), n), top


def describe(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``STATISTICS`` per text; the texts are the byte ranges between the offsets."""
    n = len(offsets) - 1

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask)))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    start, end, first = vectors.word_spans(data, offsets)
    prefix = vectors.prefix_hashes(vectors.CODES[data])
    words = vectors.range_hashes(prefix, start, end)
    counts = np.diff(first)
    owner = np.repeat(np.arange(n), counts)
    leads = np.concatenate(([0], np.cumsum(LEAD[data])))
    letters = leads[end] - leads[start]
    lone = (end - start == 1) & (SYMBOL | STOP | MARK | BAR)[data[start]] if len(start) else np.zeros(0, bool)
    distinct, _, top = _repeats(words, owner, n)
    grams, bounds = vectors.shingles(words, first, WINDOW)
    _, windows, _ = _repeats(grams, np.repeat(np.arange(n), np.diff(bounds)), n)
    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    line_end = np.sort(np.concatenate((offsets[1:], breaks)))
    # a break at the very end of a text opens an empty line that begins where the next text does: sorting keeps both lists in step
    filled = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end = line_start[filled], line_end[filled]
    line_owner = np.searchsorted(offsets, line_start, "right") - 1
    lines = np.bincount(line_owner, minlength=n)
    unlike, _, _ = _repeats(vectors.range_hashes(prefix, line_start, line_end), line_owner, n)
    w, chars = np.maximum(counts, 1), np.maximum(total(vectors.SOLID[data] & LEAD[data]), 1)
    return np.stack(
        [
            np.log1p(counts), np.bincount(owner, letters, n) / w, np.bincount(owner, letters <= SHORT, n) / w, np.bincount(owner, letters > 14, n) / w,
            distinct / np.sqrt(w), top / w, windows / np.maximum(np.diff(bounds), 1), 1 - unlike / np.maximum(lines, 1), np.log1p(counts / np.maximum(lines, 1)),
            total(UPPER[data]) / chars, total(DIGIT[data]) / chars, total(SYMBOL[data]) / chars, total(STOP[data]) / w, total(MARK[data]) / w,
            total(BAR[data]) / w, np.bincount(owner, lone, n) / w,
        ],
        axis=1,
    )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``STATISTICS`` of every text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = vectors.flat(batch.column(1))
            for a, b in vectors.chunks(offsets):
                found = describe(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c) for c in found.T)], ["doc_id", *STATISTICS])

    return id_and_text(docs, id_col, text_col).mapInArrow(rows, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass(frozen=True)
class Condition:
    """statistic > bound if ``above``, else statistic <= bound."""

    statistic: int
    above: bool
    bound: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return (x[:, self.statistic] > self.bound) == self.above

    def column(self) -> Column:
        c = F.col(STATISTICS[self.statistic])
        return c > F.lit(self.bound) if self.above else c <= F.lit(self.bound)


Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class Ensemble:
    """Rules with their weights; the score is the logistic function of their sum."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        terms = [F.when(reduce(and_, [c.column() for c in rule]), F.lit(weight)).otherwise(F.lit(0.0)) for rule, weight in self.rules]
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(self.intercept))))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            total += weight * _holds(rule, x)
        return 1 / (1 + np.exp(-total))


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(and_, [c.holds(x) for c in rule])


def _bounds(x: np.ndarray) -> list[np.ndarray]:
    """Cut points of each statistic: middles between neighbouring quantiles."""
    cuts = []
    for column in x.T:
        at = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1), method="nearest"))
        cuts.append((at[1:] + at[:-1]) / 2)
    return cuts


def _grow(x: np.ndarray, y: np.ndarray, allowed: np.ndarray, cuts: list[np.ndarray], path: Rule, rules: set[Rule]) -> None:
    """Adds the paths below a node, whose rows are given, to the rules."""
    if len(path) >= DEPTH or len(y) < 2 * LEAST_LEAF or y.min() == y.max():
        return
    best, choice = 1e-9, None
    whole = y.sum()
    for s in allowed:
        if not len(cuts[s]):
            continue
        at = np.searchsorted(cuts[s], x[:, s], "left")  # x <= cut i  <=>  at <= i
        n = np.cumsum(np.bincount(at, minlength=len(cuts[s]) + 1))[:-1]
        p = np.cumsum(np.bincount(at, y, len(cuts[s]) + 1))[:-1]
        m = len(y) - n
        gain = p**2 / np.maximum(n, 1) + (whole - p) ** 2 / np.maximum(m, 1) - whole**2 / len(y)
        gain[(n < LEAST_LEAF) | (m < LEAST_LEAF)] = 0
        top = int(gain.argmax())
        if gain[top] > best:
            best, choice = gain[top], (int(s), float(cuts[s][top]))
    if choice is None:
        return
    for above in (False, True):
        condition = Condition(choice[0], above, choice[1])
        mine = condition.holds(x)
        rules.add((*path, condition))
        _grow(x[mine], y[mine], allowed, cuts, (*path, condition), rules)


def tree_rules(x: np.ndarray, y: np.ndarray, seed: int = 11) -> list[Rule]:
    """The paths of bagged shallow trees, each over half of the statistics; of rules that hold for the same rows one stays."""
    random, cuts, rules = np.random.default_rng(seed), _bounds(x), set()
    for _ in range(TREES):
        rows = random.integers(0, len(y), len(y))
        allowed = np.sort(random.permutation(x.shape[1])[: (x.shape[1] + 1) // 2])
        _grow(x[rows], y[rows], allowed, cuts, (), rules)
    unlike: dict[bytes, Rule] = {}
    for rule in sorted(rules, key=lambda r: (len(r), [(c.statistic, c.above, c.bound) for c in r])):
        held = np.packbits(_holds(rule, x))
        if np.packbits(~_holds(rule, x)).tobytes() not in unlike:
            unlike.setdefault(held.tobytes(), rule)
    return list(unlike.values())


def lasso(held: np.ndarray, y: np.ndarray, strength: float) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on the weights of centred rules, by accelerated proximal steps."""
    centre = held.mean(axis=0)
    z = held - centre
    step = 4 / max(float(np.linalg.norm(z, 2)) ** 2 / len(y) + 1, 1e-9)
    w, b = np.zeros(z.shape[1]), float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    vw, vb, pace = w, b, 1.0
    for _ in range(STEPS):
        slope = (1 / (1 + np.exp(-np.clip(z @ vw + vb, -30, 30))) - y) / len(y)
        new = vw - step * (z.T @ slope)
        new = np.sign(new) * np.maximum(np.abs(new) - step * strength, 0)
        new_b = vb - step * slope.sum()
        following = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        vw, vb = new + (pace - 1) / following * (new - w), new_b + (pace - 1) / following * (new_b - b)
        w, b, pace = new, new_b, following
    return b - float(centre @ w), w


def learn(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """The ensemble of a sample; the penalty is the strongest whose cross-validated loss is within 1 % of the best."""
    if not len(y) or y.min() == y.max():
        return Ensemble(0.0 if not len(y) else (np.inf if y[0] else -np.inf), ())
    fold = np.random.default_rng(5).permutation(len(y)) % FOLDS

    def fitted(xs: np.ndarray, ys: np.ndarray, strengths: tuple[float, ...]) -> list[Ensemble]:
        rules = tree_rules(xs, ys)
        held = np.stack([_holds(r, xs) for r in rules], axis=1).astype(float) if rules else np.zeros((len(ys), 0))
        found = [lasso(held, ys, s) for s in strengths]
        return [Ensemble(float(b), tuple((r, float(v)) for r, v in zip(rules, w, strict=True) if v)) for b, w in found]

    losses = np.zeros(len(STRENGTHS))
    for f in range(FOLDS):
        inside = fold != f
        if y[inside].min() == y[inside].max():
            continue
        for i, e in enumerate(fitted(x[inside], y[inside], STRENGTHS)):
            p = np.clip(e.predict(x[~inside]), 1e-6, 1 - 1e-6)
            losses[i] -= (y[~inside] * np.log(p) + (1 - y[~inside]) * np.log(1 - p)).sum()
    chosen = next(s for s, loss in zip(STRENGTHS, losses, strict=True) if loss <= 1.01 * losses.min())
    return fitted(x, y, (chosen,))[0]


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``MAX_ROWS`` labelled documents that are not held out."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    marks = marks.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").select("doc_id", "y")
    ids = id_and_text(docs).select("doc_id").distinct()
    wanted = marks.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_ROWS).collect()
    if not wanted:
        return np.zeros((0, len(STATISTICS))), np.zeros(0)
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r["y"]) for r in wanted], "doc_id long, y int")
    taught = statistics(id_and_text(docs).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"))
    one = taught.groupBy("doc_id").agg(F.min(F.struct(*STATISTICS)).alias("x")).join(F.broadcast(chosen), "doc_id").orderBy("doc_id").select("x.*", "y")
    rows = np.array(one.collect(), float)
    return rows[:, :-1], rows[:, -1]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Ensemble:
    return learn(*sample(docs, labels, label))


def scores(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = statistics(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), fit(docs, labels, label).column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
