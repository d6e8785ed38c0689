"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic rows are positives; all rows that may be learnt from are unlabelled text, whatever their label says. A linear classifier over the presence of hashed words and word beginnings is trained in numpy with the non-negative risk
estimator: ``prior * R+(1) + max(0, R_u(0) - prior * R+(0))`` with the logistic loss; in a step where the second part is
negative, only that part is climbed, which is the estimator's correction. The prior is the share of toxic rows among the
labelled rows of the learning part. Only buckets of at least ``LEAST_ROWS`` positives get a
weight; AdaGrad with a proximal L1 step keeps the weights of harmless words at zero.

Fitting uses at most ``MAX_POSITIVE`` positives and ``MAX_UNLABELLED`` unlabelled rows (documented bounds, chosen by
hash); scoring covers every row. Null and empty texts have no words and get the score of the bias alone. Rows are scored one
by one, so repeated rows are equal; a null id is not held out and never learnt from. Without labels every score is
0. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.decontamination import word_numbers
from basketry.llm.tables import id_and_text

BUCKETS = 1 << 18
STEMS = (3, 4, 5)
MAX_POSITIVE = 6_000
MAX_UNLABELLED = 12_000
THRESHOLD = 0.3
STEPS = 800
BATCH = 256
RATE = 0.1
L1 = 5e-4
LEAST_ROWS = 5
WORD = re.compile(r"[^\W_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(text: str) -> np.ndarray:
    """Buckets of the distinct lower-case words of a text and of their beginnings of 3 to 5 letters."""
    words = set(WORD.findall(text.lower()))
    words = [*words, *{"<" + w[:k] for w in words for k in STEMS if len(w) > k}]
    return np.unique(word_numbers(words) % np.uint64(BUCKETS)).astype(np.int32) if words else np.zeros(0, np.int32)


def _hashed(texts: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t.as_py()) for t in batch.column(1)], pa.list_(pa.int32()))], ["positive", "words"])

    return texts.mapInArrow(rows, "positive boolean, words array<int>")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, words: np.ndarray) -> float:
        return float(_sigmoid(np.array(self.weights[words].sum() + self.bias)))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seed: int = 7) -> Model:
    """Mini-batches of both kinds of rows under the non-negative risk."""
    random, weights, bias = np.random.default_rng(seed), np.zeros(BUCKETS), float(np.log(prior / (1 - prior)))
    counts = np.zeros(BUCKETS, np.int64)
    for r in positive:
        counts[r] += 1  # the buckets of a row are different
    known = counts >= LEAST_ROWS
    positive, unlabelled = ([r[known[r]] for r in rows] for rows in (positive, unlabelled))
    seen, seen_bias = np.full(BUCKETS, 1e-4), 1e-4

    def stacked(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    for _ in range(STEPS):
        u = [unlabelled[i] for i in random.integers(0, len(unlabelled), BATCH)]
        p = [positive[i] for i in random.integers(0, len(positive), BATCH)]
        (pw, po), (uw, uo) = stacked(p), stacked(u)
        ps = _sigmoid(np.bincount(po, weights[pw], len(p)) + bias)
        us = _sigmoid(np.bincount(uo, weights[uw], len(u)) + bias)
        negative = -np.log1p(-us + 1e-12).mean() + prior * np.log1p(-ps + 1e-12).mean()
        # slopes of the losses in the logits: log(1 + e^-z) gives s - 1, log(1 + e^z) gives s
        up, uu = -prior * ps / len(p), us / len(u)
        if negative >= 0:
            up = up + prior * (ps - 1) / len(p)
        else:
            up, uu = -up, -uu
        slope = np.bincount(pw, up[po], BUCKETS) + np.bincount(uw, uu[uo], BUCKETS)
        at = np.unique(np.concatenate([pw, uw]))
        seen[at] += slope[at] ** 2
        rate = RATE / np.sqrt(seen[at])
        stepped = weights[at] - rate * slope[at]
        weights[at] = np.sign(stepped) * np.maximum(np.abs(stepped) - rate * L1, 0)
        seen_bias += (up.sum() + uu.sum()) ** 2
        bias -= RATE / np.sqrt(seen_bias) * (up.sum() + uu.sum())
    return Model(weights, bias)


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model from the labelled and unlabelled rows that are not held out."""
    texts = id_and_text(docs).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).alias("toxic")).where(~held_out(F.col("doc_id")))
    marks = marks.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counted = marks.agg(F.count("*").alias("n"), F.count_if("toxic").alias("toxic")).first()
    if not counted["toxic"] or counted["toxic"] == counted["n"]:
        return None
    rank = F.xxhash64(F.lit("pu"), "doc_id")
    chosen = marks.where("toxic").orderBy(rank, "doc_id").limit(MAX_POSITIVE).select("doc_id", F.lit(True).alias("positive"))
    others = texts.select("doc_id").orderBy(rank, "doc_id").limit(MAX_UNLABELLED)
    wanted = chosen.union(others.select("doc_id", F.lit(False)))
    rows = _hashed(texts.join(wanted, "doc_id").orderBy("doc_id").select("positive", "text")).toArrow()
    positive = rows["positive"].to_numpy()
    words = [chunk.values.to_numpy()[a:b] for chunk in rows["words"].chunks for a, b in pairwise(chunk.offsets.to_numpy())]  # views of flat numbers
    sides = [[w for w, p in zip(words, positive, strict=True) if p == side] for side in (True, False)]
    if not sides[0] or not sides[1]:
        return None
    return fit(*sides, counted["toxic"] / counted["n"])


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = learn(docs, labels)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(features(t.as_py())) if model else 0.0 for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["doc_id", "held_out", "score"])

    texts = id_and_text(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = texts.mapInArrow(rows, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
