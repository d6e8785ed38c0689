"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. The weight of a run of five words is its count in the text times the mean idf of its words. idf grows from 1 to
   ``1 + IDF_SPAN`` with the logarithm of rarity; words in less than ``RARE`` of the documents all count as rarest. So
   only words above that share need a table, and there are at most ``1 / RARE`` times the mean number of distinct words
   of a document, whatever the number of documents: that is the size bound of the broadcast.
2. Per text, ``BANDS * ROWS`` samples (Ioffe's improved consistent weighted sampling): two texts share a sample with the
   probability of their weighted Jaccard similarity. The samples of a band make one key.
3. Texts that share a key are verified by exact weighted Jaccard (``linking``), and components are the classes.

Words are runs of non-blank characters as they stand. Equal texts are one node from the start, so a group of copies is
joined once. A text without words stands alone, each row for itself; a text of one to four words has one run. Null ids
stay in the output and never name a class unless all ids of it are null (then class_id is null). Rows that repeat an id
are judged by their texts. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import vectors
from basketry.llm.buckets import linked_contents, pair_similarities
from basketry.llm.tables import id_and_text, stored

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 10, 4
#: Pairs whose sketches agree in less go unjudged: of pairs at 0.8 that is 0.0010.
LEAST_SKETCH = 0.6
RARE = 0.001
IDF_SPAN = 0.5
U = np.uint64
QUANTILES = 1 << 16
SIGNATURE = "node binary, keys array<bigint>, sketch binary"


def _nodes(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).withColumn("node", F.unhex(F.md5("text")))


def word_shares(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and idf of the words that at least ``RARE`` of the documents hold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = vectors.flat(batch.column(0))
            for lo, hi in vectors.chunks(offsets):
                words, first = vectors.word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                owner = np.repeat(np.arange(hi - lo), np.diff(first)).astype(np.uint64)
                order = np.lexsort((owner, words))
                words, owner = words[order], owner[order]
                new = np.ones(len(words), bool)
                new[1:] = (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])
                found, counts = np.unique(words[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts.astype(np.int64))], ["word", "n"])

    total = texts.count()
    least = max(2, math.ceil(RARE * total))
    rows = texts.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas()
    words = rows["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    rarity = np.log(total / rows["n"].to_numpy(float)) / math.log(1 / RARE)
    return words[order], (1 + IDF_SPAN * np.clip(rarity, 0, 1))[order]


def weighted(data: np.ndarray, offsets: np.ndarray, known: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, hash and weight of every distinct shingle of every text, by owner and hash."""
    words, first = vectors.word_hashes(data, offsets)
    grams, bounds = vectors.shingles(words, first, WORDS)
    of_word = np.full(len(words) + 1, 1 + IDF_SPAN)
    if len(known) and len(words):
        at = np.minimum(np.searchsorted(known, words), len(known) - 1)
        of_word[:-1] = np.where(known[at] == words, idf[at], 1 + IDF_SPAN)
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(len(grams)) - bounds[owner] + first[owner]
    end = np.minimum(start + WORDS, first[owner + 1])
    # one fixed order of additions, so that equal shingles get the same weight in every text
    summed = np.zeros(len(grams))
    for j in range(WORDS):
        inside = start + j < end
        summed += np.where(inside, of_word[np.minimum(start + j, len(words))], 0.0)
    mean = summed / np.maximum(end - start, 1)
    order = np.lexsort((grams, owner))
    owner, grams, mean = owner[order], grams[order], mean[order]
    new = np.ones(len(grams), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(grams)))
    return owner[at], grams[at], tf * mean[at]


def signature_rows(nodes: pa.Array, sampled: np.ndarray, bands: int, rows: int) -> pa.RecordBatch:
    keys = pa.array(band_keys(sampled, bands, rows).reshape(-1).view(np.int64))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, bands, dtype=np.int32)), keys)
    sketches = [x.tobytes() for x in (sampled & U(0xFF)).astype(np.uint8)]
    return pa.RecordBatch.from_arrays([nodes, lists, pa.array(sketches, pa.binary())], ["node", "keys", "sketch"])


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1), and their logarithms: the distribution of -ln(u1 * u2).

    Single precision is enough to draw by, and keeps the tables in the processor's cache.
    """
    p = (np.arange(QUANTILES) + 0.5) / QUANTILES
    x = np.sqrt(2 * p) + 0.1
    for _ in range(60):  # Newton on 1 - (1 + x) exp(-x) = p
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-12), 1e-9)
    return x.astype(np.float32), np.log(x).astype(np.float32)


def samples(owner: np.ndarray, grams: np.ndarray, weight: np.ndarray, n_samples: int) -> np.ndarray:
    """One row per owner that has shingles, one column per sample.

    For each shingle r and c are Gamma(2, 1) and beta uniform, drawn by its hash; t = floor(ln(weight) / r + beta), and
    the shingle with the smallest ln(c) - r * (t - beta) - r wins. That number with the shingle's hash bits is the
    sample: it is the same for two texts only if they chose the same shingle at the same t.
    """
    gamma, log_gamma = _tables()
    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    out = np.zeros((len(starts), n_samples), np.uint64)
    if not len(starts):
        return out
    logs, low = np.log(weight).astype(np.float32), grams & U(0xFFFFFFFF)
    for k in range(n_samples):
        drawn = vectors.mix(grams + U(int(vectors.BASE) * (k + 1) % (1 << 64)))
        r = gamma[(drawn & U(0xFFFF)).astype(np.int64)]
        beta = ((drawn >> U(16)) & U(0xFFFF)).astype(np.float32) / np.float32(65536)
        score = log_gamma[(drawn >> U(32) & U(0xFFFF)).astype(np.int64)] - r * (np.floor(logs / r + beta) - beta) - r
        bits = score.view(np.uint32)
        rising = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
        out[:, k] = np.minimum.reduceat(rising << U(32) | low, starts)
    return out


def band_keys(sampled: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(sampled), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(sampled), band + 1, np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            key = vectors.mix(key * vectors.STEP + sampled[:, k])
        keys[:, band] = key
    return keys


def signatures(texts: DataFrame, known: np.ndarray, idf: np.ndarray) -> DataFrame:
    """(node, keys, sketch) of every text that has words: a key per band, and the last byte of every sample."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = vectors.flat(batch.column(1))
            for lo, hi in vectors.chunks(offsets):
                owner, grams, weight = weighted(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], known, idf)
                sampled = samples(owner, grams, weight, BANDS * ROWS)
                yield signature_rows(batch.column(0).take(pa.array(np.unique(owner) + lo)), sampled, BANDS, ROWS)

    return texts.select("node", "text").mapInArrow(rows, SIGNATURE)


def similarities(left: pa.Array, right: pa.Array, known: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Exact weighted Jaccard of the texts at equal places."""
    return pair_similarities(left, right, lambda texts: weighted(*vectors.flat(texts), known, idf))


def _roots(docs: DataFrame, similar: float) -> DataFrame:
    """(node, root) of all texts that are linked to another."""
    rows = _nodes(docs)
    known, idf = word_shares(rows)

    def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return weighted(*vectors.flat(texts), known, idf)

    # copies in one batch of rows are already one; the rest are made one among the shared keys
    found = stored(signatures(rows, known, idf), "signatures")
    return linked_contents(found, rows.select("node", F.col("text").alias("content")), features, similar, LEAST_SKETCH)


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row per input row: doc_id, class_id (the smallest doc_id of its class)."""
    rows = _nodes(docs)
    roots = _roots(docs, similar)
    # written once without the texts, which three joins would otherwise read again
    ids = stored(rows.select("doc_id", "node", (F.length(F.translate("text", " \t\n\x0b\f\r", "")) > 0).alias("solid")), "ids")
    first = ids.where("solid").groupBy("node").agg(F.min("doc_id").alias("first"))
    named = first.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    lowest = named.groupBy("root").agg(F.min("first").alias("class_id"))
    of_node = named.join(lowest, "root").select("node", "class_id")
    joined = ids.join(of_node, "node", "left")
    return joined.select("doc_id", F.when(F.col("solid"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs``, all columns, of which one of each class stays: that with the smallest id.

    Classes are the same as above. Rows without words all stay. Rows of equal text and equal id are one row afterwards.
    """
    names = [f"`{c}`" for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("row")).withColumn("text", F.coalesce("row.text", F.lit("")))
    rows = rows.withColumn("node", F.unhex(F.md5("text"))).withColumn("solid", F.length(F.translate("text", " \t\n\x0b\f\r", "")) > 0)
    roots = _roots(docs, similar)
    place = F.struct(F.col("row.doc_id").isNull().alias("last"), F.col("row.doc_id").cast("long").alias("doc_id"), F.col("node"))
    first = rows.where("solid").groupBy("node").agg(F.min(place).alias("place"))
    named = first.join(roots, "node", "left").select("place", F.coalesce("root", "node").alias("root"))
    kept = named.groupBy("root").agg(F.min("place").alias("place")).select("place.node", F.col("place.doc_id").alias("kept_id"))
    # one row of each kept (text, id): the texts themselves are shuffled only for those
    solid = rows.where("solid").join(kept, (rows["node"] == kept["node"]) & rows["row.doc_id"].cast("long").eqNullSafe(kept["kept_id"]), "left_semi")
    one = solid.groupBy("node").agg(F.first("row").alias("row"))
    return one.select("row.*").union(rows.where(~F.col("solid")).select("row.*"))
