"""Benchmark decontamination: n-gram seeds find candidate passages, Smith-Waterman alignment scores them.

1. Every run of ``GRAM`` words of a test item is a seed, however many documents hold it: no seed is left out for being
   common. One pass joins documents to items by seeds: sorted seed hashes are searched in each task.
2. Around each hit, a window of three item lengths to either side is a candidate: a local alignment through the hit
   cannot reach further. Windows that cannot reach the least score, by a bound on the words they share with the item,
   are dropped; the bound loses nothing. The others are aligned with the item (match 2, mismatch and gap -1), equal
   windows of a task once. The score is the share of the item's best possible score.

Items are handled in blocks of at most ``BLOCK_SEEDS`` seeds, the bound of what is sent to the tasks; a larger benchmark
takes more passes and leaves nothing out. Documents are never shuffled.

Words are lower-case runs of letters and digits. Null and empty texts have none; items of fewer than ``GRAM`` words have
no seeds and match nothing. Equal items match alike, repeated rows each get their own pairs. Empty tables give no rows.
Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import vectors
from basketry.llm.tables import id_and_text

GRAM = 4
LEAST = 0.5
BLOCK_SEEDS = 1 << 20
#: A task keeps the scores of at most this many windows for equal ones.
KNOWN_WINDOWS = 1 << 16
MATCH, MISMATCH, GAP = 2, -1, -1
WORD = re.compile(r"[^\W_]+")
PAIRS = "doc_id long, item_id long, score double, first_word long, last_word long"
FOUND = f"{PAIRS}, node binary"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def word_numbers(words: list[str]) -> np.ndarray:
    """A 64-bit number per word."""
    data, offsets = vectors.flat(pa.array(words, pa.string()))
    prefix = vectors.prefix_hashes(vectors.CODES[data])
    return vectors.range_hashes(prefix, offsets[:-1], offsets[1:])


def gram_hashes(numbers: np.ndarray, k: int = GRAM) -> np.ndarray:
    n = max(len(numbers) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * vectors.STEP + numbers[j : j + n]
    return vectors.mix(out)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score, and the end of that alignment in the passage.

    One numpy row per item word; a running maximum resolves the gaps along the row.
    """
    n = len(passage)
    slope = np.arange(1, n + 1) * GAP
    before, best, end = np.zeros(n + 1, np.int64), 0, 0
    for word in item:
        row = np.maximum(before[:-1] + np.where(passage == word, MATCH, MISMATCH), before[1:] + GAP)
        row = np.maximum(row, 0)
        row = np.maximum.accumulate(row - slope) + slope
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at + 1
        before = np.concatenate(([0], row))
    return best, end


def _blocks(items: Iterator, limit: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items as word numbers, in blocks of at most ``limit`` seeds (or one item that has more)."""
    block, size = [], 0
    for row in items:
        numbers = word_numbers(words_of(row["text"]))
        n = max(len(numbers) - GRAM + 1, 0)
        if block and size + n > limit:
            yield block
            block, size = [], 0
        if n:
            block.append((row["doc_id"], numbers))
            size += n
    if block:
        yield block


def item_seeds(block: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and item (its place in the block) of all distinct seeds of each item, by hash and item."""
    hashes = [np.unique(gram_hashes(numbers)) for _, numbers in block]
    owners = np.repeat(np.arange(len(block)), [len(h) for h in hashes])
    hashes = np.concatenate(hashes)
    order = np.argsort(hashes, kind="stable")
    return hashes[order], owners[order]


def candidates(numbers: np.ndarray, hashes: np.ndarray, owners: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(item, first, last) windows of a document around its seed hits; overlapping windows of an item are one."""
    grams = gram_hashes(numbers)
    lo = np.searchsorted(hashes, grams, "left")
    n = np.searchsorted(hashes, grams, "right") - lo
    if not n.any():
        return
    at = np.repeat(np.arange(len(grams)), n)
    item = owners[np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    order = np.argsort(item, kind="stable")
    at, item = at[order], item[order]
    first, last = np.maximum(at - 3 * lengths[item], 0), at + GRAM + 3 * lengths[item]
    new = np.append(True, (item[1:] != item[:-1]) | (first[1:] > last[:-1]))
    end = np.append(new[1:], True)
    yield from zip(item[new].tolist(), first[new].tolist(), np.minimum(last[end], len(numbers)).tolist(), strict=True)


def may_reach(words: np.ndarray, counts: np.ndarray, passage: np.ndarray, least: float) -> bool:
    """Whether a passage can hold an alignment of at least that share; ``words`` and ``counts`` are the item's, by word.

    Of n item words, m matches and g gaps in the passage score at most ``MATCH * m + GAP * g``. So m is at least
    ``least * n``, a word matches no more often than either side has it, and the passage of the alignment is at most
    ``n + (1 - least) * MATCH * n`` words long.
    """
    n = int(counts.sum())
    wanted = max(least * n - 1e-9, 1)
    at = np.minimum(np.searchsorted(words, passage), len(words) - 1)
    member = words[at] == passage
    if np.minimum(np.bincount(at[member], minlength=len(words)), counts).sum() < wanted:
        return False
    reach = n + int((1 - min(least, 1.0)) * MATCH * n) + 1
    inside = np.concatenate(([0], np.cumsum(member)))
    return len(passage) <= reach or int((inside[reach:] - inside[:-reach]).max()) >= wanted


def matches(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per document and test item that it holds: doc_id, item_id, score, and the words of the passage."""
    return _found(docs, benchmark, least).drop("node")


def _found(docs: DataFrame, benchmark: DataFrame, least: float) -> DataFrame:
    """The matches, with the MD5 digest of the document's text."""
    texts = id_and_text(docs)
    items = id_and_text(benchmark, "item_id")
    out = None
    for block in _blocks((r for r in items.toLocalIterator()), BLOCK_SEEDS):
        part = _block_matches(texts, block, least)
        out = part if out is None else out.union(part)
    spark: SparkSession = docs.sparkSession
    return spark.createDataFrame([], FOUND) if out is None else out


def _block_matches(texts: DataFrame, block: list[tuple[int, np.ndarray]], least: float) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast((block, *item_seeds(block)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, hashes, owners = sent.value
        lengths = np.array([len(numbers) for _, numbers in block])
        bags: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        known: dict[tuple[int, bytes], tuple[int, int]] = {}

        def scored(item: int, passage: np.ndarray) -> tuple[int, int]:
            if item not in bags:
                bags[item] = np.unique(block[item][1], return_counts=True)
            if not may_reach(*bags[item], passage, least):
                return 0, 0
            key = item, hashlib.blake2b(passage.tobytes(), digest_size=16).digest()
            if key not in known:
                if len(known) >= KNOWN_WINDOWS:
                    known.clear()
                known[key] = align(block[item][1], passage)
            return known[key]

        for batch in batches:
            out = []
            for doc_id, text in zip(*batch.columns, strict=True):
                numbers = word_numbers(words_of(text.as_py()))
                best: dict[int, tuple] = {}
                for item, first, last in candidates(numbers, hashes, owners, lengths):
                    score, end = scored(item, numbers[first:last])
                    share = score / (MATCH * int(lengths[item]))
                    if share >= least and share > best.get(item, (0.0,))[0]:
                        start = max(first, first + end - int(lengths[item]))
                        best[item] = (share, start, first + end)
                node = hashlib.md5(text.as_py().encode(), usedforsecurity=False).digest() if best else b""
                out += [(doc_id.as_py(), block[item][0], *found, node) for item, found in best.items()]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [f.split()[0] for f in FOUND.split(", ")])

    return texts.mapInArrow(rows, FOUND)


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item. Rows are told apart by their texts, not their ids."""
    names = [f"`{c}`" for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("row")).withColumn("node", F.unhex(F.md5(F.coalesce(F.col("row.text").cast("string"), F.lit("")))))
    dirty = _found(docs.select("doc_id", "text"), benchmark, least).select("node").distinct()
    return rows.join(dirty, "node", "left_anti").select("row.*")
