"""Substring dedup over bytes: bytes covered by a 100-byte string that starts earlier elsewhere are removed.

This is not the difference-cover suffix sort (see README). Equal adjacent prefixes of the suffix array are found by
grouping instead of sorting:

1. Winnowing: of the ``LENGTH - GRAM + 1`` grams of ``GRAM`` bytes in each window of ``LENGTH`` bytes, the one with the smallest hash
   is a mark. A window's mark depends on its content only, so equal windows have equal marks; windows whose mark occurs
   once in all documents cannot repeat and go no further. No repeat is lost.
2. Neighbouring windows with the same mark (the first smallest gram) are one stretch. Stretches meet their equals by a 128-bit digest
   of their bytes; the one at the smallest (doc_id, start) is the first, and all windows of the others repeat.
3. Of first stretches that share their mark with an unlike one, the windows meet by digest in the same way: there a repeat begins or ends.
4. The later windows of a document, merged, are its removed runs.

Strings are judged on the input; overlaps count; matches never cross documents. Null and empty texts have no bytes. Null
ids come last. Rows that repeat an id are told apart by their text; fully equal rows are treated alike. An empty
table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import vectors
from basketry.llm.tables import discard, id_and_text, stored

LENGTH = 100
GRAM = 50
OUT_ROWS = 100_000
#: Windows meet in so many parts, one after the other, each whole by digest: only one part is shuffled at a time.
SLICES = 4
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _grams(data: bytes) -> np.ndarray:
    """Hash of every gram."""
    at = np.arange(len(data) - GRAM + 1)
    return vectors.range_hashes(vectors.prefix_hashes(vectors.CODES[np.frombuffer(data, np.uint8)]), at, at + GRAM)


def marks(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of the grams that some window of LENGTH bytes selects."""
    n, width = len(data) - GRAM + 1, LENGTH - GRAM + 1
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashed = _grams(data)
    low, size = hashed.copy(), 1  # sliding minimum by doubling
    while 2 * size <= width:
        low, size = np.minimum(low[: len(low) - size], low[size:]), 2 * size
    low = np.minimum(low[: n - width + 1], low[width - size : width - size + n - width + 1])
    # a gram is a mark if it is the smallest of some window around it; equal ones in a window all count
    around = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    high, size = around, 1
    while 2 * size <= width:
        high, size = np.maximum(high[: len(high) - size], high[size:]), 2 * size
    high = np.maximum(high[:n], high[width - size : width - size + n])
    chosen = np.flatnonzero(hashed <= high)
    return chosen, hashed[chosen]


def marked_stretches(data: bytes, places: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and mark of the stretches whose mark stands at one of the places."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashed = _grams(data)
    least = np.lib.stride_tricks.sliding_window_view(hashed, LENGTH - GRAM + 1)[:n].argmin(axis=1) + np.arange(n)
    first = np.flatnonzero(np.diff(least, prepend=-1))
    sizes = np.diff(np.append(first, n))
    held = np.isin(least[first], places)
    first, sizes = first[held], sizes[held]
    return first, sizes, hashed[least[first]]


def _source(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).select("doc_id", F.unhex(F.md5("text")).alias("source"), "text")


def _marks(docs: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, source, text in zip(*batch.columns, strict=True):
                places, hashed = marks(text.as_py().encode())
                n = len(places)
                columns = [pa.repeat(doc_id, n), pa.repeat(source, n), pa.array(places.astype(np.int32)), pa.array(hashed.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "place", "mark"])

    return _source(docs).mapInArrow(rows, "doc_id long, source binary, place int, mark long")


def _of_document(source: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """Rows of ``source`` with those of a table by (of_id, of_source)."""
    return source.join(table, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("source") == F.col("of_source")), how)


def stretches(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, source, start, size, mark, stretch): every stretch of windows that hold a repeated mark, by the digest of its bytes.

    Marks are those of windows of LENGTH bytes; a shorter window may hold none, so a smaller ``length`` is refused.
    """
    if length < LENGTH:
        raise ValueError(f"length is {length}; repeats shorter than {LENGTH} bytes cannot be found")
    found = stored(_marks(docs), "marks")
    often = stored(found.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark"), "often")
    places = found.join(often, "mark", "left_semi").groupBy("doc_id", "source").agg(F.array_sort(F.collect_set("place")).alias("places"))
    places = stored(places.withColumnsRenamed({"doc_id": "of_id", "source": "of_source"}), "places")
    discard(found, often)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, source, text, places in zip(*batch.columns, strict=True):
                data = text.as_py().encode()
                starts, sizes, hashed = marked_stretches(data, np.asarray(places.as_py(), np.int64), length)
                digests = [_digest(data[i : i + n - 1 + length]) for i, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                columns = [pa.array(starts.astype(np.int32)), pa.array(sizes.astype(np.int32)), pa.array(hashed.view(np.int64)), pa.array(digests, pa.binary())]
                columns = [pa.repeat(doc_id, len(starts)), pa.repeat(source, len(starts)), *columns]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "start", "size", "mark", "stretch"])

    joined = _of_document(_source(docs), places).select("doc_id", "source", "text", "places")
    found = stored(joined.mapInArrow(rows, "doc_id long, source binary, start int, size int, mark long, stretch binary"), "stretches")
    discard(places)
    return found


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def windows(docs: DataFrame, chosen: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, source, start, window): every window of the chosen stretches (doc_id, source, start, size), by the digest of its bytes."""
    runs = chosen.groupBy("doc_id", "source").agg(F.collect_set(F.struct("start", "size")).alias("runs"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, source, text, runs in zip(*batch.columns, strict=True):
                data = text.as_py().encode()
                starts = np.concatenate([np.arange(r["start"], r["start"] + r["size"], dtype=np.int32) for r in runs.as_py()])
                for lo in range(0, len(starts), OUT_ROWS):
                    part = starts[lo : lo + OUT_ROWS]
                    digests = [_digest(data[i : i + length]) for i in part.tolist()]
                    columns = [pa.repeat(doc_id, len(part)), pa.repeat(source, len(part)), pa.array(part), pa.array(digests, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "start", "window"])

    joined = _of_document(_source(docs), runs.withColumnsRenamed({"doc_id": "of_id", "source": "of_source"}))
    return joined.select("doc_id", "source", "text", "runs").mapInArrow(rows, "doc_id long, source binary, start int, window binary")


def later(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(of_id, of_source, runs): first window and number of windows of all that repeat an earlier one, a row per document with any."""
    found = stretches(docs, length)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "source", "start")
    one = found.groupBy("stretch").agg(F.min(place).alias("first"), F.min("size").alias("size"), F.min("mark").alias("mark"), F.count("*").alias("n"))
    one = stored(one, "first-stretches")
    unlike = one.groupBy("mark").agg(F.count("*").alias("kinds")).where("kinds > 1").select("mark")
    chosen = one.join(unlike, "mark", "left_semi").select("first.doc_id", "first.source", "first.start", "size")
    single = stored(windows(docs, chosen, length), "windows")
    again = []
    for i in range(SLICES):
        some = single.where(F.pmod(F.xxhash64("window"), F.lit(SLICES)) == i)
        of_window = some.groupBy("window").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        repeats = some.join(of_window, "window").where(~place.eqNullSafe(F.col("first")))
        again.append(stored(repeats.select("doc_id", "source", "start", F.lit(1).alias("size")), "again"))
    discard(single)
    of_stretch = one.where("n > 1").select("stretch", "first")
    whole = found.join(of_stretch, "stretch").where(~place.eqNullSafe(F.col("first"))).select("doc_id", "source", "start", "size")
    gone = reduce(DataFrame.union, [whole, *again]).groupBy("doc_id", "source").agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("runs"))
    gone = stored(gone.withColumnsRenamed({"doc_id": "of_id", "source": "of_source"}), "later")
    discard(found, one, *again)
    return gone


def clean(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left)."""
    gone = later(docs, length)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, repeats in zip(*batch.columns, strict=True):
                data = text.as_py().encode()
                runs: list[list[int]] = []
                for repeat in repeats.as_py() or ():
                    start, end = repeat["start"], repeat["start"] + repeat["size"] - 1 + length
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], end)
                    else:
                        runs.append([start, end])
                kept, at = [], 0
                for a, b in runs:
                    kept.append(data[at:a])
                    at = b
                left = b"".join([*kept, data[at:]])
                out.append((doc_id.as_py(), len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [f.split()[0] for f in RESULT.split(", ")])

    joined = _of_document(_source(docs), gone, "left")
    return joined.select("doc_id", "text", "runs").mapInArrow(rows, RESULT)
