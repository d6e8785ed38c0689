"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, union-find; one line per component stays.

A line is what stands between line feeds, without blanks at its ends. Lines of fewer than ``min_chars`` characters are
left alone: ``MIN_CHARS`` unless the caller says otherwise. The registered query and the pipeline say ``ALL_LINES``, so
every line that is not blank takes part there. Lines shorter than ``GRAM`` have no shingles and are alike only if equal.
Of the lines of a component the one at the smallest (doc_id, position) stays, all others are removed; null ids come last.
Equal lines are one node, so a line that stands in a third of all documents is joined once.

Null and empty texts have no lines to remove. Rows that repeat an id are told apart by a digest of their text; fully
equal rows are treated alike, and both keep the line that stays. An empty table gives no rows. ``clean`` keeps all
columns and replaces the text; further columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import vectors
from basketry.llm.buckets import linked_contents, pair_similarities
from basketry.llm.near_duplicates import SIGNATURE, signature_rows
from basketry.llm.tables import id_and_text, stored

GRAM = 5
SIMILAR = 0.8
BANDS, ROWS = 9, 4
#: Pairs whose sketches agree in less go unjudged: of pairs at 0.8 that is 0.0002.
LEAST_SKETCH = 0.55
MIN_CHARS = 32
ALL_LINES = 1
CHUNK_CHARS = 1 << 19
BLANKS = " \t\n\x0b\f\r"
U = np.uint64


def grams(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all character shingles of the lines (each at least GRAM long), and where the lines' shingles begin."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(x) for x in lines])
    hashed = np.zeros(max(len(codes) - GRAM + 1, 0), np.uint64)
    for j in range(GRAM):
        hashed = hashed * vectors.STEP + codes[j : j + len(hashed)]
    counts = sizes - GRAM + 1
    bounds = np.concatenate(([0], np.cumsum(counts)))
    owner = np.repeat(np.arange(len(lines)), counts)
    at = np.arange(bounds[-1]) + owner * (GRAM - 1)
    return vectors.mix(hashed[at]), bounds


def min_hashes(lines: list[str], n: int) -> np.ndarray:
    hashed, bounds = grams(lines)
    hashed = (hashed >> U(32)).astype(np.uint32)  # half the width is enough for the shingles of a line, and twice as fast
    out = np.empty((len(lines), n), np.uint64)
    for k in range(n):
        odd = np.uint32(vectors.mix(np.array([k + 1], np.uint64))[0] >> U(32)) | np.uint32(1)
        out[:, k] = np.minimum.reduceat(hashed * odd, bounds[:-1])
    return out


def _blocks(lines: list[str]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, line in enumerate(lines):
        size += len(line)
        if size >= CHUNK_CHARS:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(lines):
        yield first, len(lines)


def digest(line: str) -> bytes:
    return hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def line_features(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner and hash of the distinct shingles of every line, each of weight 1."""
    hashed, bounds = grams(lines)
    owner = np.repeat(np.arange(len(lines)), np.diff(bounds))
    order = np.lexsort((hashed, owner))
    owner, hashed = owner[order], hashed[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (hashed[1:] != hashed[:-1]))[: len(owner)]
    return owner[new], hashed[new], np.ones(int(new.sum()))


def jaccard(left: list[str], right: list[str]) -> np.ndarray:
    """Exact Jaccard of the shingle sets of lines at equal places."""
    return pair_similarities(pa.array(left, pa.string()), pa.array(right, pa.string()), lambda x: line_features(x.to_pylist()))


def _lines(text: str, min_chars: int) -> Iterator[tuple[int, str]]:
    """Position and stripped content of the lines that take part; blank ones never do."""
    least = max(min_chars, 1)
    if len(text) >= least:
        for i, line in enumerate(text.split("\n")):
            line = line.strip(BLANKS)
            if len(line) >= least:
                yield i, line


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, source, place, node): every line that takes part; ``source`` is the digest of its text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sources, places, nodes = [], [], [], []
            for doc_id, source, text in zip(*batch.columns, strict=True):
                doc_id, source = doc_id.as_py(), source.as_py()
                for place, line in _lines(text.as_py(), min_chars):
                    ids.append(doc_id)
                    sources.append(source)
                    places.append(place)
                    nodes.append(digest(line))
            columns = [pa.array(ids, pa.int64()), pa.array(sources, pa.binary()), pa.array(places, pa.int32()), pa.array(nodes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "place", "node"])

    source = id_and_text(docs).select("doc_id", F.unhex(F.md5("text")).alias("source"), "text")
    return source.mapInArrow(rows, "doc_id long, source binary, place int, node binary")


def signatures(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(node, keys, sketch) of all lines that have shingles; equal lines of a batch are one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distinct = {digest(line): line for text in batch.column(0) for _, line in _lines(text.as_py(), max(min_chars, GRAM))}
            nodes, lines = list(distinct), list(distinct.values())
            for lo, hi in _blocks(lines):
                yield signature_rows(pa.array(nodes[lo:hi], pa.binary()), min_hashes(lines[lo:hi], BANDS * ROWS), BANDS, ROWS)

    return id_and_text(docs).select("text").mapInArrow(rows, SIGNATURE)


def _contents(docs: DataFrame, min_chars: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distinct = {digest(line): line for text in batch.column(0) for _, line in _lines(text.as_py(), max(min_chars, GRAM))}
            yield pa.RecordBatch.from_arrays([pa.array(list(distinct), pa.binary()), pa.array(list(distinct.values()), pa.string())], ["node", "line"])

    return id_and_text(docs).select("text").mapInArrow(rows, "node binary, line string")


def removed(docs: DataFrame, similar: float = SIMILAR, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, source, places): the positions of the lines to remove, one row per document that loses any."""
    found = stored(signatures(docs, min_chars), "line-signatures")
    lines = _contents(docs, min_chars).withColumnRenamed("line", "content")
    roots = linked_contents(found, lines, lambda x: line_features(x.to_pylist()), similar, LEAST_SKETCH)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "source", "place")
    found = occurrences(docs, min_chars)
    of_node = found.groupBy("node").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    named = of_node.join(roots, "node", "left").select("node", "first", "n", F.coalesce("root", "node").alias("root"))
    kept = named.groupBy("root").agg(F.min("first").alias("kept"), F.sum("n").alias("all")).where(F.col("all") > 1).drop("all")
    again = stored(named.join(kept, "root").select("node", "kept"), "repeated-lines")
    gone = found.join(again, "node").where(~place.eqNullSafe(F.col("kept")))
    return gone.groupBy("doc_id", "source").agg(F.array_sort(F.collect_set("place")).alias("places"))


def clean(docs: DataFrame, similar: float = SIMILAR, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(row, doc_id, text, n_lines, n_removed)``: the input row as a struct, the text without removed lines."""
    names = [f"`{c}`" for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("row")).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce("row.text", F.lit("")).alias("text"))
    rows = rows.withColumn("source", F.unhex(F.md5("text")))
    gone = removed(docs, similar, min_chars).withColumnsRenamed({"doc_id": "gone_id", "source": "gone_source"})
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("source") == F.col("gone_source")), "left")
    lines = F.split("text", "\n")
    # a map of removed positions keeps the test for each line constant
    left = F.map_from_entries(F.transform(F.array_distinct("places"), lambda p: F.struct(p, F.lit(True))))
    kept = F.get(F.transform(F.array(left), lambda m: F.filter(lines, lambda _, i: ~F.map_contains_key(m, i))), F.lit(0))
    text = F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_removed = F.coalesce(F.size("places"), F.lit(0)).cast("long")
    n_lines = F.when(F.col("text") == "", F.lit(0)).otherwise(F.size(lines)).cast("long")
    return joined.select("row", "doc_id", text.alias("text"), n_lines.alias("n_lines"), F.greatest(n_removed, F.lit(0).cast("long")).alias("n_removed"))
