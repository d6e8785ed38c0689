"""Packing tokenized documents into sequences: bounded-space online best fit.

A document's tokens and the end token form one piece, or, if they are more than a sequence holds, full pieces after a
first, shorter one. Pieces are dealt by hash into groups of about ``GROUP_TOKENS`` tokens, and each group is packed by
its own open bins: a fixed number of them, in a bitset keyed by free space. A piece goes to the fullest bin that still
has room; when one bin too many is open, the fullest closes. The state of a group is a few kilobytes whatever its size.

Null and empty texts are one piece that holds the end token only. Repeated rows are packed each for itself, with the
same ``doc_id`` in several places. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.tables import id_and_text, stored

LENGTH = 1024
END = 2
OPEN_BINS = 256
GROUP_TOKENS = 1 << 26
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Characters whose classes are the same in every Unicode version in use; other texts go through the slower library.
UNCOMMON = re.compile("[^\\x00-\\u036f\\u2010-\\u2027\\u20ac]|<\\|endoftext\\|>")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _encoders(path: str):
    """The tokenizer of a file, and a faster encoder built from the same vocabulary and merges.

    ``byte_level_ranks`` turns the file's printable stand-ins back into bytes.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    model = json.loads(open(path, encoding="utf-8").read())["model"]
    slow = Tokenizer.from_file(path)
    printable = sorted(ByteLevel.alphabet())
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    byte_of = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}
    assert sorted(byte_of) == printable
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte_of for c in token) and token != "<|endoftext|>"}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return slow, tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, path: str) -> np.ndarray:
    """The ids that the tokenizer file gives for a text, without special tokens around it."""
    slow, fast = _encoders(path)
    if UNCOMMON.search(text):
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    return np.array(fast.encode_ordinary(text), np.uint32)


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """Start and length of each piece of n tokens."""
    if n <= length:
        return [(0, n)]
    first = n % length
    return ([(0, first)] if first else []) + [(i, length) for i in range(first, n, length)]


def pieces(docs: DataFrame, length: int = LENGTH, end: int = END, path: str | None = None, tokens: bool = False) -> DataFrame:
    """All pieces: doc_id, piece, start, length, ids_crc32; with ``tokens`` also their ids."""
    path = path or vocabulary_path()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, ids_out = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py(), path), np.uint32(end)).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), length)):
                    out.append((doc_id, k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
                    if tokens:
                        ids_out.append(ids[start : start + n])
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
            if tokens:
                names, columns = [*names, "ids"], [*columns, pa.array(ids_out, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return id_and_text(docs).mapInArrow(rows, PIECES + (", ids array<long>" if tokens else ""))


class OpenBins:
    """Open bins by free space: bit f of ``free`` is set if some open bin has f tokens left."""

    def __init__(self, length: int, limit: int):
        self.length, self.limit, self.free, self.count, self.next = length, limit, 0, 0, 0
        self.by_free: dict[int, list[int]] = {}

    def _pop(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.free ^= 1 << free
        self.count -= 1
        return number

    def place(self, n: int) -> tuple[int, int]:
        """The bin and the offset for n tokens."""
        roomy = self.free >> n
        if roomy:
            free = n + (roomy & -roomy).bit_length() - 1
            number = self._pop(free)
        else:
            free, number = self.length, self.next
            self.next += 1
        left = free - n
        if left:
            self.by_free.setdefault(left, []).append(number)
            self.free |= 1 << left
            self.count += 1
            if self.count > self.limit:
                self._pop((self.free & -self.free).bit_length() - 1)
        return number, self.length - free


def place(found: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """``found`` with sequence_id and offset. It should be a written table: it is read twice."""
    total = found.agg(F.sum("length")).first()[0] or 0
    groups = max(1, math.ceil(total / group_tokens))
    names = found.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, base = OpenBins(length, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            numbers = pa.array([base + number for number, _ in placed], pa.int64())
            offsets = pa.array([offset for _, offset in placed], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, numbers, offsets], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
    # pieces of a group in an order that a retried task repeats, and that mixes long and short ones
    mixed = found.repartition(groups, F.xxhash64("doc_id", "piece")).sortWithinPartitions(F.xxhash64("doc_id", "piece"), "doc_id", "piece", "ids_crc32")
    return mixed.mapInArrow(pack, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, length: int = LENGTH, end: int = END, path: str | None = None, open_bins: int = OPEN_BINS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(stored(pieces(docs, length, end, path), "pieces"), length, open_bins)


def sequences(docs: DataFrame, length: int = LENGTH, end: int = END, path: str | None = None, open_bins: int = OPEN_BINS) -> DataFrame:
    """The packed token ids themselves: sequence_id, ids (at most ``length``), doc_ids in their order."""
    packed = place(stored(pieces(docs, length, end, path, tokens=True), "pieces"), length, open_bins)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.col("parts.doc_id").alias("doc_ids")
    )
