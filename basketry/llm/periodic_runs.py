"""Periodic runs of words, found with a dictionary of basic factors.

The words of a text get numbers; factors of length 1, 2, 4, ... get names, equal names for equal factors (the name of a longer
factor is the pair of the names of its halves). At length L the equal factors whose starts lie less than 2 L apart propose the
periods from L to 2 L - 1. Starts at most L / 2 apart form arithmetic progressions, whose difference is the factor's own period
and was found at a smaller length; a progression therefore counts as one place. Two progressions propose the distance of their
firsts, of their lasts, and of each member of the one to the first of the next; at most three later progressions of a factor are near enough. That is
at most a few proposals per word and length, also in a text that is one word over and over, and every run gets one: inside a run
a factor and its copy one period later lie in two progressions, and either their beginnings or their ends agree, or the runs of
the factor's own period touch. Proposals are extended to both sides by comparing names from long to short; of runs with the same
start and end the smallest period stays.

Words are maximal stretches of bytes other than blank and \\t to \\r. Texts are worked on whole, many short ones at a time with
names that are never shared between texts; memory is a few numbers per word and length for the texts of one block, or for one
longer text. No shuffle.

A null or empty text has no words, no runs and the digests of empty strings. Rows are independent: repeated rows give equal rows, a null id is
kept (and rewrites nothing), an empty table gives no rows. Ties for the longest run go to the smallest start, then period. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from basketry.llm import vectors
from basketry.llm.tables import id_and_text

LEAST_LENGTH = 12
RESULT = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string"

Names = list[np.ndarray]


def _named(at: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names for all places (-1 where the factor occurs once), and the repeated places by name and start, with their names."""
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = key[1:] == key[:-1]
    again = same[:-1] | same[1:]
    number = np.cumsum(~same[:-1][again]) - 1
    at = at[again]
    names = np.full(n + 1, -1, np.int32)
    names[at] = number
    return names, at, number


def _proposals(at: np.ndarray, name: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods proposed by the equal factors of one length."""
    if not len(at):
        return at, at
    joined = (name[1:] == name[:-1]) & (2 * (at[1:] - at[:-1]) <= length)
    first = np.flatnonzero(np.concatenate(([True], ~joined)))
    last = np.concatenate((first[1:], [len(at)])) - 1
    starts, periods = [], []
    for later in (1, 2, 3):
        if len(first) <= later:
            break
        near = np.flatnonzero(name[first[later:]] == name[first[:-later]])
        for edge in (first, last):
            starts.append(at[edge[near]])
            periods.append(at[edge[near + later]] - at[edge[near]])
    group = np.cumsum(np.concatenate(([True], ~joined))) - 1
    inner = np.flatnonzero((last > first)[group] & (group + 1 < len(first)))
    following = first[group[inner] + 1]
    inner, following = (x[name[following] == name[inner]] for x in (inner, following))
    starts.append(at[inner])
    periods.append(at[following] - at[inner])
    start, period = np.concatenate(starts), np.concatenate(periods)
    fits = (period >= length) & (period < 2 * length)
    start, period = start[fits], period[fits]
    order = np.lexsort((start, period))
    start, period = start[order], period[order]
    # a proposal that begins inside the stretch its forerunner of the same period is known to match leads to the same run
    new = np.ones(len(start), bool)
    new[1:] = (period[1:] != period[:-1]) | (start[1:] - start[:-1] > length)
    return start[new], period[new]


def _extended(names: Names, start: np.ndarray, period: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches around the starts that keep the periods."""
    right, left = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    for level in range(len(names) - 1, -1, -1):
        name, length = names[level], 1 << level
        for forward, grown in ((True, right), (False, left)):
            active = np.arange(len(start))
            while len(active):
                a = start[active] + grown[active] if forward else start[active] - grown[active] - length
                b = a + period[active]
                x, y = name[np.where(a < 0, n, a)], name[np.where((a < 0) | (b > n), n, b)]
                active = active[(x == y) & (x >= 0)]
                grown[active] += length
                if level < len(names) - 1:
                    break
    return start - left, start + right + period


def runs(words: np.ndarray, owner: np.ndarray | None = None, least: int = LEAST_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods, by start and period, of all runs in a sequence of word numbers.

    ``owner`` numbers the texts of several sequences joined together; between two of them stands a -1, which belongs to no run.
    """
    n = len(words)
    owner = np.zeros(n, np.int64) if owner is None else owner
    at = np.flatnonzero(words >= 0)
    key = owner[at] * (words.max(initial=0) + 1) + words[at]  # equal for equal words of one text
    longest = int(np.bincount(owner[at]).max(initial=0)) if len(at) else 0
    names: Names = []
    starts, periods, length = [], [], 1
    while len(at) and 2 * length <= max(longest, 2):
        name, at, number = _named(at, key, n)
        names.append(name)
        start, period = _proposals(at, number, length)
        starts.append(start)
        periods.append(period)
        at = np.sort(at)
        at = at[at + length < n]
        at = at[name[at + length] >= 0]
        key = name[at].astype(np.int64) * (n + 1) + name[at + length]
        length *= 2
    if not starts:
        return (np.zeros(0, np.int64),) * 3
    start, period = np.concatenate(starts), np.concatenate(periods)
    start, end = _extended(names, start, period, n)
    long = end - start >= np.maximum(least, 2 * period)
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def repeated_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) if the words of this document from a on are to repeat with period p: one in ten, by the id's hash."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """A number for each word, the words by number (each with a blank behind it), and where the texts' words begin."""
    begin, end, first = vectors.word_spans(data, offsets)
    bounds = np.concatenate(([0], np.cumsum(end - begin))).astype(np.int64)
    solid = np.ascontiguousarray(data[vectors.SOLID[data]])
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(solid)]).dictionary_encode()
    spelled = pc.binary_join_element_wise(found.dictionary, pa.scalar(b" ", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), spelled, first


def _summaries(ids: list, data: np.ndarray, offsets: np.ndarray, rewrite: bool, least: int) -> Iterator[tuple]:
    numbers, spelled, first = _words(data, offsets)
    counts = np.diff(first)
    if rewrite:
        for d in range(len(ids)):
            tail = repeated_tail(ids[d], int(counts[d]))
            if tail is not None:
                a, p = tail
                mine = numbers[first[d] : first[d + 1]]
                mine[a:] = np.resize(mine[a : a + p], len(mine) - a)
    owner = np.repeat(np.arange(len(ids)), counts + 1)  # a mark behind the words of each text
    place = first[:-1] + np.arange(len(ids))
    words = np.full(len(owner), -1, np.int64)
    solid = np.ones(len(owner), bool)
    solid[place + counts] = False
    words[solid] = numbers
    start, end, period = runs(words, owner, least)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, start + period, 1)
    np.add.at(covered, end, -1)
    stays = (np.cumsum(covered)[:-1] == 0) & solid
    kept = spelled.take(pa.array(words[stays]))
    edges = np.frombuffer(kept.buffers()[1], np.int64)[: len(kept) + 1]
    content = memoryview(kept.buffers()[2]) if kept.buffers()[2] is not None else memoryview(b"")
    kept_first = np.concatenate(([0], np.cumsum(stays)))[np.concatenate((place, [len(words)]))]
    by_doc = np.searchsorted(start, np.concatenate((place, [len(words)])))
    for d in range(len(ids)):
        low, high = edges[kept_first[d]], edges[kept_first[d + 1]]
        text = bytes(content[low : max(low, high - 1)])
        s, e, p = (x[by_doc[d] : by_doc[d + 1]] for x in (start, end, period))
        s, lengths = s - place[d], e - s
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in zip(s.tolist(), lengths.tolist(), p.tolist(), strict=True))
        best = int(np.lexsort((p, s, -lengths))[0]) if len(s) else None
        longest = (None,) * 4 if best is None else (int(s[best]), int(lengths[best]), int(p[best]), 1000 * int(lengths[best]) // int(p[best]))
        yield (ids[d], int(counts[d]), len(s), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest(), text.decode())


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: bool = False, least: int = LEAST_LENGTH, texts: bool = True) -> DataFrame:
    """One row per document: its number of runs, the longest one, digests of all runs and of the text without repeats.

    ``collapsed`` holds the words outside the later periods of all runs, joined by blanks (null without ``texts``). ``rewrite`` first makes the tails of one document
    in ten periodic (``repeated_tail``), for trials on texts that hold few runs.
    """
    names = [f.split(" ")[0] for f in RESULT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 3

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = vectors.flat(batch.column(1))
            ids = batch.column(0).to_pylist()
            for a, b in vectors.chunks(offsets):
                part = data[offsets[a] : offsets[b]]
                found = list(_summaries(ids[a:b], part, offsets[a : b + 1] - offsets[a], rewrite, least))
                columns = list(zip(*found, strict=True))
                if not texts:
                    columns[-1] = [None] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return id_and_text(docs, id_col, text_col).mapInArrow(rows, RESULT)
