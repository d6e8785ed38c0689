"""Substring dedup by sliding sentence spans: sentences covered by a repeat of an earlier run of sentences are removed.

A sentence ends at ``.``, ``!`` or ``?`` before a blank, or at a line feed; blanks around it do not count. There are two
kinds of spans, each with a 128-bit digest (of 64-bit hashes of the words, or of digests of the sentences):

- every run of ``SPAN`` consecutive sentences, of whatever length;
- runs of ``WORDS`` words or somewhat more between cuts. Cuts are the sentence starts and, within a sentence, the word pairs
  that are the smallest hash of some ``WINDOW`` pairs in a row. From each cut the shortest such run to either side is a
  span, so a repeat of whole sentences that has ``WORDS`` words together is covered as a whole, be it one sentence or two.
  A repeat that is set in mid-sentence, or lies in a text without sentence ends, has its cuts at the same words but for
  ``WINDOW`` at its ends: from ``WORDS + 3 * WINDOW`` words on it is found, and ``WINDOW`` words at each end may stay.

Only what can repeat is digested. Every span holds a mark that its content alone decides: of each ``WORDS`` words in a row the
smallest hash of ``GRAM`` neighbouring words, or, for a shorter run of sentences, a hash of its words. Marks are counted over all
texts; a span whose mark occurs once cannot repeat and goes no further, so nothing is lost.

Equal texts are told by two 64-bit hashes. The row with the smallest doc_id stands for them; the other copies lose all their
spans without being digested. Spans of different texts meet by digest; the one at the smallest (doc_id, word) is the first, and
every word that another copy covers is removed. Spans are judged on the input, not on what is left. ``n_removed`` counts the
sentences of which nothing is left, ``n_spans`` the removed runs of words, also those within a sentence.

Null and empty texts have no sentences. Null ids come last. Rows that repeat an id are told apart by a hash of their
text; fully equal rows are treated alike and both keep the first spans. An empty table gives no rows. Further columns
are ignored. A very long text is read by one task, which needs some 100 bytes per word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import vectors
from basketry.llm.tables import discard, id_and_text, stored

SPAN = 3
WORDS = 25
WINDOW = 8
GRAM = 8
#: Blanks beyond those of ASCII text, which end words as well.
ODD_BLANK = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A task keeps the digests of this many sentences and those of one text.
KNOWN_SENTENCES = 1 << 16
#: Begins with one character class, which the search can look for alone.
BREAK = re.compile(r"[.!?\n](?:(?<=\n)\s*|(?<!\n)[ \t\x0b\f\r]+)")
OUT_ROWS = 50_000
RESULT = "doc_id long, n_sentences long, n_removed long, n_spans long, kept_text string"


def sentences(text: str) -> list[tuple[int, int]]:
    """Start of each sentence and of what follows it: together they are the whole text but for blanks at its start."""
    cuts = [0]
    for m in BREAK.finditer(text):
        first = m.start()
        if text[first] != "\n" or text[cuts[-1] : first].strip():
            cuts.append(m.end())
    if text[cuts[-1] :].strip():  # the others are not blank
        cuts.append(len(text))
    return list(zip(cuts, cuts[1:], strict=False))


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _sorted_set(numbers: np.ndarray) -> np.ndarray:
    """The distinct numbers of a short array."""
    numbers = np.sort(numbers)
    return numbers[np.append(True, numbers[1:] != numbers[:-1])[: len(numbers)]]


def _windows(numbers: np.ndarray, size: int) -> np.ndarray:
    """All runs of ``size`` neighbours, as a view."""
    return np.ndarray((len(numbers) - size + 1, size), numbers.dtype, numbers, 0, numbers.strides * 2)


def word_cuts(numbers: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The words at which runs begin and end, of a text with those word hashes and sentence starts, and its end."""
    n = len(numbers)
    at = np.zeros(0, np.int64)
    if n >= WINDOW:
        pairs = vectors.mix(np.append(np.uint64(0), numbers[:-1]) * vectors.STEP + numbers)
        first = np.zeros(n + 1, np.int64)
        first[begins + 1] = 1
        first = np.cumsum(first)
        inside = np.flatnonzero(first[WINDOW:] == first[:-WINDOW])  # no sentence starts within
        at = inside + _windows(pairs, WINDOW)[inside].argmin(axis=1)
    return _sorted_set(np.concatenate((begins, at, [n])))


def word_runs(cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the shortest runs of at least ``WORDS`` words from every cut to either side."""
    n = int(cuts[-1])
    starts, ends = cuts[cuts + WORDS <= n], cuts[cuts >= WORDS]
    starts, ends = (
        np.concatenate((starts, cuts[np.searchsorted(cuts, ends - WORDS, "right") - 1])),
        np.concatenate((cuts[np.searchsorted(cuts, starts + WORDS, "left")], ends)),
    )
    one = _sorted_set(starts * (n + 1) + ends)
    return one // (n + 1), one % (n + 1)


def _word_bytes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a text with plain blanks, and start and end of its words there."""
    data = np.frombuffer(ODD_BLANK.sub(" ", text).encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends, _ = vectors.word_spans(data, np.array([0, len(data)]))
    return data, starts, ends


def word_starts(text: str) -> np.ndarray:
    """The character at which every word begins."""
    data, starts, _ = _word_bytes(text)
    if len(data) != len(text):
        starts = (np.cumsum((data & 0xC0) != 0x80) - 1)[starts]
    return starts


def _words(text: str, at: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """First word of every sentence, and a hash of every word."""
    data, starts, ends = _word_bytes(text)
    firsts = np.array([a for a, _ in at], np.int64)
    if len(data) != len(text):
        firsts = np.flatnonzero((data & 0xC0) != 0x80)[firsts]  # from characters to bytes
    return np.searchsorted(starts, firsts), vectors.range_hashes(vectors.prefix_hashes(vectors.CODES[data]), starts, ends)


def _window_marks(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every ``WORDS`` words in a row the place and the hash of their mark."""
    n = len(numbers) - GRAM + 1
    if len(numbers) < WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = numbers[:n]
    for j in range(1, GRAM):
        grams = grams * vectors.STEP + numbers[j : n + j]
    grams = vectors.mix(grams)
    least = _windows(grams, WORDS - GRAM + 1).argmin(axis=1)
    least += np.arange(len(least))
    return least, grams[least]


def _run_marks(numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each run of words."""
    return vectors.mix(vectors.range_hashes(vectors.prefix_hashes(vectors.mix(numbers)), starts, ends))


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which hashes are among the known ones, which are sorted."""
    at = np.searchsorted(known, hashes)
    return known[np.minimum(at, len(known) - 1)] == hashes if len(known) else np.zeros(len(hashes), bool)


def _sentence_runs(begins: np.ndarray, n: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.append(begins, n)
    return bounds[:-span][: max(len(begins) - span + 1, 0)], bounds[span:]


def text_marks(text: str, span: int) -> np.ndarray:
    """The marks of a text; one that stands at several places is given twice."""
    at = sentences(text)
    begins, numbers = _words(text, at)
    places, hashes = _window_marks(numbers)
    once = np.append(True, places[1:] != places[:-1])[: len(places)]  # places of the first smallest hash never go back
    starts, ends = _sentence_runs(begins, len(numbers), span)
    short = ends - starts < WORDS
    found = np.sort(np.concatenate((hashes[once], _run_marks(numbers, starts[short], ends[short]))))
    return found[np.append([True, True], found[2:] != found[:-2])[: len(found)]]  # two of a kind stay


def text_spans(text: str, span: int, known: dict[str, bytes], marks: np.ndarray | None = None) -> tuple[list[int], list[int], list[bytes]]:
    """First word, number of words and digest of every span of a text that holds one of the marks, or of all its spans.

    ``known`` holds digests of sentences.
    """
    at = sentences(text)
    if not at:
        return [], [], []
    begins, numbers = _words(text, at)
    starts, ends = word_runs(word_cuts(numbers, begins))
    first, last = _sentence_runs(begins, len(numbers), span)
    which = np.arange(len(first))
    if marks is not None:
        marks = np.sort(marks)
        often = _among(_window_marks(numbers)[1], marks)
        held = often[starts] & often[ends - WORDS] if len(starts) else np.zeros(0, bool)
        starts, ends = starts[held], ends[held]
        short = last - first < WORDS
        held = np.zeros(len(first), bool)
        held[short] = _among(_run_marks(numbers, first[short], last[short]), marks)
        held[~short] = often[first[~short]] & often[last[~short] - WORDS] if len(often) else False
        first, last, which = first[held], last[held], which[held]
    data = numbers.tobytes()
    spans = [_digest(data[8 * i : 8 * j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
    if len(known) > KNOWN_SENTENCES:
        known.clear()
    own: dict[int, bytes] = {}  # digests by the number of the sentence
    for i in which.tolist():
        for j in range(i, i + span):
            if j not in own:
                part = text[at[j][0] : at[j][1]].strip()
                if part not in known:
                    known[part] = _digest(part.encode("utf-8", "surrogatepass"))
                own[j] = known[part]
        spans.append(_digest(b"sentences" + b"".join([own[j] for j in range(i, i + span)])))
    return [*starts.tolist(), *first.tolist()], [*(ends - starts).tolist(), *(last - first).tolist()], spans


def covered(text: str, at: list[tuple[int, int]], span: int) -> list[tuple[int, int]]:
    """First word and number of words of every span, without digests of the spans."""
    begins, numbers = _words(text, at)
    starts, ends = (np.concatenate(x) for x in zip(word_runs(word_cuts(numbers, begins)), _sentence_runs(begins, len(numbers), span), strict=True))
    return list(zip(starts.tolist(), (ends - starts).tolist(), strict=True))


def _source(docs: DataFrame) -> DataFrame:
    """(doc_id, key, other, text): ``key`` and ``other`` are two hashes of the text."""
    return id_and_text(docs).select("doc_id", F.xxhash64("text").alias("key"), F.xxhash64(F.lit(1), "text").alias("other"), "text")


def marks(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(key, mark): the marks of every row's text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found, n = [], [], 0
            for key, text in zip(batch.column(0).to_numpy(), batch.column(1), strict=True):
                found.append(text_marks(text.as_py(), span))
                keys.append(np.full(len(found[-1]), key))
                n += len(found[-1])
                if n > OUT_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(found).view(np.int64))], ["key", "mark"])
                    keys, found, n = [], [], 0
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(found).view(np.int64))], ["key", "mark"])

    return _source(docs).select("key", "text").mapInArrow(rows, "key long, mark long")


def _of_representative(source: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """Rows of ``source`` with those of a table by (rep_id, rep_key, rep_other): no copy but the smallest id meets one, so no key is hot."""
    same = F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("key") == F.col("rep_key")) & (F.col("other") == F.col("rep_other"))
    return source.join(table, same, how)


def representatives(docs: DataFrame) -> DataFrame:
    """(rep_id, rep_key, rep_other): the smallest id of every text."""
    texts = _source(docs).groupBy("key", "other").agg(F.min("doc_id").alias("rep_id"))
    return texts.withColumnsRenamed({"key": "rep_key", "other": "rep_other"})


def spans(docs: DataFrame, chosen: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, key, other, place, size, again, span): spans that may repeat, ``again`` if the text holds the same one before.

    ``chosen`` has the representatives whose texts hold repeated marks, with these marks.
    """
    kinds = {
        "doc_id": pa.int64(), "key": pa.int64(), "other": pa.int64(), "place": pa.int32(), "size": pa.int32(), "again": pa.bool_(), "span": pa.binary(),
    }

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}
        for batch in batches:
            for doc_id, key, other, text, often in zip(*batch.columns, strict=True):
                places, sizes, digests = text_spans(text.as_py(), span, known, often.values.to_numpy(zero_copy_only=False).view(np.uint64))
                seen: set[bytes] = set()
                again = [False] * len(digests)
                for i in sorted(range(len(digests)), key=places.__getitem__):
                    again[i] = digests[i] in seen
                    seen.add(digests[i])
                columns = [pa.repeat(c, len(places)) for c in (doc_id, key, other)]
                columns += [pa.array(c, k) for c, k in zip((places, sizes, again, digests), list(kinds.values())[3:], strict=True)]
                yield pa.RecordBatch.from_arrays(columns, list(kinds))

    joined = _of_representative(_source(docs), chosen, "inner").select("doc_id", "key", "other", "text", "marks")
    return joined.mapInArrow(rows, "doc_id long, key long, other long, place int, size int, again boolean, span binary")


def repeated(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(rep_id, rep_key, rep_other, places): every representative, and first word and size of its spans that are copies of an earlier one.

    Counts, first places and the marks of a text are partial aggregates, so what a third of all documents share is one row per
    task; the joins have many small rows per hot value, which adaptive execution splits.
    """
    held = stored(marks(docs, span), "marks")
    often = stored(held.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark"), "often")
    by_text = held.join(often, "mark", "left_semi").groupBy("key").agg(F.collect_set("mark").alias("marks"))
    by_text = stored(by_text.withColumnRenamed("key", "rep_key"), "marks-of-texts")
    discard(held, often)
    reps = stored(representatives(docs), "representatives")
    found = stored(spans(docs, reps.join(by_text, "rep_key"), span), "spans")
    discard(by_text)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "other")
    apart = found.where("not again")
    first = stored(apart.groupBy("span").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    later = apart.join(first, "span").where(~place.eqNullSafe(F.col("first"))).select("key", "other", "place", "size")
    later = later.union(found.where("again").select("key", "other", "place", "size"))
    gone = later.groupBy("key", "other").agg(F.collect_set(F.struct("place", "size")).alias("places"))
    gone = gone.withColumnsRenamed({"key": "rep_key", "other": "rep_other"})
    whole = stored(reps.join(gone, ["rep_key", "rep_other"], "left"), "removed")
    discard(reps, found, first)
    return whole


def clean(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """One row per document: doc_id, n_sentences, n_removed (whole sentences), n_spans (removed runs of words), kept_text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, first, places in zip(*batch.columns, strict=True):
                text, at = text.as_py(), sentences(text.as_py())
                kept, n_removed, n_spans = text, 0, 0
                gone = [(p["place"], p["size"]) for p in places.as_py() or ()] if first.as_py() else covered(text, at, span)
                if gone:
                    starts = word_starts(text)
                    change = np.zeros(len(starts) + 1, np.int64)
                    for place, size in gone:
                        change[place] += 1
                        change[place + size] -= 1
                    left = np.cumsum(change)[:-1] == 0
                    begins = np.searchsorted(starts, [a for a, _ in at])
                    n_removed = int((np.add.reduceat(left.astype(np.int64), begins) == 0).sum())
                    n_spans = int((~left & np.append(True, left[:-1])).sum())
                    bounds = np.concatenate(([at[0][0]], starts[1:], [len(text)]))
                    edges = np.flatnonzero(np.diff(left.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)  # runs of words that stay
                    kept = "".join([text[a:b] for a, b in bounds[edges].tolist()])
                out.append((doc_id.as_py(), len(at), n_removed, n_spans, kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [f.split()[0] for f in RESULT.split(", ")])

    joined = _of_representative(_source(docs), repeated(docs, span), "left")
    return joined.select("doc_id", "text", F.col("rep_key").isNotNull().alias("first"), "places").mapInArrow(rows, RESULT)
