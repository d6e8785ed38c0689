"""Runs against a search over all periods, and the query's columns against a plain version."""

import hashlib
import re
import zlib

import numpy as np
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from basketry.llm import periodic_runs, queries


def brute(words, least=12):
    """(start, end, period) by start and period: every period is tried at every place."""
    best = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                best.setdefault((i, j + q), q)  # periods come in ascending order
            i = max(j, i + 1)
    return sorted(((s, e, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def found(words, least=12, owner=None):
    return list(zip(*(x.tolist() for x in periodic_runs.runs(np.array(words, np.int64), owner, least)), strict=True))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 15)), max_size=6), st.sampled_from([2, 4, 12]))
def test_pieces_repeated(pieces, least):
    words = [w for piece, times in pieces for w in piece * times]
    assert found(words, least) == brute(words, least)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=90))
def test_two_letters(words):
    assert found(words, 2) == brute(words, 2)


def test_words_with_many_runs():
    a, b = "a", "ab"
    while len(b) < 400:
        a, b = b, b + a
    fibonacci = [ord(c) for c in b[:400]]
    thue_morse = [bin(i).count("1") & 1 for i in range(400)]
    nested = ([0] * 5 + [1]) * 4 + [2]
    for words in (fibonacci, thue_morse, nested * 9, [0] * 500, ([0, 0, 1] * 3 + [0, 0]) * 6, [0, 0, 1] * 20 + [0] + [0, 0, 1] * 20):
        assert found(words, 2) == brute(words, 2)


def test_texts_side_by_side_do_not_mix():
    owner = np.array([0] * 13 + [1] * 13 + [2] * 3)
    words = [4] * 12 + [-1] + [4] * 12 + [-1] + [4, 4, -1]
    assert found(words, 12, owner) == [(0, 12, 1), (13, 25, 1)]


def plain(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    runs = brute([numbers[w] for w in words])
    drop = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2])) if runs else None
    longest = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc_id, len(runs), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def test_query(spark):
    rows = queries.QUERIES["op13_periodic_runs"](spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    wanted = [plain(*d) for d in docs]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, wanted))
    assert sum(w[1] for w in wanted) > 20


def test_odd_documents(spark):
    text = "x y\tz\n" * 40
    texts = [(1, text), (1, text), (None, "é " * 30), (3, None), (4, ""), (5, " \n\t "), (6, "a"), (-7, "w " * 20_000 + "v"), (8, "ß ü ß ü " * 20)]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in texts], "doc_id long, text string, period string, start int")
    rows = periodic_runs.find(docs, rewrite=True)
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    wanted = [plain(i, t) for i, t in texts if i != -7]
    got = [tuple(r) for r in rows.where("doc_id is null or doc_id <> -7").select(columns).collect()]
    assert sorted(map(str, got)) == sorted(map(str, wanted))
    plain_rows = {r.doc_id: r for r in periodic_runs.find(docs).collect()}
    assert plain_rows[1].collapsed == "x y z" and plain_rows[1].n_words == 120
    assert (plain_rows[-7].start, plain_rows[-7].length, plain_rows[-7].period, plain_rows[-7].collapsed) == (0, 20_000, 1, "w v")
    assert plain_rows[8].period == 1 and plain_rows[3].collapsed == plain_rows[5].collapsed == ""
    assert periodic_runs.find(docs.limit(0)).count() == 0


def test_one_document_in_ten_is_rewritten():
    assert abs(sum(periodic_runs.repeated_tail(i, 50) is not None for i in range(5000)) / 5000 - 0.1) < 0.02
    assert periodic_runs.repeated_tail(None, 50) is None
    assert all(periodic_runs.repeated_tail(i, 0) is None for i in range(50))
