"""Sentence spans against a plain search over all spans of all texts."""

import random
from collections import Counter

import pytest

from basketry.llm import sentence_spans as spans

SCHEMA = "doc_id long, text string, key string, other string, rep_id string, places string, span string"


def corpus(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    sentence = lambda: " ".join(r.choice(words) for _ in range(r.randint(1, 14))) + r.choice([". ", "! ", "\n", ".  ", "\x85"])
    shared = ["".join(sentence() for _ in range(r.randint(1, 9))) for _ in range(6)]
    texts = []
    for _ in range(40):
        parts = [r.choice(shared) if r.random() < 0.3 else sentence() for _ in range(r.randint(0, 12))]
        texts.append("".join(parts))
    return texts + texts[:5] + ["", " \n\t", None, "one", "one", shared[0] * 3]


def plain(rows):
    """Kept words and removed runs of every row, with the first span by (id, place) and null ids last."""
    order = lambda i: (i is None, i or 0)
    found = [(i, t or "", list(zip(*spans.text_spans(t or "", spans.SPAN, {}), strict=True))) for i, t in rows]
    first = {}
    for i, _, held in found:
        for place, _, digest in held:
            first[digest] = min(first.get(digest, ((True, 1 << 60), 0)), (order(i), place))
    out = []
    for i, text, held in found:
        words = text.split()
        gone = {p + j for p, n, d in held if first[d] != (order(i), p) for j in range(n)}
        out.append((i, tuple(w for j, w in enumerate(words) if j not in gone), sum(j - 1 not in gone for j in gone)))
    return Counter(out)


def test_result_equals_the_plain_search(spark):
    texts = corpus(7)
    rows = [(i, t) for i, t in enumerate(texts)]
    rows = [*rows, (3, texts[3]), (None, texts[8])]
    docs = spark.createDataFrame([(i, t, "k", "o", "r", "p", "s") for i, t in rows], SCHEMA).repartition(5)
    found = Counter((x.doc_id, tuple(x.kept_text.split()), x.n_spans) for x in spans.clean(docs).collect())
    assert found == plain(rows)
    assert sum(n for _, _, n in found) > 20


@pytest.mark.parametrize("seed", range(5))
def test_marks_lose_no_repeated_span(seed):
    texts = [t or "" for t in corpus(seed)]
    import numpy as np

    held = [spans.text_marks(t, spans.SPAN) for t in texts]
    values, n = np.unique(np.concatenate(held), return_counts=True)
    whole = Counter(d for t in texts for d in spans.text_spans(t, spans.SPAN, {})[2])
    kept = Counter(d for t, m in zip(texts, held, strict=True) for d in spans.text_spans(t, spans.SPAN, {}, np.intersect1d(m, values[n > 1]))[2])
    assert {d: k for d, k in whole.items() if k > 1} == {d: k for d, k in kept.items() if k > 1} != {}
    assert all(k <= whole[d] for d, k in kept.items())


def odd_texts(seed, n=300):
    r = random.Random(seed)
    parts = [*" \t\n\x0b\f\r.!?ab", *"\x1c\x85\xa0　é", "a b. ", "xy\n"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 200))) for _ in range(n)]


def test_sentences_and_words_equal_the_plain_rules():
    import re

    plain_break = re.compile(r"(?<=[.!?])[ \t\x0b\f\r]+|[ \t\x0b\f\r]*\n\s*")
    for text in odd_texts(3):
        cuts = [0]
        for m in plain_break.finditer(text):
            if m.end() > cuts[-1] and text[cuts[-1] : m.start()].strip():
                cuts.append(m.end())
        ends = [*cuts[1:], len(text)]
        assert spans.sentences(text) == [(a, b) for a, b in zip(cuts, ends, strict=True) if text[a:b].strip()]
        assert spans.word_starts(text).tolist() == [m.start() for m in re.finditer(r"\S+", text)]


def test_odd_blanks_are_all_that_end_words():
    odd = [c for c in map(chr, range(0x110000)) if c.isspace() and c not in " \t\n\x0b\f\r"]
    assert [c for c in map(chr, range(0x110000)) if spans.ODD_BLANK.fullmatch(c)] == odd
