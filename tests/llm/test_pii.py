"""Base spans against a plain version over random texts, written forms, and texts that are hard to work on."""

import random
import re
from time import monotonic

import pytest

from basketry.llm import pii


def plain(text):
    """(kind, start, end) of the base patterns, by kind and start: every match in turn, failing ones dropped."""

    def luhn(digits):
        total = 0
        for i, d in enumerate(reversed(digits)):
            n = int(d) * (1 + i % 2)
            total += n - 9 if n > 9 else n
        return total % 10 == 0

    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            found.append((3, *m.span()))
    return sorted(found)


def test_base_spans_equal_a_plain_version():
    draw = random.Random(1)
    pieces = ["a.b@x.org", "10.0.0.1", "4111 1111 1111 1111", "+49 (30) 123456", "@", ".", "-", " ", "+", "9", "300.1.1.1", "x", "é", "(", "1.2.3.4.5.6", "0", "4111-1111-1111-1111-7", "@@a.b", "\n"]
    for _ in range(3000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(0, 25)))
        got = sorted((kind, a, b) for kind, spans in enumerate(pii.base_spans(text)) for a, b in spans)
        assert got == plain(text), text


@pytest.mark.parametrize("text", [
    "jane (at) example.com", "jane ( at ) example.com", "jane[at]example[dot]com", "jane at example (dot) com", "jane at example.com", "jane {at} example dot com",
])
def test_written_addresses_alone_in_a_text(text):
    assert pii.loose_spans(text)[0] == [(0, len(text))] or pii.loose_spans(text)[0][0][1] == len(text)


def test_long_local_parts_are_whole():
    assert pii.loose_spans("x" * 100 + "(at)example.com")[0] == [(0, 115)]


def test_network_addresses():
    for good in ("2001:db8::1", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fe80::1:2"):
        assert pii.loose_spans(f"to {good} now")[1] == [(3, 3 + len(good))], good
    for other in ("12:30:45", "::", "1::2::3", "a:b", "12345::1"):
        assert pii.loose_spans(f"to {other} now")[1] == [], other


def test_very_many_leading_zeros():
    text = "0" * 5000 + "1.2.3.4 and " + "1" * 6000 + ".2.3.4"
    assert pii.base_spans(text)[1] == [(0, 5007)]
    assert [c[:3] for c in pii.candidates_of(text) if c[3]] == [(1, 0, 5007)]


def test_many_candidates_of_one_text(spark):
    text = " call 030 123 456 78, ip 10.0.0.1, card 4111 1111 1111 1111;" * 6000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = monotonic()
    row = pii.find(docs).first()
    assert monotonic() - start < 60 and (row.n_ip, row.n_card) == (6000, 6000)


def test_chosen_spans_do_not_overlap():
    draw = random.Random(2)
    weights = {k: pii.np.zeros(len(pii.inputs(pii.np.array([0]))[0])) for k in range(4)}  # every score is one half: all are taken if free
    for _ in range(300):
        found = []
        for _ in range(draw.randint(0, 12)):
            a = draw.randint(0, 60)
            found.append({"kind": draw.randint(0, 3), "first": a, "last": a + draw.randint(1, 12), "base": draw.random() < 0.4, "code": 0})
        base, chosen = pii.choose(found, weights)
        taken = sorted((a, b) for _, a, b in base)
        expected = list(base)
        for c in sorted((c for c in found if not c["base"]), key=lambda c: (c["first"], -c["last"], c["kind"])):
            if not any(a < c["last"] and c["first"] < b for a, b in taken):
                taken.append((c["first"], c["last"]))
                expected.append((c["kind"], c["first"], c["last"]))
        assert chosen == sorted(expected)
