"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

1. Each text gives candidate spans: the base patterns (which always count) and looser forms of the same kinds: e-mail
   addresses written out ("name (at) host dot org"), IPv6 addresses, 13 to 15 digit cards, phone numbers without "+".
2. Five labelers vote yes, no or nothing on each candidate: its pattern, its format, a gazetteer (top-level domains,
   country codes, issuer prefixes, address ranges), the words around it, and its borders.
3. Expectation-maximisation over the counted vote patterns of all candidates estimates each labeler's reliability per
   kind (a two-class mixture with independent votes), and with it the probability that a pattern is right.
4. A logistic span classifier, trained on these probabilities with the votes and the span's shape as input, gives each
   looser candidate its score; those of 0.5 or more that touch no base span are added.

A vote pattern with a shape is one of ``CODES`` numbers per kind. So the counts that steps 3 and 4 learn from have a
fixed size however many texts there are, and every candidate is in them.

Null and empty texts have no spans. Rows are judged one by one: repeated rows each get their own result. Offsets are
code points. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from ipaddress import IPv6Address

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.tables import id_and_text, stored

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "format", "gazetteer", "context", "border")
SHAPES = 4
CODES = 3 ** len(LABELERS) << SHAPES

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

WRITTEN_AT = re.compile(r"\s?(?:\(\s?at\s?\)|\[\s?at\s?\]|\{\s?at\s?\}|\sat\s)\s?", re.I)
WRITTEN_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:\s?(?:\(\s?dot\s?\)|\[\s?dot\s?\]|\{\s?dot\s?\}|\sdot\s|\.)\s?[A-Za-z]{2,24})+", re.I)
AT_WORD = re.compile(r"[\s(\[{]at[\s)\]}]", re.I)  # part of everything that WRITTEN_AT finds
IPV6 = re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Fa-f:.])")
LOOSE_PHONE = re.compile(r"[0-9]{2,5}\)?(?:[ ./-][0-9]{2,4}){2,4}(?![0-9])")

# Gazetteers and context words.
DOMAINS = frozenset("com org net edu gov int io info biz eu de fr es uk us it nl at ch be pt pl example test".split())
COUNTRIES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "86", "91")
NEAR = {
    "email": re.compile(r"e-?mail|contact|write to|correo|courriel|kontakt|schreib", re.I),
    "ip": re.compile(r"\bip\b|server|host|address|login|adresse|direcci", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|payment|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|call|tel\b|tel\.|mobile|fax|telefon|téléphone|teléfono|anruf|appel|llam", re.I),
}
AGAINST = re.compile(r"version|isbn|issn|section|chapter|invoice|order no|doi\b|rfc", re.I)
CONTEXT = 40

CANDIDATE = "kind int, first int, last int, base boolean, code int"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _runs(text: str) -> list[int]:
    return [m.start() for m in DIGITS.finditer(text)]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ is looked at once: the local part runs back to the last match at most."""
    end, at = 0, text.find("@")
    while at >= 0:
        host = DOMAIN.match(text, at + 1)
        start = at
        while host and start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            end = host.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _from_runs(pattern: re.Pattern, text: str, runs: list[int]) -> Iterator[tuple[int, int]]:
    """Matches of a pattern that starts with a digit; a leftmost match starts where a run of digits does."""
    end = 0
    for start in runs:
        if start >= end and (m := pattern.match(text, start)):
            end = m.end()
            yield start, end


def _part(digits: str) -> int:
    """The value of a part of an address; 256 stands for everything that is longer than three digits after its zeros."""
    digits = digits.lstrip("0")
    return int(digits or 0) if len(digits) <= 3 else 256


def _small(part: str) -> bool:
    return _part(part) <= 255


def is_ipv6(span: str) -> bool:
    """Eight groups, or fewer around one ::, of which two at least are written."""
    if sum(map(bool, span.split(":"))) < 2:
        return False
    try:
        IPv6Address(span)
    except ValueError:
        return False
    return True


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of the base patterns, a list for each kind."""
    runs = _runs(text)
    phones, end, at = [], 0, text.find("+") if runs else -1
    while at >= 0:
        if m := PHONE.match(text, at):
            end = m.end()
            if 8 <= len(only_digits(m[0])) <= 15:
                phones.append(m.span())
        at = text.find("+", max(at + 1, end))
    cards = []
    for a, b in _from_runs(CARD, text, runs):
        digits = only_digits(text[a:b]) if b - a >= 16 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            cards.append((a, b))
    return [
        list(emails(text)),
        [(a, b) for a, b in _from_runs(IP, text, runs) if all(map(_small, text[a:b].split(".")))],
        cards,
        phones,
    ]


def loose_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of the looser forms, a list for each kind."""
    out: list[list[tuple[int, int]]] = [[], [], [], []]
    if AT_WORD.search(text):
        for m in WRITTEN_AT.finditer(text):
            start = m.start()
            while start > 0 and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start() and (host := WRITTEN_HOST.match(text, m.end())):
                out[0].append((start, host.end()))
    if text.count(":") >= 2:
        out[1] = [m.span() for m in IPV6.finditer(text) if is_ipv6(m[0])]
    if runs := _runs(text):
        out[2] = [(a, b) for a, b in _from_runs(CARD, text, runs) if 13 <= b - a <= 19 and 13 <= len(d := only_digits(text[a:b])) <= 15 and luhn(d)]
        out[3] = [(a, b) for a, b in _from_runs(LOOSE_PHONE, text, runs) if 9 <= len(only_digits(text[a:b])) <= 12 and not (a and text[a - 1] in "+.-/")]
    return out


def votes(text: str, kind: int, start: int, end: int, base: bool) -> list[int]:
    """The labelers' votes on a span: 1 yes, -1 no, 0 nothing."""
    span, name = text[start:end], KINDS[kind]
    digits = only_digits(span)
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    if name == "email":
        good, known = len(span) <= 254 and ".." not in span, re.split(r"\W+", span.lower())[-1] in DOMAINS
    elif name == "ip":
        good, known = True, not base or 0 < _part(span.split(".")[0]) < 224
    elif name == "card":
        good, known = luhn(digits), digits[:1] in ("3", "4", "5", "6")
    else:
        good, known = 9 <= len(digits) <= 13, digits.startswith("0") or (base and digits.startswith(COUNTRIES))
    around = before + " " + after
    context = 1 if NEAR[name].search(around) else -1 if AGAINST.search(around) else 0
    glued = before[-1:].isalnum() or after[:1].isalnum()
    return [1 if base else 0, 1 if good else -1, 1 if known else 0, context, -1 if glued else 1]


def shape(text: str, start: int, end: int) -> int:
    """Four yes/no properties of a span as bits."""
    span = text[start:end]
    seen = (len(span) > 16, " " in span, "-" in span or "." in span, any(c in "()[]{}" for c in span))
    return sum(1 << i for i, x in enumerate(seen) if x)


def encode_votes(given: list[int], bits: int) -> int:
    return sum((v + 1) * 3**i for i, v in enumerate(given)) << SHAPES | bits


def decode_votes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes (n by labelers) and shape bits (n by shapes) of codes."""
    pattern = codes >> SHAPES
    given = np.stack([pattern // 3**i % 3 - 1 for i in range(len(LABELERS))], 1)
    return given, np.stack([codes >> i & 1 for i in range(SHAPES)], 1)


def candidates_of(text: str) -> list[tuple[int, int, int, bool, int]]:
    """(kind, start, end, base, code) of every candidate of a text."""
    if "@" not in text and not DIGITS.search(text) and "at" not in text.lower():
        return []
    found = []
    for base, spans in ((True, base_spans(text)), (False, loose_spans(text))):
        for kind, of_kind in enumerate(spans):
            for start, end in of_kind:
                found.append((kind, start, end, base, encode_votes(votes(text, kind, start, end, base), shape(text, start, end))))
    return found


def candidates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and its candidates."""
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("base", pa.bool_()), ("code", pa.int32())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "first", "last", "base", "code")
        for batch in batches:
            found = [[dict(zip(names, c, strict=True)) for c in candidates_of(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "candidates"])

    return id_and_text(docs).mapInArrow(rows, f"doc_id long, candidates array<struct<{CANDIDATE.replace(' ', ': ').replace(',:', ',')}>>")


def reliabilities(given: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """EM for one kind: the probability that each vote pattern is right, the vote tables, and the share of right spans.

    Tables have a row for each labeler and class with the probabilities of no, nothing and yes. The start is the share
    of yes among the votes given; a small prior count keeps every probability above zero.
    """
    right = 0.5 + 0.4 * np.tanh(given.sum(1))
    share, table = 0.5, np.full((given.shape[1], 2, 3), 1 / 3)
    for _ in range(rounds):
        before = right
        weight = np.stack([(1 - right) * counts, right * counts])
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        for j in range(given.shape[1]):
            for v in (-1, 0, 1):
                table[j, :, v + 1] = (weight[:, given[:, j] == v].sum(1) + 0.5) / (weight.sum(1) + 1.5)
        logs = np.log(table)
        score = np.log([1 - share, share]) + sum(logs[j][:, given[:, j] + 1].T for j in range(given.shape[1]))
        right = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -50, 50)))
        if np.abs(right - before).max() < 1e-6:
            break
    if (right * counts * given.sum(1)).sum() < ((1 - right) * counts * given.sum(1)).sum():  # the classes are swapped
        right, share, table = 1 - right, 1 - share, table[:, ::-1]
    return right, table, share


def inputs(codes: np.ndarray) -> np.ndarray:
    """The classifier's input: yes and no of each labeler, the shape bits, and a constant."""
    given, bits = decode_votes(codes)
    return np.concatenate([given == 1, given == -1, bits == 1, np.ones((len(codes), 1), bool)], 1).astype(float)


def fit_classifier(x: np.ndarray, target: np.ndarray, counts: np.ndarray, decay: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression on probable labels by Newton steps; every pattern counts as often as it occurs."""
    weights = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (counts * (p - target)) + decay * weights
        curve = (x * (counts * p * (1 - p))[:, None]).T @ x + decay * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def learn(found: DataFrame) -> dict[int, np.ndarray]:
    """The classifier's weights for each kind, from the counted codes of all candidates (at most kinds times CODES rows)."""
    each = found.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.code").count()
    rows = np.array([tuple(r) for r in each.collect()], np.int64).reshape(-1, 3)
    weights = {}
    for kind in range(len(KINDS)):
        mine = rows[rows[:, 0] == kind]
        if len(mine):
            mine = mine[np.argsort(mine[:, 1])]
            codes, counts = mine[:, 1], mine[:, 2].astype(float)
            right, _, _ = reliabilities(decode_votes(codes)[0], counts)
            weights[kind] = fit_classifier(inputs(codes), right, counts)
    return weights


def choose(found: list[dict], weights: dict[int, np.ndarray], threshold: float = 0.5) -> tuple[list[tuple], list[tuple]]:
    """(kind, start, end) of the base spans, and of all chosen ones, each by kind and start."""
    base = sorted((c["kind"], c["first"], c["last"]) for c in found if c["base"])
    loose = [c for c in found if not c["base"]]
    chosen = list(base)
    if loose:
        starts, ends = [], []  # the stretches that base spans cover, apart from one another
        for a, b in sorted((a, b) for _, a, b in base):
            if ends and a < ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
        reach = 0  # loose spans are taken by their start, so the last one taken reaches furthest
        for c in sorted(loose, key=lambda c: (c["first"], -c["last"], c["kind"])):
            before = bisect_left(starts, c["last"]) - 1
            if c["first"] < reach or (before >= 0 and c["first"] < ends[before]):
                continue
            if 1 / (1 + np.exp(-(inputs(np.array([c["code"]])) @ weights[c["kind"]])[0])) >= threshold:
                reach = c["last"]
                chosen.append((c["kind"], c["first"], c["last"]))
    return base, sorted(chosen)


def written(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find(docs: DataFrame) -> DataFrame:
    """One row per document: base counts by kind, the digest of the base spans, all spans, and how many were added."""
    found = stored(candidates(docs), "pii")
    weights = learn(found)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, texts, added = [], [], [], []
            for of_doc in batch.column(1).to_pylist():
                base, chosen = choose(of_doc, weights)
                counts.append([sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))])
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                texts.append(written(chosen))
                added.append(len(chosen) - len(base))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
            columns += [pa.array(digests, pa.string()), pa.array(texts, pa.string()), pa.array(added, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [f.split()[0] for f in RESULT.split(", ")])

    return found.mapInArrow(rows, RESULT)
