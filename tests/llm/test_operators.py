"""The operators against brute force on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from basketry.llm import decontamination, line_dedup, near_duplicates, repeated_bytes, sentence_spans, toxicity
from basketry.llm.linking import components

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, node string, row string, root string, class_id string, places string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "n", "r", None, "c", "p") for i, t in rows], SCHEMA)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def edited(text, seed, n):
    r, words = random.Random(seed), text.split()
    for i in r.sample(range(len(words)), n):
        words[i] = "zz"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    a, b = prose(1, 200), prose(2, 150)
    docs = [(1, a), (2, a), (3, edited(a, 5, 2)), (4, b), (5, prose(3, 90)), (6, None), (7, ""), (8, "one"), (9, "one"), (None, b), (11, " \n\t")]
    docs += [(20 + i, edited(b, i, 1)) for i in range(25)] + [(60, prose(4, 3000)), (61, prose(5, 120) + ". " + a), (5, prose(3, 90))]
    return docs


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (50, 40)], "a int, b int")
    found = dict(components(edges).collect())
    assert found == {**{i: 0 for i in range(1, 41)}, 50: 0, 101: 100}


def test_near_duplicates(spark, rows):
    found = near_duplicates.classes(table(spark, rows)).collect()
    assert len(found) == len(rows)
    classes = dict((r.doc_id, r.class_id) for r in found)
    assert classes[2] == classes[3] == 1 and classes[8] == classes[9] == 8
    assert all(classes[i] == 4 for i in [None, 4, *range(20, 45)])
    assert all(classes[i] == i for i in (5, 6, 7, 11, 60, 61))
    kept = near_duplicates.keep_one(table(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == [1, 4, 5, 6, 7, 8, 11, 60, 61]
    assert near_duplicates.classes(table(spark, [])).count() == 0


def brute_bytes(rows, length=100):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if (w := data[i : i + length]) in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        left = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def test_repeated_bytes(spark, rows):
    rows = rows[:-1] + [(70, "ab" * 300), (71, "é" * 120 + rows[0][1][50:400] + "x")]
    found = repeated_bytes.clean(table(spark, rows)).drop("kept").collect()
    assert Counter(map(tuple, found)) == Counter(brute_bytes(rows))
    assert repeated_bytes.clean(table(spark, [])).count() == 0


def test_repeated_bytes_of_other_lengths(spark, rows):
    with pytest.raises(ValueError, match="99"):
        repeated_bytes.clean(table(spark, rows), 99)
    found = repeated_bytes.clean(table(spark, rows[:8]), 130).drop("kept").collect()
    assert Counter(map(tuple, found)) == Counter(brute_bytes(rows[:8], 130))


def test_copies_are_digested_by_stretches(spark):
    """A long copied passage in many documents: a row per stretch, and windows only where the passage begins and ends."""
    passage = prose(31, 300)
    rows = [(i, f"{prose(100 + i, 40)} {passage} {prose(200 + i, 40)}") for i in range(6)]
    docs = table(spark, rows)
    n_windows = 6 * (len(passage) - 99)
    found = repeated_bytes.stretches(docs)
    assert found.agg({"size": "sum"}).first()[0] >= n_windows
    assert found.count() < n_windows / 10
    assert Counter(map(tuple, repeated_bytes.clean(docs).drop("kept").collect())) == Counter(brute_bytes(rows))


def test_line_dedup(spark):
    x, y = prose(11, 12), prose(12, 12)
    docs = [(1, f"{x}\nshort\n{y}"), (2, f"short\n{x[:-3]}abc"), (3, f"{y}\n{y}\n{prose(13, 12)}"), (4, None), (5, ""), (None, f"  {x} ")]
    found = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.clean(table(spark, docs)).collect()}
    assert found[1] == (docs[0][1], 0) and found[2] == ("short", 1) and found[3] == (prose(13, 12), 2)
    assert found[4] == found[5] == ("", 0) and found[None] == ("", 1)
    assert line_dedup.clean(table(spark, [])).count() == 0


def test_registered_line_dedup_takes_short_lines(spark, tmp_path):
    import corpus_pipeline
    from basketry.llm import queries

    docs = [(1, "Read more\nok\nfirst words of one"), (2, " Read more \n\nok\nother words of two\n"), (3, "ok"), (4, None), (5, "Read more!")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    found = {r.doc_id: (r.n_removed, r.kept_sha256) for r in queries.QUERIES["op7_line_dedup"](spark, str(tmp_path)).collect()}
    assert found == {1: (0, sha(docs[0][1])), 2: (2, sha("\nother words of two\n")), 3: (1, sha("")), 4: (0, sha("")), 5: (1, sha(""))}
    left = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "").collect()}
    assert left == {1: docs[0][1], 2: "\nother words of two\n", 4: None}


def test_exact_line_jaccard():
    a, b = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxy!"
    sets = [{s[i : i + 5] for i in range(len(s) - 4)} for s in (a, b)]
    assert line_dedup.jaccard([a, a], [b, a]).tolist() == [len(sets[0] & sets[1]) / len(sets[0] | sets[1]), 1.0]


def test_sentence_spans(spark):
    docs = [(1, "A one. B two. C three. D four."), (2, "X. B two.  C three.\nD four. Y."), (3, "B two. C three."), (4, None), (5, "")]
    found = {r.doc_id: r for r in sentence_spans.clean(table(spark, docs)).collect()}
    assert found[1].kept_text == docs[0][1] and found[3].kept_text == docs[2][1]
    assert found[2].kept_text == "X. Y." and (found[2].n_removed, found[2].n_spans) == (3, 1)
    assert found[4].n_sentences == found[5].n_sentences == 0
    assert sentence_spans.clean(table(spark, [])).count() == 0


def test_sentence_spans_of_long_passages(spark):
    one, two, bare = prose(31, 30), f"{prose(32, 14)}. {prose(33, 14)}.", prose(34, 60)
    docs = [(1, f"{one}. {two} Out."), (2, f"Lead. {one}. Tail."), (3, f"Lead.\n{two}\nTail."), (4, bare)]
    docs += [(5, f"{prose(35, 9)} {bare} {prose(36, 9)}"), (6, f"{prose(37, 5)} {prose(38, 20)}. {prose(39, 20)}. {prose(40, 20)} {prose(41, 5)}")]
    docs += [(7, f"{prose(42, 5)} {prose(38, 20)}. {prose(39, 20)}. {prose(40, 20)} {prose(43, 5)}"), (8, f"Lead. {prose(32, 14)}. Tail.")]
    found = {r.doc_id: r for r in sentence_spans.clean(table(spark, docs)).collect()}
    assert all(found[i].kept_text == docs[i - 1][1] and found[i].n_spans == 0 for i in (1, 4, 6, 8))
    assert found[2].kept_text == "Lead. Tail." and (found[2].n_removed, found[2].n_spans) == (1, 1)
    assert found[3].kept_text == "Lead.\nTail." and (found[3].n_removed, found[3].n_spans) == (2, 1)
    for i, alone in ((5, 18), (7, 10)):
        text = found[i].kept_text
        assert found[i].n_spans == 1 and alone <= len(text.split()) <= alone + 2 * (sentence_spans.WINDOW + 1)
        assert text.startswith(docs[i - 1][1][:20]) and text.endswith(docs[i - 1][1][-20:])


def test_repeated_runs_of_words_are_found_wherever_they_stand():
    r = random.Random(5)
    for _ in range(300):
        passage = [str(r.randint(0, 50)) for _ in range(sentence_spans.WORDS + 3 * sentence_spans.WINDOW + 1)]
        sides = []
        for side in "ab":
            first = r.randint(0, 30)
            text = " ".join([f"{side}{i}" for i in range(first)] + passage + [f"{side}{i}" for i in range(r.randint(0, 30))])
            sides.append({(p - first, n, d) for p, n, d in zip(*sentence_spans.text_spans(text, 3, {}), strict=True)})
        covered = {p + i for p, n, _ in sides[0] & sides[1] for i in range(n)}
        inner = range(sentence_spans.WINDOW + 1, len(passage) - sentence_spans.WINDOW - 1)
        assert covered >= set(inner)


def test_decontamination(spark):
    item = prose(21, 30)
    docs = [(1, f"{prose(22, 50)} {item.upper()} {prose(23, 50)}"), (2, prose(24, 100)), (3, edited(item, 1, 4)), (4, None), (5, ""), (None, item)]
    tests = spark.createDataFrame([(7, item, "t"), (8, "two words", "t"), (9, None, "t")], "item_id long, text string, doc_id string")
    found = {r.doc_id: (r.item_id, r.score) for r in decontamination.matches(table(spark, docs), tests).collect()}
    assert found[1] == found[None] == (7, 1.0) and found[3][0] == 7 and 0.5 <= found[3][1] < 1 and len(found) == 3
    assert sorted(r.doc_id for r in decontamination.keep_clean(table(spark, docs), tests).collect()) == [2, 4, 5]
    assert decontamination.matches(table(spark, docs), tests.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [11, 2000])
def test_decontamination_of_common_edited_copies(spark, copies):
    words = prose(25, 40).split()
    copy = " ".join("zz" if i % 5 == 4 else w for i, w in enumerate(words))
    docs = [(i, f"{prose(1000 + i, 5)} {copy} {prose(5000 + i, 5)}") for i in range(copies)] + [(-1, prose(26, 100))]
    tests = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    found = decontamination.matches(table(spark, docs), tests).collect()
    assert sorted(r.doc_id for r in found) == list(range(copies)) and all(r.score >= 0.7 for r in found)
    assert [r.doc_id for r in decontamination.keep_clean(table(spark, docs), tests).collect()] == [-1]


def test_windows_are_dropped_only_below_the_least_score():
    import numpy as np

    r = random.Random(4)
    for _ in range(300):
        item = np.array([r.randint(0, 6) for _ in range(8)], np.uint64)
        passage = np.array([r.randint(0, 14) for _ in range(r.randint(1, 60))], np.uint64)
        for least in (0.0, 0.3, 0.5, 0.8, 1.0):
            score = decontamination.align(item, passage)[0] / (2 * len(item))
            if score and score >= least:
                assert decontamination.may_reach(*np.unique(item, return_counts=True), passage, least)


def test_clean_rows_with_null_and_repeated_ids_stay(spark):
    item, clean, other = prose(27, 30), prose(28, 60), prose(29, 60)
    tests = spark.createDataFrame([(7, item)], "item_id long, text string")
    docs = [(None, item), (None, clean), (4, f"{other} {item}"), (4, other), (5, other), (6, None)]
    left = decontamination.keep_clean(table(spark, docs), tests).collect()
    assert Counter((r.doc_id, r.text) for r in left) == Counter([(None, clean), (4, other), (5, other), (6, None)])


def test_alignment_matches_brute_force():
    import numpy as np

    r = random.Random(3)
    for _ in range(30):
        a, b = [r.randint(0, 3) for _ in range(8)], [r.randint(0, 3) for _ in range(12)]
        h = [[0] * 13 for _ in range(9)]
        for i in range(8):
            for j in range(12):
                h[i + 1][j + 1] = max(0, h[i][j] + (2 if a[i] == b[j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
        assert decontamination.align(np.array(a), np.array(b))[0] == max(map(max, h))


def test_toxicity(spark):
    docs = [(i, prose(i, 40) + (" idiot clown" if i % 5 == 0 else "")) for i in range(400)] + [(400, None), (401, ""), (None, "idiot clown")]
    labels = spark.createDataFrame([(i, int(i % 5 == 0), 1) for i in range(400)], "doc_id long, toxic int, text int")
    found = {r.doc_id: r for r in toxicity.scores(table(spark, docs), labels).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(found[i].held_out == (i in held) for i in range(402)) and not found[None].held_out
    assert sum(found[i].predicted == (i % 5 == 0) for i in held) >= 0.95 * len(held)
    assert found[400].score == found[401].score
    assert all(r.score == 0 for r in toxicity.scores(table(spark, docs), labels.limit(0)).collect())


def test_linked_large_bucket_of_many_groups(spark):
    from basketry.llm.linking import linked
    from basketry.llm.tables import stored

    rows = [(1, bytes([i]) * 16) for i in range(60)] + [(2, bytes([i]) * 16) for i in range(3)]
    members = stored(spark.createDataFrame(rows + rows[:5], "key long, node binary"), "test-members")
    same = lambda pairs: pairs.where("(cast(conv(hex(substring(a, 1, 1)), 16, 10) as int) - cast(conv(hex(substring(b, 1, 1)), 16, 10) as int)) % 20 = 0")
    found = {bytes(r.node)[0]: bytes(r.root)[0] for r in linked(members, same).collect()}
    assert found == {i: i % 20 for i in range(20, 60)}
