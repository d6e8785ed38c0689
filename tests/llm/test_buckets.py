import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketry.llm import buckets, line_dedup, near_duplicates
from basketry.llm.linking import components
from basketry.llm.tables import discard, stored


def _plain_classes(sets, similar):
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similar * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


@pytest.mark.parametrize("block_nodes", [512, 40])
def test_group_of_edited_lines_equals_brute_force(spark, monkeypatch, block_nodes):
    """One original and many edits of it, unlike each other; small blocks meet as pairs of blocks."""
    monkeypatch.setattr(buckets, "BLOCK_NODES", block_nodes)
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(400)]
    base = rng.choices(words, k=40)
    lines = [" ".join(base)]
    for i in range(300):
        edited = list(base)
        for at in rng.sample(range(40), rng.randint(1, 6)):
            edited[at] = rng.choice(words)
        lines.append(" ".join(edited))
    lines += [" ".join(rng.choices(words, k=12)) for _ in range(200)]
    lines = sorted(set(lines))
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.removed(docs).collect()}
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines]
    classes = _plain_classes(sets, 0.8)
    expected = {i for i, root in enumerate(classes) if i != root}
    assert len(expected) > 150
    assert gone <= expected
    assert len(gone) >= 0.98 * len(expected)


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(30):
        base = rng.choices(words, k=150)
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 25)):
            edited = list(base)
            for at in rng.sample(range(150), rng.randint(1, 8)):
                edited[at] = rng.choice(words)
            texts.append(" ".join(edited))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in near_duplicates.classes(docs).collect()}
    known, idf = near_duplicates.word_shares(docs)
    import pyarrow as pa

    column = pa.array(texts)
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(1, len(texts)):
        same = near_duplicates.similarities(pa.array([texts[i]] * i), column[:i], known, idf) >= 0.8 - 1e-9
        for j in np.flatnonzero(same).tolist():
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    expected = {i: root(i) for i in range(len(texts))}
    assert sum(found[i] == expected[i] for i in expected) >= 0.98 * len(expected)


def test_discard_deletes_only_written_tables(spark):
    kept = stored(spark.range(3), "kept")
    gone = stored(spark.range(3), "gone")
    discard(gone, spark.range(2), stored(spark.range(0), "empty"))
    assert kept.count() == 3
    with pytest.raises(Exception):
        gone.count()


def test_components_of_chain_after_discards(spark):
    edges = spark.range(50).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.node: r.root for r in components(edges).collect()} == {i: 0 for i in range(1, 51)}


def _never(contents):
    raise AssertionError("contents of unlike sketches are judged")


def test_contents_of_unlike_sketches_are_not_moved(spark):
    """One crowded bucket of three nodes with nothing in common but the key."""
    rows = [(bytes([i]) * 16, [7, 100 + i], bytes([i]) * 8) for i in range(3)]
    signatures = stored(spark.createDataFrame(rows, "node binary, keys array<bigint>, sketch binary"), "test-signatures")
    contents = spark.createDataFrame([(node, "x" * 40) for node, _, _ in rows], "node binary, content string")
    assert buckets.linked_contents(signatures, contents, _never, 0.8, 0.55).count() == 0


def test_partners_are_of_another_component_and_alike():
    """Rows of four groups: a pair alike, a pair of one component, an unlike pair, and two blocks where only pairs between them count."""
    rows = [(1, 0, 0, 0, b"a", "xxxx"), (1, 0, 0, 0, b"b", "xxxy"), (2, 0, 0, 0, b"a", "xxxx"), (2, 0, 0, 0, b"a", "xxxx"), (3, 0, 0, 0, b"a", "xxxx")]
    rows += [(3, 0, 0, 0, b"b", "zzzz"), (4, 0, 1, 0, b"a", "xxxx"), (4, 0, 1, 0, b"b", "xxxx"), (4, 0, 1, 1, b"c", "yyyy")]
    names = ["key", "low", "high", "block", "root", "sketch"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    columns = [pa.array([r[i].encode() if n == "sketch" else r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))]
    found = buckets.with_partners(pa.RecordBatch.from_arrays(columns, names), 0.7)
    assert found.tolist() == [True, True] + [False] * 7
