"""Statistics against a plain version, the fit against what it minimises, and held-out accuracy on made-up and given tables."""

import re
import zlib

import numpy as np
import pyarrow as pa
from conftest import SMALL
from pyspark.sql import functions as F

from basketry.llm import queries, rule_ensemble, vectors

TEXTS = ["", None, "One two, three!", "A a A a\nA a A a\nbb | cc\n", "\n\n", "x" * 400, "# 12 $$ 3", "é ü é ü é ü é ü é ü é ü", "tail\n", "Über Übermorgen"]


def described(texts):
    data, offsets = vectors.flat(pa.array(texts, pa.string()))
    return [dict(zip(rule_ensemble.STATISTICS, row, strict=True)) for row in rule_ensemble.describe(data, offsets)]


def test_statistics_against_a_plain_version():
    random = np.random.default_rng(1)
    made = ["".join(random.choice(list("ab B1#.!| \n"), int(n))) for n in random.integers(0, 200, 60)]
    for text, found in zip([*TEXTS, *made], described([*TEXTS, *made]), strict=True):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        n = max(len(words), 1)
        chars = max(sum(map(len, words)), 1)
        grams = [tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))]
        lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
        wanted = {
            "words": np.log1p(len(words)),
            "mean_word": sum(map(len, words)) / n,
            "short_words": sum(len(w) <= 3 for w in words) / n,
            "long_words": sum(len(w) > 14 for w in words) / n,
            "distinct_words": len(set(words)) / np.sqrt(n),
            "top_word": max((words.count(w) for w in words), default=0) / n,
            "repeated_windows": sum(grams.count(g) > 1 for g in grams) / max(len(grams), 1),
            "repeated_lines": 1 - len(set(lines)) / max(len(lines), 1) if lines else 1,
            "words_a_line": np.log1p(len(words) / max(len(lines), 1)),
            "upper": sum("A" <= c <= "Z" for c in text) / chars,
            "digits": sum("0" <= c <= "9" for c in text) / chars,
            "symbols": sum(c in "#*$%&<>@^~_=+\\/" for c in text) / chars,
            "stops": sum(c in ".,;:" for c in text) / n,
            "marks": sum(c in "!?" for c in text) / n,
            "bars": text.count("|") / n,
            "single_marks": sum(w in list("#*$%&<>@^~_=+\\/.,;:!?|") for w in words) / n,
        }
        assert set(wanted) == set(found)
        for name, value in wanted.items():
            assert abs(found[name] - value) < 1e-9, (name, text)


def test_paths_are_conjunctions_that_split():
    random = np.random.default_rng(2)
    x = random.random((600, len(rule_ensemble.STATISTICS)))
    y = ((x[:, 0] > 0.6) & (x[:, 3] <= 0.5)).astype(float)
    rules = rule_ensemble.tree_rules(x, y)
    assert all(1 <= len(r) <= rule_ensemble.DEPTH for r in rules)
    held = {rule_ensemble._holds(r, x).tobytes() for r in rules}
    assert len(held) == len(rules)
    ensemble = rule_ensemble.learn(x, y)
    fresh = random.random((2000, x.shape[1]))
    wanted = (fresh[:, 0] > 0.6) & (fresh[:, 3] <= 0.5)
    assert ((ensemble.predict(fresh) >= 0.5) == wanted).mean() > 0.95
    assert len(ensemble.rules) < len(rules)


def test_lasso_meets_its_conditions():
    random = np.random.default_rng(3)
    held = (random.random((500, 8)) < 0.4).astype(float)
    y = (random.random(500) < 1 / (1 + np.exp(-(2 * held[:, 0] - held[:, 1])))).astype(float)
    for strength in (0.05, 0.005):
        b, w = rule_ensemble.lasso(held, y, strength)
        slope = held.T @ (y - 1 / (1 + np.exp(-(held @ w + b)))) / len(y)
        assert abs((y - 1 / (1 + np.exp(-(held @ w + b)))).mean()) < 1e-3
        assert (np.abs(slope) <= strength + 1e-3).all()
        assert (np.abs(slope[w != 0] - strength * np.sign(w[w != 0])) < 1e-3).all()
    assert not rule_ensemble.lasso(held, y, 1.0)[1].any()


def tables(spark, n=360):
    random = np.random.default_rng(4)
    vocabulary = [f"{a}{b}" for a in ("mo", "ka", "ti", "su") for b in ("ran", "lo", "pe", "den", "sal")]
    docs, labels = [], []
    for i in range(n):
        words = list(random.choice(vocabulary, 60))
        good = i % 3 > 0
        if not good:
            words = [w + "###" for w in words] if i % 2 else words[:3] * 20
        docs.append((i, " ".join(words), "en"))
        labels.append((i, int(good)))
    return spark.createDataFrame(docs, "doc_id long, text string, words string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_rows_and_the_compiled_column(spark):
    docs, labels = tables(spark)
    rows = rule_ensemble.scores(docs, labels).collect()
    assert len(rows) == 360 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 3 > 0) for r in held]) > 0.95
    flipped = labels.withColumn("quality", F.when(rule_ensemble.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(rule_ensemble.scores(docs, flipped).collect()) == sorted(rows)  # held-out labels teach nothing
    ensemble = rule_ensemble.fit(docs, labels)
    stats = rule_ensemble.statistics(docs).select("*", ensemble.column().alias("score")).collect()
    mine = ensemble.predict(np.array([[r[s] for s in rule_ensemble.STATISTICS] for r in stats]))
    assert np.allclose(mine, [r.score for r in stats])


def test_odd_tables(spark):
    docs, labels = tables(spark)
    odd = [(None, "moran kalo", "x"), (900, None, "x"), (901, "", "x"), (901, "", "x"), (902, "a " * 50_000, "x"), (903, "x" * 100_000, "x")]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    strange = [(None, 1), (2, 0), (3, None), (4, 7), (5000, 1), (1, 1), (1, 1)]  # 2 gets two labels
    rows = rule_ensemble.scores(docs, labels.union(spark.createDataFrame(strange, labels.schema))).collect()
    assert len(rows) == 366 and len({(r.score, r.predicted) for r in rows if r.doc_id == 901}) == 1
    assert all(r.score is not None and 0 <= r.score <= 1 for r in rows) and [r.held_out for r in rows if r.doc_id is None] == [False]
    assert {r.score for r in rule_ensemble.scores(docs, labels.limit(0)).collect()} == {0.5}
    for only in (0, 1):
        assert {r.score for r in rule_ensemble.scores(docs, labels.where(F.col("quality") == only)).collect()} == {float(only)}
    assert rule_ensemble.scores(docs.limit(0), labels).count() == 0


def test_query(spark):
    rows = queries.QUERIES["op11_rule_ensemble"](spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.8
