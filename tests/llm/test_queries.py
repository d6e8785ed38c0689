"""Registered queries against their SQL on the smallest tables, and invariants of packing and personal data."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import packing, pii, queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    base = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        base.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    wanted = base.execute(queries.ORACLES[name])
    columns = sorted(d[0] for d in wanted.description)
    rows = base.execute(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall()
    found = queries.QUERIES[name](spark, SMALL).select(*columns).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, rows)) and found


def test_packing(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "word " * 3000), (5, "x y")], "doc_id long, text string")
    rows = packing.pack(docs).collect()
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.vocabulary_path())
    for doc_id, text in ((r.doc_id, r.text or "") for r in docs.collect()):
        ids = np.array([*slow.encode(text, add_special_tokens=False).ids, 2], "<u4")
        mine = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.piece)
        assert [r.start for r in mine] == list(np.cumsum([0] + [r.length for r in mine])[:-1])
        assert sum(r.length for r in mine) == len(ids) and all(r.length == 1024 for r in mine[1:])
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine)
    for sequence in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == sequence), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack(docs.limit(0)).count() == 0


def test_personal_data(spark):
    text = "mail a.b@x.org, ip 10.0.0.1 not 999.1.1.1, card 4111 1111 1111 1111, call +49 (30) 123456"
    docs = spark.createDataFrame([(1, text, 5), (2, None, 5), (3, "", 5)], "doc_id long, text string, kind int")
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    spans = [("email", "a.b@x.org"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (30) 123456")]
    wanted = ",".join(f"{k}:{text.index(s)}:{text.index(s) + len(s)}" for k, s in spans)
    assert found[1].base_sha256 == hashlib.sha256(wanted.encode()).hexdigest()
    assert set(wanted.split(",")) <= set(found[1].spans.split(","))
    assert found[2].spans == found[3].spans == "" and found[2].n_email == 0
    assert pii.find(docs.where(F.lit(False))).count() == 0
