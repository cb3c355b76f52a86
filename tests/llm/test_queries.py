"""The registered queries on the smallest tables, against brute force or DuckDB."""

from __future__ import annotations

import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tidewell.llm import bpe, packing, pseudonyms, registry, simhash, substring_dedup, token_shards

BPE = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def rows(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def run(spark, sf, n):
    name = next(q for q in registry.QUERIES if q.startswith(f"op{n}_"))
    return {r.doc_id: r for r in registry.QUERIES[name](spark, sf).collect()}


def test_names():
    assert [int(q[2:].split("_")[0]) for q in registry.QUERIES] == list(range(1, 11))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_op1(spark, sf, rows):
    import hashlib

    want = {i: (n, m, hashlib.sha256(t.encode()).hexdigest()) for i, (n, m, t) in substring_dedup.brute_force(rows).items()}
    assert {i: tuple(r)[1:] for i, r in run(spark, sf, 1).items()} == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert {r[0]: r[1:] for r in con.execute(registry.ORACLE_SQL["op1_substring_dedup"]).fetchall()} == want


def test_op3(spark, sf, rows):
    out, library = registry.QUERIES["op3_packing"](spark, sf).toPandas(), Tokenizer.from_file(BPE)
    for i, text in rows:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for r in out[out.doc_id == i].itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert out.length.sum() == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)
    assert out.sequence_id.nunique() <= packing.lower_bound(out.length.values) + 1


def test_op4_op5_folds(spark, sf, rows):
    for n, folds, held in ((4, 3, 1), (5, 4, 2)):
        got = run(spark, sf, n)
        assert {i: r.held_out for i, r in got.items()} == {i: zlib.crc32(str(i).encode()) % folds == held for i, _ in rows}
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())


def test_op6(spark, sf, rows):
    own = pseudonyms.Pseudonymiser()
    assert {i: r.text for i, r in run(spark, sf, 6).items()} == {i: own.replace(t)[0] for i, t in rows}


def test_op8(spark, sf, rows):
    assert sorted(tuple(r) for r in run(spark, sf, 8).values()) == token_shards.reference(rows, BPE, 2)


def test_op9(spark, sf, rows):
    assert {i: (r.fingerprint, r.component_id) for i, r in run(spark, sf, 9).items()} == simhash.brute_force(rows)


def test_op10(spark, sf, rows):
    got = run(spark, sf, 10)
    for i, t in rows:
        assert tuple(got[i])[1:] == bpe.reference(t, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
