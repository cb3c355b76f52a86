"""The near-duplicate stage against the Jaccard similarity of all pairs."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from tidewell.llm import shingle_join

SHINGLE = corpus_pipeline.SHINGLE


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return {r.doc_id for r in corpus_pipeline.stage_near_dedup(spark, docs, "").collect()}


def want(rows):
    return {min(rows[k][0] for k in part) for part in shingle_join.brute_force(rows, SHINGLE)}


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"e{rng.randrange(10**9)}"
    return " ".join(words)


def test_bound_of_similarity(spark):
    rng, texts = random.Random(5), []
    for _ in range(60):  # copies of 200 words with some words changed lie on both sides of the bound
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        texts += [" ".join(words), *(edited(rng, words, k) for k in (1, 3, 4, 5, 6))]
    words = [f"w{k}" for k in range(100)]
    texts += [edited(rng, words, k % 4) for k in range(150)]  # one large group
    texts += ["", None, " \t", "one two", "ONE  two", "one two three"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert kept(spark, rows) == want(rows)


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").collect()]
    assert kept(spark, rows) == want(rows)


def test_list_pairs():
    rng = np.random.default_rng(3)
    n = rng.integers(5, 40, 80)
    place, label, name = rng.integers(0, n // 5 + 1), rng.integers(0, 9, 80), np.arange(80)
    want = {frozenset((i, j)) for i in range(80) for j in range(i) if label[i] != label[j] and 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j]) and 9 * min(n[i] - place[i], n[j] - place[j]) >= 4 * (n[i] + n[j])}

    def got(*more):
        a, b = shingle_join.list_pairs(name, label, n, place, *more)
        return {frozenset(p) for p in zip(a.tolist(), b.tolist(), strict=True)}

    assert got() == want
    assert got(np.arange(80) % 2) == {p for p in want if len({k % 2 for k in p}) == 2}


def test_bitmaps_drop_no_similar_pair():
    rng = np.random.default_rng(4)
    for _ in range(300):
        base = rng.integers(0, 1 << 63, rng.integers(1, 600)).astype(np.uint64)
        other = base.copy()
        k = rng.integers(0, len(base) // 4 + 1)
        other[:k] = rng.integers(0, 1 << 63, k).astype(np.uint64)
        x, y = np.unique(base), np.unique(other)
        differ, n = np.bitwise_count((shingle_join.bitmap(x) ^ shingle_join.bitmap(y)).view(np.uint64)).sum(), len(x) + len(y)
        assert differ <= len(np.setxor1d(x, y))
        assert 9 * (n - differ) >= 8 * n or not shingle_join.similar(x, y)


def test_long_lists(spark, monkeypatch):
    """Lists of several tiles give the same components."""
    monkeypatch.setattr(shingle_join, "LIST", 7)
    rng, texts = random.Random(8), []
    words = [f"w{k}" for k in range(120)]
    texts = [edited(rng, words, k % 6) for k in range(60)] + [edited(rng, words[20:] + [f"v{k}" for k in range(20)], k % 3) for k in range(20)]
    rows = list(enumerate(texts))
    assert kept(spark, rows) == want(rows)


def test_ids_that_are_null_or_repeat(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, "a text of its own with some words"), (1, "this is text A and nothing else"), (1, "quite another text B of the same id"), (1, "quite another text B of the same id"), (None, text), (5, text + " more"), (4, text.upper())]
    docs = spark.createDataFrame([(i, t, f"l{k}", "s", 0) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = sorted(((r.doc_id, r.text, r.lang) for r in corpus_pipeline.stage_near_dedup(spark, docs, "").collect()), key=str)
    assert out == sorted([(None, rows[0][1], "l0"), (1, rows[1][1], "l1"), (1, rows[2][1], "l2"), (4, text.upper(), "l6")], key=str)


def test_group_of_copies_that_are_not_similar(spark, monkeypatch):
    """Near copies of one text that are too far apart share most lists: the last round sends on few of their pairs."""
    rng, words, counts, candidates = random.Random(9), [f"w{k}" for k in range(200)], [], shingle_join._candidates

    def counted(*args):
        out = candidates(*args)
        counts.append(out.count())
        return out

    monkeypatch.setattr(shingle_join, "_candidates", counted)
    rows = list(enumerate([edited(rng, words, 4) for _ in range(300)] + [edited(rng, words, 1) for _ in range(20)]))
    assert kept(spark, rows) == want(rows)
    assert counts and counts[0] < 1_000  # of 45,000 pairs in each list


def test_nearest_is_of_another_label_and_allowed():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 63, 100).astype(np.uint64))] * 3
    sets = [np.concatenate([s[: 100 - k], rng.integers(0, 1 << 63, k).astype(np.uint64)]) for s, k in zip(sets, (0, 5, 9), strict=True)] + [rng.integers(0, 1 << 63, 100).astype(np.uint64)]
    bits = np.stack([shingle_join.bitmap(s) for s in sets]).view(np.uint64)
    n, place, name = np.full(4, 100), np.zeros(4, np.int64), np.arange(4)
    a, b, _ = shingle_join.list_nearest(name, np.array([0, 1, 2, 3]), n, place, bits)
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 1), (1, 0), (2, 0)]
    a, b, _ = shingle_join.list_nearest(name, np.array([0, 0, 2, 3]), n, place, bits)
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 2), (1, 2), (2, 0)]
    a, b = shingle_join.list_pairs(name, name, n, place, bits=bits)
    assert {frozenset(p) for p in zip(a.tolist(), b.tolist(), strict=True)} == {frozenset(p) for p in ((0, 1), (0, 2), (1, 2))}
