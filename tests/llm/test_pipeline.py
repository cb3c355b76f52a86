"""The pipeline stage by stage, against each operator's brute force."""

from __future__ import annotations

import public_tokenizers as P
import pyarrow as pa
import pytest

import corpus_pipeline
from tidewell.llm import language_id, packing, pseudonyms, shingle_join, substring_dedup, tokens


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Each stage's input and output, as run() chains them."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (docs, after)
        docs = after
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "pii", "packing"]
    for name in list(stages)[:-1]:
        assert stages[name][1].columns == list(corpus_pipeline.COLUMNS)
        assert stages[name][1].where("n_chars <> length(text)").isEmpty()


def test_language(stages):
    before, after = (rows(x) for x in stages["language_id"])
    fitted = language_id.fit(stages["language_id"][0].select("doc_id", "text", "lang").where(language_id.fold("doc_id", 3) != 1))
    ids = sorted(before)
    _, _, accepted = fitted.predict(pa.array([before[i].text for i in ids], pa.string()))
    assert set(after) == {i for i, ok in zip(ids, accepted, strict=True) if ok} and len(after) > 0.98 * len(before)


def test_near(stages):
    before, after = (rows(x) for x in stages["near_dedup"])
    ordered = [(i, r.text) for i, r in before.items()]
    want = {min(ordered[k][0] for k in part) for part in shingle_join.brute_force(ordered, corpus_pipeline.SHINGLE)}
    assert set(after) == want and len(after) < len(before)


def test_substring(stages):
    before, after = (rows(x) for x in stages["substring_dedup"])
    want = substring_dedup.brute_force([(i, r.text) for i, r in before.items()])
    assert {i: r.text for i, r in after.items()} == {i: before[i].text if not w[1] else w[2] for i, w in want.items()}


def test_pii(stages):
    before, after = (rows(x) for x in stages["pii"])
    own = pseudonyms.Pseudonymiser()
    assert {i: r.text for i, r in after.items()} == {i: own.replace(r.text)[0] for i, r in before.items()}


def test_packing(stages):
    before, after = stages["packing"][0].collect(), stages["packing"][1].toPandas()
    enc = tokens.encoder(P.path("byte_bpe_50k.json"))
    total = {r.doc_id: len(i) + 1 for r, i in zip(before, enc.encode(pa.array([r.text for r in before])), strict=True)}
    assert after.groupby("doc_id").length.sum().to_dict() == total
    assert after.groupby("sequence_id").length.sum().max() <= packing.CAPACITY


def test_run_and_nothing(spark, sf, stages, tmp_path):
    assert corpus_pipeline.run(spark, sf).count() == stages["packing"][1].count()
    spark.read.parquet(f"{sf}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_documents(spark, sf):
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the of and to in that is for on with", "en", None, 5), (3, "the of and to in that is for on with", "en", None, 5)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(odd)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() > 0


def test_each_stage_on_odd_rows(spark, sf):
    """Every stage but the first keeps every distinct text: null and repeated ids, null, empty and very long texts."""
    long = " ".join(f"word{k}" for k in range(60_000))
    rows = [(None, "one text of its own", "en"), (7, "first text of seven", "en"), (7, "second text of seven", "de"), (8, None, "en"), (9, "", "en"), (10, " \t", None), (11, long, "en"), (11, long, "en")]
    docs = spark.createDataFrame([(*r, None, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    near = corpus_pipeline.stage_near_dedup(spark, docs, sf).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:30]) for r in near) == sorted([(0, rows[0][1]), (7, rows[1][1]), (7, rows[2][1]), (8, ""), (11, long[:30])])
    cut = corpus_pipeline.stage_substring_dedup(spark, docs, sf).collect()
    assert len(cut) == len(rows) and {r.n_chars for r in cut if r.doc_id == 11} == {0}
    assert sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.stage_pii(spark, docs, sf).collect()) == sorted((r[0] or 0, r[1] or "") for r in rows)
    packed = corpus_pipeline.stage_packing(spark, docs, sf).collect()
    assert sum(r.piece == 0 for r in packed) == len(rows) and {r.length for r in packed if r.doc_id in (8, 9)} == {1}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf).count() == 0
