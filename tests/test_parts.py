"""Exports, edits, the store, search numbers, streams."""

from __future__ import annotations

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.operators import advise, graph, lookup, profile, search, write
from tidewell.operators.policy import WRITE, Policy, PolicyError
from tidewell.sources import catalog, exports, store
from tidewell.sources.catalog import CatalogSpec, ColumnSpec, ForeignKey, TableSpec
from tidewell.streaming import windows

SEED = CatalogSpec(
    (
        TableSpec("public.users", (ColumnSpec("id", "int", True, None, True), ColumnSpec("email", "text", True, "Login address (aka username)"), ColumnSpec("name", "text", False, "Display name"), ColumnSpec("created_at", "timestamptz", True)), comment="Application accounts (aka customers)"),
        TableSpec("public.orders", (ColumnSpec("id", "int", True, None, True), ColumnSpec("user_id", "int", True, "Owning account FK"), ColumnSpec("total", "numeric", True, "Order amount (aka amt)")), comment="Purchase records (aka purchases)", foreign_keys=(ForeignKey(("user_id",), "public.users", ("id",), "orders_user_id_fkey"),)),
    )
)


@pytest.mark.parametrize(("query", "users", "orders"), [("customer", 2.004915, 0.485203), ("user", 2.706557, 0.838708), ("order", 0, 4.064865), ("email", 1.329321, 0), ("purchase", 0, 2.856392), ("login", 0.329584, 0), ("foreign key", 0, 0.659167)])
def test_seed_scores(spark, query, users, orders):
    objects, columns = SEED.objects(spark), SEED.columns(spark)
    syn = search.synonyms(spark, objects, columns)
    rows = search.lexical_scores(spark.createDataFrame([(query,)], "query string"), search.postings(objects, columns), syn, 2).collect()
    got = {r.ref: round(r.score, 6) for r in rows}
    assert got.get("public.users", 0) == pytest.approx(users, abs=2e-6)
    assert got.get("public.orders", 0) == pytest.approx(orders, abs=2e-6)


def test_seed_graph(spark):
    edges = graph.join_graph(SEED.objects(spark), SEED.columns(spark), SEED.keys(spark)).collect()
    assert [(e.src, e.dst, e.via) for e in edges] == [("public.orders", "public.users", "orders_user_id_fkey")]


@pytest.mark.parametrize(("word", "stem"), [("companies", "company"), ("addresses", "addresse"), ("buses", "bus"), ("users", "user"), ("class", "class"), ("classes", "classe"), ("status", "status"), ("atlas", "atlas"), ("ashes", "ashe"), ("", "")])
def test_stem(spark, word, stem):
    assert spark.createDataFrame([(word,)], "w string").select(text.stem(F.col("w"))).first()[0] == stem


def test_search_hides(spark):
    asked = spark.createDataFrame([("customer",), ("",)], "query string")
    from tidewell.fixtures import WAREHOUSE

    found = search.search(asked, WAREHOUSE.objects(spark), WAREHOUSE.columns(spark), search.synonyms(spark)).collect()
    assert found and all(r.query for r in found) and not any("hidden" in r.ref for r in found)
    boosted = search.with_value_boost(spark.createDataFrame([("customer", "a", 1.0)], "query string, ref string, score double"), asked, spark.createDataFrame([("customer", "b", "c")], "token string, ref string, col string"))
    assert {r.ref: r.score for r in boosted.collect()} == {"a": 1.0, "b": 2.0}


def test_fusion_bounds(spark):
    one = spark.createDataFrame([("a", 0), ("b", 1)], "ref string, rank int")
    other = spark.createDataFrame([("b", 0), ("c", 1)], "ref string, rank int")
    x, y = ({r.ref: r.score for r in search.rank_fusion(*pair).collect()} for pair in ((one, other), (other, one)))
    assert x == pytest.approx(y) and max(x.values()) <= 2 / 60 and max(x, key=x.get) == "b"


def test_cells():
    assert exports.cell(decimal.Decimal("1.50")) == "1.50"
    assert exports.cell(float("nan")) is None
    assert exports.cell(b"ab") == "YWI="
    assert exports.cell([None, datetime.date(2024, 1, 2)]) == [None, "2024-01-02"]
    assert exports.columnar(["a", "b"], []) == {"columns": [], "rows": [], "allNullColumns": []}
    assert exports.columnarize({"x": [{"a": 1, "b": None}, {"a": 2, "b": None}], "y": [1]}) == {"x": {"columns": ["a"], "rows": [[1], [2]], "allNullColumns": ["b"]}, "y": [1]}
    assert exports.markdown(["a|b"], [["x\ny"], [None]]) == "| a\\|b |\n| --- |\n| x y |\n|  |"
    assert exports.cap("éé", 3) == ("é", True)
    assert exports.render(["a"], [['x"y']], "csv") == '"a"\n"x""y"\n'


def test_edit(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string").write.parquet(path)
    policy = Policy(WRITE, pii_columns=("public.t.name",))
    dry = write.edit(spark, path, "t", "update", policy, {"id": 1}, {"name": "z"})
    assert dry["rows_affected"] == 1 and dry["diff"] == [{"id": 1, "action": "update", "column": "name", "before": "<redacted>", "after": "<redacted>"}]
    assert spark.read.parquet(path).where("name = 'z'").count() == 0
    write.edit(spark, path, "t", "update", Policy(WRITE), {"id": 1}, {"name": "z"}, dry_run=False)
    write.edit(spark, path, "t", "insert", Policy(WRITE), None, [{"id": 3}], dry_run=False)
    write.edit(spark, path, "t", "delete", Policy(WRITE), {"id": 2}, dry_run=False)
    spark.catalog.refreshByPath(path)
    assert sorted((r.id, r.name) for r in spark.read.parquet(path).collect()) == [(1, "z"), (3, None)]
    with pytest.raises(PolicyError):
        write.edit(spark, path, "t", "delete", Policy(), {"id": 1})
    with pytest.raises(ValueError):
        write.delete(spark.read.parquet(path), {})


def test_store(spark, tmp_path):
    root = str(tmp_path / "index")
    assert store.status(spark, root, "x") == {"exists": False, "drift": None}
    objects = SEED.objects(spark)
    version = store.save(spark, root, {"objects": objects}, "x")
    assert store.load(spark, root)["objects"].count() == 2
    assert store.status(spark, root, "y")["drift"] and store.status(spark, root, "x")["version"] == version
    hashes = catalog.object_hashes(objects, SEED.columns(spark), SEED.keys(spark))
    assert store.changed_objects(hashes, hashes).count() == 0


def test_vectors_in_blocks(spark, sf):
    from tidewell.operators import search
    from tidewell.queries import QUERIES

    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    want = {(r.probe_id, r.vec_id) for r in QUERIES["cosine_topk"](spark, sf).collect()}
    assert len(want) == 20 * vectors.where("vec_id % 50 = 0").count()
    got = search.cosine_top(vectors, vectors.where("vec_id % 50 = 0"), 20, block=3, tile=70)
    assert {(r.probe_id, r.vec_id) for r in got.collect()} == want


def test_nearest_of_odd_vectors(spark):
    """Nulls, sizes, zero norms, copies, repeated and missing ids: as the column expression scores them, ties by id."""
    import random

    from tidewell.functions.text import cosine
    from tidewell.operators import search

    rng = random.Random(2)
    rows = [(k, [rng.choice([-1.0, 0.5, 2.0]) for _ in range(6)]) for k in range(300)] + [(1000 + k, [0.5, 1.0, 2.0, 0.0, 0.0, 1.0]) for k in range(90)]
    rows += [(500, None), (501, None), (550, []), (551, [1.0]), (600, [0.0] * 6), (601, [0.0] * 6), (650, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (700, [float("nan")] + [1.0] * 5), (None, [1.0] * 6), (150, [1.0] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in search.cosine_top(vectors, vectors.where("vec_id % 50 = 0"), 20, block=4, tile=50).collect():
        got.setdefault(r.probe_id, []).append((r["rank"], str(r.score)[:9], r.vec_id))
    probes = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("probe_id"), F.col("embedding").alias("probe"))
    every = {}
    for r in vectors.crossJoin(probes).where("vec_id <> probe_id").select("probe_id", "vec_id", F.when(F.col("embedding").isNotNull() & F.col("probe").isNotNull(), F.round(cosine(F.col("embedding"), F.col("probe")), 12)).alias("score")).collect():
        every.setdefault(r.probe_id, []).append((r.score is None, 0 if r.score is None or r.score != r.score else -r.score, r.score == r.score, r.vec_id, r.score))
    assert set(got) == set(every) and len(got) == 13
    for probe, scores in every.items():
        best = sorted(scores, key=lambda x: (x[0], -9 if not x[0] and not x[2] else x[1], x[3]))[:20]
        shown = sorted(got[probe])
        assert [r for r, _, _ in shown] == list(range(1, 21))
        assert [s for _, s, _ in shown] == [str(x[4])[:9] for x in best], probe
        if probe != 150:  # which has two vectors
            assert sorted(v for _, _, v in shown) == sorted(x[3] for x in best), probe


def test_nearest_of_many_vectors(spark):
    """400 probes of 20,000 vectors are a matter of seconds, and each vector is shuffled once, not once a block of probes."""
    import time

    import numpy as np
    import pyarrow as pa

    from tidewell.operators import search

    n, of = 20_000, np.random.default_rng(1).normal(size=(20_000, 64)).astype(np.float32)
    of[7_000:9_000] = of[7_000]
    table = pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(of.ravel(), 64).cast(pa.list_(pa.float32()))})
    vectors = spark.createDataFrame(table).localCheckpoint()
    start = time.perf_counter()
    got = {}
    for r in search.cosine_top(vectors, vectors.where("vec_id % 50 = 0"), 20).collect():
        got.setdefault(r.probe_id, []).append((r["rank"], r.vec_id))
    assert time.perf_counter() - start < 25
    assert len(got) == 400
    unit = of.astype(float) / np.linalg.norm(of.astype(float), axis=1)[:, None]
    for probe in (0, 7_050, 9_000, 19_950):
        score = unit @ unit[probe]
        score[7_000:9_000] = score[7_000]  # copies are equal
        score[probe] = -9
        assert [v for _, v in sorted(got[probe])] == np.lexsort((np.arange(n), -score))[:20].tolist()


def test_labels_of_a_whole_table(spark, sf):
    from tidewell.queries import QUERIES

    got = QUERIES["fk_label_resolve"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/orders.parquet").count() and got.where("o_custkey__resolved IS NULL").isEmpty()


def test_labels_and_targets(spark):
    assert lookup.label_column([("id", "int"), ("Title", "string")]) == "Title"
    assert lookup.label_column([("id", "string"), ("city", "string")], ("id",)) == "city"
    rows = spark.range(60).withColumnRenamed("id", "k")
    assert lookup.resolve_labels(rows, "k", rows.select(F.col("k").alias("id"), F.lit("x").alias("name")), "id", "name").where("k__resolved IS NOT NULL").count() == 0
    few = rows.where("k < 3")
    assert lookup.resolve_labels(few, "k", rows.select(F.col("k").alias("id"), F.lit("x").alias("name")), "id", "name").where("k__resolved = 'x'").count() == 3
    c = spark.createDataFrame([("a", "shop", "h1", "d"), ("b", "shop", "h2", "d"), ("c", "other", "h3", "d")], "connection string, name string, host string, database string")
    got = lookup.resolve_target(c, "shop").collect()
    assert [r.connection for r in got] == ["a", "b"] and all(r.ambiguous for r in got)


def test_profiles_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, "x"), (None, None)], "a int, b string")
    got = {r.col: r for r in profile.profile(df, "t").collect()}
    assert got["a"].n_distinct == 1 and round(got["b"].null_frac, 4) == 0.6667 and got["b"].min == "x"
    empty = profile.profile(df.where("false"), "t").collect()
    assert all(r.n_rows == 0 and r.min is None for r in empty)


def test_sections():
    assert advise.sections({"bad": lambda: 1 / 0})["bad"]["error"]
    assert advise.clamp(None) == 20 and advise.clamp(99) == 50


def test_stream(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").repartition(2).write.parquet(str(tmp_path / "e"))
    out = windows.tumbling(windows.read_events(spark, str(tmp_path / "e")), late="2000 days")
    q = out.writeStream.format("memory").queryName("w").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    total = spark.sql("SELECT sum(n) FROM (SELECT start, event_type, max(n) AS n FROM w GROUP BY 1, 2)").first()[0]
    assert total == spark.read.parquet(f"{sf}/events.parquet").count()


def test_embeddings_are_kept(spark):
    objects, columns, keys = SEED.objects(spark), SEED.columns(spark), SEED.keys(spark)
    documents, hashes = search.embedding_document(objects, columns), catalog.object_hashes(objects, columns, keys)
    first = search.build_embeddings(documents, hashes)
    marked = first.withColumn("vector", F.transform("vector", lambda _: F.lit(7.0)))
    stale = marked.withColumn("object_hash", F.when(F.col("ref") == "public.users", "old").otherwise(F.col("object_hash")))
    again = {r.ref: r.vector for r in search.build_embeddings(documents, hashes, stale).collect()}
    assert set(again["public.orders"]) == {7.0} and again["public.users"] == {r.ref: r.vector for r in first.collect()}["public.users"]


def test_hybrid_keeps_denied_out(spark):
    objects, columns = SEED.objects(spark), SEED.columns(spark)
    vectors = search.build_embeddings(search.embedding_document(objects, columns), catalog.object_hashes(objects, columns, SEED.keys(spark)))
    asked = spark.createDataFrame([("login email",)], "query string")
    none = spark.createDataFrame([], "query string, ref string, score double")
    assert search.hybrid_search(asked, none, vectors, objects).first().ref == "public.users"
    assert search.hybrid_search(asked, none, vectors, objects.where("ref <> 'public.users'")).where("ref = 'public.users'").isEmpty()


def test_overlays(spark):
    objects, columns = SEED.objects(spark), SEED.columns(spark)
    o = catalog.overlay_objects(objects, spark.createDataFrame([("public.users", "People", True), ("public.orders", None, None)], "ref string, comment string, excluded boolean")).collect()
    assert {r.ref: (r.comment, r.excluded) for r in o} == {"public.users": ("People", True), "public.orders": ("Purchase records (aka purchases)", False)}
    c = catalog.overlay_columns(columns, spark.createDataFrame([("public.users", "email", None, True)], "ref string, name string, comment string, pii boolean"))
    assert [r.name for r in c.where("pii").collect()] == ["email"] and c.where("name = 'email'").first().comment == "Login address (aka username)"
