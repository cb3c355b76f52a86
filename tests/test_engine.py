"""One call of every tool, and what the policy keeps from it."""

from __future__ import annotations

import dataclasses
import time

import pytest

from tidewell import fixtures as fx
from tidewell.engine import TOOLS, UNAVAILABLE, Connection, Engine
from tidewell.operators.policy import ADMIN, Policy, PolicyError
from tidewell.session import TABLES
from tidewell.sources import store
from tidewell.sources.catalog import CatalogSpec, ColumnSpec, ForeignKey, TableSpec


@pytest.fixture(scope="module")
def engine(spark, sf, tmp_path_factory):
    root = tmp_path_factory.mktemp("engine")
    for t in ("nation", "region"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(str(root / t))
    tables = {t: f"{sf}/{t}.parquet" for t in TABLES} | {t: str(root / t) for t in ("nation", "region")}
    stats = {
        "table_stats": spark.createDataFrame(fx.TABLE_STATS, fx.TABLE_STATS_SCHEMA),
        "index_stats": spark.createDataFrame(fx.INDEX_STATS, fx.INDEX_STATS_SCHEMA),
        "constraints": spark.createDataFrame(fx.CONSTRAINED_INDEXES, "index string"),
        "locks": spark.createDataFrame(fx.LOCKS, fx.LOCKS_SCHEMA),
    }
    main = Connection(tables, fx.WAREHOUSE, Policy(ADMIN, deny_tables=("public.labels",), pii_columns=("public.customer.c_name",)), host="db1.example.com", database="warehouse", index_root=str(root / "index"), stats=stats)
    return Engine(spark, {"main": main, "copy": Connection({t: tables[t] for t in ("region", "orders")}, database="small")})


CALLS = {
    "run_select": {"sql": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1", "limit": 3, "resolve_refs": True},
    "explain_query": {"sql": "SELECT * FROM orders WHERE o_orderkey = 1"},
    "discover_tools": {"query": "index"},
    "resolve_target": {"hint": "warehouse", "object_hint": "customer"},
    "inspect_or_search": {"query": "customer balance"},
    "search_all_databases": {"query": "orders"},
    "search_schema": {"query": "clients"},
    "describe_object": {"ref": "orders", "resolve_refs": True},
    "get_join_path": {"a": "lineitem", "b": "nation"},
    "sample_values": {"ref": "orders", "col": "o_orderstatus"},
    "get_ddl": {"ref": "orders"},
    "table_stats": {"ref": "nation"},
    "index_usage": {"ref": "public.orders"},
    "export_query": {"sql": "SELECT n_nationkey, n_name FROM nation ORDER BY 1", "fmt": "sqlinsert", "table": "nation"},
    "db_schema_completions": {"prefix": "cust"},
    "deep_plan_analysis": {"sql": "SELECT count(*) FROM orders"},
    "auto_tune_query": {"sql": "SELECT count(*) FROM orders"},
    "schema_diff": {"source": "public", "target": "sales"},
    "generate_migration": {"source": "public", "target": "sales"},
    "check_ddl_safety": {"ddl": "DROP TABLE x"},
    "switch_connection": {"connection": "main"},
    "execute_sql": {"sql": "UPDATE nation SET n_name = 'X' WHERE n_nationkey = 3"},
    "edit_row": {"table": "nation", "action": "delete", "pk": {"n_nationkey": 99}},
    "import_data": {"table": "region", "rows": [{"r_regionkey": 77, "r_name": "NEW"}]},
    "apply_ddl": {"ddl": "CREATE TABLE x (a INT)"},
    "terminate_query": {"group": "none"},
    "run_maintenance": {"table": "kept_table"},
}


@pytest.mark.parametrize("tool", [*[t for t in TOOLS if t != "rebuild_index"], "rebuild_index"])
def test_every_tool(engine, spark, tool):
    if tool == "run_maintenance":
        spark.sql("CREATE TABLE IF NOT EXISTS kept_table USING parquet AS SELECT 1 AS a")
    assert engine.call(tool, **CALLS.get(tool, {})) is not None


def test_count():
    assert len(TOOLS) + len(UNAVAILABLE) == 55  # all tools of the survey, and prefix completion
    assert not set(TOOLS) & set(UNAVAILABLE)


@pytest.mark.parametrize("tool", UNAVAILABLE)
def test_unavailable(engine, tool):
    with pytest.raises(NotImplementedError):
        engine.call(tool)


def test_results(engine):
    r = engine.call("run_select", **CALLS["run_select"])
    assert r["total_count"] > 3 and r["has_more"] and len(r["rows"]) == 3
    assert engine.call("get_join_path", a="lineitem", b="nation") == {"path": ["public.lineitem", "public.supplier", "public.nation"], "hops": 2}
    assert engine.call("get_join_path", a="events", b="nation")["path"] is None
    assert engine.call("search_schema", query="") == []
    assert "labels" not in str(engine.call("search_schema", query="labels of documents"))
    engine.call("rebuild_index")
    assert engine.call("get_index_status")["exists"] and not engine.call("get_index_status")["drift"]
    assert "PRIMARY KEY" in engine.call("get_ddl", ref="orders")
    for call in ({"tool": "sample_values", "ref": "customer", "col": "c_name"}, {"tool": "run_select", "sql": "SELECT * FROM labels"}, {"tool": "sample_values", "ref": "labels", "col": "quality"}):
        with pytest.raises(PolicyError):
            engine.call(**call)
    with pytest.raises(KeyError, match="orders"):
        engine.call("describe_object", ref="ordrs")


def test_edits(engine):
    dry = engine.call("execute_sql", sql="UPDATE nation SET n_name = 'X' WHERE n_nationkey = 3")
    assert dry["rows_affected"] == 1 and dry["dry_run"]
    engine.call("execute_sql", sql="UPDATE nation SET n_name = 'X' WHERE n_nationkey = 3", dry_run=False)
    engine.call("execute_sql", sql="DELETE FROM nation WHERE n_nationkey = 4", dry_run=False)
    engine.call("execute_sql", sql="INSERT INTO nation (n_nationkey, n_name) VALUES (90, 'Y')", dry_run=False)
    rows = engine.call("run_select", sql="SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (3, 4, 90) ORDER BY 1")["rows"]
    assert rows == [[3, "X"], [90, "Y"]]
    assert engine.call("edit_row", table="nation", action="delete", pk={"n_nationkey": 99})["critique"]


def test_read_mode_refuses(spark, sf):
    engine = Engine(spark, {"r": Connection({"region": f"{sf}/region.parquet"})})
    for tool in ("execute_sql", "edit_row", "import_data", "apply_ddl", "run_maintenance", "terminate_query"):
        with pytest.raises(PolicyError):
            engine.call(tool)


@pytest.fixture()
def notes(spark, tmp_path):
    """People with a protected column, notes without one, and an engine in write mode over both."""
    spark.createDataFrame([(1, "a@x.com", "A"), (2, "b@x.com", "B"), (3, None, "C")], "id long, email string, name string").write.parquet(str(tmp_path / "people"))
    spark.createDataFrame([(1, "one"), (2, "two"), (4, None)], "id long, note string").write.parquet(str(tmp_path / "notes"))
    tables = {t: str(tmp_path / t) for t in ("people", "notes")}
    return Engine(spark, {"main": Connection(tables, policy=Policy("write", pii_columns=("public.People.email",)))})


@pytest.mark.parametrize(
    "sql",
    [
        "INSERT INTO notes SELECT id, email FROM people",
        "INSERT INTO notes (note) SELECT upper(p.email) || '!' FROM people p",
        "INSERT INTO notes WITH x AS (SELECT id, email AS e FROM people) SELECT id, e FROM x",
        "INSERT INTO notes SELECT id, (SELECT max(email) FROM people) FROM notes",
        "UPDATE notes SET note = (SELECT max(email) FROM people) WHERE id = 1",
        "UPDATE people SET name = email",
        "MERGE INTO notes USING people ON notes.id = people.id WHEN MATCHED THEN UPDATE SET note = people.email",
        "MERGE INTO notes n USING (SELECT id, email AS e FROM people) p ON n.id = p.id WHEN NOT MATCHED THEN INSERT (id, note) VALUES (p.id, p.e)",
    ],
)
def test_protected_values_do_not_move(notes, sql):
    dry = notes.call("execute_sql", sql=sql)
    assert dry["rows_affected"] > 0 and "x.com" not in str(dry).lower()
    with pytest.raises(PolicyError):
        notes.call("execute_sql", sql=sql, dry_run=False)


def test_protected_cells_are_masked(notes):
    for sql in ("DELETE FROM people WHERE id = 1", "UPDATE people SET email = 'new@x.com' WHERE id = 2", "INSERT INTO people VALUES (9, 'z@x.com', 'Z')", "INSERT INTO people SELECT id + 10, email, name FROM people"):
        out = notes.call("execute_sql", sql=sql)
        assert "x.com" not in str(out) and "<redacted>" in str(out), sql
    notes.call("execute_sql", sql="INSERT INTO people SELECT id + 10, email, name FROM people", dry_run=False)
    assert notes.call("run_select", sql="SELECT count(*) AS n, count(DISTINCT id) AS d FROM people")["rows"] == [[6, 6]]
    assert "x.com" not in str(notes.call("edit_row", table="people", action="insert", values={"id": 7, "email": "q@x.com"}))


def test_statements(notes):
    def rows():
        return notes.call("run_select", sql="SELECT id, note FROM notes ORDER BY id")["rows"]

    out = notes.call("execute_sql", sql="UPDATE notes AS n SET note = upper(n.note) || '!', id = n.id + 100 WHERE n.id IN (SELECT id FROM people) AND note > 'a'", dry_run=False)
    assert out["rows_affected"] == 2 and rows() == [[4, None], [101, "ONE!"], [102, "TWO!"]]
    assert notes.call("execute_sql", sql="DELETE FROM notes WHERE note LIKE 'T%' OR id BETWEEN 50 AND 101", dry_run=False)["rows_affected"] == 2
    assert rows() == [[4, None]]
    notes.call("execute_sql", sql="INSERT INTO notes (note, id) VALUES ('x', 1), ('y', 2)", dry_run=False)
    merge = "MERGE INTO notes t USING (SELECT id, name FROM people) s ON t.id = s.id WHEN MATCHED AND s.id = 1 THEN DELETE WHEN MATCHED THEN UPDATE SET note = s.name WHEN NOT MATCHED THEN INSERT (id, note) VALUES (s.id, 'new') WHEN NOT MATCHED BY SOURCE THEN UPDATE SET note = 'kept'"
    dry = notes.call("execute_sql", sql=merge)
    assert dry["rows_affected"] == 4 and rows() == [[1, "x"], [2, "y"], [4, None]]
    notes.call("execute_sql", sql=merge, dry_run=False)
    assert rows() == [[2, "B"], [3, "new"], [4, "kept"]]
    with pytest.raises(ValueError, match="more than one"):
        notes.call("execute_sql", sql="MERGE INTO notes t USING (SELECT 2 AS id UNION ALL SELECT 2) s ON t.id = s.id WHEN MATCHED THEN DELETE")
    with pytest.raises(ValueError, match="no such column"):
        notes.call("execute_sql", sql="UPDATE notes SET nothing = 1")
    with pytest.raises(PolicyError):
        notes.call("execute_sql", sql="INSERT OVERWRITE notes SELECT 1, 'a'")


def test_index_is_read(engine, spark):
    engine.call("rebuild_index")
    assert engine.call("search_schema", query="customer balance") == engine.call("search_schema", query="customer balance")
    cold = Engine(spark, {"main": Connection(engine.now.tables, engine.now.spec, engine.now.policy)})
    for query in ("customer balance", "clients", "orders", "nothing of this"):
        # values are known to the index alone, so the order may differ only where they boost
        assert {h["ref"] for h in cold._search_schema(query)} <= {h["ref"] for h in engine._search_schema(query)}
    start = time.perf_counter()
    engine.call("search_schema", query="clients")
    assert time.perf_counter() - start < 0.3
    near = engine._search_schema("customer balance", semantic=True)
    assert near and near[0]["ref"] == "public.customer" and not any("labels" in h["ref"] for h in near)
    digest = engine.call("orient")
    assert digest["enums"].get("public.orders.o_orderstatus") and digest["notes"] == []
    assert "c_name" not in str(digest["enums"])


def test_refresh_profiles_what_changed(engine):
    engine.call("rebuild_index")
    assert engine.call("refresh_index")["profiled"] == []
    spec = engine.now.spec
    orders = next(t for t in spec.tables if t.name == "orders")
    engine.now.spec = dataclasses.replace(spec, tables=tuple(dataclasses.replace(t, comment="receipts of sales") if t is orders else t for t in spec.tables))
    try:
        assert engine.call("refresh_index")["profiled"] == [orders.ref]
        assert engine.call("search_schema", query="receipts")[0]["ref"] == orders.ref
        relations = store.load(engine.spark, engine.now.index_root)
        assert relations["profiles"].groupBy("ref", "col").count().where("count > 1").isEmpty() and relations["profiles"].where("ref = 'public.lineitem'").count() > 0
        assert relations["embeddings"].groupBy("ref").count().where("count > 1").isEmpty()
    finally:
        engine.now.spec = spec


def test_export_tells_what_it_cut(engine, tmp_path):
    some = engine.call("export_query", sql="SELECT o_orderkey, o_orderstatus FROM orders ORDER BY 1")
    assert some["truncated"] and some["row_count"] <= engine.now.caps.most_rows < some["total_count"]
    out = engine.call("export_query", sql="SELECT o_orderkey, o_orderstatus FROM orders", path=str(tmp_path / "all"))
    assert not out["truncated"] and engine.spark.read.text(str(tmp_path / "all")).count() == some["total_count"] and out["header"] == '"o_orderkey","o_orderstatus"'
    masked = engine.call("export_query", sql="SELECT c_name AS who FROM customer", fmt="sqlinsert", table="copy", path=str(tmp_path / "masked"))
    assert masked["piiRedactedColumns"] == ["who"] and engine.spark.read.text(str(tmp_path / "masked")).where("value NOT LIKE '%<redacted>%'").isEmpty()


def test_unknown_column(engine):
    with pytest.raises(LookupError, match="o_orderkey"):
        engine.call("run_select", sql="SELECT o_orderky FROM orders")
    with pytest.raises(LookupError) as e:
        engine.call("run_select", sql="SELECT c_nam FROM customer")
    assert "near it: c_name" not in str(e.value)


def test_diff_of_keys_and_indexes(spark, sf):
    def table_of(schema, extra):
        cols = (ColumnSpec("id", "bigint", True, is_pk=True), ColumnSpec("other", "bigint"))
        return TableSpec(f"{schema}.a", cols, foreign_keys=(ForeignKey(("other",), f"{schema}.b", ("id",)),) if extra else (), indexes=(("other",),) if extra else (("id",),)), TableSpec(f"{schema}.b", cols)

    spec = CatalogSpec((*table_of("old", False), *table_of("new", True)))
    engine = Engine(spark, {"x": Connection({}, spec)})
    out = engine.call("schema_diff", source="old", target="new")
    assert "a_other_fkey" in str(out["constraints"]) and "REFERENCES b (id)" in str(out["constraints"]) and "a_other_idx" in str(out["indexes"])
    steps = engine.call("generate_migration", source="old", target="new").split("\n")
    assert set(steps) == {'CREATE INDEX "a_other_idx" ON "old"."a" (other);', 'ALTER TABLE "old"."a" ADD CONSTRAINT "a_other_fkey" FOREIGN KEY (other) REFERENCES b (id) NOT VALID;', '-- DROP INDEX "old"."a_id_idx";', 'ALTER TABLE "old"."a" VALIDATE CONSTRAINT "a_other_fkey";'}
