"""What statements may do, and what depends on protected columns."""

from __future__ import annotations

import pytest

from tidewell.operators.policy import ADMIN, READ, WRITE, Policy, PolicyError, check
from tidewell.operators.select import Caps, QueryTimeout, dialect, run_select, with_time_limit
from tidewell.plans import analysis
from tidewell.plans.lineage import tainted_outputs
from tidewell.session import register

ALLOWED = [
    "SELECT 1",
    "SELECT * FROM orders WHERE o_orderkey = 1",
    "SELECT o_orderstatus, count(*) FROM orders GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 5 OFFSET 1",
    "WITH a AS (SELECT 1 AS x) SELECT * FROM a",
    "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 3) SELECT * FROM t",
    "SELECT 1 UNION SELECT 2 EXCEPT SELECT 3",
    "VALUES (1), (2)",
    "TABLE orders",
    "SELECT * FROM orders JOIN customer ON o_custkey = c_custkey",
    "SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) FROM orders",
    "SELECT * FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)",
    "SELECT (SELECT max(c_custkey) FROM customer)",
    "EXPLAIN SELECT * FROM orders",
    "-- a comment\nSELECT 1",
    "SELECT 'DROP TABLE x; DELETE FROM y'",
    "SELECT * FROM orders NATURAL JOIN customer",
    "SELECT o_orderstatus, sum(o_totalprice) FROM orders GROUP BY GROUPING SETS ((o_orderstatus), ())",
    "SELECT explode(array(1, 2))",
    "SELECT * FROM orders LATERAL VIEW explode(array(1, 2)) t AS x",
    "SELECT * FROM range(3)",
    "SELECT * FROM orders TABLESAMPLE (10 PERCENT)",
    "SELECT DISTINCT o_orderstatus FROM orders",
]
REFUSED = [
    "SELEC 1",
    "",
    "SELECT 1; SELECT 2",
    "INSERT INTO orders VALUES (1)",
    "DELETE FROM orders",
    "UPDATE orders SET o_orderkey = 1",
    "MERGE INTO orders USING customer ON o_custkey = c_custkey WHEN MATCHED THEN DELETE",
    "DROP TABLE orders",
    "CREATE TABLE x (a INT)",
    "CREATE TABLE x AS SELECT 1",
    "CREATE VIEW v AS SELECT 1",
    "CREATE TEMPORARY VIEW v AS SELECT 1",
    "TRUNCATE TABLE orders",
    "ALTER TABLE orders ADD COLUMNS (x INT)",
    "SET spark.sql.ansi.enabled = false",
    "RESET",
    "USE other",
    "ADD JAR '/tmp/x.jar'",
    "CACHE TABLE orders",
    "REFRESH TABLE orders",
    "CALL x()",
    "SHOW TABLES",
    "BEGIN SELECT 1; END",
    "EXECUTE IMMEDIATE 'SELECT 1'",
    "DECLARE VARIABLE x INT",
    "SELECT reflect('java.lang.Math', 'abs', -1)",
    "SELECT java_method('java.lang.System', 'exit', 1)",
    "SELECT 1 WHERE try_reflect('java.lang.Math', 'abs', -1) = '1'",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/orders.parquet`",
    "SELECT * FROM (SELECT * FROM csv.`/etc/passwd`)",
    "WITH x AS (SELECT * FROM text.`/etc/passwd`) SELECT * FROM x",
    "EXPLAIN DELETE FROM orders",
    "FROM orders INSERT INTO a SELECT * INSERT INTO b SELECT *",
    "INSERT OVERWRITE DIRECTORY '/tmp/x' USING csv SELECT 1",
    "LOAD DATA INPATH '/x' INTO TABLE orders",
    "ANALYZE TABLE orders COMPUTE STATISTICS",
    "DESCRIBE orders",
]


@pytest.mark.parametrize("sql", ALLOWED)
def test_read_allows(spark, sql):
    check(spark, sql)


@pytest.mark.parametrize("sql", REFUSED)
def test_read_refuses(spark, sql):
    with pytest.raises(PolicyError):
        check(spark, sql)


@pytest.mark.parametrize(
    ("mode", "sql", "ok"),
    [
        (WRITE, "INSERT INTO orders VALUES (1)", True),
        (WRITE, "DELETE FROM orders WHERE o_orderkey = 1", True),
        (WRITE, "UPDATE orders SET o_orderkey = 1", True),
        (WRITE, "DROP TABLE orders", False),
        (WRITE, "SET a = b", False),
        (ADMIN, "DROP TABLE orders", True),
        (ADMIN, "TRUNCATE TABLE orders", True),
        (ADMIN, "CREATE TABLE x (a INT)", True),
        (ADMIN, "ALTER TABLE orders ADD COLUMNS (x INT)", True),
        (ADMIN, "ADD JAR '/tmp/x.jar'", False),
        (ADMIN, "USE other", False),
        (READ, "DELETE FROM orders", False),
    ],
)
def test_modes(spark, mode, sql, ok):
    if ok:
        check(spark, sql, Policy(mode))
    else:
        with pytest.raises(PolicyError):
            check(spark, sql, Policy(mode))


def test_tables(spark):
    policy = Policy(deny_tables=("secret", "hr.*"), deny_schemas=("audit",))
    assert check(spark, "WITH secret AS (SELECT 1 AS x) SELECT * FROM secret", policy) == []
    for sql in ("SELECT * FROM secret", "SELECT * FROM public.secret", "SELECT * FROM hr.people", "SELECT * FROM audit.x", "SELECT 1 WHERE 1 IN (SELECT x FROM hr.y)", "DELETE FROM hr.people"):
        with pytest.raises(PolicyError):
            check(spark, sql, Policy(WRITE, deny_tables=policy.deny_tables, deny_schemas=policy.deny_schemas))
    only = Policy(allow_schemas=("sales",))
    assert check(spark, "SELECT * FROM sales.x", only) == ["sales.x"]
    with pytest.raises(PolicyError):
        check(spark, "SELECT * FROM x", only)


@pytest.mark.parametrize(
    ("sql", "hidden"),
    [
        ("SELECT c_custkey, c_name FROM customer", ["c_name"]),
        ("SELECT c_name AS x FROM customer c", ["x"]),
        ("SELECT upper(c_name) AS x, c_custkey AS y FROM customer", ["x"]),
        ("WITH a AS (SELECT c_name AS n, c_custkey FROM customer) SELECT n, c_custkey FROM a", ["n"]),
        ("SELECT n_name AS x FROM nation UNION ALL SELECT c_name FROM customer", ["x"]),
        ("SELECT count(c_name) AS n, max(c_custkey) AS m FROM customer", ["n"]),
        ("SELECT (SELECT max(c_name) FROM customer) AS x, 1 AS y", ["x"]),
        ("SELECT c_custkey, lag(c_name) OVER (ORDER BY c_custkey) AS p FROM customer", ["p"]),
        ("SELECT c_custkey FROM customer WHERE c_name = 'a'", []),
        ("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o_custkey = c_custkey", ["c_name"]),
        ("SELECT x.* FROM (SELECT struct(c_name, 1 AS b) AS s FROM customer) x", ["s"]),
        ("SELECT explode(split(c_name, '#')) AS w, c_custkey FROM customer", ["w"]),
        ("SELECT n_name FROM nation", []),
    ],
)
def test_lineage(spark, sf, sql, hidden):
    register(spark, sf, ("customer", "nation", "orders"))
    assert tainted_outputs(spark.sql(sql), {("customer", "c_name")}) == hidden


def test_run_select(spark, sf):
    register(spark, sf, ("customer", "orders"))
    r = run_select(spark, "SELECT c_custkey, c_name FROM customer WHERE c_custkey <= $1 ORDER BY c_custkey", Policy(pii_columns=("public.customer.c_name",)), parameters=[5], limit=3)
    assert (r.total_count, r.has_more, len(r.rows), r.redacted) == (6, True, 3, ["c_name"])
    assert r.rows[0] == [0, "<redacted>"]
    r = run_select(spark, "SELECT * FROM orders LIMIT 2", caps=Caps(characters=50))
    assert r.truncated and len(r.text.encode()) <= 50
    assert [c["signal"] for c in r.critique] == ["limit_without_order_by"]
    r = run_select(spark, "SELECT * FROM orders WHERE o_orderstatus = 'X'", profiles={("orders", "o_orderstatus"): {"values": ["F", "O"]}})
    assert r.critique[0]["observed"] == ["F", "O"]
    assert run_select(spark, "SELECT 1 AS a, NULL AS b", fmt="columnar").text == '{"columns": ["a"], "rows": [[1]], "allNullColumns": ["b"]}'


def test_time_limit(spark):
    with pytest.raises(QueryTimeout):
        with_time_limit(spark, 300, lambda: spark.range(10**13).selectExpr("sum(sqrt(id))").collect())
    assert spark.range(3).count() == 3


def test_dialect():
    assert dialect("SELECT $1, '$2' -- $3") == "SELECT :p1, '$2' -- $3"


def test_plans(spark, sf):
    register(spark, sf, ("customer", "orders"))
    found = analysis.deep_analysis(spark, "SELECT * FROM orders JOIN customer ON o_custkey < c_custkey")
    assert any(f["severity"] == "critical" for f in found["findings"])
    assert "First" in analysis.tune(spark, "SELECT count(*) FROM orders")["summary"] or analysis.tune(spark, "SELECT 1")["summary"]
    assert analysis.grade(41) == "critical" and analysis.skew_grade([1, 1, 1, 97])[1] in ("high", "medium")


def test_nodes_are_graded(spark, sf):
    register(spark, sf, ("lineitem", "orders"))
    df = spark.sql("SELECT l_orderkey % 5 AS k, count(*) AS n, max(o_totalprice) AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
    found = analysis.metrics(df)
    assert abs(sum(n["share"] for n in found["nodes"]) - 100) < 1e-6 and any(n["partitions"] for n in found["nodes"])
    node = {"name": "Sort", "kind": "sort", "share": 45.0, "time_ms": 5000.0, "partitions": [1 << 20] * 9 + [1 << 24], "misestimate": 40.0, "data_size": 1 << 22}
    worst = analysis.findings({"cartesian": 0, "spill_bytes": 0, "scans": 0, "filtered_scans": 0, "exchanges": 0, "joins": 0, "python": 0, "nodes": [node]})
    assert [f["severity"] for f in worst] == ["critical", "high", "medium"]


@pytest.mark.parametrize(("ddl", "worst"), [("DROP TABLE x", "CRITICAL"), ("TRUNCATE TABLE x", "CRITICAL"), ("ALTER TABLE x DROP COLUMN y", "HIGH"), ("ALTER TABLE x ALTER COLUMN y TYPE BIGINT", "CRITICAL"), ("nonsense", "CRITICAL"), ("ALTER TABLE x ADD CONSTRAINT k FOREIGN KEY (a) REFERENCES y (b)", "HIGH"), ("ALTER TABLE x ADD CONSTRAINT k FOREIGN KEY (a) REFERENCES y (b) NOT VALID", None), ("SELECT 'DROP TABLE x'", None)])
def test_ddl(spark, ddl, worst):
    found = analysis.ddl_safety(spark, ddl)
    assert (found[0]["severity"] if found else None) == worst


def test_names_of_rules_have_no_case():
    assert not Policy(deny_schemas=("HR",)).allows("hr.people") and not Policy(deny_schemas=("hr",)).allows("HR.people")
    assert not Policy(deny_tables=("Public.Orders",)).allows("orders") and not Policy(deny_tables=("PEOPLE",)).allows("hr.people")
    assert Policy(allow_schemas=("Sales",)).allows("SALES.x") and not Policy(allow_schemas=("Sales",)).allows("x")
    assert Policy(pii_columns=("Public.Customer.Email",)).protects("customer", "EMAIL")


@pytest.mark.parametrize("rule", [{"deny_tables": ("public.orders",)}, {"deny_schemas": ("public",)}, {"deny_tables": ("*.orders",)}, {"deny_tables": ("public.*",)}, {"deny_tables": ("spark_catalog.public.orders",)}])
def test_catalog_does_not_hide_a_schema(spark, rule):
    policy = Policy(**rule)
    assert not policy.allows("spark_catalog.public.orders") and policy.allows("spark_catalog.sales.people")
    with pytest.raises(PolicyError):
        check(spark, "SELECT * FROM spark_catalog.public.orders", policy)
