"""Signals on results that are plausible but suspicious."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.plans import tree

FAN_OUT, LARGE = 2.0, 100_000.0
SHOWN_VALUES = 5


def _node(plan, names: tuple[str, ...], through: tuple[str, ...]):
    """The first node of some kind at the top of a plan, passing only through others of some kinds."""
    while True:
        if tree.kind(plan) in names:
            return plan
        children = tree.items(plan.children())
        if tree.kind(plan) not in through or len(children) != 1:
            return None
        plan = children[0]


def limit_without_order(plan) -> bool:
    limit = _node(plan, ("GlobalLimit", "LocalLimit"), ("UnresolvedWith",))
    return limit is not None and _node(limit, ("Sort",), ("GlobalLimit", "LocalLimit", "Offset")) is None


def equality_filter(plan) -> tuple[str, str] | None:
    """The first column = literal that all rows of the top filter must meet."""
    filters = [n for n in tree.walk(plan) if tree.kind(n) == "Filter"]
    if not filters:
        return None
    todo = [filters[0].condition()]
    while todo:
        e = todo.pop(0)
        if tree.kind(e) == "And":
            todo = [e.left(), e.right(), *todo]
        elif tree.kind(e) == "EqualTo":
            sides = [e.left(), e.right()]
            for a, b in (sides, sides[::-1]):
                if tree.kind(a) == "UnresolvedAttribute" and tree.kind(b) == "Literal":
                    return tree.items(a.nameParts())[-1], b.value().toString() if hasattr(b.value(), "toString") else str(b.value())
    return None


def averaged_columns(plan) -> list[tuple[str, str]]:
    """Bare columns inside AVG or SUM."""
    out = []
    for node in tree.walk(plan):
        for e in tree.expressions(node):
            if tree.kind(e) == "UnresolvedFunction" and tree.items(e.nameParts())[-1].lower() in ("avg", "sum"):
                inner = tree.items(e.children())
                if len(inner) == 1 and tree.kind(inner[0]) == "UnresolvedAttribute":
                    out.append((tree.items(e.nameParts())[-1].lower(), tree.items(inner[0].nameParts())[-1]))
    return out


def of_select(spark: SparkSession, sql: str, tables: list[str], total: int, estimates: dict[str, float], profiles: dict) -> list[dict]:
    """Signals of one statement. estimates: rows by table; profiles: (table, column) -> dict of null_frac and values."""
    plan, out = tree.parsed(spark, sql), []
    if limit_without_order(plan):
        out.append({"signal": "limit_without_order_by", "message": "which rows come back is not defined"})
    if total == 0 and len(tables) == 1 and (found := equality_filter(plan)):
        known = profiles.get((tables[0], found[0]), {}).get("values")
        if known and found[1] not in known:
            out.append({"signal": "zero_rows", "column": found[0], "value": found[1], "observed": known[:SHOWN_VALUES]})
    if len(tables) == 1:
        for function, column in averaged_columns(plan):
            share = profiles.get((tables[0], column), {}).get("null_frac", 0)
            if share > 0:
                out.append({"signal": "null_skipping_aggregate", "function": function, "column": column, "skipped": round(share * estimates.get(tables[0], 0))})
    largest = max((estimates.get(t, 0) for t in tables), default=0)
    if largest and len(tables) > 1 and total > FAN_OUT * largest:
        out.append({"signal": "join_fan_out", "rows": total, "largest_table": largest})
    if largest > LARGE and whole_scans(spark, sql):
        out.append({"signal": "seq_scan_large_table", "rows": largest})
    return out


def whole_scans(spark: SparkSession, sql: str) -> bool:
    """Whether some scan has no filter pushed down to it."""
    from tidewell.plans.analysis import physical_nodes

    return any(n["kind"] == "scan" and not n["pushed"] for n in physical_nodes(spark.sql(sql)))


def fan_out(joined_rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """signal, rows, largest: the counts of a join's result against its largest table; a row only if it fires."""
    sizes = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n")
        sizes = one if sizes is None else sizes.unionAll(one)
    largest = sizes.agg(F.max("n").alias("largest"))
    return joined_rows.agg(F.count("*").alias("rows")).crossJoin(largest).where(F.col("rows") > FAN_OUT * F.col("largest")).select(F.lit("join_fan_out").alias("signal"), "rows", "largest")


def null_skipping(df: DataFrame, columns: list[str]) -> DataFrame:
    """signal, column, skipped: how many rows an average of each column leaves out; rows only for columns with nulls."""
    counts = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("skipped")) for c in columns])
    return counts.select(F.explode(cells).alias("x")).select(F.lit("null_skipping_aggregate").alias("signal"), "x.column", "x.skipped").where("skipped > 0")


def observed_values(df: DataFrame, column: str, value: str, k: int = SHOWN_VALUES) -> DataFrame:
    """signal, column, value, observed: for a filter that finds nothing, what is there instead, the most frequent first."""
    hits = df.agg(F.count_if(F.col(column).cast("string") == value).alias("hits"))
    top = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(k)
    listed = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "v"))), lambda x: x["v"]), ", ").alias("observed"))
    return hits.where("hits = 0").crossJoin(listed).select(F.lit("zero_rows").alias("signal"), F.lit(column).alias("column"), F.lit(value).alias("value"), "observed")
