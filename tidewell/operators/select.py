"""Guarded reads: policy, masking by lineage, paging with a total, caps, time limit, formats and critique."""

from __future__ import annotations

import re
import threading
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.policy import REDACTED, Policy, check
from tidewell.plans.lineage import tainted_outputs
from tidewell.sources import exports


@dataclass(frozen=True)
class Caps:
    """Rows (default and most), bytes of rendered text, milliseconds."""

    rows: int = 50
    most_rows: int = 500
    characters: int = 20_000
    timeout_ms: int = 30_000

    def row_limit(self, asked: int | None) -> int:
        return max(1, min(asked or self.rows, max(1, min(10_000, self.most_rows))))

    def time_limit(self, asked: int | None) -> int:
        most = max(100, min(3_600_000, self.timeout_ms))
        return min(asked or most, most)


@dataclass
class Result:
    columns: list[str]
    rows: list[list]
    limit: int
    total_count: int | None
    has_more: bool
    redacted: list[str] = field(default_factory=list)
    critique: list[dict] = field(default_factory=list)
    text: str | None = None
    truncated: bool = False


class QueryTimeout(RuntimeError):
    """A query that ran over its time limit."""


def dialect(sql: str) -> str:
    """Rewrites numbered parameters ($1) to named ones (:p1), outside of quotes and comments."""
    parts = re.split(r"('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/)", sql, flags=re.S)
    return "".join(p if k % 2 else re.sub(r"\$(\d+)", r":p\1", p) for k, p in enumerate(parts))


def mask(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replaces values of columns; nulls too, so that nothing is told by them."""
    return df.select(*[F.lit(REDACTED).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def page(df: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The page with one row more than asked, and the count of all rows: two jobs that stay distributed."""
    return df.limit(limit + 1), df.agg(F.count("*").alias("total_count"))


def with_time_limit(spark: SparkSession, milliseconds: int, work):
    """Runs work in a job group that is cancelled when the time is over."""
    group, over = f"tidewell-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        over.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(milliseconds / 1000, stop)
    spark.sparkContext.setJobGroup(group, "guarded query", interruptOnCancel=True)
    timer.start()
    try:
        return work()
    except Exception as e:
        if over.is_set():
            raise QueryTimeout(f"over {milliseconds} ms") from e
        raise
    finally:
        timer.cancel()
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            spark.sparkContext.setLocalProperty(key, None)


def guarded(spark: SparkSession, sql: str, policy: Policy, parameters: list | None = None) -> tuple[DataFrame, list[str]]:
    """A permitted statement's rows with what depends on protected columns masked, and the masked columns.

    An unknown column is told with those of the statement's tables that are written nearly so.
    """
    tables = check(spark, sql, policy)
    try:
        df = spark.sql(sql, args={f"p{k}": v for k, v in enumerate(parameters, 1)} if parameters else None)
    except AnalysisException as e:
        if "UNRESOLVED_COLUMN" not in (e.getCondition() or ""):
            raise
        asked = (e.getMessageParameters() or {}).get("objectName", "").split(".")[-1].strip("`")
        near = nearest(spark, asked, [c for t in tables for c in spark.table(t).columns if not policy.protects(t, c)])
        raise LookupError(f"no column {asked}" + (f"; near it: {', '.join(near)}" if near else "")) from e
    hidden = tainted_outputs(df, policy.protected) if policy.pii_columns else []
    return (mask(df, hidden) if hidden else df), hidden


def nearest(spark: SparkSession, asked: str, names: list[str], most: int = 3) -> list[str]:
    """The names at the least edit distances from what was asked, at most a third of its length (two at least)."""
    if not names:
        return []
    known = spark.createDataFrame([(n,) for n in sorted(set(names))], "name string")
    distance = F.levenshtein(F.lower("name"), F.lit(asked.lower()))
    found = known.select("name", distance.alias("d")).where(F.col("d") <= max(2, len(asked) // 3)).orderBy("d", "name").limit(most)
    return [r["name"] for r in found.collect()]


def run_select(spark: SparkSession, sql: str, policy: Policy = Policy(), caps: Caps = Caps(), parameters: list | None = None, limit: int | None = None, fmt: str = "columnar", timeout_ms: int | None = None, estimates: dict[str, float] | None = None, profiles: dict | None = None) -> Result:
    """Runs one read-only statement and renders at most the row limit; the total is counted beside it.

    Masked columns depend on a protected column in any way but by predicates (see ``plans.lineage``).
    """
    sql = dialect(sql)
    tables = check(spark, sql, policy)
    shown, hidden = guarded(spark, sql, policy, parameters)
    n = caps.row_limit(limit)
    first, total = page(shown, n)

    def work():
        return first.collect(), total.first()[0]

    rows, count = with_time_limit(spark, caps.time_limit(timeout_ms), work)
    from tidewell.operators.critique import of_select

    cells = [[exports.cell(v) for v in row] for row in rows[:n]]
    result = Result(shown.columns, cells, n, count, len(rows) > n, hidden)
    result.critique = of_select(spark, sql, tables, count, estimates or {}, profiles or {})
    result.text, result.truncated = exports.cap(exports.render(result.columns, cells, fmt), caps.characters)
    return result
