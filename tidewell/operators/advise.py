"""Advice and monitoring as plain transforms of relations of statistics, whoever fills these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP, MOST = 20, 50


def clamp(limit: int | None, default: int = TOP, most: int = MOST) -> int:
    return max(1, min(most, default if limit is None else limit))


def high_sequential_scans(table_stats: DataFrame, limit: int | None = None, least: int = 100) -> DataFrame:
    """Tables that are read whole often, with the share of such reads."""
    total = F.col("seq_scan") + F.col("idx_scan")
    return table_stats.where(F.col("seq_scan") > least).select("ref", "seq_scan", "idx_scan", F.round(F.when(total == 0, 0.0).otherwise(100.0 * F.col("seq_scan") / total), 1).alias("seq_pct"), "n_live").orderBy(F.desc("seq_scan"), "ref").limit(clamp(limit))


def bloat(table_stats: DataFrame, limit: int | None = None, least_dead: int = 1000) -> DataFrame:
    """Tables with many dead rows, with their share."""
    total = F.col("n_live") + F.col("n_dead")
    return table_stats.where(F.col("n_dead") > least_dead).select("ref", "n_live", "n_dead", F.round(F.when(total == 0, 0.0).otherwise(100.0 * F.col("n_dead") / total), 1).alias("dead_pct")).orderBy(F.desc("dead_pct"), "ref").limit(clamp(limit))


def unused_indexes(index_stats: DataFrame, constraints: DataFrame, limit: int | None = None) -> DataFrame:
    """Indexes that no scan used and no constraint needs (index_stats: ref, index, idx_scan, is_unique, is_primary, size_bytes)."""
    idle = index_stats.where("idx_scan = 0 AND NOT is_unique AND NOT is_primary")
    return idle.join(constraints.select("index"), "index", "left_anti").select("ref", "index", "size_bytes").orderBy(F.desc("size_bytes"), "index").limit(clamp(limit))


def index_usage(index_stats: DataFrame, ref: str) -> DataFrame:
    """Indexes of one table by use, with their type; a primary key's index is called so."""
    kind = F.when(F.col("is_primary"), "PRIMARY KEY").when(F.col("is_unique"), "UNIQUE").otherwise("INDEX")
    return index_stats.where(F.col("ref") == ref).select("index", kind.alias("type"), "idx_scan", "size_bytes").orderBy(F.desc("idx_scan"), "index")


def slow_queries(statements: DataFrame, limit: int = 10, least_calls: int = 5) -> DataFrame:
    """The slowest statements on average; transaction control and rare ones do not count."""
    kept = statements.where((F.col("calls") >= least_calls) & ~F.upper(F.trim("query")).rlike("^(BEGIN|COMMIT|ROLLBACK)"))
    return kept.select("queryid", "query", "calls", F.round("mean_ms", 2).alias("mean_ms"), F.round("total_ms", 2).alias("total_ms"), "rows").orderBy(F.desc("mean_ms"), "queryid").limit(limit)


def running_queries(activity: DataFrame, own_pid: int | None = None, limit: int = 100, characters: int = 500) -> DataFrame:
    """What is at work now, the oldest first."""
    busy = activity.where("state <> 'idle'")
    if own_pid is not None:
        busy = busy.where(F.col("pid") != own_pid)
    return busy.select("pid", "user", "state", "query_start", F.substring("query", 1, characters).alias("query")).orderBy("query_start", "pid").limit(limit)


def connection_states(activity: DataFrame) -> DataFrame:
    return activity.groupBy("state", (F.col("wait_event").isNotNull()).alias("waiting")).agg(F.count("*").alias("n"))


LOCK_KEYS = ("locktype", "database", "relation", "page", "tuple", "virtualxid", "transactionid", "classid", "objid")


def blocking_locks(locks: DataFrame) -> DataFrame:
    """Who waits for whom: a lock that is not granted against granted ones on the same thing, nulls being equal."""
    a, b = locks.where("NOT granted").alias("a"), locks.where("granted").alias("b")
    on = F.col("a.pid") != F.col("b.pid")
    for k in LOCK_KEYS:
        on &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, on).select(F.col("a.pid").alias("blocked_pid"), F.col("b.pid").alias("blocking_pid"), F.col("a.locktype").alias("locktype"), F.col("a.mode").alias("wanted"), F.col("b.mode").alias("held"))


def cache_ratio(io: DataFrame) -> DataFrame:
    """Hits over hits and reads, 0 without either."""
    one = io.agg(F.sum("hits").alias("hits"), F.sum("reads").alias("reads"))
    total = F.col("hits") + F.col("reads")
    return one.select("hits", "reads", F.round(F.when(total == 0, 0.0).otherwise(F.col("hits") / total), 4).alias("ratio"))


def sections(builders: dict) -> dict:
    """Runs each section on its own: an error is its result, a single row becomes a dict."""
    out = {}
    for name, build in builders.items():
        try:
            rows = [r.asDict(recursive=True) for r in build().limit(MOST).collect()]
            out[name] = rows[0] if len(rows) == 1 else rows
        except Exception as e:  # one broken section must not hide the others
            out[name] = {"error": str(e)[:200]}
    return out
