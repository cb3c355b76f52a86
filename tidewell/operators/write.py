"""Edits as new tables: the rows after, what changed, and a write that swaps directories.

Parquet has no transactions. A dry run computes what an edit changes and writes nothing. A real write goes to a staging folder
first, then folders are renamed. Only the rows that a condition hits are compared: an update's rows hold both their values.
Cells of protected columns are masked, keys too, and protected values never move into columns that are not protected.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.policy import ADMIN, READ, REDACTED, WRITE, Policy, PolicyError
from tidewell.plans.lineage import tainted_outputs
from tidewell.sources.exports import as_text, cell

DIFF_ROWS = 100


def require(policy: Policy, ref: str, mode: str = WRITE) -> None:
    """Refuses edits in read mode and of tables that the policy denies."""
    order = (READ, WRITE, ADMIN)
    if order.index(policy.mode) < order.index(mode):
        raise PolicyError(f"{policy.mode} mode does not allow this")
    if not policy.allows(ref):
        raise PolicyError(f"the table {ref} is not allowed")


def _matches(df: DataFrame, key: dict) -> Column:
    unknown = [k for k in key if k not in df.columns]
    if unknown or not key:
        raise ValueError(f"no such key columns: {unknown}" if unknown else "a key is needed")
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v).cast(df.schema[k].dataType)) for k, v in key.items()])


def insert(df: DataFrame, rows: list[dict]) -> DataFrame:
    """The table with more rows; columns that a row lacks are null."""
    if not rows:
        return df
    unknown = {k for r in rows for k in r} - set(df.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    new = df.sparkSession.createDataFrame([tuple(r.get(c) for c in df.columns) for r in rows], df.schema)
    return df.unionByName(new)


def update(df: DataFrame, key: dict, values: dict) -> DataFrame:
    hit = _matches(df, key)
    return df.select(*[F.when(hit, F.lit(values[c]).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def delete(df: DataFrame, key: dict) -> DataFrame:
    return df.where(~_matches(df, key))


def cell_diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """key, action, column, before, after: one row for each cell that differs, joined by key, not by place."""
    rest = [c for c in before.columns if c not in key]
    a = before.select(*key, F.struct(*[as_text(before, c).alias(c) for c in rest]).alias("a"), F.lit(True).alias("in_a"))
    b = after.select(*key, F.struct(*[as_text(after, c).alias(c) for c in rest]).alias("b"), F.lit(True).alias("in_b"))
    joined = a.join(b, key, "full")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a.{c}").alias("before"), F.col(f"b.{c}").alias("after")) for c in rest])).alias("x")
    action = F.when(F.col("in_a").isNull(), "insert").when(F.col("in_b").isNull(), "delete").otherwise("update").alias("action")
    return joined.select(*key, action, cells).select(*key, "action", "x.*").where(~F.col("before").eqNullSafe(F.col("after")))


def row_cells(before: DataFrame, hit: Column, values: dict[str, Column] | None, key: list[str]) -> DataFrame:
    """The differing cells, as ``cell_diff`` gives them, of the rows that ``hit`` accepts: new values, or None for a delete.

    Old and new values stand in one row, so nothing is joined and only these rows are read on.
    """
    action = "delete" if values is None else "update"
    rest = [c for c in before.columns if c not in key] + [c for c in key if values and c in values]
    new = {c: (values[c].cast(before.schema[c].dataType) if c in values else F.col(c)) if values is not None else F.lit(None).cast(before.schema[c].dataType) for c in rest}
    rows = before.where(hit).select(*key, F.struct(*[F.col(c) for c in rest]).alias("a"), F.struct(*[v.alias(c) for c, v in new.items()]).alias("b"))
    pairs = [F.struct(F.lit(c).alias("column"), as_text(before, c, F.col(f"a.{c}")).alias("before"), as_text(before, c, F.col(f"b.{c}")).alias("after")) for c in rest]
    return rows.select(*key, F.lit(action).alias("action"), F.explode(F.array(*pairs)).alias("x")).select(*key, "action", "x.*").where(~F.col("before").eqNullSafe(F.col("after")))


def masked_cells(changed: DataFrame, policy: Policy, ref: str, key: list[str], columns: list[str]) -> DataFrame:
    """The differing cells without what the policy protects, the key's columns included."""
    hidden = [c for c in columns if policy.protects(ref, c)]
    if not hidden:
        return changed
    shown = [F.lit(REDACTED).alias(c) if c in key and c in hidden else F.when(F.col("column").isin(hidden), F.lit(REDACTED)).otherwise(F.col(c)).alias(c) if c in ("before", "after") else F.col(c) for c in changed.columns]
    return changed.select(*shown)


def guarded(source: DataFrame, values: dict[str, Column], policy: Policy, ref: str, dry_run: bool) -> dict[str, Column]:
    """New values of columns, unless they carry protected values into a column that is not protected: masked if dry, refused if real.

    What a value depends on is read from the analyzed plan; source names its tables by aliases.
    """
    if not policy.pii_columns:
        return values
    tainted = {n.removeprefix("new:") for n in tainted_outputs(source.select(*[v.alias(f"new:{c}") for c, v in values.items()]), policy.protected)}
    open_ = sorted(c for c in tainted if not policy.protects(ref, c))
    if open_ and not dry_run:
        raise PolicyError(f"protected values must not move into {ref}: {', '.join(open_)}")
    kinds = source.schema
    return {c: F.lit(REDACTED if kinds[c].dataType.typeName() == "string" else None) if c in open_ and c in kinds.names else v for c, v in values.items()}


def insert_rows(spark: SparkSession, path: str, ref: str, policy: Policy, new: DataFrame, dry_run: bool) -> dict:
    """Appends the rows of a query, whose columns are named as the table's; columns that it lacks are null."""
    require(policy, ref)
    schema = spark.read.parquet(path).schema
    unknown = sorted(set(new.columns) - set(schema.names))
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    tainted = tainted_outputs(new, policy.protected) if policy.pii_columns else []
    open_ = [c for c in tainted if not policy.protects(ref, c)]
    if open_ and not dry_run:
        raise PolicyError(f"protected values must not move into {ref}: {', '.join(open_)}")
    full = new.select(*[(F.col(f"`{f.name}`") if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    hidden = {c for c in schema.names if c in tainted or policy.protects(ref, c)}
    shown = full.select(*[F.lit(REDACTED).alias(c) if c in hidden else F.col(c) for c in full.columns])
    out = {"rows_affected": full.count(), "dry_run": dry_run, "diff": [{k: cell(v) for k, v in r.asDict().items()} for r in shown.limit(DIFF_ROWS).collect()]}
    if not dry_run:
        full.write.mode("append").parquet(path)
    return out


@dataclass(frozen=True)
class Action:
    """What becomes of a row that the condition accepts: new values by column, or none for a delete."""

    condition: Column | None
    values: dict[str, Column] | None


def merge(spark: SparkSession, path: str, ref: str, policy: Policy, source: DataFrame, on: Column, matched: list[Action], missing: list[Action], unmatched: list[Action], dry_run: bool, alias: str | None = None) -> dict:
    """MERGE: for pairs, for source rows without a partner (missing) and target rows without one, the first action that fits.

    source must carry its alias. A target row that more than one source row would change is an error.
    """
    require(policy, ref)
    name = policy.parts(ref)[1]
    alias = alias or name
    before = spark.read.parquet(path)
    schema = before.schema
    target = before.alias(name).withColumns({"__t": F.monotonically_increasing_id()}).alias(alias)
    joined = target.join(source, on, "full")
    both, only_s, only_t = F.col("__t").isNotNull() & F.col("__s").isNotNull(), F.col("__t").isNull(), F.col("__s").isNull()
    actions = [(where, a) for where, some in ((both, matched), (only_s, missing), (only_t, unmatched)) for a in some]
    old = {f.name: F.col(f"{alias}.`{f.name}`") for f in schema}
    choice = F.lit(-1)
    for k, (where, a) in reversed(list(enumerate(actions))):
        choice = F.when(where & F.coalesce(a.condition if a.condition is not None else F.lit(True), F.lit(False)), k).otherwise(choice)
    checked = [a.values if a.values is None else guarded(joined, a.values, policy, ref, dry_run) for _, a in actions]

    def new(f) -> Column:
        out = old[f.name]
        for k, values in enumerate(checked):
            v = values.get(f.name, F.lit(None) if actions[k][0] is only_s else old[f.name]) if values is not None else F.lit(None)
            out = F.when(choice == k, v.cast(f.dataType)).otherwise(out)
        return out

    plan = joined.select("__t", choice.alias("__k"), F.struct(*[old[f.name].alias(f.name) for f in schema]).alias("__old"), F.struct(*[new(f).alias(f.name) for f in schema]).alias("__new"))
    if not plan.where("__t IS NOT NULL AND __k >= 0").groupBy("__t").count().where("count > 1").isEmpty():
        raise ValueError("a row of the target matches more than one row of the source")
    gone = [k for k, v in enumerate(checked) if v is None]
    affected = plan.where("__k >= 0")
    words = F.when(F.col("__t").isNull(), "insert").when(F.col("__k").isin(gone), "delete").otherwise("update")
    pairs = [F.struct(F.lit(f.name).alias("column"), as_text(before, f.name, F.col(f"__old.{f.name}")).alias("before"), as_text(before, f.name, F.col(f"__new.{f.name}")).alias("after")) for f in schema]
    cells = affected.select(words.alias("action"), F.explode(F.array(*pairs)).alias("x")).select("action", "x.*").where(~F.col("before").eqNullSafe(F.col("after")))
    changed = masked_cells(cells, policy, ref, [], schema.names)
    out = {"rows_affected": affected.count(), "diff": [r.asDict() for r in changed.limit(DIFF_ROWS).collect()], "dry_run": dry_run}
    if not dry_run and out["rows_affected"]:
        # a target row that several source rows match without an action stays once; a source row without an action adds nothing
        stay = plan.where("__t IS NOT NULL").groupBy("__t").agg(F.max_by(F.struct("__k", "__old", "__new"), "__k").alias("r")).where(~F.col("r.__k").isin(gone) if gone else F.lit(True))
        rows = stay.select(F.when(F.col("r.__k") >= 0, F.col("r.__new")).otherwise(F.col("r.__old")).alias("row"))
        rows = rows.unionAll(plan.where("__t IS NULL AND __k >= 0").select("__new"))
        swap(spark, rows.select("row.*"), path)
    return out


def rewrite(spark: SparkSession, path: str, ref: str, policy: Policy, hit: Column, values: dict[str, Column] | None, key: list[str], dry_run: bool, alias: str | None = None) -> dict:
    """Updates (or with no values deletes) the rows that hit accepts; a condition that is null accepts nothing."""
    require(policy, ref)
    name = policy.parts(ref)[1]
    before = spark.read.parquet(path).alias(name).alias(alias or name)
    values = None if values is None else guarded(before, values, policy, ref, dry_run)
    hit = F.coalesce(hit, F.lit(False))
    affected = before.where(hit).count()
    changed = masked_cells(row_cells(before, hit, values, key), policy, ref, key, before.columns)
    out = {"rows_affected": affected, "diff": [r.asDict() for r in changed.limit(DIFF_ROWS).collect()], "dry_run": dry_run}
    if not dry_run and affected:
        if values is None:
            after = before.where(~hit)
        else:
            after = before.select(*[F.when(hit, values[c].cast(f.dataType)).otherwise(F.col(c)).alias(c) if (c := f.name) in values else F.col(c) for f in before.schema])
        swap(spark, after, path)
    return out


def edit(spark: SparkSession, path: str, ref: str, action: str, policy: Policy, key: dict | None = None, values: dict | list | None = None, key_columns: list[str] | None = None, dry_run: bool = True) -> dict:
    """One edit of the table in a folder: rows affected, at most DIFF_ROWS differing cells, and the write unless dry."""
    require(policy, ref)
    before = spark.read.parquet(path)
    if action in ("update", "delete"):
        unknown = sorted(set(values or {}) - set(before.columns)) if action == "update" else []
        if unknown:
            raise ValueError(f"no such columns: {unknown}")
        new = {c: F.lit(v) for c, v in values.items()} if action == "update" else None
        return rewrite(spark, path, ref, policy, _matches(before, key), new, key_columns or list(key), dry_run)
    if action != "insert":
        raise ValueError(f"unknown action {action}")
    rows = values if isinstance(values, list) else [values]
    added = insert(before.limit(0), rows)
    shown = added.select(*[F.lit(REDACTED).alias(c) if policy.protects(ref, c) else as_text(added, c).alias(c) for c in added.columns])
    keys = key_columns or before.columns[:1]
    cells = [{**{k: r[k] for k in keys}, "action": "insert", "column": c, "before": None, "after": r[c]} for r in shown.limit(DIFF_ROWS).collect() for c in shown.columns if c not in keys and r[c] is not None]
    if not dry_run:
        added.write.mode("append").parquet(path)
    return {"rows_affected": len(rows), "diff": cells[:DIFF_ROWS], "dry_run": dry_run}


def swap(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Writes beside the folder, then renames twice: the old folder away, the new one to its place.

    Between the two renames the path does not exist, so a reader that starts then fails; none sees half of the rows. A failed
    rename is undone and raised.
    """
    staging, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(staging)
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.rename(jvm.Path(path), jvm.Path(old)):
        raise OSError(f"{path} could not be moved")
    if not fs.rename(jvm.Path(staging), jvm.Path(path)):
        fs.rename(jvm.Path(old), jvm.Path(path))
        raise OSError(f"{staging} could not be moved")
    fs.delete(jvm.Path(old), True)


def import_rows(spark: SparkSession, rows: list[dict], schema, path: str, policy: Policy, ref: str, columns: list[str] | None = None) -> int:
    """Appends rows to a folder; by default the columns are the sorted keys of the first row."""
    require(policy, ref)
    if not rows:
        return 0
    names = columns or sorted(rows[0])
    spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], schema).write.mode("append").parquet(path)
    return len(rows)
