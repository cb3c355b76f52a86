"""Data-changing statements as edits of folders, from Spark's own unresolved plan: any condition, any expressions.

Spark's Parquet tables take neither UPDATE nor DELETE nor MERGE. Here the parsed statement's conditions and values become columns of
a query over the folder, so whatever Spark can compute may stand in them, subqueries too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import write
from tidewell.operators.policy import Policy, PolicyError
from tidewell.plans import tree


def _column(spark: SparkSession, expression) -> Column:
    from pyspark.sql.classic.column import Column as Classic

    return Classic(spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))


def _frame(spark: SparkSession, plan) -> DataFrame:
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    return Classic(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def _target(plan) -> tuple[str, str | None]:
    """The table that a statement changes as it is written there, and its alias."""
    alias = None
    if tree.kind(plan) == "SubqueryAlias":
        alias, plan = plan.identifier().name(), tree.items(plan.children())[0]
    return ".".join(tree.items(plan.multipartIdentifier())), alias


def _assigned(spark: SparkSession, assignments, names: list[str]) -> dict[str, Column]:
    out = {}
    for a in tree.items(assignments):
        asked = tree.items(a.key().nameParts())[-1]
        name = next((n for n in names if n.lower() == asked.lower()), None)
        if name is None:
            raise ValueError(f"no such column: {asked}")
        out[name] = _column(spark, a.value())
    return out


def _actions(spark: SparkSession, actions, names: list[str], source: str) -> list[write.Action]:
    out = []
    for a in tree.items(actions):
        condition = _column(spark, a.condition().get()) if a.condition().isDefined() else None
        kind = tree.kind(a)
        if kind == "DeleteAction":
            values = None
        elif kind in ("UpdateStarAction", "InsertStarAction"):
            values = {n: F.col(f"{source}.`{n}`") for n in names}
        else:
            values = _assigned(spark, a.assignments(), names)
        out.append(write.Action(condition, values))
    return out


def execute(spark: SparkSession, sql: str, policy: Policy, path_of, keys_of, dry_run: bool) -> dict:
    """Runs one INSERT, UPDATE, DELETE or MERGE that ``check`` has passed; path_of and keys_of give a table's folder and key columns."""
    plan = tree.parsed(spark, sql)
    kind = tree.kind(plan)
    if kind == "InsertIntoStatement":
        ref, _ = _target(plan.table())
        if plan.overwrite() or plan.partitionSpec().size():
            raise PolicyError("INSERT can only add rows")
        names = spark.read.parquet(path_of(ref)).columns
        given = tree.items(plan.userSpecifiedCols()) or names
        new = _frame(spark, plan.query())
        if len(new.columns) != len(given):
            raise ValueError(f"{len(given)} columns need as many values, not {len(new.columns)}")
        return write.insert_rows(spark, path_of(ref), ref, policy, new.toDF(*[next((n for n in names if n.lower() == g.lower()), g) for g in given]), dry_run)
    if kind in ("UpdateTable", "DeleteFromTable"):
        ref, alias = _target(plan.table())
        names = spark.read.parquet(path_of(ref)).columns
        if kind == "UpdateTable":
            hit = _column(spark, plan.condition().get()) if plan.condition().isDefined() else F.lit(True)
            values = _assigned(spark, plan.assignments(), names)
        else:
            hit, values = _column(spark, plan.condition()), None
        return write.rewrite(spark, path_of(ref), ref, policy, hit, values, keys_of(ref) or names[:1], dry_run, alias)
    if kind == "MergeIntoTable":
        ref, alias = _target(plan.targetTable())
        names = spark.read.parquet(path_of(ref)).columns
        source_plan = plan.sourceTable()
        own = source_plan.identifier().name() if tree.kind(source_plan) == "SubqueryAlias" else policy.parts(_target(source_plan)[0])[1]
        source = _frame(spark, source_plan).withColumn("__s", F.lit(True)).alias(own)
        lists = [_actions(spark, x, names, own) for x in (plan.matchedActions(), plan.notMatchedActions(), plan.notMatchedBySourceActions())]
        return write.merge(spark, path_of(ref), ref, policy, source, _column(spark, plan.mergeCondition()), *lists, dry_run, alias)
    raise PolicyError("only INSERT, UPDATE, DELETE and MERGE change rows")
