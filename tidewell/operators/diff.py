"""Differences of schemas as full joins, and a migration's text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Order of statuses in a report.
STATUSES = ("changed", "added", "removed", "unchanged")


def _status(compared: list[str]):
    same = F.lit(True)
    for c in compared:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return F.when(F.col("a.present").isNull(), "added").when(F.col("b.present").isNull(), "removed").when(same, "unchanged").otherwise("changed")


def compare(source: DataFrame, target: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """keys, status, old_<c>, new_<c>: what target has more, less or otherwise than source."""
    a, b = source.withColumn("present", F.lit(True)).alias("a"), target.withColumn("present", F.lit(True)).alias("b")
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"a.{k}") == F.col(f"b.{k}")
    joined = a.join(b, on, "full")
    out = [F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys]
    out += [_status(compared).alias("status")] + [x for c in compared for x in (F.col(f"a.{c}").alias(f"old_{c}"), F.col(f"b.{c}").alias(f"new_{c}"))]
    return joined.select(*out)


def schema_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Differences of columns (table_name, name, type, not_null, default_value) of two schemas."""
    return compare(source, target, ["table_name", "name"], ["type", "not_null", "default_value"])


def table_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    return compare(source.select("table_name").distinct(), target.select("table_name").distinct(), ["table_name"], [])


def part_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Differences of keys and indexes (table_name, kind, name, definition) of two schemas."""
    return compare(source, target, ["table_name", "kind", "name"], ["definition"])


def part_migration(diff: DataFrame, tables: DataFrame, schema: str = "public") -> DataFrame:
    """table_name, step, statement for keys and indexes: dropped ones are commented out, changed ones are dropped and made anew.

    A foreign key is added without checking old rows and validated afterwards, so no table stays locked while it is read.
    """
    gone = tables.where("status = 'removed'").select("table_name")
    own = diff.where("status <> 'unchanged'").join(gone, "table_name", "left_anti")
    table = F.concat(F.lit(f'"{schema}"."'), F.col("table_name"), F.lit('"'))
    name = F.concat(F.lit('"'), F.col("name"), F.lit('"'))
    is_index, is_foreign = F.col("kind") == "index", F.col("kind") == "foreign_key"
    drop = F.when(is_index, F.concat(F.lit(f'DROP INDEX "{schema}".'), name, F.lit(";"))).otherwise(F.concat(F.lit("ALTER TABLE "), table, F.lit(" DROP CONSTRAINT "), name, F.lit(";")))
    add = F.when(is_index, F.concat(F.lit("CREATE INDEX "), name, F.lit(" ON "), table, F.lit(" "), "new_definition", F.lit(";"))).otherwise(F.concat(F.lit("ALTER TABLE "), table, F.lit(" ADD CONSTRAINT "), name, F.lit(" "), "new_definition", F.when(is_foreign, " NOT VALID;").otherwise(";")))
    validate = F.concat(F.lit("ALTER TABLE "), table, F.lit(" VALIDATE CONSTRAINT "), name, F.lit(";"))

    def steps(condition, step, statement):
        return own.where(condition).select("table_name", F.lit(step).alias("step"), statement.alias("statement"))

    new = F.col("status").isin("added", "changed")
    out = steps(F.col("status") == "removed", 8, F.concat(F.lit("-- "), drop))
    return out.unionAll(steps(F.col("status") == "changed", 6, drop)).unionAll(steps(new, 7, add)).unionAll(steps(new & is_foreign, 9, validate))


def ordered(diff: DataFrame, *names: str) -> DataFrame:
    rank = F.lit(len(STATUSES))
    for k, s in reversed(list(enumerate(STATUSES))):
        rank = F.when(F.col("status") == s, k).otherwise(rank)
    return diff.orderBy(rank, *names)


def migration(diff: DataFrame, tables: DataFrame, schema: str = "public") -> DataFrame:
    """table_name, step, statement: drops are always commented out; type, nullability and default change one by one.

    A new table is created with its columns only; columns of new or dropped tables get no statements of their own.
    """
    full = F.concat(F.lit(f'"{schema}"."'), F.col("table_name"), F.lit('"'))
    column = F.concat(F.lit('"'), F.col("name"), F.lit('"'))
    whole = tables.where("status IN ('added', 'removed')").select("table_name", F.col("status").alias("table_status"))
    own = diff.join(whole, "table_name", "left")
    definition = F.concat(column, F.lit(" "), F.col("new_type"), F.when(F.col("new_not_null"), " NOT NULL").otherwise(""), F.when(F.col("new_default_value").isNotNull(), F.concat(F.lit(" DEFAULT "), "new_default_value")).otherwise(""))
    created = (
        own.where("table_status = 'added'")
        .groupBy("table_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", definition.alias("d")))), lambda x: x["d"]), ", ").alias("cols"))
        .select("table_name", F.lit(1).alias("step"), F.concat(F.lit("CREATE TABLE "), full, F.lit(" ("), "cols", F.lit(");")).alias("statement"))
    )
    dropped = tables.where("status = 'removed'").select("table_name", F.lit(9).alias("step"), F.concat(F.lit("-- DROP TABLE "), full, F.lit(";")).alias("statement"))
    kept = own.where("table_status IS NULL")
    alter = F.concat(F.lit("ALTER TABLE "), full)
    change = F.concat(alter, F.lit(" ALTER COLUMN "), column)

    def steps(condition, step: int, statement):
        return kept.where(condition).select("table_name", F.lit(step).alias("step"), statement.alias("statement"))

    changed = F.col("status") == "changed"
    out = created.unionAll(dropped)
    for more in (
        steps(F.col("status") == "added", 2, F.concat(alter, F.lit(" ADD COLUMN "), definition, F.lit(";"))),
        steps(F.col("status") == "removed", 8, F.concat(F.lit("-- "), alter, F.lit(" DROP COLUMN "), column, F.lit(";"))),
        steps(changed & ~F.col("old_type").eqNullSafe(F.col("new_type")), 3, F.concat(change, F.lit(" TYPE "), F.col("new_type"), F.lit(";"))),
        steps(changed & ~F.col("old_not_null").eqNullSafe(F.col("new_not_null")), 4, F.concat(change, F.when(F.col("new_not_null"), " SET NOT NULL;").otherwise(" DROP NOT NULL;"))),
        steps(changed & ~F.col("old_default_value").eqNullSafe(F.col("new_default_value")), 5, F.concat(change, F.when(F.col("new_default_value").isNull(), " DROP DEFAULT;").otherwise(F.concat(F.lit(" SET DEFAULT "), "new_default_value", F.lit(";"))))),
    ):
        out = out.unionAll(more)
    return out
