"""The join graph: declared keys, keys inferred from names, shortest join paths, and what has no key yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.text import table_name_variants

MAX_HOPS = 3


def declared_edges(keys: DataFrame) -> DataFrame:
    cols = F.array_join(F.zip_with("columns", "ref_columns", lambda a, b: F.concat(a, F.lit("="), b)), ",")
    return keys.select(F.col("ref").alias("src"), F.col("ref_table").alias("dst"), F.col("name").alias("via"), cols.alias("cols"), F.lit(False).alias("inferred"))


def inferred_edges(objects: DataFrame, columns: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges from columns called <table>_id to a table of that name in the same schema, unless a key is declared for the column.

    Name variants are exploded, so this is an equi-join. The target column is the sole key column, else id, else <table>_id.
    Of several tables the one named first in the order singular, s, es, ies wins.
    """
    tables = objects.where(F.col("kind") == "table").select(F.col("ref").alias("dst"), F.col("schema").alias("dst_schema"), F.lower("name").alias("dst_name"), "primary_key")
    named = columns.where(F.lower("name").rlike("._id$")).join(objects.select("ref", "schema"), "ref")
    declared = keys.select("ref", F.explode("columns").alias("name"))
    named = named.join(declared, ["ref", "name"], "left_anti")
    variants = named.select(F.col("ref").alias("src"), "schema", "name", F.posexplode(table_name_variants(F.regexp_replace(F.lower("name"), "_id$", ""))).alias("place", "variant"))
    hits = variants.join(tables, (F.col("schema") == F.col("dst_schema")) & (F.col("variant") == F.col("dst_name"))).where("src <> dst")
    dst_cols = columns.groupBy("ref").agg(F.collect_set("name").alias("names")).withColumnRenamed("ref", "dst")
    best = hits.withColumn("rn", F.row_number().over(Window.partitionBy("src", "name").orderBy("place", "dst"))).where("rn = 1").join(dst_cols, "dst")
    target = F.when(F.size("primary_key") == 1, F.col("primary_key")[0]).when(F.array_contains("names", "id"), F.lit("id")).when(F.array_contains("names", F.concat("dst_name", F.lit("_id"))), F.concat("dst_name", F.lit("_id")))
    return best.select("src", "dst", F.col("name").alias("via"), target.alias("to_col")).where("to_col IS NOT NULL").select("src", "dst", "via", F.concat("via", F.lit("="), "to_col").alias("cols"), F.lit(True).alias("inferred"))


def join_graph(objects: DataFrame, columns: DataFrame, keys: DataFrame) -> DataFrame:
    return declared_edges(keys).unionByName(inferred_edges(objects, columns, keys))


def overlay_edges(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges with those of changes (src, dst, via, cols, disabled): the same src, dst and via are replaced, new ones added, disabled ones dropped."""
    keys = ["src", "dst", "via"]
    kept = edges.join(changes.select(*keys), keys, "left_anti")
    return kept.unionByName(changes.where("NOT disabled").select(*keys, "cols", F.lit(False).alias("inferred")))


def join_paths(edges: DataFrame, sources: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """src, dst, hops, path: for each source (column node) the shortest path to every node, ties by the path's text.

    Edges work both ways; disabled ones are left out before. The hops are few, so each is one join.
    """
    both = edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = both.select(F.col("src").alias("from"), F.col("dst").alias("to"))
    found = sources.select(F.col("node").alias("src"), F.col("node").alias("at"), F.lit(0).alias("hops"), F.array("node").alias("path"))
    every = found
    for _ in range(max_hops):
        found = found.join(both, found["at"] == both["from"]).where(~F.expr("array_contains(path, `to`)")).select("src", F.col("to").alias("at"), (F.col("hops") + 1).alias("hops"), F.array_append("path", F.col("to")).alias("path"))
        found = found.withColumn("rn", F.row_number().over(Window.partitionBy("src", "at").orderBy(F.array_join("path", ">")))).where("rn = 1").drop("rn")
        every = every.unionByName(found)
    text = F.array_join("path", " > ")
    best = every.withColumn("rn", F.row_number().over(Window.partitionBy("src", "at").orderBy("hops", text))).where("rn = 1 AND hops > 0")
    return best.select("src", F.col("at").alias("dst"), "hops", text.alias("path"))


def missing_keys(edges: DataFrame) -> DataFrame:
    """Inferred edges that nobody has declared."""
    return edges.where("inferred").select("src", "via", "dst", "cols")


def unindexed_keys(keys: DataFrame, indexes: DataFrame) -> DataFrame:
    """Foreign keys whose first column leads no index."""
    leading = indexes.select("ref", F.col("columns")[0].alias("lead")).distinct()
    firsts = keys.select("ref", "name", F.col("columns")[0].alias("lead"), F.array_join("columns", ",").alias("cols"))
    return firsts.join(leading, ["ref", "lead"], "left_anti").select("ref", "name", "cols")


def orient(objects: DataFrame, columns: DataFrame, edges: DataFrame, limit: int = 40) -> DataFrame:
    """A digest of at most ``limit`` objects: ref, kind, ~rows, name:type columns (! for not null) and joins."""
    cols = columns.groupBy("ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.concat("name", F.lit(":"), "type", F.when(F.col("not_null"), "!").otherwise("")).alias("d")))), lambda c: c["d"]), ", ").alias("columns"))
    joins = edges.groupBy(F.col("src").alias("ref")).agg(F.array_join(F.array_sort(F.collect_list(F.concat("dst", F.lit(" ("), "cols", F.lit(")")))), ", ").alias("joins"))
    shown = objects.where(~F.col("excluded")).orderBy("ref").limit(limit)
    return shown.join(cols, "ref", "left").join(joins, "ref", "left").select("ref", "kind", F.concat(F.lit("~"), F.col("row_estimate").cast("long").cast("string")).alias("rows"), F.coalesce("columns", F.lit("")).alias("columns"), F.coalesce("joins", F.lit("")).alias("joins"))
