"""Catalog relations: objects, columns, keys. Spark's catalog keeps no constraints, so they come from a CatalogSpec."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    not_null: bool = False
    comment: str | None = None
    is_pk: bool = False
    pii: bool = False
    default: str | None = None


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    ref: str
    ref_columns: tuple[str, ...]
    name: str = ""


@dataclass(frozen=True)
class TableSpec:
    ref: str
    columns: tuple[ColumnSpec, ...]
    kind: str = "table"
    comment: str | None = None
    row_estimate: float = 0.0
    size_bytes: int = 0
    foreign_keys: tuple[ForeignKey, ...] = ()
    indexes: tuple[tuple[str, ...], ...] = ()
    excluded: bool = False
    definition: str | None = None

    @property
    def schema(self) -> str:
        return self.ref.split(".")[0]

    @property
    def name(self) -> str:
        return self.ref.split(".", 1)[1]


OBJECTS = "ref string, schema string, name string, kind string, comment string, row_estimate double, size_bytes long, excluded boolean, definition string, primary_key array<string>"
COLUMNS = "ref string, name string, type string, not_null boolean, comment string, ordinal int, is_pk boolean, pii boolean, default_value string"
KEYS = "ref string, name string, columns array<string>, ref_table string, ref_columns array<string>"
INDEXES = "ref string, columns array<string>"


@dataclass(frozen=True)
class CatalogSpec:
    """The objects of one database, as plain data; ``frames`` makes relations of them."""

    tables: tuple[TableSpec, ...] = field(default_factory=tuple)

    def objects(self, spark: SparkSession) -> DataFrame:
        rows = [(t.ref, t.schema, t.name, t.kind, t.comment, float(t.row_estimate), t.size_bytes, t.excluded, t.definition, [c.name for c in t.columns if c.is_pk]) for t in self.tables]
        return spark.createDataFrame(rows, OBJECTS)

    def columns(self, spark: SparkSession) -> DataFrame:
        rows = [(t.ref, c.name, c.type, c.not_null, c.comment, k, c.is_pk, c.pii, c.default) for t in self.tables for k, c in enumerate(t.columns, 1)]
        return spark.createDataFrame(rows, COLUMNS)

    def keys(self, spark: SparkSession) -> DataFrame:
        rows = [(t.ref, k.name or f"{t.name}_{k.columns[0]}_fkey", list(k.columns), k.ref, list(k.ref_columns)) for t in self.tables for k in t.foreign_keys]
        return spark.createDataFrame(rows, KEYS)

    def indexes(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t.ref, list(i)) for t in self.tables for i in t.indexes], INDEXES)


def from_frames(frames: dict[str, DataFrame], schema: str = "public") -> CatalogSpec:
    """A spec of tables by their Spark schemas alone, without keys."""
    return CatalogSpec(tuple(TableSpec(f"{schema}.{name}", tuple(ColumnSpec(f.name, f.dataType.simpleString(), not f.nullable) for f in df.schema)) for name, df in frames.items()))


def list_objects(objects: DataFrame, schema: str | None = "public", kind: str | None = None) -> DataFrame:
    """Objects by kind and name; ``matview`` and ``materialized_view`` mean the same, no schema means all."""
    kind = {"materialized_view": "matview"}.get(kind or "", kind)
    out = objects.where(~F.col("excluded"))
    if schema:
        out = out.where(F.col("schema") == schema)
    if kind:
        out = out.where(F.col("kind") == kind)
    return out.select("kind", "schema", "name", "row_estimate").dropDuplicates(["kind", "schema", "name"]).orderBy("kind", "schema", "name")


def object_hashes(objects: DataFrame, columns: DataFrame, keys: DataFrame) -> DataFrame:
    """ref, object_hash: SHA-1 over what defines an object, so an unchanged one is known without reading it."""
    cols = columns.groupBy("ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.concat_ws(":", "name", "type", F.col("not_null").cast("string"), F.coalesce("comment", F.lit(""))).alias("d")))), lambda x: x.d), ",").alias("cols"))
    fks = keys.groupBy("ref").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.array_join("columns", "+"), "ref_table", F.array_join("ref_columns", "+")))), ",").alias("fks"))
    joined = objects.join(cols, "ref", "left").join(fks, "ref", "left")
    parts = [F.col("kind"), F.col("row_estimate").cast("long").cast("string"), F.coalesce("comment", F.lit("")), F.coalesce("cols", F.lit("")), F.array_join("primary_key", ","), F.coalesce("fks", F.lit("")), F.coalesce("definition", F.lit(""))]
    return joined.select("ref", F.sha1(F.concat_ws(";;", *parts)).alias("object_hash"))


def fingerprint(objects: DataFrame) -> DataFrame:
    """One row: counts and totals of a catalog, to see whether an index is out of date."""
    one = objects.agg(F.count("*").alias("n"), F.coalesce(F.sum("row_estimate"), F.lit(0.0)).cast("long").alias("rows"), F.countDistinct("schema").alias("schemas"), F.coalesce(F.max("ref"), F.lit("")).alias("last"))
    return one.select(F.concat_ws("|", F.col("n").cast("string"), F.col("last"), F.col("rows").cast("string"), F.col("schemas").cast("string")).alias("fingerprint"))


def prefix_completion(names: DataFrame, prefix: str, limit: int = 50) -> DataFrame:
    """ref values that start with a prefix (as the whole ref or its bare name), ascending."""
    p = prefix.lower()
    return names.where(F.lower("ref").startswith(p) | F.lower(F.substring_index("ref", ".", -1)).startswith(p)).select("ref").orderBy("ref").limit(limit)


def overlay_objects(objects: DataFrame, changes: DataFrame) -> DataFrame:
    """Objects with comments and exclusions that changes (ref, comment, excluded) give; nulls leave what is there."""
    c = changes.select("ref", F.col("comment").alias("new_comment"), F.col("excluded").alias("new_excluded"))
    joined = objects.join(c, "ref", "left")
    return joined.withColumns({"comment": F.coalesce("new_comment", "comment"), "excluded": F.coalesce("new_excluded", "excluded")}).select(objects.columns)


def overlay_columns(columns: DataFrame, changes: DataFrame) -> DataFrame:
    """Columns with comments and protection that changes (ref, name, comment, pii) give."""
    c = changes.select("ref", "name", F.col("comment").alias("new_comment"), F.col("pii").alias("new_pii"))
    joined = columns.join(c, ["ref", "name"], "left")
    return joined.withColumns({"comment": F.coalesce("new_comment", "comment"), "pii": F.coalesce("new_pii", "pii")}).select(columns.columns)
