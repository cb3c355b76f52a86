"""Column profiles: counts, nulls, extremes, common values. One pass over a table for all of its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_text(df: DataFrame, name: str):
    kind = df.schema[name].dataType.typeName()
    col = F.col(f"`{name}`")
    if kind in ("timestamp", "timestamp_ntz"):
        return F.date_format(col, "yyyy-MM-dd HH:mm:ss")
    return F.to_json(col) if kind in ("array", "struct", "map") else col.cast("string")


def profile(df: DataFrame, ref: str, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """ref, col, n_rows, n_distinct, null_frac, min, max, avg_width: one row a column.

    Counts, extremes and widths of all columns come from one scan and are unpivoted afterwards. Exact distinct counts take one
    aggregate a column, each of which reads its own column alone; ``approximate`` counts them in the same scan by
    HyperLogLog, which keeps no values: the way for large tables.
    """
    names = columns or df.columns
    aggs = [F.count("*").alias("n")]
    for k, c in enumerate(names):
        text, col = as_text(df, c), F.col(f"`{c}`")
        plain = df.schema[c].dataType.typeName() in ("array", "struct", "map")
        own = text if plain else col
        aggs += [
            F.count(own).alias(f"f{k}"),
            *([F.approx_count_distinct(own).alias(f"d{k}")] if approximate else []),
            F.min(text if plain or df.schema[c].dataType.typeName() == "string" else own).alias(f"a{k}"),
            F.max(text if plain or df.schema[c].dataType.typeName() == "string" else own).alias(f"b{k}"),
            F.avg(F.octet_length(text)).alias(f"w{k}"),
        ]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("col"), F.col("n").alias("n_rows"), (F.col(f"d{k}") if approximate else F.lit(0).cast("long")).alias("n_distinct"), (1 - F.col(f"f{k}") / F.greatest(F.col("n"), F.lit(1))).alias("null_frac"), as_text(one, f"a{k}").alias("min"), as_text(one, f"b{k}").alias("max"), F.col(f"w{k}").alias("avg_width")) for k, c in enumerate(names)])
    out = one.select(F.explode(rows).alias("p")).select(F.lit(ref).alias("ref"), "p.*")
    if approximate:
        return out
    distinct = None
    for c in names:
        own = as_text(df, c) if df.schema[c].dataType.typeName() in ("array", "struct", "map") else F.col(f"`{c}`")
        n = df.agg(F.countDistinct(own).alias("d")).select(F.lit(c).alias("col"), "d")
        distinct = n if distinct is None else distinct.unionAll(n)
    return out.join(distinct, "col").select("ref", "col", "n_rows", F.col("d").alias("n_distinct"), "null_frac", "min", "max", "avg_width")


def top_values(df: DataFrame, ref: str, columns: list[str], k: int = 10) -> DataFrame:
    """ref, col, value, freq, share, rank: the k most common values, nulls left out, ties by value.

    Columns are unpivoted first, so all are counted in one shuffle of partial counts.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("col"), as_text(df, c).alias("value")) for c in columns])
    counted = df.select(F.explode(cells).alias("c")).select("c.*").where("value IS NOT NULL").groupBy("col", "value").agg(F.count("*").alias("freq"))
    totals = counted.groupBy("col").agg(F.sum("freq").alias("total"))
    w = Window.partitionBy("col").orderBy(F.desc("freq"), "value")
    best = counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.join(totals, "col").select(F.lit(ref).alias("ref"), "col", "value", "freq", (F.col("freq") / F.col("total")).alias("share"), "rank")


def sample_values(df: DataFrame, column: str, limit: int = 20) -> DataFrame:
    """The first distinct values of a column by their text, nulls left out."""
    return df.select(as_text(df, column).alias("value")).where("value IS NOT NULL").distinct().orderBy("value").limit(limit)


def enum_like(top: DataFrame, profiles: DataFrame, most: int = 20) -> DataFrame:
    """Text columns with few values, each with its values in order."""
    values = top.groupBy("ref", "col").agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("values"))
    few = profiles.where((F.col("n_distinct") > 0) & (F.col("n_distinct") <= most))
    return few.join(values, ["ref", "col"]).select("ref", "col", "n_distinct", "values")
