"""Labels of foreign keys, and references that are exact, ambiguous or nearly right."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LABELS = ("name", "title", "label", "display_name")
MOST_IDS = 50


def label_column(columns: list[tuple[str, str]], key: tuple[str, ...] = ()) -> str | None:
    """The column that names a row: a usual name, else the first text column that is no key."""
    names = {n.lower(): n for n, _ in columns}
    for label in LABELS:
        if label in names:
            return names[label]
    return next((n for n, kind in columns if kind in ("string", "varchar", "text") and n not in key), None)


def resolve_labels(rows: DataFrame, column: str, target: DataFrame, key: str, label: str, most_ids: int = MOST_IDS) -> DataFrame:
    """Adds <column>__resolved with the label that each id has in target; with over ``most_ids`` different ids nothing is looked up.

    The ids are collected up to that bound, so the target is filtered by a short list that reaches its scan.
    """
    ids = [r[0] for r in rows.select(column).where(F.col(column).isNotNull()).distinct().limit(most_ids + 1).collect()]
    if len(ids) > most_ids:
        return rows.withColumn(f"{column}__resolved", F.lit(None).cast("string"))
    found = target.where(F.col(key).isin(ids)).select(F.col(key).alias("__key"), F.col(label).cast("string").alias(f"{column}__resolved"))
    return rows.join(F.broadcast(found.dropDuplicates(["__key"])), rows[column] == F.col("__key"), "left").drop("__key")


def join_labels(rows: DataFrame, column: str, target: DataFrame, key: str, label: str) -> DataFrame:
    """Adds <column>__resolved as ``resolve_labels`` does, for any number of ids: a join, nothing is collected."""
    found = target.select(F.col(key).alias("__key"), F.col(label).cast("string").alias(f"{column}__resolved")).dropDuplicates(["__key"])
    return rows.join(found, rows[column] == F.col("__key"), "left").drop("__key")


def resolve_refs(refs: DataFrame, known: DataFrame, distance: int = 2) -> DataFrame:
    """asked, status (exact, unique, ambiguous, unknown), ref, choices, suggestion, for each asked reference.

    known has ref; bare names are compared without their schema. Suggestions are the closest bare names by edit distance.
    """
    bare = F.lower(F.substring_index("ref", ".", -1))
    names = known.select("ref", bare.alias("bare"))
    asked = refs.select("asked", F.lower("asked").alias("low"), F.lower(F.substring_index("asked", ".", -1)).alias("short"))
    exact = asked.join(names.select("ref", F.lower("ref").alias("low")), "low", "left").select("asked", "low", "short", F.col("ref").alias("exact"))
    by_name = asked.where(~F.contains("low", F.lit("."))).join(names, asked.short == names.bare).groupBy("asked").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("ref")), ", ").alias("choices"))
    near = asked.join(F.broadcast(names), F.levenshtein("short", "bare", distance) >= 0).withColumn("d", F.levenshtein("short", "bare"))
    best = near.withColumn("rn", F.row_number().over(Window.partitionBy("asked").orderBy("d", "ref"))).where("rn = 1").select("asked", F.col("ref").alias("suggestion"))
    joined = exact.join(by_name, "asked", "left").join(best, "asked", "left")
    status = F.when(F.col("exact").isNotNull(), "exact").when(F.col("n") == 1, "unique").when(F.col("n") > 1, "ambiguous").otherwise("unknown")
    return joined.select("asked", status.alias("status"), F.coalesce("exact", F.when(F.col("n") == 1, F.col("choices"))).alias("ref"), F.when(F.col("exact").isNull() & (F.col("n") > 1), F.col("choices")).alias("choices"), F.when(F.col("exact").isNull() & F.col("n").isNull(), F.col("suggestion")).alias("suggestion"))


def resolve_target(candidates: DataFrame, hint: str, object_scores: DataFrame | None = None, ratio: float = 0.85, most: int = 5) -> DataFrame:
    """Connections by how well their name, host or database fits a hint, plus ten times their best object's score.

    ``ambiguous`` marks winners whose runner-up comes within ``ratio``; at most ``most`` are listed.
    """
    from tidewell.functions.text import fuzzy_score

    scored = candidates.withColumn("fit", F.greatest(*[fuzzy_score(F.coalesce(F.col(c), F.lit("")), F.lit(hint)) for c in ("name", "host", "database")]))
    if object_scores is not None:
        scored = scored.join(object_scores.select("connection", "top_score"), "connection", "left").withColumn("fit", F.col("fit") + 10 * F.coalesce("top_score", F.lit(0.0)))
    ordered = scored.where("fit > 0").orderBy(F.desc("fit"), "connection").limit(most)
    w = Window.partitionBy(F.lit(1))
    second = F.sort_array(F.collect_list("fit").over(w), asc=False)
    return ordered.withColumn("all", second).select("connection", "fit", (F.when(F.size("all") > 1, F.col("all")[1] >= ratio * F.col("all")[0]).otherwise(False)).alias("ambiguous"))
