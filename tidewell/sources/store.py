"""The search index on disk: one Parquet folder a relation under a new directory, then a pointer to it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = 1


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm.org.apache.hadoop.fs
    return jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), jvm.Path


def save(spark: SparkSession, root: str, relations: dict[str, DataFrame], fingerprint: str) -> str:
    """Writes all relations to a new version, then swaps the pointer. One build at a time: a lock file is created exclusively."""
    fs, path = _fs(spark, root)
    fs.mkdirs(path(root))
    if not fs.createNewFile(path(f"{root}/LOCK")):
        raise RuntimeError("another build holds the lock")
    try:
        version = uuid.uuid4().hex
        for name, df in relations.items():
            df.write.parquet(f"{root}/{version}/{name}")
        row = [(version, FORMAT, fingerprint, sorted(relations))]
        spark.createDataFrame(row, "version string, format int, fingerprint string, relations array<string>").write.mode("overwrite").parquet(f"{root}/POINTER")
        return version
    finally:
        fs.delete(path(f"{root}/LOCK"), False)


def load(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The relations of the stored index by name."""
    return read(spark, root)["relations"]


def read(spark: SparkSession, root: str) -> dict:
    """relations, version and fingerprint of the stored index."""
    manifest = spark.read.parquet(f"{root}/POINTER").first()
    if manifest["format"] != FORMAT:
        raise ValueError(f"index format {manifest['format']} is not {FORMAT}: rebuild it")
    return {"relations": {name: spark.read.parquet(f"{root}/{manifest['version']}/{name}") for name in manifest["relations"]}, "version": manifest["version"], "fingerprint": manifest["fingerprint"]}


def version(spark: SparkSession, root: str) -> str | None:
    """The version that the pointer names, from the pointer's file names alone: a new pointer has new ones."""
    fs, path = _fs(spark, root)
    if not fs.exists(path(f"{root}/POINTER")):
        return None
    return "|".join(sorted(f.getPath().getName() for f in fs.listStatus(path(f"{root}/POINTER")) if f.getPath().getName().startswith("part-")))


def status(spark: SparkSession, root: str, live_fingerprint: str) -> dict:
    """Whether an index exists and still fits; a missing one is no error."""
    fs, path = _fs(spark, root)
    if not fs.exists(path(f"{root}/POINTER")):
        return {"exists": False, "drift": None}
    manifest = spark.read.parquet(f"{root}/POINTER").first()
    return {"exists": True, "drift": manifest["fingerprint"] != live_fingerprint, "version": manifest["version"]}


def changed_objects(old: DataFrame, new: DataFrame) -> DataFrame:
    """Objects (ref, object_hash) that must be indexed again: new ones and those with another hash."""
    return new.join(old.select("ref", F.col("object_hash").alias("was")), "ref", "left").where(F.col("was").isNull() | (F.col("was") != F.col("object_hash"))).select("ref", "object_hash")
