"""What the corpus operators share: the shared folder, Arrow batches of bounded bytes, input columns."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Text bytes that one call of a batch function sees, unless a single text is longer.
BATCH_BYTES = 8 << 20

#: Rows that Spark puts into one Arrow batch; keeps a batch of long texts small.
ARROW_ROWS = 1000


#: Bytes of files up to which a table in few files is dealt to all cores.
SMALL_BYTES = 64 << 20

#: Whether Spark deletes a query's shuffle files once it has run.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Tables of this process that are still in the shared folder.
_WRITTEN: list[DataFrame] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as the session names it.

    ``spark.checkpoint.dir`` is read first, then the context's checkpoint folder. Where neither is set a new local folder is made
    and set on a local master (single-machine tests); on a cluster that is an error, since its machines share no such folder.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tidewell-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes a table into the shared folder and reads it again: cuts lineage, survives lost executors.

    Shuffle files of the write go as soon as it ends, by Spark's own setting: else they stay until the driver's heap is collected after
    Python's references have been given up, which a thread of py4j does up to a second late.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewell-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidewell_path = path
    _WRITTEN.append(out)
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of queries that ``materialize`` did not write: it notices that nothing needs them when the driver's heap is collected."""
    spark.sparkContext._jvm.System.gc()


def discard(table: DataFrame) -> None:
    """Deletes a table that ``materialize`` wrote, once nothing reads it any more."""
    path = table._tidewell_path
    spark = table.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    _WRITTEN[:] = [t for t in _WRITTEN if t is not table]


@atexit.register
def clean() -> None:
    """Deletes all tables of this process that are left, at its end or when called; their results must have been read by then."""
    for t in list(_WRITTEN):
        if t.sparkSession.sparkContext._jsc is not None:  # else the session has ended and took the way to the files along
            discard(t)


@contextlib.contextmanager
def scratch():
    """Deletes, at its end, the tables that operators wrote inside but those put into the list that it gives.

    What depends on the others must have been read by then.
    """
    before, spared = list(_WRITTEN), []
    try:
        yield spared
    finally:
        for t in [t for t in _WRITTEN if not any(t is b for b in [*before, *spared])]:
            discard(t)


def inputs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """Only the id as ``doc_id`` and the text as ``text`` (null: empty), whatever other columns there are."""
    return spread(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), *more))


def spread(df: DataFrame) -> DataFrame:
    """Deals a small table in few files to all cores: a file's row group is read by one task. Larger tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < SMALL_BYTES
    return df.repartition(cores) if small and 0 < len(df.inputFiles()) < cores else df


def typed(df: DataFrame, names: list[str]) -> str:
    """Columns with their types, each followed by a comma, to begin a schema with."""
    return "".join(f"`{n}` {df.schema[n].dataType.simpleString()}, " for n in names)


def carried(table: pa.Table, names: list[str]) -> dict[str, pa.ChunkedArray]:
    return {n: table[n] for n in names}


def prepare(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch to ARROW_ROWS rows, if it is higher; lets Python workers find this package."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))


def pieces(batches: Iterator[pa.RecordBatch], limit: int, col: str = "text") -> Iterator[pa.Table]:
    """Tables of about ``limit`` bytes of ``col``: batches are joined or cut, rows never."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit - size, "right")))
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1]) - before
            start = stop
            if size >= limit or start < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.Table], pa.Table | None]], schema: str, limit: int = BATCH_BYTES, col: str = "text") -> DataFrame:
    """Applies ``make()`` (called once a task) to tables of about ``limit`` bytes of ``col``.

    The function may return None or a table; its columns follow ``schema``.
    """
    prepare(df.sparkSession)

    def run(batches):
        f = make()
        for table in pieces(batches, limit, col):
            out = f(table)
            if out is not None and out.num_rows:
                yield from out.combine_chunks().to_batches(max_chunksize=ARROW_ROWS)
            out = table = None
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives freed memory back to the system: Spark keeps Python workers, and what one stage held would add to the next one's."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def column(table: pa.Table, name: str) -> pa.Array:
    """A table's column as one contiguous array."""
    chunked = table.column(name)
    return chunked.chunk(0) if chunked.num_chunks == 1 else chunked.combine_chunks() if chunked.num_chunks else pa.array([], chunked.type)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of unsigned 64-bit numbers that spreads their bits."""
    # fixed values: multipliers of the public splitmix64 generator
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def bounded_sample(rows: DataFrame, group: str, most: int | dict[object, int], most_bytes: int) -> pa.Table:
    """A sample of (group, text) rows on the driver: of each group the distinct texts of least hash.

    A group gives at most ``most`` texts (or ``most[group]``) and as many as have ``most_bytes`` characters together (its first text always). Copies
    count once, so neither a repeated id nor a repeated text takes the sample. Candidates are thinned by hash and joined with
    their copies before they are ranked; null texts count as empty. In ascending order of group and hash.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy(group).count().collect()}
    empty = pa.table({group: pa.array([], pa.string()), "text": pa.array([], pa.string())})
    if not sizes:
        return empty
    hashed = rows.select(group, F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    most = most if isinstance(most, dict) else dict.fromkeys(sizes, most)
    # twice as many as are wanted pass, so that few groups fall short after copies are joined
    share = F.create_map(*[F.lit(x) for g, n in sizes.items() for x in (g, min(1.0, 2 * most[g] / n))])
    some = hashed.where(F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30) < share[F.col(group)])
    some = materialize(some.groupBy(group, "h").agg(F.min("text").alias("text")), "sample")
    w = Window.partitionBy(group).orderBy("h")
    limit = F.create_map(*[F.lit(x) for g in sizes for x in (g, most[g])])
    ranked = some.select(group, "h", F.row_number().over(w).alias("k"), F.sum(F.length("text")).over(w).alias("upto"), F.length("text").alias("n"))
    wanted = ranked.where((F.col("k") <= limit[F.col(group)]) & (F.col("upto") - F.col("n") < most_bytes)).select(group, "h")
    out = some.join(F.broadcast(wanted), [group, "h"]).toArrow()
    discard(some)
    return out.sort_by([(group, "ascending"), ("h", "ascending")]) if out.num_rows else empty


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
