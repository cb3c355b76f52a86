"""Documents in blocks, and how often keys occur among all blocks.

A block is one row: some documents whose texts have about ``BLOCK_BYTES``, as a compressed Arrow stream. The
table of blocks is written once, so a block's documents and their order are the same in every pass over it.

A key is one unsigned 64-bit hash or several. A block sends each of its distinct keys once, ascending and dealt to buckets by their top bits,
with how often the block has it. A bucket sends back a class a key: 0 for a key that occurs once at all, k for one that occurs
2**k times or less, up to ``MOST``. So a key that every document holds costs no more than one per block, and no group is larger than
its bucket. A block sends at most one row a bucket and a key, and looks only at the buckets that its keys fall into: work and rows
grow with the keys, whatever the number of buckets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import column, materialize, pieces, prepare, release

BLOCK_BYTES, BLOCKS_PER_FILE = 4 << 20, 32
#: Keys that one bucket holds, about.
BUCKET_KEYS = 1 << 21


def write_blocks(docs: DataFrame) -> DataFrame:
    """The table of blocks (block, body) of docs, which has a column text."""
    prepare(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for table in pieces(batches, BLOCK_BYTES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table.combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "body"])
            block += 1

    spark, key = docs.sparkSession, "spark.sql.files.maxRecordsPerFile"
    before = spark.conf.get(key)
    spark.conf.set(key, BLOCKS_PER_FILE)  # a reader holds the rows of one file at most
    try:
        return materialize(docs.mapInArrow(run, "block long, body binary"), "blocks", "none")
    finally:
        spark.conf.set(key, before)


def block_table(body: bytes) -> pa.Table:
    with pa.ipc.open_stream(body) as reader:
        return reader.read_all()


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of the texts, split at ASCII white space and otherwise unchanged, and how many end with each text."""
    lists = pc.ascii_split_whitespace(texts)
    ends = np.asarray(lists.offsets).astype(np.int64)
    flat = lists.flatten()
    full = pc.not_equal(pc.binary_length(flat), 0)
    if len(flat) and not pc.all(full).as_py():
        counts = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        ends, flat = counts[ends], flat.filter(full)
    else:
        ends = ends - ends[0]
    return flat.dictionary_encode(), ends[1:]


def word_hashes(words: pa.DictionaryArray) -> np.ndarray:
    import xxhash

    distinct = np.fromiter(map(xxhash.xxh3_64_intdigest, words.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(words.dictionary))
    return distinct[words.indices.to_numpy(zero_copy_only=False).astype(np.int64)] if len(words) else np.empty(0, np.uint64)


def buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key, which rises with the key: key * buckets >> 64, by 32 bits."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def distinct_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows of keys (n, width), ascending, the place of each row among them, and how often each occurs."""
    n = len(keys)
    if not n:
        return keys, np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(keys[:, 0], kind="stable") if keys.shape[1] == 1 else np.lexsort(keys.T[::-1])
    ordered = keys[order]
    new = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(axis=1)])
    inverse = np.empty(n, np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ordered[new], inverse, np.diff(np.append(np.flatnonzero(new), n))


def planes(keys: np.ndarray, width: int) -> bytes:
    """Ascending keys (n, k) byte plane by byte plane, so that what neighbours share compresses; the first ``width`` bytes of each."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(len(keys), -1)[:, :width].T[::-1]).tobytes()


def from_planes(data: bytes, width: int) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(width, -1)[::-1]
    out = np.zeros((rows.shape[1], -(-width // 8) * 8), np.uint8)
    out[:, :width] = rows.T
    return out.view("<u8")


KEYS_SCHEMA = "bucket int, block long, keys binary, counts binary"
#: The highest class of a key.
MOST = 15


def key_rows(block: int, keys: np.ndarray, buckets: int, width: int = 8) -> pa.Table | None:
    """The rows that a block sends: its distinct keys (n, k) of ``width`` bytes by bucket, and how often it has each (up to 255)."""
    if not len(keys):
        return None
    distinct, _, counts = distinct_keys(keys)
    bucket = buckets_of(distinct[:, 0], buckets)
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = np.append(starts[1:], len(bucket))
    counts = np.minimum(counts, 255).astype(np.uint8)
    parts = [(planes(distinct[a:b], width), counts[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return pa.table([pa.array(bucket[starts], pa.int32()), pa.array([block] * len(parts), pa.int64()), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())], ["bucket", "block", "keys", "counts"])


def _nibbles(values: np.ndarray) -> bytes:
    values = np.append(values, np.uint8(0)) if len(values) % 2 else values
    return (values[::2] | values[1::2] << 4).astype(np.uint8).tobytes()


def _from_nibbles(data: bytes, n: int) -> np.ndarray:
    packed = np.frombuffer(data, np.uint8)
    return np.stack([packed & 15, packed >> 4], axis=1).ravel()[:n]


def classes(sent: DataFrame, width: int = 8) -> DataFrame:
    """For each block, its buckets and the classes of its keys in their order: block, found array<struct<bucket, classes>>."""

    def judge(key, table):
        keys = [from_planes(k, width) for k in column(table, "keys").to_pylist()]
        counts = np.concatenate([np.frombuffer(c, np.uint8) for c in column(table, "counts").to_pylist()]).astype(np.int64)
        _, inverse, _ = distinct_keys(np.concatenate(keys))
        total = np.bincount(inverse, counts)
        found = np.minimum(np.ceil(np.log2(total)), MOST).astype(np.uint8)[inverse]
        ends = np.cumsum([len(k) for k in keys])
        out = [_nibbles(found[e - len(k) : e]) for k, e in zip(keys, ends, strict=True)]
        return pa.table([table["block"], table["bucket"], pa.array(out, pa.binary())], ["block", "bucket", "classes"])

    found = sent.groupBy("bucket").applyInArrow(judge, "block long, bucket int, classes binary")
    return found.groupBy("block").agg(F.collect_list(F.struct("bucket", "classes")).alias("found"))


def classes_of(keys: np.ndarray, found: list[dict] | None, buckets: int) -> np.ndarray:
    """The class of each of a block's keys among all blocks."""
    if not len(keys) or not found:
        return np.zeros(len(keys), np.uint8)
    distinct, inverse, _ = distinct_keys(keys)
    bucket = buckets_of(distinct[:, 0], buckets)
    out = np.zeros(len(distinct), np.uint8)
    for f in found:
        a, b = np.searchsorted(bucket, [f["bucket"], f["bucket"] + 1])
        out[a:b] = _from_nibbles(f["classes"], b - a)
    return out[inverse]


def map_blocks(blocks: DataFrame, f: Callable[[dict], pa.Table | None], schema: str) -> DataFrame:
    """Applies ``f`` to each row (a dict) of a table of blocks."""
    prepare(blocks.sparkSession)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                out = f(batch.slice(k, 1).to_pylist()[0])
                if out is not None and out.num_rows:
                    yield from out.combine_chunks().to_batches(max_chunksize=1000)
                out = None
        release()

    return blocks.mapInArrow(run, schema)
