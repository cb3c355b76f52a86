"""Token-ID output: shards of zstandard frames, one frame a document, with one shared dictionary.

The dictionary is trained on the serialized ids of a bounded sample of documents (``SAMPLE_DOCS`` with the smallest hash
of their id, ``SAMPLE_BYTES`` at most; too few to train on: no dictionary). A shard is a byte string::

    magic "TWSHARD2" | sha256 of the dictionary (32) | id width (u8) | kind of doc_id (u8) | documents n (u32) | ids before it in its part (u64)
    | index | n_ids u32[n] | frame offset u64[n + 1] | frames

The index is doc_id i64[n] where doc_id is a whole number (kind 0); any other doc_id is its text (kind 1): u32[n] lengths, then the
UTF-8 bytes. So one short document is read by its index entry alone (``read_document``). Shards are the rows of a Parquet table,
since only Spark's own writers reach every store. Parts are ranges of ascending doc_id and their numbers ascend too; so do
the shards of a part and the documents of a shard. The ids before a document are its shard's start plus those before it there.

Null texts count as empty: a document then holds the end id alone. Rows with one doc_id are ordered by a hash of their
frames, so equal rows are interchangeable and a repeated id is split over parts like others; a null doc_id sorts first and comes
back as null. No documents: no shards.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm import tokens
from tidewell.llm.common import ARROW_ROWS, column, discard, documents, inputs, map_batches, materialize, prepare

MAGIC, HEAD = b"TWSHARD2", struct.Struct("<8s32sBBIQ")
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 1_000, 8 << 20, 64 << 10
SHARD_BYTES, LEVEL = 8 << 20, 3
#: What stands for null in an index: of numbers, and as the length of a text.
NULL_ID, NULL_LENGTH = -(1 << 63), (1 << 32) - 1
WHOLE_TYPES = ("tinyint", "smallint", "int", "bigint")


def _serialized(ids: np.ndarray, width: int, end_id: int | None) -> bytes:
    ids = ids if end_id is None else np.append(ids, np.uint32(end_id))
    return ids.astype(f"<u{width}").tobytes()


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int | None) -> bytes:
    """A zstandard dictionary of the sample, or no bytes if the sample is too small."""
    import zstandard

    hashed = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    last = hashed.select("h").orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    if last is None:
        return b""
    enc = tokens.encoder(tokenizer_path)
    sample, size = [], 0
    rows = hashed.where(F.col("h") <= last).select("h", F.length("text").alias("n"), "text").orderBy("h", "n", "text").limit(SAMPLE_DOCS)
    for row in rows.toLocalIterator():
        sample.append(_serialized(enc.encode(pa.array([row.text]))[0], enc.width, end_id))
        size += len(sample[-1])
        if size > SAMPLE_BYTES:
            break
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return b""


def _index(ids: list, kind: int) -> bytes:
    if not kind:
        return np.array([NULL_ID if i is None else i for i in ids], "<i8").tobytes()
    texts = [None if i is None else i.encode() for i in ids]
    return np.array([NULL_LENGTH if t is None else len(t) for t in texts], "<u4").tobytes() + b"".join(t or b"" for t in texts)


def pack_shard(dictionary: bytes, width: int, kind: int, before: int, ids: list, counts: list[int], frames: list[bytes]) -> bytes:
    head = HEAD.pack(MAGIC, hashlib.sha256(dictionary).digest(), width, kind, len(ids), before)
    index = _index(ids, kind) + np.array(counts, "<u4").tobytes()
    return b"".join([head, index, np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8").tobytes(), *frames])


class Shard:
    """A shard's documents by position; the dictionary must be the one that it was written with."""

    def __init__(self, data: bytes, dictionary: bytes):
        import zstandard

        magic, digest, self.width, kind, n, self.before = HEAD.unpack_from(data)
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not a shard, or one of another dictionary")
        at = HEAD.size
        if not kind:
            self.doc_ids = [None if i == NULL_ID else i for i in np.frombuffer(data, "<i8", n, at).tolist()]
            at += 8 * n
        else:
            lengths, at, self.doc_ids = np.frombuffer(data, "<u4", n, at).tolist(), at + 4 * n, []
            for size in lengths:
                text = None if size == NULL_LENGTH else data[at : at + size].decode()
                self.doc_ids.append(text)
                at += 0 if text is None else size
        self.counts = np.frombuffer(data, "<u4", n, at)
        self.offsets = np.frombuffer(data, "<u8", n + 1, at + 4 * n)
        self.frames = memoryview(data)[at + 12 * n + 8 :]
        self.decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, k: int) -> np.ndarray:
        raw = self.decompressor.decompress(self.frames[int(self.offsets[k]) : int(self.offsets[k + 1])])
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def read_document(data: bytes, dictionary: bytes, doc_id: int | str) -> np.ndarray | None:
    """The ids of the first document with that id, without touching the others' frames."""
    shard = Shard(data, dictionary)
    return shard.ids(shard.doc_ids.index(doc_id)) if doc_id in shard.doc_ids else None


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int | None = None, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bytes]:
    """The table of shards (part, seq, n_docs, n_ids, shard), written to the shared folder, and its dictionary."""
    docs = inputs(docs, id_col, text_col)
    kind = int(docs.schema["doc_id"].dataType.simpleString() not in WHOLE_TYPES)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("string" if kind else "long"))
    dictionary = train_dictionary(docs, tokenizer_path, end_id)

    def make_frames():
        import zstandard

        enc = tokens.encoder(tokenizer_path)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)

        def run(table: pa.Table) -> pa.Table:
            ids = enc.encode(column(table, "text"))
            frames = [compressor.compress(_serialized(i, enc.width, end_id)) for i in ids]
            return pa.table({"doc_id": table["doc_id"], "n_ids": pa.array([len(i) + (end_id is not None) for i in ids], pa.int64()), "frame": pa.array(frames, pa.binary())})

        return run

    frames = materialize(map_batches(docs, make_frames, f"doc_id {'string' if kind else 'long'}, n_ids long, frame binary"), "frames", "none")
    width = tokens.encoder(tokenizer_path).width
    prepare(docs.sparkSession)

    def shards(batches):
        from pyspark import TaskContext

        part, seq, before = TaskContext.get().partitionId(), 0, 0
        held: tuple[list, list, list] = ([], [], [])
        size = 0

        def flush():
            n = sum(held[1])
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (seq, pa.int32()), (len(held[0]), pa.int64()), (n, pa.int64()), (pack_shard(dictionary, width, kind, before, *held), pa.binary()))], ["part", "seq", "n_docs", "n_ids", "shard"])

        for batch in batches:
            for doc_id, n, frame in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if size and size + len(frame) > shard_bytes:
                    yield flush()
                    seq, before, held, size = seq + 1, before + sum(held[1]), ([], [], []), 0
                for values, x in zip(held, (doc_id, n, frame), strict=True):
                    values.append(x)
                size += len(frame)
        if held[0]:
            yield flush()

    hashed = frames.withColumn("h", F.xxhash64("frame"))
    ordered = hashed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "frame")
    out = materialize(ordered.select("doc_id", "n_ids", "frame").mapInArrow(shards, "part int, seq int, n_docs long, n_ids long, shard binary"), "shards", "none")
    discard(frames)
    return out, dictionary


def read_shards(shards: DataFrame, dictionary: bytes, id_type: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every document, from the stored shards.

    id_type is the type that doc_id had: whole numbers come back as such, all others as texts.

    The starts of parts come from one row a part; there are at most ``spark.sql.shuffle.partitions`` parts, so they are broadcast.
    """
    prepare(shards.sparkSession)
    kind = "bigint" if id_type in WHOLE_TYPES else "string"

    def read(batches):
        arrow = pa.int64() if kind == "bigint" else pa.string()
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(data, dictionary)
                starts = shard.before + np.cumsum(shard.counts, dtype=np.int64) - shard.counts
                for a in range(0, len(starts), ARROW_ROWS):
                    rows = range(a, min(a + ARROW_ROWS, len(starts)))
                    ids = [shard.ids(k) for k in rows]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(ids), pa.int32()), pa.array(shard.doc_ids[rows.start : rows.stop], arrow), pa.array(starts[rows.start : rows.stop]), pa.array([len(i) for i in ids], pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary())],
                        ["part", "doc_id", "local", "n_tokens", "ids"],
                    )

    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select(F.col("part"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = shards.select("part", "shard").mapInArrow(read, f"part int, doc_id {kind}, local long, n_tokens long, ids binary")
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("local") + F.col("before")).alias("start"), "n_tokens", "ids")


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents as shards and describes what is read back."""
    import public_tokenizers

    shards, dictionary = write_shards(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_shards(shards, dictionary).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def reference(rows: list[tuple[int, str | None]], tokenizer_path: str, end_id: int) -> list[tuple]:
    """doc_id, start, n_tokens, ids_crc32 of a few documents, by the library alone."""
    from tokenizers import Tokenizer

    tokenizer, start, out = Tokenizer.from_file(tokenizer_path), 0, []
    for doc_id, text in sorted(rows):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out
