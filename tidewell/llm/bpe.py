"""Byte-level BPE encoding and decoding with the tiktoken library and a rank file.

Texts over ``LONG`` characters are cut before they reach the library, only where a white-space character follows
another character: every match of the pattern either ends there or starts there, so the cut never changes the ids.
Null texts count as empty; an empty text has no ids and decodes to no bytes. Every input row gives one output row,
repeated rows included; other columns are ignored. Ids decode to the exact UTF-8 bytes of the text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import column, documents, inputs, map_batches

#: Characters from which a text is cut into parts of about that length.
LONG = 1 << 16

_CUT = re.compile(r"(?<=\S)(?=[\t-\r ])")
_ENCODERS: dict = {}


def encoder(rank_path: str, pattern: str):
    """The tiktoken encoder of a local rank file, kept for the life of the process."""
    import tiktoken

    if (rank_path, pattern) not in _ENCODERS:
        with open(rank_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        _ENCODERS[rank_path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[rank_path, pattern]


def safe_parts(text: str, long: int = LONG) -> list[str]:
    """Cuts a long text before white space that follows another character; parts join to the text."""
    parts, start = [], 0
    while len(text) - start > long:
        cut = _CUT.search(text, start + long)
        if cut is None:
            break
        parts.append(text[start : cut.start()])
        start = cut.start()
    parts.append(text[start:])
    return parts


def encode(text: str, enc, long: int = LONG) -> list[int]:
    if len(text) <= long:
        return enc.encode_ordinary(text)
    return [i for part in safe_parts(text, long) for i in enc.encode_ordinary(part)]


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: little-endian unsigned 32-bit ids of the whole text, as bytes."""

    def make():
        enc = encoder(rank_path, pattern)

        def run(table: pa.Table) -> pa.Table:
            ids = [array("I", encode(text, enc)).tobytes() for text in column(table, "text").to_pylist()]
            return pa.table({"doc_id": table["doc_id"], "ids": pa.array(ids, pa.binary())})

        return run

    docs = inputs(docs, id_col, text_col)
    return map_batches(docs, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode_documents(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, ids and decoded: the bytes that the ids stand for."""

    def make():
        enc = encoder(rank_path, pattern)

        def run(table: pa.Table) -> pa.Table:
            decoded = [enc.decode_bytes(array("I", ids).tolist()) for ids in column(table, "ids").to_pylist()]
            return pa.table({"doc_id": table["doc_id"], "ids": table["ids"], "decoded": pa.array(decoded, pa.binary())})

        return run

    encoded = encoded.select("doc_id", "ids")
    return map_batches(encoded, make, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary", col="ids")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes of each document."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    out = decode_documents(encode_documents(documents(spark, sf_dir), path, pattern), path, pattern)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def reference(text: str | None, rank_path: str, pattern: str) -> tuple[int, str, str]:
    """The same digests by the library alone."""
    ids = encoder(rank_path, pattern).encode_ordinary(text or "")
    return len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()
