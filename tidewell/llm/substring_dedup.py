"""Substring dedup by recompression: removes every word covered by a window of words that also starts elsewhere.

1. Documents are put into blocks (``blocks``), and each is recompressed (``recompression``): rounds name runs and pairs by hashes,
   the same for equal substrings wherever they stand. Every window of ``window`` words is anchored at the high-level
   symbol of least hash among those that follow from the window's own words. So windows whose anchor occurs once are unique.
2. Windows with a shared anchor, and those that hold no whole symbol (inside long runs), are verified: two independent hashes
   of all their words, of 64 and 32 bits, are searched for among all such windows. No window is judged by its anchor alone.
3. Words of windows that occur twice, in one document or in two, are removed.

Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, unchanged. Null texts count as empty; documents of fewer words than the window
lose nothing. Repeated rows are documents of their own: from ``window`` words on, each removes the other. The order of rows
does not matter. Other columns are ignored.
"""

from __future__ import annotations

import functools
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import blocks as bl
from tidewell.llm import recompression
from tidewell.llm.common import carried, column, documents, free_shuffles, inputs, materialize, mix64, typed

WINDOW = 35
#: Words that an anchor stands for and keys of candidate windows a word, for the number of buckets.
WORDS_PER_BLOCK = bl.BLOCK_BYTES // 6

#: Bytes of a window's key.
KEY_BYTES = 12
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


@functools.lru_cache(4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base to the powers 0 to n - 1 modulo 2**64, and their inverses."""
    powers = np.full(n, base, np.uint64)
    inverse = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    powers[:1] = inverse[:1] = 1
    return np.cumprod(powers, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)


def window_keys(hashes: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Two hashes of the words of each window, of two bases over differently mixed words: (n, 2), the second of 32 bits."""
    n = 1 << max(10, int(len(hashes)).bit_length())
    out = np.empty((len(starts), 2), np.uint64)
    for k, base in enumerate(_BASES):
        powers, inverses = _powers(base, n)
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum((mix64(hashes + np.uint64(0x632BE59BD9B4E019)) if k else hashes) * powers[: len(hashes)], out=sums[1:])
        out[:, k] = mix64((sums[starts + window] - sums[starts]) * inverses[starts])
    out[:, 1] >>= np.uint64(32)
    return out


class Block:
    """A block's documents, words and windows."""

    def __init__(self, body: bytes, window: int):
        self.table = bl.block_table(body)
        self.words, self.ends = bl.words_of(column(self.table, "text"))
        self.hashes = bl.word_hashes(self.words)
        self.sizes = np.diff(self.ends, prepend=0)
        doc = np.repeat(np.arange(len(self.ends)), np.maximum(self.sizes - window + 1, 0))
        first = np.cumsum(np.maximum(self.sizes - window + 1, 0)) - np.maximum(self.sizes - window + 1, 0)
        self.starts = np.arange(len(doc)) - first[doc] + (self.ends - self.sizes)[doc]
        self.places = self.starts + doc + 1
        self.window = window

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The names of the used anchors, the index of each window's anchor among them (-1: none)."""
        symbols = recompression.recompress(self.hashes, self.ends)
        at = recompression.anchors(symbols, self.places, self.window)
        used, inverse = np.unique(at[at >= 0], return_inverse=True)
        own = np.full(len(at), -1, np.int64)
        own[at >= 0] = inverse
        return mix64(symbols.name[used]), own


def _candidates(block: Block, found: list | None, buckets: int) -> np.ndarray:
    """Which windows may occur twice: their anchor is shared, or they have none."""
    names, own = block.anchors()
    shared = np.append(bl.classes_of(names[:, None], found, buckets) > 0, True)
    return shared[own]


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), keep_whole: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, text: the kept words joined by one space, of every row of docs, and columns to carry.

    With ``keep_whole`` texts that lose nothing keep their white space.
    """
    docs = inputs(docs, id_col, text_col, *carry)
    names = ["doc_id", *carry]
    table = bl.write_blocks(docs)
    n_blocks = table.count()
    buckets = max(24, -(-n_blocks * WORDS_PER_BLOCK // (8 * bl.BUCKET_KEYS)))
    more = max(24, -(-n_blocks * WORDS_PER_BLOCK // bl.BUCKET_KEYS))

    def send_anchors(row: dict) -> pa.Table | None:
        names, _ = Block(row["body"], window).anchors()
        return bl.key_rows(row["block"], names[:, None], buckets)

    def send_windows(row: dict) -> pa.Table | None:
        block = Block(row["body"], window)
        marked = _candidates(block, row["found"], buckets)
        keys = window_keys(block.hashes, block.starts[marked], window)
        sent = bl.key_rows(row["block"], keys, more, KEY_BYTES)
        # bucket -1 keeps for the last pass which windows these were
        own = pa.table([pa.array([-1], pa.int32()), pa.array([row["block"]], pa.int64()), pa.array([b""], pa.binary()), pa.array([np.packbits(marked).tobytes()], pa.binary())], ["bucket", "block", "keys", "counts"])
        return own if sent is None else pa.concat_tables([own, sent])

    def finish(row: dict) -> pa.Table:
        block = Block(row["body"], window)
        drop = np.zeros(len(block.hashes) + 1, np.int64)
        if row["marked"] is not None:
            marked = np.flatnonzero(np.unpackbits(np.frombuffer(row["marked"], np.uint8), count=len(block.starts)))
            starts = block.starts[marked]
            starts = starts[bl.classes_of(window_keys(block.hashes, starts, window), row["found"], more) > 0]
            np.add.at(drop, starts, 1)
            np.add.at(drop, starts + window, -1)
        keep = np.cumsum(drop[:-1]) == 0
        removed = block.sizes - np.diff(np.concatenate([[0], np.cumsum(keep)])[block.ends], prepend=0)
        texts = []
        for text, a, b, n in zip(column(block.table, "text").to_pylist(), block.ends - block.sizes, block.ends, removed, strict=True):
            words = text.encode().split()  # at exactly the white space that separates words here
            if keep_whole and not n:
                texts.append(text)
                continue
            texts.append(b" ".join(words if not n else compress(words, keep[a:b].tolist())).decode())
        return pa.table(carried(block.table, names) | {"n_words": block.sizes, "n_removed": removed, "text": pa.array(texts, pa.string())})

    anchors = bl.classes(bl.map_blocks(table, send_anchors, bl.KEYS_SCHEMA))
    sent = materialize(bl.map_blocks(table.join(anchors, "block", "left"), send_windows, bl.KEYS_SCHEMA), "windows")
    free_shuffles(docs.sparkSession)
    marked = sent.where("bucket < 0").select("block", F.col("counts").alias("marked"))
    windows = bl.classes(sent.where("bucket >= 0"), KEY_BYTES)
    return bl.map_blocks(table.join(marked, "block", "left").join(windows, "block", "left"), finish, f"{typed(docs, names)}n_words long, n_removed long, text string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document, as counts and a digest."""
    out = dedup_substrings(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
windows AS (SELECT doc_id, p, md5(array_to_string(list_slice(ws, p, p + 34), ' ')) AS h FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 34)) AS p FROM w)),
again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
covered AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 34)) AS k FROM windows JOIN again USING (h)),
words AS (SELECT doc_id, unnest(generate_series(1, len(ws))) AS k, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS t FROM words ANTI JOIN covered USING (doc_id, k) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""


def brute_force(rows: list[tuple], window: int = WINDOW) -> dict:
    """doc_id -> (n_words, n_removed, kept text), comparing all windows' words."""
    import re
    from collections import Counter

    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", text or "")) for i, text in rows]
    seen = Counter(tuple(w[p : p + window]) for _, w in words for p in range(len(w) - window + 1))
    out = {}
    for i, w in words:
        drop = [False] * len(w)
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                drop[p : p + window] = [True] * window
        out[i] = (len(w), sum(drop), " ".join(x for x, d in zip(w, drop, strict=True) if not d))
    return out
