"""SimHash near-dedup by a byte-position inverted index with count filtering.

A fingerprint has 64 bits, that is eight bytes. Fingerprints that differ in at most ``DISTANCE`` bits differ in at most that
many bytes, so they share at least 8 - DISTANCE bytes at equal positions. Lists of single bytes would hold one in 256 of all
fingerprints, so the index posts each distinct fingerprint under the bytes of every choice of 8 - DISTANCE positions instead: with
four of eight bytes 70 choices, and a posting list holds about one in 2**32 unrelated fingerprints. In a list the bytes that
a pair shares at equal positions are tallied; pairs that reach the guaranteed minimum are verified by their differing bits.

Copies collapse first: equal fingerprints are one entry. A posting list gives only links that join what is not joined yet
inside it, at most one fewer than its entries, so groups of near copies give no pairs of all with all. Lists of over
``LIST`` entries are cut into tiles of so many; each pair of tiles is one group, so no task holds more than two tiles and an
entry is copied once a tile.

Texts: A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, shingles are ``shingle`` words joined by spaces, repeats included; a
text of fewer words is one shingle, a text without words (or null) has fingerprint zero and links like any other. A bit is
set if it is set in over half of the shingles' hashes (XXH64 of UTF-8, seed 42). Repeated rows share a component.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import column, documents, inputs, map_batches, materialize, prepare
from tidewell.llm.components import components

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Entries of a posting list that one tile holds.
LIST = 20_000


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The hash of every shingle of one text, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # bytes.lower changes A-Z alone; bytes.split knows just this white space
    if not words:
        return np.empty(0, "<u8")
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = (ends - [len(w) + 1 for w in words])[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins, stops, strict=True)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The unsigned SimHash of shingle hashes."""
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The unsigned SimHash of one text."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: the fingerprint as a signed 64-bit number, of every row."""

    def make():
        def run(table: pa.Table) -> pa.Table:
            fps = np.array([fingerprint(t, shingle) for t in column(table, "text").to_pylist()], np.uint64)
            return pa.table({"doc_id": table["doc_id"], "fp": fps.view(np.int64)})

        return run

    docs = inputs(docs, id_col, text_col)
    return map_batches(docs, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def shared_bytes(differing: np.ndarray) -> np.ndarray:
    """How many bytes at equal positions pairs of fingerprints share, from the bits in which they differ."""
    return (np.ascontiguousarray(differing).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def list_links(entries: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Verified links that join all entries of a posting list that are linked inside it, without cycles.

    A search from each entry not reached yet: what it reaches leaves the list, so a dense list shrinks at once.
    """
    entries = np.unique(entries)
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    rest, queue = entries, []
    while len(rest):
        if queue:
            x = queue.pop()
        else:
            x, rest = rest[0], rest[1:]
        differing = rest ^ x
        near = shared_bytes(differing) >= 8 - distance
        near[near] = np.bitwise_count(differing[near]) <= distance
        if near.any():
            found = rest[near]
            a.append(np.full(len(found), x))
            b.append(found)
            queue.extend(found)
            rest = rest[~near]
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _keys(fps: np.ndarray, distance: int) -> np.ndarray:
    """The posting keys of each fingerprint, one column a choice of positions: the choice's number above its bytes."""
    out = []
    for number, chosen in enumerate(combinations(range(8), 8 - distance)):
        mask = np.uint64(sum(0xFF << 8 * p for p in chosen))
        out.append((fps & mask) ^ np.uint64((number + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return np.stack(out, axis=1)


def links(distinct: DataFrame, distance: int = DISTANCE, tile: int = LIST) -> DataFrame:
    """a, b: links that connect exactly the fingerprints (fp, one row each) that chains of near ones connect."""
    prepare(distinct.sparkSession)

    def post(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            keys = _keys(fps, distance)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fps, keys.shape[1]).view(np.int64))], ["key", "fp"])

    def rows(key, number, a, b):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(a), number, np.int32)), pa.array(a), pa.array(b)], ["key", "tile", "a", "b"])

    def whole(keys, fps):
        """The links of whole lists."""
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        u = fps.view(np.uint64)
        two = starts[sizes == 2]
        differing = u[two] ^ u[two + 1]
        two = two[(shared_bytes(differing) >= 8 - distance) & (np.bitwise_count(differing) <= distance)]
        a, b = [u[two]], [u[two + 1]]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            x, y = list_links(u[s : s + n], distance)
            a.append(x)
            b.append(y)
        a, b = np.concatenate(a), np.concatenate(b)
        return rows(np.zeros(len(a), np.int64), -1, a.view(np.int64), b.view(np.int64))

    def read(batches):
        """Lists of a partition sorted by key: links of the short ones, full tiles of the others."""
        held: list[np.ndarray] = []  # fingerprints of the list that is open
        key, size, tiles = None, 0, 0

        def closed():
            """The last tile of a list that was cut, or the links of a whole one."""
            fps = np.concatenate(held)
            keys = np.full(len(fps), key, np.int64)
            return rows(keys, tiles, fps, fps) if tiles else whole(keys, fps)

        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            while len(keys):
                if size and keys[0] != key:
                    yield closed()
                    held, size, tiles = [], 0, 0
                if not size:
                    last = int(np.searchsorted(keys, keys[-1], "left"))
                    if last:
                        yield whole(keys[:last], fps[:last])
                        keys, fps = keys[last:], fps[last:]
                    key = keys[0]
                n = int(np.searchsorted(keys, key, "right"))
                held.append(fps[:n])
                size += n
                keys, fps = keys[n:], fps[n:]
                if size > tile:
                    open_ = np.concatenate(held)
                    full = (size - 1) // tile * tile  # something stays, so a cut list always ends by a tile
                    for k in range(0, full, tile):
                        yield rows(np.full(tile, key, np.int64), tiles, open_[k : k + tile], open_[k : k + tile])
                        tiles += 1
                    held, size = [open_[full:]], size - full
        if size:
            yield closed()

    posted = distinct.select("fp").mapInArrow(post, "key long, fp long")
    found = materialize(posted.repartition("key").sortWithinPartitions("key").mapInArrow(read, "key long, tile int, a long, b long"), "links")
    short = found.where("tile < 0").select("a", "b")
    cut = found.where("tile >= 0")
    if cut.isEmpty():
        return short
    counts = cut.groupBy("key").agg(F.max("tile").alias("most"))
    paired = cut.join(counts, "key").select("key", "a", F.explode(F.transform(F.sequence(F.lit(0), "most"), lambda j: F.struct(F.least("tile", j).alias("i"), F.greatest("tile", j).alias("j")))).alias("p"))

    def of_tiles(table):
        a, b = list_links(column(table, "a").to_numpy().view(np.uint64), distance)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return short.unionAll(paired.groupBy("key", "p.i", "p.j").applyInArrow(of_tiles, "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the least doc_id of those that chains of near fingerprints reach), of every row."""
    fps = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    entries = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "entries")
    roots = components(links(entries, distance))
    joined = entries.join(roots, entries.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = materialize(joined.join(least, "root").select(F.col("fp").alias("entry"), "component_id"), "ids")
    return fps.join(ids, fps.fp == ids.entry).select("doc_id", "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def brute_force(rows: list[tuple], distance: int = DISTANCE, shingle: int = SHINGLE) -> dict:
    """doc_id -> (fingerprint, component_id), comparing all pairs and hashing shingle by shingle."""
    import re

    from xxhash import xxh64_intdigest

    fps = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))] if words else []
        hashes = [xxh64_intdigest(s.encode(), SEED) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    least: dict = {}
    for k, (doc_id, _) in enumerate(rows):
        least[root(k)] = min(doc_id, least.get(root(k), doc_id))
    return {doc_id: (f"{fps[k]:016x}", least[root(k)]) for k, (doc_id, _) in enumerate(rows)}
