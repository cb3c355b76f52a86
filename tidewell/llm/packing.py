"""Best-fit packing with certified bounds: documents' pieces into sequences of at most ``capacity`` tokens.

Pieces are dealt into groups of about ``GROUP`` rows. Each group is packed by best-fit decreasing, and dual-feasible
functions give a lower bound of its bins. A group whose bins equal its bound is certified: it keeps all bins but the
emptiest. A group with a gap keeps its full bins only (room of less than ``capacity // SLACK``); all its open bins are
exchanged. What is exchanged is dealt anew into groups of about ``GROUP`` pieces that are packed again, until one group is left or a round leaves as many
groups as it had; the last round keeps all its bins. So no task holds more than about ``GROUP`` rows, and nothing is dropped.

A document of more than ``capacity`` ids is cut so that its first piece takes the remainder and the others are full. Null
texts count as empty: with an end id such a document is one piece of one id, without one it has no ids and no piece.
Repeated rows are packed each; other columns are ignored; no documents give no pieces.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import tokens
from tidewell.llm.common import column, documents, inputs, map_batches, materialize

CAPACITY = 2048
GROUP, SLACK = 10_000, 256


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The most bins that any of three families of dual-feasible functions proves necessary."""
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    total = int(counts @ sizes)
    best = -(-total // capacity)
    # small items fall to 0, large ones rise to a whole bin: totals for all thresholds from running sums
    below, above = np.cumsum(counts * sizes), np.cumsum(counts[::-1])[::-1]
    for t in range(1, capacity // 2 + 1):
        whole = int(above[capacity - t + 1]) if capacity - t + 1 <= capacity else 0
        middle = int(below[capacity - t] - below[t - 1])
        best = max(best, whole + -(-middle // capacity))
    # rounding to multiples of capacity / k, and counts of items per k
    for k in range(1, 64):
        scaled = sizes * (k + 1)
        exact = scaled % capacity == 0
        best = max(best, -(-int((counts * np.where(exact, sizes * k, scaled // capacity * capacity)).sum()) // (capacity * k)))
    for t in range(2, min(64, capacity // 2) + 1):
        most = capacity // t
        value = np.where(sizes * 2 > capacity, 2 * (most - (capacity - sizes) // t), np.where(sizes * 2 == capacity, most, 2 * (sizes // t)))
        best = max(best, -(-int((counts * value).sum()) // (2 * most)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item and each bin's free room. Ties in length keep the order of the items."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    room: list[int] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by room
    rooms: list[int] = []  # the rooms that some open bin has, ascending
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        at = bisect.bisect_left(rooms, size)
        if at == len(rooms):
            b, left = len(room), capacity - size
            room.append(left)
        else:
            left = rooms[at]
            b = free[left].pop()
            if not free[left]:
                del rooms[at]
            left -= size
            room[b] = left
        bins[i] = b
        if left:
            if not free[left]:
                bisect.insort(rooms, left)
            free[left].append(b)
    return bins, np.array(room, np.int64)


def pack_group(lengths: np.ndarray, capacity: int, last: bool) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Bins of the items, which items stay in their bins, bins, bound. The last group keeps all."""
    bins, room = best_fit_decreasing(lengths, capacity)
    bound = lower_bound(lengths, capacity)
    kept = np.ones(len(room), bool)
    if not last:
        if len(room) == bound:
            kept[np.argmax(room)] = room.max(initial=0) == 0
        else:
            kept = room < max(1, capacity // SLACK)
    return bins, kept[bins], len(room), bound


def piece_starts(n: int, capacity: int) -> Iterable[int]:
    """Where the pieces of n ids start: the remainder first, then full pieces."""
    first = n % capacity or capacity
    return [0, *range(first, n, capacity)] if n else []


def make_pieces(docs: DataFrame, tokenizer_path: str, end_id: int | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table in the shared folder: uid, doc_id, piece, start, length, ids (little-endian, 2 or 4 bytes an id), ids_crc32.

    uid numbers the pieces by task and place; it is fixed by being written once. ids_crc32 is of 4-byte ids.
    """

    def make():
        from pyspark import TaskContext

        enc = tokens.encoder(tokenizer_path)
        at = [TaskContext.get().partitionId() << 40]

        def run(table: pa.Table) -> pa.Table:
            rows: list[list] = [[], [], [], [], [], [], []]
            for doc_id, ids in zip(column(table, "doc_id").to_pylist(), enc.encode(column(table, "text")), strict=True):
                if end_id is not None:
                    ids = np.append(ids, np.uint32(end_id))
                starts = piece_starts(len(ids), capacity)
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    part = ids[a:b].astype("<u4")
                    for values, x in zip(rows, (at[0], doc_id, k, a, b - a, part.astype(f"<u{enc.width}").tobytes(), zlib.crc32(part.tobytes())), strict=True):
                        values.append(x)
                    at[0] += 1
            return pa.table([pa.array(x, t) for x, t in zip(rows, (pa.int64(), table.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)], ["uid", "doc_id", "piece", "start", "length", "ids", "ids_crc32"])

        return run

    docs = inputs(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialize(map_batches(docs, make, f"uid long, doc_id {kind}, piece int, start long, length long, ids binary, ids_crc32 long"), "pieces")


def _packer(level: int, last: bool, capacity: int):
    """Packs the rows of one group; the place of a bin in the whole run is its sequence_id."""

    def pack(key, table):
        table = table.sort_by([("length", "descending"), ("uid", "ascending")])
        size = column(table, "length").to_numpy().astype(np.int64)
        bins, kept, n_bins, bound = pack_group(size, capacity, last)
        order = np.argsort(bins, kind="stable")
        running = np.cumsum(size[order]) - size[order]
        starts = np.searchsorted(bins[order], np.arange(n_bins))
        offset = np.empty(len(size), np.int64)
        offset[order] = running - running[starts][bins[order]]
        sequence = (level << 56) + (key[0].as_py() << 24) + bins
        first = np.arange(len(size)) == 0
        return pa.table({"uid": table["uid"], "length": table["length"], "sequence_id": sequence, "offset": offset, "kept": kept, "bins": np.where(first, n_bins, 0), "bound": np.where(first, bound, 0)})

    return pack


def assign(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, report: list | None = None) -> DataFrame:
    """uid, sequence_id, offset of every row of ``pieces`` (uid, length): a table in the shared folder.

    report gets a row for each round: groups, items, bins, sum of the groups' bounds, certified groups.
    """
    spark = pieces.sparkSession
    lengths = pieces.select("uid", "length")
    n, level, done, tables = lengths.count(), 0, [], []
    groups = max(1, -(-n // group))
    schema = "uid long, length long, sequence_id long, offset long, kept boolean, bins long, bound long"
    last = groups == 1
    while True:
        dealt = lengths.withColumn("g", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(groups)))
        packed = materialize(dealt.groupBy("g").applyInArrow(_packer(level, last, capacity), schema), f"packed{level}")
        tables.append(packed)
        if report is not None:
            report.append(packed.agg(F.count_if(F.col("bins") > 0), F.count("*"), F.sum("bins"), F.sum("bound"), F.count_if((F.col("bins") > 0) & (F.col("bins") == F.col("bound")))).first())
        done.append(packed.where("kept").select("uid", "sequence_id", "offset"))
        if last:
            break
        lengths = packed.where("not kept").select("uid", "length")
        before, groups, level = groups, max(1, -(-lengths.count() // group)), level + 1
        last = groups == 1 or groups >= before
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def pack(docs: DataFrame, tokenizer_path: str, end_id: int | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The tables of pieces (with their ids) and of their places; both have uid."""
    pieces = make_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col)
    return pieces, assign(pieces, capacity)


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """sequence_id, length, ids: the packed sequences, each at most one capacity long."""
    joined = pieces.select("uid", "length", F.hex("ids").alias("h")).join(places, "uid")
    grouped = joined.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "h"))).alias("parts"))
    return grouped.select("sequence_id", "length", F.unhex(F.array_join("parts.h", "")).alias("ids"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in the packed sequences."""
    import public_tokenizers

    pieces, places = pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return placed(pieces, places)


def placed(pieces: DataFrame, places: DataFrame) -> DataFrame:
    return pieces.drop("ids").join(places, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
