"""Near duplicates by exact Jaccard similarity of shingle sets: SimHash finds links first, prefix filtering the others.

Two texts are linked if the sets of their shingles (simhash's words and hashes) have a Jaccard similarity of at least 4 / 5.
No SimHash distance guarantees that, so it only joins groups of near copies first:

1. Rows of equal sets are one entry. SimHash links between entries are verified by their texts; components are labelled.
2. All shingles have one order: by how often they occur among all documents (in powers of two, counted in blocks of
   documents, see ``blocks``), the rare ones first. Each set is posted under its first n - ceil(0.8 n) + 1, since two sets that
   are similar enough share one of these. A shingle that occurs once in all tables is not posted.
3. A posting list is of interest while its entries have different labels. A pair of it is a candidate only if sizes, what remains behind
   the shared shingle, and the bitmaps of both sets still allow the overlap that is needed. The bitmap holds the parities of the
   shingles in ``BITS`` classes: two sets differ in at least as many shingles as their bitmaps do in bits.
4. Candidates are verified by their texts in rounds. In the first, until one joins nothing (``ROUNDS`` at most), a set is paired with at most ``LEADERS`` others:
   for each of so many salts with the one of least salted name among the leaders of its lists, a list's leader being its set of least salted name.
   In the next (``NEAREST`` at most), a set is paired with one other: lists are dealt to parts of about ``PART_ROWS`` by salted name, and of all it meets there under
   another label it takes the one whose bitmap differs least. So groups of near copies join by links in proportion to their sets, those
   without a set that is similar to most others too. The last round takes all candidates whose labels still differ. Only bounds that
   hold for every similar pair drop any in it, the bitmaps' among them before a pair leaves its list, so no link is lost and a
   large group sends on few pairs that are not similar.

A set has a 64-bit name and shingles 64-bit hashes; collisions are not looked for. Texts without words (or null) are one entry.
A row is known by its id and the hash of its text, so null and repeated ids are rows like others. Lists of over ``LIST`` entries
are dealt to tiles by name, and each pair of tiles is one group: no task holds more than about two tiles.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import blocks as bl
from tidewell.llm.common import column, discard, free_shuffles, inputs, map_batches, materialize, mix64, prepare
from tidewell.llm.components import components
from tidewell.llm.simhash import links, majority, shingle_hashes

#: The least similarity as a fraction: bounds stay whole numbers.
PART, WHOLE = 4, 5
#: Bits of a set's bitmap; rounds of leaders, and leaders that a set is paired with in one; entries of a tile.
BITS, ROUNDS, LEADERS, LIST = 512, 3, 4, 4_000
#: Rounds of the nearest, and entries of a part of a list in them.
NEAREST, PART_ROWS = 12, 500
#: Distinct shingles of a block, about, for the number of buckets.
KEYS_PER_BLOCK = bl.BLOCK_BYTES // 6


def least_overlap(a, b):
    """Shingles that sets of a and b shingles must share to be similar."""
    return -(-PART * (a + b) // (PART + WHOLE))


def _set(text: str, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def _name(hashes: np.ndarray) -> int:
    return int(mix64(mix64(hashes).sum(dtype=np.uint64)[None] + np.uint64(len(hashes))).view(np.int64)[0])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    return len(np.intersect1d(a, b, assume_unique=True)) >= least_overlap(len(a), len(b))


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """The parity of the set's hashes in each of BITS classes, as signed 64-bit words."""
    return np.packbits(np.bincount((mix64(hashes) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).view(np.int64)


def _named(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, h, fp, name of every row."""

    def make():
        def run(table: pa.Table) -> pa.Table:
            fps, names = [], []
            for text in column(table, "text").to_pylist():
                hashes = shingle_hashes(text, shingle)
                fps.append(majority(hashes))
                names.append(_name(np.unique(hashes)))
            return pa.table({"doc_id": table["doc_id"], "h": table["h"], "fp": np.array(fps, np.uint64).view(np.int64), "name": np.array(names, np.int64)})

        return run

    return map_batches(docs, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h long, fp long, name long")


def prefix(hashes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of a set's first hashes in the order of rank and hash, as many as a similar set must share one of."""
    n = len(hashes)
    return np.lexsort((hashes, rank))[: n - -(-PART * n // WHOLE) + 1 if n else 0]


def _posted(docs: DataFrame, shingle: int) -> DataFrame:
    """key, name, n, place: the prefix of each set without the shingles that occur once in all documents.

    Each set has one more row, without key and place, with its bitmap in bits.
    """
    table = bl.write_blocks(docs)
    buckets = max(24, -(-table.count() * KEYS_PER_BLOCK // bl.BUCKET_KEYS))

    def sets(row: dict) -> dict[int, np.ndarray]:
        out = {}
        for text in column(bl.block_table(row["body"]), "text").to_pylist():
            hashes = _set(text, shingle)
            out[_name(hashes)] = hashes
        return out

    def send(row: dict) -> pa.Table | None:
        return bl.key_rows(row["block"], np.concatenate(list(sets(row).values()))[:, None], buckets)

    def post(row: dict) -> pa.Table | None:
        own = sets(row)
        ranks, at, out = bl.classes_of(np.concatenate(list(own.values()))[:, None], row["found"], buckets), 0, []
        for name, hashes in own.items():
            rank = ranks[at : at + len(hashes)]
            at += len(hashes)
            first = prefix(hashes, rank)
            places = np.flatnonzero(rank[first])
            if len(places):
                out.append((hashes[first[places]].view(np.int64), name, len(hashes), places, bitmap(hashes)))
        if not out:
            return None
        sizes = [len(x[0]) for x in out]
        names, n = np.array([x[1] for x in out], np.int64), np.array([x[2] for x in out], np.int32)
        lists = pa.table({"key": np.concatenate([x[0] for x in out]), "name": np.repeat(names, sizes), "n": np.repeat(n, sizes), "place": np.concatenate([x[3] for x in out]).astype(np.int32), "bits": pa.nulls(sum(sizes), pa.list_(pa.int64()))})
        return pa.concat_tables([lists, pa.table({"key": pa.nulls(len(out), pa.int64()), "name": names, "n": n, "place": pa.nulls(len(out), pa.int32()), "bits": pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * (BITS // 64), np.concatenate([x[4] for x in out]))})])

    found = bl.classes(bl.map_blocks(table, send, bl.KEYS_SCHEMA))
    out = materialize(bl.map_blocks(table.join(found, "block", "left"), post, "key long, name long, n int, place int, bits array<long>"), "posted")
    discard(table)
    free_shuffles(docs.sparkSession)
    return out


def possible(n_a, n_b, rest_a, rest_b):
    """Whether sets of n shingles, of which ``rest`` lie from the shared one on, may share enough; on numbers, arrays or columns."""
    return (WHOLE * n_a >= PART * n_b) & (WHOLE * n_b >= PART * n_a) & ((PART + WHOLE) * rest_a >= PART * (n_a + n_b)) & ((PART + WHOLE) * rest_b >= PART * (n_a + n_b))


def _near(n_a, n_b, bits_a: np.ndarray, bits_b: np.ndarray):
    """Whether bitmaps allow that sets are similar, and in how many bits they differ: sets differ in at least as many shingles."""
    differ = np.bitwise_count(bits_a ^ bits_b).sum(axis=-1, dtype=np.int64)
    return (PART + WHOLE) * (n_a + n_b - differ) >= 2 * PART * (n_a + n_b), differ


def list_pairs(name: np.ndarray, label: np.ndarray, n: np.ndarray, place: np.ndarray, tile: np.ndarray | None = None, bits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of different labels of one posting list; with tile only pairs of two tiles, with bits only those that bitmaps allow."""
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if len(n) > 1 and (label != label[0]).any():
        order = np.argsort(n, kind="stable")
        name, label, n, rest = name[order], label[order], n[order].astype(np.int64), (n - place)[order].astype(np.int64)
        tile = None if tile is None else tile[order]
        bits = None if bits is None else bits[order]
        stops = np.searchsorted(n, n * WHOLE // PART, "right")
        for i in range(len(n) - 1):
            j = np.arange(i + 1, stops[i])
            j = j[(label[j] != label[i]) & possible(n[i], n[j], rest[i], rest[j])]
            if tile is not None:
                j = j[tile[j] != tile[i]]
            if bits is not None:
                j = j[_near(n[i], n[j], bits[i], bits[j])[0]]
            a.append(np.full(len(j), name[i]))
            b.append(name[j])
    return np.concatenate(a), np.concatenate(b)


def list_nearest(name: np.ndarray, label: np.ndarray, n: np.ndarray, place: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each set of one posting list that has one, the candidate of another label whose bitmap differs least; name, other, share of bits."""
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    n = n.astype(np.int64)
    rest = n - place
    if len(n) > 1 and (label != label[0]).any():
        for i in range(len(n)):
            j = np.flatnonzero((label != label[i]) & possible(n[i], n, rest[i], rest))
            ok, differ = _near(n[i], n[j], bits[i], bits[j])
            if ok.any():
                share = np.where(ok, differ / (n[i] + n[j]), 2.0)
                k = np.lexsort((name[j], share))[0]
                out.append((name[i : i + 1], name[j[k] : j[k] + 1], share[k : k + 1]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _columns(table) -> list[np.ndarray]:
    return [column(table, c).to_numpy() for c in ("name", "label", "n", "place")]


def _bits(table) -> np.ndarray:
    return column(table, "bits").flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64)  # bits of signed numbers are those of their absolute values


def _pairs_table(a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _live(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The posting lists whose entries have different labels, with size: a table in the shared folder."""
    labelled = lists.join(labels, lists.name == labels.node, "left").select(*lists.columns, F.coalesce("root", "name").alias("label"))
    mixed = labelled.groupBy("key").agg(F.count("*").alias("size"), F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
    return materialize(labelled.join(mixed.select("key", "size"), "key"), "live")


def _proposed(live: DataFrame, salt: int) -> DataFrame:
    """a, b: each set a with at most LEADERS others, one a salt."""
    salts = range(salt * LEADERS, (salt + 1) * LEADERS)
    lead = [F.min(F.struct(F.xxhash64("name", F.lit(k)).alias("rank"), "name", "label", "n", "place")).alias(f"l{k}") for k in salts]
    led = live.groupBy("key").agg(*lead)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("salt"), F.col(f"l{k}").alias("l")) for k in salts])).alias("x")
    met = live.join(led.select("key", each), "key").where("label <> x.l.label")
    met = met.where(possible(F.col("n"), F.col("x.l.n"), F.col("n") - F.col("place"), F.col("x.l.n") - F.col("x.l.place")))
    best = met.groupBy("name", F.col("x.salt").alias("salt")).agg(F.min(F.struct("x.l.rank", "x.l.name")).alias("best"))
    return best.select(F.col("name").alias("a"), F.col("best.name").alias("b"))


def _with_bits(live: DataFrame, sets: DataFrame) -> DataFrame:
    """The posting lists with bitmaps: each set that is posted has one."""
    return live.join(sets.select("name", "bits"), "name")


def _whole(rows: DataFrame, by: list[str], f, schema: str) -> DataFrame:
    """Applies ``f`` to tables of whole lists, rows that agree in the columns ``by``, and where each list begins."""
    prepare(rows.sparkSession)

    def read(batches):
        held: list[pa.Table] = []

        def some(table: pa.Table):
            keys = np.stack([column(table, c).to_numpy().astype(np.int64) for c in by], axis=1)
            bounds = np.append(np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])), len(keys))
            return f(table, bounds).combine_chunks().to_batches(max_chunksize=10_000)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in by], axis=1)
            same = (keys == keys[-1]).all(axis=1)
            at = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
            if at or held and [held[0][c][0].as_py() for c in by] != keys[0].tolist():
                yield from some(pa.concat_tables([*held, pa.Table.from_batches([batch.slice(0, at)])]))
                held = []
            held.append(pa.Table.from_batches([batch.slice(at)]))
        if held:
            yield from some(pa.concat_tables(held))

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(read, schema)


def _nearest(live: DataFrame, sets: DataFrame, salt: int) -> DataFrame:
    """a, b: each set with the nearest by bitmaps, of another label, that it meets in parts of its lists."""

    def of_lists(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        cols = [*_columns(table), _bits(table)]
        found = [list_nearest(*(c[s:e] for c in cols)) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.table(dict(zip(("a", "b", "share"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    parts = live.withColumn("part", F.pmod(F.xxhash64("name", F.lit(salt)), F.ceil(F.col("size") / PART_ROWS)).cast("int"))
    met = _whole(_with_bits(parts, sets).select("key", "part", "name", "label", "n", "place", "bits"), ["key", "part"], of_lists, "a long, b long, share double")
    best = met.groupBy("a").agg(F.min(F.struct("share", "b")).alias("best"))
    return best.select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b"))


def _candidates(live: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: all candidate pairs of the posting lists that bitmaps allow."""

    def of_lists(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        cols, bits = _columns(table), _bits(table)
        found = [list_pairs(*(c[s:e] for c in cols), bits=bits[s:e]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
        return _pairs_table(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))

    live = _with_bits(live, sets)
    order = ("key", "name", "label", "n", "place", "bits")
    short = _whole(live.where(F.col("size") <= LIST).select(*order), ["key"], of_lists, "a long, b long")
    tiles = F.ceil(F.col("size") / LIST).cast("int")
    long = live.where(F.col("size") > LIST).withColumn("tile", F.pmod(F.xxhash64("name"), tiles).cast("int"))
    dealt = long.withColumn("j", F.explode(F.sequence(F.lit(0), tiles - 1))).select(*order, "tile", F.least("tile", "j").alias("lo"), F.greatest("tile", "j").alias("hi"))

    def of_tiles(table):
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        return _pairs_table(*list_pairs(*_columns(table), None if lo == hi else column(table, "tile").to_numpy(), _bits(table)))

    return short.unionAll(dealt.groupBy("key", "lo", "hi").applyInArrow(of_tiles, "a long, b long"))


def _differ(a, b):
    """In how many bits two columns of bitmaps differ, as a column."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, k: total + k)


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Those pairs (a, b) of names that are similar: by their bitmaps first, then by the shingles of their texts."""
    x, y = (sets.select(F.col("name").alias(c), F.col("bits").alias(f"bits_{c}"), F.col("n").alias(f"n_{c}")) for c in "ab")
    n = F.col("n_a") + F.col("n_b")
    # sets differ in at least as many shingles as their bitmaps do in bits; a pair without bitmaps is read
    near = pairs.distinct().join(x, "a", "left").join(y, "b", "left").where(F.coalesce((PART + WHOLE) * (n - _differ(F.col("bits_a"), F.col("bits_b"))) >= 2 * PART * n, F.lit(True)))
    near = materialize(near.select("a", "b"), "pairs")
    both = near.join(texts.select(F.col("name").alias("a"), "text"), "a").join(texts.select(F.col("name").alias("b"), F.col("text").alias("other")), "b")

    def make():
        of = functools.lru_cache(2_000)(lambda text: _set(text, shingle))

        def run(table: pa.Table) -> pa.Table:
            keep = [similar(of(x), of(y)) for x, y in zip(column(table, "text").to_pylist(), column(table, "other").to_pylist(), strict=True)]
            return table.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return run

    return materialize(map_batches(both.select("a", "b", "text", "other"), make, "a long, b long"), "verified")


def _joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """node, root after more links (a, b) of nodes: only the links between labels are looked at, each pair of labels once."""
    x, y = (labels.select(F.col("node").alias(f"node_{c}"), F.col("root").alias(f"root_{c}")) for c in "ab")
    named = more.join(x, F.col("a") == F.col("node_a"), "left").join(y, F.col("b") == F.col("node_b"), "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    new = components(named.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    to = new.select(F.col("node").alias("old"), F.col("root").alias("new"))
    moved = labels.join(to, labels.root == to.old, "left").select("node", F.coalesce("new", "root").alias("root"))
    return materialize(moved.unionByName(new.join(labels, "node", "left_anti").select("node", "root")), "labels")


def similar_rows(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (xxhash64 of the text, null as empty), least: doc_id and h of the first row of the component, of every row.

    Components are what chains of similar rows reach. First is the least doc_id (nulls last), then the least h.
    """
    docs = inputs(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    rows = materialize(_named(docs, shingle), "fingerprints")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    entries = materialize(rows.groupBy("name").agg(F.min(key).alias("first"), F.min("fp").alias("fp")), "entries")
    leads = materialize(entries.groupBy("fp").agg(F.min("name").alias("lead")), "leads")
    found = links(leads.select("fp"))
    x, y = (leads.select(F.col("fp").alias(c), F.col("lead").alias(f"lead_{c}")) for c in "ab")
    near = found.join(x, "a").join(y, "b").select(F.least("lead_a", "lead_b").alias("a"), F.greatest("lead_a", "lead_b").alias("b")).distinct()
    same = entries.join(leads, "fp").where("name <> lead").select(F.least("name", "lead").alias("a"), F.greatest("name", "lead").alias("b"))
    near = materialize(near.unionAll(same), "near")
    posted = _posted(docs, shingle)
    # copies of a set are posted alike, so any of them will do
    lists = posted.where("key IS NOT NULL").groupBy("key", "name").agg(F.min("n").alias("n"), F.min("place").alias("place"))
    lists = materialize(lists, "lists")
    shared = lists.groupBy("key").count().where("count > 1").select("key")
    lists = materialize(lists.join(shared, "key"), "lists")
    # the bitmaps and texts of all that may have a partner, fetched once
    wanted = materialize(lists.select("name").unionAll(near.select("a")).unionAll(near.select("b")).distinct(), "wanted")
    sets = materialize(posted.where("key IS NULL").groupBy("name").agg(F.min("n").alias("n"), F.first("bits").alias("bits")).join(wanted, "name", "left_semi"), "sets")
    discard(posted)
    first = entries.join(wanted, "name", "left_semi").select("name", F.col("first.doc_id").alias("id"), F.col("first.h").alias("h"))
    texts = docs.join(first, docs.doc_id.eqNullSafe(first.id) & (docs.h == first.h)).select("name", "text")
    texts = materialize(texts.groupBy("name").agg(F.min("text").alias("text")), "texts")
    free_shuffles(docs.sparkSession)
    labels = components(_verified(near, sets, texts, shingle))
    live = _live(lists, labels)
    for nearest, rounds in ((False, ROUNDS), (True, NEAREST)):
        for salt in range(rounds):
            more = _verified(_nearest(live, sets, salt) if nearest else _proposed(live, salt), sets, texts, shingle)
            if more.isEmpty():
                break
            discard(live)
            # one link a set is enough: what else it would join is a candidate later
            labels = _joined(labels, more if nearest else more.groupBy("a").agg(F.min("b").alias("b")))
            free_shuffles(docs.sparkSession)
            live = _live(lists, labels)
    # these join no more: all pairs that are left
    labels = _joined(labels, _verified(_candidates(live, sets), sets, texts, shingle))
    roots = labels
    joined = entries.join(roots, entries.name == roots.node, "left").select("name", "first", F.coalesce("root", "name").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("least"))
    ids = materialize(joined.join(least, "root").select("name", "least"), "ids")
    return rows.join(ids, "name").select("doc_id", "h", "least")


def brute_force(rows: list[tuple], shingle: int) -> list[set[int]]:
    """Components of row numbers, comparing the shingle sets of all pairs of (id, text)."""
    import re

    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))} if words else set())
    part = [{k} for k in range(len(rows))]
    for i in range(len(rows)):
        for j in range(i):
            if part[i] is not part[j] and min(len(sets[i]), len(sets[j])) * WHOLE >= PART * max(len(sets[i]), len(sets[j])):
                if WHOLE * len(sets[i] & sets[j]) >= PART * len(sets[i] | sets[j]):
                    part[i] |= part[j]
                    for k in part[j]:
                        part[k] = part[i]
    return [set(x) for x in {id(x): x for x in part}.values()]
