"""Media columns: MPEG transport streams written to and parsed from a binary column.

A stream holds one program: a PAT and a PMT packet, then one private elementary stream. The payload is cut into
access units of ``UNIT`` bytes; each becomes one PES packet with a presentation timestamp, split over 188-byte transport
packets with running continuity counters. Every ``RAP_EVERY``-th unit starts with an adaptation field that marks a
random-access point and carries a clock reference; the last packet of a unit is stuffed by its adaptation field.

Parsing takes nothing from the writer: it finds all elementary streams of all programs by PAT and PMT (sections of any number of
packets, with their CRCs), checks the continuity counters, joins the PES packets and returns each stream's payload with all
timestamps and random-access points; ``payload`` and its fellows are those of the first stream, ``streams`` has the others.
A packet that is sent twice in a row, as the standard allows, counts once. A jump of the counters is no error where the packet
announces it (discontinuity indicator). Scrambled packets and those marked as damaged are counted in ``errors`` and left out.
Null texts count as empty. A stream that is cut, lost its tables or fails a CRC has a null payload and its errors
counted; a gap in the counters is counted in ``cc_errors`` and the payload holds what arrived. Repeated rows give
repeated rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import column, documents, inputs, map_batches, materialize

# fixed values of the transport stream format (ISO/IEC 13818-1)
PACKET, SYNC, PAT_PID = 188, 0x47, 0x0000
STREAM_TYPE_PRIVATE_PES, STREAM_ID_PRIVATE_1 = 0x06, 0xBD
CLOCK_HZ, PTS_MODULUS = 90_000, 1 << 33
# this writer's choices
PMT_PID, ES_PID, PROGRAM = 0x1000, 0x0100, 1
UNIT, UNIT_TICKS, RAP_EVERY = 32_768, 3_003, 8

STREAM_SCHEMA = "program: int, pid: int, stream_type: int, payload: binary, pts: array<long>, unit_offsets: array<long>, random_access: array<int>, cc_errors: int, errors: int"
SCHEMA_PARSED = f"payload binary, pts array<long>, unit_offsets array<long>, random_access array<int>, packets int, cc_errors int, errors int, streams array<struct<{STREAM_SCHEMA}>>"


@functools.lru_cache(1)
def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 24
        for _ in range(8):
            value = (value << 1 ^ 0x04C11DB7 if value & 0x80000000 else value << 1) & 0xFFFFFFFF
        table.append(value)
    return table


def crc32_mpeg(data: bytes) -> int:
    """The CRC of program tables: polynomial 0x04C11DB7, not reflected, no final inversion."""
    table, value = _crc_table(), 0xFFFFFFFF
    for byte in data:
        value = (value << 8 & 0xFFFFFFFF) ^ table[value >> 24 ^ byte]
    return value


def _section_packet(pid: int, table_id: int, extension: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    section = bytes([table_id, 0xB0 | length >> 8, length & 0xFF]) + extension.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    section += crc32_mpeg(section).to_bytes(4, "big")
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


@functools.lru_cache(1)
def _tables() -> bytes:
    pat = _section_packet(PAT_PID, 0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    stream = bytes([STREAM_TYPE_PRIVATE_PES]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"
    return pat + _section_packet(PMT_PID, 0x02, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + stream)


def _pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


def _pcr_bytes(base: int) -> bytes:
    return (base << 15 | 0x7E00).to_bytes(6, "big")


def mux(payload: bytes, unit: int = UNIT) -> bytes:
    """A transport stream of the payload; the same bytes for the same payload."""
    out, counter = [_tables()], 0
    for k, start in enumerate(range(0, max(1, len(payload)), unit)):
        data = payload[start : start + unit]
        pts = k * UNIT_TICKS % PTS_MODULUS
        pes = b"\x00\x00\x01" + bytes([STREAM_ID_PRIVATE_1]) + (8 + len(data)).to_bytes(2, "big") + b"\x84\x80\x05" + _pts_bytes(pts) + data
        field = b"\x07\x50" + _pcr_bytes(pts) if k % RAP_EVERY == 0 else b""
        first = PACKET - 4 - len(field)
        n = 1 + max(0, -(-(len(pes) - first) // (PACKET - 4)))
        packets = np.zeros((n, PACKET), np.uint8)
        packets[:, 0] = SYNC
        packets[:, 1] = ES_PID >> 8
        packets[0, 1] |= 0x40
        packets[:, 2] = ES_PID & 0xFF
        packets[:, 3] = 0x10 | (counter + np.arange(n)) & 0x0F
        counter += n
        body = np.frombuffer(pes, np.uint8)
        if field:
            packets[0, 3] |= 0x20
        if n > 1:
            packets[0, 4:] = np.frombuffer(field + pes[:first], np.uint8)
            full = first + (n - 2) * (PACKET - 4)
            packets[1:-1, 4:] = body[first:full].reshape(n - 2, PACKET - 4)
            last, field = body[full:], b""
        else:
            last = body
        stuffing = PACKET - 4 - len(field) - len(last)
        if stuffing:
            packets[-1, 3] |= 0x20
            if not field:
                field = bytes([stuffing - 1]) + (b"\x00" + b"\xff" * (stuffing - 2) if stuffing > 1 else b"")
            else:
                field = bytes([field[0] + stuffing]) + field[1:] + b"\xff" * stuffing
        if field and n == 1 or stuffing:
            packets[-1, 4 : 4 + len(field)] = np.frombuffer(field, np.uint8)
        packets[-1, 4 + len(field) :] = last
        out.append(packets.tobytes())
    return b"".join(out)


def _payload(packets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each packet's data begin (the end of the packet if it has none), and its adaptation flags."""
    has_field, has_data = packets[:, 3] & 0x20 > 0, packets[:, 3] & 0x10 > 0
    skip = np.where(has_field, 5 + packets[:, 4].astype(np.int32), 4)
    return np.where(has_data, np.minimum(skip, PACKET), PACKET), np.where(has_field & (packets[:, 4] > 0), packets[:, 5], 0)


def _counted(packets: np.ndarray) -> tuple[np.ndarray, int]:
    """The packets of one pid without those sent twice, and the gaps of their continuity counters."""
    if len(packets) < 2:
        return packets, 0
    data = packets[:, 3] & 0x10 > 0
    _, flags = _payload(packets)
    counters = packets[:, 3].astype(np.int32) & 0x0F
    keep, gaps, last, repeated = np.ones(len(packets), bool), 0, -1, False
    own = np.flatnonzero(data)  # only packets with data advance the counter
    if not (np.diff(counters[own]) & 0x0F == 1).all():
        for i in own.tolist():
            jump = int(counters[i] - counters[last]) & 0x0F if last >= 0 else 1
            if jump == 0 and not repeated and _same(packets[last], packets[i]):
                keep[i], repeated = False, True
                continue
            gaps += jump != 1 and not flags[i] & 0x80
            last, repeated = i, False
    return packets[keep], gaps


def _same(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether a packet repeats the one before it: all bytes but a clock reference, which may be a new one."""
    if (a == b).all():
        return True
    if not a[3] & 0x20 or a[4] < 7 or not a[5] & 0x10:
        return False
    return bool((a[:6] == b[:6]).all() and (a[12:] == b[12:]).all())


def _sections(packets: np.ndarray) -> list[bytes]:
    """The sections that the packets of one pid carry, whole and with a right CRC, in their order."""
    packets, _ = _counted(packets)
    skip, _ = _payload(packets)
    out: list[bytes] = []
    held = b""
    open_ = False
    for packet, at in zip(packets, skip.tolist(), strict=True):
        data = packet[at:].tobytes()
        if packet[1] & 0x40:
            if not data:
                continue
            held += data[1 : 1 + data[0]] if open_ else b""
            parts = [held, data[1 + data[0] :]] if open_ else [data[1 + data[0] :]]
        else:
            parts = [held + data] if open_ else []
        for part in parts:
            while len(part) >= 3 and part[0] != 0xFF:
                length = 3 + (int.from_bytes(part[1:3], "big") & 0x0FFF)
                if len(part) < length:
                    break
                if length >= 12 and part[5] & 1 and not crc32_mpeg(part[:length]):  # that is in force now
                    out.append(part[:length])
                part = part[length:]
            held, open_ = part, bool(part) and part[0] != 0xFF
    return out


def _elementary(packets: np.ndarray) -> dict:
    """One elementary stream of its packets: payload, timestamps, random-access points."""
    packets, gaps = _counted(packets)
    out = {"payload": None, "pts": [], "unit_offsets": [], "random_access": [], "cc_errors": gaps, "errors": 0}
    starts = packets[:, 1] & 0x40 > 0
    skip, flags = _payload(packets)
    data = packets[np.arange(PACKET) >= skip[:, None]].tobytes()
    ends = np.cumsum(PACKET - skip)
    begins = np.flatnonzero(starts)
    at = [int(ends[i - 1]) if i else 0 for i in begins]
    units, size = [], 0
    for k, (i, begin) in enumerate(zip(begins, at, strict=True)):
        pes = data[begin : at[k + 1] if k + 1 < len(at) else len(data)]
        length = int.from_bytes(pes[4:6], "big")
        if pes[:3] != b"\x00\x00\x01" or len(pes) < 9 or length and len(pes) != 6 + length:
            out["errors"] += 1
            continue
        if pes[7] & 0x80:
            p = pes[9:14]
            out["pts"].append((p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1)
        else:
            out["pts"].append(None)
        if flags[i] & 0x40:
            out["random_access"].append(len(units))
        units.append(pes[9 + pes[8] :])
        out["unit_offsets"].append(size)
        size += len(units[-1])
    out["payload"] = b"".join(units)
    return out


def demux(stream: bytes) -> dict:
    """All elementary streams, and payload, timestamps and random-access points of the first program's first one."""
    out = {"payload": None, "pts": [], "unit_offsets": [], "random_access": [], "packets": len(stream) // PACKET, "cc_errors": 0, "errors": int(len(stream) % PACKET > 0), "streams": []}
    packets = np.frombuffer(stream, np.uint8, out["packets"] * PACKET).reshape(-1, PACKET)
    good = (packets[:, 0] == SYNC) & (packets[:, 1] < 0x80) & (packets[:, 3] & 0xC0 == 0)
    out["errors"] += int((~good).sum())
    packets = packets[good]
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    programs: dict[int, int] = {}
    for section in _sections(packets[pids == PAT_PID]):
        if section[0] == 0x00:
            for i in range(8, len(section) - 4, 4):
                number = int.from_bytes(section[i : i + 2], "big")
                if number:
                    programs.setdefault(number, int.from_bytes(section[i + 2 : i + 4], "big") & 0x1FFF)
    found: dict[int, tuple[int, int]] = {}
    for number, pid in programs.items():
        for section in _sections(packets[pids == pid]):
            if section[0] != 0x02 or int.from_bytes(section[3:5], "big") != number:
                continue
            i = 12 + (int.from_bytes(section[10:12], "big") & 0x0FFF)
            while i + 5 <= len(section) - 4:
                found.setdefault(int.from_bytes(section[i + 1 : i + 3], "big") & 0x1FFF, (number, section[i]))
                i += 5 + (int.from_bytes(section[i + 3 : i + 5], "big") & 0x0FFF)
            break
    if not found:
        out["errors"] += 1
        return out
    for k, (pid, (number, kind)) in enumerate(found.items()):
        one = _elementary(packets[pids == pid])
        if not k:
            out |= {name: one[name] for name in ("payload", "pts", "unit_offsets", "random_access", "cc_errors")}
            out["errors"] += one["errors"]
        else:
            out["streams"].append({"program": number, "pid": pid, "stream_type": kind} | one)
    return out


def padded(text: str) -> bytes:
    """UTF-8 bytes with zeros appended up to a positive multiple of 64."""
    data = text.encode()
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def to_streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """doc_id, n_bytes (of the text) and media: a transport stream of its padded UTF-8 bytes."""

    def make():
        def run(table: pa.Table) -> pa.Table:
            texts = column(table, "text").to_pylist()
            return pa.table({"doc_id": table["doc_id"], "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "media": pa.array([mux(padded(t), unit) for t in texts], pa.binary())})

        return run

    docs = inputs(docs, id_col, text_col)
    return map_batches(docs, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def parse_streams(media: DataFrame) -> DataFrame:
    """Adds to doc_id, n_bytes and media what the streams hold; a null stream parses like an empty one."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType(media.select("doc_id", "n_bytes", "media").schema.fields + StructType.fromDDL(SCHEMA_PARSED).fields)

    names = to_arrow_schema(StructType.fromDDL(SCHEMA_PARSED))

    def make():
        def run(table: pa.Table) -> pa.Table:
            found = [demux(m or b"") for m in column(table, "media").to_pylist()]
            out = {n: table[n] for n in ("doc_id", "n_bytes", "media")}
            return pa.table(out | {f.name: pa.array([x[f.name] for x in found], f.type) for f in names})

        return run

    return map_batches(media.select("doc_id", "n_bytes", "media"), make, schema.simpleString()[7:-1].replace(":", " "), col="media")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores each document as a transport stream, reads the stored bytes back and describes them."""
    stored = materialize(to_streams(documents(spark, sf_dir)), "media")
    parsed = parse_streams(stored)
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("packets="), "packets"), F.concat(F.lit("units="), F.size("pts")), F.concat(F.lit("rap="), F.concat_ws(",", F.col("random_access").cast("array<string>"))),
        F.concat(F.lit("first_pts="), F.element_at("pts", 1)), F.concat(F.lit("last_pts="), F.element_at("pts", -1)), F.concat(F.lit("pts_crc="), F.crc32(F.concat_ws(",", F.col("pts").cast("array<string>")))),
        F.concat(F.lit("cc_errors="), "cc_errors"), F.concat(F.lit("errors="), "errors"),
    )
    return parsed.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


def reference(text: str | None) -> tuple:
    """What the query must return of the payload, without any stream."""
    payload = padded(text or "")
    return len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])
