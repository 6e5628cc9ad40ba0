"""Media columns as MPEG transport streams.

A payload of 8-bit samples is stored as one elementary stream: an access unit of 576 samples each in its own packetised
packet with a presentation time, four transport packets a unit, behind a program association and a program map table.
Reading starts from the bytes alone: packets are found by their sync byte, the tables name the stream's packets, the
continuity counters are checked, the elementary packets are put together again, and every unit's time and random
access point is kept.

Defined results: a null or empty text is stored as one unit of fill bytes; equal texts give equal streams; repeated
rows are stored each by itself; an empty table gives an empty result; further columns are ignored.  A stream whose
counters jump, whose tables fail their checksum or which ends within a packet is read as far as it goes and says so
(``errors``).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents, table

# Fixed values of the public format (ISO/IEC 13818-1).
PACKET = 188
SYNC = 0x47
PAT_PID = 0x0000
PRIVATE_STREAM_1 = 0xBD
PRIVATE_DATA_TYPE = 0x06
CLOCK = 90_000

# Choices of this store.
PMT_PID = 0x0100
DATA_PID = 0x0101
PROGRAM = 1
UNIT = 576
RATE = 24_000
#: Units between random access points.
ACCESS_EVERY = 32


def crc32_mpeg(data: bytes) -> int:
    """The tables' checksum: polynomial 04C11DB7, most significant bit first, no final complement."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table: int, ident: int, body: bytes) -> bytes:
    """A table section: header, body and checksum."""
    length = 5 + len(body) + 4
    head = bytes([table, 0xB0 | length >> 8, length & 255, ident >> 8, ident & 255, 0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return packet + b"\xff" * (PACKET - len(packet))


def tables() -> bytes:
    """The two packets that every stream starts with."""
    pat = _section(0x00, 1, bytes([PROGRAM >> 8, PROGRAM & 255, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))
    pmt = _section(
        0x02,
        PROGRAM,
        bytes([0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0, PRIVATE_DATA_TYPE, 0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0]),
    )
    return _table_packet(PAT_PID, pat) + _table_packet(PMT_PID, pmt)


TABLES = tables()

#: Layout of a unit's four packets: bytes of adaptation field (its length byte included) and of payload.
FIRST, LAST = 8, PACKET - 4 - (UNIT + 14 - (PACKET - 4 - 8) - 2 * (PACKET - 4))


def _stamp(flag: int, t: np.ndarray) -> np.ndarray:
    """33-bit times in the five bytes of a packet header."""
    out = np.empty((len(t), 5), np.uint8)
    out[:, 0] = flag << 4 | (t >> 30 & 7) << 1 | 1
    out[:, 1] = t >> 22 & 255
    out[:, 2] = (t >> 15 & 127) << 1 | 1
    out[:, 3] = t >> 7 & 255
    out[:, 4] = (t & 127) << 1 | 1
    return out


def store(payload: bytes) -> bytes:
    """The transport stream of a payload of whole units."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    n = len(samples)
    k = np.arange(n, dtype=np.int64)
    times = k * UNIT * CLOCK // RATE & (1 << 33) - 1
    p = np.empty((n, 4, PACKET), np.uint8)
    p[:, :, 0] = SYNC
    p[:, :, 1] = DATA_PID >> 8
    p[:, 0, 1] |= 0x40
    p[:, :, 2] = DATA_PID & 255
    counter = ((4 * k)[:, None] + np.arange(4)) & 15
    p[:, :, 3] = 0x10 | counter
    p[:, (0, 3), 3] |= 0x20
    # the first packet: clock reference and random access flag, then the header of the elementary packet
    p[:, 0, 4] = FIRST - 1
    p[:, 0, 5] = 0x10 | np.where(k % ACCESS_EVERY == 0, 0x40, 0)
    p[:, 0, 6] = times >> 25 & 255
    p[:, 0, 7] = times >> 17 & 255
    p[:, 0, 8] = times >> 9 & 255
    p[:, 0, 9] = times >> 1 & 255
    p[:, 0, 10] = (times & 1) << 7 | 0x7E
    p[:, 0, 11] = 0
    length = 3 + 5 + UNIT
    p[:, 0, 12:21] = (0, 0, 1, PRIVATE_STREAM_1, length >> 8, length & 255, 0x84, 0x80, 5)
    p[:, 0, 21:26] = _stamp(2, times)
    a, b = PACKET - 26, PACKET - 4
    p[:, 0, 26:] = samples[:, :a]
    p[:, 1, 4:] = samples[:, a : a + b]
    p[:, 2, 4:] = samples[:, a + b : a + 2 * b]
    # the last packet: stuffing, then what is left
    p[:, 3, 4] = LAST - 1
    p[:, 3, 5] = 0
    p[:, 3, 6 : 4 + LAST] = 0xFF
    p[:, 3, 4 + LAST :] = samples[:, a + 2 * b :]
    return TABLES + p.tobytes()


class Stream(NamedTuple):
    """What is read from a stream: the data, each unit's time (90 kHz), the byte offsets and times of random access
    points, and what was wrong."""

    data: bytes
    times: np.ndarray
    access_at: np.ndarray
    access_times: np.ndarray
    errors: list[str]


def _sections(packets: np.ndarray, pid: np.ndarray, start: np.ndarray, want: int, table: int) -> bytes | None:
    """The body of the first whole section of ``table`` on a packet id."""
    for row in packets[(pid == want) & start]:
        at = 4 + (1 + int(row[4]) if row[3] & 0x20 else 0)
        at += 1 + int(row[at])
        length = (int(row[at + 1]) & 15) << 8 | int(row[at + 2])
        whole = row[at : at + 3 + length].tobytes()
        if whole[:1] == bytes([table]) and len(whole) == 3 + length and crc32_mpeg(whole) == 0:
            return whole[8:-4]
    return None


def read(media: bytes) -> Stream:
    """Parse a transport stream."""
    empty = np.empty(0, np.int64)
    errors = [] if len(media) % PACKET == 0 else ["cut"]
    packets = np.frombuffer(media, np.uint8, len(media) // PACKET * PACKET).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        errors.append("sync")
        packets = packets[packets[:, 0] == SYNC]
    pid = (packets[:, 1].astype(np.int64) & 31) << 8 | packets[:, 2]
    start = packets[:, 1] & 0x40 != 0
    pat = _sections(packets, pid, start, PAT_PID, 0x00)
    program = next((int.from_bytes(pat[k + 2 : k + 4], "big") & 0x1FFF for k in range(0, len(pat), 4) if pat[k : k + 2] != b"\0\0"), None) if pat else None
    pmt = _sections(packets, pid, start, program, 0x02) if program is not None else None
    if pmt is None:
        return Stream(b"", empty, empty, empty, [*errors, "tables"])
    at = 4 + ((pmt[2] & 15) << 8 | pmt[3])
    stream = int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF

    where = np.flatnonzero(pid == stream)
    rows, start = packets[where], start[where]
    has_field, has_data = rows[:, 3] & 0x20 != 0, rows[:, 3] & 0x10 != 0
    counters = rows[:, 3][has_data] & 15
    jumps = int(((counters[1:] - counters[:-1]) & 15 != 1).sum())
    if jumps:
        errors.append(f"continuity:{jumps}")
    begin = np.where(has_field, 5 + rows[:, 4].astype(np.int64), 4)
    begin = np.where(has_data, np.minimum(begin, PACKET), PACKET)
    access = has_field & (rows[:, 4] > 0) & (rows[:, 5] & 0x40 != 0)
    # the header of each elementary packet: 9 bytes and as many more as the last of them says
    heads = np.flatnonzero(start)
    h = begin[heads]
    marker = rows[heads[:, None], np.minimum(h[:, None] + np.arange(14), PACKET - 1)].astype(np.int64)
    if len(heads) and (marker[:, :3] != (0, 0, 1)).any():
        errors.append("packet start")
    stamped = marker[:, 7] & 0x80 != 0
    t = marker[:, 9:14]
    times = (t[:, 0] >> 1 & 7) << 30 | t[:, 1] << 22 | t[:, 2] >> 1 << 15 | t[:, 3] << 7 | t[:, 4] >> 1
    times = np.where(stamped, times, -1)
    begin[heads] = np.minimum(h + 9 + marker[:, 8], PACKET)
    if len(heads):
        begin[: heads[0]] = PACKET  # the tail of a unit whose start is missing
        said = (marker[:, 4] << 8 | marker[:, 5]) - 3 - marker[:, 8]
        got = np.add.reduceat(PACKET - begin, heads)
        if ((said > 0) & (said != got)).any():
            errors.append("length")
    keep = np.arange(PACKET)[None, :] >= begin[:, None]
    point = access[heads]
    return Stream(rows[keep].tobytes(), times, where[heads][point] * PACKET, times[point], errors)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length of the text in UTF-8, and its bytes with fill bytes up to a positive multiple of a unit."""
    raw = (text or "").encode("utf-8")
    whole = max(1, -(-len(raw) // UNIT)) * UNIT
    return len(raw), raw + b"\xff" * (whole - len(raw))


MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
READ_SCHEMA = "data binary, times array<long>, access_at array<long>, access_times array<long>, errors array<string>"


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the transport stream of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in blocks(texts):
                pairs = [payload_of(t) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([n for n, _ in pairs], pa.int64()),
                        pa.array([store(p) for _, p in pairs], pa.binary()),
                    ],
                    ["doc_id", "n_bytes", "media"],
                )

    return documents(docs).mapInArrow(run, MEDIA_SCHEMA)


def read_media(stored: DataFrame) -> DataFrame:
    """The columns of ``stored`` and what is read from its ``media``."""
    schema = ", ".join(f"{c} {t}" for c, t in stored.dtypes) + ", " + READ_SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in batches:
            at = batch.schema.get_field_index("media")
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = [read(m) for m in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array([s.data for s in found], pa.binary()),
                        *[pa.array([getattr(s, c).tolist() for s in found], longs) for c in ("times", "access_at", "access_times")],
                        pa.array([s.errors for s in found], pa.list_(pa.string())),
                    ],
                    [*part.schema.names, "data", "times", "access_at", "access_times", "errors"],
                )

    return stored.mapInArrow(run, schema)


def digests(read_back: DataFrame) -> DataFrame:
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("units="), F.size("times").cast("string")),
        F.concat(F.lit("times="), F.array_min("times").cast("string"), F.lit("-"), F.array_max("times").cast("string")),
        F.concat(F.lit("access="), F.size("access_at").cast("string")),
        F.concat(F.lit("last_access="), F.element_at("access_at", -1).cast("string")),
        F.concat(F.lit("errors="), F.array_join("errors", ",")),
    )
    size = F.octet_length("data")
    return read_back.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("data", 256).alias("payload_sha256"),
        F.crc32(F.substring("data", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as a stream, read back from its bytes."""
    return digests(read_media(store_texts(table(spark, sf_dir, "documents"))))


def tail_crc(payload: bytes) -> int:
    """For tests."""
    return zlib.crc32(payload[-32:])


def sha(data: bytes) -> str:
    """For tests."""
    return hashlib.sha256(data).hexdigest()
