"""Token ids in binary blocks by a static range asymmetric numeral system.

One table of frequencies, counted over all ids and scaled to a power of two, codes every block.  A block of 65,536 ids is
coded by itself in 32 interleaved lanes: lane j codes the ids j, j + 32, ... with a state of its own, and the lanes' 32-bit
words form one stream.  Every 16,384 ids the block keeps a checkpoint, the lanes' states and the place in the stream, from which
decoding can start; a task decodes the segments of many blocks side by side.  Each block carries a checksum of its ids and
one of its bytes, and lists the documents that it holds.

Documents are dealt to files by ranges of doc_id and lie there in ascending order.  A file counts its ids from 0; where it begins in the
whole follows from the sizes of the files before it.  As every store that Spark reaches must do, a file is a
Parquet file with one row a block, so that blocks are read in parallel.

Defined results: a null or empty text is the closing id alone; a null doc_id comes first; rows of equal doc_id follow each other
by their text's hash; equal rows are each written; an empty table gives no blocks and an empty result; further columns are
ignored.  A block that is cut short or damaged, or an id that the table lacks, raises ValueError.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import VOCABULARY, split_pattern, vocabulary_path
from .common import BROADCAST_ROWS, blocks, documents, materialise, shared_dir, slices, table
from .packing import worker_ids

MAGIC = b"FRNS"
LANES = 32
BLOCK = 65_536
SEGMENT = 16_384
SCALE_BITS = 20
SCALE = 1 << SCALE_BITS
#: A state lies between this and 2^63; what goes above leaves as a word of 32 bits.
LEAST = 1 << 31
#: Blocks that a task codes side by side.
SIDE_BY_SIDE = 64
LANE_BITS = LANES.bit_length() - 1
#: Numbers of what leaves or enters in one step.
ORDER = np.arange(SIDE_BY_SIDE * (BLOCK // SEGMENT) * LANES)
#: magic, ids, checkpoints, words, documents, checksum of the ids, checksum of the table
_HEAD = struct.Struct("<4s4IIQ")
#: doc_id, whether it is null, the file's ids before it, its ids
_DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("first", "<i8"), ("n", "<i8")])


class Table:
    """Frequencies of ids that sum to ``SCALE``; an id that was counted has at least 1."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids, self.freq = ids.astype(np.uint32), freq.astype(np.uint64)
        self.low = np.cumsum(self.freq) - self.freq
        self.number = np.full(int(ids.max()) + 1 if len(ids) else 1, -1, np.int32)
        self.number[self.ids] = np.arange(len(ids), dtype=np.int32)
        self.slot = np.repeat(np.arange(len(ids), dtype=np.int32), freq)
        self.common = int(self.freq.argmax()) if len(ids) else 0
        self.crc = zlib.crc32(self.ids.astype("<u4").tobytes() + self.freq.astype("<u4").tobytes())

    @classmethod
    def counted(cls, ids: list[int], counts: list[int]) -> Table:
        """Each id gets one place and a share of the rest; what rounding leaves goes to the most frequent ids."""
        if len(ids) > SCALE // 2:
            raise ValueError(f"{len(ids)} different ids; the table has {SCALE} places")
        total, spare = sum(counts), SCALE - len(ids)
        freq = np.array([1 + c * spare // total for c in counts], np.int64)
        if len(ids):
            first = np.lexsort((ids, -np.array(counts, np.float64)))[: SCALE - int(freq.sum())]
            freq[first] += 1
        return cls(np.array(ids, np.int64), freq)

    def numbers(self, ids: np.ndarray) -> np.ndarray:
        """Places of ids in the table."""
        if not len(ids):
            return np.zeros(0, np.int32)
        if int(ids.max()) >= len(self.number) or (found := self.number[ids]).min() < 0:
            raise ValueError("an id that the frequency table lacks")
        return found


class Coded(NamedTuple):
    n: int
    checkpoints: np.ndarray  # a row for each segment: place in the stream, then the lanes' states
    words: np.ndarray


def encode(parts: list[np.ndarray], table: Table) -> list[Coded]:
    """Code blocks side by side; all must have as many ids, the last one of a file stands alone."""
    n, count = len(parts[0]), len(parts)
    steps = -(-n // LANES)
    codes = np.full((count, steps * LANES), table.common, np.int32)
    codes[:, :n] = table.numbers(np.concatenate(parts)).reshape(count, n)
    codes = codes.reshape(count, steps, LANES).transpose(1, 0, 2)
    state = np.full(count * LANES, LEAST, np.uint64)
    stream, place = np.empty(count * steps * LANES, np.uint32), (np.arange(count) + 1) * (steps * LANES)
    each, segments = SEGMENT // LANES, []
    wide, places, room = np.uint64(32), np.uint64(SCALE), np.uint64(63 - SCALE_BITS)
    for start in range((steps - 1) // each * each, -1, -each):
        some = codes[start : start + each].reshape(-1, count * LANES)
        freqs, lows = table.freq[some], table.low[some]
        for step in range(len(some) - 1, -1, -1):
            freq = freqs[step]
            high = state >> room
            full = (high >= freq).nonzero()[0]  # block after block, by lane
            block = full >> LANE_BITS
            number = np.bincount(block, minlength=count)
            place -= number
            leaving = state[full]
            stream[(place - number.cumsum() + number)[block] + ORDER[: len(full)]] = leaving
            state[full] = leaving >> wide
            state += state // freq * (places - freq) + lows[step]
        segments.append((place.copy(), state.reshape(count, LANES).copy()))
    place -= np.arange(count) * (steps * LANES)
    stream = stream.reshape(count, -1)
    segments = [(p - np.arange(count) * (steps * LANES), s) for p, s in segments]
    out = []
    for k in range(count):
        at = np.array([p[k] for p, _ in reversed(segments)], np.uint64) - np.uint64(place[k])
        states = np.array([s[k] for _, s in reversed(segments)], np.uint64).reshape(-1, LANES)
        out.append(Coded(n, np.column_stack([at, states]), stream[k, place[k] :].copy()))
    return out


def decode(coded: list[Coded], table: Table) -> list[np.ndarray]:
    """The ids of blocks, all their segments side by side."""
    base = np.cumsum([0, *[len(c.words) for c in coded]])
    stream = np.concatenate([*[c.words for c in coded], np.zeros(1, np.uint32)]).astype(np.uint64)
    start = np.concatenate([c.checkpoints[:, 0].astype(np.int64) + base[k] for k, c in enumerate(coded)])
    state, last = np.concatenate([c.checkpoints[:, 1:] for c in coded]), len(stream) - 1
    longest = min(SEGMENT, max(c.n for c in coded))
    steps, count = -(-longest // LANES), len(start)
    found, state = np.empty((steps, count * LANES), np.int32), state.ravel()
    mask, bits, wide, least = np.uint64(SCALE - 1), np.uint64(SCALE_BITS), np.uint64(32), np.uint64(LEAST)
    for step in range(steps):
        slot = state & mask
        code = table.slot[slot.view(np.int64)]
        found[step] = code
        state = table.freq[code] * (state >> bits) + slot - table.low[code]
        empty = (state < least).nonzero()[0]
        block = empty >> LANE_BITS
        number = np.bincount(block, minlength=count)
        at = (start - number.cumsum() + number)[block] + ORDER[: len(empty)]
        state[empty] = state[empty] << wide | stream[np.minimum(at, last)]  # a shorter segment runs on behind its end
        start = start + number
    found = found.reshape(steps, count, LANES).transpose(1, 0, 2)
    ids, out, k = table.ids, [], 0
    for c in coded:
        m = len(c.checkpoints)
        out.append(ids[found[k : k + m].reshape(m, -1)[:, :SEGMENT].ravel()[: c.n]])
        k += m
    return out


def frame(coded: Coded, ids: np.ndarray, docs: np.ndarray, table: Table) -> bytes:
    """A block's bytes: head, documents, checkpoints, words, and a checksum of all of it."""
    head = _HEAD.pack(MAGIC, coded.n, len(coded.checkpoints), len(coded.words), len(docs), zlib.crc32(ids.astype("<u4").tobytes()), table.crc)
    body = b"".join((head, docs.tobytes(), coded.checkpoints.astype("<u8").tobytes(), coded.words.astype("<u4").tobytes()))
    return body + struct.pack("<I", zlib.crc32(body))


def unframe(raw: bytes, table: Table) -> tuple[Coded, np.ndarray, int]:
    """A block's code, documents and checksum of its ids."""
    if len(raw) < _HEAD.size + 4 or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError("a block is damaged")
    magic, n, segments, words, docs, crc, table_crc = _HEAD.unpack_from(raw)
    if magic != MAGIC or table_crc != table.crc:
        raise ValueError("a block of another format or table")
    a = _HEAD.size
    b = a + docs * _DOC.itemsize
    c = b + segments * (LANES + 1) * 8
    states = np.frombuffer(raw, "<u8", segments * (LANES + 1), b).reshape(segments, LANES + 1)
    return Coded(n, states, np.frombuffer(raw, "<u4", words, c)), np.frombuffer(raw, _DOC, docs, a), crc


class Files(NamedTuple):
    """Where blocks and the table of frequencies lie."""

    blocks: str
    table: str


def text_ids(docs: DataFrame, closing_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """doc_id, tie, the ids of each whole text with the closing id as little-endian numbers, and the bytes of each of them
    (2 where the vocabulary allows)."""
    pattern = split_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_ids(vocabulary or vocabulary_path(VOCABULARY), pattern)
        end, width = np.array([closing_id], encoder.kind).tobytes(), int(encoder.kind[-1])
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in blocks(texts):
                ids = [encoder.encode(t) + end for t in texts[a:b]]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.full(b - a, width, np.int8)), pa.array(ids, pa.binary())], ["doc_id", "tie", "width", "ids"])

    # equal rows get different ties, so that no task must take them all
    tie = F.struct(F.xxhash64("text").alias("text"), F.monotonically_increasing_id().alias("row"))
    return documents(docs).select("doc_id", "text", tie.alias("tie")).mapInArrow(run, "doc_id long, tie struct<text: bigint, row: bigint>, width byte, ids binary")


def _numbers(width: int, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{width}")


def _by_width(widths: pa.Array, ids: pa.Array) -> list[list[np.ndarray]]:
    """The ids of some rows, those of one width together."""
    found: dict[int, list[np.ndarray]] = {}
    for w, raw in zip(widths.to_pylist(), ids.to_pylist(), strict=True):
        found.setdefault(w, []).append(_numbers(w, raw))
    return list(found.values())


def frequencies(tokens: DataFrame) -> DataFrame:
    """id and how often it occurs; a task sends a row for each id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for part in slices(batches):
            for ids in _by_width(part.column(0), part.column(1)):
                counts = np.bincount(np.concatenate(ids))
                if len(counts) > len(total):
                    counts[: len(total)] += total
                    total = counts
                else:
                    total[: len(counts)] += counts
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])

    return tokens.select("width", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


BLOCKS = "file int, block int, first long, n long, payload binary"


class _Writer:
    """One file's documents in order, coded as soon as some blocks are full."""

    def __init__(self, file: int, table: Table):
        self.file, self.table, self.block, self.first, self.end = file, table, 0, 0, 0
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, self.end, len(ids)))
        self.ids.append(ids)
        self.end += len(ids)

    def rows(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """The blocks that are full, and at the end also the last one."""
        if not last and self.end - self.first < SIDE_BY_SIDE * BLOCK or self.end == self.first:
            return
        ids, docs = np.concatenate(self.ids).astype(np.uint32, copy=False), np.array(self.docs, _DOC)
        cuts = list(range(0, len(ids) - len(ids) % BLOCK, BLOCK))
        done = len(cuts) * BLOCK
        for k in range(0, len(cuts), SIDE_BY_SIDE):
            yield self._batch([ids[a : a + BLOCK] for a in cuts[k : k + SIDE_BY_SIDE]], docs)
        if last and done < len(ids):
            yield self._batch([ids[done:]], docs)
            done = len(ids)
        self.ids = [ids[done:]]
        self.docs = [tuple(d) for d in docs[docs["first"] + docs["n"] > self.first].tolist()]

    def _batch(self, parts: list[np.ndarray], docs: np.ndarray) -> pa.RecordBatch:
        rows = []
        for ids, coded in zip(parts, encode(parts, self.table), strict=True):
            end = self.first + len(ids)
            a, b = np.searchsorted(docs["first"] + docs["n"], self.first, "right"), np.searchsorted(docs["first"], end)
            rows.append((self.file, self.block, self.first, len(ids), frame(coded, ids, docs[a:b], self.table)))
            self.first, self.block = end, self.block + 1
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        names = [f.split()[0] for f in BLOCKS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def write(tokens: DataFrame, files: int | None = None) -> Files:
    """Write documents' ids (:func:`text_ids`) in ascending doc_id order."""
    spark = tokens.sparkSession
    tokens = materialise(tokens, "ids")
    counts = frequencies(tokens).orderBy("id").collect()  # a row per id of the vocabulary
    table = Table.counted([r["id"] for r in counts], [r["n"] for r in counts])
    at = Files(*[f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}" for kind in ("blocks", "frequencies")])
    rows = [(int(i), int(f)) for i, f in zip(table.ids, table.freq, strict=True)]
    spark.createDataFrame(rows, "id long, freq long").coalesce(1).write.parquet(at.table)
    sent = spark.sparkContext.broadcast((table.ids, table.freq.astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(TaskContext.get().partitionId(), Table(*sent.value))
        for part in slices(batches):
            for doc_id, width, ids in zip(*(c.to_pylist() for c in part.columns), strict=True):
                writer.add(doc_id, _numbers(width, ids))
            yield from writer.rows()
        yield from writer.rows(last=True)

    order = [F.col("doc_id").asc_nulls_first(), F.col("tie.text").asc_nulls_first(), F.col("tie.row").asc()]
    files = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens.rdd.getNumPartitions())
    dealt = tokens.repartitionByRange(files, *order).sortWithinPartitions(*order)
    dealt.select("doc_id", "width", "ids").mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(at.blocks)
    return at


PIECES = "file int, doc_id long, first long, doc_tokens long, at long, n long, ids binary"


def read(spark: SparkSession, at: Files) -> DataFrame:
    """The documents' ids as they lie in the blocks: a document that goes over blocks has a row in each.  ``first`` is
    where it begins in its ``file`` and ``at`` where the row does."""
    counts = spark.read.schema("id long, freq long").parquet(at.table).orderBy("id").collect()
    sent = spark.sparkContext.broadcast((np.array([r["id"] for r in counts], np.int64), np.array([r["freq"] for r in counts], np.int64)))
    names = [f.split()[0] for f in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for part in slices(batches, SIDE_BY_SIDE):
            table = table or Table(*sent.value)
            opened = [unframe(raw, table) for raw in part.column(2).to_pylist()]
            rows = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), opened, decode([c for c, _, _ in opened], table), strict=True)
            for file, first, (_, docs, crc), ids in rows:
                raw = memoryview(ids.astype("<u4").tobytes())
                if zlib.crc32(raw) != crc:
                    raise ValueError("ids of a block differ from its checksum")
                start = np.maximum(docs["first"], first)
                end = np.minimum(docs["first"] + docs["n"], first + len(ids))
                cut = [bytes(raw[4 * (a - first) : 4 * (z - first)]) for a, z in zip(start.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(docs), file, np.int32)), pa.array(docs["doc_id"], mask=docs["null"].astype(bool)), pa.array(docs["first"]), pa.array(docs["n"]), pa.array(start), pa.array(end - start), pa.array(cut, pa.binary())],
                    names,
                )

    stored = spark.read.schema(BLOCKS).parquet(at.blocks)
    return stored.select("file", "first", "payload").mapInArrow(run, PIECES)


def file_starts(spark: SparkSession, at: Files) -> DataFrame:
    """Where each file begins in the whole, from the files' sizes."""
    sizes = spark.read.schema(BLOCKS).parquet(at.blocks).groupBy("file").agg(F.max(F.col("first") + F.col("n")).alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return sizes.select(F.col("file").alias("__file"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def joined_crc(pieces: list[tuple[int, int]]) -> int:
    """The checksum of byte strings one after another, from (length, checksum) of each.  As a checksum is affine in what went
    before, a piece is put behind others by running zeros of its length through theirs."""
    total = 0
    for n, crc in pieces:
        shifted, plain = total, 0
        while n:
            zeros = bytes(min(n, 1 << 18))
            shifted, plain, n = zlib.crc32(zeros, shifted), zlib.crc32(zeros, plain), n - len(zeros)
        total = shifted ^ plain ^ crc
    return total


def digests(spark: SparkSession, at: Files) -> DataFrame:
    """Per document doc_id, start, n_tokens and the checksum of its ids, from the files alone."""
    pieces = read(spark, at).select("file", "doc_id", "first", "doc_tokens", "at", "n", F.crc32("ids").alias("crc"))
    pieces = materialise(pieces, "pieces")
    same = ["file", "doc_id", "first"]
    whole = pieces.filter("n = doc_tokens").select(*same, F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [joined_crc([(4 * p["n"], p["crc"]) for p in x]) for x in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.int64())], [*same, "n_tokens", "ids_crc32"])

    parts = pieces.filter("n < doc_tokens").groupBy(*same).agg(
        F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("pieces")
    )  # a document's blocks
    joined = parts.mapInArrow(run, "file int, doc_id long, first long, n_tokens long, ids_crc32 long")
    starts = materialise(file_starts(spark, at), "starts")
    starts = F.broadcast(starts) if starts.count() <= BROADCAST_ROWS else starts
    both = whole.union(joined).join(starts, F.col("file") == F.col("__file"))
    return both.select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def op13_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written to blocks and read back."""
    return digests(spark, write(text_ids(table(spark, sf_dir, "documents"))))
