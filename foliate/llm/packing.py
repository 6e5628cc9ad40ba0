"""Mixture-controlled packing by deficit round-robin.

Every source is a queue of token streams.  Round after round each queue earns its quantum, the share of a window that
the mixture gives it, and sends the tokens that it has earned; the fraction that is left stays as its deficit.  A round
is as long as a window, so every window holds each queue's share within two tokens.  Only a queue that earns less than ``grain`` tokens a
round saves them up and sends ``grain`` at a time, so that the documents of rare sources are not cut to single tokens.  The queues' output,
one after another, is cut every ``length`` tokens, and only the very last window is short.

How much a queue has sent after r rounds is a closed form of r, so a token's place in the output follows from its
place in its own queue.  Deficits therefore carry over windows and partitions without any task seeing more than its
own documents: each partition needs only how many tokens of each queue lie before it.  With many queues the closed form's
sum over all of them becomes a table: what each queue sends is sorted by round and queue, and running sums give its place.

Defined results: a null or empty text is the closing id alone; a null source is a queue of its own; repeated rows are
packed each by itself; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator, Mapping
from functools import lru_cache
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import LOW, MEMO_WORDS, SPLIT, VOCABULARY, Vocabulary, split_pattern, vocabulary_path
from .common import BROADCAST_ROWS, blocks, materialise, table

#: With more queues than this, places come from a sorted table; bounds the table of quanta that every task holds.
MAX_QUEUES = 64
#: Fractions of a token in which quanta are counted; finer with more than 64 queues (:func:`units`).
UNITS = 1024


class Mixture(NamedTuple):
    """``weights`` by source; None: each source's share of all tokens.  Sources it lacks get the mean of the others.
    Windows of ``length`` tokens; queues that earn less than ``grain`` tokens a window send ``grain`` at a time."""

    weights: Mapping[str, float] | None = None
    length: int = 2048
    grain: int = 16
    closing_id: int = 1


def units(queues: int) -> int:
    """So fine that the mean quantum does not shrink with the number of queues, and that 64 bits hold 2^40 tokens."""
    return UNITS << min(10, max(0, (queues - 1) // 64).bit_length())


class Rounds(NamedTuple):
    """What decides when a queue's tokens are sent: for single queues, or for one of each document."""

    quantum: np.ndarray  # in units
    last: np.ndarray  # the round after which the queue is empty
    grain: np.ndarray  # 1, or the grain where the quantum is smaller
    units: np.ndarray | int

    @classmethod
    def of(cls, quantum: np.ndarray, last: np.ndarray, units: np.ndarray | int, grain: int) -> Rounds:
        return cls(quantum, last, np.where(quantum < grain * units, grain, 1), units)

    def at(self, k: np.ndarray) -> Rounds:
        return Rounds(self.quantum[k], self.last[k], self.grain[k], self.units[k] if isinstance(self.units, np.ndarray) else self.units)

    def earned(self, r: np.ndarray) -> np.ndarray:
        """Whole grains earned after ``r`` rounds, in tokens."""
        return r * self.quantum // self.units // self.grain * self.grain

    def turn(self, token: np.ndarray) -> np.ndarray:
        """The round that sends the queue's token of that number."""
        due = (token // self.grain + 1) * self.grain
        return np.minimum(-(-due * self.units // self.quantum), self.last)


def _parts(start: np.ndarray, n: np.ndarray, rounds: Rounds) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents [start, start + n) of their queues cut where a round's tokens end: which document, first token and length
    of each part, and the round that sends it."""
    fine, end = rounds.grain == 1, start + n
    head = np.where(fine, rounds.turn(start), start // rounds.grain)
    tail = np.where(fine, rounds.turn(end - 1), (end - 1) // rounds.grain)
    parts = tail - head + 1
    which = np.repeat(np.arange(len(n)), parts)
    k = head[which] + np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    own = rounds.at(which)
    low = np.where(fine[which], own.earned(k - 1), k * own.grain)
    high = np.where(fine[which], np.where(k >= own.last, end[which], own.earned(k)), (k + 1) * own.grain)
    first = np.maximum(low, start[which])
    turn = np.where(fine[which], k, own.turn(first))
    return which, first, np.minimum(high, end[which]) - first, turn


class Queues:
    """The closed form: totals and quanta of all queues in ring order."""

    def __init__(self, totals: np.ndarray, shares: np.ndarray, mixture: Mixture):
        self.total, self.length = totals.astype(np.int64), mixture.length
        u = units(len(totals))
        quantum = np.maximum(1, np.round(shares / shares.sum() * mixture.length * u)).astype(np.int64)
        self.rounds = Rounds.of(quantum, -(-self.total * u // quantum), u, mixture.grain)

    def sent(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens that each queue (column) has sent after each of ``rounds`` (row)."""
        r = rounds[:, None]
        whole = np.minimum(self.rounds.earned(np.minimum(r, self.rounds.last)), self.total)
        return np.where(r >= self.rounds.last, self.total, whole)

    def place(self, queue: np.ndarray, first: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """Place in the output of each part of a queue, from its first token and the round that sends it."""
        after, before = self.sent(turn), self.sent(turn - 1)
        ring = np.arange(len(self.total))[None, :] < queue[:, None]
        mine = before[np.arange(len(queue)), queue]
        return np.where(ring, after, before).sum(1) + first - mine


def _cuts(start: np.ndarray, n: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges [start, start + n) cut at every multiple of ``step``: which range, first and length of each part."""
    parts = (start + n - 1) // step - start // step + 1
    which = np.repeat(np.arange(len(n)), parts)
    k = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.maximum((start[which] // step + k) * step, start[which])
    end = np.minimum((start[which] // step + k + 1) * step, start[which] + n[which])
    return which, first, end - first


def pieces(queue: np.ndarray, start: np.ndarray, n: np.ndarray, queues: Queues) -> tuple[np.ndarray, ...]:
    """Document, start within it, length, sequence and offset of every piece of documents at ``start`` of a queue."""
    doc, first, size, turn = _parts(start, n, queues.rounds.at(queue))
    at = queues.place(queue[doc], first, turn)
    # parts of a document that follow each other in the output are one piece
    joined = np.zeros(len(doc), bool)
    joined[1:] = (doc[1:] == doc[:-1]) & (at[1:] == at[:-1] + size[:-1])
    head = np.flatnonzero(~joined)
    size = np.add.reduceat(size, head) if len(head) else size
    doc, first, at = doc[head], first[head], at[head]
    part, place, length = _cuts(at, size, queues.length)
    inside = first[part] - start[doc[part]] + place - at[part]
    return doc[part], inside, length, place // queues.length, place % queues.length


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: A character whose class Unicode versions may see differently, and a word or a gap of so many characters.
_HIGH = re.compile(rf"[\u{LOW:04x}-\U0010ffff]")
_LONG = re.compile(r"\S{1000}|\s{1000}")


def _high(text: str) -> bool:
    try:
        text.encode("latin-1")  # no such character, and quickly seen
    except UnicodeEncodeError:
        return bool(_HIGH.search(text))
    return False


def _long(text: str) -> bool:
    """Whether :data:`_LONG` is found.  A run of 1,000 fills one of the pieces of 500 whole; most texts have none such."""
    suspect = any(len(text[k : k + 500].split(None, 1)) < 2 for k in range(0, len(text) - 499, 500))
    return suspect and bool(_LONG.search(text))


class TextIds:
    """Ids as the tokenizers library gives them.

    Texts of low code points are encoded by tiktoken over the same file's ranks, which is exact there and many times
    faster.  Texts with other characters go through the library word by word, each distinct word once; texts with its
    special strings, or with words so long that tiktoken's merging turns slow, through the library whole.
    """

    def __init__(self, path: str, pattern: str):
        self.library, self.find = _tokenizer(path), regex.compile(pattern).findall
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}
        self.fast = self._ranked(Vocabulary(path))

    def _ranked(self, vocabulary: Vocabulary):
        """tiktoken's encoding, where the ids are in the order of the merges, as it takes them to be."""
        import tiktoken

        if any(a >= b for a, b in pairwise(vocabulary.results)):
            return None
        ranks = {b: i for b, i in vocabulary.ids.items() if i not in vocabulary.special.values()}
        pattern = SPLIT.replace("{L}", r"\p{L}").replace("{N}", r"\p{N}")
        return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 16- or 32-bit numbers (:attr:`kind`)."""
        if any(s in text for s in self.special):  # the library splits at these first
            return self._whole(text)
        if _long(text):
            return self._whole(text)
        if self.fast and not _high(text):
            found = array("H" if self.kind == "<u2" else "I", self.fast(text))
            return found.tobytes() if sys.byteorder == "little" else np.array(found, self.kind).tobytes()
        return self._by_word(text)

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _by_word(self, text: str) -> bytes:
        words, memo = self.find(text), self.memo
        try:
            return b"".join(map(memo.__getitem__, words))
        except KeyError:
            if len(memo) > MEMO_WORDS:
                memo.clear()
            new = [w for w in dict.fromkeys(words) if w not in memo]
            for w, e in zip(new, self.library.encode_batch(new, add_special_tokens=False), strict=True):
                memo[w] = np.array(e.ids, self.kind).tobytes()
            return b"".join(map(memo.__getitem__, words))

    @property
    def kind(self) -> str:
        return "<u2" if self.library.get_vocab_size() <= 65536 else "<u4"


_TEXT_IDS: dict[str, TextIds] = {}


def worker_ids(path: str, pattern: str) -> TextIds:
    if path not in _TEXT_IDS:
        _TEXT_IDS[path] = TextIds(path, pattern)
    return _TEXT_IDS[path]


def _tokens(docs: DataFrame, path: str, closing_id: int) -> DataFrame:
    """The ids of each document, and how many tokens of its queue its partition holds before it."""
    pattern = split_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = worker_ids(path, pattern)
        end = np.array([closing_id], ids.kind).tobytes()
        sent: dict[str | None, int] = {}
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in blocks(texts):
                part = batch.slice(a, b - a)
                raw = [ids.encode(t) + end for t in texts[a:b]]
                n = [len(x) // len(end) for x in raw]
                before = []
                for queue, k in zip(part.column(2).to_pylist(), n, strict=True):
                    before.append(sent.get(queue, 0))
                    sent[queue] = before[-1] + k
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(raw, pa.binary())],
                    ["doc_id", "queue", "part", "before", "n", "ids"],
                )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        "queue",
        F.spark_partition_id().alias("part"),
    )
    return rows.mapInArrow(run, "doc_id long, queue string, part int, before long, n long, ids binary")


def with_queue(docs: DataFrame) -> DataFrame:
    """The source as queue."""
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.withColumn("queue", source)


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, mixture: Mixture = Mixture(), vocabulary: str | None = None) -> DataFrame:
    """A row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    path = vocabulary or vocabulary_path(VOCABULARY)
    tokens = materialise(_tokens(with_queue(docs), path, mixture.closing_id), "tokens")
    sums = materialise(tokens.groupBy("queue", "part").agg(F.sum("n").alias("n")), "sums")
    totals = sums.groupBy("queue").agg(F.sum("n").alias("n"))
    few = totals.limit(MAX_QUEUES + 1).collect()
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(
        F.col("queue").alias("__q"), F.col("part").alias("__p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    many = len(few) > MAX_QUEUES
    if many:
        base = base.join(_quanta(totals, mixture), F.col("__q").eqNullSafe(F.col("__of")))
    if sums.count() <= BROADCAST_ROWS:  # a row per queue and input partition; else both sides shuffle
        base = F.broadcast(base)
    wide = tokens.join(base, F.col("queue").eqNullSafe(F.col("__q")) & (F.col("part") == F.col("__p")))
    start = (F.col("base") + F.col("before")).alias("start")
    if many:
        grains = _grains(wide.select("doc_id", "queue", start, "n", "ids", "quantum", "last", "units"), mixture)
        return _by_table(materialise(grains, "grains"), mixture)
    return _by_closed_form(wide.select("doc_id", "queue", start, "n", "ids"), few, mixture)


def _by_closed_form(wide: DataFrame, totals: list, mixture: Mixture) -> DataFrame:
    totals = sorted(totals, key=lambda r: (r["queue"] is not None, r["queue"]))
    names, n = [r["queue"] for r in totals], np.array([r["n"] for r in totals], np.int64)
    given = mixture.weights or {}
    mean = sum(given.values()) / len(given) if given else 1.0
    shares = np.array([given.get(q, mean) for q in names], float) if given else n.astype(float)
    queues = Queues(n, shares, mixture)
    number = {q: k for k, q in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, queue, start, n, raw = (c for c in batch.columns)
            queue = np.array([number[q] for q in queue.to_pylist()], np.int64)
            start, n, raw = start.to_numpy(), n.to_numpy(), raw.to_pylist()
            step = 512
            for a in range(0, len(n), step):
                some = slice(a, a + step)
                doc, inside, length, sequence, offset = pieces(queue[some], start[some], n[some], queues)
                wide_ids = [np.frombuffer(x, "<u2" if len(x) == 2 * k else "<u4").astype("<u4") for x, k in zip(raw[some], n[some].tolist(), strict=True)]
                cut = [wide_ids[d][i : i + k].tobytes() for d, i, k in zip(doc.tolist(), inside.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [doc_id.take(pa.array(doc + a)), pa.array(inside), pa.array(length), pa.array(cut, pa.binary()), pa.array(n[some][doc]), pa.array(sequence), pa.array(offset)],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    return wide.mapInArrow(run, PIECES)


def _quanta(totals: DataFrame, mixture: Mixture) -> DataFrame:
    """A row per queue: its quantum and last round, as :class:`Queues` has them."""
    spark, share = totals.sparkSession, F.col("n").cast("double")
    if mixture.weights:
        given = [(q, float(w)) for q, w in mixture.weights.items()]
        weights = F.broadcast(spark.createDataFrame(given, "__w string, weight double"))
        totals = totals.join(weights, F.col("queue").eqNullSafe(F.col("__w")), "left")
        share = F.coalesce("weight", F.lit(sum(w for _, w in given) / len(given)))
    totals = materialise(totals.select("queue", "n", share.alias("share")), "totals")
    queues, whole = totals.agg(F.count(F.lit(1)), F.sum("share")).first()
    u = units(queues)
    quantum = F.greatest(F.lit(1), F.rint(F.col("share") / whole * mixture.length * u).cast("long"))
    totals = totals.select(F.col("queue").alias("__of"), "n", quantum.alias("quantum"), F.lit(u).cast("long").alias("units"))
    return totals.withColumn("last", F.expr("(n * units + quantum - 1) div quantum")).drop("n")


def _grains(wide: DataFrame, mixture: Mixture) -> DataFrame:
    """A row for each part of a document that one round sends."""
    grain = mixture.grain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                some = batch.slice(a, 512)
                doc_id, queue, raw = some.column(0), some.column(1), some.column(4).to_pylist()
                start, n, quantum, last, unit = (some.column(k).to_numpy() for k in (2, 3, 5, 6, 7))
                doc, first, size, turn = _parts(start, n, Rounds.of(quantum, last, unit, grain))
                inside, each = first - start[doc], pa.array(doc)
                width = [len(x) // k for x, k in zip(raw, n.tolist(), strict=True)]
                cut = [raw[d][i * width[d] : (i + k) * width[d]] for d, i, k in zip(doc.tolist(), inside.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(turn), queue.take(each), pa.array(first), doc_id.take(each), pa.array(inside), pa.array(size), pa.array(cut, pa.binary()), pa.array(n[doc])],
                    ["turn", "queue", "first", "doc_id", "start", "length", "ids", "doc_tokens"],
                )

    return wide.mapInArrow(
        run, "turn long, queue string, first long, doc_id long, start long, length long, ids binary, doc_tokens long"
    )


def _by_table(grains: DataFrame, mixture: Mixture) -> DataFrame:
    """Places by running sums over the parts in the order they are sent, then each window put together."""
    spark, length = grains.sparkSession, mixture.length
    dealt = max(int(spark.conf.get("spark.sql.shuffle.partitions")), grains.rdd.getNumPartitions())
    order = [F.col("turn"), F.col("queue").asc_nulls_first(), F.col("first")]
    slim = grains.select("turn", "queue", "first", "length").repartitionByRange(dealt, *order).sortWithinPartitions(*order)

    def run_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = 0
        for batch in batches:
            size = batch.column(2).to_numpy()
            at = sent + np.cumsum(size) - size
            sent += int(size.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(at), batch.column(2)],
                ["__q", "__first", "part", "at", "size"],
            )

    slim = slim.select("queue", "first", "length", F.spark_partition_id().alias("part"))
    placed = materialise(slim.mapInArrow(run_sums, "__q string, __first long, part int, at long, size long"), "placed")
    ends = placed.groupBy("part").agg(F.max(F.col("at") + F.col("size")).alias("end")).collect()  # a row per partition
    base, sent = [], 0
    for r in sorted(ends, key=lambda r: r["part"]):
        base.append((r["part"], sent))
        sent += r["end"]
    base = F.broadcast(spark.createDataFrame(base, "__part int, base long"))
    placed = placed.join(base, F.col("part") == F.col("__part"))
    placed = placed.select("__q", "__first", (F.col("base") + F.col("at")).alias("place"))
    same = F.col("queue").eqNullSafe(F.col("__q")) & (F.col("first") == F.col("__first"))
    rows = grains.join(placed, same).select("queue", "first", "doc_id", "start", "length", "ids", "doc_tokens", "place")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts that end behind a window's end are cut there."""
        for batch in batches:
            start, n, place, doc_tokens = (batch.column(k).to_numpy() for k in (3, 4, 7, 6))
            first, raw = batch.column(1).to_numpy(), batch.column(5).to_pylist()
            part, at, size = _cuts(place, n, length)
            skip, each = at - place[part], pa.array(part)
            wide = [np.frombuffer(x, "<u2" if len(x) == 2 * k else "<u4").astype("<u4") for x, k in zip(raw, n.tolist(), strict=True)]
            ids = [wide[p][i : i + k].tobytes() for p, i, k in zip(part.tolist(), skip.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(each), pa.array((first - start)[part]), batch.column(2).take(each), pa.array(start[part] + skip), pa.array(size), pa.array(ids, pa.binary()), pa.array(doc_tokens[part]), pa.array(at // length), pa.array(at % length)],
                ["queue", "head", "doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts of one document that follow each other in a window are one piece."""
        held, key, done = None, None, []
        for batch in batches:
            for queue, head, doc_id, start, n, ids, doc_tokens, sequence, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key == (queue, head, sequence, offset, start):
                    held[2] += n
                    held[3].append(ids)
                else:
                    if held:
                        done.append(held)
                    held = [doc_id, start, n, [ids], doc_tokens, sequence, offset]
                key = (queue, head, sequence, offset + n, start + n)
            if len(done) >= 2000:
                yield _pieces(done)
                done = []
        if held:
            yield _pieces([*done, held])

    rows = rows.mapInArrow(cut, f"queue string, head long, {PIECES}")
    return rows.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset").mapInArrow(join, PIECES)


def _pieces(rows: list[list]) -> pa.RecordBatch:
    cols = [[b"".join(r[3]) for r in rows] if k == 3 else [r[k] for r in rows] for k in range(7)]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 3 else pa.int64()) for k, c in enumerate(cols)], names)


def digests(packed: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents")))


def crc(ids: list[int]) -> int:
    """What :func:`digests` returns for a piece's ids; for tests."""
    return zlib.crc32(np.array(ids, "<u4").tobytes())
