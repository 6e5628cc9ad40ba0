"""Byte-level BPE by a minimal acyclic transducer.

Frequent words (pieces of the pre-tokeniser's pattern, counted over the whole corpus) are compiled on the driver into
one automaton that shares suffixes; a word's path adds up to its number, and the number leads to its ids.  The
automaton is a flat file in the shared folder which Spark hands to each executor and which the workers map into
memory.  A word that is not in it is merged by rank, exactly as the vocabulary's own rule says.

Defined results: a null text is an empty one (no ids); repeated rows are encoded alike; an empty table gives an empty
result and an empty automaton; text of any length is encoded whole; the special string of the vocabulary inside a text
becomes its id, as the library's default does.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import struct
import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents, materialise, shared_dir, table

#: Words in the automaton: the most frequent ones of the corpus.  Bounds the file (a few MB) and what the driver takes.
LEXICON_WORDS = 100_000
#: Distinct words that a worker remembers or counts before it starts anew.
MEMO_WORDS = 400_000
#: The vocabulary of the queries, by the name that public_tokenizers.path() takes.
VOCABULARY = "byte_bpe_50k.json"

#: Separator pattern of byte-level BPE vocabularies (fixed value of the public format).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def split_pattern() -> str:
    """The split pattern with letters and numbers as the tokenizers library knows them.

    The regex module may know newer characters; the library is asked about each one that this Python's own, older
    tables lack.  Without the library those tables decide.
    """
    try:
        from tokenizers import pre_tokenizers

        ask = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        joins = {"L": lambda c: len(ask("a" + c)) == 1, "N": lambda c: len(ask("1" + c)) == 1}
    except ImportError:
        joins = dict.fromkeys("LN", lambda c: False)
    sets = {}
    for kind in "LN":
        is_kind = regex.compile(rf"\p{{{kind}}}").match
        odd = [
            cp
            for cp in range(0x370, 0x110000)
            if not 0xD800 <= cp < 0xE000
            and unicodedata.category(chr(cp)) == "Cn"
            and is_kind(chr(cp))
            and not joins[kind](chr(cp))
        ]
        ranges = "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in _runs(odd))
        sets[kind] = f"[\\p{{{kind}}}--[{ranges}]]" if odd else f"\\p{{{kind}}}"
    return "(?V1)" + SPLIT.replace("{L}", sets["L"]).replace("{N}", sets["N"])


#: Below this code point a text is split by the standard library, with the classes spelled out.
LOW = 0x370


@lru_cache(maxsize=1)
def low_pattern() -> str:
    """The split pattern over the code points below LOW, where all Unicode versions agree."""

    def spelled(wanted: Callable[[str], bool]) -> str:
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in _runs([c for c in range(LOW) if wanted(chr(c))]))

    space = spelled(lambda c: regex.match(r"\s", c) is not None)
    kinds = {k: spelled(lambda c, k=k: regex.match(rf"\p{{{k}}}", c) is not None) for k in "LN"}
    p = SPLIT.replace(r"[^\s{L}{N}]", f"[^{space}{kinds['L']}{kinds['N']}]")
    p = p.replace("{L}", f"[{kinds['L']}]").replace("{N}", f"[{kinds['N']}]")
    return p.replace(r"\s+(?!\S)", f"[{space}]+(?![^{space}])").replace(r"\s+", f"[{space}]+")


def splitter(pattern: str, low: str) -> Callable[[str], list[str]]:
    """Pieces of a text: by ``low`` where it holds low code points only, else by ``pattern``."""
    some_high = re.compile(f"[\\u{LOW:04x}-\\U0010ffff]").search
    fast, full = re.compile(low).findall, regex.compile(pattern).findall
    return lambda text: full(text) if some_high(text) else fast(text)


def _runs(points: list[int]) -> list[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    out: list[tuple[int, int]] = []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1] = (out[-1][0], p)
        else:
            out.append((p, p))
    return out


class Vocabulary:
    """Ranks and ids of a byte-level BPE file, over raw bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in byte_letters().items()}
        raw = lambda s: bytes(to_byte[c] for c in s)
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in spec["model"]["merges"]]
        self.ranks = {(self.ids[raw(a)], self.ids[raw(b)]): (k, self.ids[raw(a) + raw(b)]) for k, (a, b) in enumerate(pairs)}
        self.results = [new for _, new in sorted(self.ranks.values())]
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.by_id = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of lowest rank is merged first, the leftmost on ties (n log n in its length)."""
        ids = [self.byte_ids[b] for b in word]
        ranks, n = self.ranks, len(ids)
        if n < 2:
            return ids
        if n < 64:
            far = len(ranks)
            left = [ranks.get(p, (far,))[0] for p in zip(ids, ids[1:], strict=False)]
            while left and (least := min(left)) < far:
                k = left.index(least)
                new = self.results[least]
                ids[k : k + 2] = [new]
                del left[k]
                if k < len(left):
                    left[k] = ranks.get((new, ids[k + 1]), (far,))[0]
                if k:
                    left[k - 1] = ranks.get((ids[k - 1], new), (far,))[0]
            return ids
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], k, ids[k], ids[k + 1], r[1]) for k in range(n - 1) if (r := ranks.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            j = following[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = new, -1
            following[k] = j = following[j]
            if j < n:
                before[j] = k
                if r := ranks.get((new, ids[j])):
                    heapq.heappush(heap, (r[0], k, new, ids[j], r[1]))
            if (i := before[k]) >= 0 and (r := ranks.get((ids[i], new))):
                heapq.heappush(heap, (r[0], i, ids[i], new, r[1]))
        return [x for x in ids if x >= 0]


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte (rule of the public format)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


# --- the automaton -----------------------------------------------------------------------------------------------

MAGIC = b"MAFT0001"


def compile_lexicon(words: Iterable[bytes], ids_of: Callable[[bytes], list[int]]) -> bytes:
    """The minimal acyclic automaton of ``words`` as one flat file.

    Built from sorted words, suffix by suffix: a state that can no longer grow is replaced by an equal one.  Each edge
    carries how many words sort before those behind it, so a path's sum is its word's number (an additive output).
    """
    words = sorted(set(words))
    registry: dict[tuple, int] = {}
    edges: list[tuple[tuple[int, int], ...]] = []  # of each finished state: (byte, state), ascending
    final: list[bool] = []

    def finish(kids: list[tuple[int, int]], ends: bool) -> int:
        key = (ends, tuple(kids))
        found = registry.get(key)
        if found is None:
            found = registry[key] = len(edges)
            edges.append(key[1])
            final.append(ends)
        return found

    # the open path: per depth its finished children, whether a word ends there, and the byte that leads on
    path: list[tuple[list[tuple[int, int]], bool]] = [([], False)]
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            kids, ends = path.pop()
            path[-1][0].append((last[len(path) - 1], finish(kids, ends)))

    for w in words:
        same = 0
        while same < min(len(w), len(last)) and w[same] == last[same]:
            same += 1
        close(same)
        path += [([], False) for _ in range(len(w) - same)]
        path[-1] = (path[-1][0], True)
        last = w
    close(0)
    start = finish(*path[0])

    behind: list[int] = []  # words from each state on; children are finished before their parents
    for kids, ends in zip(edges, final, strict=True):
        behind.append(ends + sum(behind[s] for _, s in kids))
    keys, targets, adds = [], [], []
    for state, kids in enumerate(edges):
        add = int(final[state])
        for byte, to in kids:
            keys.append(state * 256 + byte)
            targets.append(to)
            adds.append(add)
            add += behind[to]
    lists = [ids_of(w) for w in words]
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=starts[1:])
    arrays = [
        np.array(keys, np.int64), np.array(targets, np.int32), np.array(adds, np.int32), np.array(final, np.uint8),
        starts, np.array([i for x in lists for i in x], np.uint32),
    ]
    head = struct.pack("<8sqq6q", MAGIC, start, len(words), *[a.nbytes for a in arrays])
    return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)


class Lexicon:
    """A compiled automaton over a buffer (a memory map in the workers)."""

    def __init__(self, buffer):
        magic, self.start, self.size, *nbytes = struct.unpack_from("<8sqq6q", buffer)
        if magic != MAGIC:
            raise ValueError("not a lexicon file")
        at, parts = struct.calcsize("<8sqq6q"), []
        for n, kind in zip(nbytes, (np.int64, np.int32, np.int32, np.uint8, np.int64, np.uint32), strict=True):
            parts.append(np.frombuffer(buffer, kind, n // np.dtype(kind).itemsize, at))
            at += n + (-n % 8)
        self.keys, self.targets, self.adds, self.final, self.starts, self.ids = parts

    @classmethod
    def from_file(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, or -1: all words walk the automaton together, a byte at a time."""
        lengths = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lengths)
        flat = np.frombuffer(b"".join(words), np.uint8)
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys):
            return out
        live = np.flatnonzero(lengths > 0)
        state, number, depth = np.full(len(live), self.start, np.int64), np.zeros(len(live), np.int64), 0
        while len(live):
            key = state * 256 + flat[ends[live] - lengths[live] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, at = live[ok], at[ok]
            state, number, depth = self.targets[at].astype(np.int64), number[ok] + self.adds[at], depth + 1
            done = lengths[live] == depth
            hit = done & (self.final[state] == 1)
            out[live[hit]] = number[hit]
            live, state, number = live[~done], state[~done], number[~done]
        return out

    def word_ids(self, number: int) -> np.ndarray:
        return self.ids[self.starts[number] : self.starts[number + 1]]


class Encoder:
    """Encodes texts: pattern, automaton for known words, exact merges for the others."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon, pattern: str, low: str):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.find = splitter(pattern, low)
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.forget()

    def forget(self) -> None:
        """The memory of words: word to its number, and the numbers' ids in one array."""
        self.memo: dict[str, int] = {s: k for k, s in enumerate(self.vocabulary.special)}
        self.lengths = np.ones(len(self.memo), np.int64)
        self.ids = np.array(list(self.vocabulary.special.values()), np.uint32)
        self.starts = np.arange(len(self.memo))

    def pieces(self, text: str) -> list[str]:
        if self.special is None or not any(s in text for s in self.vocabulary.special):
            return self.find(text)
        out: list[str] = []
        for part in self.special.split(text):
            out += [part] if part in self.vocabulary.special else self.find(part)
        return out

    def learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8") for w in words]
        numbers = self.lexicon.numbers(raw)
        known = numbers >= 0
        lengths = np.empty(len(words), np.int64)
        lengths[known] = np.diff(self.lexicon.starts)[numbers[known]] if known.any() else 0
        merged: list[int] = []
        for k in np.flatnonzero(~known).tolist():
            ids = self.vocabulary.merge(raw[k])
            lengths[k] = len(ids)
            merged += ids
        ids = np.empty(int(lengths.sum()), np.uint32)
        found = np.repeat(known, lengths)
        ids[~found] = merged
        ids[found] = _gather(self.lexicon.starts[numbers[known]], lengths[known], self.lexicon.ids)
        self.memo.update(zip(words, range(len(self.lengths), len(self.lengths) + len(words)), strict=True))
        self.lengths, self.ids = np.concatenate([self.lengths, lengths]), np.concatenate([self.ids, ids])
        self.starts = np.cumsum(self.lengths) - self.lengths

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and how many each has."""
        if len(self.memo) > MEMO_WORDS:
            self.forget()
        split = [self.pieces(t) for t in texts]
        words = list(chain.from_iterable(split))
        if new := set(words).difference(self.memo):
            self.learn(sorted(new))
        number = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        n = self.lengths[number]
        total = np.concatenate([[0], np.cumsum(n)])
        per_text = np.diff(total[np.cumsum([0, *map(len, split)])])
        return _gather(self.starts[number], n, self.ids), per_text


def _gather(starts: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The ranges of ``values`` one after another."""
    ends = np.cumsum(lengths)
    return values[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)]


# --- on Spark ----------------------------------------------------------------------------------------------------


def word_counts(docs: DataFrame, pattern: str, memo: int = MEMO_WORDS) -> DataFrame:
    """(word, n) over all whole texts; each task adds up what it has read before the shuffle."""
    low = low_pattern()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = splitter(pattern, low), Counter()

        def flush():
            return pa.RecordBatch.from_pydict(
                {"word": pa.array(list(seen.keys()), pa.string()), "n": pa.array(list(seen.values()), pa.int64())}
            )

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(find(text or ""))
                if len(seen) > memo:
                    yield flush()
                    seen.clear()
        if seen:
            yield flush()

    counted = docs.select("text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> list[str]:
    """At most ``most`` words, all of a count or none of it, from the highest count down.

    Where to stop is read from a histogram of the counts (a few hundred rows), so no task sends more than it must.
    """
    step = F.floor(F.log2("n") * 16).cast("int")
    rows = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect()
    least, held = None, 0
    for r in rows:
        if held + r["words"] > most:
            break
        least, held = r["step"], held + r["words"]
    return [] if least is None else [r[0] for r in counts.filter(step >= least).select("word").collect()]


def store_file(spark: SparkSession, data: bytes, name: str) -> str:
    """Write a small file to the shared folder and have Spark hand it to every executor; its name there."""
    name = f"{name}-{uuid.uuid4().hex}.bin"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def build_lexicon(
    docs: DataFrame, vocabulary: str | None = None, words: int = LEXICON_WORDS, pattern: str | None = None
) -> str:
    """Count words, compile the most frequent ones, and hand the automaton out; the name for :func:`encode`."""
    pattern = pattern or split_pattern()
    vocab = Vocabulary(vocabulary or vocabulary_path())
    # rarer words than these are never among the frequent ones of a corpus that has more words than the lexicon
    counts = materialise(word_counts(docs, pattern).filter(F.col("n") > 1), "words")
    frequent = [w.encode("utf-8") for w in frequent_words(counts, words)]
    return store_file(docs.sparkSession, compile_lexicon(frequent, vocab.merge), "lexicon")


_ENCODERS: dict[tuple, Encoder] = {}


def worker_encoder(lexicon: str, vocabulary: str, pattern: str, low: str) -> Encoder:
    """One encoder per worker process and lexicon."""
    key = (lexicon, vocabulary)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary(vocabulary), Lexicon.from_file(SparkFiles.get(lexicon)), pattern, low)
    return _ENCODERS[key]


def encode(
    docs: DataFrame, lexicon: str, vocabulary: str | None = None, pattern: str | None = None, decoded: bool = False
) -> DataFrame:
    """doc_id and ``ids``: the little-endian 32-bit ids of the whole text; with ``decoded`` also the ``text`` that
    these ids decode to, made in the same worker."""
    vocabulary, pattern, low = vocabulary or vocabulary_path(), pattern or split_pattern(), low_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(lexicon, vocabulary, pattern, low)
        table = decode_table(encoder.vocabulary) if decoded else None
        for batch in batches:
            doc, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in blocks(texts):
                ids, n = encoder.encode(texts[a:b])
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(n) * 4
                cut = [bytes(raw[e - 4 * k : e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                columns, names = [doc.slice(a, b - a), pa.array(cut, pa.binary())], ["doc_id", "ids"]
                if table is not None:
                    columns.append(pa.array([decode_bytes(c, table) for c in cut], pa.string()))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(columns, names)

    return documents(docs).mapInArrow(run, "doc_id long, ids binary" + ", text string" * decoded)


def decode_bytes(ids: bytes | None, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> str:
    """The text of little-endian 32-bit ids.  Bytes that are no UTF-8 become U+FFFD."""
    starts, lengths, flat = table
    numbers = np.frombuffer(ids or b"", "<u4")
    return _gather(starts[numbers], lengths[numbers], flat).tobytes().decode("utf-8", "replace")


def decode_table(vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each id's bytes, and all these bytes."""
    parts = [vocab.by_id.get(i, b"") for i in range(max(vocab.by_id) + 1)]
    n = np.array([len(p) for p in parts], np.int64)
    return np.cumsum(n) - n, n, np.frombuffer(b"".join(parts), np.uint8)


_DECODERS: dict[str, tuple] = {}


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``text`` of each row's ``ids``; other columns stay.  Bytes that are no UTF-8 become U+FFFD."""
    vocabulary = vocabulary or vocabulary_path()
    schema = ", ".join(f"{c} {t}" for c, t in encoded.dtypes) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _DECODERS:
            _DECODERS[vocabulary] = decode_table(Vocabulary(vocabulary))
        table = _DECODERS[vocabulary]
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [decode_bytes(x, table) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "text"])

    return encoded.mapInArrow(run, schema)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))
    lexicon = build_lexicon(docs)
    both = encode(docs, lexicon, decoded=True)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def digest(ids: list[int]) -> str:
    """What :func:`op10_bpe` returns for a list of ids; for tests."""
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
