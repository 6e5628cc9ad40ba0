"""Near-duplicate documents by SetSketch registers.

Each set of word shingles becomes ``m`` registers: minima of exponentially distributed values, kept as truncated
exponents to the base ``b``.  Registers of a union are the maxima of the parts' registers, so sketches merge; equal
registers are about as frequent as the sets are alike, so bands of them find candidates.  Documents that share a band
meet at the band's smallest one, pairs that the joint likelihood of both sketches rules out are dropped, and the rest
is confirmed on the full sets.

How hot groups are met: equal sets are one class from the start (their fingerprint is grouped with partial sums) and
only the class's smallest document goes on.  Every class is tested against the smallest one that it meets (its hub), one
hub's set in a task at a time; what that links is one component and is not tested within itself again.  Only members that
stand outside a group's largest component are tested further, in pairs of blocks of bounded size, by registers first;
a task returns a spanning forest of what it confirmed, so no list of all pairs is ever made.  Keys with very many
rows (a band, a hub, a fingerprint, a node) are looked up by a broadcast of bounded size and their rows spread.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing; fewer words
than a shingle has are one shingle; rows of one doc_id are one document, with different texts that of the largest set
(the greatest fingerprint on ties); rows without a doc_id are one document each, kept after those that have one, and a
component_id is null where no member has a doc_id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, blocks, documents, hot_from, lookup, materialise, slices, table, without


class Params(NamedTuple):
    """``words`` per shingle; documents link at ``percent`` % similarity; ``bands`` of ``rows`` registers.

    With 36 bands of 5 a pair at 80 % similarity is missed with probability 7e-7 before any other link is counted.
    A candidate is dropped when its estimate lies more than ``margin`` standard errors below the threshold.
    """

    words: int = 5
    percent: int = 80
    bands: int = 36
    rows: int = 5
    base: float = 1.2
    rate: float = 20.0
    top: int = 254
    margin: float = 5.0
    block: int = 96

    @property
    def registers(self) -> int:
        return self.bands * self.rows


MEMO_WORDS = 100_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of the public MurmurHash3."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_WORDS: dict[bytes, int] = {}


def _word_hash(word: bytes) -> int:
    found = _WORDS.get(word)
    if found is None:
        if len(_WORDS) > MEMO_WORDS:
            _WORDS.clear()
        found = _WORDS[word] = xxhash.xxh3_64_intdigest(word)
    return found


def shingles(text: str | None, words: int) -> np.ndarray:
    """The ascending 64-bit hashes of the distinct shingles of a whole text, A-Z lower-cased."""
    tokens = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_word_hash, tokens), np.uint64, len(tokens))
    n = max(1, len(h) - words + 1)
    s = np.full(n, min(len(h), words), np.uint64)
    for k in range(min(len(h), words)):
        s = _mix(s * _GOLD + h[k : k + n])
    return np.unique(s)


def fingerprint(shingle_set: np.ndarray) -> bytes:
    """128 bits of a whole set."""
    return hashlib.blake2b(shingle_set.tobytes(), digest_size=16).digest()


def sketch(sets: list[np.ndarray], p: Params) -> np.ndarray:
    """One row of registers per set.

    A shingle's values are the points of a Poisson process, each thrown to one register; only the earliest points can
    be minima, so points are drawn up to a time by which all registers are hit, later for the sets where one was not.
    """
    m = p.registers
    least = np.full((len(sets), m), np.inf)
    sizes = np.array([len(s) for s in sets], np.int64)
    # by this time a register is still free with probability exp(-8) / m
    until = np.where(sizes > 0, (math.log(m) + 8) / (p.rate * np.maximum(sizes, 1)), 0.0)
    todo = np.flatnonzero(sizes > 0)
    while len(todo):
        owner = np.repeat(todo, sizes[todo])
        state = np.concatenate([sets[i] for i in todo])
        time = np.zeros(len(state))
        while len(state):
            state = _mix(state + _GOLD)
            time = time - np.log((state >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / (m * p.rate)
            live = time <= until[owner]
            owner, state, time = owner[live], state[live], time[live]
            cell = owner * m + (_mix(state ^ _GOLD) % np.uint64(m)).astype(np.int64)
            np.minimum.at(least.reshape(-1), cell, time)
        todo = todo[np.isinf(least[todo]).any(axis=1)]
        until[todo] *= 2
    with np.errstate(divide="ignore"):
        exponent = np.floor(1 - np.log(least) / math.log(p.base))
    return np.clip(np.where(np.isinf(least), 0, exponent), 0, p.top).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, p: Params) -> np.ndarray:
    """Maximum-likelihood similarity of pairs, from which registers are greater, less and equal, and both sizes.

    The log-likelihood is concave in the similarity, so its maximum is found by ternary search.
    """
    up, down = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - up - down
    u = na / np.maximum(na + nb, 1)
    v = 1 - u
    log_b = math.log(p.base)

    def prob(x: np.ndarray) -> np.ndarray:
        return -np.log(np.maximum(1 - x * (p.base - 1) / p.base, 1e-300)) / log_b

    def value(j: np.ndarray) -> np.ndarray:
        more, less = prob(np.maximum(u - v * j, 0)), prob(np.maximum(v - u * j, 0))
        tiny = 1e-12
        return (
            up * np.log(np.maximum(more, tiny))
            + down * np.log(np.maximum(less, tiny))
            + same * np.log(np.maximum(1 - more - less, tiny))
        )

    low, high = np.zeros(len(u)), np.minimum(u / np.maximum(v, 1e-12), v / np.maximum(u, 1e-12))
    for _ in range(40):
        x, y = low + (high - low) / 3, high - (high - low) / 3
        left = value(x) > value(y)
        high, low = np.where(left, y, high), np.where(left, low, x)
    return (low + high) / 2


def candidate_floor(p: Params) -> float:
    """Estimates below this rule a pair out."""
    j = p.percent / 100
    return j - p.margin * math.sqrt(j * (1 - j) / p.registers)


def linked(inter: np.ndarray, na: np.ndarray, nb: np.ndarray, p: Params) -> np.ndarray:
    return 100 * inter >= p.percent * (na + nb - inter)


# --- on Spark ----------------------------------------------------------------------------------------------------


def sketches(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, n, ``fp`` (128 bits of the whole set) and the registers: one row per document, that of its largest set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for k, end in blocks(texts):
                part = batch.slice(k, end - k)
                sets = [shingles(t, p.words) for t in texts[k:end]]
                regs = sketch(sets, p)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([fingerprint(s) for s in sets], pa.binary()),
                        pa.array([r.tobytes() for r in regs], pa.binary()),
                    ],
                    ["doc_id", "n", "fp", "regs"],
                )

    rows = documents(docs).mapInArrow(run, "doc_id long, n long, fp binary, regs binary")
    return rows.groupBy("doc_id").agg(F.max(F.struct("n", "fp", "regs")).alias("s")).select("doc_id", "s.*")


def _bands(reps: DataFrame, p: Params) -> DataFrame:
    """A row per class and band: the band's key, the class and its set's size."""
    key = F.xxhash64("i", F.substring("regs", F.col("i") * p.rows + 1, F.lit(p.rows)))
    every = F.explode(F.sequence(F.lit(0), F.lit(p.bands - 1)))
    return reps.select("doc_id", "n", "regs", every.alias("i")).select(key.alias("key"), "doc_id", "n")


def meetings(reps: DataFrame, p: Params) -> DataFrame:
    """(hub, hub_n, doc_id, n): every class that shares a band with others, the smallest class there, and both sizes."""
    bands = _bands(reps, p)
    hubs = bands.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("hub"), F.count(F.lit(1)).alias("size"))
    hubs = hubs.filter("size > 1").select("key", F.col("hub.doc_id").alias("hub"), F.col("hub.n").alias("hub_n"), "size")
    met = lookup(bands, materialise(hubs, "hubs"), "key", "size", reps.count() * p.bands, F.col("doc_id"))
    return met.filter(F.col("hub") < F.col("doc_id")).select("hub", "hub_n", "doc_id", "n").distinct()


def _with_block(met: DataFrame, pairs: int) -> tuple[DataFrame, DataFrame]:
    """``met`` with ``part``, and (hub, part): a hot hub's group is dealt to parts, any other is one."""
    sizes = materialise(met.groupBy("hub").agg(F.count(F.lit(1)).alias("size")), "sizes")
    least = hot_from(pairs)
    parts = F.greatest(F.lit(1), F.floor(F.col("size") / least)).cast("int")
    hot = sizes.filter(F.col("size") >= least).select(F.col("hub").alias("__hub"), parts.alias("__parts"))  # HOT_KEYS rows at most
    wide = met.join(F.broadcast(hot), F.col("hub") == F.col("__hub"), "left")
    part = F.pmod(F.xxhash64("doc_id"), F.coalesce("__parts", F.lit(1))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.when(F.col("size") >= least, parts).otherwise(1) - 1))
    return wide.select(*met.columns, part.alias("part")), sizes.select("hub", every.alias("part"))


def estimated(met: DataFrame, parts: DataFrame, reps: DataFrame, p: Params) -> DataFrame:
    """(hub, part, doc_id): the meetings whose sizes and likelihood estimate allow the link."""
    floor = candidate_floor(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            regs = [np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(b.num_rows, -1) for k in (5, 6)]
            est = similarity(*regs, b.column(3).to_numpy().astype(float), b.column(4).to_numpy().astype(float), p)
            yield b.select([0, 1, 2]).filter(pa.array(est >= floor))

    # a link needs 100 * min >= percent * max
    pairs = met.filter(100 * F.least("hub_n", "n") >= p.percent * F.greatest("hub_n", "n"))
    a = parts.join(reps.select(F.col("doc_id").alias("hub"), F.col("regs").alias("ra")), "hub")
    b = reps.select("doc_id", F.col("regs").alias("rb"))
    both = pairs.join(b, "doc_id").join(a, ["hub", "part"]).select("hub", "part", "doc_id", "hub_n", "n", "ra", "rb")
    return both.mapInArrow(run, "hub long, part int, doc_id long")


def _with_text(docs: DataFrame, tests: DataFrame, reps: DataFrame) -> DataFrame:
    """``tests`` with the text of their doc_id, and its fingerprint if they lack it."""
    wanted = tests.select("doc_id").distinct()
    if wanted.count() <= BROADCAST_ROWS:  # else the texts are shuffled
        wanted = F.broadcast(wanted)
    texts = documents(docs).join(wanted, "doc_id", "left_semi")
    known = tests if "fp" in tests.columns else tests.join(reps.select("doc_id", "fp"), "doc_id")
    return known.join(texts, "doc_id")


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array([f[i] for f in found], pa.int64()) for i, k in enumerate("ab")})


def stars(docs: DataFrame, pairs: DataFrame, reps: DataFrame, p: Params) -> DataFrame:
    """(a, b): the pairs of a hub and a document that the full sets confirm.  A task holds one hub's set at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, None
        for batch in slices(batches):
            found: list[tuple[int, int]] = []
            for hub_id, part, role, doc_id, fp, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at != (hub_id, part):
                    at, hub = (hub_id, part), None
                own = shingles(text, p.words)
                if fingerprint(own) != fp:  # another text under the same doc_id
                    continue
                if role == 0:
                    hub = own
                elif hub is not None and linked(np.intersect1d(hub, own, assume_unique=True).size, len(hub), len(own), p):
                    found.append((hub_id, doc_id))
            yield _edges(found)

    hubs = pairs.select("hub", "part").distinct().select("hub", "part", F.lit(0).alias("role"), F.col("hub").alias("doc_id"))
    tests = materialise(hubs.unionByName(pairs.select("hub", "part", F.lit(1).alias("role"), "doc_id")), "tests")
    rows = _with_text(docs, tests, reps).select("hub", "part", "role", "doc_id", "fp", "text")
    return rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "role").mapInArrow(run, "a long, b long")


def _members(met: DataFrame, comp: DataFrame) -> DataFrame:
    """(hub, doc_id, n, c, new): every group's members with their component, the hub itself too.

    A hub that meets smaller ones belongs to the group of the smallest (its parent), and two members that both belong there
    too are compared there.  ``new`` are those that don't.
    """
    own = met.groupBy("hub").agg(F.count(F.lit(1)).alias("size"), F.max("hub_n").alias("n"))
    parents = met.groupBy(F.col("doc_id").alias("hub")).agg(F.min("hub").alias("parent"))
    own = materialise(own.join(parents, "hub", "left"), "own")
    rows = lookup(met.select("hub", "doc_id", "n"), own.select("hub", "size", "parent"), "hub", "size", met.count(), F.col("doc_id"))
    rows = rows.unionByName(own.select("hub", F.col("hub").alias("doc_id"), "n", "parent"))
    there = met.select(F.col("hub").alias("parent"), "doc_id", F.lit(True).alias("there"))
    rows = rows.join(there, ["parent", "doc_id"], "left").join(comp, "doc_id", "left")
    c = F.coalesce("component_id", "doc_id")
    return rows.select("hub", "doc_id", "n", c.alias("c"), F.col("there").isNull().alias("new"))


def _rest(met: DataFrame, comp: DataFrame, reps: DataFrame, p: Params) -> DataFrame | None:
    """(hub, x, y, side, doc_id, c, n, regs, fp): what the hubs leave open, dealt to pairs of blocks; None where nothing is.

    A group whose members are one component is done.  In all others a member outside the largest component is tested
    against all others, but for two that meet at the hub's parent (:func:`_members`): ``x`` and ``y`` number two blocks, ``side``
    is a document's own one and ``c`` its component.  A block holds about ``p.block`` documents, or fewer where they are long.
    """
    members = materialise(_members(met, comp), "members")
    each = members.groupBy("hub", "c").agg(F.count(F.lit(1)).alias("k"), F.count_if("new").alias("k_new"))
    groups = each.groupBy("hub").agg(F.max(F.struct("k", "c")).alias("main"), F.sum("k").alias("size"), F.sum("k_new").alias("new"))
    groups = groups.filter((F.col("size") > 2) & (F.col("size") > F.col("main.k")) & (F.col("new") > 0)).select("hub", "size", F.col("main.c").alias("main"))
    groups = materialise(groups, "groups")
    if groups.isEmpty():
        return None
    rows = lookup(members, groups, "hub", "size", members.count(), F.col("doc_id")).filter("main IS NOT NULL")
    # four kinds: outside and new, in the main component and new, outside and old, in the main one and old
    apart = F.col("c") != F.col("main")
    kind = F.when(apart & F.col("new"), 0).when(F.col("new"), 1).when(apart, 2).otherwise(3)
    rows = materialise(rows.select("hub", "doc_id", "n", "c", kind.alias("kind")), "kinds")
    block = lambda k: F.greatest(F.ceil(F.count_if(F.col("kind") == k) / p.block), F.ceil(F.sum(F.when(F.col("kind") == k, F.col("n"))) / 1_000_000), F.lit(0)).cast("int")
    blocks_of = rows.groupBy("hub").agg(F.count(F.lit(1)).alias("size"), F.array(*[block(k) for k in range(4)]).alias("blocks"))
    blocks_of = materialise(blocks_of, "blocks")
    rows = lookup(rows, blocks_of, "hub", "size", rows.count(), F.col("doc_id"))
    n = [F.get("blocks", F.lit(k)) for k in range(4)]
    at = [F.lit(0), n[0], n[0] + n[1], n[0] + n[1] + n[2]]
    span = lambda k: F.when(n[k] > 0, F.sequence(at[k], at[k] + n[k] - 1)).otherwise(F.array().cast("array<int>"))
    meets = F.concat(span(0), F.when(F.col("kind") == 0, F.concat(span(1), span(2), span(3))).when(F.col("kind") == 1, span(2)).when(F.col("kind") == 2, span(1)).otherwise(F.array().cast("array<int>")))
    mine = F.pmod(F.xxhash64("doc_id"), F.get("blocks", F.col("kind"))).cast("int")
    side = F.get(F.array(*at), F.col("kind")) + mine
    rows = rows.select("hub", "doc_id", "c", "n", side.alias("side"), meets.alias("meets")).filter(F.size("meets") > 0)
    rows = rows.join(reps.select("doc_id", "regs", "fp"), "doc_id").select("hub", "doc_id", "c", "n", "regs", "fp", "side", F.explode("meets").alias("other"))
    return rows.select("hub", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "doc_id", "c", "n", "regs", "fp")


class _Group(NamedTuple):
    """The documents of one pair of blocks."""

    hub: int
    x: int
    y: int
    side: np.ndarray
    ids: np.ndarray
    c: np.ndarray
    n: np.ndarray
    regs: np.ndarray

    def candidates(self, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index pairs of different components that sizes and likelihood allow to be linked, and their estimates."""
        floor, out = candidate_floor(p), [(np.empty(0, int),) * 2 + (np.empty(0),)]
        every = np.arange(len(self.ids))
        left, right = every[self.side == self.x], every[self.side == self.y]
        if len(left) > len(right):
            left, right = right, left
        for a in left.tolist():
            b = right[right > a] if self.x == self.y else right  # each block is tested within itself elsewhere
            ok = (self.c[b] != self.c[a]) & (100 * np.minimum(self.n[a], self.n[b]) >= p.percent * np.maximum(self.n[a], self.n[b]))
            b = b[ok & (self.ids[b] != self.hub)] if self.ids[a] != self.hub else b[:0]  # those with the hub were tested before
            # equal registers are at least as frequent as the sets are alike
            b = b[(self.regs[b] == self.regs[a]).sum(1) >= floor * p.registers]
            if len(b):
                est = similarity(np.broadcast_to(self.regs[a], (len(b), p.registers)), self.regs[b], np.full(len(b), float(self.n[a])), self.n[b].astype(float), p)
                b, est = b[est >= floor], est[est >= floor]
                out.append((np.full(len(b), a), b, est))
        return tuple(np.concatenate(z) for z in zip(*out, strict=True))

    def forest(self, sets: list[np.ndarray], p: Params) -> list[tuple[int, int]]:
        """Links on the full sets that connect all that is linked here and was in different components."""
        a, b, est = self.candidates(p)
        root = {c: c for c in self.c.tolist()}

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        out = []
        for k in np.argsort(-est, kind="stable").tolist():
            i, j = int(a[k]), int(b[k])
            ci, cj = find(int(self.c[i])), find(int(self.c[j]))
            if ci != cj and linked(np.intersect1d(sets[i], sets[j], assume_unique=True).size, len(sets[i]), len(sets[j]), p):
                root[ci] = cj
                out.append((int(self.ids[i]), int(self.ids[j])))
        return out


def _grouped(batches: Iterator[pa.RecordBatch], prepare) -> Iterator[list[tuple] | None]:
    """The rows of each group of equal first three columns; None after each batch."""
    held: list[tuple] = []
    for batch in slices(batches):
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and held[-1][:3] != row[:3]:
                yield held
                held = []
            held.append(prepare(row))
        yield None
    if held:
        yield held


def _group(rows: list[tuple]) -> _Group:
    column = lambda k: np.array([r[k] for r in rows], np.int64)
    return _Group(*rows[0][:3], column(3), column(4), column(5), column(6), np.frombuffer(b"".join(r[7] for r in rows), np.uint8).reshape(len(rows), -1))


def remaining(docs: DataFrame, met: DataFrame, comp: DataFrame, reps: DataFrame, p: Params) -> DataFrame:
    """(a, b): links that connect what :func:`stars` left apart and the full sets link.

    Pairs of blocks are compared by their registers first; texts go only to documents that then have a candidate.
    """
    by = ["hub", "x", "y"]
    schema = "hub long, x long, y long, side long, doc_id long, c long, n long, regs binary, fp binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in _grouped(batches, lambda r: r):
            if rows is not None:
                a, b, _ = _group(rows).candidates(p)
                out += [rows[i] for i in np.union1d(a, b).tolist()]
            elif out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for rows in _grouped(batches, lambda r: (*r[:-1], shingles(r[-1], p.words))):
            if rows is not None:
                rows = [r for r in rows if fingerprint(r[-1]) == r[-2]]  # not another text under the same doc_id
                rows = list({r[4]: r for r in rows}.values())
                found += _group(rows).forest([r[-1] for r in rows], p) if rows else []
            else:
                yield _edges(found)
                found = []
        yield _edges(found)

    open_ = _rest(met, comp, reps, p)
    if open_ is None:
        return docs.sparkSession.createDataFrame([], "a long, b long")
    open_ = materialise(open_, "open")
    typed = open_.select(*names).withColumns({k: F.col(k).cast(t) for k, t in (x.split() for x in schema.split(", "))})
    # dealt by number, as the work for a row is large for its bytes
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), open_.count() // 4096)
    some = materialise(typed.repartition(parts, *by).sortWithinPartitions(*by).mapInArrow(screen, schema), "screened")
    rows = _with_text(docs, some, reps).select(*names, "text")
    return rows.repartition(parts, *by).sortWithinPartitions(*by).mapInArrow(confirm, "a long, b long")


def _settled(edges: DataFrame) -> tuple:
    """Count and two sums of hashes of a set of edges, which two sets share only if they are equal."""
    h = [F.sum(F.xxhash64(F.lit(k), "lo", "hi").cast("decimal(20,0)")) for k in (1, 2)]
    return tuple(edges.agg(F.count(F.lit(1)), *h).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(doc_id, component_id) of every document with a link: the smallest document that can be reached.

    Alternates large stars (neighbours above a node go to its smallest neighbour) and small stars (those below do),
    until nothing changes; every round is written to the shared folder, and only counts reach the driver.  Nodes with very
    many neighbours take their smallest one by broadcast (:func:`lookup`).
    """
    edges = materialise(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo < hi").distinct(), "edges")
    state = _settled(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        both = edges.select(F.col("lo").alias("n"), F.col("hi").alias("o")).unionByName(
            edges.select(F.col("hi").alias("n"), F.col("lo").alias("o"))
        )
        least = both.groupBy("n").agg(F.least(F.min("o"), F.col("n")).alias("m"), F.count_if(F.col("o") > F.col("n")).alias("size"))
        up = edges.select(F.col("lo").alias("n"), F.col("hi").alias("o"))
        large = lookup(up, least, "n", "size", state[0], F.col("o"))
        large = materialise(large.select(F.col("m").alias("lo"), F.col("o").alias("hi")).distinct(), "large")  # no more rows than edges
        lower = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("size"))
        small = lookup(large, lower, "hi", "size", state[0], F.col("lo"))
        small = small.select(F.col("m").alias("lo"), F.explode(F.array("hi", "lo")).alias("hi")).filter("lo < hi").distinct()
        edges, before = materialise(small, "edges"), state
        state = _settled(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("hi").alias("doc_id"), F.col("lo").alias("component_id"))


class Numbered(NamedTuple):
    """Documents of which each has a doc_id: those without one got numbers beyond ``low`` to ``high``."""

    docs: DataFrame
    low: int
    high: int

    def given(self, number: str) -> Column:
        """The doc_id as the table has it."""
        return F.when(F.col(number).between(self.low, self.high), F.col(number))


def _numbered(docs: DataFrame) -> Numbered | None:
    """doc_id, text and the whole row (``__row``); None where every document has a doc_id."""
    number = F.col("doc_id").cast("long")
    low, high, missing = docs.agg(F.min(number), F.max(number), F.count_if(number.isNull())).first()
    if not missing:
        return None
    low, high = (0, -1) if low is None else (low, high)
    rows = documents(docs, carry=True)
    lost = rows.filter("doc_id IS NULL").withColumn("__m", F.monotonically_increasing_id())
    lost = materialise(lost.select("text", "__row", (F.col("__m") % 2**33).alias("k"), F.shiftright("__m", 33).alias("part")), "lost")
    counts = lost.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # a row per partition
    starts, at = [], high + 1 if high + missing < 2**63 else low - missing
    for r in counts:
        starts.append((r["part"], at))
        at += r["n"]
    starts = F.broadcast(docs.sparkSession.createDataFrame(starts, "__part long, start long"))
    lost = lost.join(starts, F.col("part") == F.col("__part"))
    lost = lost.select((F.col("start") + F.col("k")).alias("doc_id"), "text", "__row")
    return Numbered(rows.filter("doc_id IS NOT NULL").unionByName(lost), low, high)


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Per document: n_shingles, component_id, kept."""
    numbered = _numbered(docs)
    if numbered is None:
        return _near_duplicates(docs, p)
    found = _near_duplicates(numbered.docs, p)
    return found.withColumns({c: numbered.given(c) for c in ("doc_id", "component_id")})


def _near_duplicates(docs: DataFrame, p: Params) -> DataFrame:
    found = materialise(sketches(docs, p), "sketches")
    classes = found.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    classes = materialise(classes, "classes")
    reps = materialise(found.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), "reps")
    met = materialise(meetings(reps, p), "meetings")
    met, parts = _with_block(met, met.count())
    pairs = materialise(estimated(met, parts, reps, p), "pairs")
    comp = components(stars(docs, pairs, reps, p))
    more = materialise(remaining(docs, met, comp, reps, p), "more")
    comp = _joined(comp, more)
    classes = classes.join(comp.withColumnRenamed("doc_id", "rep"), "rep", "left")
    classes = materialise(classes.select("fp", "size", F.coalesce("component_id", "rep").alias("c")), "components")
    rows = lookup(found.select("doc_id", "n", "fp"), classes, "fp", "size", found.count(), F.col("doc_id"))
    component = F.coalesce("c", "doc_id")
    return rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        (F.col("doc_id") == component).alias("kept"),
    )


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """The components after further links between their members."""
    if links.isEmpty():
        return comp
    of = comp.withColumnsRenamed({"doc_id": "__d", "component_id": "__c"})
    for end in ("a", "b"):
        links = links.join(of, F.col(end) == F.col("__d"), "left").withColumn(end, F.coalesce("__c", end)).select("a", "b")
    above = materialise(components(links), "above")
    up = above.withColumnsRenamed({"doc_id": "__d", "component_id": "__c"})
    moved = comp.join(up, F.col("component_id") == F.col("__d"), "left").select("doc_id", F.coalesce("__c", "component_id").alias("component_id"))
    return moved.unionByName(above.join(comp.select("doc_id"), "doc_id", "left_anti"))


def keep_one(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The documents, without the near copies of smaller doc_ids; all columns stay."""
    numbered = _numbered(docs)
    rows = docs if numbered is None else numbered.docs
    kept = without(rows, _near_duplicates(rows, p).filter(~F.col("kept")))
    return kept if numbered is None else kept.select("__row.*")


#: The parameters of the query: three words, 85 %.
QUERY = Params(words=3, percent=85)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), QUERY)
