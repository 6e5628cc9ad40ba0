"""Ranked lexical search: WAND in each document shard, heaps merged.

Indexing deals documents to shards of bounded size where they lie: a task counts the terms of the documents it reads and
writes a row per shard and term with the documents that hold it and how often, and a row per shard with its documents' ids
and lengths.  Nothing is shuffled.  Sums over these rows give the collection's statistics.

Searching sends a shard's postings of the asked terms to one task.  There each posting's impact is known at once, hence each
term's largest impact in the shard, and WAND walks the postings in order of documents: terms are added up, by the documents
they stand at, until their largest impacts together can beat the heap's threshold; the document reached is the pivot, and what lies
before it is skipped.  The threshold starts at the tenth best score of the documents that hold the heaviest terms.  Each shard
returns at most ``k`` rows an item, of which the best are kept.

Items are a stated set and go through in blocks of bounded terms.

Defined results: a null or empty text has no terms and is not counted; rows of the same item_id are one item; an item without known
terms has no row; equal scores rank by doc_id, null last; repeated documents count and rank each by itself; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, documents, materialise, slices, table

#: Bytes that belong to terms: ASCII letters and digits, and all bytes of other code points; A-Z count as a-z.
_TERM_BYTES = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(128)) + bytes(range(128, 256))


class Params(NamedTuple):
    """A shard ends at ``shard_terms`` term occurrences or ``shard_docs`` documents; items go through in blocks of about
    ``block_terms`` terms."""

    k: int = 10
    shard_terms: int = 2_000_000
    shard_docs: int = 20_000
    block_terms: int = 20_000
    seeds: int = 64


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, with repeats."""
    return (text or b"").translate(_TERM_BYTES).split()


class Index(NamedTuple):
    """``postings`` (shard, term, df, docs, tfs) and ``shards`` (shard, ids, lens), both in the shared folder."""

    postings: DataFrame
    shards: DataFrame
    documents: int
    terms: int


_INDEX = "shard long, term binary, df long, docs binary, tfs binary, ids array<long>, lens array<long>"


class _Shard:
    """Documents of one shard while they are read."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.lens: list[int] = []
        self.term, self.doc, self.tf, self.size = array("i"), array("i"), array("i"), 0

    def add(self, doc_id: int | None, found: list[bytes]) -> None:
        counts, numbers = Counter(found), self.numbers
        self.term.extend([numbers.setdefault(t, len(numbers)) for t in counts])
        self.tf.extend(counts.values())
        self.doc.extend([len(self.ids)] * len(counts))
        self.ids.append(doc_id)
        self.lens.append(len(found))
        self.size += len(found)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """Documents by ascending id, and each term's documents in that order."""
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] or 0))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        longs = pa.list_(pa.int64())
        names = [f.split()[0] for f in _INDEX.split(", ")]
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard]), pa.array([None], pa.binary()), pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([[self.ids[k] for k in order]], longs), pa.array([[self.lens[k] for k in order]], longs)],
            names,
        )
        term, doc, tf = (np.frombuffer(x, np.int32) for x in (self.term, self.doc, self.tf))
        by = np.lexsort((place[doc], term))
        ends = np.cumsum(np.bincount(term, minlength=len(self.numbers))) * 4
        docs, tfs = memoryview(place[doc[by]].astype("<i4").tobytes()), memoryview(tf[by].astype("<i4").tobytes())
        words, starts = list(self.numbers), np.concatenate([[0], ends[:-1]])
        for a in range(0, len(words), 5000):
            spans = list(zip(starts[a : a + 5000].tolist(), ends[a : a + 5000].tolist(), strict=True))
            n, nothing = len(spans), pa.nulls(len(spans), longs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * n), pa.array(words[a : a + 5000], pa.binary()), pa.array([(z - s) // 4 for s, z in spans], pa.int64()), pa.array([bytes(docs[s:z]) for s, z in spans], pa.binary()), pa.array([bytes(tfs[s:z]) for s, z in spans], pa.binary()), nothing, nothing],
                names,
            )


def index(docs: DataFrame, params: Params = Params()) -> Index:
    """Index every document; the result can be searched any number of times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, _Shard()
        for part in slices(batches):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if found := terms_of(text):
                    shard.add(doc_id, found)
                if shard.size >= params.shard_terms or len(shard.ids) >= params.shard_docs:
                    yield from shard.rows(number)
                    number, shard = number + 1, _Shard()
        if shard.ids:
            yield from shard.rows(number)

    raw = documents(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    rows = materialise(raw.mapInArrow(run, _INDEX), "postings")
    shards = rows.filter(F.col("term").isNull()).select("shard", "ids", "lens")
    n, total = shards.select(F.size("ids").alias("n"), F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x).alias("l")).agg(
        F.sum("n"), F.sum("l")
    ).first()
    return Index(rows.filter(F.col("term").isNotNull()).drop("ids", "lens"), shards, n or 0, total or 0)


def query_terms(items: DataFrame) -> DataFrame:
    """item_id and each of its terms once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            pairs = [(i, t) for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for t in set(terms_of(text))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in pairs], pa.int64()), pa.array([t for _, t in pairs], pa.binary())], ["item_id", "term"]
            )

    raw = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return raw.mapInArrow(run, "item_id long, term binary").distinct()


def weight(documents: int, df: int) -> int:
    """A term's weight from the number of documents and of those that hold it."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def length_factor(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """``m`` of documents of ``n`` terms each."""
    return np.array([10 + 90 * x * documents // terms for x in n.tolist()], np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds to each document's score."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Postings(NamedTuple):
    """One term of one shard: documents (ascending) and their impacts, weight included, and the largest of these."""

    docs: list[int]
    scores: list[int]
    most: int
    docs_array: np.ndarray
    scores_array: np.ndarray


def wand(lists: list[Postings], k: int, seeds: int = 64) -> list[tuple[int, int]]:
    """The ``k`` best (score, document) with a score above 0, best first; equal scores by ascending document."""
    lists = sorted((x for x in lists if x.most > 0), key=lambda x: -x.most)
    if not lists:
        return []
    reach = _seeded(lists, k, seeds)  # a document must score this much at least
    end = 1 << 62
    docs, scores, most = [x.docs for x in lists], [x.scores for x in lists], [x.most for x in lists]
    at, now = [0] * len(lists), [d[0] for d in docs]
    heap: list[tuple[int, int]] = []  # (score, -document), the worst first
    order = list(range(len(lists)))
    while order:
        order.sort(key=now.__getitem__)
        bound = 0
        for place, t in enumerate(order):
            bound += most[t]
            if bound >= reach:
                break
        else:
            break  # all that is left together can't reach it
        pivot = now[t]
        if now[order[0]] == pivot:
            score = 0
            for t in order:
                if now[t] != pivot:
                    break
                score += scores[t][at[t]]
                at[t] += 1
                now[t] = docs[t][at[t]] if at[t] < len(docs[t]) else end
            if score >= reach:
                if len(heap) < k:
                    heapq.heappush(heap, (score, -pivot))
                else:
                    heapq.heapreplace(heap, (score, -pivot))
                if len(heap) == k:  # later documents lose ties
                    reach = max(reach, heap[0][0] + 1)
        else:
            for t in order[:place]:
                if now[t] < pivot:
                    at[t] = bisect_left(docs[t], pivot, at[t] + 1)
                    now[t] = docs[t][at[t]] if at[t] < len(docs[t]) else end
        if end in now:
            order = [t for t in order if now[t] != end]
            now = [x if x != end else -1 for x in now]
    return [(s, -d) for s, d in sorted(heap, reverse=True)]


def _seeded(lists: list[Postings], k: int, seeds: int) -> int:
    """A score that ``k`` documents have at least: the k-th best of some that hold the heaviest terms; 1 if there are fewer."""
    some, held = [], 0
    for x in lists:
        some.append(x.docs_array[:seeds])
        held += len(some[-1])
        if held >= seeds:
            break
    chosen = np.unique(np.concatenate(some))
    if len(chosen) < k:
        return 1
    total = np.zeros(len(chosen), np.int64)
    for x in lists:
        where = np.minimum(np.searchsorted(x.docs_array, chosen), len(x.docs_array) - 1)
        total += np.where(x.docs_array[where] == chosen, x.scores_array[where], 0)
    return max(1, int(np.partition(total, len(total) - k)[len(total) - k]))


def search(found: Index, items: DataFrame, params: Params = Params()) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``k`` best documents."""
    asked = materialise(query_terms(items), "asked")
    pairs = asked.count()
    spark, schema = items.sparkSession, "item_id long, rank int, doc_id long, score long"
    if not pairs or not found.documents:
        return spark.createDataFrame([], schema)
    distinct = materialise(asked.select("term").distinct(), "terms")
    known = F.broadcast(distinct) if distinct.count() <= BROADCAST_ROWS else distinct
    df = found.postings.select("term", "df").join(known, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    asked = materialise(asked.join(df, "term"), "weighted")
    n_blocks = -(-pairs // params.block_terms)
    parts = []
    for block in range(n_blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).collect()  # about block_terms rows
        if rows:
            parts.append(_search_block(found, rows, params))
    merged = parts[0] if parts else spark.createDataFrame([], "item_id long, doc_id long, score long")
    for p in parts[1:]:
        merged = merged.union(p)
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return merged.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= params.k).select("item_id", "rank", "doc_id", "score")


def _search_block(found: Index, rows: list, params: Params) -> DataFrame:
    """The ``k`` best documents of each shard for the items of one block."""
    spark, n, total = found.postings.sparkSession, found.documents, found.terms
    weights = {bytes(r["term"]): weight(n, r["df"]) for r in rows}
    number = {t: k for k, t in enumerate(sorted(weights))}
    queries: dict[int | None, list[int]] = {}
    for r in rows:
        queries.setdefault(r["item_id"], []).append(number[bytes(r["term"])])
    by_number = [weights[t] for t in number]
    sent = spark.sparkContext.broadcast((queries, by_number))
    terms = F.broadcast(spark.createDataFrame([(bytearray(t), k) for t, k in number.items()], "term binary, t int"))
    nothing = F.lit(None)
    postings = found.postings.join(terms, "term").select(
        "shard", "t", "docs", "tfs", nothing.cast("array<long>").alias("ids"), nothing.cast("array<long>").alias("lens")
    )
    heads = found.shards.select(
        "shard", F.lit(-1).alias("t"), nothing.cast("binary").alias("docs"), nothing.cast("binary").alias("tfs"), "ids", "lens"
    )

    def run(shard: pa.Table) -> pa.Table:
        queries, by_number = sent.value
        numbers = shard.column("t").to_pylist()
        head = numbers.index(-1)
        ids = shard.column("ids")[head].as_py()
        m = length_factor(np.array(shard.column("lens")[head].as_py(), np.int64), n, total)
        lists: dict[int, Postings] = {}
        for t, docs, tfs in zip(numbers, shard.column("docs").to_pylist(), shard.column("tfs").to_pylist(), strict=True):
            if t >= 0:
                where = np.frombuffer(docs, "<i4")
                scores = by_number[t] * impacts(np.frombuffer(tfs, "<i4").astype(np.int64), m[where])
                lists[t] = Postings(where.tolist(), scores.tolist(), int(scores.max()), where, scores)
        out = [
            (item, ids[doc], score)
            for item, terms in queries.items()
            for score, doc in wand([lists[t] for t in terms if t in lists], params.k, params.seeds)
        ]
        return pa.table(
            [pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["item_id", "doc_id", "score"]
        )

    return postings.unionByName(heads).groupBy("shard").applyInArrow(run, "item_id long, doc_id long, score long")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return search(index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
lens AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM lens),
factors AS (SELECT doc_id, 10 + (90 * n * docs) // total AS m FROM lens, whole),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM dfs, whole),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN factors USING (doc_id) GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
