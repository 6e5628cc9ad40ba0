"""Shards by a k-d tree over document metadata.

A node of the tree is split at the weighted median of its widest metadata dimension, weights being bytes, until each
leaf is one shard of about the target bytes; how wide a dimension is counts as a share of its width in the whole table.  A document's key in a dimension is the value and, for ties, a hash of
its text and id and then one of the row's number, so a node can be split within equal values and within equal rows: a hot group
of copies, and a row that is repeated, spread like all else.  The
median is found on the cluster: per round every node's key range is cut into bins, bins are summed where the rows are,
and the bin that holds the median is the next range, until it holds one key; the driver sees one row per node.

Law: ``bytes`` (leaves differ by about the size of a document).

Defined results: a null text has size 1; null metadata is a value of its own, below all others; repeated rows lie next
to each other in every dimension and are placed one by one, which of them where is left open; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, n_chunks, running_offset, table, with_missing

#: Bins per node and round.
BINS = 1024
#: Bits of a key: its value, then the tie-break.
VALUE_BITS, TIE_BITS = 20, 42
#: Bits of the tie-break that tell equal rows apart.
ROW_BITS = 20
VALUES = 1 << VALUE_BITS

DIMENSIONS = ("d_size", "d_lang", "d_source", "d_order")


class Split(NamedTuple):
    node: int
    dimension: str
    key: int  # keys up to this one go to the first child
    first: int
    second: int


def _named(c: str) -> Column:
    """A name as a number that keeps equal names together: null is 0."""
    return F.coalesce(F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(VALUES - 1)) + 1, F.lit(0))


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, and per dimension the 62-bit key of each document; ids keep their order at any range."""
    docs = with_missing(docs, lang="string", source="string")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    number = F.col("doc_id").cast("long")
    low, high = docs.agg(F.min(number), F.max(number)).first()
    size = F.octet_length(text).cast("long") + 1
    base = docs.select(
        number.alias("doc_id"),
        size.alias("size"),
        F.crc32(text).alias("text_crc32"),
        _named("lang").alias("d_lang"),
        _named("source").alias("d_source"),
    )
    same = F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32"), 64 - TIE_BITS + ROW_BITS)
    row = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - ROW_BITS)  # the caller writes these rows once
    tie = F.shiftleft(same, ROW_BITS) + row
    steps = (VALUES - 2) / max((high or 0) - (low or 0), 1)
    value = {
        "d_size": F.least(F.floor(F.log2("size") * (VALUES // 64)), F.lit(VALUES - 1)).cast("long"),
        "d_lang": F.col("d_lang"),
        "d_source": F.col("d_source"),
        "d_order": F.coalesce(1 + F.floor((F.col("doc_id").cast("double") - F.lit(float(low or 0))) * steps), F.lit(0)),
    }
    return base.withColumns({d: (F.shiftleft(v.cast("long"), TIE_BITS) + tie) for d, v in value.items()})


def _small(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A broadcast table of constants: one row per node, so at most as many as there are shards."""
    values = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}L" for x in r) + ")" for r in rows)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})"))


def _per_node(rows: DataFrame, columns: str, table: list[tuple]) -> DataFrame:
    """``rows`` of the nodes in ``table`` (node first) with its columns; one node needs no join."""
    names = columns.split(", ")
    if len(table) == 1:
        node, *values = table[0]
        return rows.filter(F.col("node") == node).withColumns({n: F.lit(v) for n, v in zip(names[1:], values, strict=True)})
    return rows.join(_small(rows.sparkSession, columns, table), "node")


def _in_dimension(name: Column) -> Column:
    out = F.lit(None).cast("long")
    for d in DIMENSIONS:
        out = F.when(name == d, F.col(d)).otherwise(out)
    return out


def _with_node(meta: DataFrame, splits: list[Split]) -> DataFrame:
    """``node`` of each row: one comparison per level, from the root down."""
    if not splits:
        return meta.withColumn("node", F.lit(1).cast("long"))
    root, *deeper = sorted(splits, key=lambda s: s.node)
    rows = meta.withColumn("node", 2 + (F.col(root.dimension) > root.key).cast("long"))
    levels: dict[int, list[Split]] = {}
    for s in deeper:
        levels.setdefault(s.node.bit_length(), []).append(s)
    for level in sorted(levels):
        here = _small(meta.sparkSession, "node, by, up_to", [(s.node, s.dimension, s.key) for s in levels[level]])
        second = (_in_dimension(F.col("by")) > F.col("up_to")).cast("long")
        rows = rows.join(here, "node", "left").select(
            *meta.columns, F.when(F.col("by").isNull(), F.col("node")).otherwise(2 * F.col("node") + second).alias("node")
        )
    return rows


def _medians(rows: DataFrame, dimension: dict[int, str], ranges: dict[int, tuple[int, int]], want: dict[int, float]) -> dict[int, int]:
    """Per node the key up to which the weights come nearest to ``want``."""
    low = {n: a for n, (a, _) in ranges.items()}
    high = {n: b for n, (_, b) in ranges.items()}
    before = dict.fromkeys(ranges, 0)
    out: dict[int, int] = {}
    keyed = _per_node(rows, "node, by", [(n, dimension[n]) for n in ranges])
    keyed = keyed.select("node", _in_dimension(F.col("by")).alias("key"), "size")
    upto = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    while low:
        width = {n: max(1, -(-(high[n] - low[n] + 1) // BINS)) for n in low}
        here = _per_node(keyed, "node, low, high, width", [(n, low[n], high[n], width[n]) for n in low])
        here = here.filter("key between low and high").withColumn("bin", F.expr("cast((key - low) div width as int)"))
        sums = here.groupBy("node", "bin").agg(F.sum("size").alias("w"), F.min("key").alias("a"), F.max("key").alias("b"))
        sums = _per_node(sums.withColumn("upto", F.sum("w").over(upto)), "node, goal", [(n, max(1, math.ceil(want[n] - before[n]))) for n in low])
        for r in sums.filter("upto >= goal and upto - w < goal").collect():  # the bin that holds it, one row per node
            n, at = r["node"], before[r["node"]] + r["upto"] - r["w"]
            if r["a"] == r["b"]:  # one key: take it or stop before it, whichever is nearer
                take = at + r["w"] - want[n] <= want[n] - at
                out[n] = r["a"] if take else r["a"] - 1
                low.pop(n)
                high.pop(n)
            else:
                low[n], high[n], before[n] = r["a"], r["b"], at
    return out


def kd_shards(meta: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> tuple[DataFrame, list[Split]]:
    """The rows of :func:`metadata` with their shard, and the splits that it is made of."""
    total = meta.agg(F.sum("size").alias("w")).first()["w"] or 0
    leaves = shards or max(1, math.ceil(total / target_bytes))
    splits: list[Split] = []
    count, inner, whole = {1: leaves}, set(), None
    while open_nodes := {n: k for n, k in count.items() if k > 1 and n not in inner}:
        rows = _with_node(meta, splits)
        least = min(open_nodes)  # nodes of one level, and leaves of earlier ones below them
        found = rows.filter(F.col("node") >= least).groupBy("node").agg(
            F.sum("size").alias("w"),
            *[f(d).alias(f"{d}_{a}") for d in DIMENSIONS for f, a in ((F.min, "min"), (F.max, "max"))],
        )
        stats = {r["node"]: r for r in found.collect()}
        width = lambda d, r: (r[f"{d}_max"] >> TIE_BITS) - (r[f"{d}_min"] >> TIE_BITS)
        whole = whole or {d: max(1, width(d, stats[1])) for d in DIMENSIONS if 1 in stats}
        dimension, ranges, want = {}, {}, {}
        for n, k in open_nodes.items():
            if (r := stats.get(n)) is None:  # no rows left: its leaves stay empty
                dimension[n] = DIMENSIONS[0]
                continue
            d = max(DIMENSIONS, key=lambda d, r=r: width(d, r) / whole[d])
            dimension[n], ranges[n] = d, (r[f"{d}_min"], r[f"{d}_max"])
            want[n] = r["w"] * (k // 2) / k
        keys = _medians(rows, dimension, ranges, want) if ranges else {}
        for n, k in open_nodes.items():
            splits.append(Split(n, dimension[n], keys.get(n, 0), 2 * n, 2 * n + 1))
            count[2 * n], count[2 * n + 1] = k // 2, k - k // 2
            inner.add(n)
    order = sorted((n for n in count if n not in inner), key=lambda n: bin(n)[3:])
    placed = _per_node(_with_node(meta, splits), "node, shard", [(n, k) for k, n in enumerate(order)])
    return placed.withColumn("shard", F.col("shard").cast("int")).drop("node"), splits


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Per document: size, text_crc32, shard and its slot there."""
    meta = materialise(metadata(docs), "metadata")
    placed, _ = kd_shards(meta, shards, target_bytes)
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    return running_offset(
        placed, ["shard"], order, F.col("d_order"), F.lit(1), "slot", n_chunks(meta.count())
    ).select("doc_id", "size", "text_crc32", "shard", "slot")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"), shards=16)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
