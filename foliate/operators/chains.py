"""Chains of starts: each row knows which row would begin next if it began itself, and only those count that are reached from
the first one.

Greedy batches and sessions that are anchored at their first row are of this kind.  Both look like a fold, as a start depends on
the one before; but the pointers don't, and following all of them two, four, eight steps at once takes as many rounds as the
longest chain has binary digits, each of them a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def _same(by: list[str], left: str, right: str) -> Column:
    """Equal groups, null ones too, and a pointer that meets its place."""
    on = F.col(left) == F.col(right)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return on


def next_beyond(rows: DataFrame, by: list[str], at: str, reach: Column, out: str) -> DataFrame:
    """``out``: the smallest ``at`` of the group that is greater than ``reach``, which does not fall as ``at`` rises.

    Places and what they ask for are merged into one sorted sequence, in which a frame that grows from the end holds the
    answer: no pairs are made.  A group is sorted by one task.
    """
    points = rows.select(*by, F.col(at).alias("__v"), F.lit(1).alias("__kind"), F.col(at).alias("__at")).distinct()
    asked = rows.select(*by, reach.alias("__v"), F.lit(0).alias("__kind"), F.col(at).alias("__at")).distinct()
    above = Window.partitionBy(*by).orderBy(F.desc("__v"), "__kind").rowsBetween(Window.unboundedPreceding, -1)
    found = points.unionByName(asked).withColumn(out, F.last(F.when(F.col("__kind") == 1, F.col("__v")), True).over(above))
    return found.filter("__kind = 0").select(*by, F.col("__at").alias(at), out)


def reached(nodes: DataFrame, by: list[str], at: str, follows: str) -> DataFrame:
    """The nodes of each group that its first one (smallest ``at``) reaches by the pointers ``follows``, which are null or lead to a greater
    ``at``.  ``nodes`` has one row for each place."""
    rows = nodes.select(*by, at, F.col(follows).alias("__to"))
    firsts = rows.groupBy(*by).agg(F.min(at).alias("__first")).select(*[F.col(c).alias(f"__{c}") for c in by], "__first")
    rows = cut(rows.join(firsts, _same(by, at, "__first"), "left").select(*by, at, "__to", F.col("__first").isNotNull().alias("__on")))
    while not rows.filter("__on AND __to IS NOT NULL").isEmpty():
        names = [F.col(c).alias(f"__{c}") for c in by]
        further = rows.select(*names, F.col(at).alias("__p"), F.col("__to").alias("__then"))
        # what a reached node points to is reached; these nodes lie on one path, so each has a target of its own
        new = rows.filter("__on AND __to IS NOT NULL").select(*names, F.col("__to").alias("__hit"))
        stepped = rows.join(further, _same(by, "__to", "__p"), "left").select(*by, at, F.col("__then").alias("__to"), "__on")
        rows = cut(stepped.join(new, _same(by, at, "__hit"), "left").select(*by, at, "__to", (F.col("__on") | F.col("__hit").isNotNull()).alias("__on")))
    return rows.filter("__on").select(*by, at)


def running(rows: DataFrame, by: list[str], order: list[str], **values: Column) -> DataFrame:
    """Running sums of ``values`` over each group in ``order``, own row included, without one task for a group.

    Rows are dealt by ranges of group and order; each range has its sums, these get running sums of their own (a row for each group and
    range), and within a range a window does the rest.
    """
    spark = rows.sparkSession
    sums = {f"__v{k}": v.cast("long") for k, v in enumerate(values.values())}
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    dealt = rows.withColumns(sums).repartitionByRange(parts, *by, *order)
    dealt = cut(dealt.withColumn("__range", F.spark_partition_id()))
    per = dealt.groupBy(*by, "__range").agg(*[F.sum(v).alias(v) for v in sums])
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__range").alias("__r"), *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"__b{v}") for v in sums])
    here = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = dealt.join(base, _same(by, "__range", "__r"))
    return joined.select(*rows.columns, *[(F.col(f"__b{v}") + F.sum(v).over(here)).alias(name) for v, name in zip(sums, values, strict=True)])


def _pointers(ends: np.ndarray, sizes: np.ndarray, most_bytes: int, most: int) -> np.ndarray:
    """Which entry begins the next batch if one begins here, for each of some entries in a row."""
    here = np.arange(len(ends))
    return np.clip(np.searchsorted(ends, ends - sizes + most_bytes, "right"), here + 1, here + most)


def greedy_batches(entries: DataFrame, by: str, order: str, size: str, most_bytes: int, most: int, block: int = 8192) -> DataFrame:
    """Greedy batches in order: a batch ends before the entry that would take it over its bytes or its count; an entry larger than a
    batch is one by itself.  ``entries`` has distinct ``order`` within a group; a null size is 0, none is negative.  Returns ``by``, ``order``, ``batch``.

    An entry's pointer leads at most ``most`` entries on, so the chain enters each block of a queue at one of its first ``most`` entries.  Where it
    leaves the block from each of these is found within the block; of these alone the chain is followed, and then each block is numbered from its entry.
    """
    block = max(block, most)
    rows = entries.select(by, F.col(order).cast("long").alias(order), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("__size"))
    rows = running(rows, [by], [order], __n=F.lit(1), __end=F.col("__size"))
    own = F.floor((F.col("__n") - 1) / block)
    halo = (F.pmod(F.col("__n") - 1, F.lit(block)) < most) & (own > 0)
    blocks = cut(rows.select("*", own.alias("__own"), F.explode(F.when(halo, F.array(own, own - 1)).otherwise(F.array(own))).alias("__block")))
    kind = blocks.schema[by].dataType.simpleString()

    def opened(t: pa.Table) -> tuple[pa.Table, np.ndarray, int]:
        """A block's rows in order, their pointers, and how many are its own; the rest is of the next one."""
        t = t.sort_by("__n")
        return t, _pointers(t["__end"].to_numpy(), t["__size"].to_numpy(), most_bytes, most), min(block, t.num_rows)

    def exits(t: pa.Table) -> pa.Table:
        t, to, n = opened(t)
        out, steps = [0] * n, to.tolist()
        for k in range(n - 1, -1, -1):
            out[k] = steps[k] if steps[k] >= n else out[steps[k]]
        first, count = t["__n"][0].as_py(), min(most, n)
        beyond = [first + x if x < t.num_rows else None for x in out[:count]]
        return pa.table({by: t[by][:count], "__n": t["__n"][:count], "__to": pa.array(beyond, pa.int64())})

    def numbered(t: pa.Table) -> pa.Table:
        t, to, n = opened(t)
        entry, first, steps = t["__entry"][0].as_py(), t["__n"][0].as_py(), to.tolist()
        starts, k = np.zeros(n, np.int64), n if entry is None else entry - first
        while k < n:
            starts[k], k = 1, steps[k]
        return pa.table({by: t[by][:n], order: t[order][:n], "__block": t["__block"][:n], "__local": pa.array(np.cumsum(starts))})

    steps = blocks.groupBy(by, "__block").applyInArrow(exits, f"`{by}` {kind}, __n long, __to long")
    entered = reached(steps, [by], "__n", "__to").select(F.col(by).alias(f"__{by}"), F.floor((F.col("__n") - 1) / block).alias("__at"), F.col("__n").alias("__entry"))
    # a short last block may be passed over; of any other the chain's first entry counts
    entered = entered.groupBy(f"__{by}", "__at").agg(F.min("__entry").alias("__entry"))
    met = blocks.join(entered, _same([by], "__block", "__at"), "left").select(by, order, "__n", "__end", "__size", "__block", "__entry")
    local = cut(met.groupBy(by, "__block").applyInArrow(numbered, f"`{by}` {kind}, `{order}` long, __block long, __local long"))
    before = Window.partitionBy(by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    per = local.groupBy(by, "__block").agg(F.max("__local").alias("__starts"))
    base = per.select(F.col(by).alias(f"__{by}"), F.col("__block").alias("__at"), F.coalesce(F.sum("__starts").over(before), F.lit(0)).alias("__base"))
    return local.join(base, _same([by], "__block", "__at")).select(by, order, (F.col("__base") + F.col("__local") - 1).cast("int").alias("batch"))
