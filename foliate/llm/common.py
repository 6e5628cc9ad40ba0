"""What the operators of this subpackage share: the shared folder, materialised tables, distributed offsets."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The white space of every word definition here: space and the code points 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"

#: Rows of a few numbers up to which a counted table is broadcast (some tens of MB); beyond it the join shuffles.
BROADCAST_ROWS = 500_000


#: Bytes on disk up to which a table is dealt to all cores when it is read: about one row group, which is one task however many
#: cores are free.  A larger table is read as it lies.
DEALT_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; one of at most ``DEALT_BYTES`` is dealt to the cores, 256 KB or more to each."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = min(spark.sparkContext.defaultParallelism, 1 + (size >> 18))
    return found.repartition(parts) if 1 < parts and size <= DEALT_BYTES and found.rdd.getNumPartitions() < parts else found


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Set here only where the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="foliate-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there and any executor can read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_missing(df: DataFrame, **types: str) -> DataFrame:
    """Add null columns for those in ``types`` that ``df`` lacks."""
    have = set(df.columns)
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in have})


def documents(df: DataFrame, carry: bool = False) -> DataFrame:
    """The two columns that most operators read, so that other columns never reach a scan; with ``carry`` also the
    whole row as ``__row``, whatever its columns are called."""
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    return df.select(*columns, *[F.struct("*").alias("__row")] * carry)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name an array for use in several places of one expression, computed once."""
    return F.transform(F.array(value), body)[0]


def kept_rows(judged: DataFrame, verdict: Column) -> DataFrame:
    """The whole rows (``__row``) of ``judged`` that meet ``verdict``.

    The verdict goes through a generator, as a filter on it would be pushed down into the scan's projection and compute
    what it is made of again for each place that names it.
    """
    return judged.select("__row", F.explode(F.array(verdict)).alias("__verdict")).filter("__verdict").select("__row.*")


def without(df: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``df`` whose doc_id is not in ``gone`` (a counted set is broadcast, a larger one shuffled)."""
    gone = materialise(gone.select(F.col("doc_id").alias("__id")).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return documents(df, carry=True).join(gone, F.col("doc_id") == F.col("__id"), "left_anti").select("__row.*")


#: Keys that may be hot at once: what is broadcast for them is bounded by it at any size of the input.
HOT_KEYS = 100_000
#: Salted keys that a hot key's rows are dealt to.
SALTS = 1 << 20


def hot_from(rows: int) -> int:
    """The rows from which a key is hot: a share of all rows such that at most ``HOT_KEYS`` keys have as many."""
    return max(256, -(-rows // HOT_KEYS))


def lookup(rows: DataFrame, table: DataFrame, key: str, size: str, total: int, spread: Column) -> DataFrame:
    """Left join of ``rows`` to ``table``, which has one row per ``key``; ``size`` says how many of the ``total`` rows have it.

    Rows of hot keys meet a broadcast table of at most ``HOT_KEYS`` rows and go on under salted keys, by ``spread``, so
    that no task gets them all; the others are shuffled.
    """
    least, values = hot_from(total), [c for c in table.columns if c not in (key, size)]
    if total < least:  # no key can be hot
        return rows.join(table.drop(size), key, "left").select(*rows.columns, *values)
    table = table.withColumn("__hot", F.col(size) >= least)
    hot = table.filter("__hot").select(F.col(key).alias("__k"), *[F.col(v).alias(f"__h_{v}") for v in values], F.lit(True).alias("__found"))
    wide = rows.join(F.broadcast(hot), F.col(key) == F.col("__k"), "left").drop("__k")
    salted = F.when(F.col("__found"), 1 + F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0)
    cold = table.select(
        F.col(key).alias("__k"), *[F.col(v).alias(f"__c_{v}") for v in values], F.when(F.col("__hot"), -1).otherwise(0).cast("long").alias("__t")
    )
    both = wide.withColumn("__s", salted.cast("long")).join(cold, (F.col(key) == F.col("__k")) & (F.col("__s") == F.col("__t")), "left")
    return both.select(*rows.columns, *[F.coalesce(f"__h_{v}", f"__c_{v}").alias(v) for v in values])


def n_chunks(rows: int, per_chunk: int = 4096, least: int = 1024) -> int:
    """Chunks for :func:`running_offset`: small ones for small tables, so no chunk holds a hot key's rows alone."""
    return max(least, math.ceil(rows / per_chunk))


def running_offset(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk_by: Column, value: Column, out: str, chunks: int
) -> DataFrame:
    """Exclusive running sum of ``value`` over all rows of the same ``keys``, gapless and without one task per key.

    Rows of a key are dealt to ``chunks`` by the hash ``chunk_by``.  Chunk sums (one row per key and chunk,
    combined before the shuffle) get their own running sum, and each chunk is then numbered by itself.
    """
    df = df.withColumns({"__chunk": F.pmod(F.xxhash64(chunk_by), F.lit(chunks)).cast("int"), "__value": value.cast("long")})
    sums = df.groupBy(*keys, "__chunk").agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__chunk").alias("__c"), "__base")
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col("__chunk") == F.col("__c")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return (
        df.join(sums, on, "left")
        .withColumn(out, (F.col("__base") + F.coalesce(F.sum("__value").over(inside), F.lit(0))).cast("long"))
        .drop("__chunk", "__value", "__base", "__c", *[f"__k_{k}" for k in keys])
    )


#: Characters of text that a worker handles at once.
BLOCK_CHARS = 2_000_000


def blocks(texts: list[str], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` characters, or of a single longer one."""
    at = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, k
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that a worker makes Python objects of few rows at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
