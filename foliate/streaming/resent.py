"""Documents that are sent again: a landing folder as a stream, each key's latest text as a table.

A sending that repeats another within the watermark is dropped by the stream's state.  The rest is upserted batch by batch: the table
lies in buckets of its keys' hash, a batch writes anew only the buckets that it touches, and an entry of its number in the log says where they
are.  A batch that runs again after a failure writes the same places and the same entry, so nothing is applied twice; and as the later
sending of a key wins whatever the order of the batches, the table equals that of one batch over all files.  Only what arrives
more than ``delay`` behind the latest sending is given up, as the stream's state must end somewhere.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LOG = "batch long, bucket int, place string"


def latest_by_key(sent: DataFrame, key: str = "doc_id") -> DataFrame:
    """The last sending of each key, ties by the greater text: what the table holds once all is read."""
    last = Window.partitionBy(key).orderBy(F.desc("sent"), F.desc_nulls_last("text"))
    return sent.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _log(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        spark.read.parquet(f"{folder}/log")
    except AnalysisException:  # no batch so far
        return None
    return spark.read.schema(LOG).parquet(f"{folder}/log")


def _places(spark: SparkSession, folder: str, before: int | None = None) -> dict[int, str]:
    """Where each bucket lies, by the last batch that wrote it: as many as there are buckets."""
    log = _log(spark, folder)
    if log is None:
        return {}
    log = log if before is None else log.filter(F.col("batch") < before)
    return {r["bucket"]: r["place"] for r in log.groupBy("bucket").agg(F.max_by("place", "batch").alias("place")).collect()}


def read_table(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The table as the last batch left it."""
    places = _places(spark, folder)
    if not places:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/{p}" for p in places.values()])


def _upsert(batch: DataFrame, number: int, folder: str, schema: str, key: str, buckets: int) -> None:
    spark = batch.sparkSession
    batch = batch.withColumn("__bucket", _bucket(key, buckets)).persist()
    try:
        touched = sorted(r[0] for r in batch.select("__bucket").distinct().collect())  # at most as many as buckets
        if not touched:
            return
        places = _places(spark, folder, before=number)
        old = [f"{folder}/{places[b]}" for b in touched if b in places]
        rows = batch.drop("__bucket")
        if old:
            rows = rows.unionByName(spark.read.schema(schema).parquet(*old))
        kept = latest_by_key(rows, key).withColumn("bucket", _bucket(key, buckets))
        kept.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{folder}/rows/batch={number}")
        entries = [(number, b, f"rows/batch={number}/bucket={b}") for b in touched]
        spark.createDataFrame(entries, LOG).coalesce(1).write.mode("overwrite").parquet(f"{folder}/log/n={number}")
    finally:
        batch.unpersist()


def ingest(
    spark: SparkSession, landing: str, folder: str, schema: str = "doc_id long, text string, sent timestamp", key: str = "doc_id",
    delay: str = "30 days", buckets: int = 64, files_a_batch: int = 1000,
) -> StreamingQuery:
    """Read what lies in ``landing`` (Parquet of ``schema``) and stop; started again with the same ``folder`` it goes on with new files."""
    sent = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(landing)
    once = sent.withWatermark("sent", delay).withColumn("__text", F.sha2(F.col("text").cast("binary"), 256)).dropDuplicatesWithinWatermark([key, "__text", "sent"]).drop("__text")
    writer = once.writeStream.foreachBatch(lambda batch, number: _upsert(batch, number, folder, schema, key, buckets))
    return writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
