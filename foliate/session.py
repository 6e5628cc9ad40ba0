"""Session and table access."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings that suit any size: runtime re-planning, skew handling, UTC.
CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session for local use; on a cluster pass the running one instead."""
    builder = SparkSession.builder.master(master).appName("foliate")
    for k, v in {**CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


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
    """The folder that driver and executors share; set here only for a local session that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="foliate-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
