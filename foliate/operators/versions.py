"""Versions of a table in a folder, replacements that say what they remove, and keyed upserts.

A version is committed in two steps: its rows are written to a place named after their content, then a log entry of its number names that
place.  A task or a job that is repeated writes the same place again, a log number exists once, and rows that no entry names are not read;
so a commit either happened or did not, and the same content twice in a row is one version.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "number int, place string, rows long, content string, label string"


class Shrinks(ValueError):
    """A replacement that has fewer rows than what is stored."""


def content_hash(rows: DataFrame) -> tuple[int, str]:
    """Rows and a hash of them whatever their order: two sums of each row's hashes, so a repeated row counts."""
    columns = [F.coalesce(F.to_json(F.struct(F.col(c))), F.lit("")) for c in sorted(rows.columns)]
    whole = F.concat_ws("\x1f", *columns)
    sums = [F.sum(F.xxhash64(F.lit(k), whole).cast("decimal(38,0)")) for k in (1, 2)]
    n, a, b = rows.agg(F.count(F.lit(1)), *[F.coalesce(s, F.lit(0)) for s in sums]).first()
    return n, f"{int(a) % 2**64:016x}{int(b) % 2**64:016x}"


def history(spark: SparkSession, folder: str) -> DataFrame:
    """The log: number (from 1), place, rows, content and label of every version."""
    try:
        spark.read.parquet(f"{folder}/log")
    except AnalysisException:  # nothing was committed so far
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(f"{folder}/log")


def latest(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows of the last version."""
    last = history(spark, folder).orderBy(F.desc("number")).first()
    return None if last is None else spark.read.parquet(f"{folder}/{last['place']}")


def commit(rows: DataFrame, folder: str, label: str = "apply") -> int:
    """Commit ``rows`` as a version and return its number; content that the last version has already adds none."""
    spark = rows.sparkSession
    last = history(spark, folder).orderBy(F.desc("number")).first()
    n, content = content_hash(rows)
    if last is not None and last["content"] == content and last["rows"] == n:
        return last["number"]
    place, number = f"rows/{content}", 1 if last is None else last["number"] + 1
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{place}")
    entry = spark.createDataFrame([(number, place, n, content, label)], LOG).coalesce(1)
    entry.write.mode("error").parquet(f"{folder}/log/entry={number}")  # the one who comes second fails here
    return number


def replace_plan(stored: DataFrame, declared: DataFrame, key: list[str], value: str) -> DataFrame:
    """What putting ``declared`` in place of ``stored`` does, a row per key: ``added``, ``changed`` or ``removed``; what stays has none.  Keys are unique on each side."""
    a = stored.select(*key, F.col(value).alias("__old"), F.lit(True).alias("__stored"))
    b = declared.select(*key, F.col(value).alias("__new"), F.lit(True).alias("__declared"))
    both = a.join(b, key, "full")
    what = F.when(F.col("__stored").isNull(), "added").when(F.col("__declared").isNull(), "removed").when(~F.col("__old").eqNullSafe(F.col("__new")), "changed")
    return both.select(*key, what.alias("what")).filter("what IS NOT NULL")


def replace(rows: DataFrame, folder: str, key: list[str], value: str, confirm_shrink: bool = False, label: str = "replace") -> DataFrame:
    """Commit ``rows`` in place of the last version and return the plan.  Fewer rows than stored are refused unless the caller confirms it, and
    then nothing is written."""
    stored = latest(rows.sparkSession, folder)
    if stored is None:
        commit(rows, folder, label)
        return replace_plan(rows.limit(0), rows, key, value)
    plan = replace_plan(stored, rows, key, value)
    if not confirm_shrink and rows.count() < stored.count():
        raise Shrinks(f"{plan.filter(F.col('what') == 'removed').count()} rows would be removed")
    commit(rows, folder, label)
    return plan


def upsert(stored: DataFrame, declared: DataFrame, bank: str, key: str, value: str) -> DataFrame:
    """Questions of a bank brought to what a file declares: ``bank``, ``key``, ``action`` and the value that the bank then has.

    Declared keys are ``updated`` (``same`` if equal) or ``created``, stored ones that the file lacks are ``left``: nothing is ever deleted.  All or
    none: where a row of the bank or of its file has no key, or the file has one twice, the bank is ``declined`` whole and stays as it is.
    """
    odd = F.count_if(F.col(key).isNull())
    old = stored.groupBy(bank).agg(odd.alias("__odd"))
    new = declared.groupBy(bank).agg((odd + F.count(key) - F.count_distinct(key)).alias("__odd"))
    declined = old.unionByName(new).filter("__odd > 0").select(bank).distinct()
    s = stored.select(bank, key, F.col(value).alias("__old"), F.lit(True).alias("__stored"))
    d = declared.select(bank, key, F.col(value).alias("__new"), F.lit(True).alias("__declared"))
    both = s.join(declined, bank, "left_anti").join(d.join(declined, bank, "left_anti"), [bank, key], "full")
    action = F.when(F.col("__declared").isNull(), "left").when(F.col("__stored").isNull(), "created").when(F.col("__old").eqNullSafe(F.col("__new")), "same").otherwise("updated")
    done = both.select(bank, key, action.alias("action"), F.when(F.col("__declared"), F.col("__new")).otherwise(F.col("__old")).alias(value))
    kept = s.join(declined, bank, "left_semi").select(bank, key, F.lit("declined").alias("action"), F.col("__old").alias(value))
    return done.unionByName(kept)
