"""Queries of emphasis marks, around the words of every line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import emphasis as E
from . import query
from .fixtures import LINES, line_words, lines

WORDS = "coalesce(nullif(trim(regexp_replace(regexp_replace(text, '[^A-Za-z ]+', '', 'g'), ' +', ' ', 'g'), ' '), ''), 'none')"

#: Forms by the line's place, and what each becomes: space behind and before, a nested span, an empty one, marks of different kinds, none open.
MARKED = """CASE pos % 9 WHEN 0 THEN 'Our **' || w || ' **is' WHEN 1 THEN 'the** ' || w || ' **and the** ' || w || ' **of' WHEN 2 THEN '***' || w || '*** is' WHEN 3 THEN 'a ** ** b ' || w
  WHEN 4 THEN 'x *' || w || ' **y **z* v' WHEN 5 THEN 'as** *' || w || ' conformity*** (or' WHEN 6 THEN 'no ' || w WHEN 7 THEN '* ' || w || ' * *' || w ELSE 'a *** ' || w || '  *** b' END"""
REPAIRED = """CASE pos % 9 WHEN 0 THEN 'Our **' || w || '** is' WHEN 1 THEN 'the **' || w || '** and the **' || w || '** of' WHEN 2 THEN '***' || w || '*** is' WHEN 3 THEN 'a   b ' || w
  WHEN 4 THEN 'x *' || w || ' **y** z* v' WHEN 5 THEN 'as** *' || w || ' conformity ***(or' WHEN 6 THEN 'no ' || w WHEN 7 THEN ' *' || w || '*  *' || w ELSE 'a  ***' || w || '***   b' END"""
FLAGGED = """CASE pos % 6 WHEN 0 THEN '**🎯 ' || w || '**' WHEN 1 THEN '**📌 Try** ' || w WHEN 2 THEN '💡 ' || w WHEN 3 THEN ' ** ⚠️ ' || w || '** and **b**' WHEN 4 THEN w || ' 👉 x' ELSE '➡️' || w END"""
BARE = """CASE pos % 6 WHEN 0 THEN w WHEN 1 THEN '**Try** ' || w WHEN 2 THEN w WHEN 3 THEN '**' || w || '** and **b**' WHEN 4 THEN w || ' 👉 x' ELSE w END"""


def _worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), line_words("text").alias("w"))


def _sql(form: str) -> str:
    return f"WITH {LINES}, l AS (SELECT doc_id, pos::BIGINT AS pos, {WORDS} AS w FROM lines) SELECT doc_id, pos, {form} AS text FROM l"


@query(_sql(REPAIRED))
def emphasis_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with white space inside their spans, repaired; the SQL states what each form becomes."""
    return E.repaired(_worded(spark, sf_dir).select("doc_id", "pos", F.expr(MARKED).alias("text")), ["doc_id", "pos"])


@query(_sql(BARE))
def flag_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged lines without their signs."""
    return _worded(spark, sf_dir).select("doc_id", "pos", E.without_flag(F.expr(FLAGGED)).alias("text"))
