"""Derived inputs, built by the same rule in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lines import explode_lines
from ..session import table


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, pos, text) of all documents."""
    return explode_lines(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "lang")


LINES = """lines AS (
  SELECT doc_id, lang, unnest(range(len(l)))::INT AS pos, unnest(l) AS text
  FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents)
)"""

def line_words(c: str | Column) -> Column:
    """The words of a line in ASCII letters, one space between them; ``none`` without any.  Letters are one class, which is the cheapest to test."""
    words = F.btrim(F.regexp_replace(F.regexp_replace(c, r"[^\p{Alpha} ]+", ""), " +", " "))
    return F.regexp_replace(words, "^$", "none")


def words_of_lines(c: str | Column) -> Column:
    """:func:`line_words` of each line of a text; patterns meet the whole text, which costs about half as much."""
    words = F.regexp_replace(F.regexp_replace(c, r"[^\p{Alpha} \n]+", ""), " {2,}", " ")
    return F.transform(F.transform(F.split(words, "\n"), lambda w: F.btrim(w)), lambda w: F.when(w == "", "none").otherwise(w))


#: Prefix of a line by its position mod 7; every fifth line is blank instead.
PREFIX = {0: "# ", 1: "## ", 2: "- ", 3: "1. ", 4: "**Example**: ", 5: "| "}


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a Markdown prefix; those without one and of an even document are bold when they are short."""
    text, kind = F.col("text"), F.pmod(F.col("pos"), F.lit(7))
    out = text
    for k, p in PREFIX.items():
        tail = " | b |" if p == "| " else ""
        out = F.when(kind == k, F.concat(F.lit(p), text, F.lit(tail))).otherwise(out)
    bold = (kind == 6) & (F.col("doc_id") % 2 == 0)
    out = F.when(bold, F.concat(F.lit("**"), F.substring(text, 1, 20), F.lit("**"))).otherwise(out)
    return lines(spark, sf_dir).withColumn("text", F.when(F.pmod(F.col("pos"), F.lit(5)) == 4, "").otherwise(out))


MARKED = (
    LINES
    + """, marked AS (
  SELECT doc_id, lang, pos, CASE WHEN pos % 5 = 4 THEN ''
    WHEN pos % 7 = 6 AND doc_id % 2 = 0 THEN '**' || substring(text, 1, 20) || '**'
    """
    + "\n    ".join(
        f"WHEN pos % 7 = {k} THEN '{p}' || text" + (" || ' | b |'" if p == "| " else "") for k, p in PREFIX.items()
    )
    + """
    ELSE text END AS text
  FROM lines
)"""
)

CLASS = """CASE
    WHEN regexp_matches(text, '^[ \\t]*$') THEN 'blank'
    WHEN regexp_matches(text, '^#{1,6}[ \\t]+[^ \\t]') THEN 'heading'
    WHEN regexp_matches(text, '^[ \\t]*\\|') THEN 'table'
    WHEN regexp_matches(text, '^[ \\t]*\\$\\$') THEN 'display'
    WHEN regexp_matches(text, '^\\*\\*Step[ \\t]*[0-9]+[ \\t]*[:.)\\-–]?[ \\t]*[^*]*\\*\\*') THEN 'step'
    WHEN regexp_matches(text, '(?i)^\\*\\*Final Answer[^*]*\\*\\*[ \\t]*$') THEN 'answer'
    WHEN regexp_matches(text, '^[ \\t]*(?:[-*][ \\t]+)?\\*\\*(?:[^*]{1,24}\\bExamples?[ \\t]*:|Examples?)[^*]*\\*\\*') THEN 'example'
    WHEN regexp_matches(text, '^[ \\t]*[-*][ \\t]+\\*\\*[^*]+\\*\\*') THEN 'rule'
    WHEN regexp_matches(text, '^\\*\\*[^*]+\\*\\*:?[ \\t]*$') THEN 'bold'
    WHEN regexp_matches(text, '^[ \\t]*(?:[-*+]|[0-9]+[.)])[ \\t]+') THEN 'list'
    WHEN regexp_matches(text, '(?i)^[ \\t]*where\\b') THEN 'where'
    ELSE 'text' END"""

LEVEL = "nullif(length(regexp_extract(text, '^(#{1,6})[ \\t]+[^ \\t]', 1)), 0)"
HEADING = "trim(regexp_replace(text, '^#{1,6}[ \\t]+', ''), ' ')"

CLASSED = (
    MARKED
    + f""", classed AS (
  SELECT *, {CLASS} AS class, {LEVEL} AS level, {HEADING} AS heading,
    length(text) - length(ltrim(text, ' ')) AS indent FROM marked
)"""
)
