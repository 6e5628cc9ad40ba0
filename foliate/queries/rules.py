"""Queries of the rule engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules as R
from ..session import table
from . import query

#: A small registry, as SQL rows (rule, fact, condition).
RULES = """(VALUES ('long', 'chars', '> 5000'), ('short_en', 'chars', '<= 500'), ('short_en', 'lang', 'en'),
  ('maths', 'dollars', '>= 2'), ('maths', 'lines', '> 1'), ('table', 'bars', '> 10'), ('one_line', 'lines', '1'),
  ('source_1x', 'source', '~ RC1'), ('odd', 'rare', '< 10'), ('never', 'lang', 'xx')) AS r(rule_id, fact, condition)"""

FACTS = """facts AS (
  SELECT doc_id::VARCHAR AS file_id, unnest(['chars', 'lang', 'dollars', 'lines', 'bars', 'source', 'rare']) AS fact,
    unnest([length(text)::VARCHAR, lang, (length(text) - length(replace(text, '$', '')))::VARCHAR,
      (length(text) - length(replace(text, chr(10), '')) + 1)::VARCHAR,
      (length(text) - length(replace(text, '|', '')))::VARCHAR, source,
      CASE WHEN doc_id % 50 = 0 THEN (doc_id % 20)::VARCHAR END]) AS value
  FROM documents
), known AS (SELECT * FROM facts WHERE value IS NOT NULL)"""

MATCHES = f"""WITH {FACTS}, rules AS (SELECT * FROM {RULES}), c AS (
  SELECT file_id, rule_id, value, condition, regexp_extract(condition, '^(>=|<=|>|<|~)', 1) AS op,
    trim(regexp_replace(condition, '^(>=|<=|>|<|~)', '')) AS rest FROM known JOIN rules USING (fact)
), ok AS (
  SELECT file_id, rule_id, coalesce(CASE op WHEN '>=' THEN try_cast(value AS DOUBLE) >= try_cast(rest AS DOUBLE)
    WHEN '<=' THEN try_cast(value AS DOUBLE) <= try_cast(rest AS DOUBLE) WHEN '>' THEN try_cast(value AS DOUBLE) > try_cast(rest AS DOUBLE)
    WHEN '<' THEN try_cast(value AS DOUBLE) < try_cast(rest AS DOUBLE) WHEN '~' THEN contains(lower(value), lower(rest))
    ELSE CASE WHEN regexp_matches(rest, '^-?[0-9]+$') THEN try_cast(value AS DOUBLE) = try_cast(rest AS DOUBLE) ELSE value = rest END END, false) AS ok FROM c
), m AS (
  SELECT file_id, rule_id FROM ok JOIN (SELECT rule_id, count(*) AS clauses FROM rules GROUP BY rule_id) USING (rule_id)
  GROUP BY file_id, rule_id, clauses HAVING count(*) FILTER (ok) = clauses
)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    count = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))
    wide = d.select(
        F.col("doc_id").alias("id"),
        F.length("text").alias("chars"),
        "lang",
        count("$").alias("dollars"),
        (count("\n") + 1).alias("lines"),
        count("|").alias("bars"),
        "source",
        F.when(F.col("doc_id") % 50 == 0, F.col("doc_id") % 20).alias("rare"),
    )
    return R.long_facts(wide, "id")


def rules(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {RULES}")


@query(f"{MATCHES} SELECT file_id, rule_id FROM m")
def rule_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that a document meets."""
    return R.match(facts(spark, sf_dir), rules(spark))


@query(
    f"""{MATCHES} SELECT rule_id, count(file_id)::BIGINT AS n_files,
  coalesce(array_to_string(list_slice(list_sort(list(file_id) FILTER (file_id IS NOT NULL)), 1, 8), ','), '') AS samples
FROM (SELECT DISTINCT rule_id FROM rules) LEFT JOIN m USING (rule_id) GROUP BY ALL"""
)
def rule_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per rule with samples; rules without a match too."""
    return R.report(R.match(facts(spark, sf_dir), rules(spark)), rules(spark))
