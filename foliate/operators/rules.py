"""Rules over facts: a small condition language, compiled to columns, and a many-to-many match.

Facts are sparse wide rows, rules are small data.  Each rule is a conjunction of clauses ``fact -> condition``:
``> 5``, ``>= 5``, ``< 5``, ``<= 5`` compare numbers, ``~ word`` asks whether a text holds a word (any case), a bare
number asks for numeric equality and anything else for equality.  A fact that is absent meets no condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import small

FACTS_SCHEMA = "file_id string, fact string, value string"
RULES_SCHEMA = "rule_id string, fact string, condition string"
#: Parts in which a rule's files are ordered.
SALTS = 64


def meets(value: Column, condition: Column) -> Column:
    """Whether a fact's value (as text; null: absent) meets a condition."""
    op = F.regexp_extract(condition, r"^[ ]*(>=|<=|>|<|~)", 1)
    rest = F.btrim(F.regexp_replace(condition, r"^[ ]*(>=|<=|>|<|~)", ""))
    a, b = F.expr("1.0D") * value.try_cast("double"), rest.try_cast("double")
    found = (
        F.when(op == ">=", a >= b)
        .when(op == "<=", a <= b)
        .when(op == ">", a > b)
        .when(op == "<", a < b)
        .when(op == "~", F.contains(F.lower(value), F.lower(rest)))
        .when(rest.rlike(r"^-?[0-9]+$"), a == b)
        .otherwise(value == rest)
    )
    return F.coalesce(found, F.lit(False))


def long_facts(wide: DataFrame, key: str) -> DataFrame:
    """One row per file and fact; absent facts have no row."""
    facts = [c for c in wide.columns if c != key]
    pairs = F.array(*[F.struct(F.lit(c).alias("fact"), F.col(c).cast("string").alias("value")) for c in facts])
    return wide.select(F.col(key).cast("string").alias("file_id"), F.inline(pairs)).filter("value is not null")


def match(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """(file_id, rule_id): every rule all of whose clauses a file meets.

    Clauses meet facts on the fact's name, so nothing is compared that a rule does not name; rules are broadcast if they are
    few.  A clause is met if any row of its fact meets it, so repeated facts count once.
    """
    rules = rules.distinct()
    number = F.row_number().over(Window.partitionBy("rule_id").orderBy("fact", "condition"))  # a rule's clauses are few
    numbered = small(rules.withColumns({"clause": number, "clauses": F.count(F.lit(1)).over(Window.partitionBy("rule_id"))}))
    hit = facts.join(numbered, "fact").filter(meets(F.col("value"), F.col("condition")))
    met = hit.groupBy("file_id", "rule_id", "clauses").agg(F.size(F.collect_set("clause")).alias("met"))
    return met.filter("met = clauses").select("file_id", "rule_id")


def report(matches: DataFrame, rules: DataFrame, samples: int = 8) -> DataFrame:
    """Per rule: how many files it matches and the first of them; rules without a match too."""
    counts = matches.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_files"))
    short = matches.select("rule_id", F.col("file_id").alias("id")).filter("id IS NOT NULL").distinct()
    first = short.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    for by in (["rule_id", "salt"], ["rule_id"]):  # so that no task orders all files of a rule
        first = first.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).filter(F.col("place") <= samples)
    listed = F.array_join(F.array_sort(F.collect_list("id")), ",")
    found = counts.join(first.groupBy("rule_id").agg(listed.alias("samples")), "rule_id", "left")
    every = rules.select("rule_id").distinct()
    return every.join(found, "rule_id", "left").select(
        "rule_id", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("samples", F.lit("")).alias("samples")
    )
