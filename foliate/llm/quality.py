"""Quality rules: one table of thresholds, compiled into one Spark projection.

Every measure is a built-in expression over the text of the row, so scoring a table is one scan without a shuffle
and without user functions.

Defined results: a null text is an empty one (no words, base_failed); repeated rows and ties are judged alike, each
row by itself; an empty table gives an empty result; columns of the input other than doc_id and text are ignored by
:func:`measures` and kept as they are by :func:`keep`.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, documents, kept_rows, let, table

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the four languages (fixed values, natural order).
STOP_WORDS = (
    "the be to of and that have with is it in for a on as at by this was or an from are not "
    "der die das und ist nicht ein eine mit von zu den auf für im es sich auch dem des "
    "le la les de des du un une et est que qui dans pour sur par en au aux pas "
    "el los las del y en con por para una se no lo su al como más"
).split()

STOP_PATTERN = (
    r"(?i)(?<![^\x20\x09-\x0D])(?:" + "|".join(dict.fromkeys(STOP_WORDS)) + r")(?=[.,;:!?]*(?:[\x20\x09-\x0D]|\z))"
)


class Rule(NamedTuple):
    """A row of the threshold table: ``measure`` must lie between ``least`` and ``most`` (None: no bound)
    where the text has at least ``min_words`` words."""

    name: str
    measure: str
    least: float | None
    most: float | None
    min_words: int


#: The threshold table in production.
RULES = (
    Rule("mean_word_length", "mean_word_length", 1.5, 30.0, 20),
    Rule("symbol_ratio", "symbol_ratio", None, 0.10, 20),
    Rule("bar_word_ratio", "bar_word_ratio", None, 0.20, 20),
    Rule("shout_ratio", "shout_ratio", None, 0.20, 20),
    Rule("dup_line_ratio", "dup_line_ratio", None, 0.60, 20),
    Rule("stop_word_ratio", "stop_word_ratio", 0.01, None, 50),
    Rule("distinct_word_ratio", "distinct_word_ratio", 0.10, None, 40),
)

#: Words in the windows whose repetition is counted.
WINDOW = 8


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _joined(hashes: Column, by: int) -> Column:
    """Each hash with the one ``by`` places on."""
    return let(
        hashes,
        lambda h: F.zip_with(
            h, F.slice(h, by + 1, F.greatest(F.size(h) - by, F.lit(0))), lambda a, b: F.xxhash64(a, b)
        ),
    )


def _window_hashes(words: Column, window: int) -> Column:
    """64-bit hashes of all runs of ``window`` words, by doubling: each zip joins neighbouring runs of one length."""
    hashes, length = F.transform(words, lambda w: F.xxhash64(w)), 1
    while length < window:
        hashes, length = _joined(hashes, length), 2 * length
    return F.slice(hashes, F.lit(1), F.size(words) - (window - 1))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words which the text holds twice or more, the first one included.

    ``window`` is a power of two.  Texts whose windows all differ end after that comparison; the others sort
    (hash, position), keep the positions whose neighbour has the same hash, and add up what these windows cover.
    """

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(pairs, lambda p: _cover(p, window))

    return F.when(F.size(words) <= window, F.lit(0)).otherwise(
        let(
            _window_hashes(words, window),
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)),
        )
    )


def _cover(pairs: Column, window: int) -> Column:
    same = F.filter(
        F.transform(
            pairs,
            lambda p, k: F.when(
                (F.get(pairs, k - 1)["h"] == p["h"]) | (F.get(pairs, k + 1)["h"] == p["h"]), p["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    return let(
        F.array_sort(same),
        lambda at: F.aggregate(
            at,
            F.struct(F.lit(0).alias("n"), F.lit(-window).alias("prev")),
            lambda acc, i: F.struct(
                (acc["n"] + F.least(F.lit(window), i - acc["prev"])).alias("n"), i.alias("prev")
            ),
            lambda acc: acc["n"],
        ),
    )


def measures(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id and every measure that the rules name, from one projection of the whole text."""
    row = ["__row"] * carry
    d = documents(docs, carry).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *row)
    d = d.withColumn("words", _words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "doc_id",
        *row,
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        let(
            lines,
            lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")),
        ).alias("lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: (w == "|") | (w == "||"))).alias("bar_words"),
        F.size(F.filter("words", lambda w: w.endswith("!!"))).alias("shout_words"),
        F.size(F.array_distinct("words")).alias("distinct_words"),
        F.regexp_count("text", F.lit(STOP_PATTERN)).alias("stop_words"),
    )
    n = F.col("n_words")
    return d.select(
        "doc_id",
        *row,
        n.cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.col("lines.dup").cast("long").alias("n_dup_lines"),
        F.col("n_repeat_words").cast("long").alias("n_repeat_words"),
        _ratio(F.col("word_chars"), n).alias("mean_word_length"),
        _ratio(F.col("n_symbols"), F.col("word_chars")).alias("symbol_ratio"),
        _ratio(F.col("bar_words"), n).alias("bar_word_ratio"),
        _ratio(F.col("shout_words"), n).alias("shout_ratio"),
        _ratio(F.col("lines.dup"), F.col("lines.n")).alias("dup_line_ratio"),
        _ratio(F.col("stop_words"), n).alias("stop_word_ratio"),
        _ratio(F.col("distinct_words"), n).alias("distinct_word_ratio"),
    )


def base_failed() -> Column:
    """Fewer than 20 words, or over 30 % of the words in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def verdict(rules: Sequence[Rule] = RULES) -> Column:
    """The threshold table as one boolean expression over :func:`measures`."""
    ok = F.lit(True)
    for r in rules:
        inside = F.lit(True)
        if r.least is not None:
            inside = inside & (F.col(r.measure) >= r.least)
        if r.most is not None:
            inside = inside & (F.col(r.measure) <= r.most)
        ok = ok & ((F.col("n_words") < r.min_words) | inside)
    return ok


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, carry: bool = False) -> DataFrame:
    """Per document: the measures, ``base_failed`` and ``kept``."""
    m = measures(docs, carry).withColumn("base_failed", base_failed())
    return m.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents that the rules keep; all columns stay."""
    return kept_rows(judge(docs, rules, carry=True), F.col("kept"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql_verdict(rules: Sequence[Rule]) -> str:
    def bound(r: Rule) -> str:
        least = [f"{r.measure} >= {r.least}"] if r.least is not None else []
        return " AND ".join([*least, *([f"{r.measure} <= {r.most}"] if r.most is not None else [])]) or "true"

    return " AND ".join(f"(n_words < {r.min_words} OR ({bound(r)}))" for r in rules)


#: The query in DuckDB SQL.  Windows are compared as text; words are tested one by one where Spark's pattern looks
#: around itself.
SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW} + 2)) AS i FROM w)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
covered AS (SELECT rid, sum(least({WINDOW}, i - prev)) AS n FROM
  (SELECT rid, i, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -{WINDOW}) AS prev FROM again) GROUP BY rid),
m AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
  length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols, len(lines) AS n_lines,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  len(list_filter(words, lambda x: x IN ('|', '||'))) AS bars, len(list_filter(words, lambda x: ends_with(x, '!!'))) AS shouts,
  len(list_distinct(words)) AS distinct_words,
  len(list_filter(words, lambda x: regexp_full_match(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '(?:{"|".join(dict.fromkeys(STOP_WORDS))})[.,;:!?]*'))) AS stops
  FROM w LEFT JOIN covered c USING (rid)),
r AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_length,
  CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_ratio,
  CASE WHEN n_words > 0 THEN bars / n_words ELSE 0 END AS bar_word_ratio,
  CASE WHEN n_words > 0 THEN shouts / n_words ELSE 0 END AS shout_ratio,
  CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
  CASE WHEN n_words > 0 THEN stops / n_words ELSE 0 END AS stop_word_ratio,
  CASE WHEN n_words > 0 THEN distinct_words / n_words ELSE 0 END AS distinct_word_ratio,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND {_sql_verdict(RULES)} AS kept FROM r"""
