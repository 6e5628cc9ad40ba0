"""Queries over maths in text.  Spans, and what only looks like one, are put in by the same rule on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import maths as M
from ..functions import text as T
from ..operators import dashes as D
from ..session import table
from . import query
from .fixtures import line_words, lines

#: What stands for which words: spans, an escaped dollar, code, two prices, and a span that a digit follows.
PUT = (
    (" the ", " $x_1 + y$ "),
    (", ", " $$a = b$$ "),
    (" of ", " $5 and $6 "),
    (" in ", " $cost \\$4$ "),
    (". ", " `code $z$` "),
    (" to ", " $q$2 "),
)


def _put(text):
    text = F.replace(text, F.lit("$"), F.lit(""))
    for words, form in PUT:
        text = F.replace(text, F.lit(words), F.lit(form))
    return text


def _sql_put(c: str) -> str:
    c = f"replace({c}, '$', '')"
    for words, form in PUT:
        c = f"replace({c}, '{words}', '{form}')"
    return c


SPANS = f"""t AS (SELECT doc_id, {_sql_put("text")} AS t FROM documents),
s AS (SELECT doc_id, t, regexp_extract_all(t, '\\$\\$([\\s\\S]+?)\\$\\$', 1) AS display,
  regexp_extract_all(replace(replace(replace(t, '`code $z$`', '`code  z `'), '$$a = b$$', '         '), ' $q$2 ', ' '),
    '\\$((?:\\\\\\$|[^$\\n]){{0,398}}?(?:\\\\\\$|[^$\\s\\\\]))\\$', 1) AS inline FROM t)"""


@query(
    f"""WITH {SPANS} SELECT doc_id, len(display)::BIGINT AS n_display, len(inline)::BIGINT AS n_inline, md5(array_to_string(inline, '|')) AS inline,
  len(list_filter(list_concat(display, inline), lambda x: contains(x, '\\$') OR contains(x, chr(10))))::BIGINT AS n_fragile FROM s"""
)
def maths_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display and inline spans of every text, and how many do not survive being read back."""
    d = table(spark, sf_dir, "documents").select("doc_id", _put(F.col("text")).alias("t"))
    d = d.select("doc_id", M.display_spans("t").alias("display"), M.inline_spans("t").alias("inline"))
    n = lambda c: F.size(c).cast("long")
    return d.select(
        "doc_id", n("display").alias("n_display"), n("inline").alias("n_inline"), F.md5(F.array_join("inline", "|").cast("binary")).alias("inline"),
        n(F.filter(F.concat("display", "inline"), M.is_fragile)).alias("n_fragile"),
    )


@query(
    """WITH t AS (SELECT doc_id, replace(replace(text, ' the ', ' \\alpha '), ' of ', ' \\text{u v} ') AS t FROM documents),
m AS (SELECT doc_id, replace(replace(t, '\\text{u v}', chr(2)), '\\alpha ', chr(1)) AS m FROM t),
a AS (SELECT doc_id, regexp_replace(regexp_replace(m, '([A-Za-z]) ([A-Za-z])', '\\1\\\\ \\2', 'g'), '([A-Za-z]) ([A-Za-z])', '\\1\\\\ \\2', 'g') AS a FROM m),
b AS (SELECT doc_id, regexp_replace(regexp_replace(replace(a, chr(2) || ' ' || chr(2), chr(2) || '\\ ' || chr(2)), '([A-Za-z0-9]) ' || chr(2), '\\1\\\\ ' || chr(2), 'g'),
  chr(2) || ' ([A-Za-z0-9])', chr(2) || '\\\\ \\1', 'g') AS b FROM a)
SELECT doc_id, md5(replace(replace(b, chr(2), '\\text{u v}'), chr(1), '\\alpha ')) AS repaired FROM b"""
)
def maths_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spaces between words of a formula made drawn ones; commands and textual groups keep theirs."""
    t = F.replace(F.replace("text", F.lit(" the "), F.lit(" \\alpha ")), F.lit(" of "), F.lit(" \\text{u v} "))
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", F.md5(M.repair_spaces("t").cast("binary")).alias("repaired"))


@query(
    f"""WITH t AS (SELECT doc_id, {_sql_put("text")} AS t FROM documents),
u AS (SELECT doc_id, replace(replace(replace(replace(t, '$x_1 + y$', chr(1)), '$$a = b$$', chr(2)), '$cost \\$4$', chr(3)), '`code $z$`', chr(4)) AS u FROM t)
SELECT doc_id, md5(replace(replace(replace(replace(replace(replace(u, '$', '€'), 'e', 'E'), chr(1), '$x_1 + y$'), chr(2), '$$a = b$$'), chr(3), '$cost \\$4$'), chr(4), '`code $z$`')) AS masked FROM u"""
)
def prose_rules_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule that would spoil any formula, applied to the prose alone."""
    rule = lambda piece: F.replace(F.replace(piece, F.lit("$"), F.lit("€")), F.lit("e"), F.lit("E"))
    d = table(spark, sf_dir, "documents").select("doc_id", _put(F.col("text")).alias("t"))
    return d.select("doc_id", F.md5(M.in_prose("t", rule).cast("binary")).alias("masked"))


@query(
    """WITH p AS (SELECT p_partkey, p_name, p_type, '\\frac{' || p_name || '}{' || p_type || '} + \\text{' || p_brand || '} \\\\ ' || repeat('x', p_size) AS t FROM part)
SELECT p_partkey, greatest(greatest(length(p_name), length(p_type)) + 3 + length(regexp_extract(t, 'text\\{([^}]*)\\}', 1)), length(regexp_extract(t, 'x*$')))::BIGINT AS width FROM p"""
)
def formula_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn width of a fraction, a name and a second line."""
    t = F.concat(F.lit("\\frac{"), "p_name", F.lit("}{"), "p_type", F.lit("} + \\text{"), "p_brand", F.lit("} \\\\ "), F.repeat(F.lit("x"), F.col("p_size")))
    return table(spark, sf_dir, "part").select("p_partkey", M.drawn_width(t).cast("long").alias("width"))


@query(
    """WITH f AS (SELECT page_id, replace(replace(html, 'e', '&#101;'), 't', '&#x74;') AS h FROM pages) SELECT page_id, md5(replace(replace(h, '&#101;', 'e'), '&#x74;', 't') || 'é&#1114112;') AS decoded FROM f"""
)
def numeric_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal and hexadecimal references to characters; one beyond Unicode stays."""
    h = F.concat(F.replace(F.replace("html", F.lit("e"), F.lit("&#101;")), F.lit("t"), F.lit("&#x74;")), F.lit("&#xE9;&#1114112;"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.decode_numeric(h).cast("binary")).alias("decoded"))


#: Lone dashes before words and connectives, pairs, cells, several sentences, brackets and dashes in maths, around the words of each line.
DASHED = """CASE pos % 11 WHEN 0 THEN 'first — ' || w || ' second' WHEN 1 THEN 'first — because ' || w WHEN 2 THEN 'he — ' || w || ' — said' WHEN 3 THEN 'he — ' || w || ' — Said it'
  WHEN 4 THEN '| — | ' || w || ' |' WHEN 5 THEN 'note: one — ' || w WHEN 6 THEN 'so $a — b$ is (x: ' || w || ' — y)' WHEN 7 THEN 'end ' || w || ' , — and'
  WHEN 8 THEN 'one: ' || w || '. Two — ' || w || '! Three' WHEN 9 THEN 'see: (' || w || ' — y) and **' || w || ' — b** — z' ELSE 'p — q — ' || w || ' — r ((' END"""
FIRST_WORD = D.BEFORE_CONNECTIVE.replace("(?![A-Za-z0-9_])", "([^A-Za-z0-9_]|$)")
#: What each form becomes by the rule: a pair has 160 characters at most, and words that begin with a connective take a comma.
SETTLED = f"""CASE pos % 11 WHEN 0 THEN 'first' || sep || w || ' second' WHEN 1 THEN 'first, because ' || w
  WHEN 2 THEN CASE WHEN length(w) <= 160 THEN 'he (' || w || ') said' ELSE 'he' || sep || w || ': said' END
  WHEN 3 THEN CASE WHEN length(w) <= 160 THEN 'he (' || w || '), Said it' ELSE 'he' || sep || w || ': Said it' END
  WHEN 4 THEN '| – | ' || w || ' |' WHEN 5 THEN 'note: one, ' || w WHEN 6 THEN 'so $a — b$ is (x: ' || w || ', y)' WHEN 7 THEN 'end ' || w || ', and'
  WHEN 8 THEN 'one: ' || w || '. Two' || sep || w || '! Three' WHEN 9 THEN 'see: (' || w || ': y) and **' || w || ', b**, z'
  ELSE 'p (q)' || CASE WHEN regexp_matches(w, '^[A-Z]') THEN ', ' ELSE ' ' END || w || ': r ((' END"""
WORDS = "coalesce(nullif(trim(regexp_replace(regexp_replace(text, '[^A-Za-z ]+', '', 'g'), ' +', ' ', 'g'), ' '), ''), 'none')"


@query(
    f"""WITH d AS (SELECT doc_id, text FROM documents), l AS (SELECT doc_id, unnest(range(len(x)))::BIGINT AS pos, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM d)),
w AS (SELECT doc_id, pos, {WORDS} AS w FROM l), s AS (SELECT *, CASE WHEN regexp_matches(w, '{FIRST_WORD}') THEN ', ' ELSE ': ' END AS sep FROM w)
SELECT doc_id, pos, {SETTLED} AS settled FROM s"""
)
def dash_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines with dashes, settled; the SQL states what the rule makes of each form."""
    dashed = F.expr(f"transform(ws, w -> {DASHED})")[0]
    w = lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), F.array(line_words("text")).alias("ws"))
    w = w.select("doc_id", "pos", T.once(dashed, M.hold).alias("h"))
    settled = w.select("doc_id", "pos", D.settled("h.text").alias("text"), "h.inline", "h.display")
    return settled.select("doc_id", "pos", M.put_back("text", F.col("inline"), F.col("display")).alias("settled"))


@query(
    f"""WITH RECURSIVE t AS (SELECT doc_id, {_sql_put("text")} AS t FROM documents), m AS (
  SELECT doc_id, t, 0 AS n, 0 AS a, 0 AS size, NULL::VARCHAR AS hit FROM t
  UNION ALL SELECT doc_id, t, n + 1, p + a + size, length(h), h FROM (
    SELECT doc_id, t, n, a, size, regexp_extract(substring(t, a + size + 1), '\\$x_1 \\+ y\\$|\\$\\$a = b\\$\\$|\\$cost \\\\\\$4\\$', 0) AS h,
      instr(substring(t, a + size + 1), h) - 1 AS p FROM m) WHERE h <> '')
SELECT doc_id, n::INT AS n, starts_with(hit, '$$') AS display, a::INT AS start, (a + size)::INT AS "end", trim(hit, '$') AS tex FROM m WHERE n > 0"""
)
def span_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of every text with its place; in SQL the forms that are maths are sought one after another."""
    d = table(spark, sf_dir, "documents").select("doc_id", _put(F.col("text")).alias("text"))
    return M.spans(d, ["doc_id"])
