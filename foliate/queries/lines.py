"""Queries over ordered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import lines as L
from ..session import table
from . import query
from .fixtures import CLASS, CLASSED, LEVEL, LINES, marked
from .fixtures import lines as plain


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


@query(
    f"""WITH {CLASSED} SELECT lang, class, count(*)::BIGINT AS n_lines,
  sum(len(list_filter(string_split_regex(text, '[ \\t]+'), lambda w: w <> '')))::BIGINT AS n_words
FROM classed GROUP BY ALL"""
)
def line_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language and class of line: lines and words."""
    out = L.with_class(marked(spark, sf_dir)).groupBy("lang", "class")
    return out.agg(F.count(F.lit(1)).alias("n_lines"), F.sum("n_words").cast("long").alias("n_words"))


@query(
    f"""WITH {CLASSED}, heads AS (
  SELECT doc_id, pos, heading AS title, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt,
    row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS unit FROM classed WHERE level = 1
) SELECT h.doc_id, title, unit::BIGINT AS unit, pos::BIGINT AS first,
  coalesce(nxt - 1, (SELECT max(pos) FROM lines l WHERE l.doc_id = h.doc_id))::BIGINT AS last FROM heads h"""
)
def unit_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units: from a level-1 heading to the line before the next."""
    return longs(L.unit_ranges(marked(spark, sf_dir)), "unit", "first", "last")


@query(
    f"""WITH {CLASSED}, u AS (
  SELECT *, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS unit FROM classed
), s AS (
  SELECT doc_id, unit, coalesce(last_value(CASE WHEN level >= 2 THEN heading END IGNORE NULLS)
    OVER (PARTITION BY doc_id, unit ORDER BY pos), '(opening)') AS section FROM u
) SELECT doc_id, unit::BIGINT AS unit, section, count(*)::BIGINT AS n_lines FROM s GROUP BY ALL"""
)
def section_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per section; what stands before a unit's first sub-heading is its opening."""
    out = L.with_section(marked(spark, sf_dir)).groupBy("doc_id", "unit", "section").agg(F.count(F.lit(1)).alias("n_lines"))
    return longs(out, "unit")


@query(
    """SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn)::BIGINT AS occurrence,
  role || '#' || row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS key FROM conversations"""
)
def heading_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrence keys: here a role's n-th turn of a conversation."""
    c = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.col("role").alias("heading")
    )
    out = L.with_occurrence(c).select(
        F.col("doc_id").alias("conv_id"), F.col("pos").alias("turn"), F.col("heading").alias("role"), "occurrence", "key"
    )
    return longs(out, "occurrence")


@query(
    f"""WITH {CLASSED}, f AS (
  SELECT *, lead(level) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM classed WHERE class <> 'blank'
) SELECT doc_id, pos::BIGINT AS pos, level::BIGINT AS level, coalesce(nxt, 0) > level AS is_label
FROM f WHERE level IS NOT NULL"""
)
def heading_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(L.labels_of_sections(marked(spark, sf_dir)), "pos", "level")


@query(
    f"""WITH {CLASSED}, f AS (
  SELECT *, class = 'bold' OR coalesce(level, 0) >= 4 AS is_lead,
    class = 'text' OR (class = 'heading' AND coalesce(level, 0) < 4) AS ends FROM classed WHERE class <> 'blank'
), p AS (
  SELECT p.doc_id, p.pos, p.text, (SELECT max(e.pos) FROM f e WHERE e.doc_id = p.doc_id AND e.pos < p.pos AND e.ends) AS ended,
    (SELECT max(l.pos) FROM f l WHERE l.doc_id = p.doc_id AND l.pos < p.pos AND l.is_lead) AS led FROM f p WHERE class = 'text'
) SELECT p.doc_id, p.pos::BIGINT AS pos, CASE WHEN led > coalesce(ended, -1) THEN CASE WHEN l.class = 'bold' THEN replace(l.text, '*', '') ELSE l.heading END END AS lead, p.text
FROM p LEFT JOIN f l ON l.doc_id = p.doc_id AND l.pos = p.led"""
)
def lead_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads before their paragraphs.  A paragraph's lead is the last one since the last line that ends a wait."""
    return longs(L.join_leads(marked(spark, sf_dir)), "pos")


@query(
    f"""WITH {CLASSED}, f AS (
  SELECT *, sum(CASE WHEN class = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS number
  FROM classed WHERE class <> 'blank'
), s AS (
  SELECT doc_id, number, min(pos) AS pos, max(level) AS level, count(*) FILTER (class <> 'heading') AS filled
  FROM f WHERE number > 0 GROUP BY ALL
) SELECT doc_id, pos::BIGINT AS pos, level::BIGINT AS level, filled::BIGINT AS filled,
  filled > 0 OR coalesce(lead(level) OVER (PARTITION BY doc_id ORDER BY pos) > level, false) AS kept FROM s"""
)
def empty_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(L.empty_sections(marked(spark, sf_dir)), "pos", "level", "filled")


@query(
    f"""WITH {LINES}, t AS (
  SELECT doc_id, pos, CASE WHEN pos % 9 = 0 THEN '# ' || text WHEN (doc_id % 4 = 0 OR pos % 4 < 2) AND text <> '' THEN text || ' ' || pos ELSE text END AS text FROM lines
), c AS (SELECT *, {CLASS} AS class, {LEVEL} AS level FROM t), n AS (
  SELECT *, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS unit FROM c
) SELECT doc_id, unit::BIGINT AS unit, count(*)::BIGINT AS n_lines, count(*) FILTER (class = 'heading')::BIGINT AS n_headings,
  avg(CASE WHEN regexp_matches(text, '[^0-9][0-9]{{1,4}}[ \\t]*$') THEN 1 ELSE 0 END) AS share,
  count(*) >= 5 AND count(*) FILTER (class = 'heading') = 0
    AND avg(CASE WHEN regexp_matches(text, '[^0-9][0-9]{{1,4}}[ \\t]*$') THEN 1 ELSE 0 END) > 0.7 AS is_contents
FROM n WHERE class <> 'blank' AND coalesce(level, 0) <> 1 GROUP BY ALL"""
)
def contents_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents pages: units of plain lines, in every fourth document all of which end in their number."""
    return longs(L.contents_pages(_contents(spark, sf_dir)), "unit", "n_lines", "n_headings")


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heading every ninth line, plain lines between; three of four, or all in every fourth document, end in their number."""
    numbered = F.concat("text", F.lit(" "), F.col("pos").cast("string"))
    every = (F.col("doc_id") % 4 == 0) | (F.pmod(F.col("pos"), F.lit(4)) < 2)
    text = F.when(F.pmod(F.col("pos"), F.lit(9)) == 0, F.concat(F.lit("# "), "text")).when(every & (F.col("text") != ""), numbered).otherwise(F.col("text"))
    return plain(spark, sf_dir).withColumn("text", text)


NESTED = (
    LINES
    + f""", n AS (SELECT doc_id, pos, CASE WHEN pos % 11 = 10 THEN 'words' ELSE repeat('  ', pos % 3) || CASE WHEN pos % 2 = 0 THEN '1. ' ELSE '- ' END || trim(text, ' ') END AS text FROM lines),
c AS (SELECT doc_id, pos, text, {CLASS} AS class, length(text) - length(ltrim(text, ' ')) AS indent,
  length(regexp_extract(text, '^[ \\t]*((?:[-*+]|[0-9]+[.)])[ \\t]+)', 1)) AS marker FROM n),
r AS (SELECT *, sum(CASE WHEN class NOT IN ('list', 'blank') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM c),
p AS (SELECT i.doc_id, i.pos, i.run, i.text, (SELECT max(a.pos) FROM r a WHERE a.doc_id = i.doc_id AND a.run = i.run AND a.class = 'list' AND a.pos < i.pos
    AND a.indent + a.marker <= i.indent AND NOT EXISTS (SELECT 1 FROM r b WHERE b.doc_id = a.doc_id AND b.run = a.run AND b.class = 'list' AND b.pos > a.pos AND b.pos < i.pos
      AND b.indent < a.indent + a.marker)) AS parent FROM r i WHERE i.class = 'list')"""
)


@query(
    f"""WITH {NESTED} SELECT doc_id, pos::BIGINT AS pos, count(*) OVER (PARTITION BY doc_id, run, parent) > 1 AS keeps_number
FROM p WHERE regexp_matches(text, '^[ \\t]*[0-9]+[.)][ \\t]+')"""
)
def list_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which numbered items have another one beside them.  In SQL an item's parent is the last one before it that it is indented past and
    that no item between has closed."""
    return longs(L.numbered_siblings(_nested(spark, sf_dir, numbered=True)), "pos")


def _nested(spark: SparkSession, sf_dir: str, numbered: bool = False) -> DataFrame:
    """Plain lines as list items, indented by their position mod 3 (every other one with a number if ``numbered``); every eleventh is
    ordinary text."""
    indent = F.repeat(F.lit("  "), F.pmod(F.col("pos"), F.lit(3)).cast("int"))
    mark = F.when(F.lit(numbered) & (F.pmod(F.col("pos"), F.lit(2)) == 0), "1. ").otherwise("- ")
    item = F.concat(indent, mark, F.btrim("text"))
    return plain(spark, sf_dir).withColumn("text", F.when(F.pmod(F.col("pos"), F.lit(11)) == 10, F.lit("words")).otherwise(item))


@query(
    f"""WITH RECURSIVE {NESTED.replace("CASE WHEN pos % 2 = 0 THEN '1. ' ELSE '- ' END", "'- '")}, up AS (
  SELECT doc_id, pos, parent, 0 AS depth FROM p
  UNION ALL SELECT up.doc_id, up.pos, p.parent, depth + 1 FROM up JOIN p ON p.doc_id = up.doc_id AND p.pos = up.parent
) SELECT doc_id, pos::BIGINT AS pos, max(depth)::BIGINT AS depth FROM up GROUP BY doc_id, pos"""
)
def list_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of nested items: how many parents there are above one another."""
    return longs(L.list_depths(_nested(spark, sf_dir)), "pos", "depth").select("doc_id", "pos", "depth")


@query(
    f"""WITH {CLASSED} SELECT doc_id, pos::BIGINT AS pos,
  last_value(CASE WHEN level IS NOT NULL THEN heading END IGNORE NULLS)
    OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS under,
  first_value(CASE WHEN level IS NOT NULL THEN heading END IGNORE NULLS)
    OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ahead FROM classed"""
)
def asof_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last heading above and the next one below every line."""
    return longs(L.heading_before(marked(spark, sf_dir)), "pos")


@query(
    f"""WITH {CLASSED}, b AS (
  SELECT doc_id, class, count(*) AS n FROM classed WHERE class <> 'blank' GROUP BY ALL
) SELECT doc_id, class, n::BIGINT AS n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, class)::BIGINT AS place FROM b"""
)
def block_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of a document by how often they come."""
    counts = L.with_class(marked(spark, sf_dir)).filter("class <> 'blank'").groupBy("doc_id", "class")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "class"))
    return longs(counts.agg(F.count(F.lit(1)).alias("n")).withColumn("place", place), "place")


@query(
    f"""WITH {CLASSED} SELECT lang, class, count(*)::BIGINT AS n_lines, count(DISTINCT doc_id)::BIGINT AS n_docs,
  grouping(lang)::BIGINT AS all_langs, grouping(class)::BIGINT AS all_classes FROM classed GROUP BY CUBE (lang, class)"""
)
def class_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: all roll-ups of the class table."""
    out = L.with_class(marked(spark, sf_dir)).cube("lang", "class").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.countDistinct("doc_id").alias("n_docs"),
        F.grouping("lang").alias("all_langs"),
        F.grouping("class").alias("all_classes"),
    )
    return longs(out, "all_langs", "all_classes")
