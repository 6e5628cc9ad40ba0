"""Queries of ordered rules, over lines whose form follows from their place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ordered as O
from ..session import table
from . import query
from .fixtures import CLASS, HEADING, LEVEL, LINES, lines
from .lines import longs

#: What a line becomes by its place mod 23.
FORMS = (
    "'# ' || text", "'## ' || text", "text", "'| a | b |'", "text || ':'", "'- ' || text", "'- ' || text", "'<!-- style: note -->'", "text", "'**bold**'", "'$$ x = ' || pos || ' $$'",
    "'where x is ' || text", "'#### deep'", "text || ':'", "text", "'**Lead** ' || text", "'| c | d |'", "'![alt](pic' || pos || '.png)'", "'*caption ' || pos || '*'", "'**Example**: ' || text",
    "'**Step 1: do** ' || text", "'$$ y = ' || pos || ' $$'", "'**' || pos || '.** ' || text",
)
FORM = "CASE pos % 23 " + " ".join(f"WHEN {k} THEN {f}" for k, f in enumerate(FORMS)) + " END"
SHAPED = LINES + f""", shaped AS (SELECT doc_id, pos, {FORM} AS text FROM lines WHERE text <> ''),
c AS (SELECT *, {CLASS} AS class, {LEVEL} AS level, {HEADING} AS heading FROM shaped),
f AS (SELECT *, lag(class) OVER w AS prev_class, lag(text) OVER w AS prev_text, lag(level) OVER w AS prev_level, lead(class) OVER w AS next_class, lead(text) OVER w AS next_text,
  lead(pos) OVER w AS next_pos, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER w AS unit FROM c WHERE class <> 'blank' WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"""


def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).filter("text <> ''").withColumn("text", F.expr(FORM)).select("doc_id", "pos", "text")


@query(
    f"""WITH {SHAPED}, r AS (SELECT *, sum(CASE WHEN class <> 'list' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM f),
l AS (SELECT doc_id, run, max(pos) AS run_last FROM r WHERE class = 'list' GROUP BY ALL)
SELECT r.doc_id, pos::BIGINT AS pos, next_pos::BIGINT AS first, CASE WHEN next_class = 'list' THEN run_last ELSE next_pos END::BIGINT AS last,
  CASE WHEN prev_level >= 4 THEN trim(regexp_replace(prev_text, '^#+ +', ''), ' ') END AS title
FROM r LEFT JOIN l ON l.doc_id = r.doc_id AND l.run = r.run WHERE class = 'text' AND regexp_matches(text, ':[ \\t]*$') AND next_pos IS NOT NULL"""
)
def colon_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each colon flag takes, and its title from a folded heading."""
    return longs(O.flag_takes(shaped(spark, sf_dir)), "pos", "first", "last")


@query(
    f"""WITH {SHAPED} SELECT doc_id, pos::BIGINT AS pos, 'note' AS style, text FROM f WHERE prev_text = '<!-- style: note -->' AND text <> '<!-- style: note -->'"""
)
def style_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a style marker applies to."""
    return longs(O.styled(shaped(spark, sf_dir)), "pos")


@query(
    f"""WITH {LINES}, m AS (SELECT doc_id, pos, text, CASE WHEN pos % 5 < 2 THEN 'b' WHEN pos % 5 < 4 THEN 'i' END AS mark FROM lines),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - row_number() OVER (PARTITION BY doc_id, mark ORDER BY pos) AS g FROM m)
SELECT doc_id, mark, min(pos)::BIGINT AS pos, count(*)::BIGINT AS n, md5(string_agg(text, '' ORDER BY pos)) AS text FROM g GROUP BY doc_id, mark, g"""
)
def run_coalescing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring runs of one mark as one."""
    mark = F.when(F.col("pos") % 5 < 2, "b").when(F.col("pos") % 5 < 4, "i")
    runs = lines(spark, sf_dir).select("doc_id", "pos", "text", mark.alias("mark"))
    return longs(O.coalesced(runs), "pos").withColumn("text", F.md5(F.col("text").cast("binary")))


@query(
    f"""WITH {SHAPED} SELECT doc_id, pos::BIGINT AS pos, coalesce(prev_class <> 'bold', true) AS is_formula,
  CASE WHEN coalesce(prev_class <> 'bold', true) AND next_class = 'where' THEN next_pos END::BIGINT AS where_pos FROM f WHERE class = 'display'"""
)
def formula_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display lines that are formulas, with the where-line that each takes in."""
    return longs(O.formulas(shaped(spark, sf_dir)), "pos", "where_pos")


@query(
    f"""WITH {SHAPED}, s AS (SELECT *, last_value(CASE WHEN level >= 2 THEN heading END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM f)
SELECT doc_id, pos::BIGINT AS pos, CASE WHEN prev_class = 'bold' THEN trim(replace(prev_text, '*', ''), ': ') WHEN prev_class = 'text' AND starts_with(prev_text, '**Lead**') THEN 'Lead' ELSE section END AS caption,
  CASE WHEN prev_class = 'bold' THEN 'bold' WHEN prev_class = 'text' AND starts_with(prev_text, '**Lead**') THEN 'lead' ELSE 'section' END AS how FROM s WHERE class = 'table' AND coalesce(prev_class, '') <> 'table'"""
)
def table_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table's caption and where it comes from."""
    return longs(O.captions(shaped(spark, sf_dir)), "pos")


@query(
    f"""WITH {SHAPED} SELECT doc_id, pos::BIGINT AS pos, 'pic' || pos || '.png' AS file, CASE WHEN starts_with(next_text, '*caption') THEN trim(next_text, '*') END AS caption
FROM f WHERE starts_with(text, '![alt]')"""
)
def figure_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures alone on their line and their captions."""
    return longs(O.figures(shaped(spark, sf_dir)), "pos")


CLOSED = f"CASE WHEN pos % 11 = 7 AND doc_id % 3 = 0 THEN '## Summary' WHEN pos % 11 = 4 AND doc_id % 3 = 1 THEN '**In short** ' || text WHEN pos % 11 = 0 THEN '# ' || text WHEN pos % 11 = 9 AND doc_id % 2 = 0 THEN '- ' || text ELSE text END"


@query(
    f"""WITH {LINES}, t AS (SELECT doc_id, pos, {CLOSED} AS text FROM lines), c AS (SELECT *, {CLASS} AS class, {LEVEL} AS level, {HEADING} AS heading FROM t),
u AS (SELECT *, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER w AS unit, sum(CASE WHEN class = 'heading' THEN 1 ELSE 0 END) OVER w AS section FROM c WHERE class <> 'blank' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
s AS (SELECT doc_id, unit, section, min(pos) FILTER (class = 'heading') AS pos, max(heading) FILTER (level > 1) AS title, count(*) FILTER (class = 'text') AS n, count(*) FILTER (class NOT IN ('text', 'heading')) AS o FROM u GROUP BY ALL),
b AS (SELECT doc_id, unit, max(pos) AS box FROM s WHERE title = 'Summary' AND n > 0 AND o = 0 GROUP BY ALL), l AS (SELECT doc_id, unit, max(pos) AS lead FROM u WHERE starts_with(text, '**In short**') GROUP BY ALL)
SELECT doc_id, unit::BIGINT AS unit, coalesce(box, lead)::BIGINT AS pos, CASE WHEN box IS NOT NULL THEN 'section' ELSE 'lead' END AS how FROM b FULL JOIN l USING (doc_id, unit)"""
)
def closing_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What closes each unit."""
    t = lines(spark, sf_dir).withColumn("text", F.expr(CLOSED))
    return longs(O.closing(t, T.RECAP, T.RECAP_LEAD), "unit", "pos")


@query(
    """WITH b AS (SELECT conv_id AS unit, turn::DOUBLE AS spot, CASE WHEN turn = 3 THEN 'closing' ELSE role END AS type FROM conversations),
q AS (SELECT doc_id AS unit, least(count(*), 5) AS n FROM (SELECT doc_id, unnest(range(1 + doc_id % 9)) FROM documents) GROUP BY 1),
k AS (SELECT unit, coalesce(max(spot) FILTER (type = 'closing') - 0.5, max(spot) + 0.5) AS spot FROM b GROUP BY unit),
r AS (SELECT unit, spot, type, NULL::BIGINT AS n_questions FROM b UNION ALL SELECT k.unit, k.spot, 'check', n FROM k JOIN q USING (unit))
SELECT unit, type, n_questions, row_number() OVER (PARTITION BY unit ORDER BY spot)::BIGINT AS place FROM r"""
)
def inline_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A check of five questions at most before the closing box."""
    kind = F.when(F.col("turn") == 3, "closing").otherwise(F.col("role"))
    blocks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("unit"), F.col("turn").alias("pos"), kind.alias("type"))
    bank = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit"), F.explode(F.sequence(F.lit(0), F.col("doc_id") % 9)).alias("q"))
    return longs(O.with_check(blocks, bank), "place")


WORKED = "CASE pos % 9 WHEN 0 THEN '## ' || text WHEN 1 THEN '**Step ' || pos || ': do it**' WHEN 2 THEN text WHEN 3 THEN '$$x = ' || pos || '$$' WHEN 4 THEN text WHEN 5 THEN text WHEN 6 THEN '**Final Answer**' WHEN 7 THEN '$$z = ' || pos || '$$' ELSE text END"


@query(
    f"""WITH {LINES}, t AS (SELECT doc_id, pos, {WORKED} AS text FROM lines WHERE text <> ''), c AS (SELECT *, {CLASS} AS class FROM t),
s AS (SELECT *, last_value(CASE WHEN class IN ('step', 'answer') THEN pos WHEN class IN ('heading', 'example') THEN -1 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS step FROM c WHERE class <> 'blank'),
k AS (SELECT *, min(CASE WHEN class = 'display' THEN pos END) OVER (PARTITION BY doc_id, step) AS shown FROM s WHERE step >= 0)
SELECT doc_id, step::BIGINT AS step_pos, max(CASE WHEN class = 'step' THEN 'do it' WHEN class = 'answer' THEN 'Final Answer' END) AS label, max(CASE WHEN pos = shown THEN trim(text, '$ ') END) AS result,
  md5(coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (class = 'text' AND pos > shown), '')) AS note, bool_or(class = 'answer') AS is_answer FROM k GROUP BY doc_id, step"""
)
def worked_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps with label, result and note; the answer's display."""
    t = lines(spark, sf_dir).filter("text <> ''").withColumn("text", F.expr(WORKED))
    return longs(O.worked_steps(t), "step_pos").withColumn("note", F.md5(F.col("note").cast("binary")))


@query(
    f"""WITH {SHAPED}, h AS (SELECT *, last_value(CASE WHEN level IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS under FROM f)
SELECT doc_id, unit::BIGINT AS unit, min(pos)::BIGINT AS first_stem, arg_min(under, pos)::BIGINT AS heading_pos FROM h WHERE regexp_matches(text, '^\\*\\*[0-9]+\\.\\*\\*[ \\t]*.') GROUP BY ALL"""
)
def question_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading above each unit's first question."""
    return longs(O.question_section(shaped(spark, sf_dir)), "unit", "first_stem", "heading_pos")


@query(
    f"""WITH {LINES}, u AS (SELECT DISTINCT doc_id, pos, text FROM lines WHERE text <> ''), w AS (SELECT a.doc_id, a.text AS first, CASE WHEN a.doc_id % 4 = 3 THEN 'nowhere' ELSE b.text END AS last
  FROM u a JOIN u b ON b.doc_id = a.doc_id AND b.pos = a.pos + 2 WHERE a.pos = 1),
s AS (SELECT w.*, (SELECT min(pos) FROM u WHERE u.doc_id = w.doc_id AND u.text = w.first) AS a FROM w), e AS (SELECT s.*, (SELECT min(pos) FROM u WHERE u.doc_id = s.doc_id AND u.text = s.last AND u.pos >= s.a) AS b FROM s)
SELECT doc_id, a::BIGINT AS a, b::BIGINT AS b, b IS NOT NULL AS found, (b - a + 1)::BIGINT AS n_lines FROM e"""
)
def cut_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages cut between two lines that must both stand."""
    u = lines(spark, sf_dir).filter("text <> ''").select("doc_id", "pos", "text")
    first = u.filter("pos = 1").select("doc_id", F.col("text").alias("first"))
    last = u.filter("pos = 3").select("doc_id", F.when(F.col("doc_id") % 4 == 3, "nowhere").otherwise(F.col("text")).alias("last"))
    return longs(O.passages(u, first.join(last, "doc_id")), "a", "b", "n_lines")


DASHED = "replace(replace(replace(replace(replace(text, '*', ''), '$', ''), '`', ''), ' the ', ' — '), ', ', CASE doc_id % 4 WHEN 0 THEN ' $a — b$ ' WHEN 1 THEN ' *' WHEN 2 THEN ' ** ' ELSE ' `— ' END)"


@query(
    f"""WITH t AS (SELECT doc_id, regexp_extract_all({DASHED}, '\\*\\*|[$`*—]') AS m FROM documents), e AS (SELECT doc_id, unnest(m) AS mark, unnest(range(len(m))) AS pos FROM t),
p AS (SELECT *, sum(CASE WHEN mark = '$' THEN 1 ELSE 0 END) OVER w % 2 + sum(CASE WHEN mark = '`' THEN 1 ELSE 0 END) OVER w % 2 + sum(CASE WHEN mark = '*' THEN 1 ELSE 0 END) OVER w % 2
  + sum(CASE WHEN mark = '**' THEN 1 ELSE 0 END) OVER w % 2 AS odd FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS dash, odd = 0 AS outside FROM p WHERE mark = '—'"""
)
def dash_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each dash of a text stands outside maths, code and emphasis."""
    return longs(O.dash_parity(table(spark, sf_dir, "documents").select("doc_id", F.expr(DASHED).alias("text"))), "dash")


@query(
    f"""WITH RECURSIVE {SHAPED}, p AS (SELECT *, row_number() OVER w AS k, class IN ('step', 'answer', 'display', 'table') OR regexp_matches(text, '^\\s*(?:[-*]\\s|[0-9]+[.)]\\s)') OR starts_with(text, '$') AS working,
  class IN ('example', 'heading') AS bar, max(CASE WHEN class = 'example' THEN pos END) OVER w AS part FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
q AS (SELECT *, coalesce(lead(working) OVER w, false) AS then_working, bool_or(class = 'step') OVER (PARTITION BY doc_id, part) AS stepped, NOT bar AND (working OR coalesce(NOT lead(bar) OVER w AND (lead(working) OVER w OR
  coalesce(NOT lead(bar, 2) OVER w AND (lead(working, 2) OVER w OR coalesce(NOT lead(bar, 3) OVER w AND lead(working, 3) OVER w, false)), false)), false)) AS reaches FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, k, pos, CASE WHEN class = 'example' THEN pos END AS example, class = 'example' AND working AS seen, class = 'example' AS open FROM q WHERE k = 1
  UNION ALL SELECT doc_id, k, pos, CASE WHEN inside THEN CASE WHEN class = 'example' THEN pos ELSE example END END, CASE WHEN class = 'example' THEN working ELSE seen OR working END, inside AND class <> 'table' FROM (
    SELECT q.*, r.example, r.seen, q.class = 'example' OR (r.open AND q.class <> 'heading' AND (stepped OR working OR then_working OR (NOT r.seen AND reaches))) AS inside FROM r JOIN q ON q.doc_id = r.doc_id AND q.k = r.k + 1))
SELECT doc_id, pos::BIGINT AS pos, example::BIGINT AS example FROM r WHERE example IS NOT NULL"""
)
def example_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that belong to a worked example.  In SQL each paragraph sees what the one before has left."""
    return longs(O.example_runs(shaped(spark, sf_dir)), "pos", "example")


@query(
    f"""WITH {SHAPED} SELECT doc_id, pos::BIGINT AS pos, min(CASE WHEN level IS NOT NULL THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)::BIGINT AS next_heading FROM f"""
)
def headings_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next heading of every line."""
    return longs(O.next_heading(shaped(spark, sf_dir)), "pos", "next_heading")
