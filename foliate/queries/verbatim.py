"""Queries of prose against its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import verbatim as V
from ..session import table
from . import query
from .fixtures import LINES, lines

#: A line as a unit of its own form by its place: as it is, in capitals, with dashes and spaces, in emphasis, with an escape, and one that isn't there.
UNIT = """CASE pos % 6 WHEN 0 THEN text WHEN 1 THEN translate(text, 'aeinrst', 'AEINRST') WHEN 2 THEN replace(text, ' ', '  — ') WHEN 3 THEN '**' || text || '**,' WHEN 4 THEN text || ' not there' ELSE '“' || replace(text, ',', ' …') || '\\!' END"""
WORDS = """SELECT {key}, n, w, a, b FROM (SELECT {key}, lower(regexp_replace(translate(replace(regexp_replace(h, '\\\\([!-/:-@\\[-`{{-~])', '\\1', 'g'), '…', '...'), '‘’“”„*_`', chr(39) || chr(39) || repeat(chr(34), 3)), '[.,;:!?]+$', '')) AS w,
  e - length(h) AS a, e AS b, k AS n FROM (SELECT {key}, k, h, sum(length(g) + length(h)) OVER (PARTITION BY {key} ORDER BY k) AS e FROM (
  SELECT {key}, unnest(range(len(h))) AS k, unnest(h) AS h, unnest(g[1:len(h)]) AS g FROM (SELECT {key}, regexp_extract_all(text, '[^\\s—–―‒−]+') AS h, string_split_regex(text, '[^\\s—–―‒−]+') AS g FROM {table})))) WHERE w <> ''"""


@query(
    f"""WITH {LINES}, u AS (SELECT doc_id, pos, {UNIT} AS text FROM lines),
sw AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i FROM ({WORDS.format(key="doc_id", table="documents")})),
uw AS ({WORDS.format(key="doc_id, pos", table="u")}),
s AS (SELECT doc_id, ' ' || string_agg(w, ' ' ORDER BY n) || ' ' AS t FROM sw GROUP BY doc_id), f AS (SELECT doc_id, pos, ' ' || string_agg(w, ' ' ORDER BY n) || ' ' AS t, count(*) AS m FROM uw GROUP BY doc_id, pos),
p AS (SELECT f.doc_id, f.pos, m, instr(s.t, f.t) AS c, s.t AS t FROM f JOIN s USING (doc_id)),
x AS (SELECT doc_id, pos, m, c, length(substring(t, 1, c)) - length(replace(substring(t, 1, c), ' ', '')) AS i FROM p)
SELECT doc_id, pos::BIGINT AS pos, CASE WHEN coalesce(m, 0) < 4 THEN 'short' WHEN c > 0 THEN 'stands' ELSE 'missing' END AS state,
  CASE WHEN m >= 4 AND c > 0 THEN f.a END::INT AS start, CASE WHEN m >= 4 AND c > 0 THEN l.b END::INT AS "end"
FROM u LEFT JOIN x USING (doc_id, pos) LEFT JOIN sw f USING (doc_id, i) LEFT JOIN (SELECT doc_id, i AS j, b FROM sw) l ON l.doc_id = u.doc_id AND l.j = x.i + m - 1"""
)
def verbatim_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each line, changed in form only, stands in its document.  In SQL both are joined to one string of words, which is searched."""
    units = lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("unit"), F.expr(UNIT.replace("\\!", "\\\\!")).alias("text"))
    found = V.find_units(table(spark, sf_dir, "documents").select("doc_id", "text"), units)
    return found.withColumnRenamed("unit", "pos")


#: Edits of each document: its first words, a text that isn't there, one that stands often, and one that overlaps the first in every seventh document.
EDITS = """SELECT doc_id, 1 AS edit, substring(text, 1, 40) AS old, 'NEW' AS new FROM {d} WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 2, 'never ' || doc_id, 'x' FROM {d} WHERE doc_id % 11 = 0
UNION ALL SELECT doc_id, 3, substring(text, 60, 30), '' FROM {d} WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 4, substring(text, 20, 40), 'y' FROM {d} WHERE doc_id % 7 = 0"""
STATED = f"""e AS ({EDITS.format(d="documents")}), c AS (SELECT e.*, text, CASE WHEN coalesce(old, '') = '' THEN 0 ELSE instr(text, old) END AS f FROM e JOIN documents USING (doc_id)),
g AS (SELECT *, f > 0 AND instr(substring(text, f + 1), old) > 0 AS again FROM c), h AS (SELECT *, CASE WHEN f > 0 AND NOT again THEN f - 1 END AS a, CASE WHEN f > 0 AND NOT again THEN f - 1 + length(old) END AS b FROM g),
r AS (SELECT h.*, CASE WHEN f = 0 THEN 'missing' WHEN again THEN 'twice'
  WHEN EXISTS (SELECT 1 FROM h o WHERE o.doc_id = h.doc_id AND o.edit <> h.edit AND o.a < h.b AND h.a < o.b) THEN 'overlaps' ELSE 'applied' END AS state FROM h)"""


@query(f"""WITH {STATED} SELECT doc_id, edit, state, a::INT AS start, b::INT AS "end" FROM r""")
def edit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each edit on record."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return V.approved_edits(d, spark.sql(EDITS, d=d)).drop("new")


@query(
    f"""WITH {STATED}, k AS (SELECT doc_id, bool_and(state = 'applied') AS fine, max(CASE WHEN edit = 1 THEN a END) AS a1, max(CASE WHEN edit = 1 THEN b END) AS b1, max(CASE WHEN edit = 3 THEN a END) AS a3,
  max(CASE WHEN edit = 3 THEN b END) AS b3, max(CASE WHEN edit = 4 THEN a END) AS a4, max(CASE WHEN edit = 4 THEN b END) AS b4 FROM r GROUP BY doc_id),
o AS (SELECT doc_id, coalesce(fine, true) AS fine, CASE WHEN NOT coalesce(fine, false) THEN text WHEN a1 IS NOT NULL AND a3 IS NOT NULL THEN 'NEW' || substring(text, b1 + 1, a3 - b1) || substring(text, b3 + 1)
  WHEN a1 IS NOT NULL THEN 'NEW' || substring(text, b1 + 1) WHEN a3 IS NOT NULL AND a4 IS NOT NULL THEN substring(text, 1, a4) || 'y' || substring(text, b4 + 1, a3 - b4) || substring(text, b3 + 1)
  WHEN a3 IS NOT NULL THEN substring(text, 1, a3) || substring(text, b3 + 1) WHEN a4 IS NOT NULL THEN substring(text, 1, a4) || 'y' || substring(text, b4 + 1) ELSE text END AS t FROM documents LEFT JOIN k USING (doc_id))
SELECT doc_id, NOT fine AS refused, md5(t) AS text FROM o"""
)
def edited_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their edits made, or refused."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return V.edited(d, spark.sql(EDITS, d=d)).select("doc_id", "refused", F.md5(F.col("text").cast("binary")).alias("text"))


@query(
    """WITH s AS (SELECT doc_id AS section, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]{3,}'))) AS word FROM documents),
q AS (SELECT item_id AS question, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]{3,}'))) AS word FROM benchmark),
w AS (SELECT word, floor(1000 * ln((2 * (SELECT count(*) FROM documents) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM s GROUP BY word HAVING count(*) <= 1000),
p AS (SELECT question, sum(w)::BIGINT AS whole FROM q JOIN w USING (word) GROUP BY question), x AS (SELECT question, section, sum(w)::BIGINT AS score FROM q JOIN w USING (word) JOIN s USING (word) GROUP BY ALL),
b AS (SELECT question, max(score) AS score, arg_max(section, (score, -section)) AS section FROM x GROUP BY question)
SELECT item_id AS question, CASE WHEN score >= 0.5 * whole THEN section END AS section, coalesce(score, 0)::BIGINT AS score, coalesce(whole, 0)::BIGINT AS whole
FROM benchmark LEFT JOIN p ON p.question = item_id LEFT JOIN b ON b.question = item_id"""
)
def exam_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that covers each benchmark item by its rare words, if any does."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question"), "text")
    return V.covering_sections(q, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("section"), "text"))
