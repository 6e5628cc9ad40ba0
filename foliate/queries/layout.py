"""Queries of page layout and of chains.  Runs are the documents' texts in pieces of 60 characters, placed on pages by their number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chains as C
from ..operators import layout as L
from ..session import cut, table
from . import query

#: Three pieces a line; every fifth document and line drifts so far that its third piece begins another line.
PLACED = """SELECT doc_id, CAST(i % 3 AS INT) AS r, CAST(floor(i / 3) AS INT) AS v, text FROM pieces"""
SLOTTED = """SELECT *, CAST(floor(v / 30) AS INT) AS page, CAST(96 + floor((v % 30) / 3) * 100 + (v % 3) * 22 AS INT) AS base FROM placed"""
RUNS = """SELECT doc_id, page, CAST(CASE WHEN v % 30 = 29 THEN 1135 ELSE base + r * ((doc_id + v) % 5) END AS INT) AS top,
  CAST(135 + 14 * (floor(v / 2) % 3) + r * 200 AS INT) AS "left", CASE WHEN v = 0 THEN 30 WHEN v % 13 IN (5, 6) THEN 24 WHEN v % 13 = 9 THEN 18 ELSE 11 END AS size,
  'Times' AS family, CASE WHEN v % 13 IN (5, 6, 9) THEN '#2980b8' ELSE '#000000' END AS colour, r = 1 AND v % 3 = 0 AS bold, r = 1 AND v % 3 = 1 AS italic,
  CASE WHEN r = 0 AND v % 7 = 3 THEN ' ' WHEN r = 2 AND v % 6 = 2 THEN text || '-' ELSE text END AS text FROM slotted
UNION ALL SELECT doc_id, page, base + 2, CAST(105 + 5 * ((doc_id + v) % 7) AS INT), 11, CASE WHEN v % 4 = 1 THEN 'SymbolMT' ELSE 'Times' END, '#000000', FALSE, FALSE,
  CASE WHEN v % 4 = 1 THEN 'o' WHEN v % 16 = 6 THEN 'b.' ELSE '12.' END FROM slotted WHERE r = 0 AND (v % 4 = 1 OR v % 8 = 6)"""
DUCK = f"""pieces AS (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS text
  FROM (SELECT doc_id, regexp_extract_all(replace(text, chr(10), ' '), '(?s).{{1,60}}') AS p FROM documents)), placed AS ({PLACED}), slotted AS ({SLOTTED}),
runs AS ({RUNS}), kept AS (SELECT * FROM runs WHERE top BETWEEN 100 AND 1130 AND size < 30 AND text <> '')"""

ON_LINES = f"""{DUCK}, starts AS (
  SELECT doc_id, page, min(top) AS line FROM kept GROUP BY doc_id, page
  UNION ALL SELECT s.doc_id, s.page, min(k.top) FROM starts s JOIN kept k ON k.doc_id = s.doc_id AND k.page = s.page AND k.top > s.line + 6 GROUP BY s.doc_id, s.page, s.line
), on_lines AS (SELECT k.*, s.line FROM kept k ASOF JOIN starts s ON k.doc_id = s.doc_id AND k.page = s.page AND k.top >= s.line)"""

LINED = f"""{ON_LINES}, numbered AS (SELECT *, trim(text, ' ') <> '' AS filled FROM on_lines),
tops AS (SELECT doc_id, page, line, line - lag(line) OVER (PARTITION BY doc_id ORDER BY page, line) AS gap FROM (SELECT DISTINCT doc_id, page, line FROM on_lines)),
led AS (SELECT *, min(CASE WHEN filled THEN rn END) OVER (PARTITION BY doc_id, page, line) AS head FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page, line ORDER BY "left", top) AS rn FROM numbered)),
heads AS (SELECT doc_id, page, line, head, "left" AS x, CASE WHEN regexp_matches(trim(text, ' '), '^([0-9]+|[A-Za-z])\\.$') THEN 'ol' WHEN regexp_matches(family, '(?i)wingdings|symbol') THEN 'ul' END AS marker
  FROM led WHERE rn = head),
rest AS (SELECT l.*, h.marker, h.x, min(CASE WHEN l.filled AND (h.marker IS NULL OR l.rn > h.head) THEN l.rn END) OVER (PARTITION BY l.doc_id, l.page, l.line) AS begin
  FROM led l JOIN heads h USING (doc_id, page, line)),
worded AS (SELECT *, CASE WHEN NOT filled THEN text WHEN bold THEN regexp_replace(text, '^( *)(.*?)( *)$', '\\1**\\2**\\3') WHEN italic THEN regexp_replace(text, '^( *)(.*?)( *)$', '\\1*\\2*\\3') ELSE text END AS said FROM rest),
lined AS (SELECT doc_id, page, line AS top, any_value(gap) AS gap, any_value(marker) AS marker, any_value(CASE WHEN marker IS NOT NULL THEN x END) AS marker_left,
  coalesce(max(CASE WHEN rn = begin AND colour = '#2980b8' THEN CASE WHEN size >= 24 THEN 1 WHEN size >= 18 THEN 2 END END), 0) AS level,
  coalesce(string_agg(text, '' ORDER BY rn) FILTER (rn >= begin), '') AS content, coalesce(string_agg(said, '' ORDER BY rn) FILTER (rn >= begin), '') AS marked
  FROM worded JOIN tops USING (doc_id, page, line) GROUP BY doc_id, page, line)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = F.regexp_extract_all(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("(?s).{1,60}"), F.lit(0))
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pieces).alias("i", "text"))
    d = spark.sql(PLACED.replace("FROM pieces", "FROM {d}"), d=d)
    d = spark.sql(SLOTTED.replace("FROM placed", "FROM {d}"), d=d)
    return spark.sql(RUNS.replace("FROM slotted", "FROM {d}").replace('"left"', "`left`"), d=d)


@query(f"""WITH RECURSIVE {ON_LINES} SELECT doc_id, page, line, count(*)::BIGINT AS n_runs, max(top) AS lowest, md5(string_agg(text, '' ORDER BY "left", top)) AS content FROM on_lines GROUP BY doc_id, page, line""")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs on lines that are anchored at their first run."""
    placed = L.on_lines(L.content_runs(runs(spark, sf_dir)))
    parts = F.array_sort(F.collect_list(F.struct("left", "top", "text")))
    text = F.array_join(F.transform(parts, lambda p: p["text"]), "")
    found = placed.groupBy("doc_id", "page", "line").agg(F.count(F.lit(1)).alias("n_runs"), F.max("top").alias("lowest"), text.alias("content"))
    return found.withColumn("content", F.md5(F.col("content").cast("binary")))


@query(
    f"""WITH RECURSIVE {LINED}, filled AS (SELECT *, lag(level) OVER w AS before FROM lined WHERE trim(content, ' ') <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY page, top)),
started AS (SELECT *, CASE WHEN level > 0 THEN before IS DISTINCT FROM level OR coalesce(gap, 31) > 30
  ELSE marker IS NOT NULL OR coalesce(gap, 31) > 30 OR before IS NULL OR before > 0 END AS starts, CASE WHEN level > 0 THEN trim(content, ' ') ELSE content END AS c,
  CASE WHEN level > 0 THEN trim(content, ' ') ELSE marked END AS m FROM filled),
b AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY page, top)::BIGINT AS block FROM started),
s AS (SELECT *, CASE WHEN lag(c) OVER w IS NULL OR regexp_matches(lag(c) OVER w, '[ -]$') THEN '' ELSE ' ' END AS sep FROM b WINDOW w AS (PARTITION BY doc_id, block ORDER BY page, top))
SELECT doc_id, block, CASE WHEN arg_min(level, (page, top)) > 0 THEN 'heading' ELSE coalesce(arg_min(coalesce(marker, 'p'), (page, top)), 'p') END AS kind, arg_min(level, (page, top))::INT AS level,
  min(page)::INT AS page, arg_min(top, (page, top)) AS top, count(*)::INT AS n_lines, md5(string_agg(sep || c, '' ORDER BY page, top)) AS content, md5(string_agg(sep || m, '' ORDER BY page, top)) AS marked
FROM s GROUP BY doc_id, block"""
)
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as headings, paragraphs and items."""
    found = L.blocks(L.lines(runs(spark, sf_dir)))
    return found.withColumns({c: F.md5(F.col(c).cast("binary")) for c in ("content", "marked")})


@query(
    f"""WITH RECURSIVE {LINED}, n AS (SELECT *, row_number() OVER w AS n, sum(CASE WHEN marker IS NULL AND coalesce(gap, 31) > 30 THEN 1 ELSE 0 END) OVER w AS list
  FROM lined WINDOW w AS (PARTITION BY doc_id ORDER BY page, top)),
m AS (SELECT doc_id, list, page, top, marker_left AS x, row_number() OVER (PARTITION BY doc_id, list ORDER BY n) AS k FROM n WHERE marker IS NOT NULL),
stack AS (SELECT doc_id, list, page, top, k, [x] AS open FROM m WHERE k = 1
  UNION ALL SELECT m.doc_id, m.list, m.page, m.top, m.k, list_append(list_filter(s.open, lambda y: y < m.x - 6), m.x) FROM stack s JOIN m ON m.doc_id = s.doc_id AND m.list = s.list AND m.k = s.k + 1)
SELECT doc_id, page, top, (len(open) - 1)::INT AS depth FROM stack"""
)
def column_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths of list markers by their columns."""
    return L.depths(cut(L.lines(runs(spark, sf_dir))))


@query(
    """WITH RECURSIVE e AS (SELECT event_id, greatest(round(value), 0)::BIGINT AS size, row_number() OVER (ORDER BY event_id) AS k FROM events),
p AS (SELECT event_id, k, size, sum(size) OVER (ORDER BY k) AS upto FROM e),
s AS (SELECT 1::BIGINT AS k, 0 AS batch UNION ALL SELECT max(n.k) + 1, s.batch + 1 FROM s JOIN p f ON f.k = s.k JOIN p n ON n.k >= s.k AND n.k < s.k + 50 AND (n.k = s.k OR n.upto - f.upto + f.size <= 500)
  WHERE s.k <= (SELECT max(k) FROM p) GROUP BY s.k, s.batch)
SELECT event_id, batch::BIGINT AS batch FROM p ASOF JOIN s ON p.k >= s.k"""
)
def one_queue_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one queue in greedy batches by value and count; in SQL each batch begins where the one before ends."""
    e = table(spark, sf_dir, "events").select(F.lit(0).alias("queue"), "event_id", F.greatest(F.round("value"), F.lit(0.0)).cast("long").alias("size"))
    return C.greedy_batches(e, "queue", "event_id", "size", 500, 50).select("event_id", F.col("batch").cast("long").alias("batch"))
