"""Queries over what files say, states and counts, block operations, and what is written back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lines as L
from ..operators import ops as K
from ..operators import sources as S
from ..operators import state as X
from ..session import table
from . import query
from .fixtures import CLASSED, LINES, lines, marked
from .lines import longs


@query(
    """WITH b AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN hex(encode(text)) WHEN 1 THEN '93' || hex(encode('caf')) || 'E9' || hex(encode(doc_id::VARCHAR)) ELSE hex(encode(text || chr(65533))) END AS h, text FROM documents)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN md5(text) WHEN 1 THEN md5('“café' || doc_id) END AS text, CASE doc_id % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'windows-1252' ELSE 'refused' END AS encoding FROM b WHERE NOT contains(text, chr(65533))"""
)
def decoded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in two encodings, and texts that lost characters before."""
    d, k = table(spark, sf_dir, "documents").filter(~F.contains("text", F.lit("�"))), F.col("doc_id") % 3
    latin = F.concat(F.unhex(F.lit("93")), F.lit("caf").cast("binary"), F.unhex(F.lit("E9")), F.col("doc_id").cast("string").cast("binary"))
    raw = F.when(k == 0, F.col("text").cast("binary")).when(k == 1, latin).otherwise(F.concat("text", F.lit("�")).cast("binary"))
    text, encoding = S.decoded("raw")
    return d.select("doc_id", raw.alias("raw")).select("doc_id", F.md5(text.cast("binary")).alias("text"), encoding.alias("encoding"))


@query(
    """SELECT o_orderkey, 'media/' || o_custkey || '.png' AS first, 't' || o_orderkey AS second, 2::BIGINT AS n FROM orders"""
)
def relationship_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets by id, whatever the order of the attributes."""
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    xml = F.concat(
        F.lit('<Relationships><Relationship Id="rId1" Type="image" Target="media/'), cust, F.lit('.png"/><Relationship Target="t'), key,
        F.lit('" Id="rId2"/><Relationship Type="x"/></Relationships>'),
    )
    rels = S.relationships("xml")
    return table(spark, sf_dir, "orders").select("o_orderkey", xml.alias("xml")).select(
        "o_orderkey", F.try_element_at(rels, F.lit("rId1")).alias("first"), F.try_element_at(rels, F.lit("rId2")).alias("second"), F.size(rels).cast("long").alias("n")
    )


@query(
    """SELECT p_partkey, p_name AS producer, (p_size % 4)::BIGINT AS pages, list_filter(['word/media/a.png', 'word/media/' || p_size || '.jpg'], lambda x: true) AS media, NOT p_partkey % 4 IN (1, 2, 3) AS authors FROM part"""
)
def file_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A PDF's producer and pages, an archive's media, and whether a file is an author's."""
    p = table(spark, sf_dir, "part")
    pages = F.repeat(F.lit("1 0 obj <</Type /Page>> "), (F.col("p_size") % 4).cast("int"))
    pdf = F.concat(F.lit("%PDF-1.7 <</Type /Pages>> "), pages, F.lit("/Producer ("), "p_name", F.lit(")")).cast("binary")
    names = F.array(F.lit("word/media/a.png"), F.lit("__MACOSX/word/media/a.png"), F.concat(F.lit("word/media/"), F.col("p_size").cast("string"), F.lit(".jpg")), F.lit("word/media/._a.png"), F.lit("word/x.xml"))
    name = F.element_at(F.array(F.lit("in/notes.docx"), F.lit("in/~$notes.docx"), F.lit("in/.hidden"), F.lit("in/README.md")), (F.col("p_partkey") % 4 + 1).cast("int"))
    producer, n = S.pdf_facts("pdf")
    rows = p.select("p_partkey", pdf.alias("pdf"), names.alias("names"), name.alias("name"))
    return rows.select("p_partkey", producer.alias("producer"), n.cast("long").alias("pages"), S.media_entries("names").alias("media"), S.authors_file("name").alias("authors"))


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'absent' WHEN 1 THEN 'malformed' ELSE 'read' END AS state, CASE WHEN event_id % 3 = 2 THEN user_id END AS v FROM events"""
)
def json_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON that is absent, malformed or read."""
    user = F.col("user_id").cast("string")
    text = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"v": '), user)).when(F.col("event_id") % 3 == 2, F.concat(F.lit('{"v": '), user, F.lit("}")))
    value, state = S.tolerant_json("j", "v long")
    return table(spark, sf_dir, "events").select("event_id", text.alias("j")).select("event_id", state.alias("state"), value["v"].alias("v"))


@query(
    """SELECT user_id, arg_max(event_type, event_id) AS value FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 GROUP BY user_id"""
)
def newest_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest JSON line of each user that names a type and is no side line."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    fields = F.concat(F.when(k % 5 == 0, F.lit('"x": 1')).otherwise(F.concat(F.lit('"model": "'), "event_type", F.lit('"'))), F.when(k % 7 == 0, F.lit(', "side": true')).otherwise(""))
    rows = e.select("user_id", "event_id", F.concat(F.lit("{"), fields, F.lit("}")).alias("line"))
    return S.newest(rows, "user_id", "event_id", "line", "model", "side")


@query(
    f"""WITH {LINES}, b AS (SELECT doc_id, pos, CASE WHEN pos % 4 < 2 THEN '- ' || text ELSE text END AS text, pos % 4 < 2 AS item FROM lines WHERE trim(CASE WHEN pos % 4 < 2 THEN '- ' || text ELSE text END) <> ''),
p AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN '' WHEN item AND lag(item) OVER w THEN chr(10) ELSE chr(10) || chr(10) END AS gap FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, md5(string_agg(gap || text, '' ORDER BY pos)) AS markdown FROM p GROUP BY doc_id"""
)
def emitted_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks written back as Markdown."""
    item = F.pmod(F.col("pos"), F.lit(4)) < 2
    b = lines(spark, sf_dir).select("doc_id", "pos", F.when(item, F.concat(F.lit("- "), "text")).otherwise(F.col("text")).alias("text"), item.alias("is_item"))
    return S.markdown(b, "doc_id", "pos").withColumn("markdown", F.md5(F.col("markdown").cast("binary")))


@query(
    """SELECT p_partkey, '| ' || p_name || ' | a\\|b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_brand || ' |  |' || chr(10) || '| c\\\\d | ' || p_size || ' |' AS t FROM part"""
)
def written_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe tables from rows of unequal length with characters to escape."""
    rows = F.array(F.array(F.col("p_name"), F.lit("a|b")), F.array(F.col("p_brand")), F.array(F.lit("c\\d"), F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", rows.alias("rows")).select("p_partkey", S.markdown_table("rows").alias("t"))


@query(
    """WITH d AS (SELECT l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN 'picture' WHEN 1 THEN 'textbox' ELSE 'shape' END AS kind, 'm' || l_linenumber AS file, l_quantity > 25 AS referenced FROM lineitem),
g AS (SELECT l_orderkey, count(*) FILTER (kind = 'picture') AS p, count(*) FILTER (kind = 'textbox') AS t, count(*) FILTER (kind = 'shape') AS s, list_sort(list(DISTINCT file) FILTER (NOT referenced)) AS o FROM d GROUP BY 1)
SELECT l_orderkey, '{"pictures":' || p || ',"textboxes":' || t || ',"shapes":' || s || ',"orphans":[' || coalesce(array_to_string(list_transform(o, lambda x: '"' || x || '"'), ','), '') || ']}' AS inventory FROM g"""
)
def drawing_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of drawings by kind and unreferenced media, as JSON."""
    k = F.col("l_linenumber") % 3
    d = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.when(k == 0, "picture").when(k == 1, "textbox").otherwise("shape").alias("kind"), F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("file"),
        (F.col("l_quantity") > 25).alias("referenced"),
    )
    return S.inventory(d, "l_orderkey")


@query(
    f"""WITH {CLASSED}, u AS (SELECT doc_id, lang, class, text, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS unit,
  len(list_filter(string_split_regex(text, '[ \\t]+'), lambda w: w <> '')) AS n_words FROM classed)
SELECT lang, doc_id, grouping(doc_id)::BIGINT AS total, count(*)::BIGINT AS n_lines, sum(n_words)::BIGINT AS n_words, max(CASE WHEN class = 'text' THEN n_words END)::BIGINT AS longest_prose,
  count(*) FILTER (contains(text, '?'))::BIGINT AS n_questions, count(DISTINCT CASE WHEN class = 'bold' THEN text END)::BIGINT AS n_terms,
  CASE WHEN count(*) FILTER (class = 'table') > 0 THEN round(sum(n_words) / count(*) FILTER (class = 'table'))::BIGINT END AS words_per_table,
  sum(length(text)) / count(DISTINCT unit) < 40 AS is_scan FROM u GROUP BY GROUPING SETS ((lang, doc_id), (lang), ())"""
)
def conversion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document with its counts and ratios (null without a table), and totals per language and of all."""
    u = L.with_class(L.with_unit(marked(spark, sf_dir)))
    n_tables = F.count_if(F.col("class") == "table")
    out = u.rollup("lang", "doc_id").agg(
        F.grouping("doc_id").cast("long").alias("total"),
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("n_words").cast("long").alias("n_words"),
        F.max(F.when(F.col("class") == "text", F.col("n_words"))).cast("long").alias("longest_prose"),
        F.count_if(F.col("text").contains("?")).alias("n_questions"),
        F.countDistinct(F.when(F.col("class") == "bold", F.col("text"))).alias("n_terms"),
        F.round(F.sum("n_words") / F.when(n_tables > 0, n_tables)).cast("long").alias("words_per_table"),
        (F.sum(F.length("text")) / F.countDistinct("unit") < 40).alias("is_scan"),
    )
    return out


@query(
    """WITH p AS (SELECT event_id AS id, user_id AS course, CASE event_id % 4 WHEN 0 THEN 'fold' WHEN 1 THEN 'figure' WHEN 2 THEN 'chart' END AS disposition, event_id % 9 = 0 AS parked, event_type AS op FROM events)
SELECT op, coalesce(disposition, 'none') AS disposition, count(*)::BIGINT AS n, count(*) FILTER (disposition IS NULL)::BIGINT AS undisposed, count(*) FILTER (parked)::BIGINT AS parked,
  row_number() OVER (PARTITION BY op ORDER BY count(*) DESC, coalesce(disposition, 'none'))::BIGINT AS place, array_to_string(list_sort(list(id))[1:8], ',') AS samples FROM p GROUP BY op, coalesce(disposition, 'none')"""
)
def disposition_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations by kind and disposition, largest first, eight samples each; what has no disposition or is parked."""
    k = F.col("event_id") % 4
    p = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("op"), F.when(k == 0, "fold").when(k == 1, "figure").when(k == 2, "chart").alias("d"), (F.col("event_id") % 9 == 0).alias("parked")
    )
    p = p.withColumn("disposition", F.coalesce("d", F.lit("none")))
    counts = p.groupBy("op", "disposition").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d").isNull()).alias("undisposed"), F.count_if("parked").alias("parked"))
    first = p.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    for by in (["op", "disposition", "salt"], ["op", "disposition"]):  # no task orders a whole group
        first = first.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).filter("__r <= 8")
    samples = first.groupBy("op", "disposition").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("samples"))
    place = F.row_number().over(Window.partitionBy("op").orderBy(F.desc("n"), "disposition"))
    return longs(counts.join(samples, ["op", "disposition"]).withColumn("place", place), "place")


CONTEXT = "CASE doc_id % 5 WHEN 0 THEN text || ' f(x, y) = x' WHEN 1 THEN text || ' y = 2x + 1, so' WHEN 2 THEN text || ' g( x ) = x^2' ELSE text END"


@query(
    f"""WITH d AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'textbox' WHEN 1 THEN 'shape' ELSE 'picture' END AS kind, doc_id % 11 = 0 AS as_is, {CONTEXT} AS t FROM documents)
SELECT doc_id, CASE WHEN kind IN ('textbox', 'shape') THEN 'fold' WHEN as_is THEN 'figure' WHEN regexp_matches(t, '(?i)\\(\\s*x\\s*,\\s*y\\s*\\)|\\bz\\s*=') THEN 'figure'
  WHEN regexp_matches(t, '(?i)(?:[fghpqyv]\\s*\\(\\s*x\\s*\\)|y)\\s*=\\s*[^\\n,;.]{{2,80}}') THEN 'chart' ELSE 'uncertain' END AS disposition,
  contains(t, '![') AS has_marker FROM d"""
)
def dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do with each drawing, by its kind and the text around it; and whether a picture marker is left."""
    k = F.col("doc_id") % 7
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(k == 0, "textbox").when(k == 1, "shape").otherwise("picture").alias("kind"), (F.col("doc_id") % 11 == 0).alias("as_is"), F.expr(CONTEXT).alias("t")
    )
    return d.select("doc_id", T.disposition("kind", "as_is", "t").alias("disposition"), F.contains("t", F.lit("![")).alias("has_marker"))


#: What a course's folder and its gates say, by its number.
STATE = """CASE WHEN k % 10 = 0 THEN 'exam' END AS recorded_mode, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS n_docx, CASE WHEN k % 4 > 0 THEN 2 ELSE 0 END AS n_sources, CASE WHEN k % 5 = 0 THEN 0 ELSE 3 END AS n_files,
  k % 6 > 0 AS has_inventory, k % 7 > 0 AS has_findings, CASE WHEN k % 8 > 0 THEN k % 2 END AS undisposed, k % 9 > 0 AS has_manifest, CASE WHEN k % 11 < 5 THEN 0 ELSE k % 11 END AS open_findings"""
GATES = {"structureAnswered": "k % 13 > 1", "analyzeDone": "k % 17 > 9", "composeSkipped": "k % 19 > 12", "courseShellVerified": "k % 5 > 2", "verifyMatched": "k % 23 > 5", "unitOneAccepted": "k % 29 > 20", "auditDone": "k % 31 > 27", "reviewDone": "k % 37 > 33", "published": "k % 41 > 39"}


@query(
    f"""WITH c AS (SELECT c_custkey AS k FROM customer), s AS (SELECT k, {STATE}, {", ".join(f"{test} AS {name}" for name, test in GATES.items())} FROM c),
p AS (SELECT *, CASE WHEN published THEN 7 WHEN reviewDone THEN 6 WHEN auditDone THEN 5 WHEN has_manifest AND verifyMatched AND unitOneAccepted THEN 4 WHEN composeSkipped THEN 3 WHEN analyzeDone THEN 2
  WHEN n_sources > 0 AND has_inventory AND has_findings AND undisposed = 0 AND structureAnswered THEN 1 ELSE 0 END AS phase FROM s)
SELECT k AS course, coalesce(recorded_mode, CASE WHEN n_docx > 0 OR n_sources > 0 THEN 'summary' WHEN n_files > 0 THEN 'scratch' END) AS mode, phase::BIGINT AS phase,
  ['Intake', 'Analyze', 'Compose', 'Layout', 'Audit', 'Student View', 'Publish', 'Observe'][phase + 1] AS name,
  CASE phase WHEN 3 THEN CASE WHEN NOT courseShellVerified THEN 'author: the course itself' WHEN NOT unitOneAccepted THEN 'author: the first unit' END WHEN 5 THEN 'reviewer: the course as a student'
    WHEN 6 THEN CASE WHEN open_findings > 0 THEN 'person: open findings ' || open_findings ELSE 'author: the word publish' END END AS waits_for FROM p"""
)
def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each course is, in which mode, and whom it waits for."""
    gates = f"map({', '.join(f'{name!r}, {test}' for name, test in GATES.items())}) AS gates"
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    s = spark.sql(f"SELECT k AS course, {STATE}, {gates} FROM {{c}}", c=c)
    return longs(X.states(s, "course"), "phase")


#: Lists of findings: as they should be, under a wrong key, beside another list, none, and what is no JSON.
LISTS = """CASE k % 6 WHEN 0 THEN '{"lines": [{"state": "open", "id": ' || k || '}, {"state": "done"}]}' WHEN 1 THEN '{"lines": [], "findings": [{"state": "open"}]}' WHEN 2 THEN '{"items": [' || k || ']}'
  WHEN 3 THEN '{"lines": [{"state": "done"}], "notes": [1]}' WHEN 4 THEN '{"lines": [' ELSE '{"course": "c' || k || '", "lines": []}' END"""


@query(f"""SELECT c_custkey AS course, CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END::BIGINT AS n_open, CASE c_custkey % 6 WHEN 1 THEN 'findings' WHEN 2 THEN 'items' END AS misplaced FROM customer""")
def findings_misplaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open findings of each course, and the key under which a list can't be seen."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).select("k", F.expr(LISTS).alias("t"))
    n, under = X.findings_seen("t")
    return c.select(F.col("k").alias("course"), n.cast("long").alias("n_open"), under.alias("misplaced"))


@query(
    """WITH r AS (SELECT p_partkey AS name, CASE p_size % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'draft' ELSE 'retired' END AS status FROM part)
SELECT name, status, CASE status WHEN 'draft' THEN 1 WHEN 'active' THEN 2 ELSE 3 END::BIGINT AS "group", row_number() OVER (PARTITION BY status ORDER BY name)::BIGINT AS place FROM r"""
)
def registry_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry by status in a given order, then by name."""
    k = F.col("p_size") % 3
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.when(k == 0, "active").when(k == 1, "draft").otherwise("retired").alias("status"))
    return longs(S.ranked(r, ["draft", "active", "retired"]), "group", "place")


#: Blocks of a unit (a document's lines, each with a word of its own) and what becomes of them by the rule.
BLOCKS = {
    "b0": "'## Costs of ' || w || '\n\nBuy **it** at ' || w || '.\n\nx = ' || w || '\n\nSo the total is:\n\n**y** = 2\n\nThat is ' || w",
    "b1": "'keep ' || w || '\n  stop  \nrest ' || w",
    "b2": "'before ' || w || '\n$a$\nand\n$b$\nbehind ' || w",
    "b3": "'fourth ' || w",
    "b4": "'z = ' || w",
}
LEFT = """SELECT doc_id AS unit, unnest([{'place': 0, 'id': 'b3', 'type': 'callout', 'title': 'New', 'problem': NULL, 'body': 'put', 'steps': NULL},
  {'place': 1, 'id': 'first', 'type': 'worked-example', 'title': 'Costs of ' || w, 'problem': 'Buy **it** at ' || w || '.', 'body': NULL, 'steps': CASE WHEN length(w) <= 116 THEN 'x = ' || w || '|' ELSE 'x|x = ' || w END || ';So the total is|y = 2 That is ' || w},
  {'place': 2, 'id': 'n1', 'type': 'prose', 'title': NULL, 'problem': NULL, 'body': 'one', 'steps': NULL}, {'place': 3, 'id': 'n2', 'type': 'table', 'title': 'T', 'problem': NULL, 'body': 'two', 'steps': NULL},
  {'place': 4, 'id': 'b1', 'type': 'prose', 'title': NULL, 'problem': NULL, 'body': 'keep ' || w, 'steps': NULL}, {'place': 5, 'id': 'b2', 'type': 'prose', 'title': NULL, 'problem': NULL, 'body': 'before ' || w, 'steps': NULL},
  {'place': 6, 'id': 'f', 'type': 'formula', 'title': NULL, 'problem': NULL, 'body': 'a = b', 'steps': NULL}, {'place': 7, 'id': 'b2-after', 'type': 'prose', 'title': NULL, 'problem': NULL, 'body': 'behind ' || w, 'steps': NULL}]) AS b FROM w"""
LOG = "rename:done,rename:taken,after:done,worked:done,cut:done,cut:empties,formula:done,splitAt:not prose,worked:no title,replace:done,move:done,move:no place,remove:done,remove:missing,turn:missing"
WORD = "coalesce(nullif(trim(regexp_replace(regexp_replace(text, '[^A-Za-z ]+', ' ', 'g'), ' +', ' ', 'g'), ' '), ''), 'none')"


def block_ops(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A unit of five blocks for each document, around its words, and fifteen operations that depend on one another."""
    words = F.btrim(F.regexp_replace(F.regexp_replace("text", "[^A-Za-z ]+", " "), " +", " "))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit"), F.when(words == "", "none").otherwise(F.coalesce(words, F.lit("none"))).alias("w"))
    each = [F.struct(F.lit(k).alias("place"), F.lit(name).alias("id"), F.expr(body).alias("body")) for k, (name, body) in enumerate(BLOCKS.items())]
    none = F.lit(None)
    b = d.select("unit", F.inline(F.array(*each)))
    blocks = b.select("unit", "place", "id", F.lit("prose").alias("type"), none.cast("string").alias("title"), none.cast("string").alias("problem"), "body", none.cast("array<struct<label: string, note: string>>").alias("steps"))
    put = lambda *rows: [(i, t, h, x) for i, t, h, x in rows]
    steps = [
        ("rename", "b0", "first", None, None, None), ("rename", "b1", "first", None, None, None), ("after", "first", None, None, None, put(("n1", "prose", None, "one"), ("n2", "table", "T", "two"))),
        ("worked", "first", None, None, None, None), ("cut", "b1", "stop", None, None, None), ("cut", "b3", None, None, None, None), ("formula", "b2", None, None, ["$a$", "$b$"], put(("f", "formula", None, "a = b"))),
        ("splitAt", "f", None, None, ["a = b"], put(("g", "formula", None, "x"))), ("worked", "b4", None, None, None, None), ("replace", "b3", None, None, None, put((None, "callout", "New", "put"))),
        ("move", "b3", "first", None, None, None), ("move", "b4", "nowhere", None, None, None), ("remove", "b4", None, None, None, None), ("remove", "b4", None, None, None, None), ("turn", "b4", None, None, None, None),
    ]
    listed = spark.createDataFrame([(k, *x) for k, x in enumerate(steps)], K.OPS.removeprefix("unit long, "))
    listed = listed.withColumn("arg", F.when((F.col("op") == "cut") & (F.col("id") == "b3"), "@").otherwise(F.col("arg")))
    units = blocks.filter("place = 3").select((F.col("unit") + 0).alias("unit"), F.concat("body", F.lit("")).alias("__first"))
    ops = units.join(F.broadcast(listed))  # fifteen rows
    return blocks, ops.withColumn("arg", F.when(F.col("arg") == "@", F.col("__first")).otherwise(F.col("arg"))).drop("__first")


@query(
    f"""WITH w AS (SELECT doc_id, {WORD} AS w FROM documents), l AS ({LEFT})
SELECT unit, b.place::BIGINT AS place, b.id AS id, b.type AS type, b.title AS title, md5(b.problem) AS problem, md5(b.body) AS body, md5(b.steps) AS steps, '{LOG}' AS log FROM l"""
)
def block_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks after their operations; the SQL states what the rule leaves of each."""
    found = longs(K.apply_ops(*block_ops(spark, sf_dir)), "place")
    steps = F.array_join(F.transform("steps", lambda s: F.concat(s["label"], F.lit("|"), F.coalesce(s["note"], F.lit("")))), ";")
    return found.withColumn("steps", steps).withColumns({c: F.md5(F.col(c).cast("binary")) for c in ("problem", "body", "steps")})
