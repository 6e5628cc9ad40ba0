"""Queries of joins that keep order, near misses and leftovers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import once
from ..operators import joins as J
from ..session import table
from . import query
from .fixtures import LINES, lines
from .lines import longs

#: Styles from parts: chains of fifty, the first of a chain with a level of its own in two of three chains; every chain of a fifth kind ends in a
#: circle, and some styles are based on one that is not there.
STYLES = """styles AS (SELECT 's' || p_partkey AS style, CASE WHEN p_partkey % 50 = 0 AND p_partkey // 50 % 3 < 2 THEN (p_size % 6 + 1)::INT END AS level,
  CASE WHEN p_partkey % 50 > 0 THEN 's' || (p_partkey - 1) WHEN p_partkey // 50 % 3 = 2 THEN 's' || (p_partkey + 49) WHEN p_partkey % 100 = 0 THEN 'missing' END AS based_on FROM part)"""


@query(
    f"""WITH RECURSIVE {STYLES}, walk AS (
  SELECT style, level, based_on, 0 AS depth FROM styles
  UNION ALL SELECT w.style, p.level, p.based_on, depth + 1 FROM walk w JOIN styles p ON w.based_on = p.style
  WHERE w.level IS NULL AND depth < 200
) SELECT style, arg_min(level, depth)::BIGINT AS level FROM walk GROUP BY style"""
)
def style_levels_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels inherited along chains of fifty styles, with circles and missing parents among them.  No chain has 200 steps, so the SQL's end
    only stops circles."""
    k = F.col("p_partkey")
    chain = F.expr("p_partkey div 50") % 3
    name = lambda n: F.concat(F.lit("s"), n.cast("string"))
    styles = table(spark, sf_dir, "part").select(
        name(k).alias("style"),
        F.when((k % 50 == 0) & (chain < 2), (F.col("p_size") % 6 + 1).cast("int")).alias("level"),
        F.when(k % 50 > 0, name(k - 1)).when(chain == 2, name(k + 49)).when(k % 100 == 0, F.lit("missing")).alias("based_on"),
    )
    return longs(J.inherited_levels(styles), "level")


FORMATS = "(VALUES (0, 0, 'decimal'), (0, 1, 'bullet'), (1, 0, 'lowerLetter')) AS f(abstract_id, ilvl, format)"


@query(
    f"""SELECT event_id AS para_id, user_id % 4 AS num_id, event_id % 3 AS ilvl, coalesce(format, 'bullet') AS format
FROM events LEFT JOIN (VALUES (0, 0), (1, 1), (2, 0)) AS n(num_id, abstract_id) ON n.num_id = user_id % 4
LEFT JOIN {FORMATS} ON f.abstract_id = n.abstract_id AND f.ilvl = event_id % 3"""
)
def numbering_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paragraph's list format over two hops; events stand for paragraphs."""
    e = table(spark, sf_dir, "events")
    paragraphs = e.select(F.col("event_id").alias("para_id"), (F.col("user_id") % 4).alias("num_id"), (F.col("event_id") % 3).alias("ilvl"))
    numbers = spark.sql("SELECT * FROM VALUES (0L, 0L), (1L, 1L), (2L, 0L) AS n(num_id, abstract_id)")
    formats = spark.sql(f"SELECT cast(abstract_id AS long) abstract_id, cast(ilvl AS long) ilvl, format FROM {FORMATS}")
    return J.list_formats(paragraphs, numbers, formats)


@query(
    """WITH p AS (SELECT doc_id, unnest(range(0, 6))::BIGINT AS point_id, n_chars FROM documents),
points AS (SELECT doc_id, point_id, point_id * n_chars // 5 AS at FROM p),
l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
e AS (SELECT doc_id, unnest(range(len(l)))::BIGINT AS block_id, unnest(l) AS text FROM l),
blocks AS (SELECT doc_id, block_id, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY block_id)::BIGINT AS stop FROM e)
SELECT p.doc_id, point_id, (SELECT min(block_id) FROM blocks b WHERE b.doc_id = p.doc_id AND b.stop > p.at) AS "into" FROM points p"""
)
def range_join_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six places of each document and the line that each falls into: a merge, not a comparison of all pairs."""
    at = (F.expr("point_id * n_chars div 5")).cast("long")
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(5)).cast("array<bigint>")).alias("point_id"))
    points = d.select("doc_id", "point_id", at.alias("at"))
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = lines(spark, sf_dir).select(
        "doc_id", F.col("pos").cast("long").alias("block_id"), F.sum(F.length("text") + 1).over(upto).cast("long").alias("end")
    )
    return J.drained_before(points, ends)


@query(
    "SELECT d.doc_id, lang FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels)"
)
def semi_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared units only: documents that have a label."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What nothing refers to: documents without a label."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    """WITH used AS (SELECT source || '/' || lang AS series FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
known AS (SELECT DISTINCT source || '/' || lang AS series FROM documents WHERE n_chars > 3000)
SELECT series, count(*)::BIGINT AS n FROM used WHERE series NOT IN (SELECT series FROM known WHERE series IS NOT NULL) GROUP BY series"""
)
def undeclared_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series (source and language) in use that are not among those declared (by long documents)."""
    series = F.concat_ws("/", "source", "lang")
    d = table(spark, sf_dir, "documents").filter("source is not null and lang is not null").select(series.alias("series"), "n_chars")
    return d.groupBy("series").agg(F.count(F.lit(1)).alias("n")).join(d.filter("n_chars > 3000").select("series").distinct(), "series", "left_anti")


TITLES = """(VALUES ('The', 'article', 2), ('Th', 'short', 3), ('A', 'single', 1), ('Die', 'german', 4), ('La', 'romance', 5)) AS t(prefix, title, ord)"""


@query(
    f"""SELECT doc_id AS row_id, (SELECT arg_min(title, ord) FROM {TITLES} WHERE starts_with(text, prefix)) AS title FROM documents"""
)
def prefix_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first title whose prefix a text begins with."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return J.first_prefix(d, spark.sql(f"SELECT * FROM {TITLES}")).select("row_id", "title")


@query(
    """WITH a AS (SELECT doc_id AS name FROM documents), b AS (SELECT doc_id + 7 AS name, quality = 1 AS ok FROM labels)
SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'volunteered' WHEN coalesce(ok, false) THEN 'uploaded'
  ELSE 'failed' END AS status FROM a FULL JOIN b ON a.name = b.name"""
)
def reconcile_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was asked for against what came back."""
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"))
    answered = table(spark, sf_dir, "labels").select((F.col("doc_id") + 7).alias("name"), (F.col("quality") == 1).alias("ok"))
    return J.reconcile(asked, answered)


@query(
    """WITH l AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN -o_custkey ELSE o_custkey END AS k, o_orderpriority AS name FROM orders),
r AS (SELECT c_custkey AS k, c_custkey AS v, CASE c_custkey % 5 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' ELSE 'other' END AS name FROM customer),
f AS (SELECT name, min(v) AS first FROM r GROUP BY name)
SELECT id, coalesce(r.v, f.first) AS v, CASE WHEN r.v IS NOT NULL THEN 'key' WHEN f.first IS NOT NULL THEN 'name' ELSE 'none' END AS how
FROM l LEFT JOIN r ON l.k = r.k LEFT JOIN f ON f.name = l.name"""
)
def fallback_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on the key, and on the name for those whose key is gone: here every third order's."""
    gone = F.when(F.col("o_orderkey") % 3 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey"))
    left = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), gone.alias("k"), F.col("o_orderpriority").alias("name"))
    m = F.col("c_custkey") % 5
    right = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), F.col("c_custkey").alias("v"), F.when(m == 0, "1-URGENT").when(m == 1, "2-HIGH").otherwise("other").alias("name")
    )
    return J.with_fallback(left, right, "k", "name", "v").select("id", "v", "how")


#: An edited copy: every tenth line loses its last three words, every 17th line is gone.
EDITED = (
    LINES
    + """, w AS (SELECT doc_id, pos, list_filter(string_split_regex(text, '[ \\t\\n]+'), lambda w: w <> '') AS ws FROM lines),
source AS (SELECT doc_id, pos, ws FROM w WHERE len(ws) > 0),
edited AS (SELECT doc_id, pos, CASE WHEN pos % 10 = 9 THEN ws[1:greatest(len(ws) - 3, 0)] ELSE ws END AS ws FROM w WHERE pos % 17 <> 16)"""
)


def _edited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, pos, ws) of the source and of the edited copy."""
    words = F.filter(F.split("text", r"[ \t\n]+"), lambda w: w != "")
    w = lines(spark, sf_dir).select("doc_id", "pos", words.alias("ws"))
    cut = F.slice("ws", F.lit(1), F.greatest(F.size("ws") - 3, F.lit(0)))
    edited = w.filter("pos % 17 <> 16").withColumn("ws", F.when(F.col("pos") % 10 == 9, cut).otherwise(F.col("ws")))
    return w.filter(F.size("ws") > 0), edited


BAG = f"""WITH {EDITED}, s AS (SELECT doc_id, unnest(ws) AS word FROM source), e AS (SELECT doc_id, unnest(ws) AS word FROM edited),
e2 AS (SELECT doc_id, unnest(CASE WHEN pos % 10 = 9 THEN ws[4:] ELSE ws END) AS word FROM w WHERE pos % 17 <> 16),
sc AS (SELECT doc_id, word, count(*) AS n FROM s GROUP BY ALL), ec AS (SELECT doc_id, word, count(*) AS a FROM e GROUP BY ALL),
ec2 AS (SELECT doc_id, word, count(*) AS b FROM e2 GROUP BY ALL),
d AS (SELECT sc.doc_id, word, (n - greatest(coalesce(a, 0), coalesce(b, 0)))::BIGINT AS missing FROM sc LEFT JOIN ec USING (doc_id, word)
  LEFT JOIN ec2 USING (doc_id, word) WHERE n > greatest(coalesce(a, 0), coalesce(b, 0)))"""


@query(f"{BAG} SELECT doc_id, word, missing FROM d")
def word_bag_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that both readings of an edited copy hold less often than its source: one lacks the last three words of every tenth line, the
    other the first three."""
    words = F.filter(F.split("text", r"[ \t\n]+"), lambda w: w != "")
    w = lines(spark, sf_dir).select("doc_id", "pos", words.alias("ws"))
    source = w.select("doc_id", F.explode("ws").alias("word"))
    read = w.filter("pos % 17 <> 16").select("doc_id", (F.col("pos") % 10 == 9).alias("cut"), F.size("ws").alias("n"), F.posexplode("ws").alias("i", "word"))
    read = read.select("doc_id", "word", (~F.col("cut") | (F.col("i") < F.col("n") - 3)).alias("in_first"), (~F.col("cut") | (F.col("i") >= 3)).alias("in_second"))
    return J.bag_difference(source, read)


@query(
    f"""{BAG}, m AS (SELECT doc_id, pos, unnest(list_distinct(ws)) AS word FROM source),
c AS (SELECT doc_id, pos, count(*)::BIGINT AS n_missing FROM m JOIN d USING (doc_id, word) GROUP BY ALL)
SELECT doc_id, max(n_missing) AS n_missing, min(pos) FILTER (n_missing = top)::BIGINT AS pos
FROM (SELECT *, max(n_missing) OVER (PARTITION BY doc_id) AS top FROM c) GROUP BY doc_id"""
)
def worst_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line with the most distinct missing words, the first on ties."""
    source, _ = _edited(spark, sf_dir)
    missing = word_bag_diff(spark, sf_dir).select("doc_id", "word")
    words = source.select("doc_id", "pos", F.explode(F.array_distinct("ws")).alias("word"))
    each = words.join(missing, ["doc_id", "word"], "left_semi").groupBy("doc_id", "pos").agg(F.count(F.lit(1)).alias("n"))
    best = each.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("pos")).alias("p"))).alias("b"))
    return best.select("doc_id", F.col("b.n").alias("n_missing"), (-F.col("b.p")).cast("long").alias("pos"))


@query(
    f"""WITH RECURSIVE {EDITED}, p AS (SELECT doc_id, unnest(a) AS word, unnest(range(len(a))) AS i FROM (SELECT doc_id, flatten(list(ws ORDER BY pos)) AS a FROM edited GROUP BY doc_id)),
r AS (SELECT s.doc_id, s.pos, p.i AS start, 1 AS n FROM source s JOIN p ON p.doc_id = s.doc_id AND p.word = s.ws[1]
  UNION ALL SELECT r.doc_id, r.pos, r.start, n + 1 FROM r JOIN source s ON s.doc_id = r.doc_id AND s.pos = r.pos JOIN p ON p.doc_id = r.doc_id AND p.i = r.start + n AND p.word = s.ws[n + 1]),
b AS (SELECT doc_id, pos, max(n) AS best FROM r GROUP BY ALL)
SELECT s.doc_id, s.pos::BIGINT AS line, len(ws)::BIGINT AS want, coalesce(best, 0)::BIGINT AS best,
  CASE WHEN coalesce(best, 0) >= len(ws) THEN 'whole' WHEN best >= 4 AND best >= 0.5 * len(ws) THEN 'cut' ELSE 'gone' END AS verdict FROM source s LEFT JOIN b ON b.doc_id = s.doc_id AND b.pos = s.pos"""
)
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source line still stands whole in the edited copy, is cut, or is gone.  In SQL every place of a line's first word is
    followed word by word."""
    source, edited = _edited(spark, sf_dir)
    s = source.select("doc_id", F.col("pos").alias("line"), F.posexplode("ws").alias("i", "word"))
    text = edited.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ws"))), lambda x: x["ws"])).alias("all"))
    p = text.select("doc_id", F.posexplode("all").alias("i", "word"))
    return longs(J.verdict_of_runs(J.longest_runs(s, p)), "line", "want", "best")


#: Questions from lines, eight lines each: a stem, two options, an answer, four lines of text.  In every fifth document the third
#: answer names no option, in every seventh the second one is missing.
QUIZ = """CASE pos % 8 WHEN 0 THEN '**' || (pos div 8 + 1) || '.** ' || text WHEN 1 THEN '**A.** one' WHEN 2 THEN '**B.** two'
  WHEN 3 THEN CASE WHEN doc_id % 5 = 0 AND pos div 8 = 2 THEN '**3.** C — x' WHEN doc_id % 7 = 0 AND pos div 8 = 1 THEN 'none' ELSE '**' || (pos div 8 + 1) || '.** B – since' END ELSE 'text ' || text END"""


@query(
    f"""WITH {LINES}, q AS (SELECT doc_id, pos, {QUIZ.replace("div", "//")} AS text FROM lines),
a AS (SELECT doc_id, pos, text, nullif(regexp_extract(text, '^\\*\\*([0-9]+)\\.\\*\\*\\s*([A-Z])\\s*[—–-]\\s*(.+)$', 1), '') AS a_no, regexp_extract(text, '^\\*\\*([0-9]+)\\.\\*\\*\\s*([A-Z])\\s*[—–-]\\s*(.+)$', 2) AS a_letter,
  nullif(regexp_extract(text, '^\\*\\*([0-9]+)\\.\\*\\*\\s*(.+)$', 1), '') AS s_no, nullif(regexp_extract(text, '^\\*\\*([A-Z])\\.\\*\\*\\s*(.+)$', 1), '') AS letter FROM q),
n AS (SELECT *, last_value(CASE WHEN a_no IS NULL THEN s_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS number FROM a),
s AS (SELECT doc_id, s_no AS number, arg_min(text, pos) AS stem FROM n WHERE s_no IS NOT NULL AND a_no IS NULL GROUP BY ALL),
o AS (SELECT doc_id, number, list_sort(list(DISTINCT letter)) AS letters FROM n WHERE letter IS NOT NULL AND number IS NOT NULL GROUP BY ALL),
w AS (SELECT doc_id, a_no AS number, arg_min(a_letter, pos) AS answer FROM n WHERE a_no IS NOT NULL GROUP BY ALL),
j AS (SELECT s.doc_id, s.number, stem, letters, answer, coalesce(list_contains(letters, answer), false) AS ok FROM s LEFT JOIN o USING (doc_id, number) LEFT JOIN w USING (doc_id, number)),
g AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, bool_and(ok) OVER (PARTITION BY doc_id) AS good FROM j)
SELECT doc_id, number::BIGINT AS number, stem, array_to_string(letters, '') AS letters, answer FROM g WHERE n >= 3 AND good"""
)
def question_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems, options and answers joined on the number, all or nothing per document."""
    return J.lift_questions(lines(spark, sf_dir).withColumn("text", F.expr(QUIZ)))


def _windows(text: Column, n: int) -> Column:
    """All stretches of ``n`` characters."""
    windows = lambda chars: F.transform(F.sequence(F.lit(1), F.greatest(F.size(chars) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(chars, i, F.lit(n)), ""))
    return once(F.split(text, ""), windows)  # cut once: a place in a string is counted from its begin


@query(
    """WITH b AS (SELECT item_id, substring(text, 1, 40) AS head FROM benchmark WHERE text <> ''),
l AS (SELECT doc_id, unnest(range(len(x)))::BIGINT AS pos, unnest(x) AS text, len(x) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
h AS (SELECT item_id, doc_id, min(pos) AS pos, max(n) AS n FROM b JOIN l ON contains(text, head) GROUP BY ALL)
SELECT item_id, doc_id, pos, greatest(pos - 2, 0)::BIGINT AS context_from, least(pos + 11, n - 1)::BIGINT AS context_to FROM h"""
)
def substring_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each document that holds the opening (40 characters, or all) of a benchmark item, and the lines around it.

    A word that stands between two spaces of an opening stands so in every line that holds it.  So lines meet items on the longest such word, where
    they lie, and no other word becomes a row that is kept.  An opening without one meets lines on windows of twelve characters, or of as many as it has.
    """
    heads = table(spark, sf_dir, "benchmark").filter("text <> ''").select("item_id", F.substring("text", 1, 40).alias("head"))
    inner = F.filter(F.split("head", " ", -1), lambda w, k: (k > 0) & (k < F.size(F.split("head", " ", -1)) - 1) & (w != ""))
    heads = heads.withColumn("key", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    split = F.posexplode(F.split("text", "\n")).alias("pos", "text")
    found = table(spark, sf_dir, "documents").select("doc_id", (F.size(F.split("text", "\n")) - 1).alias("last"), split).filter("text <> ''")
    met = [found.select("doc_id", "last", "pos", "text", F.explode(F.split("text", " ", -1)).alias("key")).join(J.small(heads.filter("key IS NOT NULL")), "key")]
    rest = heads.filter("key IS NULL").withColumn("key", F.substring("head", 1, 12))
    for n in [r[0] for r in rest.select(F.length("key")).distinct().collect()]:  # at most twelve
        of = J.small(rest.filter(F.length("key") == n))
        met.append(found.select("doc_id", "last", "pos", "text", F.explode(F.array_distinct(_windows(F.col("text"), n))).alias("key")).join(of, "key"))
    out = None
    for rows in met:
        hit = rows.filter(F.contains("text", F.col("head"))).select("item_id", "doc_id", "pos", "last")
        out = hit if out is None else out.unionByName(hit)
    out = out.groupBy("item_id", "doc_id").agg(F.min("pos").alias("pos"), F.max("last").alias("last"))
    out = out.select("item_id", "doc_id", "pos", F.greatest(F.col("pos") - 2, F.lit(0)).alias("context_from"), F.least(F.col("pos") + 11, "last").alias("context_to"))
    return longs(out, "pos", "context_from", "context_to")
