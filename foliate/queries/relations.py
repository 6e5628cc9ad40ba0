"""Queries of joins whose misses matter.  Orders, parts and customers stand for pictures, relationships and cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relations as R
from ..session import table
from . import query
from .fixtures import LINES, lines

REFS = "refs AS (SELECT l_orderkey, l_linenumber::BIGINT AS line, CASE WHEN l_linenumber % 3 = 0 THEN -l_partkey ELSE l_partkey END AS rid FROM lineitem), rels AS (SELECT p_partkey AS rid, p_name AS file FROM part)"


def _refs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    gone = F.when(F.col("l_linenumber") % 3 == 0, -F.col("l_partkey")).otherwise(F.col("l_partkey"))
    refs = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), gone.alias("rid"))
    return refs, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rid"), F.col("p_name").alias("file"))


@query(f"WITH {REFS} SELECT l_orderkey, line, rid, file FROM refs JOIN rels USING (rid)")
def picture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures with the file of their relationship; those without one are dropped."""
    return R.resolve(*_refs(spark, sf_dir), "rid").select("l_orderkey", "line", "rid", "file")


@query(f"WITH {REFS} SELECT l_orderkey, line, rid, file FROM refs LEFT JOIN rels USING (rid)")
def picture_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pictures; the file is null where the relationship is missing."""
    return R.resolve(*_refs(spark, sf_dir), "rid", keep_missing=True).select("l_orderkey", "line", "rid", "file")


@query(
    """WITH s AS (SELECT o_custkey AS unit, substring(o_orderpriority, 1, 1) AS anchor, o_orderkey FROM orders),
b AS (SELECT c_custkey AS unit, CAST(c_nationkey % 6 AS VARCHAR) AS anchor, c_name AS supplied FROM customer) SELECT o_orderkey, s.unit, s.anchor, supplied FROM s LEFT JOIN b ON s.unit = b.unit AND s.anchor = b.anchor"""
)
def supplied_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was supplied for a unit's anchor, if anything."""
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), F.substring("o_orderpriority", 1, 1).alias("anchor"), "o_orderkey")
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit"), (F.col("c_nationkey") % 6).cast("string").alias("anchor"), F.col("c_name").alias("supplied"))
    return s.join(b, ["unit", "anchor"], "left").select("o_orderkey", "unit", "anchor", "supplied")


@query(
    """SELECT 'shared' AS pair, count(*)::BIGINT AS n_common, count(*) = 0 AS disjoint FROM (SELECT text FROM benchmark INTERSECT SELECT text FROM conversations) UNION ALL
SELECT 'keys', count(*)::BIGINT, count(*) = 0 FROM (SELECT doc_id AS k FROM documents INTERSECT SELECT doc_id FROM labels WHERE toxic = 1)"""
)
def exam_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two banks share a text (they must not), and two tables a key."""
    a = R.common(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "conversations"), "text")
    b = R.common(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id")
    return a.withColumn("pair", F.lit("shared")).unionByName(b.withColumn("pair", F.lit("keys")))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def unit_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strict lookup: an unknown key would be an error."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("key"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), "n_name")
    return R.strict(c, n, "key").select("c_custkey", "n_name")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def glossary_of_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a glossary whose unit is kept."""
    kept = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("s_nationkey"))
    return table(spark, sf_dir, "supplier").join(kept, "s_nationkey", "left_semi").select("s_suppkey", "s_name")


@query("WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS id FROM orders) SELECT o_orderkey, id FROM c WHERE id NOT IN (SELECT c_custkey FROM customer)")
def cases_without_stimulus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases whose stimulus is not there."""
    c = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_custkey") + 1000000).otherwise(F.col("o_custkey")).alias("id"))
    return R.missing(c, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id").select("o_orderkey", "id")


@query(
    """WITH e AS (SELECT doc_id AS key, source || lang AS fp FROM documents), g AS (SELECT source || lang AS fp, min(doc_id) AS group_id FROM documents WHERE n_chars > 2500 GROUP BY 1),
r AS (SELECT doc_id AS key, CASE WHEN quality = 1 THEN doc_id END AS bound_to FROM labels)
SELECT e.key, group_id, CASE WHEN r.key IS NULL THEN 'no row' WHEN bound_to IS NOT NULL THEN 'bound before' WHEN group_id IS NULL THEN 'no group' ELSE 'bound' END AS status
FROM e LEFT JOIN g USING (fp) LEFT JOIN r ON r.key = e.key"""
)
def case_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries to groups by fingerprint and to rows by key."""
    d = table(spark, sf_dir, "documents").withColumn("fp", F.concat("source", "lang"))
    groups = d.filter("n_chars > 2500 AND fp IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("group_id"))
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.when(F.col("quality") == 1, F.col("doc_id")).alias("bound_to"))
    return R.bind(d.select(F.col("doc_id").alias("key"), "fp"), groups, rows)


@query("SELECT DISTINCT l_partkey AS part FROM lineitem EXCEPT SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 48")
def parts_not_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared parts that a second reading does not find in place."""
    declared = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), "l_returnflag", "l_quantity")
    return R.missing(declared.select("part").distinct(), declared.filter("l_returnflag = 'N' AND l_quantity > 48"), "part")


CHECKLIST = "(VALUES ('ends in five', '5$'), ('two words', '^[a-z]+ [a-z]+$'), ('a digit', '[0-9]'), ('nothing', 'zzzz')) AS c(item, pattern)"


@query(
    f"SELECT item, count(p_name)::BIGINT AS n, min(p_name) AS first FROM {CHECKLIST} LEFT JOIN part ON regexp_matches(p_name, pattern) GROUP BY item"
)
def checklist_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which file names each item of a checklist takes."""
    items = spark.sql(f"SELECT * FROM {CHECKLIST}")
    return R.first_by_pattern(items, table(spark, sf_dir, "part").select(F.col("p_name").alias("name")))


@query(
    """WITH i AS (SELECT p_partkey, ' ' || upper(p_type) || ' ' AS label FROM part), s AS (SELECT DISTINCT lower(p_type) AS label FROM part WHERE p_size > 45)
SELECT p_partkey, lower(trim(i.label)) IN (SELECT label FROM s) AS skipped FROM i"""
)
def recorded_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that were skipped, whatever their case."""
    p = table(spark, sf_dir, "part")
    skips = p.filter("p_size > 45").select(R.same_label("p_type").alias("label")).distinct().withColumn("__s", F.lit(True))
    items = p.select("p_partkey", R.same_label(F.concat(F.lit(" "), F.upper("p_type"), F.lit(" "))).alias("label"))
    return items.join(skips, "label", "left").select("p_partkey", F.coalesce("__s", F.lit(False)).alias("skipped"))


@query(
    f"""WITH {LINES}, h AS (SELECT doc_id, pos, '2.' || pos || ' ' || text || ' :' AS t FROM lines WHERE regexp_matches(text, '^[a-zA-Z]')),
n AS (SELECT doc_id, pos, lower(trim(regexp_replace(regexp_replace(t, '^[0-9]+(?:\\.[0-9]+)*[.)]?[ ]+', ''), '[ ]*:[ ]*$', ''), ' ')) AS name FROM h),
w AS (SELECT doc_id, pos, CASE WHEN pos % 2 = 0 THEN lower(trim(text, ' ')) ELSE 'no such heading' END AS name FROM lines WHERE regexp_matches(text, '^[a-zA-Z]') AND NOT regexp_matches(text, ':[ ]*$') AND pos % 5 = 0)
SELECT w.doc_id, w.pos::BIGINT AS wanted, min(n.pos)::BIGINT AS found FROM w LEFT JOIN n ON n.doc_id = w.doc_id AND n.name = w.name GROUP BY ALL"""
)
def named_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings asked for by name, found by their plain form; null: missed."""
    own = lines(spark, sf_dir).filter(F.col("text").rlike("^[a-zA-Z]"))
    named = own.select("doc_id", "pos", T.plain_heading(F.concat(F.lit("2."), F.col("pos").cast("string"), F.lit(" "), "text", F.lit(" :"))).alias("name"))
    wanted = own.filter(~F.col("text").rlike(":[ ]*\\z") & (F.col("pos") % 5 == 0))
    name = F.when(F.col("pos") % 2 == 0, F.lower(F.btrim("text"))).otherwise("no such heading")
    wanted = wanted.select("doc_id", F.col("pos").alias("wanted"), name.alias("name"))
    found = wanted.join(named, ["doc_id", "name"], "left").groupBy("doc_id", "wanted").agg(F.min("pos").alias("found"))
    return found.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("wanted", "found")])


@query("SELECT c_nationkey % 5 AS topic, r_name AS slug, count(o_orderkey)::BIGINT AS n_entries FROM customer JOIN region ON r_regionkey = c_nationkey % 5 LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def bank_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bank's topic to its slug and on to its entries."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 5).alias("topic"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("topic"), F.col("r_name").alias("slug"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return c.join(r, "topic").join(o, "c_custkey", "left").groupBy("topic", "slug").agg(F.count("o_orderkey").alias("n_entries"))


@query(
    """WITH a AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY 1), b AS (SELECT o_orderkey AS k, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0)::BIGINT AS n_left, coalesce(b.n, 0)::BIGINT AS n_right, (coalesce(a.n, 0) - coalesce(b.n, 0))::BIGINT AS difference FROM a FULL JOIN b ON a.k = b.k"""
)
def inventory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures against their markers, by count alone."""
    a = table(spark, sf_dir, "lineitem").filter("l_quantity > 10").select(F.col("l_orderkey").alias("k"))
    return R.counted(a, table(spark, sf_dir, "orders").filter("o_totalprice > 1000").select(F.col("o_orderkey").alias("k")), "k")


@query(
    """SELECT conv_id, turn, 0 AS rank FROM conversations WHERE role = 'system' UNION ALL SELECT conv_id, turn, 1 FROM conversations WHERE role = 'user'
UNION ALL SELECT conv_id, turn, 2 FROM conversations WHERE role = 'assistant'"""
)
def anchored_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of three kinds in a fixed order."""
    c = table(spark, sf_dir, "conversations")
    return R.in_order(*[c.filter(F.col("role") == r).select("conv_id", "turn") for r in ("system", "user", "assistant")])


@query(
    f"""WITH {LINES}, s AS (SELECT DISTINCT doc_id, text FROM lines WHERE pos % 9 <> 8) SELECT l.doc_id, count(*)::BIGINT AS n_published, count(*) FILTER (s.doc_id IS NULL)::BIGINT AS n_missing
FROM lines l LEFT JOIN s ON s.doc_id = l.doc_id AND s.text = l.text GROUP BY l.doc_id"""
)
def published_in_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that were published and that the source lacks."""
    every = lines(spark, sf_dir)
    return R.covers(every.filter("pos % 9 <> 8"), every, "doc_id", "text")


@query(
    f"""WITH {LINES}, f AS (SELECT doc_id, replace(replace(text, '’', ''''), '—', '-') AS t FROM documents), p AS (SELECT doc_id, pos, replace(replace(CASE WHEN pos % 6 = 5 THEN text || ' not there' ELSE text END, '’', ''''), '—', '-') AS t FROM lines)
SELECT p.doc_id, p.pos::BIGINT AS pos, contains(f.t, p.t) AS stands FROM p JOIN f USING (doc_id)"""
)
def paragraphs_stand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each paragraph stands in its source, both in one form of dashes and quotes.

    Paragraphs meet their source's lines on a hash; only what is no whole line would have to be sought in the text, and those lines
    are kept with their document by the same key.
    """
    form = lambda c: F.translate(c, "’—", "'-")
    every = lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), "text")
    p = every.select("doc_id", "pos", form(F.when(F.col("pos") % 6 == 5, F.concat("text", F.lit(" not there"))).otherwise(F.col("text"))).alias("t"))
    whole = every.select("doc_id", form(F.col("text")).alias("t")).distinct().withColumn("__whole", F.lit(True))
    marked = p.join(whole, ["doc_id", "t"], "left")
    f = table(spark, sf_dir, "documents").select("doc_id", form(F.col("text")).alias("__source"))
    rest = marked.filter("__whole IS NULL").join(f, "doc_id").select("doc_id", "pos", F.contains("__source", F.col("t")).alias("stands"))
    return marked.filter("__whole").select("doc_id", "pos", F.lit(True).alias("stands")).unionByName(rest)


@query(
    """WITH u AS (SELECT c_nationkey AS course, c_mktsegment || c_custkey AS title FROM customer), n AS (SELECT c_nationkey AS course, c_mktsegment || c_custkey AS title FROM customer WHERE c_nationkey % 2 = 0 AND c_acctbal > 5000),
f AS (SELECT c_mktsegment || c_custkey AS title FROM customer WHERE c_acctbal < 0)
SELECT course, title FROM u WHERE CASE WHEN course IN (SELECT course FROM n) THEN (course, title) IN (SELECT course, title FROM n) ELSE title NOT IN (SELECT title FROM f) END"""
)
def units_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units that a course names, or all but its front matter."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("course"), F.concat("c_mktsegment", F.col("c_custkey").cast("string")).alias("title"), "c_acctbal")
    u = c.select("course", "title")
    return R.chosen_units(u, c.filter("course % 2 = 0 AND c_acctbal > 5000").select("course", "title"), c.filter("c_acctbal < 0").select("title"))


@query(
    f"""WITH {LINES}, s AS (SELECT doc_id AS unit, pos, CASE pos % 3 WHEN 0 THEN '1.' || pos || ' ' WHEN 1 THEN '★ ' ELSE '' END || 'Part ' || pos // 4 || CASE WHEN pos % 5 = 0 THEN ' :' ELSE '' END AS heading FROM lines),
h AS (SELECT unit, 'part ' || pos // 4 AS plain, min(pos) AS pos, count(*) AS times FROM s GROUP BY ALL), w AS (SELECT doc_id AS unit, unnest(['PART 0:', '2. Part 1', 'Part 9']) AS heading, unnest(['part 0', 'part 1', 'part 9']) AS plain FROM documents)
SELECT w.unit, heading, h.pos::BIGINT AS pos, coalesce(times, 0)::BIGINT AS times FROM w LEFT JOIN h ON h.unit = w.unit AND h.plain = w.plain"""
)
def sections_by_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted sections of every document by their headings, which are written in several ways; misses are kept."""
    form = "concat(CASE pos % 3 WHEN 0 THEN concat('1.', pos, ' ') WHEN 1 THEN '★ ' ELSE '' END, 'Part ', pos div 4, CASE WHEN pos % 5 = 0 THEN ' :' ELSE '' END)"
    s = lines(spark, sf_dir).select(F.col("doc_id").alias("unit"), F.expr(form).alias("heading"), F.col("pos").cast("long").alias("pos"))
    w = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit"), F.explode(F.array(*[F.lit(x) for x in ("PART 0:", "2. Part 1", "Part 9")])).alias("heading"))
    return R.by_heading(s, w)
