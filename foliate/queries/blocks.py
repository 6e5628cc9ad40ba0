"""Queries over blocks, bytes, packing and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..session import table
from . import query
from .fixtures import LINES, MARKED, lines, marked
from .lines import longs


@query(
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, kind ORDER BY turn) AS g
  FROM (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 2 THEN 'b' ELSE 'a' END AS kind FROM conversations))
SELECT conv_id, kind, min(turn) AS first, count(*)::BIGINT AS n, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn, text)) AS body FROM s GROUP BY conv_id, kind, g"""
)
def callout_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of one kind as one block; turns stand for blocks."""
    kind = F.when(F.col("turn") % 3 == 2, "b").otherwise("a")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", kind.alias("kind"))
    return B.merge_neighbours(c, "conv_id", "turn", "kind", "text").withColumn("body", F.md5(F.col("body").cast("binary")))


@query(
    """SELECT conv_id, role, arg_min(text, turn) AS title, count(*)::BIGINT AS n, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS body
FROM conversations GROUP BY conv_id, role"""
)
def flag_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of one kind as one block, the first one's text its title."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", "text")
    return B.merge_kinds(c, ["conv_id", "role"], "turn", "text").withColumn("body", F.md5(F.col("body").cast("binary")))


@query(
    """WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)
  - row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS g FROM orders)
SELECT o_custkey, o_orderstatus, min(o_orderkey) AS first, count(*)::BIGINT AS n FROM r GROUP BY o_custkey, o_orderstatus, g HAVING count(*) >= 3"""
)
def rule_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three or more of one kind; orders stand for rules."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    runs = B.islands(o, "o_custkey", "o_orderkey", "o_orderstatus").groupBy("o_custkey", "o_orderstatus", "island")
    return runs.agg(F.min("o_orderkey").alias("first"), F.count(F.lit(1)).alias("n")).filter("n >= 3").drop("island")


@query(
    f"""WITH {MARKED}, r AS (SELECT doc_id, pos, regexp_replace(trim(text, ' '), '^\\||\\|$', '', 'g') AS t FROM marked WHERE starts_with(text, '|'))
SELECT doc_id, pos::BIGINT AS pos, len(string_split(t, '|'))::BIGINT AS n_cells, trim(string_split(t, '|')[1], ' ') AS head,
  len(list_filter(string_split(t, '|'), lambda c: NOT regexp_matches(trim(c, ' '), '^:?-+:?$'))) = 0 AS separator FROM r"""
)
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = marked(spark, sf_dir).filter(F.col("text").startswith("|")).select("doc_id", "pos", B.table_cells("text").alias("cells"))
    out = rows.select("doc_id", "pos", F.size("cells").alias("n_cells"), F.get("cells", 0).alias("head"), B.is_separator(F.col("cells")).alias("separator"))
    return longs(out, "pos", "n_cells")


@query(
    f"""WITH RECURSIVE {LINES}, w AS (SELECT doc_id, pos, len(list_filter(string_split_regex(text, '[ \\t]+'), lambda w: w <> '')) AS n FROM lines),
t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM w), f AS (
  SELECT doc_id, pos, 0 AS part, n AS held FROM t WHERE pos = 0
  UNION ALL SELECT t.doc_id, t.pos, part + CASE WHEN total > 460 AND t.pos % 4 = 0 AND held >= 230 THEN 1 ELSE 0 END,
    CASE WHEN total > 460 AND t.pos % 4 = 0 AND held >= 230 THEN 0 ELSE held END + n FROM f JOIN t ON t.doc_id = f.doc_id AND t.pos = f.pos + 1
) SELECT doc_id, pos::BIGINT AS pos, part::BIGINT AS part FROM f"""
)
def prose_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long prose in parts; every fourth line stands for a lead.  In SQL each line adds to what the one before holds."""
    words = F.size(F.filter(F.split("text", r"[ \t]+"), lambda w: w != ""))
    p = lines(spark, sf_dir).select("doc_id", "pos", words.alias("n_words"), (F.col("pos") % 4 == 0).alias("is_lead"))
    return longs(B.split_long(p), "pos", "part")


@query(
    """WITH RECURSIVE e AS (SELECT event_type || '/' || hour(ts) AS queue, event_id, greatest(round(value), 0)::BIGINT AS size FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY event_id) AS k FROM e), f AS (
  SELECT queue, event_id, k, 0 AS batch, 1 AS n, size AS held FROM n WHERE k = 1
  UNION ALL SELECT n.queue, n.event_id, n.k, batch + CASE WHEN held + size > 500 OR f.n >= 50 THEN 1 ELSE 0 END, CASE WHEN held + size > 500 OR f.n >= 50 THEN 1 ELSE f.n + 1 END,
    CASE WHEN held + size > 500 OR f.n >= 50 THEN size ELSE held + size END FROM f JOIN n ON n.queue = f.queue AND n.k = f.k + 1
) SELECT queue, event_id, batch::BIGINT AS batch FROM f"""
)
def bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of events by value and count, a queue per type and hour of the day.  In SQL each entry adds to what the one before holds."""
    queue = F.concat_ws("/", "event_type", F.hour("ts").cast("string"))
    e = table(spark, sf_dir, "events").select("event_id", queue.alias("queue"), F.greatest(F.round("value"), F.lit(0.0)).cast("long").alias("size"))
    return longs(B.pack_batches(e, "queue", "event_id", "size", 500, 50), "batch")


@query(
    """WITH s AS (SELECT p_size AS size, sum(length(p_name))::BIGINT AS chars FROM part GROUP BY p_size),
body AS (SELECT arg_max(size, chars * 1000 - size) AS body FROM s)
SELECT size, chars, dense_rank() OVER (ORDER BY size DESC)::BIGINT AS level FROM s, body WHERE size > body ORDER BY size DESC LIMIT 6"""
)
def body_size_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body size: the one with the most characters; the six largest sizes above it are heading levels."""
    sizes = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("size")).agg(F.sum(F.length("p_name")).alias("chars"))
    body = sizes.agg(F.max_by("size", F.struct("chars", (-F.col("size")).alias("o"))).alias("body"))
    top = sizes.join(F.broadcast(body), F.col("size") > F.col("body")).orderBy(F.desc("size")).limit(6)
    return top.select("size", "chars", F.dense_rank().over(Window.orderBy(F.desc("size"))).cast("long").alias("level"))


@query(
    """WITH f AS (SELECT doc_id, replace(text, chr(10), ' Page ' || (n_chars % 7) || ' of ' || (n_chars % 11) || chr(10)) AS t FROM documents)
SELECT doc_id, list_max(list_transform(regexp_extract_all(t, 'Page ([0-9]+) of [0-9]+', 1), lambda x: x::BIGINT)) AS seen,
  list_transform(regexp_extract_all(t, 'Page [0-9]+ of ([0-9]+)', 1), lambda x: x::BIGINT)[-1] AS declared FROM f"""
)
def page_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest page seen and the last total declared."""
    footer = F.concat(F.lit(" Page "), (F.col("n_chars") % 7).cast("string"), F.lit(" of "), (F.col("n_chars") % 11).cast("string"), F.lit("\n"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), footer).alias("t"))
    numbers = lambda g: F.regexp_extract_all("t", F.lit("Page ([0-9]+) of ([0-9]+)"), F.lit(g)).cast("array<bigint>")
    return d.select("doc_id", F.array_max(numbers(1)).alias("seen"), F.try_element_at(numbers(2), F.lit(-1)).alias("declared"))


@query(
    f"""WITH {LINES} SELECT text, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS n_docs FROM lines WHERE text <> '' GROUP BY text HAVING count(*) > 1"""
)
def dup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that occur more than once: here whole lines."""
    keyed = lines(spark, sf_dir).filter("text <> ''").groupBy("text")
    return keyed.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs")).filter("n > 1")


FINDINGS = """f AS (SELECT event_id AS id, user_id AS unit, CASE event_id % 3 WHEN 0 THEN 'note' WHEN 1 THEN 'warning' ELSE 'error' END AS severity,
  CASE WHEN event_id % 5 < 3 THEN 'done' WHEN event_id % 5 = 3 THEN 'accepted' ELSE 'open' END AS state,
  CASE WHEN event_id % 2 = 0 THEN 'reason' ELSE ' ' END AS why FROM events)"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    m3, m5 = F.col("event_id") % 3, F.col("event_id") % 5
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("unit"),
        F.when(m3 == 0, "note").when(m3 == 1, "warning").otherwise("error").alias("severity"),
        F.when(m5 < 3, "done").when(m5 == 3, "accepted").otherwise("open").alias("state"),
        F.when(F.col("event_id") % 2 == 0, "reason").otherwise(" ").alias("why"),
    )


@query(
    f"""WITH {FINDINGS} SELECT unit, id, severity, place::BIGINT AS place FROM (SELECT *, row_number() OVER (PARTITION BY unit
  ORDER BY CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END, id) AS place FROM f) WHERE place <= 3"""
)
def severity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(B.worst_first(_findings(spark, sf_dir), "unit"), "place").select("unit", "id", "severity", "place")


@query(
    f"""WITH {FINDINGS} SELECT unit, bool_and(state = 'done' OR (state = 'accepted' AND trim(why) <> '')) AS may_publish,
  count(*) FILTER (NOT (state = 'done' OR (state = 'accepted' AND trim(why) <> '')))::BIGINT AS n_open FROM f GROUP BY unit"""
)
def publish_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.may_publish(_findings(spark, sf_dir), "unit")


#: First bytes (hexadecimal) that are put before a text, by its id mod 9; and images that are whole, cut, or padded.
HEADS = ("255044462D", "504B0304", "D0CF11E0A1B11AE1", "FFD8FF", "89504E470D0A1A0A", "7B5C727466", "FFFE", "", "0001020304")
TAILS = ("", "FFD9", "FFD90000", "49454E44AE426082")
BYTES = f"""[{", ".join(f"'{h}'" for h in HEADS)}][doc_id % 9 + 1] || hex(encode(substring(text, 1, 40))) || [{", ".join(f"'{t}'" for t in TAILS)}][doc_id // 9 % 4 + 1]"""


@query(
    f"""WITH b AS (SELECT doc_id, text, {BYTES} AS h FROM documents)
SELECT doc_id, CASE WHEN starts_with(h, '25504446') THEN 'pdf' WHEN starts_with(h, '504B0304') THEN 'zip' WHEN starts_with(h, 'D0CF11E0') THEN 'ole' WHEN starts_with(h, 'FFD8FF') THEN 'jpeg'
  WHEN starts_with(h, '89504E47') THEN 'png' WHEN starts_with(h, '7B5C7274') THEN 'rtf' WHEN doc_id % 9 = 7 AND doc_id // 9 % 4 = 0 AND length(text) > 0 THEN 'text' ELSE 'unknown' END AS kind,
  CASE WHEN starts_with(h, 'FFD8FF') THEN regexp_matches(h, 'FFD9(?:00)*$') WHEN starts_with(h, '89504E47') THEN ends_with(h, '49454E44AE426082') END AS whole FROM b"""
)
def sniff_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds by first bytes, and whether images are whole."""
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), k.cast("int"))
    d = table(spark, sf_dir, "documents")
    h = F.concat(pick(HEADS, F.col("doc_id") % 9 + 1), F.hex(F.encode(F.substring("text", 1, 40), "UTF-8")), pick(TAILS, F.expr("doc_id div 9 % 4 + 1")))
    f = d.select("doc_id", F.unhex(h).alias("content"))
    return f.select("doc_id", B.sniff("content").alias("kind"), B.image_whole("content").alias("whole"))


@query(
    """WITH a AS (SELECT l_orderkey, o_totalprice::BIGINT AS size, list({'name': CASE l_partkey % 50 WHEN 0 THEN 'a/../../b' WHEN 1 THEN '/etc/x' WHEN 2 THEN 'C:x' ELSE 'word/' || l_linenumber || '..xml' END,
  'bytes': l_quantity::BIGINT * l_quantity::BIGINT * l_quantity::BIGINT * 3000}) AS e FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, o_totalprice)
SELECT l_orderkey, CASE WHEN len(list_filter(e, lambda x: x.name IN ('a/../../b', '/etc/x', 'C:x'))) > 0 THEN 'name' WHEN list_sum(list_transform(e, lambda x: x.bytes)) > 536870912 THEN 'size'
  WHEN list_sum(list_transform(e, lambda x: x.bytes)) > 200 * size AND list_sum(list_transform(e, lambda x: x.bytes)) > 67108864 THEN 'ratio' END AS reason FROM a"""
)
def zip_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why archives must not be unpacked; an order's lines stand for an archive's entries."""
    k = F.col("l_partkey") % 50
    name = F.when(k == 0, "a/../../b").when(k == 1, "/etc/x").when(k == 2, "C:x").otherwise(F.concat(F.lit("word/"), F.col("l_linenumber").cast("string"), F.lit("..xml")))
    q = F.col("l_quantity").cast("long")
    e = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(name.alias("name"), (q * q * q * 3000).alias("uncompressed"))).alias("entries"))
    size = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.expr("cast(round(o_totalprice) AS long)").alias("size"))
    return e.join(size, "l_orderkey").select("l_orderkey", B.zip_reason(F.col("entries"), F.col("size")).alias("reason"))
