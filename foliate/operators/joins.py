"""Joins that keep order, near misses and leftovers: recursive, two-hop, as-of, fallback, prefix, bag and sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def inherited_levels(styles: DataFrame) -> DataFrame:
    """Each style's own level, else that of the nearest style it is based on, at any length of the chain; null where the chain ends
    or runs in a circle without one.

    ``styles`` is (style, level, based_on).  Pointers are doubled: after k rounds a row knows the nearest level within 2^k steps and
    who comes next, so the rounds are the logarithm of the longest chain.  Only rows without a level and with a next style stay open; when
    a round resolves none and no pointer is left that was not seen, what is open is a circle.
    """
    rows = styles.select("style", F.col("level").cast("int").alias("level"), F.col("based_on").cast("string").alias("next"))
    rounds = max(1, rows.count()).bit_length() + 1  # no chain is longer than there are styles
    for _ in range(rounds):
        above = rows.select(F.col("style").alias("__s"), F.col("level").alias("__l"), F.col("next").alias("__n"))
        open_ = F.col("level").isNull() & F.col("next").isNotNull()
        joined = rows.join(above, open_ & (F.col("next") == F.col("__s")), "left")
        rows = joined.select("style", F.coalesce("level", "__l").alias("level"), F.when(F.coalesce("level", "__l").isNull(), F.col("__n")).alias("next"))
        rows = cut(rows)  # its plan would double each round
        if rows.filter("level IS NULL AND next IS NOT NULL").isEmpty():
            break
    return rows.select("style", "level")


def list_formats(paragraphs: DataFrame, numbers: DataFrame, formats: DataFrame) -> DataFrame:
    """Two hops: a paragraph's number id to an abstract list, that and the level to a format; a bullet if either
    misses."""
    return (
        paragraphs.join(numbers, "num_id", "left")
        .join(formats, ["abstract_id", "ilvl"], "left")
        .select("para_id", "num_id", "ilvl", F.coalesce("format", F.lit("bullet")).alias("format"))
    )


def drained_before(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """Range join by a merge: each point goes to the first block of its document that ends after it.

    Points and block ends are one sorted sequence per document, and a point takes the next end: no pairs are made.
    """
    both = points.select("doc_id", "at", F.lit(0).alias("kind"), "point_id", F.lit(None).cast("long").alias("block_id")).unionByName(
        blocks.select("doc_id", F.col("end").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("point_id"), "block_id")
    )
    # from the end: a frame that grows is linear
    ahead = Window.partitionBy("doc_id").orderBy(F.desc("at"), "kind", F.desc("block_id")).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("into", F.last("block_id", True).over(ahead)).filter("kind = 0").select("doc_id", "point_id", "into")


def with_fallback(left: DataFrame, right: DataFrame, key: str, fallback: str, value: str) -> DataFrame:
    """Left join on ``key``; rows whose key is not there are matched on ``fallback``, where its first row counts."""
    exact = right.select(key, F.col(value).alias("__exact"))
    first = right.groupBy(fallback).agg(F.min(value).alias("__first"))
    return (
        left.join(exact, key, "left")
        .join(first, fallback, "left")
        .withColumn(value, F.coalesce("__exact", "__first"))
        .withColumn("how", F.when(F.col("__exact").isNotNull(), "key").when(F.col("__first").isNotNull(), "name").otherwise("none"))
        .drop("__exact", "__first")
    )


#: Rows up to which a counted table is broadcast.
BROADCAST_ROWS = 500_000


def small(table: DataFrame) -> DataFrame:
    """``table`` marked for a broadcast if it has few rows; else joins shuffle it."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def first_prefix(rows: DataFrame, titles: DataFrame, text: str = "text") -> DataFrame:
    """Each row with the first title (by ``ord``) whose prefix it begins with.

    Rows meet titles on the length of a prefix and the text up to it, an equi join; the number of lengths is what
    multiplies the rows, not the number of titles.
    """
    lengths = titles.select(F.length("prefix").alias("__n")).distinct().agg(F.array_sort(F.collect_list("__n")).alias("__lengths"))
    cut = rows.select("row_id", F.col(text).alias("__t")).join(F.broadcast(lengths))  # one row: an array of lengths
    fit = F.filter("__lengths", lambda n: n <= F.length("__t"))
    candidates = cut.select("row_id", F.explode(F.transform(fit, lambda n: F.col("__t").substr(F.lit(1), n))).alias("prefix"))
    hit = candidates.join(small(titles), "prefix").groupBy("row_id").agg(F.min_by("title", "ord").alias("title"))
    return rows.join(hit, "row_id", "left")


def unused_prefixes(rows: DataFrame, titles: DataFrame, text: str = "text") -> DataFrame:
    """The titles that no row took."""
    return titles.join(first_prefix(rows, titles, text).select("title").distinct(), "title", "left_anti")


def reconcile(asked: DataFrame, answered: DataFrame) -> DataFrame:
    """What was asked for against what came back, by name: uploaded, failed (also when unnamed) or volunteered."""
    both = asked.select("name", F.lit(True).alias("__asked")).join(
        answered.select("name", "ok", F.lit(True).alias("__answered")), "name", "full_outer"
    )
    status = (
        F.when(F.col("__asked").isNull(), "volunteered")
        .when(F.coalesce("ok", F.lit(False)), "uploaded")
        .otherwise("failed")
    )
    return both.select("name", status.alias("status"))


def bag_difference(source: DataFrame, readings: DataFrame) -> DataFrame:
    """Words that occur more often in ``source`` than in the better of two readings, and by how much.

    ``source`` is (doc_id, word), ``readings`` (doc_id, word, in_first, in_second); all three are counted in one pass, so a word of a document
    goes through one shuffle once, combined before it.
    """
    none, yes = F.lit(False), F.lit(True)
    each = source.select("doc_id", "word", yes.alias("own"), none.alias("a"), none.alias("b")).unionByName(
        readings.select("doc_id", "word", none.alias("own"), F.col("in_first").alias("a"), F.col("in_second").alias("b"))
    )
    n = each.groupBy("doc_id", "word").agg(*[F.count_if(c).cast("int").alias(c) for c in ("own", "a", "b")])
    best = F.when(F.col("doc_id").isNull() | F.col("word").isNull(), 0).otherwise(F.greatest("a", "b"))  # a null meets nothing
    return n.filter(F.col("own") > best).select("doc_id", "word", (F.col("own") - best).cast("long").alias("missing"))


def longest_runs(source: DataFrame, published: DataFrame) -> DataFrame:
    """Per source line: its words and the longest run of them, from its first word on, that stands in ``published``.

    ``source`` is (doc_id, line, i, word), ``published`` (doc_id, i, word), i counting from 0; no word holds a space.  A document's published words
    are one string, parted by spaces, and a run stands there if its own string does.  As a longer run holds the shorter ones, a line that does not
    stand whole is halved: as many searches as its count of words has binary digits.  Every word goes through one shuffle, by its document.
    """
    said = lambda *order: F.array_sort(F.collect_list(F.struct(*order, "word")))
    joined = lambda ws: F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" "))
    words = lambda c: F.transform(c, lambda x: x["word"])
    lines = source.repartition("doc_id").groupBy("doc_id", "line").agg(said("i").alias("p")).select("doc_id", "line", words("p").alias("ws"))
    texts = published.repartition("doc_id").groupBy("doc_id").agg(said("i").alias("p")).select("doc_id", joined(words("p")).alias("all"))
    stands = lambda k: F.contains("all", joined(F.slice("ws", F.lit(1), k)))
    want = F.size("ws")

    def halved(a: Column) -> Column:
        mid = ((a["lo"] + a["hi"] + 1) / 2).cast("int")
        found = F.when(stands(mid), F.struct(mid.alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), (mid - 1).alias("hi")))
        return F.when(a["lo"] < a["hi"], found).otherwise(a)

    rounds = F.sequence(F.lit(1), F.length(F.bin(want.cast("long"))))
    part = F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), (want - 1).alias("hi")), lambda a, _: halved(a), lambda a: a["lo"])
    best = F.when(F.col("all").isNull(), 0).when(F.contains("all", joined(F.col("ws"))), want).otherwise(part)
    return lines.join(texts, "doc_id", "left").select("doc_id", "line", want.cast("long").alias("want"), best.cast("long").alias("best"))


def verdict_of_runs(runs: DataFrame, least: int = 4, share: float = 0.5) -> DataFrame:
    """whole, cut (a good part stands there, the rest is missing: a failure) or gone (a note)."""
    return runs.withColumn(
        "verdict",
        F.when(F.col("best") >= F.col("want"), "whole")
        .when((F.col("best") >= least) & (F.col("best") >= share * F.col("want")), "cut")
        .otherwise("gone"),
    )


#: Forms of a question's stem, option and answer (fixed values); an answer looks like a stem up to its letter and dash.
STEM, OPTION = r"^\*\*([0-9]+)\.\*\*\s*(.+)$", r"^\*\*([A-Z])\.\*\*\s*(.+)$"
ANSWER = r"^\*\*([0-9]+)\.\*\*\s*([A-Z])\s*[—–-]\s*(.+)$"


def lift_questions(lines: DataFrame, least: int = 3) -> DataFrame:
    """Numbered stems with lettered options and numbered answers, joined on the number; all or nothing per document.

    A document's questions are lifted only if there are ``least`` of them, every stem has an answer and every answer's
    letter is one of the options.
    """
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    answer_no, answer_letter = (F.regexp_extract("text", ANSWER, k) for k in (1, 2))
    stem_no = F.when(answer_no == "", F.regexp_extract("text", STEM, 1)).otherwise("")
    letter = F.regexp_extract("text", OPTION, 1)
    rows = lines.select(
        "doc_id", "pos", "text", answer_no.alias("a_no"), answer_letter.alias("a_letter"), stem_no.alias("s_no"), letter.alias("letter")
    )
    rows = rows.withColumn("number", F.last(F.when(F.col("s_no") != "", F.col("s_no")), True).over(order))
    stems = rows.filter("s_no <> ''").groupBy("doc_id", F.col("s_no").alias("number")).agg(F.min_by("text", "pos").alias("stem"))
    options = rows.filter("letter <> '' and number is not null").groupBy("doc_id", "number").agg(F.array_sort(F.collect_set("letter")).alias("letters"))
    answers = rows.filter("a_no <> ''").groupBy("doc_id", F.col("a_no").alias("number")).agg(F.min_by("a_letter", "pos").alias("answer"))
    q = stems.join(options, ["doc_id", "number"], "left").join(answers, ["doc_id", "number"], "left")
    good = F.coalesce(F.array_contains("letters", F.col("answer")), F.lit(False))
    each = Window.partitionBy("doc_id")
    q = q.withColumns({"n": F.count(F.lit(1)).over(each), "ok": F.min(good.cast("int")).over(each)})
    return q.filter((F.col("n") >= least) & (F.col("ok") == 1)).select(
        "doc_id", F.col("number").cast("long").alias("number"), "stem", F.array_join("letters", "").alias("letters"), "answer"
    )
