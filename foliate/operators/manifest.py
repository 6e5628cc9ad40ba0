"""A course as one nested document: topics with their blocks and questions, and the map of units' keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = 1
#: The document as it is read back.
SCHEMA = (
    "version int, course struct<slug: string, programCode: string, title: string, topicTerm: string>, "
    "topics array<struct<number: int, slug: string, title: string, blocks array<struct<id: string, type: string, body: string>>, "
    "questions array<struct<key: string, stem: string, options array<struct<text: string, correct: boolean>>>>>>, "
    "glossary array<struct<term: string, definition: string>>"
).replace("blocks array", "blocks: array").replace("questions array", "questions: array").replace("options array", "options: array")
#: What stands for a picture until it is put in (fixed value).
PICTURE = r"\[FIGURE:([^\]]+)\]"


def _ordered(order: list[str], **columns: Column | str) -> Column:
    """The rows of a group as structs, in order; a group is one unit's."""
    values = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]
    rows = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*values).alias("v"))))
    return F.transform(rows, lambda r: r["v"])


def _filled(array: str) -> Column:
    """Null for an empty list, which is left out of the document."""
    return F.when(F.size(array) > 0, F.col(array))


def manifests(courses: DataFrame, topics: DataFrame, blocks: DataFrame, questions: DataFrame, options: DataFrame, glossary: DataFrame) -> DataFrame:
    """(course, manifest): one JSON document a course, put together from below, so each level is shuffled once by its parent's key.

    ``courses`` (course, slug, programCode, title, topicTerm), ``topics`` (course, topic, number, slug, title), ``blocks`` (topic, pos, id, type, body),
    ``questions`` (topic, pos, key, stem), ``options`` (key, pos, text, correct), ``glossary`` (course, term, definition).  A topic without blocks or questions has
    empty lists; a course without glossary has none.
    """
    o = options.groupBy("key").agg(_ordered(["pos"], text="text", correct="correct").alias("options"))
    q = questions.join(o, "key", "left").groupBy("topic").agg(_ordered(["pos", "key"], key="key", stem="stem", options="options").alias("questions"))
    b = blocks.groupBy("topic").agg(_ordered(["pos", "id"], id="id", type="type", body="body").alias("blocks"))
    t = topics.join(b, "topic", "left").join(q, "topic", "left")
    t = t.withColumns({n: F.coalesce(n, F.array()) for n in ("blocks", "questions")})
    t = t.groupBy("course").agg(_ordered(["number", "slug"], number="number", slug="slug", title="title", blocks="blocks", questions="questions").alias("topics"))
    g = glossary.groupBy("course").agg(_ordered(["term"], term="term", definition="definition").alias("glossary"))
    c = courses.select("course", F.struct("slug", "programCode", "title", "topicTerm").alias("about")).join(t, "course", "left").join(g, "course", "left")
    body = F.struct(F.lit(VERSION).alias("version"), F.col("about").alias("course"), F.coalesce("topics", F.array()).alias("topics"), _filled("glossary").alias("glossary"))
    return c.select("course", F.to_json(body).alias("manifest"))


def manifest_parts(courses: DataFrame, topics: DataFrame, blocks: DataFrame, questions: DataFrame, options: DataFrame, glossary: DataFrame) -> DataFrame:
    """(course, part, number, slug, piece): the documents of :func:`manifests` in pieces, for courses that are more than one task should hold.

    Part 0 opens a document, a part 1 in order of number and slug is one topic, part 2 closes it with its glossary; a course's pieces one behind the other,
    topics parted by commas, are its document, character by character.
    """
    o = options.groupBy("key").agg(_ordered(["pos"], text="text", correct="correct").alias("options"))
    q = questions.join(o, "key", "left").groupBy("topic").agg(_ordered(["pos", "key"], key="key", stem="stem", options="options").alias("questions"))
    b = blocks.groupBy("topic").agg(_ordered(["pos", "id"], id="id", type="type", body="body").alias("blocks"))
    t = topics.join(b, "topic", "left").join(q, "topic", "left").join(courses.select("course"), "course", "left_semi")
    t = t.withColumns({n: F.coalesce(n, F.array()) for n in ("blocks", "questions")})
    each = t.select("course", F.lit(1).alias("part"), "number", "slug", F.to_json(F.struct("number", "slug", "title", "blocks", "questions")).alias("piece"))
    none = (F.lit(None).cast(topics.schema["number"].dataType).alias("number"), F.lit(None).cast("string").alias("slug"))
    about = F.to_json(F.struct(F.lit(VERSION).alias("version"), F.struct("slug", "programCode", "title", "topicTerm").alias("course")))
    head = courses.withColumn("__about", about).select(
        "course", F.lit(0).alias("part"), *none, F.concat(F.col("__about").substr(F.lit(1), F.length("__about") - 1), F.lit(',"topics":[')).alias("piece")
    )
    g = glossary.groupBy("course").agg(_ordered(["term"], term="term", definition="definition").alias("glossary"))
    terms = F.when(F.size("glossary") > 0, F.concat(F.lit(',"glossary":'), F.to_json("glossary")))
    tail = courses.select("course").join(g, "course", "left").select("course", F.lit(2).alias("part"), *none, F.concat(F.lit("]"), F.coalesce(terms, F.lit("")), F.lit("}")).alias("piece"))
    return head.unionByName(each).unionByName(tail)


def read_parts(parts: DataFrame) -> DataFrame:
    """(course, part, number, slug, m): the pieces of :func:`manifest_parts` read back, each as a document that holds only what the piece says; one that
    does not fit the schema ends the job."""
    whole = (
        F.when(F.col("part") == 0, F.concat("piece", F.lit("]}")))
        .when(F.col("part") == 1, F.concat(F.lit('{"topics":['), "piece", F.lit("]}")))
        .otherwise(F.concat(F.lit('{"topics":['), "piece"))
    )
    return parts.select("course", "part", "number", "slug", F.from_json(whole, SCHEMA, {"mode": "FAILFAST"}).alias("m"))


def read_manifests(manifests: DataFrame) -> DataFrame:
    """(course, m): the documents read back; one that does not fit the schema ends the job."""
    return manifests.select("course", F.from_json("manifest", SCHEMA, {"mode": "FAILFAST"}).alias("m"))


def unit_keys(topics: DataFrame) -> DataFrame:
    """(course, keys): a JSON map of each unit's slug to its key.  Two units of one slug would lose a key: that is an error."""
    pairs = F.array_sort(F.collect_list(F.struct("slug", "topic")))
    t = topics.groupBy("course").agg(F.count_distinct("slug").alias("slugs"), pairs.alias("pairs"))
    strict = F.when(F.col("slugs") == F.size("pairs"), F.to_json(F.map_from_entries("pairs")))
    error = F.raise_error(F.concat(F.lit("two units of one slug in course "), F.col("course").cast("string")))
    return t.select("course", F.coalesce(strict, error).alias("keys"))


def problems(courses: DataFrame, topics: DataFrame, blocks: DataFrame) -> DataFrame:
    """(course, kind, what): what refuses a document.  A picture's marker in a body, a course without a programme, a slug or block id twice."""
    of = topics.select("course", "topic", F.col("slug").alias("of"))
    marks = F.explode(F.regexp_extract_all("body", F.lit(PICTURE), F.lit(1)))
    pictures = blocks.select("topic", "id", marks.alias("mark")).join(of, "topic")
    pictures = pictures.select("course", F.lit("picture").alias("kind"), F.concat("of", F.lit(" / "), "id", F.lit(": "), "mark").alias("what"))
    bare = courses.filter(F.coalesce(F.trim("programCode"), F.lit("")) == "").select("course", F.lit("programme").alias("kind"), F.col("slug").alias("what"))
    twice = topics.groupBy("course", "slug").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("course", F.lit("slug").alias("kind"), F.col("slug").alias("what"))
    ids = blocks.join(of, "topic").groupBy("course", "of", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    ids = ids.select("course", F.lit("block").alias("kind"), F.concat("of", F.lit(" / "), "id").alias("what"))
    return pictures.unionByName(bare).unionByName(twice).unionByName(ids)


def sliced(topics: DataFrame, glossary: DataFrame, blocks: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The named units (course, slug), and of the glossary the terms that their blocks use as whole words."""
    some = topics.join(named, ["course", "slug"], "left_semi")
    words = blocks.join(some.select("course", "topic"), "topic").select("course", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("body"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("__w")).distinct()
    first = F.regexp_extract(F.lower("term"), r"[\p{L}\p{N}]+", 0)
    used = glossary.withColumn("__first", first).join(words, (F.col("__first") == F.col("__w")) & (glossary["course"] == words["course"]), "left_semi").drop("__first")
    return some, used
