"""Joins whose misses matter: kept, reported, refused, or counted against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_heading
from .joins import small


def resolve(refs: DataFrame, targets: DataFrame, key: str, keep_missing: bool = False) -> DataFrame:
    """References with their target; one without a target is dropped, or kept with nulls."""
    return refs.join(targets, key, "left" if keep_missing else "inner")


def missing(refs: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """The references whose target is not there."""
    return refs.join(targets.select(key).distinct(), key, "left_anti")


def strict(refs: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """As :func:`resolve`, but a reference without a target is an error that names some of them."""
    lost = [r[0] for r in missing(refs, targets, key).select(key).distinct().orderBy(key).limit(5).collect()]
    if lost:
        raise ValueError(f"no target for {key} {', '.join(map(str, lost))}")
    return resolve(refs, targets, key)


def common(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many distinct keys both hold, and whether none does."""
    both = a.select(key).intersect(b.select(key))
    return both.agg(F.count(F.lit(1)).alias("n_common")).withColumn("disjoint", F.col("n_common") == 0)


def bind(entries: DataFrame, groups: DataFrame, rows: DataFrame) -> DataFrame:
    """Entries (key, fp) to a group by fingerprint and to a stored row by key, with what became of each.

    ``groups`` is (fp, group_id), ``rows`` (key, bound_to).  An entry whose row is bound already is left alone, whichever group it has.
    """
    found = entries.join(groups, "fp", "left").join(rows.withColumn("__row", F.lit(True)), "key", "left")
    status = (
        F.when(F.col("__row").isNull(), "no row")
        .when(F.col("bound_to").isNotNull(), "bound before")
        .when(F.col("group_id").isNull(), "no group")
        .otherwise("bound")
    )
    return found.select("key", "group_id", status.alias("status"))


def first_by_pattern(items: DataFrame, names: DataFrame) -> DataFrame:
    """Each item (item, pattern) with how many ``names`` (name) its pattern fits and the first of them.

    Items are a checklist, small data that is broadcast after a count; names are scanned once.
    """
    hit = names.join(small(items), F.expr("name RLIKE pattern"))
    found = hit.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first"))
    return items.select("item").join(found, "item", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def same_label(c: str | Column) -> Column:
    """A label as it is compared: without case and outer blanks."""
    return F.lower(F.btrim(F.col(c) if isinstance(c, str) else c))


def counted(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of each key on either side, and by how much they differ."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("n_left"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("n_right"))
    both = a.join(b, key, "full_outer")
    n = [F.coalesce(c, F.lit(0)) for c in ("n_left", "n_right")]
    return both.select(key, n[0].alias("n_left"), n[1].alias("n_right"), (n[0] - n[1]).alias("difference"))


def in_order(*kinds: DataFrame) -> DataFrame:
    """Blocks of several kinds in a fixed order: all of the first, then of the second; ``rank`` says which."""
    ranked = [k.withColumn("rank", F.lit(i)) for i, k in enumerate(kinds)]
    out = ranked[0]
    for k in ranked[1:]:
        out = out.unionByName(k)
    return out


def covers(source: DataFrame, published: DataFrame, by: str, text: str) -> DataFrame:
    """Per key: how many published texts there are, and how many of them its source lacks."""
    have = source.select(by, text).distinct().withColumn("__there", F.lit(True))
    out = published.join(have, [by, text], "left").groupBy(by)
    return out.agg(F.count(F.lit(1)).alias("n_published"), F.count_if(F.col("__there").isNull()).alias("n_missing"))


def chosen_units(units: DataFrame, named: DataFrame, front: DataFrame) -> DataFrame:
    """Units (``course``, ``title``) that a course names; of a course that names none, all but front matter (``title``)."""
    picked = units.join(named.select("course", "title").distinct(), ["course", "title"], "left_semi")
    rest = units.join(named.select("course").distinct(), "course", "left_anti").join(front.select("title").distinct(), "title", "left_anti")
    return picked.unionByName(rest.select(*units.columns))


def by_heading(sections: DataFrame, wanted: DataFrame) -> DataFrame:
    """What is ``wanted`` of a unit's sections by the text of a heading (``unit``, ``heading``), in its plain form: the first section of that heading; ``pos`` is null where
    there is none, and ``times`` says how many there are."""
    have = sections.select("unit", plain_heading("heading").alias("__h"), "pos").groupBy("unit", "__h").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("times"))
    asked = wanted.select("*", plain_heading("heading").alias("__h"))
    return asked.join(have, ["unit", "__h"], "left").drop("__h").withColumn("times", F.coalesce("times", F.lit(0)))
