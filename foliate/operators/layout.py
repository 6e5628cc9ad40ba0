"""Positioned runs of a page to lines, blocks and list depths.

``runs`` is (doc_id, page, top, left, size, family, colour, bold, italic, text): pieces of text as a page shows them.  All limits are
parameters; their values are the rule's own (fixed values).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Page(NamedTuple):
    """Text above ``header`` or below ``footer`` is furniture, that of ``cover`` points or more a title page.  Runs within ``same_line`` of a
    line's first one are on it; a gap over ``gap`` ends a block; markers within ``same_column`` are of one column."""

    header: int = 100
    footer: int = 1130
    cover: int = 30
    same_line: int = 6
    gap: int = 30
    same_column: int = 6
    title_colour: str = "#2980b8"
    title: int = 24
    subtitle: int = 18


def content_runs(runs: DataFrame, page: Page = Page()) -> DataFrame:
    """Runs without margins, cover and empty ones.  A run of white space stays, as it parts two words."""
    return runs.filter(F.col("top").between(page.header, page.footer) & (F.coalesce("size", F.lit(0)) < page.cover) & (F.col("text") != ""))


def on_lines(runs: DataFrame, page: Page = Page()) -> DataFrame:
    """``line``: the top of the line that a run is on.  A line takes what lies within ``same_line`` of its first run; the run beyond
    begins the next one, so how far runs drift from each other does not matter."""
    by = ["doc_id", "page"]
    rest = [c for c in runs.columns if c not in by]
    pages = runs.groupBy(*by).agg(F.collect_list(F.struct(*rest)).alias("__runs"))
    tops = F.array_sort(F.array_distinct(F.transform("__runs", lambda r: r["top"])))
    none = F.array().cast(f"array<{runs.schema['top'].dataType.simpleString()}>")
    begins = lambda a, top: (F.size(a) == 0) | (top > F.element_at(a, F.size(a)) + page.same_line)
    starts = F.aggregate(tops, none, lambda a, top: F.when(begins(a, top), F.concat(a, F.array(top))).otherwise(a))
    own = lambda r, lines: F.struct(*[r[c].alias(c) for c in rest], F.array_max(F.filter(lines, lambda x: x <= r["top"])).alias("line"))
    # the lines are an element of an array, so that they are found once a page and not for each run
    placed = F.transform(F.array(starts), lambda lines: F.transform("__runs", lambda r: own(r, lines)))[0]
    return pages.select(*by, F.inline(placed))


def marker_kind(text: Column, family: Column) -> Column:
    """``ol`` for a number or a letter with a point, ``ul`` for a glyph of a symbol font; null for content."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    numbered = t.rlike(r"^[0-9]+\.$") | t.rlike(r"^[A-Za-z]\.$")
    return F.when(numbered, "ol").when(family.rlike("(?i)Wingdings|Symbol"), "ul")


def _filled(run: Column) -> Column:
    return run["text"].rlike(r"\S")


def _from_first(runs: Column) -> Column:
    """An array of runs without the blank ones that lead it."""
    first = F.coalesce(F.array_min(F.transform(runs, lambda r, i: F.when(_filled(r), i))), F.size(runs))
    return F.slice(runs, first + 1, F.size(runs))


def _marked(run: Column) -> Column:
    """A run's text with its emphasis, white space outside of it."""
    mark = F.when(run["bold"], "**").when(run["italic"], "*").otherwise("")
    whole = F.concat(F.regexp_extract(run["text"], r"^(\s*)", 1), mark, F.regexp_replace(run["text"], r"^\s+|\s+$", ""), mark, F.regexp_extract(run["text"], r"(\s*)$", 1))
    return F.when(_filled(run) & (mark != ""), whole).otherwise(run["text"])


def lines(runs: DataFrame, page: Page = Page()) -> DataFrame:
    """A row for each line that has a filled run: page, top, gap to the line before (null for the first), marker and its place, level
    of a heading (0 without), content and the same with emphasis.  Content of a marker alone is empty."""
    placed = on_lines(content_runs(runs, page), page)
    parts = F.array_sort(F.collect_list(F.struct("left", "top", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("family", F.lit("")).alias("family"), F.coalesce("colour", F.lit("")).alias("colour"), "bold", "italic", "text")))
    rows = placed.groupBy("doc_id", "page", F.col("line").alias("top")).agg(parts.alias("runs"))
    order = Window.partitionBy("doc_id").orderBy("page", "top")
    rows = rows.withColumn("gap", F.col("top") - F.lag("top").over(order)).withColumn("runs", _from_first(F.col("runs"))).filter(F.size("runs") > 0)
    first = F.col("runs")[0]
    rows = rows.withColumns({"marker": marker_kind(first["text"], first["family"]), "marker_left": first["left"]})
    rest = F.when(F.col("marker").isNull(), F.col("runs")).otherwise(_from_first(F.slice("runs", F.lit(2), F.size("runs"))))
    rows = rows.withColumn("runs", rest)
    lead, blue = F.get("runs", F.lit(0)), F.get("runs", F.lit(0))["colour"] == page.title_colour
    level = F.when(blue & (lead["size"] >= page.title), 1).when(blue & (lead["size"] >= page.subtitle), 2).otherwise(0)
    joined = lambda f: F.array_join(F.transform("runs", f), "")
    return rows.select(
        "doc_id", "page", "top", "gap", "marker", F.when(F.col("marker").isNotNull(), F.col("marker_left")).alias("marker_left"),
        level.alias("level"), joined(lambda r: r["text"]).alias("content"), joined(_marked).alias("marked"),
    )


def depths(lines: DataFrame, page: Page = Page()) -> DataFrame:
    """``depth`` of every marker line: how many markers are still open when it comes.

    A marker opens at its column and stays open until one comes that is not right of it by more than ``same_column``; what lies
    between is closed by then, so a marker's end does not depend on the others.  The end is the first place behind it of any column up to
    its own; for that every column of a list has its next place, so work grows with the markers times the columns of their list, of
    which a page has no more than its width.  A line without a marker and behind a gap ends all lists.
    """
    order = Window.partitionBy("doc_id").orderBy("page", "top")
    reset = (F.col("marker").isNull() & (F.coalesce("gap", F.lit(page.gap + 1)) > page.gap)).cast("int")
    rows = lines.select("doc_id", "page", "top", "marker", F.col("marker_left").alias("x"), F.row_number().over(order).alias("n"), F.sum(reset).over(order).alias("list"))
    rows = rows.filter(F.col("marker").isNotNull()).drop("marker")
    by = ["doc_id", "list"]
    columns = rows.groupBy(*by).agg(F.collect_set("x").alias("columns"))
    each = rows.join(columns, by).select(*by, "n", "x", F.explode("columns").alias("c"))
    behind = Window.partitionBy(*by, "c").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("next", F.last(F.when(F.col("x") == F.col("c"), F.col("n")), True).over(behind))
    ends = each.filter(F.col("c") <= F.col("x") + page.same_column).groupBy(*by, "n").agg(F.min("next").alias("end"))
    closed = ends.groupBy(*by, F.col("end").alias("n")).agg(F.count(F.lit(1)).alias("closed"))
    upto = Window.partitionBy(*by).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = F.count(F.lit(1)).over(upto) - 1 - F.sum(F.coalesce("closed", F.lit(0))).over(upto)
    return rows.join(closed, [*by, "n"], "left").select("doc_id", "page", "top", open_.cast("int").alias("depth"))


def blocks(lines: DataFrame, page: Page = Page()) -> DataFrame:
    """Headings, paragraphs and list items: (doc_id, block, kind, level, page, top, n_lines, content, marked).

    A heading goes on over lines of its level without a gap; any other block ends at a gap, a marker or a heading.  Lines are joined by a
    space unless the one before ends with a space or a hyphen.
    """
    order = Window.partitionBy("doc_id").orderBy("page", "top")
    rows = lines.filter(F.col("content").rlike(r"\S"))
    wide = F.coalesce("gap", F.lit(page.gap + 1)) > page.gap
    before = F.lag("level").over(order)
    heading = F.col("level") > 0
    starts = F.when(heading, ~before.eqNullSafe(F.col("level")) | wide).otherwise(F.col("marker").isNotNull() | wide | before.isNull() | (before > 0))
    trimmed = lambda c: F.when(heading, F.regexp_replace(F.col(c), r"^\s+|\s+$", "")).otherwise(F.col(c))
    rows = rows.withColumns({"__starts": starts.cast("int"), "content": trimmed("content"), "marked": F.when(heading, trimmed("content")).otherwise(F.col("marked"))})
    rows = rows.withColumn("block", F.sum("__starts").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = F.array_sort(F.collect_list(F.struct("page", "top", "content", "marked", "level", "marker")))
    found = rows.groupBy("doc_id", "block").agg(parts.alias("p"))
    first = F.col("p")[0]

    def joined(c: str) -> Column:
        before = lambda i: F.get(F.col("p"), i - 1)["content"]
        return F.array_join(F.transform("p", lambda x, i: F.when((i == 0) | before(i).rlike(r"[\s-]$"), x[c]).otherwise(F.concat(F.lit(" "), x[c]))), "")

    kind = F.when(first["level"] > 0, "heading").otherwise(F.coalesce(first["marker"], F.lit("p")))
    return found.select("doc_id", "block", kind.alias("kind"), first["level"].alias("level"), first["page"].alias("page"), first["top"].alias("top"), F.size("p").alias("n_lines"), joined("content").alias("content"), joined("marked").alias("marked"))
