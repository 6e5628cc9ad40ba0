"""Ordered lines: classes, units, sections, leads and lists.

Windows run over one document (``doc_id``) or one unit of it at a time; a document's lines are the unit of order, so
no operator here sorts more than that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .folds import fold

#: Line classes in the order in which they are tried (first match wins), as patterns that Java and RE2 read alike.  The
#: forms of examples, steps, answers, rules, bold and where-lines are fixed values.
CLASSES = (
    ("blank", r"^[ \t]*$"),
    ("heading", r"^#{1,6}[ \t]+[^ \t]"),
    ("table", r"^[ \t]*\|"),
    ("display", r"^[ \t]*\$\$"),
    ("step", r"^\*\*Step[ \t]*[0-9]+[ \t]*[:.)\-–]?[ \t]*[^*]*?\*\*[ \t]*"),
    ("answer", r"(?i)^\*\*Final Answer[^*]*\*\*[ \t]*$"),
    ("example", r"^[ \t]*(?:[-*][ \t]+)?\*\*(?:[^*]{1,24}?\bExamples?[ \t]*:|Examples?)[^*]*\*\*[ \t]*:?[ \t]*"),
    ("rule", r"^[ \t]*[-*][ \t]+\*\*[^*]+?\*\*[ \t]*:?[ \t]*.*$"),
    ("bold", r"^\*\*[^*]+\*\*:?[ \t]*$"),
    ("list", r"^[ \t]*(?:[-*+]|[0-9]+[.)])[ \t]+"),
    ("where", r"(?i)^[ \t]*where\b"),
)


def explode_lines(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, pos, text): the lines of each text."""
    return docs.select("doc_id", *keep, F.posexplode(F.split("text", "\n")).alias("pos", "text"))


def classify(text: str | Column = "text") -> Column:
    t = F.col(text) if isinstance(text, str) else text
    out = F.lit("text")
    for name, pattern in reversed(CLASSES):
        out = F.when(t.rlike(pattern), name).otherwise(out)
    return out


def heading_level(text: str = "text") -> Column:
    """1 to 6, or null for a line that is no heading."""
    marks = F.regexp_extract(text, r"^(#{1,6})[ \t]+[^ \t]", 1)
    return F.when(marks != "", F.length(marks))


def heading_text(text: str = "text") -> Column:
    return F.btrim(F.regexp_replace(text, r"^#{1,6}[ \t]+", ""))


def with_class(lines: DataFrame) -> DataFrame:
    """Adds class, level, indent and the number of words."""
    return lines.withColumns(
        {
            "class": classify("text"),
            "level": heading_level("text"),
            "indent": F.length("text") - F.length(F.ltrim("text")),
            "n_words": F.size(F.filter(F.split("text", r"[ \t]+"), lambda w: w != "")),
        }
    )


def in_doc(*more: str) -> WindowSpec:
    return Window.partitionBy("doc_id", *more).orderBy("pos")


def so_far(*more: str) -> WindowSpec:
    return in_doc(*more).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def from_end(*more: str) -> WindowSpec:
    """The lines after a line, the farthest first: a frame that grows, where one that shrinks would be read anew for each line."""
    return Window.partitionBy("doc_id", *more).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)


def before(*more: str) -> WindowSpec:
    return in_doc(*more).rowsBetween(Window.unboundedPreceding, -1)


def with_unit(lines: DataFrame) -> DataFrame:
    """``unit``: how many level-1 headings there were up to the line (0: what stands before the first)."""
    return lines.withColumn("unit", F.sum(F.when(heading_level() == 1, 1).otherwise(0)).over(so_far()))


def unit_ranges(lines: DataFrame) -> DataFrame:
    """A row per unit: title, first line and the line before the next unit."""
    heads = lines.filter(heading_level() == 1)
    end = F.lead("pos").over(in_doc())
    last = lines.groupBy("doc_id").agg(F.max("pos").alias("last"))
    return (
        heads.select("doc_id", F.col("pos").alias("first"), heading_text().alias("title"), end.alias("next"))
        .join(last, "doc_id")
        .select(
            "doc_id",
            "title",
            F.row_number().over(Window.partitionBy("doc_id").orderBy("first")).alias("unit"),
            "first",
            F.coalesce(F.col("next") - 1, F.col("last")).alias("last"),
        )
    )


def with_occurrence(headings: DataFrame) -> DataFrame:
    """``key``: a heading with how often it has come in its document, as ``name#n``."""
    n = F.row_number().over(Window.partitionBy("doc_id", "heading").orderBy("pos"))
    return headings.withColumn("occurrence", n).withColumn("key", F.concat("heading", F.lit("#"), n.cast("string")))


def with_section(lines: DataFrame, opening: str = "(opening)") -> DataFrame:
    """The section that a line lies in: the last heading below level 1 of its unit, or the opening."""
    named = F.when(heading_level() >= 2, heading_text())
    return with_unit(lines).withColumn("section", F.coalesce(F.last(named, True).over(so_far("unit")), F.lit(opening)))


def labels_of_sections(lines: DataFrame) -> DataFrame:
    """Headings whose next line with text is a deeper heading: they only group what follows."""
    filled = with_class(lines).filter(F.col("class") != "blank")
    filled = filled.withColumn("next_level", F.lead("level").over(in_doc()))
    return filled.filter(F.col("level").isNotNull()).select(
        "doc_id", "pos", "level", (F.coalesce("next_level", F.lit(0)) > F.col("level")).alias("is_label")
    )


def join_leads(lines: DataFrame, deep: int = 4) -> DataFrame:
    """Bold-only lines and headings of level ``deep`` or more wait for the next ordinary paragraph and stand before it, over
    lists and the like; any other heading ends the wait, and so does the paragraph.

    Returns the paragraphs with their lead (null if there was none).
    """
    filled = with_class(lines).filter(F.col("class") != "blank")
    is_lead = (F.col("class") == "bold") | (F.coalesce("level", F.lit(0)) >= deep)
    ends = (F.col("class") == "text") | ((F.col("class") == "heading") & ~is_lead)
    # a wait is what lies between two lines that end one
    wait = F.sum(F.when(ends, 1).otherwise(0)).over(before())
    text = F.when(F.col("class") == "bold", F.translate("text", "*", "")).otherwise(heading_text())
    waiting = filled.withColumn("wait", F.coalesce(wait, F.lit(0)))
    led = waiting.withColumn("lead", F.last(F.when(is_lead, text), True).over(in_doc("wait").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return led.filter(F.col("class") == "text").select("doc_id", "pos", "lead", "text")


def empty_sections(lines: DataFrame) -> DataFrame:
    """Sections and whether they are kept: they hold a line of text, or a deeper heading comes next."""
    classed = with_class(lines).filter(F.col("class") != "blank")
    number = F.sum(F.when(F.col("class") == "heading", 1).otherwise(0)).over(so_far())
    numbered = classed.withColumn("number", number).filter(F.col("number") > 0)
    sections = numbered.groupBy("doc_id", "number").agg(
        F.min("pos").alias("pos"), F.max("level").alias("level"), F.count_if(F.col("class") != "heading").alias("filled")
    )
    deeper = F.coalesce(F.lead("level").over(in_doc()) > F.col("level"), F.lit(False))
    return sections.select("doc_id", "pos", "level", "filled", ((F.col("filled") > 0) | deeper).alias("kept"))


def contents_pages(lines: DataFrame, least: int = 5, share: float = 0.7) -> DataFrame:
    """Units that are a table of contents: lines enough, no heading inside, and most of them end in a page number."""
    u = with_class(with_unit(lines)).filter((F.col("class") != "blank") & (F.coalesce("level", F.lit(0)) != 1))
    numbered = F.avg(F.col("text").rlike(r"[^0-9][0-9]{1,4}[ \t]*$").cast("int"))
    return u.groupBy("doc_id", "unit").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.col("class") == "heading").alias("n_headings"),
        numbered.alias("share"),
        ((F.count(F.lit(1)) >= least) & (F.count_if(F.col("class") == "heading") == 0) & (numbered > share)).alias("is_contents"),
    )


def list_depths(lines: DataFrame, by: str = "doc_id") -> DataFrame:
    """Depth of each list item by a fold over the lines of a document: an item is deeper than the last one if it is
    indented by at least that one's marker width; a line of text empties the stack, a blank one does not.  ``parent`` is the
    line of the item that it stands below (null at the top)."""
    marker = F.length(F.regexp_extract("text", r"^[ \t]*((?:[-*+]|[0-9]+[.)])[ \t]+)", 1))
    rows = with_class(lines).withColumn("marker", marker)

    def step(stack: list, pos: int, kind: str, indent: int, marker: int) -> tuple | None:
        if kind == "list":
            while stack and stack[-1][0] > indent:
                stack.pop()
            out = (len(stack), stack[-1][1] if stack else None)
            stack.append((indent + marker, pos))
            return out
        if kind != "blank":
            stack.clear()
        return None

    return fold(rows, [by], ["pos"], ["pos", "class", "indent", "marker"], list, step, "depth int, parent int")


def numbered_siblings(lines: DataFrame) -> DataFrame:
    """Numbered items with whether they keep their number: another numbered item of the same run stands beside them.

    A run is what lies between lines that are neither list items nor blank; items stand beside each other if they have one parent, so
    deeper ones are stepped over.
    """
    breaks = F.sum(F.when(~F.col("class").isin("list", "blank"), 1).otherwise(0)).over(so_far())
    runs = with_class(lines).withColumn("run", breaks).select("doc_id", "pos", "run", "text")
    numbered = runs.filter(F.col("text").rlike(r"^[ \t]*[0-9]+[.)][ \t]+")).join(list_depths(lines), ["doc_id", "pos"])
    beside = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "run", "parent"))
    return numbered.select("doc_id", "pos", (beside > 1).alias("keeps_number"))


def heading_before(lines: DataFrame) -> DataFrame:
    """As-of both ways: for every line the last heading above and the next one below."""
    name = F.when(heading_level().isNotNull(), heading_text())
    return lines.select(
        "doc_id",
        "pos",
        F.last(name, True).over(before()).alias("under"),
        F.last(name, True).over(from_end()).alias("ahead"),
    )
