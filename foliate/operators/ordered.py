"""Ordered rules: what a line takes from its neighbours.  Windows over the lines with text of one document; each frame
grows, so work is linear in the lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold
from .lines import from_end, heading_level, heading_text, in_doc, so_far, with_class, with_unit


def filled(lines: DataFrame) -> DataFrame:
    """Lines with text, with their class and their neighbours' classes and texts."""
    rows = with_class(lines).filter(F.col("class") != "blank")
    w = in_doc()
    around = {f"{side}_{c}": f(c).over(w) for side, f in (("prev", F.lag), ("next", F.lead)) for c in ("class", "text", "pos")}
    return rows.withColumns(around)


def flag_takes(lines: DataFrame) -> DataFrame:
    """A flag that ends in a colon takes the next line, or the whole run of a list: (doc_id, pos, first, last, title).

    Under a heading that is folded away (level 4 and deeper) it takes that heading as its title.
    """
    rows = filled(lines)
    listed = F.col("class") == "list"
    runs = F.sum(F.when(~listed, 1).otherwise(0)).over(so_far())
    rows = rows.withColumn("run", runs)
    rows = rows.withColumn("run_last", F.when(listed, F.max(F.when(listed, F.col("pos"))).over(Window.partitionBy("doc_id", "run"))))
    rows = rows.withColumns({"next_last": F.lead("run_last").over(in_doc()), "prev_level": F.lag("level").over(in_doc())})
    flag = (F.col("class") == "text") & F.col("text").rlike(r":[ \t]*\z") & F.col("next_pos").isNotNull()
    title = F.when(F.col("prev_level") >= 4, F.btrim(F.regexp_replace("prev_text", r"^#{1,6}[ \t]+", "")))
    return rows.filter(flag).select("doc_id", "pos", F.col("next_pos").alias("first"), F.coalesce("next_last", "next_pos").alias("last"), title.alias("title"))


def styled(lines: DataFrame, marker: str = r"^<!-- style: ([a-z-]+) -->$") -> DataFrame:
    """A style marker applies to the next line with text; one that another marker, or nothing, follows is dropped."""
    rows = filled(lines)
    name = lambda c: F.nullif(F.regexp_extract(c, marker, 1), F.lit(""))
    rows = rows.withColumns({"own": name("text"), "style": name("prev_text")})
    return rows.filter("own IS NULL AND style IS NOT NULL").select("doc_id", "pos", "style", "text")


def coalesced(runs: DataFrame) -> DataFrame:
    """Neighbouring runs (doc_id, pos, mark, text) with one mark as one run: its first place, how many and the text joined."""
    w = in_doc()
    starts = F.when(F.col("mark").eqNullSafe(F.lag("mark").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    island = runs.withColumn("__starts", starts).withColumn("island", F.sum("__starts").over(so_far()))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda r: r["text"]), "")
    return island.groupBy("doc_id", "island", "mark").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n"), joined.alias("text")).drop("island")


def formulas(lines: DataFrame) -> DataFrame:
    """Display lines that are formulas: not after a bold lead; a where-line that follows is taken in."""
    rows = filled(lines).filter("class = 'display'")
    free = F.coalesce(F.col("prev_class") != "bold", F.lit(True))
    where = F.when(F.col("next_class") == "where", F.col("next_pos"))
    return rows.select("doc_id", "pos", free.alias("is_formula"), F.when(free, where).alias("where_pos"))


def captions(lines: DataFrame) -> DataFrame:
    """Each table's caption: the bold line before it, else the bold beginning of the paragraph before it, else its section."""
    named = F.when(heading_level() >= 2, heading_text())
    rows = filled(lines).withColumn("section", F.last(named, True).over(so_far()))
    first = rows.filter((F.col("class") == "table") & F.coalesce(F.col("prev_class") != "table", F.lit(True)))
    bold = F.when(F.col("prev_class") == "bold", F.btrim(F.translate("prev_text", "*", ""), F.lit(": ")))
    lead = F.nullif(F.when(F.col("prev_class") == "text", F.regexp_extract("prev_text", r"^\*\*([^*]+)\*\*", 1)), F.lit(""))
    how = F.when(bold.isNotNull(), "bold").when(lead.isNotNull(), "lead").otherwise("section")
    return first.select("doc_id", "pos", F.coalesce(bold, lead, "section").alias("caption"), how.alias("how"))


def figures(lines: DataFrame) -> DataFrame:
    """A picture alone on its line, with the italic line after it as caption (null without one)."""
    rows = filled(lines).filter(F.col("text").rlike(r"^!\[[^\]]*\]\([^)]*\)[ \t]*$"))
    caption = F.nullif(F.regexp_extract(F.coalesce("next_text", F.lit("")), r"^[*_]([^*_].*[^*_]|[^*_])[*_][ \t]*$", 1), F.lit(""))
    return rows.select("doc_id", "pos", F.regexp_extract("text", r"\(([^)]*)\)", 1).alias("file"), caption.alias("caption"))


def closing(lines: DataFrame, recap: str, lead: str) -> DataFrame:
    """Per unit the box that closes it: the last section whose heading is a recap and that holds text only, else the last
    line with a recap as its bold lead: (doc_id, unit, pos, how)."""
    rows = with_class(with_unit(lines)).filter("class <> 'blank'")
    rows = rows.withColumn("section", F.sum(F.when(F.col("class") == "heading", 1).otherwise(0)).over(so_far()))
    sections = rows.groupBy("doc_id", "unit", "section").agg(
        F.min(F.when(F.col("class") == "heading", F.col("pos"))).alias("pos"),
        F.max(F.when((F.col("class") == "heading") & (F.col("level") > 1), heading_text())).alias("title"),
        F.count_if(F.col("class") == "text").alias("n_text"),
        F.count_if(~F.col("class").isin("text", "heading")).alias("n_other"),
    )
    boxes = sections.filter(F.col("title").rlike(recap) & (F.col("n_text") > 0) & (F.col("n_other") == 0)).groupBy("doc_id", "unit").agg(F.max("pos").alias("box"))
    leads = rows.filter(F.col("text").rlike(lead)).groupBy("doc_id", "unit").agg(F.max("pos").alias("lead"))
    both = boxes.join(leads, ["doc_id", "unit"], "full_outer")
    return both.select("doc_id", "unit", F.coalesce("box", "lead").alias("pos"), F.when(F.col("box").isNotNull(), "section").otherwise("lead").alias("how"))


def with_check(blocks: DataFrame, bank: DataFrame, most: int = 5) -> DataFrame:
    """Blocks (unit, pos, type) with a check of min(``most``, questions of the unit) before the closing box, or at the end."""
    last = blocks.groupBy("unit").agg(F.max("pos").alias("last"), F.max(F.when(F.col("type") == "closing", F.col("pos"))).alias("box"))
    n = bank.groupBy("unit").agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("n_questions"))
    at = F.coalesce(F.col("box") - 0.5, F.col("last") + 0.5)
    checks = last.join(n, "unit").select("unit", at.alias("at"), F.lit("check").alias("type"), "n_questions")
    rows = blocks.select("unit", F.col("pos").cast("double").alias("at"), "type", F.lit(None).cast("long").alias("n_questions")).unionByName(checks)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("unit").orderBy("at"))).drop("at")


def worked_steps(lines: DataFrame) -> DataFrame:
    """Steps of worked examples: each step line's label, its first display as result, the text after that as note; the display
    after a final answer is the answer: (doc_id, step_pos, label, result, note, is_answer)."""
    rows = with_class(lines).filter("class <> 'blank'")
    opens = F.col("class").isin("step", "answer")
    ends = F.col("class").isin("heading", "example")
    rows = rows.withColumn("step", F.last(F.when(opens, F.col("pos")).when(ends, F.lit(-1)), True).over(so_far())).filter("step >= 0")
    shown = F.when(F.col("class") == "display", F.col("pos"))
    rows = rows.withColumn("first_shown", F.min(shown).over(Window.partitionBy("doc_id", "step")))
    label = F.btrim(F.regexp_replace("text", r"^\*\*Step[ \t]*[0-9]+[ \t]*[:.)\-–]?[ \t]*|\*\*", ""))
    note = F.when((F.col("class") == "text") & (F.col("pos") > F.col("first_shown")), F.struct("pos", "text"))
    out = rows.groupBy("doc_id", F.col("step").alias("step_pos")).agg(
        F.max(F.when(opens, label)).alias("label"),
        F.max(F.when(F.col("pos") == F.col("first_shown"), F.btrim(F.col("text"), F.lit("$ ")))).alias("result"),
        F.array_join(F.transform(F.array_sort(F.collect_list(note)), lambda x: x["text"]), " ").alias("note"),
        F.max(F.col("class") == "answer").alias("is_answer"),
    )
    return out


def question_section(lines: DataFrame, stem: str = r"^\*\*[0-9]+\.\*\*[ \t]*.") -> DataFrame:
    """The heading that the questions of a unit stand under: the nearest one above the first stem."""
    rows = with_unit(lines).withColumn("under", F.last(F.when(heading_level().isNotNull(), F.col("pos")), True).over(so_far()))
    return rows.filter(F.col("text").rlike(stem)).groupBy("doc_id", "unit").agg(F.min("pos").alias("first_stem"), F.min_by("under", "pos").alias("heading_pos"))


def passages(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lines between a first and a last line (doc_id, first, last as texts); a passage counts only if both stand, in that order."""
    first = lines.select("doc_id", F.col("text").alias("first"), F.col("pos").alias("a"))
    last = lines.select("doc_id", F.col("text").alias("last"), F.col("pos").alias("b"))
    starts = wanted.join(first, ["doc_id", "first"], "left").groupBy("doc_id", "first", "last").agg(F.min("a").alias("a"))
    found = starts.join(last, ["doc_id", "last"], "left").groupBy("doc_id", "first", "last", "a").agg(F.min(F.when(F.col("b") >= F.col("a"), F.col("b"))).alias("b"))
    return found.select("doc_id", "a", "b", (F.coalesce("a", "b").isNotNull() & F.col("b").isNotNull()).alias("found"), (F.col("b") - F.col("a") + 1).alias("n_lines"))


def dash_parity(docs: DataFrame, dash: str = "—") -> DataFrame:
    """Per dash of a text: whether it stands outside all spans, which is so where each kind of mark came an even number of times before it."""
    marks = F.regexp_extract_all("text", F.lit(rf"\*\*|[$`*{dash}]"), F.lit(0))
    tokens = docs.select("doc_id", F.posexplode(marks).alias("pos", "mark"))
    upto = in_doc().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    odd = [F.sum((F.col("mark") == m).cast("int")).over(upto) % 2 for m in ("$", "`", "*", "**")]
    rows = tokens.withColumn("outside", (odd[0] + odd[1] + odd[2] + odd[3]) == 0).filter(F.col("mark") == dash)
    return rows.select("doc_id", F.row_number().over(in_doc()).alias("dash"), "outside")


#: An item of a list (fixed value).
LIST_ITEM = r"^\s*(?:[-*]\s|[0-9]+[.)]\s)"
#: Paragraphs within which an example that has no working yet must come to some.
AHEAD = 4


def example_runs(lines: DataFrame) -> DataFrame:
    """``example`` of every paragraph (a line that is not blank) that belongs to one, by the place where it begins.

    An example ends before the next one and before a heading.  It goes on over all else if a step lies ahead; otherwise over working (steps, answers,
    items, formulas, tables), over one sentence that working follows, and, until it has any working, over sentences from which
    working is at most four paragraphs away.  A table ends it and is taken in.
    """
    rows = with_class(lines).filter("class <> 'blank'")
    along = in_doc()
    begins = F.col("class") == "example"
    working = F.col("class").isin("step", "answer", "display", "table") | F.col("text").rlike(LIST_ITEM) | F.col("text").startswith("$")
    rows = rows.withColumns({"working": working, "n": F.row_number().over(along), "at": F.last(F.when(begins, F.col("pos")), True).over(along)})
    near = along.rowsBetween(0, AHEAD - 1)
    found = F.min(F.when(F.col("working"), F.col("n"))).over(near)
    barred = F.min(F.when(begins | (F.col("class") == "heading"), F.col("n"))).over(near)
    reaches = F.coalesce(found < F.coalesce(barred, found + 1), F.lit(False))
    of = Window.partitionBy("doc_id", "at")
    before = of.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    stepped = F.max(F.col("class") == "step").over(of)
    goes_on = stepped | F.col("working") | F.coalesce(F.lead("working").over(along), F.lit(False)) | (~F.coalesce(F.max("working").over(before), F.lit(False)) & reaches)
    rows = rows.withColumn("stops", ~begins & ((F.col("class") == "heading") | ~goes_on))
    rows = rows.withColumn("ends", F.col("stops") | F.coalesce(F.lag((F.col("class") == "table") & (F.col("at") < F.col("pos"))).over(of.orderBy("pos")), F.lit(False)))
    over = F.max("ends").over(of.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("over", over).filter(F.col("at").isNotNull() & ~F.col("over")).select("doc_id", "pos", F.col("at").alias("example"))


def next_heading(lines: DataFrame) -> DataFrame:
    """Per line the place of the next heading."""
    return lines.select("doc_id", "pos", F.last(F.when(heading_level().isNotNull(), F.col("pos")), True).over(from_end()).alias("next_heading"))
