"""Quality rules over the elements of a page: one boolean column per rule, unpivoted to findings.

A block is (type, variant, title, caption, body, head, rows, roles, steps, latex) and may have problem, answer, markers, series, and result and substitution of a
step; fields that a block or its table lacks are null.  Questions are read as blocks (:func:`question_blocks`), so that a rule covers both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import drawn_width

#: Longest heading, widest formula, and how far around a note word its owner may stand (fixed values).
HEADING, WIDTH, NEAR = 120, 62, 90
#: Forms of the rules (fixed values).
ENTRY_LINE = r"(?m)^\s*(?:\*\*)?\s*(?:Dr|Cr)\.\s"
PIPE_ROW = r"(?m)^\s*\|.*\|"
EXERCISE = r"(?i)\b(?:exercise|try to|try doing|your turn)\b"
ANSWER = r"(?im)^(?:\*\*)?\s*(?:the\s+)?answers?\b[:!.]?\s*$"
FURNITURE = r"(?i)\b(?:footnote|voetnoot|bottom of the page|top of the page|see page \d+|on page \d+|\(page \d+\)|next page|previous page|overleaf)\b"
NOTE, OWNER = r"(?i)\b(?:footnote|voetnoot)\b", r"(?i)\b(?:SPSS|output|uitvoer|table|tabel|printout)\b"
LONG_HEADING = rf"(?m)^#{{1,6}} .{{{HEADING + 1},}}$"
BOLD_LINE = r"^\*\*[^*]+\*\*:?$"
STYLE_MARK = "<!-- style:"
MARKDOWN = r"(?m)\*\*|`|^\s*[-*]\s|\[[^\]]*\]\([^)]*\)"


def has_open_mark(c: Column) -> Column:
    """Whether a line of the text keeps an asterisk after escaped ones and closed spans are gone."""

    def bare(line: Column) -> Column:
        out = F.regexp_replace(line, r"\\\*", "")
        out = F.regexp_replace(out, r"\*\*[^*]+\*\*", "")
        return F.regexp_replace(out, r"(?<!\*)\*[^*]+\*(?!\*)", "")

    return F.exists(F.split(F.coalesce(c, F.lit("")), "\n"), lambda line: bare(line).contains("*"))


def _points_at_page(text: Column) -> Column:
    """The first mention of a page's furniture; a note is forgiven beside what has notes of its own on a screen."""
    found = F.regexp_substr(text, F.lit(FURNITURE))
    at = F.instr(text, found)
    around = text.substr(F.greatest(at - NEAR, F.lit(1)), F.least(at - 1, F.lit(NEAR)) + NEAR)
    return found.isNotNull() & ~(found.rlike(NOTE) & around.rlike(OWNER))


#: Fields of a block that not every table has.
MORE = {"problem": "string", "answer": "string", "markers": "array<struct<label: string>>", "series": "array<struct<label: string>>"}
STEP = "array<struct<label: string, note: string, result: string, substitution: string>>"


def _whole(blocks: DataFrame) -> DataFrame:
    """``blocks`` with every field that a rule reads."""
    have = {f.name: f.dataType for f in blocks.schema.fields}
    added = {c: F.lit(None).cast(t) for c, t in MORE.items() if c not in have}
    in_step = have["steps"].elementType.fieldNames() if "steps" in have else []
    step = lambda s: F.struct(*[(s[n] if n in in_step else F.lit(None).cast("string")).alias(n) for n in ("label", "note", "result", "substitution")])
    return blocks.withColumns(added | {"steps": F.transform("steps", step) if in_step else F.lit(None).cast(STEP)})


def question_blocks(questions: DataFrame, *keys: str) -> DataFrame:
    """A question (stem, explanation, options of text and rationale) as a block of type ``question``, whose body is all that a student reads."""
    options = F.flatten(F.transform(F.coalesce("options", F.array()), lambda o: F.array(o["text"], o["rationale"])))
    body = F.array_join(F.array_compact(F.concat(F.array("stem", "explanation"), options)), "\n")
    none = {"variant": "string", "title": "string", "caption": "string", "head": "array<string>", "rows": "array<array<string>>", "roles": "array<string>", "steps": STEP, "latex": "string"}
    return questions.select(*keys, F.lit("question").alias("type"), body.alias("body"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])


def rules() -> dict[str, Column]:
    """Each rule's name and whether a block (with all fields) breaks it."""
    text = lambda c: F.coalesce(c, F.lit(""))
    body, kind = text("body"), F.col("type")
    prose = kind == "prose"
    head = F.lower(F.array_join(F.coalesce("head", F.array().cast("array<string>")), " "))
    cells = F.flatten(F.coalesce("rows", F.array().cast("array<array<string>>")))
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    filled = F.filter(F.split(F.btrim(body), "\n"), lambda x: F.btrim(x) != "")
    steps = F.coalesce("steps", F.array().cast(STEP))
    labels = F.transform(F.concat(*[F.coalesce(c, F.array().cast(MORE[c])) for c in ("markers", "series")]), lambda m: m["label"])
    notes = F.flatten(F.transform(steps, lambda s: F.array(s["label"], s["note"])))
    marked = lambda c: F.coalesce(c, F.lit("")).rlike(MARKDOWN)
    tabular = F.when(kind == "table", F.concat(F.coalesce("head", F.array().cast("array<string>")), cells)).otherwise(F.array().cast("array<string>"))
    worded = F.flatten(F.transform(steps, lambda s: F.array(s["label"], s["note"], s["result"], s["substitution"])))
    fields = F.concat(F.array("body", "caption", "title", "problem", "answer"), tabular, worded)
    return {
        "entry_in_prose": prose & body.rlike(ENTRY_LINE),
        "accounts_as_table": (kind == "table") & head.rlike(r"\bdebit\b") & head.rlike(r"\bcredit\b") & F.exists(cells, lambda c: F.coalesce(c, F.lit("")).rlike("[0-9]")),
        "steps_with_head": (kind == "table") & (F.col("variant") == "steps") & (some("head") | some("roles")),
        "pipes_in_prose": prose & body.rlike(PIPE_ROW),
        "exercise_in_callout": (kind == "callout") & body.rlike(EXERCISE) & body.contains("?"),
        "answer_as_line": body.rlike(ANSWER),
        "points_at_page": _points_at_page(F.concat_ws(" ", body, text("title"), text("caption"))),
        "paragraph_as_heading": body.rlike(LONG_HEADING),
        "ends_on_bold": prose & F.btrim(F.coalesce(F.try_element_at(filled, F.lit(-1)), F.lit(""))).rlike(BOLD_LINE),
        "style_mark": F.to_json(F.struct("type", "variant", "title", "caption", "body", "head", "rows", "roles", "steps", "latex", *MORE)).contains(STYLE_MARK),
        "formula_too_wide": (kind == "formula") & (drawn_width(text("latex")) > WIDTH),
        "markdown_in_plain_field": marked("caption") | ((kind == "chart") & (marked("title") | F.exists(labels, marked))) | ((kind == "worked-example") & F.exists(notes, marked)),
        "open_mark": F.exists(fields, has_open_mark),
    }


def which_account(rows: str | Column = "rows") -> Column:
    """What a debit and credit table should have been: with a row of totals a trial balance, else a journal entry."""
    totals = F.exists(rows, lambda r: F.coalesce(F.get(r, F.lit(0)), F.lit("")).rlike(r"(?i)\btotals?\b"))
    return F.when(totals, "trial balance").otherwise("journal entry")


def findings(blocks: DataFrame, *keys: str) -> DataFrame:
    """A row per block and rule that it breaks."""
    broken = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules().items()])
    return _whole(blocks).select(*keys, F.explode(F.array_compact(broken)).alias("rule"))
