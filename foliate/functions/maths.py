"""Maths in text: spans, repairs inside them, and rules kept out of them, as built-in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col, map_matches

#: What counts as maths (fixed values): a doubled dollar may cross lines; a single one may not, has no space inside either
#: edge, is not closed by an escaped dollar and not followed by a digit.
DISPLAY = r"\$\$([\s\S]+?)\$\$"
INLINE = r"(?<![\\$])\$(?![\s$])((?:\\\$|[^$\n]){0,398}?(?:\\\$|[^$\s\\]))\$(?!\d)"
#: Code, in which a dollar is a dollar.
CODE = r"```[\s\S]*?```|`[^`\n]*`"
#: Groups in which a space is drawn (fixed values).
TEXTUAL = r"\\(?:text|textrm|textit|textbf|mathrm|mathit|mbox|operatorname)\s*\{[^{}\\]*+(?:(?:\\.|\{[^{}]*+\})[^{}\\]*+)*+\}"


def without_code(c: str | Column) -> Column:
    """The text with every dollar inside code blanked, so lengths and places stay."""
    return map_matches(c, CODE, lambda h: F.translate(h, "$", " "))


def display_spans(c: str | Column) -> Column:
    """The maths of all display spans, in order."""
    return F.regexp_extract_all(without_code(c), F.lit(DISPLAY), F.lit(1))


def inline_spans(c: str | Column) -> Column:
    """The maths of all inline spans, in order: looked for where no display span is."""
    rest = map_matches(without_code(c), DISPLAY, lambda h: F.repeat(F.lit(" "), F.length(h)))
    return F.regexp_extract_all(rest, F.lit(INLINE), F.lit(1))


def is_fragile(tex: Column) -> Column:
    """Maths that does not survive being read back: it holds an escaped dollar or a line break."""
    return tex.contains("\\$") | tex.contains("\n")


def repair_spaces(c: str | Column) -> Column:
    """Maths whose plain spaces between words, which are not drawn, are made drawn ones.

    Left alone are spaces within a textual group and those that end a command; beside such a group a digit counts as part of a
    word too.  Pieces between the groups are rewritten, so no place shifts under another repair.
    """
    # the space comes first, so that what stands before it is looked at only there
    command = r"(?<!\\[A-Za-z]{1,60} )"

    def outside(piece: Column, k: Column, pieces: Column) -> Column:
        out = F.regexp_replace(piece, "(?<=[A-Za-z]) (?=[A-Za-z])" + command, r"\\ ")
        out = F.when((k > 0) & (k < pieces - 1) & (piece == " "), F.lit("\\ ")).otherwise(out)
        before_group = F.regexp_replace(out, "(?<=[A-Za-z0-9]) $" + command, r"\\ ")
        out = F.when(k < pieces - 1, before_group).otherwise(out)
        return F.when(k > 0, F.regexp_replace(out, "^ (?=[A-Za-z0-9])", r"\\ ")).otherwise(out)

    # the pieces are an element of an array, so that they are cut once and not again for each of them
    repaired = F.transform(F.array(F.split(col(c), TEXTUAL, -1)), lambda ps: F.transform(ps, lambda p, k: outside(p, k, F.size(ps))))[0]
    hits = F.regexp_extract_all(col(c), F.lit(TEXTUAL), F.lit(0))
    return F.array_join(F.zip_with(repaired, hits, lambda p, h: F.concat(p, F.coalesce(h, F.lit("")))), "")


def in_prose(c: str | Column, rule: Callable[[Column], Column]) -> Column:
    """``rule`` applied to all that is neither maths nor code; the maths goes back as it was."""
    spans = f"{CODE}|{DISPLAY.replace('(', '(?:', 1)}|{INLINE.replace('((', '(?:(', 1)}"
    return map_matches(c, spans, lambda h: h, lambda piece, _: rule(piece))


#: What stands for a span while a text is rewritten, and for a dollar in code (characters that no text may hold, fixed values).
INLINE_MARK, DISPLAY_MARK, CODE_DOLLAR = "\ufdd0", "\ufdd1", "\ufdd2"
#: Inline maths where display maths is a mark, which counts as white space.
_INLINE_HELD = INLINE.replace(r"(?![\s$])", rf"(?![\s${DISPLAY_MARK}])").replace(r"[^$\s\\]", rf"[^$\s\\{DISPLAY_MARK}]").replace("((", "(?:(", 1)


def _code_apart(c: str | Column) -> Column:
    return map_matches(c, CODE, lambda h: F.translate(h, "$", CODE_DOLLAR))


def hold(c: str | Column) -> Column:
    """A text with a mark in place of each span of maths, and the spans: struct (text, inline, display).  Rules see the text whole and no
    formula, and :func:`put_back` undoes it."""
    display = DISPLAY.replace("(", "(?:", 1)
    apart = _code_apart(c)
    rest = F.regexp_replace(apart, display, DISPLAY_MARK)
    return F.struct(
        F.regexp_replace(rest, _INLINE_HELD, INLINE_MARK).alias("text"),
        F.regexp_extract_all(rest, F.lit(_INLINE_HELD), F.lit(0)).alias("inline"),
        F.regexp_extract_all(apart, F.lit(display), F.lit(0)).alias("display"),
    )


def put_back(c: str | Column, inline: Column, display: Column) -> Column:
    """The spans in place of their marks."""
    out = col(c)
    for mark, held in ((INLINE_MARK, inline), (DISPLAY_MARK, display)):
        out = F.array_join(F.zip_with(F.split(out, mark, -1), held, lambda p, h: F.concat(p, F.coalesce(h, F.lit("")))), "")
    return F.translate(out, CODE_DOLLAR, "$")


def spans(texts: DataFrame, key: list[str]) -> DataFrame:
    """Every span of ``texts`` (``key`` and ``text``) in order: ``key``, n (from 1), display, start, end (code points, end exclusive) and tex.

    Display spans become runs of their own length, so one pattern finds both kinds and what lies between hits gives their places.
    """
    run, end = DISPLAY_MARK, "\ufdd3"
    filled = map_matches(_code_apart("text"), DISPLAY.replace("(", "(?:", 1), lambda h: F.concat(F.repeat(F.lit(run), F.length(h) - 1), F.lit(end)))
    either = f"{run}+{end}|{_INLINE_HELD.replace(DISPLAY_MARK, DISPLAY_MARK + end)}"
    t = texts.select(*key, "text", filled.alias("__f"))
    hits = F.zip_with(F.regexp_extract_all("__f", F.lit(either), F.lit(0)), F.split("__f", either, -1), lambda h, gap: F.struct(h.alias("hit"), F.length(gap).alias("gap")))
    t = t.select(*key, "text", F.filter(hits, lambda x: x["hit"].isNotNull()).alias("__h"))
    # places are summed up where the text lies, so no span takes it through a shuffle
    none = F.struct(F.lit(0).alias("stop"), F.array().cast("array<int>").alias("at"))
    stop = lambda a, h: a["stop"] + h["gap"] + F.length(h["hit"])
    add = lambda a, h: F.struct(stop(a, h).alias("stop"), F.concat(a["at"], F.array(a["stop"] + h["gap"])).alias("at"))
    t = t.withColumn("__at", F.aggregate("__h", none, add, lambda a: a["at"]))
    placed = F.zip_with("__h", "__at", lambda h, at: F.struct(F.endswith(h["hit"], F.lit(end)).alias("display"), at.alias("start"), (at + F.length(h["hit"])).alias("end")))

    def found(x: Column, k: Column) -> Column:
        edge = F.when(x["display"], 2).otherwise(1)
        tex = F.col("text").substr(x["start"] + edge + 1, x["end"] - x["start"] - 2 * edge)
        return F.struct((k + 1).alias("n"), x["display"].alias("display"), x["start"].alias("start"), x["end"].alias("end"), tex.alias("tex"))

    return t.select(*key, F.inline(F.transform(placed, found)))


#: What is not drawn as it is written (fixed values): a textual group is its content, a frame nothing, another command one space.
_WRITTEN = r"\\text\{[^}]*\}|\\(?:begin|end)\{[a-z*]+\}|\\[a-zA-Z]+|[{}&]"
#: A fraction whose halves hold groups one level deep.
FRACTION = r"\\frac\{([^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+)\}\{([^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+)\}"
#: Levels at which fractions may stand in each other.
LEVELS = 8


def _width(c: Column) -> Column:
    """Characters that a piece of a formula draws, white space as one."""

    def drawn(x: Column) -> Column:
        group = F.regexp_replace(F.regexp_extract(x, r"\{([\s\S]*)\}", 1), r"\\[a-zA-Z]+|[{}&]", " ")
        return F.when(x.startswith("\\text{"), group).when(x.rlike(r"^\\(?:begin|end)\{|^[{}&]"), "").otherwise(" ")

    return F.length(F.btrim(F.regexp_replace(map_matches(c, _WRITTEN, drawn), r"\s+", " ")))


def drawn_width(c: str | Column) -> Column:
    """Characters of the widest line that a formula draws.  A fraction is as wide as its wider half: all fractions of a level become bars of
    that width at once, then those around them."""

    def bar(fraction: Column) -> Column:
        halves = [_width(F.regexp_extract(fraction, FRACTION, k)) for k in (1, 2)]
        return F.repeat(F.lit("#"), F.greatest(*halves))

    whole = FRACTION.replace("([^", "(?:[^")
    flat = F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), col(c), lambda out, _: F.when(out.contains("\\frac{"), map_matches(out, whole, bar)).otherwise(out))
    return F.array_max(F.transform(F.split(F.when(col(c).contains("\\frac{"), flat).otherwise(col(c)), r"\\\\"), _width))
