"""Emphasis marks: white space moved out of spans, empty spans dropped, and flags taken off without stranding a mark."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, once


def opening(marks: Column) -> Column:
    """Of each mark of a text (an array of their lengths) whether it opens.

    A mark closes if the last one still open is the same, else it opens; that is a stack of marks, kept in Python as no built-in has one.
    """

    def run(batch: pa.Array) -> pa.Array:
        def roles(sizes: list | None) -> list | None:
            if sizes is None:
                return None
            stack, out = [], []
            for size in sizes:
                opens = not stack or stack[-1] != size
                stack.append(size) if opens else stack.pop()
                out.append(opens)
            return out

        return pa.array([roles(x) for x in batch.to_pylist()], pa.list_(pa.bool_()))

    return F.arrow_udf(run, "array<boolean>")(marks)


def repaired(lines: DataFrame, key: list[str]) -> DataFrame:
    """``lines`` (``key`` and ``text``, one row a key) with the white space just inside a span put outside of it, and spans without anything
    in them dropped.  Marks are runs of up to three asterisks.  Lines without a mark stay as they are, and each line is repaired in its row."""
    mark = r"\*{1,3}"
    some = F.when(F.col("text").contains("*"), F.col("text"))
    t = lines.select(*key, "text", F.regexp_extract_all(some, F.lit(mark), F.lit(0)).alias("__marks"))
    t = t.withColumn("__opens", opening(F.transform("__marks", F.length)))
    role = lambda k: F.get("__opens", k)

    def cut(piece: Column, k: Column) -> Column:
        filled = piece.rlike(r"\S")
        head = F.when(filled & role(k - 1), F.regexp_extract(piece, r"^\s*+", 0)).otherwise("")
        tail = F.when(filled & ~role(k), F.regexp_extract(piece, r"\s(?<!\s\s)\s*+\z", 0)).otherwise("")
        ends = F.struct(head.alias("head"), tail.alias("tail"))
        core = lambda e: piece.substr(F.length(e["head"]) + 1, F.length(piece) - F.length(e["head"]) - F.length(e["tail"]))
        return once(ends, lambda e: F.struct(e["head"].alias("head"), core(e).alias("core"), e["tail"].alias("tail")))

    t = t.withColumn("__p", F.when(F.col("__marks").isNotNull(), F.transform(F.split("text", mark, -1), cut)))
    piece = lambda k: F.get("__p", k)
    marked = lambda m, k: F.when(role(k), F.concat(piece(k + 1)["head"], m)).otherwise(F.concat(m, piece(k)["tail"]))
    rest = F.transform("__marks", lambda m, k: F.concat(marked(m, k), piece(k + 1)["core"]))
    whole = F.concat(piece(F.lit(0))["core"], F.array_join(rest, ""))
    return t.select(*key, F.coalesce(F.regexp_replace(whole, r"\*{2,3}(\s*)\*{2,3}", "$1"), "text").alias("text"))


#: Signs that flag a line (fixed values).
FLAG = r"^(\s*\*\*)?\s*(?:🎯|💡|📌|⚠️|❗|❕|👉|➡️)\x{FE0F}?\s*"


def without_flag(c: str | Column) -> Column:
    """A flagged line without its sign.  Emphasis that began before the sign goes with it where it held the whole line, and stays where it
    held a part."""
    whole, opener = F.regexp_extract(col(c), FLAG, 0), F.ltrim(F.regexp_extract(col(c), FLAG, 1))
    rest = col(c).substr(F.length(whole) + 1, F.length(col(c)))
    held = F.instr(rest, "**") == F.length(rest) - 1
    kept = F.when(opener == "", rest).when(held & (F.length(rest) > 1), rest.substr(F.lit(1), F.length(rest) - 2)).otherwise(F.concat(opener, rest))
    return F.when(col(c).rlike(FLAG), kept).otherwise(col(c))
