"""Blocks: islands of like neighbours, tables, packing, bytes and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold


def islands(rows: DataFrame, by: str, order: str, same: str) -> DataFrame:
    """``island``: number of the run of neighbours (within ``by``, along ``order``) that have the same ``same``."""
    w = Window.partitionBy(by).orderBy(order)
    starts = F.when(F.col(same).eqNullSafe(F.lag(same).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("__starts", starts).withColumn(
        "island", F.sum("__starts").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ).drop("__starts")


def merge_neighbours(rows: DataFrame, by: str, order: str, same: str, text: str) -> DataFrame:
    """Neighbours of one kind as one block, their texts joined in order by a blank line.  A merged block is one row, so a run of
    neighbours is held whole."""
    joined = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return (
        islands(rows, by, order, same)
        .groupBy(by, "island", same)
        .agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"), joined.alias("parts"))
        .withColumn("body", F.array_join(F.transform("parts", lambda p: p["t"]), "\n\n"))
        .drop("parts", "island")
    )


def merge_kinds(rows: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """All rows of one kind as one block: the first one's text is its title, order is kept."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    merged = rows.groupBy(*by).agg(F.min_by(text, order).alias("title"), F.count(F.lit(1)).alias("n"), parts.alias("parts"))
    return merged.withColumn("body", F.array_join(F.transform("parts", lambda p: p["t"]), "\n")).drop("parts")


def table_cells(text: str | Column) -> Column:
    """Cells of a pipe row, without the outer pipes."""
    t = F.col(text) if isinstance(text, str) else text
    bare = F.regexp_replace(F.btrim(t), r"^\||\|\z", "")
    return F.transform(F.split(bare, r"\|"), lambda c: F.btrim(c))


def is_separator(cells: Column) -> Column:
    """A row of dashes between a table's head and its body."""
    return F.forall(cells, lambda c: c.rlike(r"^:?-+:?\z"))


def split_long(paragraphs: DataFrame, most: int = 460, fill: float = 0.5) -> DataFrame:
    """Greedy splits of long prose: a new part begins at a lead once the current one is filled by ``fill``.

    ``paragraphs`` is (doc_id, pos, n_words, is_lead); a document's paragraphs are folded in order.  Documents of
    ``most`` words or fewer stay whole.  Returns (doc_id, pos, part).
    """
    whole = F.sum("n_words").over(Window.partitionBy("doc_id")) <= most

    def step(state: dict, n_words: int, is_lead: bool, whole: bool) -> tuple:
        if is_lead and not whole and state["held"] >= fill * most:
            state["part"], state["held"] = state["part"] + 1, 0
        state["held"] += n_words
        return (state["part"],)

    return fold(paragraphs.withColumn("whole", whole), ["doc_id"], ["pos"], ["n_words", "is_lead", "whole"], lambda: {"part": 0, "held": 0}, step, "part int")


def pack_batches(entries: DataFrame, by: str, order: str, size: str, most_bytes: int, most: int) -> DataFrame:
    """Greedy batches in order: a batch ends before the entry that would take it over its bytes or its count; an entry
    larger than a batch is one by itself.  One queue is one task's, as each batch starts where the last one ends."""
    rows = entries.select(by, F.col(order).cast("long").alias(order), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"))

    def step(state: dict, size: int) -> tuple:
        if state["n"] and (state["held"] + size > most_bytes or state["n"] >= most):
            state.update(batch=state["batch"] + 1, n=0, held=0)
        state["n"] += 1
        state["held"] += size
        return (state["batch"],)

    return fold(rows, [by], [order], ["size"], lambda: {"batch": 0, "n": 0, "held": 0}, step, "batch int")


#: First bytes of known kinds, from the formats' own specifications (hexadecimal, fixed values).
MAGIC = (
    ("pdf", "255044462D"),
    ("zip", "504B0304"),
    ("ole", "D0CF11E0A1B11AE1"),
    ("jpeg", "FFD8FF"),
    ("png", "89504E470D0A1A0A"),
    ("rtf", "7B5C727466"),
    ("gif", "47494638"),
    ("ps", "25215053"),
)


def sniff(content: str | Column) -> Column:
    """Kind of a file by its first bytes; ``text`` for valid UTF-8 of which over 95 % of the first 4 KiB are letters, marks, numbers,
    punctuation, symbols or white space; else ``unknown``.  A character that the cut at 4 KiB splits is left out."""
    c = F.col(content) if isinstance(content, str) else content
    head = F.hex(F.substring(c, 1, 8))
    digits = F.regexp_replace(F.hex(F.substring(c, 1, 4096)), "^((?:..)*?)(?:[C-F].|(?:E.|F.)[89AB].|F.[89AB].[89AB].)$", "$1")
    start = F.when(F.octet_length(c) > 4096, digits).otherwise(F.hex(c))
    text = F.try_to_binary(start, F.lit("hex")).cast("string")
    printable = F.regexp_count(text, F.lit(r"[\p{L}\p{M}\p{N}\p{P}\p{S}\p{Z}\t\r\n]"))
    is_text = F.is_valid_utf8(text) & (F.length(text) > 0) & (printable > 0.95 * F.length(text))
    out = F.when(is_text, "text").otherwise("unknown")
    for kind, magic in reversed(MAGIC):
        out = F.when(head.startswith(magic), kind).otherwise(out)
    return out


def image_whole(content: str | Column) -> Column:
    """Whether an image ends with its format's end mark (zero bytes after a JPEG's are allowed); null for others."""
    c = F.hex(F.col(content) if isinstance(content, str) else content)
    return F.when(c.startswith("FFD8FF"), F.regexp_replace(c, r"(?:00)+\z", "").endswith("FFD9")).when(
        c.startswith("89504E470D0A1A0A"), c.endswith("49454E44AE426082")
    )


def zip_reason(entries: Column, size: Column) -> Column:
    """Why an archive must not be unpacked, or null: names that leave the folder, 512 MiB, or 200 times its size and
    over 64 MiB.  ``entries`` is array<struct<name, uncompressed>>."""
    total = F.aggregate(entries, F.lit(0).cast("long"), lambda acc, e: acc + e["uncompressed"])
    bad = F.exists(entries, lambda e: e["name"].rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|\z)"))
    return F.when(bad, "name").when(total > 512 * 1024 * 1024, "size").when(
        (total > 200 * size) & (total > 64 * 1024 * 1024), "ratio"
    )


#: Severities from worst to least.
SEVERITIES = ("error", "warning", "note")


def worst_first(findings: DataFrame, by: str, k: int = 3) -> DataFrame:
    """The ``k`` worst findings of each ``by``, by severity, then by id."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    w = Window.partitionBy(by).orderBy(rank, "id")
    return findings.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def may_publish(findings: DataFrame, by: str) -> DataFrame:
    """Whether every finding is done, or accepted with a reason."""
    settled = (F.col("state") == "done") | ((F.col("state") == "accepted") & (F.length(F.btrim(F.coalesce("why", F.lit("")))) > 0))
    return findings.groupBy(by).agg(
        F.bool_and(F.coalesce(settled, F.lit(False))).alias("may_publish"), F.count_if(~F.coalesce(settled, F.lit(False))).alias("n_open")
    )
