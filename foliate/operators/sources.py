"""What files say about themselves, read from bytes and text by built-in expressions, and how blocks are written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col

#: The code points of Windows-1252 from 128 to 159; bytes without one are the control of that number (fixed values).
WINDOWS_1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"


def decoded(content: str | Column) -> tuple[Column, Column]:
    """Text and encoding of a file: strict UTF-8, else Windows-1252; null and ``refused`` where a replacement character is in it already."""
    raw = col(content)
    utf8 = F.is_valid_utf8(raw.cast("string"))
    latin = F.translate(F.decode(raw, "ISO-8859-1"), "".join(map(chr, range(0x80, 0xA0))), WINDOWS_1252)
    text = F.when(utf8, raw.cast("string")).otherwise(latin)
    lost = text.contains("�")
    return F.when(~lost, text), F.when(lost, "refused").when(utf8, "utf-8").otherwise("windows-1252")


def relationships(xml: str | Column) -> Column:
    """Map of id to target of all relationship elements, in whatever order their attributes are; of an id that comes twice the last one counts."""
    elements = F.regexp_extract_all(col(xml), F.lit(r"<Relationship\s[^>]*>"), F.lit(0))
    attribute = lambda e, n: F.regexp_extract(e, rf'\s{n}="([^"]*)"', 1)
    pairs = F.transform(elements, lambda e: F.struct(attribute(e, "Id").alias("id"), attribute(e, "Target").alias("target")))
    named = F.filter(pairs, lambda p: p["id"] != "")
    later = lambda p, k: F.exists(F.slice(named, k + 2, F.size(named)), lambda q: q["id"] == p["id"])
    return F.map_from_entries(F.filter(named, lambda p, k: ~later(p, k)))


def pdf_facts(content: str | Column) -> tuple[Column, Column]:
    """Producer and number of pages, from a PDF's bytes read as Latin-1."""
    text = F.decode(col(content), "ISO-8859-1")
    return F.nullif(F.regexp_extract(text, r"/Producer\s*\(([^)]*)\)", 1), F.lit("")), F.regexp_count(text, F.lit(r"/Type\s*/Page(?![a-z])"))


def media_entries(names: str | Column) -> Column:
    """The media files among an archive's names, without the sidecar copies that some systems add."""
    return F.filter(col(names), lambda n: n.rlike(r"(?i)^word/media/[^/]+$") & ~n.rlike(r"/\._|^__MACOSX/"))


def authors_file(name: str | Column) -> Column:
    """Whether a file is an author's: no lock file, hidden file or readme."""
    base = F.regexp_extract(col(name), r"([^/]*)$", 1)
    return ~base.rlike(r"(?i)^(?:~\$|\.|readme)")


def tolerant_json(c: str | Column, schema: str) -> tuple[Column, Column]:
    """The value of a JSON text and what is wrong with it: absent is null, malformed says so and is no error."""
    text = col(c)
    state = F.when(text.isNull(), "absent").when(F.try_parse_json(text).isNull(), "malformed").otherwise("read")
    return F.when(state == "read", F.from_json(text, schema)), state


def newest(rows: DataFrame, by: str, order: str, line: str, field: str, side: str) -> DataFrame:
    """Per ``by`` the value of ``field`` in the last JSON line that has one and is no side line."""
    value, aside = F.get_json_object(line, f"$.{field}"), F.get_json_object(line, f"$.{side}")
    good = rows.select(by, order, value.alias("value"), aside.alias("aside")).filter("value IS NOT NULL AND coalesce(aside, 'false') <> 'true'")
    return good.groupBy(by).agg(F.max_by("value", order).alias("value"))


def markdown(blocks: DataFrame, by: str, order: str) -> DataFrame:
    """Blocks (text, is_item) as one Markdown text: a blank line between blocks, none between the items of a list."""
    row = F.struct(F.col(order).alias("o"), F.col("text").alias("t"), F.col("is_item").alias("i"))
    kept = F.filter(F.array_sort(F.collect_list(row)), lambda r: F.btrim(r["t"]) != "")
    texts = blocks.groupBy(by).agg(kept.alias("rows"))
    parts = F.transform("rows", lambda r, k: F.concat(F.when(k == 0, "").when(r["i"] & F.coalesce(F.get("rows", k - 1)["i"], F.lit(False)), "\n").otherwise("\n\n"), r["t"]))
    return texts.select(by, F.array_join(parts, "").alias("markdown"))


def markdown_table(rows: str | Column) -> Column:
    """Rows of cells as a pipe table: padded to the widest row, backslashes and pipes escaped in one pass, the first row its head."""
    width = F.array_max(F.transform(col(rows), lambda r: F.size(r)))
    cell = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"([\\|])", r"\\$1")

    def line(r: Column) -> Column:
        padded = F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r)))
        return F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))

    lines = F.transform(col(rows), line)
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
    return F.array_join(F.concat(F.slice(lines, F.lit(1), F.lit(1)), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")


def inventory(drawings: DataFrame, by: str) -> DataFrame:
    """Per document one JSON text: counts by kind and the media that no drawing refers to."""
    counts = drawings.groupBy(by).agg(
        F.count_if(F.col("kind") == "picture").alias("pictures"),
        F.count_if(F.col("kind") == "textbox").alias("textboxes"),
        F.count_if(F.col("kind") == "shape").alias("shapes"),
        F.array_sort(F.collect_set(F.when(~F.col("referenced"), F.col("file")))).alias("orphans"),
    )
    return counts.select(by, F.to_json(F.struct("pictures", "textboxes", "shapes", "orphans")).alias("inventory"))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``status`` in a given order, then by name: the place of each row within its status."""
    at = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("status"))
    return rows.withColumns({"group": at, "place": F.row_number().over(Window.partitionBy("status").orderBy("name"))})
