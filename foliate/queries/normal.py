"""Queries over text normalisation.  Characters that the given tables lack are put in by the same rule on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.brackets import without_tags
from ..operators.normalise import normalised
from ..session import table
from . import query
from .fixtures import LINES, lines, words_of_lines


def _docs(spark: SparkSession, sf_dir: str, text: Column, **columns: Column) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", text.alias("t"))
    return d.select("doc_id", *[c.alias(n) for n, c in columns.items()])


def _chars(c: Column | str) -> Column:
    return F.length(c).cast("long")


@query(
    """WITH RECURSIVE h AS (SELECT page_id, replace(replace(html, '<b>', '<<i>b>'), '&amp;', '&amp;lt;') AS html FROM pages), s AS (
  SELECT page_id, html AS t, 0 AS n FROM h
  UNION ALL SELECT page_id, regexp_replace(t, '<[^<>]*>', '', 'g'), n + 1 FROM s WHERE regexp_matches(t, '<[^<>]*>')
) SELECT h.page_id, md5(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&amp;', '&')) AS decoded,
  md5(arg_max(t, n)) AS stripped FROM h JOIN s USING (page_id) GROUP BY h.page_id, html"""
)
def xml_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities decoded and tags stripped until none is left, of raw pages with a tag put into another one."""
    p = table(spark, sf_dir, "pages").withColumn("html", F.replace(F.replace("html", F.lit("<b>"), F.lit("<<i>b>")), F.lit("&amp;"), F.lit("&amp;lt;")))
    p = without_tags(p.select("page_id", F.md5(T.decode_xml_once("html").cast("binary")).alias("decoded"), F.col("html").alias("text")), ["page_id", "decoded"])
    return p.select("page_id", "decoded", F.md5(F.col("text").cast("binary")).alias("stripped"))


@query(
    """SELECT doc_id, len(list_filter(string_split_regex(text, '[ \\t\\n]+'), lambda w: w <> ''))::BIGINT AS spaced,
  len(regexp_extract_all(lower(text), '\\p{L}{3,}'))::BIGINT AS letters, len(regexp_extract_all(text, '[\\p{L}\\p{N}]+'))::BIGINT AS with_digits FROM documents"""
)
def three_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: F.size(c).cast("long")
    return _docs(
        spark, sf_dir, F.col("text"), spaced=n(T.words_spaced("t")), letters=n(T.words_of_letters("t")), with_digits=n(T.words_with_digits("t"))
    )


FP = "substring(lower(trim(regexp_replace(translate(text, '*_`#>', ''), '[ \\t\\n]+', ' ', 'g'), ' ')), 1, 120)"


@query(
    f"""WITH f AS (SELECT source, {FP} AS fp, doc_id FROM documents)
SELECT source, fp, count(*)::BIGINT AS n, min(doc_id) AS first FROM f GROUP BY ALL HAVING count(*) > 1"""
)
def fingerprint_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ambiguous keys: fingerprints that a source has more than once."""
    d = table(spark, sf_dir, "documents").select("source", T.fingerprint("text").alias("fp"), "doc_id")
    return d.groupBy("source", "fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


SLUG = "regexp_replace(replace(lower(strip_accents(t)), '&', ' and '), '[^a-z0-9]+', '-', 'g')"


@query(
    f"""WITH {LINES}, f AS (SELECT doc_id, pos, text || ' & Čapek ő' AS t FROM lines)
SELECT doc_id, pos::BIGINT AS pos, trim(substring(trim({SLUG}, '-'), 1, 44), '-') AS unit_slug, substring(trim({SLUG}, '-'), 1, 80) AS course_slug FROM f"""
)
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both slugs of every line."""
    t = lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), F.concat("text", F.lit(" & Čapek ő")).alias("t"))
    return t.select("doc_id", "pos", T.slug("t").alias("unit_slug"), T.slug("t", 80, trim_last=False).alias("course_slug"))


@query(
    """WITH f AS (SELECT doc_id, replace(replace(text, chr(10), chr(10) || 'Page 3 of 12' || chr(10)), ', ', ' Page 4 of 12 | Acme ') AS t FROM documents),
g AS (SELECT doc_id, regexp_replace(t, '\\n[ ]*(?:[A-Z][A-Za-z]+ \\| )?Page [0-9]+ of [0-9]+(?: \\| [A-Z][A-Za-z]+)?[ ]*\\n', chr(10) || chr(10), 'g') AS t FROM f)
SELECT doc_id, md5(regexp_replace(t, '[ ]*(?:[A-Z][A-Za-z]+ \\| )?Page [0-9]+ of [0-9]+(?: \\| [A-Z][A-Za-z]+)?[ ]*', ' ', 'g')) AS clean FROM g"""
)
def furniture_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.replace("text", F.lit("\n"), F.lit("\nPage 3 of 12\n"))
    t = F.replace(t, F.lit(", "), F.lit(" Page 4 of 12 | Acme "))
    return _docs(spark, sf_dir, t, clean=F.md5(T.strip_furniture("t").cast("binary")))


@query(
    """WITH f AS (SELECT doc_id, replace(replace(text, 'ti', 't' || chr(8208) || ' ' || chr(10) || '  i'), 'er ', 'er' || chr(8208) || ' ') AS t FROM documents),
g AS (SELECT doc_id, regexp_replace(t, '(\\p{L})' || chr(8208) || '[ \\t]*\\r?\\n?[ \\t]*(\\p{L})', '\\1\\2', 'g') AS t FROM f)
SELECT doc_id, md5(t) AS joined, (length(t) - length(replace(t, chr(8208), '')))::BIGINT AS left_over FROM g"""
)
def soft_hyphen_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.replace(F.replace("text", F.lit("ti"), F.lit("t‐ \n  i")), F.lit("er "), F.lit("er‐ "))
    joined = T.join_hyphens("t")
    return _docs(spark, sf_dir, t, joined=F.md5(joined.cast("binary")), left_over=T.hyphens_left(joined).cast("long"))


@query(
    """WITH f AS (SELECT doc_id, replace(replace(replace(text, ' the ', ' \\\\*the\\_ \\# \\! '), '.', '\\.'), ', ', ' \\~\\=\\(\\) ') AS t FROM documents)
SELECT doc_id, md5(regexp_replace(t, '\\\\+([~+=)(\\[\\]*_-])', '\\1', 'g')) AS clean FROM f"""
)
def escape_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escapes of the ten characters go; those of a heading's mark, an exclamation mark and a dot stay."""
    t = F.replace(F.replace("text", F.lit(" the "), F.lit(" \\\\*the\\_ \\# \\! ")), F.lit("."), F.lit("\\."))
    t = F.replace(t, F.lit(", "), F.lit(" \\~\\=\\(\\) "))
    return _docs(spark, sf_dir, t, clean=F.md5(T.strip_escapes("t").cast("binary")))


@query(
    """WITH f AS (SELECT doc_id, replace(replace(text, ', ', ' ,' || chr(160)), chr(10), ' ;' || chr(10)) AS t FROM documents)
SELECT doc_id, md5(regexp_replace(replace(t, chr(160), ' '), ' +([,;:!?])', '\\1', 'g')) AS clean FROM f"""
)
def punctuation_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.replace(F.replace("text", F.lit(", "), F.lit(" , ")), F.lit("\n"), F.lit(" ;\n"))
    return _docs(spark, sf_dir, t, clean=F.md5(T.close_punctuation(T.plain_spaces("t")).cast("binary")))


@query(
    f"""WITH {LINES}, f AS (SELECT doc_id, pos, '1.' || (doc_id % 9) || ' ' || text || ' :' AS t FROM lines)
SELECT doc_id, pos::BIGINT AS pos, md5(regexp_replace(t, '^[0-9]+(?:\\.[0-9]+)*[.)]?[ ]+', '')) AS title,
  len(string_split_regex(trim(t, ' '), ' +')) <= 6 AND NOT regexp_matches(trim(t, ' '), '[.!?]$') AS short_label FROM f"""
)
def heading_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a heading: without its number, and whether it is a short label."""
    t = F.concat(F.lit("1."), (F.col("doc_id") % 9).cast("string"), F.lit(" "), "text", F.lit(" :"))
    rows = lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), t.alias("t"))
    return rows.select("doc_id", "pos", F.md5(T.strip_heading_number("t").cast("binary")).alias("title"), T.is_short_label("t").alias("short_label"))


@query(
    f"""WITH {LINES}, f AS (SELECT doc_id, pos, trim(text, ' ') AS t FROM lines),
g AS (SELECT *, substring(t, 1, 118) AS head FROM f), h AS (
  SELECT *, CASE WHEN instr(head, ' ') = 0 THEN 0 ELSE length(head) - instr(reverse(head), ' ') + 1 END AS space FROM g),
i AS (SELECT *, CASE WHEN space > 40 THEN space - 1 ELSE 118 END AS cut FROM h)
SELECT doc_id, pos::BIGINT AS pos, md5(CASE WHEN length(t) > 120 THEN substring(t, 1, cut) ELSE t END) AS label,
  md5(CASE WHEN length(t) > 120 THEN trim(substring(t, cut + 1), ' ') ELSE '' END) AS note FROM i"""
)
def step_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a step: its label and the note that takes the rest."""
    label, rest = T.label_and_rest("text")
    rows = lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), label.alias("label"), rest.alias("note"))
    return rows.withColumns({c: F.md5(F.col(c).cast("binary")) for c in ("label", "note")})


DASH = chr(0x2014)


@query(
    f"""WITH f AS (SELECT doc_id, replace(text, ' the ', ' {DASH} the ') AS t FROM documents)
SELECT doc_id, (length(t) - length(replace(t, '{DASH}', '')))::BIGINT AS dashes, (length(t) - length(replace(t, '*', '')))::BIGINT AS stars,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^\\|') AND length(x) > 500))::BIGINT AS wide_rows,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^[-*+] ')))::BIGINT AS typed_bullets FROM f"""
)
def preflight_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.replace("text", F.lit(" the "), F.lit(f" {DASH} the "))
    n = lambda c: (F.length("t") - F.length(F.replace("t", F.lit(c), F.lit("")))).cast("long")
    rows = F.split("t", "\n")
    return _docs(
        spark, sf_dir, t, dashes=n(DASH), stars=n("*"),
        wide_rows=F.size(F.filter(rows, lambda x: x.rlike(r"^\|") & (F.length(x) > 500))).cast("long"),
        typed_bullets=F.size(F.filter(rows, lambda x: x.rlike("^[-*+] "))).cast("long"),
    )


#: A line around its words: a dash, a formula with all that the rules would change, a broken word, an escape, a footer, a space that does not break.
RAW = "w || ' ends — so $a — b \\[ c‐d$ holds ' || w || ' e\\[f re‐fit' || CASE WHEN pos % 3 = 0 THEN chr(10) || 'Page 3 of 12' || chr(10) || '$$x — y' || chr(10) || '\\[ z$$ t' WHEN pos % 3 = 1 THEN ' Page 4 of 12 | Acme x' ELSE '' END".replace("\\u00a0", chr(160))
CLEAN = "w || ' ends, so $a — b \\[ c‐d$ holds ' || w || ' e[f refit' || CASE WHEN pos % 3 = 0 THEN chr(10) || chr(10) || '$$x — y' || chr(10) || '\\[ z$$ t' WHEN pos % 3 = 1 THEN ' x' ELSE '' END"
LINE_WORDS = "coalesce(nullif(trim(regexp_replace(regexp_replace(text, '[^A-Za-z ]+', '', 'g'), ' +', ' ', 'g'), ' '), ''), 'none')"


@query(f"""WITH {LINES}, w AS (SELECT doc_id, pos, {LINE_WORDS} AS w FROM lines) SELECT doc_id, md5(string_agg({CLEAN}, chr(10) ORDER BY pos)) AS text FROM w GROUP BY doc_id""")
def normalised_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts through all rules for prose; formulas hold what each rule would change and keep it."""
    raw = F.expr("transform(ws, (w, pos) -> " + RAW.replace("\\[", "\\\\[") + ")")
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", words_of_lines("text").alias("ws"))
    found = normalised(rows.select("doc_id", F.array_join(raw, "\n").alias("text")))
    return found.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"))
