"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the hash of its content.  A ledger keeps, for each pair of a blob and a
rule, what was found.  A rule's name there is a hash of all it says, so a changed rule is another one; what was scanned for the same
rules together lies in one folder, named after a hash of their names, and a table beside the ledger says which rules a folder is of.  Only pairs that the ledger lacks are scanned, one text for each blob and only for the rules that
it lacks, and findings are joined back to all paths and versions that hold the blob.  Spans come from built-in
expressions: the matches of a pattern and the text between them give every match its place.

Defined results: a null text is an empty blob, in which nothing is found; repeated rows are versions of their own;
equal texts are one blob; a null doc_id is one like others; an empty table gives an empty result; further columns are
ignored by :func:`scan` and kept by :func:`redact`.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, documents, let, lookup, materialise, shared_dir, table


class Rule(NamedTuple):
    """A kind of secret: leftmost, non-overlapping matches of ``pattern`` of which ``group`` has ``least`` characters.

    ``hint`` is a cheaper pattern that every text with such a match also matches."""

    kind: str
    pattern: str
    group: int
    least: int
    hint: str

    @property
    def version(self) -> str:
        """A hash of all that decides what the rule finds."""
        return hashlib.sha256(repr((self.kind, self.pattern, self.group, self.least, self.hint)).encode()).hexdigest()[:12]


#: The base rules (fixed values), then what this scan adds: provider tokens, signed web tokens, private key blocks.
BASE = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
        r"(?i:passw|secret|token|api_?key)",
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, "AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, "[0-9a-f]{24}"),
)
ADDED = (
    Rule("ghp", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, "gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20, "xox[abprs]-"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, r"eyJ[A-Za-z0-9_-]+\."),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", 0, 60, "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + ADDED
#: Steps of a running fold that are held in one small array.
CHUNK = 256
SPANS = "array<struct<start:int,rank:int,end:int>>"


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """``op`` (a sum or a maximum, from 0) over each beginning of an array of ints: chunk by chunk, as an array that grows by one
    element is copied each time."""

    def fold(x: Column) -> Column:
        return F.aggregate(x, F.array(F.lit(0)), lambda acc, v: F.concat(acc, F.array(op(F.element_at(acc, -1), v))))

    def spread(each: Column) -> Column:
        ends = fold(F.transform(each, lambda e: F.element_at(e, -1)))
        return let(ends, lambda o: F.flatten(F.transform(each, lambda e, i: F.transform(F.slice(e, F.lit(2), F.size(e)), lambda v: op(v, F.get(o, i))))))

    numbers = F.sequence(F.lit(0), F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / CHUNK).cast("int"))
    return let(F.transform(numbers, lambda k: fold(F.slice(values, k * CHUNK + 1, F.lit(CHUNK)))), spread)


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's spans: array of (start, rank, end) in code points, end exclusive."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hits
    between = F.split(text, rule.pattern, -1)
    each = F.zip_with(
        F.zip_with(hits, tested, lambda h, g: F.struct(F.length(h).alias("n"), F.length(g).alias("g"))),
        F.slice(F.transform(between, lambda x: F.length(x)), F.lit(1), F.size(hits)),
        lambda h, b: F.struct(b.alias("skip"), h["n"].alias("n"), h["g"].alias("g")),
    )

    def placed(x: Column) -> Column:
        ends = running(F.transform(x, lambda e: e["skip"] + e["n"]), lambda a, b: a + b)
        every = F.zip_with(x, ends, lambda e, end: F.struct((end - e["n"]).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), e["g"].alias("g")))
        fit = F.filter(every, lambda e: e["g"] >= rule.least)
        return F.transform(fit, lambda e: F.struct(e["start"].alias("start"), e["rank"].alias("rank"), e["end"].alias("end")))

    return F.when(text.rlike(rule.hint), let(each, placed)).otherwise(F.array().cast(SPANS))


def all_spans(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Spans of all rules by start, then in the order of the rules."""
    return F.array_sort(F.concat(*[spans(text, r, k) for k, r in enumerate(rules)]))


def ledger_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"


def _ledger(spark: SparkSession, path: str, versions: Sequence[str]) -> DataFrame | None:
    """The entries of folders that hold one of the rules; other folders are not read."""
    try:
        sets, entries = spark.read.parquet(f"{path}.sets"), spark.read.parquet(path)
    except AnalysisException:  # nothing was written there so far
        return None
    wanted = sets.filter(F.arrays_overlap(F.split("rules", "-"), F.array(*[F.lit(v) for v in versions])))
    folders = [r["folder"] for r in wanted.select("folder").distinct().collect()]  # one for each set of rules scanned together
    return entries.filter(F.col("folder").isin(folders))


def _folder(rules: Column) -> Column:
    """A name of fixed length, with a letter first, as a name of digits would be read as a number."""
    return F.concat(F.lit("r"), F.substring(F.sha2(rules, 256), 1, 24))


def _blob(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _texts(docs: DataFrame, todo: DataFrame) -> DataFrame:
    """blob, text and ``lacks`` of one row for each blob in ``todo``."""
    # a few bytes a blob: the document that stands for it, and a hash, as rows of one doc_id may hold other texts
    keys = todo.select(F.col("doc_id").alias("__id"), F.xxhash64("blob").alias("__h"), "lacks", "again")
    keys = F.broadcast(keys) if todo.count() <= BROADCAST_ROWS else keys
    docs = docs.withColumn("blob", _blob(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("blob") == F.col("__h"))
    found = docs.join(keys, same).select("blob", "text", "lacks", "again")
    if todo.filter("again").isEmpty():
        return found
    # a doc_id that has the same text more than once: these texts are shuffled
    return found.filter("NOT again").unionByName(found.filter("again").dropDuplicates(["blob"]))


def scan(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``found`` (spans) for every row of ``versions`` (doc_id, text), scanning only what ``ledger`` lacks.

    The pairs scanned now are appended to the ledger, blobs without a finding too.  A scan that is repeated after a failure
    writes the same pairs once more at most, which changes no result.
    """
    spark, wanted = versions.sparkSession, F.array(*[F.lit(r.version) for r in rules]).cast("array<string>")
    docs = documents(versions).withColumn("text", F.coalesce("text", F.lit("")))
    blobs = materialise(docs.select("doc_id", _blob(F.col("text")).alias("blob")), "blobs")
    versions = [r.version for r in rules]
    known = _ledger(spark, ledger, versions)
    each = blobs.groupBy("blob", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    each = each.groupBy("blob").agg(F.sum("n").alias("size"), F.min(F.struct("doc_id", "n")).alias("one"))
    each = each.select("blob", "size", F.col("one.doc_id").alias("doc_id"), (F.col("one.n") > 1).alias("again"))
    lacks = wanted
    if known is not None:
        seen = known.select("blob", F.split("rules", "-").alias("of")).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("of"))).alias("seen"))
        each = each.join(seen, "blob", "left")
        lacks = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
    each = materialise(each.select("blob", "size", "doc_id", "again", lacks.alias("lacks")), "each")
    todo = each.filter(F.size("lacks") > 0)
    if not todo.isEmpty():
        texts = _texts(docs, todo)
        none = F.array().cast(SPANS)
        found = [F.when(F.array_contains("lacks", r.version), spans(F.col("text"), r, k)).otherwise(none) for k, r in enumerate(rules)]
        versioned = F.transform(F.concat(*found), lambda s: F.struct(F.get(wanted, s["rank"]).alias("rule"), s["start"].alias("start"), s["end"].alias("end")))
        together = F.concat_ws("-", "lacks")
        sets = todo.select(together.alias("rules")).distinct()
        sets.select("rules", _folder(F.col("rules")).alias("folder")).write.mode("append").parquet(f"{ledger}.sets")
        texts = texts.select("blob", together.alias("rules"), versioned.alias("found"), _folder(together).alias("folder"))
        texts.write.mode("append").partitionBy("folder").option("compression", "zstd").parquet(ledger)
    known = _ledger(spark, ledger, versions)
    if known is None:  # no text so far
        return blobs.select("doc_id", "blob", F.array().cast(SPANS).alias("found"))
    hits = known.filter(F.size("found") > 0)
    ranked = F.transform("found", lambda s: F.struct(s["start"].alias("start"), (F.array_position(wanted, s["rule"]) - 1).cast("int").alias("rank"), s["end"].alias("end")))
    hits = hits.select("blob", F.filter(ranked, lambda s: s["rank"] >= 0).alias("found")).groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"))
    hits = hits.filter(F.size("found") > 0).join(each.select("blob", "size"), "blob")
    rows = lookup(blobs, materialise(hits, "hits"), "blob", "size", blobs.count(), F.col("doc_id"))
    return rows.select("doc_id", "blob", F.coalesce("found", F.array().cast(SPANS)).alias("found"))


def _listed(found: Column, rules: Sequence[Rule]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def redact(docs: DataFrame, ledger: str | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents with every found span replaced by the name of its kind; all columns stay.

    Spans that overlap are replaced as one, under the name of the first of them.
    """
    spark = docs.sparkSession
    found = scan(docs, ledger or ledger_path(spark), rules).filter(F.size("found") > 0)
    found = found.select(F.col("doc_id").alias("__id"), F.col("found").alias("__found"), F.col("blob").alias("__blob")).dropDuplicates(["__id", "__blob"])
    found = materialise(found, "found")
    if found.count() <= BROADCAST_ROWS // 10:  # a few spans each
        found = F.broadcast(found)
    kinds = F.array(*[F.lit(f"[{r.kind}]") for r in rules])
    text = F.coalesce("text", F.lit(""))

    def clean(reached: Column) -> Column:
        pieces = F.transform(
            "__found",
            lambda s, i: F.when(
                s["start"] >= F.coalesce(F.get(reached, i - 1), F.lit(0)),
                F.concat(_between(text, F.coalesce(F.get(reached, i - 1), F.lit(0)), s["start"]), F.get(kinds, s["rank"])),
            ).otherwise(""),
        )
        return F.concat(F.array_join(pieces, ""), _between(text, F.element_at(reached, -1), F.length(text)))

    cleaned = let(running(F.transform("__found", lambda s: s["end"]), lambda a, b: F.greatest(a, b)), clean)
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (_blob(text) == F.col("__blob"))
    wide = documents(docs, carry=True).join(found, same, "left")
    row = F.col("__row")
    new = F.when(F.col("__found").isNull(), row.getField("text")).otherwise(cleaned)
    return wide.select(*[new.alias(c) if c == "text" else row.getField(c).alias(c) for c in docs.columns])


def _between(text: Column, start: Column, end: Column) -> Column:
    return text.substr(start + 1, end - start)


def digests(scanned: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    counts = {f"n_{r.kind}": F.size(F.filter("found", _of(k))) for k, r in enumerate(BASE)}
    return scanned.select(
        "doc_id",
        *[c.cast("long").alias(n) for n, c in counts.items()],
        F.sha2(_listed(base, rules).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("found"), rules).alias("spans"),
    )


def _of(rank: int):
    return lambda s: s["rank"] == rank


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against a new ledger, so every blob is scanned once."""
    docs = table(spark, sf_dir, "documents")
    return digests(scan(docs, ledger_path(spark)))


def _sql_kind(rule: Rule, rank: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT rid, {rank} AS rank, '{rule.kind}' AS kind, unnest(range(len(h))) AS i, unnest(h) AS hit, unnest(g) AS grp,
    unnest(b[1:len(h)]) AS gap FROM (SELECT rid, regexp_extract_all(text, '{pattern}', 0) AS h,
    regexp_extract_all(text, '{pattern}', {rule.group}) AS g, string_split_regex(text, '{pattern}') AS b FROM d)"""


#: The query in DuckDB SQL, by the same gaps between matches.
SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({" UNION ALL ".join(_sql_kind(r, k) for k, r in enumerate(RULES))}),
least AS (SELECT * FROM (VALUES {", ".join(f"({k}, {r.least})" for k, r in enumerate(RULES))}) AS l(rank, least)),
placed AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY rid, rank ORDER BY i) AS stop FROM hits),
s AS (SELECT rid, rank, kind, (stop - length(hit))::BIGINT AS a, stop::BIGINT AS b, kind || ':' || (stop - length(hit))::BIGINT || ':' || stop::BIGINT AS said
  FROM placed JOIN least USING (rank) WHERE length(grp) >= least.least),
agg AS (SELECT rid, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2,
  string_agg(said, ',' ORDER BY a, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(said, ',' ORDER BY a, rank) AS spans FROM s GROUP BY rid)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN agg USING (rid)"""
