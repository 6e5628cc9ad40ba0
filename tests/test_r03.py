"""Round 3: what grew faster than its input, or differed on larger tables."""

from __future__ import annotations

import time

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from foliate.functions import maths as M
from foliate.operators import chains as C
from foliate.operators import joins as J
from foliate.operators import layout as L
from foliate.operators import manifest as K
from foliate.queries import versions as Q


def same_as_sql(spark, folder, name, **tables):
    """A query over ``tables`` (written to ``folder``) against its SQL."""
    con = duckdb.connect()
    for t, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    found = entry.queries()[name](spark, str(folder))
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    want = sorted(con.execute(f"SELECT {', '.join(found.columns)} FROM ({entry.oracle_sql()[name]})").fetchall(), key=repr)
    assert got == want
    return got


def documents(spark, *texts):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_ampersands_of_a_text_are_drawn(spark, tmp_path):
    """A line of 59 characters with ampersands among them is too wide in a formula."""
    text = "\n".join(["x"] * 3 + ["a&&& b " * 8 + "ccc"])
    rules = same_as_sql(spark, tmp_path, "element_rules", documents=documents(spark, text))
    assert (0, 3, "formula_too_wide") in rules


def test_the_chain_is_followed_over_few_entries(spark, monkeypatch):
    """Of a queue only the first entries of each block are nodes of the chain, and the batches are those of a plain loop."""
    nodes = []
    reached = C.reached
    monkeypatch.setattr(C, "reached", lambda rows, *a: (nodes.append(rows.count()), reached(rows, *a))[1])
    rows = spark.range(5000).selectExpr("'q' AS q", "id AS at", "id % 7 AS size")
    got = [r["batch"] for r in C.greedy_batches(rows, "q", "at", "size", 12, 5, block=500).orderBy("at").collect()]
    assert nodes == [10 * 5]
    want, n, total, batch = [], 0, 0, -1
    for k in range(5000):
        if batch < 0 or n == 5 or total + k % 7 > 12:
            batch, n, total = batch + 1, 0, 0
        n, total = n + 1, total + k % 7
        want.append(batch)
    assert got == want


def exchanges(df) -> int:
    """Shuffles of a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange " in line and "Broadcast" not in line for line in plan.split("\n"))


def test_spans_take_no_text_through_a_shuffle(spark):
    """Spans are placed where their text lies."""
    t = spark.createDataFrame([(1, "a $x$ $$b$$ `$` $c$ d"), (2, "none"), (3, None)], "k int, text string")
    found = M.spans(t, ["k"])
    assert exchanges(found) == 0
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, False, 2, 5, "x"), (1, 2, True, 6, 11, "b"), (1, 3, False, 16, 19, "c")]


def test_spaces_are_repaired_in_linear_time(spark):
    """Pieces between textual groups are cut once: before, each of them cut the whole text again."""
    n = 8000
    t = spark.range(1).select(F.repeat(F.lit("a b \\text{u v} c \\d e "), n).alias("t")).select(M.repair_spaces("t").alias("t"))
    begun = time.monotonic()
    got = t.first()[0]
    assert time.monotonic() - begun < 15
    assert got.startswith("a\\ b\\ \\text{u v}\\ c \\d e\\ a\\ b") and got.count("\\ ") == 3 * n + n - 1


def test_lines_of_pages_take_one_shuffle(spark):
    """A page's runs come together once; its lines are found there."""
    rows = [(d, p, t, "x") for d in (1, None) for p in (1, 2) for t in (110, 104, 100, 107, 120, 112)]
    runs = spark.createDataFrame(rows, "doc_id long, page int, top int, text string")
    found = L.on_lines(runs)
    assert exchanges(found) == 1
    lines = {100: 100, 104: 100, 107: 107, 110: 107, 112: 107, 120: 120}
    assert sorted((r["top"], r["line"]) for r in found.filter("doc_id = 1 AND page = 2").collect()) == sorted(lines.items())


def test_bags_are_counted_in_one_shuffle(spark):
    """Source and readings go through the same one; a null word meets nothing."""
    source = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, "c"), (1, None)], "doc_id long, word string")
    read = spark.createDataFrame([(1, "a", True, False), (1, "b", True, True), (1, "c", False, False), (1, None, True, True), (2, "d", True, True)], "doc_id long, word string, in_first boolean, in_second boolean")
    found = J.bag_difference(source, read)
    assert exchanges(found) == 1
    assert sorted((tuple(r) for r in found.collect()), key=repr) == [(1, "a", 1), (1, "c", 1), (1, None, 1)]


def test_pieces_of_a_manifest_are_its_document(spark, tiny):
    """One behind the other they are what the whole document says, and no row holds a course."""
    course = Q._course(spark, tiny)
    whole = dict(tuple(r) for r in K.manifests(**course).collect())
    parts = K.manifest_parts(**course).orderBy("course", "part", "number", "slug").collect()
    for c, document in whole.items():
        own = [r for r in parts if r["course"] == c]
        assert own[0]["piece"] + ",".join(r["piece"] for r in own if r["part"] == 1) + own[-1]["piece"] == document
    read = Q.manifest_round_trip(spark, tiny)
    assert "collect_list(struct(struct(number" not in read._jdf.queryExecution().optimizedPlan().toString()


def test_runs_are_found_in_one_shuffle_a_side(spark):
    """No candidate place is a row: a word said a thousand times by both sides makes a million of them otherwise."""
    source = spark.range(1000).selectExpr("1L AS doc_id", "int(id div 100) AS line", "int(id % 100) AS i", "if(id = 950, 'z', 'a') AS word")
    published = spark.range(1200).selectExpr("1L AS doc_id", "int(id) AS i", "if(id = 1199, 'b', 'a') AS word")
    found = J.longest_runs(source, published)
    assert exchanges(found) == 2
    assert sorted(tuple(r) for r in found.collect()) == [(1, k, 100, 100 if k < 9 else 50) for k in range(10)]


def test_units_are_read_as_arrow(spark, tiny):
    """A unit's few blocks are no data frame of their own."""
    plan = entry.queries()["block_operations"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "InPandas" not in plan
