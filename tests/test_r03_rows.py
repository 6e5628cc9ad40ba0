"""Round 3: steps that made a row of every token, now done where the text lies."""

from __future__ import annotations

import __spark_entry__ as entry
from test_r03 import documents, exchanges, same_as_sql


def test_dashes_are_settled_in_their_rows(spark, tiny):
    """No line goes through a shuffle, but for a small table that is dealt to the cores."""
    from foliate.operators import dashes as D

    lines = spark.createDataFrame([(1, "a: b — c"), (2, "x ((( a: b) — c d. E — f"), (3, None), (4, " — ")], "n long, text string")
    found = D.settle_lines(lines, ["n"])
    assert exchanges(found) == 0
    assert dict(map(tuple, found.collect())) == {1: "a: b, c", 2: "x (((a: b), c d. E: f", 3: None, 4: " – "}
    plan = entry.queries()["dash_rule"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan


def test_units_and_their_source_meet_once(spark):
    """One shuffle a side, of texts and not of words; nothing is written for a later step."""
    from foliate.operators import verbatim as V

    sources = spark.createDataFrame([(1, "a b c d e “f” g, h. a b c d"), (2, "a b")], "doc_id long, text string")
    units = spark.createDataFrame([(1, 1, "C — D e \"f\""), (2, 1, "a b c d"), (3, 1, "b d c a"), (4, 2, "a b"), (5, 9, "a b c d")], "unit long, doc_id long, text string")
    found = V.find_units(sources, units)
    assert exchanges(found) <= 2
    assert sorted((r["unit"], r["state"], r["start"], r["end"]) for r in found.collect()) == [(1, "stands", 4, 13), (2, "stands", 0, 7), (3, "missing", None, None), (4, "short", None, None), (5, "missing", None, None)]


def test_tags_are_stripped_in_their_rows(spark, tiny):
    """A page's tokens are no rows, so a task holds one batch of pages whatever the input."""
    plan = entry.queries()["xml_text"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and "hashpartitioning" not in plan


def test_texts_are_normalised_in_their_rows(spark):
    """A text's lines with a dash neither leave it nor come back by a join."""
    from foliate.operators.normalise import normalised

    found = normalised(spark.createDataFrame([(1, "a — b\nc\n$x — y$ — re‐fit"), (2, None), (3, "")], "doc_id long, text string"))
    assert exchanges(found) == 0 and "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert dict(map(tuple, found.collect())) == {1: "a: b\nc\n$x — y$: refit", 2: None, 3: ""}


def test_emphasis_is_repaired_in_its_row(spark):
    """Marks and what lies between them are no rows."""
    from foliate.operators import emphasis as E

    found = E.repaired(spark.createDataFrame([(1, "a **b **c"), (2, "x"), (3, None), (4, "* a *** b ***")], "n long, text string"), ["n"])
    assert exchanges(found) == 0
    assert dict(map(tuple, found.collect())) == {1: "a **b** c", 2: "x", 3: None, 4: " *a  ***b*** "}


def test_openings_meet_lines_on_a_word(spark, tmp_path):
    """Windows are made only for openings without a word between two spaces; results are those of the SQL."""
    items = spark.createDataFrame([(1, "the opening of an item that is longer than forty characters"), (2, "短い文です。空白のない文章がここにある"), (3, "one two"), (4, ""), (5, "ab")], "item_id long, text string")
    docs = documents(spark, "x\nso the opening of an item that is longer than\n短い文です。空白のない文章がここにある!", "xone two", "one  two\nab\nthe opening of an item", None, "")
    found = same_as_sql(spark, tmp_path, "substring_context", documents=docs, benchmark=items)
    assert {(r[0], r[1]) for r in found} >= {(1, 0), (2, 0), (3, 1), (5, 2)}
    items.filter("item_id = 1").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    plan = entry.queries()["substring_context"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "sequence(" not in plan
