"""Versions, manifests and streams under repeats, restarts and refusals."""

from __future__ import annotations

import datetime as dt
import tempfile

import pytest

from foliate.operators import emphasis as E
from foliate.operators import manifest as M
from foliate.operators import versions as V
from foliate.streaming import resent as S


@pytest.fixture
def folder():
    return f"file://{tempfile.mkdtemp(prefix='foliate-versions-')}"


def test_commits_and_refusals(spark, folder):
    rows = spark.createDataFrame([(k, f"b{k}") for k in range(10)], "id long, body string")
    assert V.latest(spark, folder) is None
    assert V.commit(rows, folder) == 1 and V.commit(rows.orderBy("body", ascending=False), folder) == 1
    with pytest.raises(V.Shrinks, match="4 rows"):
        V.replace(rows.filter("id < 6"), folder, ["id"], "body")
    assert V.history(spark, folder).count() == 1 and V.latest(spark, folder).count() == 10
    plan = V.replace(rows.filter("id < 6").selectExpr("id", "IF(id = 2, null, body) AS body"), folder, ["id"], "body", confirm_shrink=True)
    assert sorted((r["id"], r["what"]) for r in plan.collect()) == [(2, "changed"), (6, "removed"), (7, "removed"), (8, "removed"), (9, "removed")]
    assert V.latest(spark, folder).count() == 6 and V.history(spark, folder).count() == 2
    assert V.commit(rows, folder) == 3  # what was there before comes back as a version of its own
    # rows that no log entry names, as a commit that ended half way leaves them, are not read
    rows.limit(1).write.parquet(f"{folder}/rows/lost")
    assert V.latest(spark, folder).count() == 10


def test_content_counts_repeats_and_nulls(spark):
    of = lambda rows: V.content_hash(spark.createDataFrame(rows, "a string, b string"))
    assert of([("x", "y")]) != of([("x", "y")] * 2) and of([("x", "y")])[0] == 1
    assert of([("xy", "")]) != of([("x", "y")]) and of([(None, "y")]) != of([("", "y")])
    assert of([("x", "y"), ("z", None)]) == of([("z", None), ("x", "y")]) and of([])[0] == 0


def test_upsert_is_all_or_none(spark):
    make = lambda rows: spark.createDataFrame(rows, "bank string, key string, stem string")
    stored = make([("a", "1", "x"), ("a", "2", "y"), ("b", None, "z"), ("b", "1", "w"), ("c", "1", "v")])
    declared = make([("a", "2", "Y"), ("a", "3", "n"), ("b", "1", "W"), ("c", "1", "v"), ("c", "1", "u"), ("d", "9", "new")])
    found = sorted(map(tuple, V.upsert(stored, declared, "bank", "key", "stem").collect()), key=repr)
    assert found == sorted([("a", "1", "left", "x"), ("a", "2", "updated", "Y"), ("a", "3", "created", "n"), ("b", None, "declined", "z"), ("b", "1", "declined", "w"), ("c", "1", "declined", "v"), ("d", "9", "created", "new")], key=repr)
    again = V.upsert(make([("a", "1", "x")]), make([("a", "1", "x")]), "bank", "key", "stem")
    assert [r["action"] for r in again.collect()] == ["same"]


def test_manifest_of_empty_parts_and_refusals(spark):
    make = spark.createDataFrame
    courses = make([(1, "c", "P", 'a "title"', "Week"), (2, "bare", "", "t", "Week")], "course long, slug string, programCode string, title string, topicTerm string")
    topics = make([(1, 10, 2, "two", "Two"), (1, 11, 1, "one", "One\nline")], "course long, topic long, number int, slug string, title string")
    blocks = make([(10, 2, "b2", "prose", "later"), (10, 1, "b1", "prose", "see [FIGURE:x.png] and [FIGURE:y.png]"), (10, 3, "b2", "prose", None)], "topic long, pos long, id string, type string, body string")
    questions = make([(11, 1, "k", "stem")], "topic long, pos long, key string, stem string")
    options = make([("k", 2, "no", False), ("k", 1, "yes", True)], "key string, pos int, text string, correct boolean")
    glossary = make([], "course long, term string, definition string")
    written = {r["course"]: r["manifest"] for r in M.manifests(courses, topics, blocks, questions, options, glossary).collect()}
    assert "glossary" not in written[1] and '"topics":[]' in written[2]
    m = {r["course"]: r["m"] for r in M.read_manifests(M.manifests(courses, topics, blocks, questions, options, glossary)).collect()}[1]
    assert [t["slug"] for t in m["topics"]] == ["one", "two"] and m["course"]["title"] == 'a "title"' and m["topics"][0]["title"] == "One\nline"
    assert [b["id"] for b in m["topics"][1]["blocks"]] == ["b1", "b2", "b2"] and m["topics"][0]["blocks"] == []
    assert [(o["text"], o["correct"]) for o in m["topics"][0]["questions"][0]["options"]] == [("yes", True), ("no", False)]
    found = sorted((r["course"], r["kind"], r["what"]) for r in M.problems(courses, topics, blocks).collect())
    assert found == [(1, "block", "two / b2"), (1, "picture", "two / b1: x.png"), (1, "picture", "two / b1: y.png"), (2, "programme", "bare")]
    twice = topics.unionByName(make([(1, 12, 3, "two", "Again")], topics.schema))
    with pytest.raises(Exception, match="two units of one slug in course 1"):
        M.unit_keys(twice).collect()
    with pytest.raises(Exception, match="MALFORMED|JsonEOF|arse"):
        M.read_manifests(make([(1, '{"version": "x"')], "course long, manifest string")).collect()
    some, used = M.sliced(topics, make([(1, "later", "d"), (1, "see", "d"), (1, "never", "d"), (2, "see", "d")], "course long, term string, definition string"), blocks, make([(1, "two")], "course long, slug string"))
    assert [r["topic"] for r in some.collect()] == [10] and sorted(r["term"] for r in used.collect()) == ["later", "see"]


def test_stream_goes_on_after_a_restart(spark, folder):
    schema = "doc_id long, text string, sent timestamp"
    at = lambda day: dt.datetime(2024, 1, day)
    send = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/landing")
    table = lambda: sorted(((r["doc_id"], r["text"], r["sent"].day) for r in S.read_table(spark, f"{folder}/table", schema).collect()), key=repr)
    run = lambda: S.ingest(spark, f"{folder}/landing", f"{folder}/table", buckets=4).awaitTermination()
    assert table() == []
    send([(1, "a", at(2)), (2, "b", at(2)), (1, "a", at(2)), (None, "n", at(1))])
    run()
    assert table() == sorted([(1, "a", 2), (2, "b", 2), (None, "n", 1)], key=repr)
    run()  # nothing new
    send([(1, "older", at(1)), (2, "newer", at(5)), (3, None, at(3))])
    run()
    want = sorted([(1, "a", 2), (2, "newer", 5), (3, None, 3), (None, "n", 1)], key=repr)
    assert table() == want
    # the last batch once more, as after a failure between its table and the stream's own log
    numbers = {r["batch"] for r in S._log(spark, f"{folder}/table").collect()}
    again = spark.createDataFrame([(1, "older", at(1)), (2, "newer", at(5)), (3, None, at(3))], schema)
    S._upsert(again, max(numbers), f"{folder}/table", schema, "doc_id", 4)
    assert table() == want


def test_emphasis_by_cases(spark):
    cases = {
        "Our **behaviour **— how": "Our **behaviour** — how", "the** clarity **and the** severity **of": "the **clarity** and the **severity** of", "as** engaged**: x": "as **engaged**: x",
        "confirmed.** Limitations: **": "confirmed. **Limitations:** ", "***Arousal*** is": "***Arousal*** is", "no **here** at": "no **here** at", "a **** b": "a *** *b", "": "", "x": "x", "**": "**",
        "** **": " ", "*a **b ***": "*a **b ***", "****x ****": "x ",
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "n long, text string")
    got = {r["n"]: r["text"] for r in E.repaired(rows, ["n"]).collect()}
    found = {c: got[k] for k, c in enumerate(cases)}
    assert found == cases
