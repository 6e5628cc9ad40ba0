"""Queries that SQL cannot express, against plain loops over the same tables."""

from __future__ import annotations

from collections import defaultdict

import pytest

import __spark_entry__ as entry
from foliate.functions import text as T
from foliate.operators import blocks as B
from foliate.operators import rules as R
from pyspark.sql import functions as F


def run(spark, tiny, name):
    return entry.queries()[name](spark, tiny).collect()


@pytest.fixture(scope="module")
def texts(spark, tiny):
    return {r["doc_id"]: r["text"].split("\n") for r in spark.read.parquet(f"{tiny}/documents.parquet").collect() if r["text"] is not None}


def test_longest_run(spark, tiny, texts):
    want = {}
    for d, ls in texts.items():
        published = []
        for pos, line in enumerate(ls):
            ws = line.split()
            if pos % 17 != 16:
                published += ws[:-3] if pos % 10 == 9 else ws
        at = defaultdict(list)
        for i, w in enumerate(published):
            at[w].append(i)
        for pos, line in enumerate(ls):
            ws, best = line.split(), 0
            for p in at.get(ws[0], ()) if ws else ():
                n = 0
                while n < len(ws) and p + n < len(published) and published[p + n] == ws[n]:
                    n += 1
                best = max(best, n)
            if ws:
                verdict = "whole" if best >= len(ws) else "cut" if best >= 4 and best >= 0.5 * len(ws) else "gone"
                want[d, pos] = (len(ws), best, verdict)
    got = {(r["doc_id"], r["line"]): (r["want"], r["best"], r["verdict"]) for r in run(spark, tiny, "longest_run")}
    assert got == want
    assert {v[2] for v in want.values()} >= {"whole", "cut"}


def test_bin_packing(spark, tiny):
    queues = defaultdict(list)
    for r in spark.read.parquet(f"{tiny}/events.parquet").orderBy("event_id").collect():
        queues[f"{r['event_type']}/{r['ts'].hour}"].append((r["event_id"], r["value"]))
    got = {(r["queue"], r["event_id"]): r["batch"] for r in run(spark, tiny, "bin_packing")}
    sizes = {r["event_id"]: r["s"] for r in spark.read.parquet(f"{tiny}/events.parquet").select("event_id", F.greatest(F.round("value"), F.lit(0.0)).cast("long").alias("s")).collect()}
    for q, items in queues.items():
        batch = held = n = 0
        for e, _ in items:
            if n and (held + sizes[e] > 500 or n >= 50):
                batch, held, n = batch + 1, 0, 0
            held, n = held + sizes[e], n + 1
            assert got[q, e] == batch
    assert max(got.values()) > 0 and len(got) == sum(map(len, queues.values()))


def test_prose_split(spark, tiny, texts):
    got = {(r["doc_id"], r["pos"]): r["part"] for r in run(spark, tiny, "prose_split")}
    want = {}
    for d, ls in texts.items():
        n_words = [len([w for w in x.replace("\t", " ").split(" ") if w]) for x in ls]
        part = held = 0
        for pos, n in enumerate(n_words):
            if sum(n_words) > 460 and pos % 4 == 0 and held >= 230:
                part, held = part + 1, 0
            held += n
            want[d, pos] = part
    assert got == want and max(want.values()) > 0


def test_list_nesting(spark, tiny, texts):
    got = {(r["doc_id"], r["pos"]): r["depth"] for r in run(spark, tiny, "list_nesting")}
    for d, ls in texts.items():
        stack = []
        for pos in range(len(ls)):
            if pos % 11 == 10:
                stack = []
                continue
            if not ls[pos].strip(" "):
                continue  # an empty item: its class is that of the marker alone
            indent = 2 * (pos % 3)
            stack = [s for s in stack if s + 2 <= indent]
            assert got[d, pos] == len(stack)
            stack.append(indent)


def test_question_lift_needs_every_answer(spark):
    from foliate.operators import joins as J

    sheet = ["**1.** a", "**A.** x", "**B.** y", "**2.** b", "**A.** x", "**3.** c", "**B.** x", "**1.** A — for", "**2.** A - so", "**3.** B – as"]
    rows = [(d, k, t) for d in (1, 2) for k, t in enumerate(sheet)] + [(3, k, t) for k, t in enumerate(sheet[:-1])]
    rows = [(d, k, t.replace("**3.** B", "**3.** D") if d == 2 else t) for d, k, t in rows]
    got = {(r["doc_id"], r["number"], r["letters"], r["answer"]) for r in J.lift_questions(spark.createDataFrame(rows, "doc_id long, pos int, text string")).collect()}
    assert got == {(1, 1, "AB", "A"), (1, 2, "A", "A"), (1, 3, "B", "B")}  # 2 names no option, 3 lacks an answer


def test_text_functions_by_cases(spark):
    cases = [
        (T.decode_xml("t"), "&amp;lt; &lt;b&gt;", "&lt; <b>"),
        (T.close_punctuation("t"), "a , b ; 3 .5 .", "a, b; 3 .5."),
        (T.strip_heading_number("t"), "1.2.3 Title", "Title"),
        (T.plain_heading("t"), "2) Big Idea :", "big idea"),
        (T.escape_latex("t"), "50% & $3_x", r"50\% \& \$3\_x"),
        (T.escape_latex("t"), "a\\b~c^d", r"a\textbackslash{}b\textasciitilde{}c\textasciicircum{}d"),
        (T.decode_xml_once("t"), "\ue000 &amp;lt;", "\ue000 &lt;"),
        (T.decode_numeric("t"), "&#233;&#x1F600;&#xD800;&#0;", "é😀&#xD800;&#0;"),
        (T.slug("t"), "Šťastný Čapek & ő", "stastny-capek-and-o"),
        (T.strip_escapes("t"), r"\# \! \~ \= \\_ \.", r"\# \! ~ = _ \."),
        (T.join_hyphens("t"), "be\u2010 \n  fore \u2010 x", "before \u2010 x"),
        (T.strip_furniture("t"), "a\nPage 3 of 12\nPage 4 of 12\nb", "a\n\n\nb"),
        (T.media_path("t"), "a/b/../../c.png", "word/c.png"),
        (T.flatten_space("t"), "\ta\t b \n c", "a  b\nc"),
        (T.escape_markdown("t"), "a*b_c", r"a\*b\_c"),
        (T.prose_like_maths("t").cast("string"), "one two three four five six seven", "true"),
        (T.prose_like_maths("t").cast("string"), "one two three four five six = seven", "false"),
        (T.media_path("t"), "media/../img/./a.png", "word/img/a.png"),
        (T.media_path("t"), "/x/a.png", "x/a.png"),
        (T.label_left_of_equals("t", most=10), "Revenue = 3 + 4 + 5 + 6", "Revenue"),
        (T.word_hyphens("t"), "a<w:noBreakHyphen/>b<w:softHyphen/>c", "a-bc"),
    ]
    for expr, given, want in cases:
        assert spark.createDataFrame([(given,)], "t string").select(expr.alias("x")).first()["x"] == want, given


def test_no_rule_or_queue_is_one_array(spark):
    matches = spark.range(3000).selectExpr("cast(id AS string) AS file_id", "'all' AS rule_id")
    rules = spark.createDataFrame([("all", "f", "1"), ("none", "f", "2")], R.RULES_SCHEMA)
    report, e = R.report(matches, rules), spark.range(3000).selectExpr("'q' AS queue", "id", "id % 9 AS size")
    want = ",".join(sorted(map(str, range(3000)))[:8])
    assert {tuple(r) for r in report.collect()} == {("all", 3000, want), ("none", 0, "")}
    packed = B.pack_batches(e, "queue", "id", "size", 20, 5)
    batch = held = n = 0
    for r in packed.orderBy("id").collect():
        s = r["id"] % 9
        if n and (held + s > 20 or n >= 5):
            batch, held, n = batch + 1, 0, 0
        held, n = held + s, n + 1
        assert r["batch"] == batch
    plans = [f._jdf.queryExecution().optimizedPlan().toString() for f in (report, packed)]
    assert "collect_set" not in plans[0] and "collect_list" not in plans[1]


@pytest.mark.parametrize("name", ["list_depths", "heading_before", "drained_before", "split_long", "pack_batches"])
def test_one_long_key_takes_linear_time(spark, name):
    """40,000 lines, points or entries of one document, folded or framed in a few seconds."""
    import time

    from foliate.operators import joins as J
    from foliate.operators import lines as L

    n = 40_000
    lines = spark.range(n).selectExpr("1L AS doc_id", "cast(id AS int) AS pos", "CASE WHEN id % 50 = 0 THEN '# head' ELSE concat(repeat(' ', cast(id % 3 * 2 AS int)), '- item') END AS text")
    run = {
        "list_depths": lambda: L.list_depths(lines),
        "heading_before": lambda: L.heading_before(lines),
        "drained_before": lambda: J.drained_before(spark.range(n).selectExpr("1L AS doc_id", "id AS at", "id AS point_id"), spark.range(n).selectExpr("1L AS doc_id", "id * 2 AS end", "id AS block_id")),
        "split_long": lambda: B.split_long(spark.range(n).selectExpr("1L AS doc_id", "cast(id AS int) AS pos", "5 AS n_words", "id % 3 = 0 AS is_lead")),
        "pack_batches": lambda: B.pack_batches(spark.range(n).selectExpr("'q' AS queue", "id", "id % 9 AS size"), "queue", "id", "size", 20, 5),
    }[name]
    run().limit(1).collect()  # workers and code
    began = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    assert time.perf_counter() - began < 8  # quadratic forms took from 50 s


def test_levels_of_long_chains_and_circles(spark):
    from foliate.operators import joins as J

    rows = [(f"s{k}", 3 if k == 0 else None, f"s{k - 1}" if k else None) for k in range(100)] + [("a", None, "b"), ("b", None, "c"), ("c", None, "a"), ("lost", None, "gone")]
    got = {r["style"]: r["level"] for r in J.inherited_levels(spark.createDataFrame(rows, "style string, level int, based_on string")).collect()}
    assert got == {**{f"s{k}": 3 for k in range(100)}, "a": None, "b": None, "c": None, "lost": None}


def test_prefixes_of_any_length_and_unused_ones(spark):
    from foliate.operators import joins as J

    titles = spark.range(1, 1500).selectExpr("repeat('x', cast(id AS int)) AS prefix", "cast(id AS string) AS title", "-id AS ord")
    rows = spark.createDataFrame([(1, "x" * 1300), (2, "xy"), (3, "y"), (4, "")], "row_id long, text string")
    assert {r["row_id"]: r["title"] for r in J.first_prefix(rows, titles).collect()} == {1: "1300", 2: "1", 3: None, 4: None}
    assert J.unused_prefixes(rows, titles).count() == 1499 - 2


def test_repeated_facts_and_ids_that_begin_alike(spark):
    facts = spark.createDataFrame([("f", "n", "7"), ("f", "n", "7"), ("f", "lang", "en"), ("g", "n", "7")], R.FACTS_SCHEMA)
    rules = spark.createDataFrame([("r", "n", "> 5"), ("r", "lang", "en")], R.RULES_SCHEMA)
    assert [tuple(r) for r in R.match(facts, rules).collect()] == [("f", "r")]
    two = spark.createDataFrame([("a" * 20 + "1", "r"), ("a" * 20 + "2", "r")], "file_id string, rule_id string")
    (row,) = R.report(two, rules).collect()
    assert row["samples"] == f"{'a' * 20}1,{'a' * 20}2"


def test_leads_wait_over_lists_and_end_at_headings(spark):
    from foliate.operators import lines as L

    text = ["**lead**", "- item", "words one", "words two", "#### deep", "words three", "**gone**", "## next", "words four"]
    lines = spark.createDataFrame([(1, k, t) for k, t in enumerate(text)], "doc_id long, pos int, text string")
    assert {r["text"]: r["lead"] for r in L.join_leads(lines).collect()} == {"words one": "lead", "words two": None, "words three": "deep", "words four": None}


def test_items_of_other_parents_are_no_siblings(spark):
    from foliate.operators import lines as L

    text = ["- a", "  1. x", "- b", "  1. y", "  2. z"]
    lines = spark.createDataFrame([(1, k, t) for k, t in enumerate(text)], "doc_id long, pos int, text string")
    assert {r["pos"]: r["keeps_number"] for r in L.numbered_siblings(lines).collect()} == {1: False, 3: True, 4: True}


def test_maths_by_cases(spark):
    from foliate.functions import maths as M

    one = lambda expr, given: spark.createDataFrame([(given,)], "t string").select(expr.alias("x")).first()["x"]
    assert one(M.inline_spans("t"), r"a $x$ b $ y $ $p = \$5$ `$c$` $q$2 $z$$w$") == ["x", r"p = \$5", "z"]
    assert one(M.display_spans("t"), "a $$x\ny$$ b ```$$no$$```") == ["x\ny"]
    assert one(M.repair_spaces("t"), r"a b c \alpha x 2 y \text{in it} z 3 \text{u} \text{v} \beta \text{w}") == r"a\ b\ c \alpha x 2 y\ \text{in it}\ z 3\ \text{u}\ \text{v} \beta \text{w}"
    assert one(M.drawn_width("t"), r"\frac{\frac{abcdef}{gh}}{ij} + x \\ y") == 12  # an outer fraction is met before the one in it
    assert one(M.in_prose("t", F.upper), "ab $cd$ ef `gh` $$ij$$ k") == "AB $cd$ EF `gh` $$ij$$ K"


def test_examples_cross_text_only_before_working(spark):
    from foliate.operators import ordered as O

    text = ["**Example**: a", "intent", "$$x$$", "after", "# h", "**Example**: b", "one", "two", "three", "four", "five", "**Step 1: s**", "**Example**: c", "- li", "| t |", "- li"]
    lines = spark.createDataFrame([(1, k, t) for k, t in enumerate(text)], "doc_id long, pos int, text string")
    assert {r["pos"]: r["example"] for r in O.example_runs(lines).collect()} == {0: 0, 1: 0, 2: 0, **{k: 5 for k in range(5, 12)}, 12: 12, 13: 12, 14: 12}
    reach = ["**Example**: a", "one", "two", "three", "four", "$$x$$", "**Example**: b", "one", "two", "three", "1. x", "said", "more", "- y", "**Example**: c", "one", "# h", "- z", "- **Example**: d", "one", "two", "- z"]
    lines = spark.createDataFrame([(1, k, t) for k, t in enumerate(reach)], "doc_id long, pos int, text string")
    # four paragraphs are in reach before any working, one after it; an example that is an item has working
    assert sorted(r["pos"] for r in O.example_runs(lines).collect()) == [0, 6, 7, 8, 9, 10, 14, 18]


def test_block_operations_see_what_came_before(spark):
    from foliate.operators import ops as K

    block = f"unit long, place int, {K.BLOCK}"
    row = lambda unit, place, name, body, kind="prose": (unit, place, name, kind, None, None, body, None)
    blocks = spark.createDataFrame([row(1, 0, "a", "p"), row(1, 1, "b", "## Title\n\nx = 1\n\nstop\n\nrest"), row(2, 0, "a", "q <!-- style: x -->"), row(3, 0, "a", None)], block)
    op = lambda seq, what, name, arg=None, unit=1, find=None, put=None: (unit, seq, what, name, arg, None, find, put)
    ops = spark.createDataFrame(
        [op(1, "rename", "a", "z"), op(2, "rename", "b", "z"), op(3, "after", "z", put=[("n", "prose", None, "new"), ("b", "prose", None, "twin")]), op(4, "worked", "b"), op(5, "move", "b", "z"), op(6, "cut", "z", "p"), op(7, "remove", "nobody"),
         op(1, "cut", "a", "x", unit=3), op(2, "worked", "a", unit=3), op(3, "formula", "a", unit=3, find=["", "x"], put=[("f", "formula", None, "y")])],
        K.OPS,
    )
    rows = K.apply_ops(blocks, ops).orderBy("unit", "place").collect()
    # the twin stands before the old b by then, so it is the one that is met: no heading, no calculation
    assert [(r["unit"], r["id"], r["type"], r["body"]) for r in rows][:4] == [(1, "b", "prose", "twin"), (1, "z", "prose", "p"), (1, "n", "prose", "new"), (1, "b", "prose", "## Title\n\nx = 1\n\nstop\n\nrest")]
    assert rows[0]["log"] == "rename:done,rename:taken,after:done,worked:no title,move:done,cut:empties,remove:missing,twice"
    assert [(r["unit"], r["log"]) for r in rows][4:] == [(2, "marker"), (3, "cut:no line,worked:no title,formula:does not follow")]


def test_worked_examples_by_the_rule():
    from foliate.operators import ops as K

    def of(body, title=None):
        made = K.worked([K._new(id="b", type="prose", body=body)], 0, {"id": "b", "title": title})[0]
        return made["title"], made["problem"], [(s["label"], s["note"]) for s in made["steps"]]

    long = "w" * 130
    assert of("### Costs\n\nHow  much?\n\nWhy?\n\n**a** = 1\n\nSo:\n\nthen it is:\n\nb = 2\n\nDone.\n\nReally.") == ("Costs", "How  much?\n\nWhy?", [("a = 1", None), ("So: then it is", "b = 2 Done. Really.")])
    assert of(f"net, = {long}\n\n{long}\n\nc: = 3\n\n= {long}", "T") == ("T", None, [("net", f"net, = {long}"), ("c", f"{long} c: = 3"), ("Continue", f"= {long}")])
    for body in ("# one\n\nno title = 1", "## T\n\nno sum"):
        with pytest.raises(K.Refused):
            of(body)


def test_an_unknown_key_is_refused(spark):
    from foliate.operators import relations as Q

    a, b = spark.createDataFrame([(1,), (2,)], "key long"), spark.createDataFrame([(1, "x")], "key long, v string")
    with pytest.raises(ValueError, match="no target for key 2"):
        Q.strict(a, b, "key")


def test_dashes_by_cases_and_in_linear_time(spark):
    import time

    from foliate.functions import maths as M
    from foliate.operators import dashes as D

    def settle(texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "n long, t string").select("n", M.hold("t").alias("h"))
        done = D.settle_lines(rows.select("n", F.col("h.text").alias("text")), ["n"]).join(rows, "n")
        return [r["s"] for r in done.orderBy("n").select(M.put_back("text", F.col("h.inline"), F.col("h.display")).alias("s")).collect()]

    cases = {
        "a — b": "a: b", "a — but b": "a, but b", "a: b — c": "a: b, c", "he — it — said": "he (it) said", "he — it — *Said*": "he (it), *Said*", "a —, b": "a:, b",
        "|—| — | x |": "|–| – | x |", " — ": " – ", "x (a: b — c). D — e": "x (a: b, c). D: e", "`a — b — c` d": "`a: b: c` d", "One. Two — 3 .5 .": "One. Two: 3 .5.", "no dash ,": "no dash ,",
        "a ; — b": "a; b", "(( a — b)": "((a: b)",
    }
    more = {
        "a$x — y$ — $z$ — B": "a$x — y$ ($z$), B", "(a — b": "(a: b", "a) — (b: c) d": "a), (b: c) d", "a) — (b: c) — d": "a) ((b: c)) d", "**a — b — c**": "**a: b: c**", "x — a — y — b — z": "x (a) y (b) z",
        "(a (b — c) : d) e": "(a (b: c): d) e", "(a: (b) — c (d) ) :": "(a: (b), c (d)):", "— start": ": start", "a —": "a:", "one — two — three — four": "one (two) three: four", "$$a — b$$ — $5 — 6": "$$a — b$$: $5: 6",
        "p < .05 — q": "p < .05: q", "~a ( b — c )": "~a (b: c)", "x — **because** y": "x, **because** y",
    }
    cases |= more
    assert dict(zip(cases, settle(cases), strict=True)) == cases
    took = []
    for n in (2000, 4000):
        line = ("word " * (160_000 // n) + "— ") * n
        settle([line])
        began = time.perf_counter()
        assert "—" not in settle([line])[0]
        took.append(time.perf_counter() - began)
    assert took[1] < 2.5 * took[0] + 1


def test_tags_go_however_deep_and_in_linear_time(spark):
    import re
    import time

    from foliate.operators.brackets import without_tags

    def plain(text):
        while (new := re.sub("<[^<>]*>", "", text)) != text:
            text = new
        return text

    texts = ["a<<<<<b>>>>>c <d", "", None, "no tag >", "<a>x</a> < y > z <", "> < <b>> <c", "<<i>b>text</<i>b>", ">>><<<", "<>" * 50 + "x", "a<b<c>d>e>f"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, text string")
    got = dict(without_tags(rows, ["n"]).collect())
    assert [got[k] for k in range(len(texts))] == [t and plain(t) for t in texts]
    long = spark.createDataFrame([(1, "<b>x</b> < y " * 80_000), (2, "<" * 100_000 + "x" + ">" * 100_000)], "n long, text string")
    began = time.perf_counter()
    assert {r["n"]: len(r["text"]) for r in without_tags(long, ["n"]).collect()} == {1: 6 * 80_000, 2: 0}
    assert time.perf_counter() - began < 20  # a rewriting form took minutes


def test_normalised_by_cases(spark):
    from foliate.operators.normalise import normalised

    cases = {
        "a — b\n$a — b$ — $$c\n— d$$": "a: b\n$a — b$: $$c\n— d$$", "`x — $y` z": "`x: $y` z", "no dash $x\u00a0y$\u00a0z": "no dash $x\u00a0y$ z", "": "", "|—|\n—\n  — x": "|–|\n–\n: x",
        "re‐fit $re‐fit$ \\[ $\\[$": "refit $re‐fit$ [ $\\[$", "x\nPage 1 of 2\ny — z": "x\n\ny: z",
    }
    rows = spark.createDataFrame([*enumerate(cases), (99, None)], "doc_id long, text string")
    got = dict(normalised(rows).collect())
    assert {c: got[k] for k, c in enumerate(cases)} == cases and got[99] is None


def test_states_and_findings_by_the_rule(spark):
    from foliate.operators import state as X

    base = {"recorded_mode": None, "n_docx": 0, "n_sources": 0, "n_files": 0, "has_inventory": False, "has_findings": False, "undisposed": None, "has_manifest": False, "open_findings": 0, "gates": {}}
    closed = {"n_sources": 2, "has_inventory": True, "has_findings": True, "undisposed": 0, "gates": {"structureAnswered": True}}
    cases = [
        ({}, (None, 0, None)), ({"n_files": 3}, ("scratch", 0, None)), ({"n_docx": 1, "n_files": 1}, ("summary", 0, None)), ({"recorded_mode": "exam"}, ("exam", 0, None)),
        (closed, ("summary", 1, None)), (closed | {"undisposed": 1}, ("summary", 0, None)), (closed | {"undisposed": None}, ("summary", 0, None)), (closed | {"gates": {}}, ("summary", 0, None)),
        ({"gates": {"composeSkipped": True}}, (None, 3, "author: the course itself")), ({"gates": {"composeDone": True, "courseShellVerified": True}}, (None, 3, "author: the first unit")),
        ({"has_manifest": True, "gates": {"verifyMatched": True, "unitOneAccepted": True}}, (None, 4, None)), ({"has_manifest": True, "gates": {"verifyMatched": True}}, (None, 0, None)),
        ({"gates": {"auditDone": True}}, (None, 5, "reviewer: the course as a student")), ({"gates": {"reviewDone": True}, "open_findings": 2}, (None, 6, "person: open findings 2")),
        ({"gates": {"reviewDone": True}}, (None, 6, "author: the word publish")), ({"gates": {"published": True, "reviewDone": False}}, (None, 7, None)),
    ]
    schema = "n int, recorded_mode string, n_docx int, n_sources int, n_files int, has_inventory boolean, has_findings boolean, undisposed int, has_manifest boolean, open_findings int, gates map<string, boolean>"
    rows = spark.createDataFrame([(k, *(base | c).values()) for k, (c, _) in enumerate(cases)], schema)
    got = {r["n"]: (r["mode"], r["phase"], r["waits_for"]) for r in X.states(rows, "n").collect()}
    assert [got[k] for k in range(len(cases))] == [want for _, want in cases]
    texts = {
        '{"lines": [{"state": "open"}, {"state": "done"}, {}]}': (1, None), '{"lines": [], "findings": [{"state": "open"}]}': (0, "findings"), '{"lines": [{"state": "done"}], "other": [1]}': (0, None),
        '{"course": "x", "items": [1], "more": [2]}': (0, "items"), '{"lines": "x", "list": [ ]}': (0, None), "not json": (0, None), None: (0, None), '{"lines": []}': (0, None),
    }
    found = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    n, under = X.findings_seen("t")
    assert [(r["o"], r["m"]) for r in found.select("n", n.alias("o"), under.alias("m")).orderBy("n").collect()] == list(texts.values())


def test_relationships_of_a_repeated_id(spark):
    from foliate.operators import sources as S

    xml = '<Relationship Id="a" Target="1"/><Relationship Target="2" Id="b"/><Relationship Id="a" Target="3"/><Relationship Target="4"/>'
    assert spark.createDataFrame([(xml,)], "x string").select(S.relationships("x").alias("m")).first()["m"] == {"a": "3", "b": "2"}
