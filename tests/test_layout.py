"""Chains of starts and page layout against plain loops."""

from __future__ import annotations

import random

import pytest

from foliate.operators import chains as C
from foliate.operators import layout as L

RUN = "doc_id long, page int, top int, left int, size int, family string, colour string, bold boolean, italic boolean, text string"


def run_row(top, left, text, page=1, size=11, family="Times", colour="#000000", bold=False, italic=False, doc=1):
    return (doc, page, top, left, size, family, colour, bold, italic, text)


def plain_batches(sizes, most_bytes, most):
    out, batch, held, n = [], 0, 0, 0
    for s in sizes:
        s = s or 0
        if n and (held + s > most_bytes or n >= most):
            batch, held, n = batch + 1, 0, 0
        held, n = held + s, n + 1
        out.append(batch)
    return out


@pytest.mark.parametrize(("most_bytes", "most"), [(20, 5), (7, 50), (100, 1)])
def test_greedy_batches(spark, most_bytes, most):
    rng = random.Random(most)
    queues = {q: [rng.choice([None, 0, 1, 3, 8, 30]) for _ in range(n)] for q, n in (("a", 500), ("b", 1), (None, 40))}
    rows = [(q, 10 * k, s) for q, sizes in queues.items() for k, s in enumerate(sizes)]
    found = C.greedy_batches(spark.createDataFrame(rows, "q string, at long, size int"), "q", "at", "size", most_bytes, most, block=64)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["at"]):
        got.setdefault(r["q"], []).append(r["batch"])
    assert got == {q: plain_batches(s, most_bytes, most) for q, s in queues.items()}
    empty = spark.createDataFrame([], "q string, at long, size int")
    assert C.greedy_batches(empty, "q", "at", "size", 5, 5).collect() == []


def test_one_queue_is_dealt_to_many_tasks(spark):
    """Running sums of one key come from ranges of it, not from one task."""
    rows = spark.range(20_000).selectExpr("'q' AS q", "id", "id % 9 AS size")
    sums = C.running(rows, ["q"], ["id"], upto=rows["size"])
    held = dict(sums.select("id", "upto").collect())
    total = 0
    for k in range(20_000):
        total += k % 9
        assert held[k] == total
    counts = [len(p) for p in sums.select("id").rdd.glom().collect()]
    assert max(counts) < 10_000


def test_lines_are_anchored_at_their_first_run(spark):
    """Runs that drift by 5 each are no line of all: 100, 105 | 110, 115 | 120."""
    rows = [run_row(t, 100 + t, f"t{t}") for t in (100, 105, 110, 115, 120)] + [run_row(99, 1, "head"), run_row(1131, 1, "foot"), run_row(200, 1, "title", size=30), run_row(300, 1, "")]
    found = L.on_lines(L.content_runs(spark.createDataFrame(rows, RUN)))
    assert sorted((r["top"], r["line"]) for r in found.collect()) == [(100, 100), (105, 100), (110, 110), (115, 110), (120, 120)]
    assert L.lines(spark.createDataFrame([], RUN)).collect() == []


def test_depths_of_columns(spark):
    """A marker is open until one comes that is not right of it by more than six."""
    def plain(events):
        out, stack = [], []
        for x in events:
            if x is None:
                stack = []
                continue
            while stack and stack[-1] >= x - 6:
                stack.pop()
            stack.append(x)
            out.append(len(stack) - 1)
        return out

    rng = random.Random(3)
    docs = {1: [100, 105, 111, 120, 113, 100], 2: [135, 149, 149, 135, None, 189, 162, 189]} | {d: [rng.choice([None, 100, 104, 108, 115, 122, 140]) for _ in range(60)] for d in range(3, 12)}
    rows = [(d, k // 30, 100 + 10 * (k % 30), 40 if x is None else 10, None if x is None else "ul", x) for d, xs in docs.items() for k, x in enumerate(xs)]
    found = L.depths(spark.createDataFrame(rows, "doc_id long, page int, top int, gap int, marker string, marker_left int"))
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["doc_id"], r["page"], r["top"])):
        got.setdefault(r["doc_id"], []).append(r["depth"])
    assert got == {d: plain(xs) for d, xs in docs.items()}


def test_blocks(spark):
    blue = {"colour": "#2980b8", "size": 24}
    rows = [
        run_row(100, 100, "Formal Institutions and ", **blue), run_row(122, 100, "Legal Systems", **blue),  # a title over two lines
        run_row(200, 100, "Next", **blue), run_row(222, 100, "smaller", colour="#2980b8", size=18),
        run_row(244, 100, "The "), run_row(244, 130, "Model ", bold=True), run_row(244, 160, "combines integration-"), run_row(266, 100, "responsiveness"), run_row(288, 100, "and more"),
        run_row(400, 110, "•", family="SymbolMT"), run_row(401, 130, " "), run_row(401, 140, "one"), run_row(420, 130, "two"), run_row(442, 110, "12."), run_row(442, 130, "three"),
        run_row(464, 110, "b."), run_row(600, 100, "   "), run_row(640, 100, "end", italic=True), run_row(110, 100, "goes on", page=2),
    ]
    found = L.blocks(L.lines(spark.createDataFrame(rows, RUN))).orderBy("block").collect()
    assert [(r["kind"], r["level"], r["n_lines"], r["content"], r["marked"]) for r in found] == [
        ("heading", 1, 2, "Formal Institutions and Legal Systems", "Formal Institutions and Legal Systems"), ("heading", 1, 1, "Next", "Next"), ("heading", 2, 1, "smaller", "smaller"),
        ("p", 0, 3, "The Model combines integration-responsiveness and more", "The **Model** combines integration-responsiveness and more"),
        ("ul", 0, 2, "one two", "one two"), ("ol", 0, 1, "three", "three"), ("p", 0, 2, "end goes on", "*end* goes on"),
    ]
