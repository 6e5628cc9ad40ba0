"""Round 4: texts meet all rules for prose at once, and a rule looks only where it can apply."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from foliate.functions import maths as M
from foliate.functions import prose as P
from foliate.functions import text as T
from foliate.operators import dashes as D
from foliate.operators.normalise import normalised

ODD = [
    "", "x", "Acme | Page 1 of 2 | Beta Page 3 of 4", "xAcme | Page 1 of 2", "A | Page 1 of 2", " \t Acme | Page 1 of 2\t x", "Page 1 of 2 | Acme | Page 3 of 4", "a\n\tAcme | Page 1 of 2 \nb\nPage 3 of 4\n",
    "\nPage 1 of 2\nPage 3 of 4\n", "Page 1 of 2 | Page 3 of 4", "Page x of 2", "a‐b‐c‐d", "a‐ \t\r\n b ‐c", "1‐a a‐1 ²‐a é‐Ж", "a‐\n\nb", "‐‐a‐", r"\* \\\_ \. \$ \\", " a ", "$a$ $b c$ \\$5 $6 $7",
    "$$a\nb$$ $c$ ``` $x$ ``` `$y$`", "$$$$ $$", "$a $$b$$ c$", "$1$2", "$a $ $b\x1c$", "$x\\$ y$",
]


def test_a_rule_gives_what_its_column_gives(spark):
    rules = [(P.strip_furniture, T.strip_furniture), (P.join_hyphens, T.join_hyphens), (P.strip_escapes, T.strip_escapes), (P.plain_spaces, T.plain_spaces)]
    rows = spark.createDataFrame(list(enumerate(ODD)), "n long, text string")
    held = F.struct(*[M.hold("text")[c] for c in ("text", "inline", "display")])
    for n, *want, (text, inline, display) in rows.select("n", *[column("text") for _, column in rules], held).collect():
        assert [rule(ODD[n]) for rule, _ in rules] == want, ODD[n]
        assert P.hold(ODD[n]) == (text, inline, display)
        assert P.put_back(*P.hold(ODD[n])) == ODD[n]


def test_lines_are_settled_by_cases():
    cases = {
        "a. B — c: d! E — f": "a. B, c: d! E: f", "a — ſo": "a: ſo", "a — SO b": "a, SO b", "a — so_": "a: so_", "a — **and** b": "a, **and** b",
        "a — — b": "a: b", ", — — b": ",: b", "a —b — c": "a: b: c", "x — y —  Z": "x (y) Z", "\x1c — b": "\x1c: b", "((a: b) — c — d) e": "((a: b) (c) d) e",
    }
    assert {line: D.settle(line) for line in cases} == cases


def test_texts_meet_all_rules_at_once(spark):
    """Rules are no patterns over every character of a column, so a run of blanks takes linear time."""
    words = "some words of a line that has no dash but for one " * 5
    line = f"{words}ends — so $a — b \\[ c‐d$ holds {words} e\\[f re‐fit Page 4 of 12 | Acme x"
    done = f"{words}ends, so $a — b \\[ c‐d$ holds {words}e[f refit x"
    blanks = "a" + " " * 100_000 + "b"
    rows = spark.createDataFrame([(1, f"{line}\n" * 20), (2, blanks), (3, None)], "doc_id long, text string")
    assert "regexp_replace" not in normalised(rows)._jdf.queryExecution().executedPlan().toString()
    began = time.perf_counter()
    assert dict(map(tuple, normalised(rows).collect())) == {1: f"{done}\n" * 20, 2: blanks, 3: None}
    assert time.perf_counter() - began < 15
