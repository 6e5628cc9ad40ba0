"""Operations on blocks, in the order they are listed: each sees what the one before has left.

Operations of a unit depend on each other, so a unit is one group's fold; units are dealt over the cluster and a unit is a page's blocks
(tens to hundreds), never a corpus.  What the rule refuses is an error of that operation: it is reported and changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A block, as operations read, put in and leave it.
BLOCK = "id string, type string, title string, problem string, body string, steps array<struct<label: string, note: string>>"
RESULT = f"unit long, place int, {BLOCK}, log string"
#: Operations: ``arg`` is the new id, the id to move before or the line to cut from; ``find`` the lines of a formula; ``blocks`` what is put in.
OPS = "unit long, seq int, op string, id string, arg string, title string, find array<string>, blocks array<struct<id: string, type: string, title: string, body: string>>"
#: Characters of a step's label (fixed value).
LABEL = 120


class Refused(Exception):
    """What an operation is refused for."""


def _new(**fields) -> dict:
    return {"id": None, "type": None, "title": None, "problem": None, "body": None, "steps": None} | fields


def _prose(block: dict) -> list[str]:
    if block["type"] != "prose":
        raise Refused("not prose")
    return (block["body"] or "").split("\n")


def _line(rows: list[str], wanted: str | None) -> int:
    if wanted not in rows:
        raise Refused("no line")
    return rows.index(wanted)


def _place(blocks: list[dict], name: str | None, why: str = "missing") -> int:
    found = [k for k, b in enumerate(blocks) if b["id"] == name]
    if not found:
        raise Refused(why)
    return found[0]


def replace(blocks: list[dict], at: int, op: dict) -> list[dict]:
    """A block of any type takes the place and the id."""
    return [_new(**op["blocks"][0]) | {"id": op["id"]}]


def after(blocks: list[dict], at: int, op: dict) -> list[dict]:
    return [blocks[at], *[_new(**b) for b in op["blocks"]]]


def rename(blocks: list[dict], at: int, op: dict) -> list[dict]:
    """An id is an anchor, so one that is live is not taken over."""
    if any(b["id"] == op["arg"] for b in blocks):
        raise Refused("taken")
    return [blocks[at] | {"id": op["arg"]}]


def cut(blocks: list[dict], at: int, op: dict) -> list[dict]:
    """Prose ends before a line, which is sought without the white space around it."""
    rows = _prose(blocks[at])
    kept = "\n".join(rows[: _line([r.strip() for r in rows], op["arg"])]).rstrip()
    if not kept:
        raise Refused("empties")
    return [blocks[at] | {"body": kept}]


def split(blocks: list[dict], at: int, op: dict) -> list[dict]:
    """A formula takes the place of its lines, every second one of the prose; what stands before and after stays prose."""
    rows, lines = _prose(blocks[at]), op["find"]
    first = _line(rows, lines[0])
    last = first + 2 * (len(lines) - 1)
    if rows[first : last + 1 : 2] != lines:
        raise Refused("does not follow")
    before, behind = "\n".join(rows[:first]).strip(), "\n".join(rows[last + 1 :]).strip()
    made = [blocks[at] | {"body": before}] if before else []
    rest = [_new(id=f"{op['id']}-after", type="prose", body=behind)] if behind else []
    return [*made, _new(**op["blocks"][0]), *rest]


def plain(text: str) -> str:
    return " ".join(text.replace("**", "").split())


def step_of(said: str, calculation: str) -> dict:
    """One step: named by the sentence that announces it, by itself if it is short, else by what stands left of its equals sign."""
    line = plain(calculation)
    left = re.sub(r"[,:\s]+$", "", line.split("=")[0]).strip()
    by_left = left if left and len(left) <= LABEL else "Continue"
    if not said:
        return {"label": line, "note": None} if len(line) <= LABEL else {"label": by_left, "note": line}
    return {"label": said, "note": line} if len(said) <= LABEL else {"label": by_left, "note": f"{said} {line}"}


def worked(blocks: list[dict], at: int, op: dict) -> list[dict]:
    """Prose as a worked example: its heading is the title, what stands before the first calculation the problem, and each calculation a step."""
    parts = [p.strip() for p in re.split(r"\n\n+", "\n".join(_prose(blocks[at]))) if p.strip()]
    heading = re.match(r"#{2,6}\s+(.*)", parts[0], re.S) if parts else None
    title = op["title"] or (heading and heading[1].strip())
    if not title:
        raise Refused("no title")
    parts = parts[1:] if heading else parts
    calculations = [k for k, p in enumerate(parts) if "=" in p]
    if not calculations:
        raise Refused("no calculation")
    begins = [calculations[0], *[k + 1 for k in calculations[:-1]]]
    steps = [step_of(re.sub(r"[.:\s]+$", "", plain(" ".join(parts[a:k]))), parts[k]) for a, k in zip(begins, calculations, strict=True)]
    if closing := plain(" ".join(parts[calculations[-1] + 1 :])):
        steps[-1]["note"] = " ".join(x for x in (steps[-1]["note"], closing) if x)
    problem = "\n\n".join(parts[: calculations[0]]) or None
    return [_new(id=op["id"], type="worked-example", title=title, problem=problem, steps=steps)]


#: What each operation leaves in place of its block.
MAKES: dict[str, Callable[[list[dict], int, dict], list[dict]]] = {
    "replace": replace, "after": after, "rename": rename, "remove": lambda blocks, at, op: [], "cut": cut, "splitAt": split, "formula": split, "worked": worked,
}


def _apply(blocks: list[dict], op: dict) -> str:
    """One operation on the blocks of a unit; what became of it."""
    try:
        at = _place(blocks, op["id"])
        if op["op"] == "move":
            others = blocks[:at] + blocks[at + 1 :]
            to = _place(others, op["arg"], "no place")
            blocks[:] = [*others[:to], blocks[at], *others[to:]]
        elif op["op"] in MAKES:
            blocks[at : at + 1] = MAKES[op["op"]](blocks, at, op)
        else:
            raise Refused("unknown")
    except Refused as why:
        return str(why)
    return "done"


def apply_ops(blocks: DataFrame, ops: DataFrame) -> DataFrame:
    """``blocks`` (unit, place and the columns of :data:`BLOCK`) after all of ``ops`` (:data:`OPS`).  ``log`` says, in each row alike, what became of each
    operation, and at last whether an id stands twice (``twice``) or a body still has a style marker (``marker``): neither may be published."""

    names = ["id", "type", "title", "problem", "body", "steps"]
    schema = to_arrow_schema(StructType.fromDDL(RESULT))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sorted(left.to_pylist(), key=lambda b: (b["place"] is None, b["place"], b["id"] is None, b["id"]))
        unit, rows = rows[0]["unit"] if rows else None, [{n: b[n] for n in names} for b in rows]
        log = [f"{o['op']}:{_apply(rows, o)}" for o in sorted(right.to_pylist(), key=lambda o: o["seq"])]
        if len({b["id"] for b in rows}) < len(rows):
            log.append("twice")
        if any("<!-- style:" in (b["body"] or "") for b in rows):
            log.append("marker")
        said = ",".join(log)
        return pa.Table.from_pylist([{"unit": unit, "place": k, **b, "log": said} for k, b in enumerate(rows)], schema)

    return blocks.select("unit", "place", "id", "type", "title", "problem", "body", "steps").groupBy("unit").cogroup(ops.groupBy("unit")).applyInArrow(run, RESULT)
