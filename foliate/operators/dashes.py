"""The dash rule over lines, as a plain function of a line that Arrow batches run.

A line is cut into sentences.  What a dash becomes follows from the marks before it, its neighbours, the bracket it stands in, whether a colon stands
in the same scope, and which word follows.  Brackets in each other take a stack, which no built-in has; so the whole rule is in Python, where it
looks at the places around a line's dashes and not at every character by every pattern.  Only lines with a dash leave their engine, none its row,
and work is linear in the text.

The rule: a cell or line that is only a dash keeps a shorter one.  Two dashes with at most 160 characters between them become brackets,
if both stand outside of all marks, with a comma where a capital, a digit or a formula follows.  Any other dash becomes a
comma before a connective or where its scope has a colon (the innermost closed bracket, else the sentence), nothing behind a
comma, semicolon or colon, and else a colon.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import DISPLAY_MARK, INLINE_MARK
from ..functions.text import col

DASH, SHORT = "—", "–"
#: White space of any kind, as characters and as a class.
SPACES = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS = f"[{SPACES}]"
#: Longest text between two dashes that become brackets (fixed value).
ASIDE = 160
#: Connectives that follow a comma, in two languages (fixed values).
CONNECTIVES = (
    "because although though while whereas since so as and but or which who that if when unless also plus yet for "
    "omdat hoewel terwijl want maar dus zodat doordat aangezien namelijk bijvoorbeeld oftewel ofwel "
    "waardoor waarbij waarvan waarin waarop waarmee waaruit waarover "
    "zoals wat welke wie die dat als wanneer zodra indien mits tenzij voordat nadat totdat ook en of"
)
BEFORE_CONNECTIVE = rf"(?i)^(?:{CONNECTIVES.replace(' ', '|')})(?![A-Za-z0-9_])"
#: What stands for what while a sentence is settled (characters that no text may hold, fixed values): half of ``**``, a dash within marks, and a
#: bracket that closes before a single space.
STAR, HELD, CLOSED = "\ufdd4", "\ufdd5", "\ufdd6"
_ANY = f"[{DASH}{HELD}]"
_CELL = re.compile(rf"(\|{WS}*+){DASH}(?={WS}*\|)")
_END = re.compile(rf"[.!?]{WS}++")
#: From each odd mark to the next one.
_MARKED = [(mark[-1], re.compile(rf"{re.escape(mark)}[^{mark[-1]}]*+(?:{re.escape(mark)}|\Z)")) for mark in ("$", "`", "*", STAR * 2)]
#: Two dashes with a space on each side and between them more than spaces, with all space behind; or one dash that is of no such pair.
_PAIR = re.compile(rf"{WS}{_ANY}{WS}(?!{WS}*{_ANY})[^{DASH}{HELD}]{{1,{ASIDE}}}{WS}{_ANY}{WS}++|{_ANY}{WS}*+")
_COMMA_AFTER = re.compile(rf"{CLOSED}(?=[*{STAR}]*+[A-Z0-9$\\{INLINE_MARK}{DISPLAY_MARK}])")
_SCOPES = re.compile(f"[():{DASH}]")
_WORD = re.compile(r"\**+([A-Za-z]++)(?![0-9_])")
_CONNECTIVES = frozenset(CONNECTIVES.split())
#: Space before a sign or in a run, met at its begin only; most lines have none.
_LOOSE = re.compile(rf"{WS}[{SPACES},;:).]")
_TIDY = [(re.compile(p), to) for p, to in ((rf"\({WS}++", "("), (rf",{WS}*+,", ","), (rf":{WS}*+:", ":"))]
_BEFORE_SIGN = re.compile(rf"{WS}(?<!{WS}{WS}){WS}*+([,;:)]|\.(?![0-9]))")
_RUN = re.compile(rf"{WS}{{2,}}")


def _pair(found: re.Match) -> str:
    """Two dashes as brackets; one of the spaces behind is taken."""
    hit = found[0]
    if HELD in hit or hit[0] == DASH:
        return hit
    second = hit.rindex(DASH)
    return f" ({hit[3 : second - 1]}" + (CLOSED if second + 2 == len(hit) else f") {hit[second + 2 :]}")


def _bracketed(sentence: str) -> str:
    """A sentence's pairs of dashes as brackets."""
    t = sentence.replace("**", STAR * 2)  # as long as before
    for last, inside in _MARKED:
        if last in t:
            t = inside.sub(lambda m: m[0].replace(DASH, HELD), t)
    if t.count(DASH) < 2:
        return sentence
    t = _COMMA_AFTER.sub("), ", _PAIR.sub(_pair, t))
    return t.replace(CLOSED, ") ").replace(STAR * 2, "**").replace(HELD, DASH)


def _listed(sentence: str) -> list[bool]:
    """Of each dash of a sentence whether its scope has a colon: the innermost bracket around it that closes, else the sentence."""
    found, scopes = [False] * sentence.count(DASH), [(0, [])]  # of each scope: colons, and dashes that stand in no inner one
    if ":" not in sentence:
        return found

    def close(colons: int, dashes: list[int]) -> None:
        for k in dashes if colons else ():
            found[k] = True

    n = 0
    for sign in _SCOPES.findall(sentence):
        colons, dashes = scopes[-1]
        if sign == "(":
            scopes.append((0, []))
        elif sign == ":":
            scopes[-1] = (colons + 1, dashes)
        elif sign == DASH:
            dashes.append(n)
            n += 1
        elif len(scopes) > 1:
            close(*scopes.pop())
            scopes[-1] = (scopes[-1][0] + colons, scopes[-1][1])
    close(sum(colons for colons, _ in scopes), [k for _, dashes in scopes for k in dashes])  # a bracket that nothing closes is none
    return found


def _single(sentence: str) -> str:
    """What is left of dashes as commas and colons."""
    before, *rest = sentence.split(DASH)
    out = []
    for after, listed in zip(rest, _listed(sentence), strict=True):
        before, after = before.rstrip(SPACES), after.lstrip(SPACES)
        word = _WORD.match(after)
        joined = listed or (word and word[1].lower() in _CONNECTIVES)
        out += (before, " " if before.endswith((",", ";", ":")) else ", " if joined else ": ")
        before = after
    return "".join([*out, before])


def _settled(sentence: str) -> str:
    return _single(_bracketed(sentence) if sentence.count(DASH) > 1 else sentence)


def _tidy(line: str) -> str:
    loose = _LOOSE.search(line)
    if loose:
        line = _BEFORE_SIGN.sub(r"\1", line)
    for pattern, to in _TIDY:
        line = pattern.sub(to, line)
    return (_RUN.sub(" ", line) if loose else line).strip(SPACES)


def settle(line: str) -> str:
    """A line with its dashes settled; formulas are held already (:func:`~foliate.functions.maths.hold`).  A line without a dash stays as it is."""
    if line.strip(SPACES) == DASH:
        return line.replace(DASH, SHORT)
    if "|" in line and DASH in line:
        line = _CELL.sub(rf"\1{SHORT}", line)
    if DASH not in line:
        return line
    out, at = [], 0
    for found in _END.finditer(line) if "." in line or "!" in line or "?" in line else ():
        out.append(_settled(line[at : found.start() + 1]))
        at = found.end()
    if at < len(line):
        out.append(_settled(line[at:]))
    return _tidy(" ".join(out))


def settled(line: str | Column) -> Column:
    """:func:`settle` of a column; only lines with a dash are handed to Python."""

    def run(batch: pa.Array) -> pa.Array:
        return pa.array([x and settle(x) for x in batch.to_pylist()], pa.string())

    some = F.when(col(line).contains(DASH), col(line))
    return F.coalesce(F.arrow_udf(run, "string")(some), col(line))


def settle_lines(lines: DataFrame, key: list[str]) -> DataFrame:
    """``lines`` (``key`` and ``text``, one row a key) with their dashes settled."""
    return lines.select(*key, settled("text").alias("text"))
