"""Rules for prose over one text, as plain functions: what Arrow batches run where a text meets many rules.

Each gives what the column expression of the same name in :mod:`.text` and :mod:`.maths` gives.  A column expression tries its pattern at every character
of a text; here a rule looks for the one character or word that it cannot do without, and at the text around it only.
"""

from __future__ import annotations

import re
import string

from . import maths as M

_CODE = re.compile(M.CODE)
_DISPLAY = re.compile(M.DISPLAY.replace("(", "(?:", 1))
_INLINE = re.compile(M._INLINE_HELD.replace(r"(?<![\\$])\$", r"\$(?<![\\$]\$)", 1), re.ASCII)  # the dollar first, as nothing else is looked for


def _taken(spans: re.Pattern, mark: str, text: str) -> tuple[str, list[str]]:
    held = []

    def take(found: re.Match) -> str:
        held.append(found[0])
        return mark

    return spans.sub(take, text), held


def hold(text: str) -> tuple[str, list[str], list[str]]:
    """A text with a mark in place of each span of maths, the inline spans and the display spans."""
    if "`" in text:
        text = _CODE.sub(lambda m: m[0].replace("$", M.CODE_DOLLAR), text)
    display, inline = [], []
    if "$$" in text:
        text, display = _taken(_DISPLAY, M.DISPLAY_MARK, text)
    if "$" in text:
        text, inline = _taken(_INLINE, M.INLINE_MARK, text)
    return text, inline, display


def put_back(text: str, inline: list[str], display: list[str]) -> str:
    """The spans in place of their marks."""
    for mark, held in ((M.INLINE_MARK, inline), (M.DISPLAY_MARK, display)):
        first, *rest = text.split(mark)
        held = held + [""] * (len(rest) - len(held))
        text = first + "".join(h + p for h, p in zip(held, rest, strict=False))
    return text.replace(M.CODE_DOLLAR, "$")


_PAGE = r"Page [0-9]+ of [0-9]+(?: \| [A-Z][A-Za-z]+)?[ \t]*+"
_OWN_LINE = re.compile(rf"\n[ \t]*+(?:[A-Z][A-Za-z]+ \| )?{_PAGE}(?=\n)")
_FOOTER = re.compile(_PAGE)


def strip_furniture(text: str) -> str:
    """Page footers: a line of its own leaves a line break, one within a line leaves a space."""
    if "Page " not in text:
        return text
    text = _OWN_LINE.sub("\n", text)
    out, at = [], 0
    for found in _FOOTER.finditer(text):
        before = text[at : found.start()]
        if before.endswith(" | "):  # a brand, from its first capital
            letters = before[len(before[:-3].rstrip(string.ascii_letters)) : -3].lstrip(string.ascii_lowercase)
            before = before[: -3 - len(letters)] if len(letters) > 1 else before
        out.append(before.rstrip(" \t"))
        at = found.end()
    return " ".join([*out, text[at:]])


_HYPHEN = re.compile("\u2010[ \t]*+\r?+\n?+[ \t]*+")


def join_hyphens(text: str) -> str:
    """U+2010 between two letters, with or without blanks and a line break after it, is taken out; a letter that ended one such place begins no other."""
    out, at, taken = [], 0, -1
    for found in _HYPHEN.finditer(text) if "\u2010" in text else ():
        left, right = found.start() - 1, found.end()
        if left > taken and right < len(text) and text[left].isalpha() and text[right].isalpha():
            out.append(text[at : left + 1])
            at = taken = right
    return "".join([*out, text[at:]])


_ESCAPE = re.compile(r"\\(?<!\\\\)\\*+([~+=)(\[\]\-*_])")


def strip_escapes(text: str) -> str:
    """Backslashes before ten characters that need none."""
    return _ESCAPE.sub(r"\1", text) if "\\" in text else text


def plain_spaces(text: str) -> str:
    return text.replace("\u00a0", " ")
