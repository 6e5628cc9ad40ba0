"""Text functions as built-in column expressions.

White space is spelled out wherever engines differ on it; slices and lengths count code points.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named character references of XML, the ampersand last so that doubly escaped text loses one layer only.
XML_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decode_xml(c: str | Column) -> Column:
    """Named XML references to their characters."""
    out = col(c)
    for name, char in XML_ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def decode_xml_once(c: str | Column) -> Column:
    """Every reference is replaced in one pass: the ampersand that a decoded reference leaves never begins another one."""
    return decode_xml(c)  # the ampersand goes last


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``c``, which is worked out once however often it stands there."""
    return F.transform(F.array(c), use)[0]


def map_matches(c: str | Column, pattern: str, inside: Callable[[Column], Column], outside: Callable[[Column, Column], Column] | None = None) -> Column:
    """The text with ``inside`` applied to every match of ``pattern``, and ``outside`` (of a piece and its number) to what lies between."""
    pieces, hits = F.split(col(c), pattern, -1), F.regexp_extract_all(col(c), F.lit(pattern), F.lit(0))
    between = F.transform(pieces, outside) if outside else pieces
    return F.array_join(F.zip_with(between, hits, lambda p, h: F.concat(p, F.coalesce(inside(h), F.lit("")))), "")


def decode_numeric(c: str | Column) -> Column:
    """Decimal and hexadecimal character references to their characters; those beyond Unicode stay."""

    def char(ref: Column) -> Column:
        digits = F.regexp_extract(ref, "([0-9A-Fa-f]+);", 1)
        code = F.when(ref.rlike("(?i)^&#x"), F.conv(digits, 16, 10).cast("long")).otherwise(digits.try_cast("long"))
        utf32 = F.unhex(F.lpad(F.hex(code), 8, "0"))
        return F.when((code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF), F.decode(utf32, "UTF-32")).otherwise(ref)

    return map_matches(c, "&#(?:[0-9]{1,9}|[xX][0-9A-Fa-f]{1,8});", char)


def word_hyphens(c: str | Column) -> Column:
    """The hyphen elements of a word processor: the non-breaking one is a hyphen, the optional one nothing."""
    out = F.regexp_replace(col(c), r"<w:noBreakHyphen[ ]*/>", "-")
    return F.regexp_replace(out, r"<w:softHyphen[ ]*/>", "")


def flatten_space(c: str | Column) -> Column:
    """Tabs to spaces, and no white space at either end of a line."""
    out = F.replace(col(c), F.lit("\t"), F.lit(" "))
    return F.regexp_replace(F.regexp_replace(out, "(?m)^ +", ""), "(?m) +$", "")


def strip_furniture(c: str | Column, brand: str = r"[A-Z][A-Za-z]+") -> Column:
    """Page footers (``Page 3 of 12``, with a brand before or after): a line of its own leaves a line break, one
    within a line leaves a space."""
    footer = rf"(?:{brand} \| )?Page [0-9]+ of [0-9]+(?: \| {brand})?"
    own = F.regexp_replace(col(c), rf"\n[ \t]*{footer}[ \t]*(?=\n)", "\n")
    return F.regexp_replace(own, rf"[ \t]*{footer}[ \t]*", " ")


def join_hyphens(c: str | Column) -> Column:
    """U+2010 between two letters, with or without blanks and a line break after it, is taken out."""
    return F.regexp_replace(col(c), "(\\p{L})\u2010[ \t]*\r?\n?[ \t]*(\\p{L})", "$1$2")


def hyphens_left(c: str | Column) -> Column:
    return F.regexp_count(col(c), F.lit("\u2010"))


def strip_escapes(c: str | Column) -> Column:
    """Backslashes before ten characters that need none (fixed values; the dot is not one of them)."""
    return F.regexp_replace(col(c), r"\\+([~+=)(\[\]\-*_])", "$1")


def plain_spaces(c: str | Column) -> Column:
    return F.replace(col(c), F.lit("\u00a0"), F.lit(" "))


def close_punctuation(c: str | Column) -> Column:
    """No space before punctuation, but for the point of a decimal."""
    return F.regexp_replace(col(c), r" +([,;:!?]|\.(?![0-9]))", "$1")


def strip_heading_number(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"^[0-9]+(?:\.[0-9]+)*[.)]?[ ]+", "")


def plain_heading(c: str | Column) -> Column:
    """A heading without its symbol, number and closing colon, in lower case."""
    bare = F.regexp_replace(col(c), r"^[^\p{L}\p{N}]+", "")
    return F.lower(F.btrim(F.regexp_replace(strip_heading_number(bare), r"[ ]*:[ ]*$", "")))


def is_short_label(c: str | Column) -> Column:
    """Six words at most and no end of a sentence."""
    text = F.btrim(col(c))
    return (F.size(F.split(text, " +")) <= 6) & ~text.rlike(r"[.!?]\z")


def slug(c: str | Column, most: int = 44, trim_last: bool = True) -> Column:
    """Lower case, accents off, ``&`` to ``and``, all else to hyphens; cut at ``most``.  ``trim_last`` trims hyphens
    after the cut, else before it (then a slug may end with one)."""
    out = F.regexp_replace(F.lower(F.translate(col(c), ACCENTED, PLAIN)), MARKS, "")
    out = F.regexp_replace(F.replace(out, F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", "-")
    if trim_last:
        return F.btrim(F.substring(F.btrim(out, F.lit("-")), 1, most), F.lit("-"))
    return F.substring(F.btrim(out, F.lit("-")), 1, most)


def _letters_with_marks() -> tuple[str, str]:
    """All letters that the Unicode data decompose to one ASCII letter and marks, and these letters, in lower case."""
    found = {}
    for code in range(0xC0, 0x2100):
        c = chr(code)
        base = [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]
        if len(base) == 1 and base[0].isascii() and base[0].isalpha() and base[0] != c:
            found[c] = base[0].lower()
    return "".join(found), "".join(found.values())


ACCENTED, PLAIN = _letters_with_marks()
#: Marks that stand by themselves after a decomposed letter.
MARKS = "[\u0300-\u036f]+"


def fingerprint(c: str | Column) -> Column:
    """Emphasis and quote marks off, white space collapsed, lower case, the first 120 characters."""
    bare = F.translate(col(c), "*_`#>", "")
    return F.substring(F.lower(F.btrim(F.regexp_replace(bare, r"[ \t\n]+", " "))), 1, 120)


def words_spaced(c: str | Column) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(col(c), r"[ \t\n]+"), lambda w: w != "")


def words_of_letters(c: str | Column) -> Column:
    """Runs of three letters or more, lower-cased."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"\p{L}{3,}"), F.lit(0))


def words_with_digits(c: str | Column) -> Column:
    """Runs of letters and digits (marks that follow a letter belong to none of them)."""
    return F.regexp_extract_all(col(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def label_and_rest(c: str | Column, most: int = 120, near: int = 118, early: int = 40) -> tuple[Column, Column]:
    """A label of ``most`` characters at most, cut at the last space up to ``near`` (or at ``near`` if that space comes
    too early), and what is left over."""
    text = F.btrim(col(c))
    head = F.substring(text, 1, near)
    space = F.length(head) - F.instr(F.reverse(head), " ") + 1
    space = F.when(F.instr(head, " ") == 0, 0).otherwise(space)
    cut = F.when(space > early, space - 1).otherwise(near)
    long = F.length(text) > most
    label = F.when(long, F.substring(text, F.lit(1), cut)).otherwise(text)
    rest = F.when(long, F.btrim(F.substring(text, cut + 1, F.length(text)))).otherwise("")
    return label, rest


def label_left_of_equals(c: str | Column, default: str = "Step", most: int = 120) -> Column:
    """A long line's label: what stands left of the first ``=`` if that is short enough."""
    text = F.btrim(col(c))
    left = F.btrim(F.split_part(text, F.lit("="), F.lit(1)))
    fits = text.contains("=") & (F.length(left) <= most) & (left != "")
    return F.when(F.length(text) <= most, text).when(fits, left).otherwise(default)


def prose_like_maths(c: str | Column) -> Column:
    """More than six tokens and nothing that only TeX writes."""
    return (F.size(words_spaced(c)) > 6) & ~col(c).rlike(r"[\\^_{}=]")


def escape_markdown(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"([\\`*_{}\[\]<>#|])", r"\\$1")


def escape_latex(c: str | Column) -> Column:
    """Every special character gets its backslash in one pass, so a backslash put in is never met again; a backslash, a
    tilde and a circumflex have names instead."""
    named = {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}

    def safe(x: Column) -> Column:
        out = F.concat(F.lit("\\"), x)
        for char, name in named.items():
            out = F.when(x == char, name).otherwise(out)
        return out

    return map_matches(c, r"[#$%&_{}\\~^]", safe)


def media_path(c: str | Column) -> Column:
    """A path below ``word/``: dot segments resolved at any depth, a leading slash meaning the archive's root."""
    full = F.when(col(c).startswith("/"), F.substring(col(c), F.lit(2), F.length(col(c)))).otherwise(F.concat(F.lit("word/"), col(c)))
    start = F.array().cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part.isin(".", ""), kept).when(part == "..", up).otherwise(F.concat(kept, F.array(part)))

    return F.array_join(F.aggregate(F.split(full, "/"), start, step), "/")


#: Names of a closing section, in two languages, and those that a bold lead may have (fixed values).
RECAP = (
    r"(?i)^(?:(?:week|unit|lecture|chapter|hoorcollege|college|thema)\s*\d+\s*[:–-]?\s*)?"
    r"(?:wrap[\s-]?up|in\s+short|in\s+summary|summary|recap|conclusion|key\s+(?:takeaways?|insights?|points?)|"
    r"to\s+summari[sz]e|brief\s+overview|kort\s+overzicht|samenvatting|kernpunten)\s*$"
)
RECAP_LEAD = (
    r"(?is)^\*\*(?:(?:week|unit|lecture|chapter)\s*\d+\s*[:–-]?\s*)?"
    r"(?:wrap[\s-]?up|in short|in summary|summary|recap|conclusion|key (?:takeaways?|insights?|points?)|to summari[sz]e)\*\*[:.]?\s*(.*)$"
)


def is_recap(c: str | Column) -> Column:
    """Whether a heading names a closing section and nothing else."""
    return col(c).rlike(RECAP)


def recap_lead(c: str | Column) -> Column:
    """What follows a bold lead that names a closing section; null without one."""
    return F.when(col(c).rlike(RECAP_LEAD), F.btrim(F.regexp_extract(col(c), RECAP_LEAD, 1)))


def findings(c: str | Column) -> dict[str, Column]:
    """What is left for a person to read after the rules above, as counts."""
    t, rows = col(c), F.split(col(c), "\n")
    count = lambda x: F.length(t) - F.length(F.replace(t, F.lit(x), F.lit("")))
    lines = lambda test: F.size(F.filter(rows, test))
    return {
        "dashes": count("\u2014"),
        "hyphens": count("\u2010"),
        "bullets": lines(lambda x: x.rlike("^[ \t]*[•▪◦]")),
        "long_headings": lines(lambda x: x.rlike(r"^#{1,6}\s") & (F.length(x) > 120)),
        "deep_headings": lines(lambda x: x.rlike(r"^#{4,}\s")),
        "backslashes": count("\\"),
        "wide_rows": lines(lambda x: F.ltrim(x).startswith("|") & (F.length(x) > 500)),
    }


#: A text that names two variables, and one that states a function of x (fixed values).
TWO_VARIABLES = r"(?i)\(\s*x\s*,\s*y\s*\)|\bz\s*="
FUNCTION_OF_X = r"(?i)(?:[fghpqyv]\s*\(\s*x\s*\)|y)\s*=\s*[^\n,;.]{2,80}"


def disposition(kind: str | Column, as_is: str | Column, context: str | Column) -> Column:
    """What becomes of a drawing: boxes and shapes are folded into the text, pictures stay figures where that is asked for or a
    surface is meant, become charts where the text states their function, and else are for a person to decide."""
    return (
        F.when(col(kind).isin("textbox", "shape"), "fold")
        .when(col(as_is) | col(context).rlike(TWO_VARIABLES), "figure")
        .when(col(context).rlike(FUNCTION_OF_X), "chart")
        .otherwise("uncertain")
    )
