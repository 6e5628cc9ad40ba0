"""The normaliser: every rule for prose over whole texts, with the maths held back until all are done."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prose as P
from .dashes import DASH, settle


def normalise(text: str) -> str:
    """Dashes settled line by line, page furniture taken out, broken words joined, needless backslashes and non-breaking spaces replaced; formulas come
    back as they were."""
    text, inline, display = P.hold(text)
    if DASH in text:
        text = "\n".join(settle(line) if DASH in line else line for line in text.split("\n"))
    for rule in (P.strip_furniture, P.join_hyphens, P.strip_escapes, P.plain_spaces):
        text = rule(text)
    return P.put_back(text, inline, display)


def normalised(docs: DataFrame) -> DataFrame:
    """(doc_id, text): each text :func:`normalise`\\ d.  ``docs`` has one row a doc_id; a null text stays null.

    The dash rule needs a stack, which no built-in has, so texts are handed to Python; there all rules are run at once, as patterns over whole
    texts in the engine cost many times as much.
    """

    def run(batch: pa.Array) -> pa.Array:
        return pa.array((x and normalise(x) for x in (cell.as_py() for cell in batch)), pa.string())

    return docs.select("doc_id", F.arrow_udf(run, "string")("text").alias("text"))
