"""Brackets that close: a stack over one text, kept in Python where the text lies.

No built-in keeps a stack.  Each helper reads a text's tokens once, so it is linear in the text however deep brackets stand in each other, and no
text leaves its row.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_tags(texts: DataFrame, key: list[str]) -> DataFrame:
    """``texts`` (``key`` and ``text``, one row a key) with tags removed until none is left: a removal may put another tag together, so every ``<`` that
    some ``>`` closes goes with all between, however deep.  Texts without a ``<`` stay as they are."""

    def run(batch: pa.Array) -> pa.Array:
        import re

        token = re.compile("[<>]|[^<>]+")

        def stripped(text: str | None) -> str | None:
            if text is None:
                return None
            out, opened = [], []
            for tok in token.findall(text):
                if tok == ">" and opened:
                    del out[opened.pop() :]
                else:
                    if tok == "<":
                        opened.append(len(out))
                    out.append(tok)
            return "".join(out)

        return pa.array([stripped(x) for x in batch.to_pylist()], pa.string())

    some = F.when(F.col("text").contains("<"), F.col("text"))
    return texts.select(*key, F.coalesce(F.arrow_udf(run, "string")(some), "text").alias("text"))
