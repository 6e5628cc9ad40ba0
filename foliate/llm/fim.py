"""Fill-in-middle by succinct rank and select.

The UTF-8 bytes of many texts lie one after another in one buffer.  A packed bitvector marks each byte that begins a code
point; a directory holds the popcount before each block of 512 bits and, within its block, before each word.  The
popcount between two byte places gives a text's code points, and selecting two ranks gives the bytes at which it is cut, so
no text is ever decoded.

A document's draws are the first four 32-bit groups of the SHA-256 of a seed and its id.  Forms: ``plain`` (the text as it
is), ``psm`` (prefix, suffix, middle) and ``spm`` (suffix, prefix, middle), each part behind its sentinel.

Defined results: a null or empty text, and one that holds a sentinel, is plain; a null doc_id is drawn for as the seed with
nothing behind it; repeated rows are each cut alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, table

BLOCK_BITS = 512
WORDS = BLOCK_BITS // 64


class Params(NamedTuple):
    """``rate`` of a hundred documents are cut, ``spm`` of a hundred of these with the suffix first."""

    seed: str = "1:"
    rate: int = 90
    spm: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


class Boundaries:
    """Code point boundaries of a buffer of UTF-8 bytes."""

    def __init__(self, data: np.ndarray):
        bits = np.packbits((data & 0xC0) != 0x80, bitorder="little")
        packed = np.zeros(-(-len(bits) // (BLOCK_BITS // 8)) * (BLOCK_BITS // 8) + BLOCK_BITS // 8, np.uint8)
        packed[: len(bits)] = bits
        self.size, self.words = len(data), packed.view("<u8")
        ones = np.bitwise_count(self.words).astype(np.uint16).reshape(-1, WORDS)
        self.in_block = (np.cumsum(ones, 1, dtype=np.uint16) - ones).ravel()
        each = ones.sum(1, dtype=np.int64)
        self.before = np.cumsum(each) - each

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Boundaries before each byte place."""
        word = at >> 6
        below = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[at // BLOCK_BITS] + self.in_block[word] + np.bitwise_count(below)

    def select(self, rank: np.ndarray) -> np.ndarray:
        """The byte place of the boundary that has ``rank`` others before it; the buffer's end where there is none."""
        block = np.searchsorted(self.before, rank, "right") - 1
        rest = rank - self.before[block]
        inside = self.in_block.reshape(-1, WORDS)[block]
        word = block * WORDS + (inside <= rest[:, None]).sum(1) - 1
        rest = rest - self.in_block[word]
        bits = np.unpackbits(self.words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        hit = np.cumsum(bits, 1, dtype=np.uint8) == (rest + 1)[:, None]
        return np.where(hit.any(1), word * 64 + hit.argmax(1), self.size)


def draws(seed: str, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits for a document."""
    digest = hashlib.sha256(f"{seed}{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4))


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


def _cut(batch: pa.RecordBatch, params: Params) -> pa.RecordBatch:
    doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).fill_null(b"").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]]
    start, end = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    marks = Boundaries(np.frombuffer(raw, np.uint8))
    first = marks.rank(start)
    n = marks.rank(end) - first
    h = np.array([draws(params.seed, d) for d in doc_ids], np.int64).reshape(-1, 4)
    one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    # the rank behind a text's last code point belongs to the next text
    at = np.where(low < n, marks.select(first + low), end)
    to = np.where(high < n, marks.select(first + high), end)
    p, s, m = (x.encode() for x in (params.prefix, params.suffix, params.middle))
    forms, outputs = [], []
    rows = zip(start.tolist(), at.tolist(), to.tolist(), end.tolist(), h.tolist(), strict=True)
    for a, b, c, z, (_, _, h3, h4) in rows:
        text = bytes(raw[a:z])
        if not text or h3 % 100 >= params.rate or p in text or s in text or m in text:
            form, output = "plain", text
        elif h4 % 100 < params.spm:
            form, output = "spm", b"".join((s, raw[c:z], p, raw[a:b], m, raw[b:c]))
        else:
            form, output = "psm", b"".join((p, raw[a:b], s, raw[c:z], m, raw[b:c]))
        forms.append(form)
        outputs.append(output)
    plain = np.array([f == "plain" for f in forms], bool)
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(low, pa.int64(), mask=plain), pa.array(high - low, pa.int64(), mask=plain), pa.array(outputs, pa.binary())],
        ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def transform(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the ``output`` text of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1024):
            yield _cut(part, params)

    raw = documents(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    return raw.mapInArrow(run, SCHEMA).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, params: Params = Params()) -> Column:
    """The text that an output was made of, from the output and its form alone: sentinels part it, as no text that is
    cut holds one."""
    sentinels = "|".join(re.escape(x) for x in (params.prefix, params.suffix, params.middle))
    parts = F.split(output, sentinels)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b,
         ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4
  FROM hashed
), formed AS (
  SELECT doc_id, t, n, least(a, b) AS low, greatest(a, b) AS high,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
              WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, substring(t, 1, low) AS p, substring(t, low + 1, high - low) AS m, substring(t, high + 1, n - high) AS s FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
