"""Ranked search, fill-in-middle and binary ids against plain versions, on hand-made and random input."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from foliate.llm import fim, lexical, rans

ODD = "doc_id long, text string, n string, form string, output string, ids string, rank string, shard string, tie string"


def rows_of(spark, pairs):
    """Rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "n", "form", "output", "ids", "rank", "shard", "tie") for i, t in pairs], ODD)


TEXTS = ["", None, "plain words here", "größe — 漢字 𝒳 é", "has <S> inside", "x", "one two three " * 400, "same", "same"]


# Fill-in-middle


@pytest.mark.parametrize("seed", range(4))
def test_rank_and_select(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice("aé漢𝒳 ") for _ in range(rng.choice([0, 1, 63, 64, 2000])))
    raw = text.encode()
    marks = fim.Boundaries(np.frombuffer(raw, np.uint8))
    starts = [k for k, b in enumerate(raw) if b & 0xC0 != 0x80]
    at = np.arange(len(raw) + 1)
    assert marks.rank(at).tolist() == [sum(s < k for s in starts) for k in at.tolist()]
    assert marks.select(np.arange(len(starts) + 1)).tolist() == [*starts, len(raw)]


def plain_fim(doc_id, text):
    t, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, len(t), "plain", None, None, t)
    form = "spm" if h4 % 100 < 20 else "psm"
    return (doc_id, len(t), form, a, b - a, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


def test_fim_cases(spark):
    pairs = [(k * 40 + j, t) for j in range(12) for k, t in enumerate(TEXTS)] + [(None, "no id"), (7, "twice"), (7, "twice")]
    made = fim.transform(rows_of(spark, pairs))
    found = made.withColumn("back", fim.restored(made["output"], made["form"])).collect()
    assert sorted((tuple(r)[:-1] for r in found), key=repr) == sorted((plain_fim(*p) for p in pairs), key=repr)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert sorted(r["back"] for r in found) == sorted(t or "" for _, t in pairs)


def test_fim_own_sentinels_and_empty_table(spark):
    own = fim.Params(prefix="[P.]", suffix="[S.]", middle="[M.]", rate=100, spm=50)
    made = fim.transform(rows_of(spark, [(k, f"text {k} [P+]") for k in range(40)]), own)
    found = made.select("doc_id", "form", fim.restored(made["output"], made["form"], own).alias("back")).collect()
    assert {r["form"] for r in found} == {"psm", "spm"}
    assert all(r["back"] == f"text {r['doc_id']} [P+]" for r in found)
    assert fim.transform(rows_of(spark, [])).collect() == []


# Ranked search


def plain_search(docs, items, k=10):
    terms = [(i, lexical.terms_of((t or "").encode())) for i, t in docs]
    terms = [(i, t) for i, t in terms if t]
    n, total = len(terms), sum(len(t) for _, t in terms)
    df = Counter(w for _, t in terms for w in set(t))
    out = []
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, set()).update(lexical.terms_of((text or "").encode()))
    for item, want in asked.items():
        scored = []
        for doc, t in terms:
            tf, m = Counter(t), 10 + 90 * len(t) * n // total
            score = sum(lexical.weight(n, df[w]) * (10**9 * tf[w] // (1000 * tf[w] + 8 * m)) for w in want if w in tf)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def searched(spark, docs, items, params=lexical.Params()):
    found = lexical.search(lexical.index(rows_of(spark, docs).repartition(3), params), spark.createDataFrame(items, "item_id long, text string, rank string"), params)
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_search_equals_all_scores(spark, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    def text(n):
        return " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=n))
    docs = [(k, text(rng.choice([1, 5, 30]))) for k in range(300)] + [(1000 + k, "w0 w1 w59") for k in range(40)]
    items = [(k, text(rng.choice([1, 3, 12])), "x") for k in range(20)]
    want = plain_search(docs, [i[:2] for i in items])
    assert searched(spark, docs, items) == want
    # shards of a few documents, blocks of a few terms, and no head start
    assert searched(spark, docs, items, lexical.Params(shard_docs=7, block_terms=10, seeds=0)) == want


def test_search_cases(spark):
    docs = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "same words"), (3, "Same"), (20, "ÉCOLE École"), (21, "\x00 - !")]
    items = [(1, "same SAME plain", "x"), (2, None, "x"), (3, "", "x"), (4, "unknownterm", "x"), (5, "école", "x"), (5, "inside", "x"), (6, "École", "x")]
    assert searched(spark, docs, items) == plain_search(docs, [i[:2] for i in items])
    assert searched(spark, [], items) == []
    assert searched(spark, [(1, None), (2, " - ")], items) == []
    assert searched(spark, docs, []) == []


def test_terms_are_the_contract_pattern():
    import re

    pattern = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    text = "".join(map(chr, range(0x300))) + "AbC été 漢字 x\u0085y\xa0z"
    want = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in pattern.findall(text)]
    assert [t.decode() for t in lexical.terms_of(text.encode())] == want


def test_wand_skips(monkeypatch):
    """A frequent light term's documents are not scored one by one."""
    heavy = lexical.Postings(list(range(0, 1000, 100)), [1000] * 10, 1000, np.arange(0, 1000, 100), np.full(10, 1000))
    light = lexical.Postings(list(range(1000)), [1] * 1000, 1, np.arange(1000), np.ones(1000, np.int64))
    touched = []

    class Watched(list):
        def __getitem__(self, k):
            touched.append(k)
            return super().__getitem__(k)

    found = lexical.wand([heavy, light._replace(scores=Watched(light.scores))], 5)
    assert found == [(1001, d) for d in (0, 100, 200, 300, 400)]
    assert len(touched) <= 10


# Binary ids


@pytest.mark.parametrize("n", [1, 31, 32, 33, rans.SEGMENT, rans.SEGMENT + 1, rans.BLOCK])
def test_coded_ids_come_back(n):
    rng = np.random.default_rng(n)
    parts = [np.minimum(rng.zipf(1.3, n), 40_000).astype(np.uint32) for _ in range(3)]
    ids, counts = np.unique(np.concatenate(parts), return_counts=True)
    table = rans.Table.counted(ids.tolist(), counts.tolist())
    assert table.freq.sum() == rans.SCALE and table.freq.min() >= 1
    coded = rans.encode(parts, table)
    for part, found in zip(parts, rans.decode(coded, table), strict=True):
        assert np.array_equal(part, found)
    if n == rans.BLOCK:  # near the entropy, with checkpoints
        p = counts / counts.sum()
        bits = sum(32 * len(c.words) for c in coded) / (3 * n)
        assert bits < 1.02 * -(p * np.log2(p)).sum() + 0.05
        assert all(len(c.checkpoints) == rans.BLOCK // rans.SEGMENT for c in coded)


def test_decoding_starts_at_a_checkpoint():
    ids = np.random.default_rng(1).integers(0, 500, rans.BLOCK).astype(np.uint32)
    table = rans.Table.counted(*[x.tolist() for x in np.unique(ids, return_counts=True)])
    whole = rans.encode([ids], table)[0]
    part = rans.Coded(rans.SEGMENT, whole.checkpoints[2:3], whole.words)
    assert np.array_equal(rans.decode([part], table)[0], ids[2 * rans.SEGMENT : 3 * rans.SEGMENT])


def test_damage_is_found():
    ids = np.arange(1000, dtype=np.uint32) % 7
    table = rans.Table.counted(list(range(7)), [200] * 7)
    raw = rans.frame(rans.encode([ids], table)[0], ids, np.zeros(0, rans._DOC), table)
    assert np.array_equal(rans.decode([rans.unframe(raw, table)[0]], table)[0], ids)
    for bad in (raw[:-1], raw[:50] + bytes([raw[50] ^ 1]) + raw[51:], b""):
        with pytest.raises(ValueError):
            rans.unframe(bad, table)
    with pytest.raises(ValueError):
        rans.unframe(raw, rans.Table.counted(list(range(7)), [1, *[200] * 6]))
    with pytest.raises(ValueError):
        rans.encode([np.array([9], np.uint32)], table)


def test_checksums_join():
    parts = [b"", b"abc", bytes(700_000), b"\x01" * 300_001]
    assert rans.joined_crc([(len(p), zlib.crc32(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def library_rows(pairs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    out, start = [], 0
    for doc_id, text in pairs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_ids_of_all_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    want = library_rows(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
    assert sorted(map(tuple, rans.op13_token_output(spark, tiny).collect())) == want


def test_ids_cases(spark):
    """A document over several blocks, no id, repeated rows, and files without documents."""
    pairs = [(None, "no id"), (1, None), (2, ""), (5, "a b c d e f g " * 20_000), (6, "same"), (6, "same"), (9, "größe 漢字")]
    files = rans.write(rans.text_ids(rows_of(spark, pairs[::-1])), files=3)
    blocks = spark.read.parquet(files.blocks)
    assert blocks.agg({"n": "max"}).first()[0] == rans.BLOCK
    found = sorted(map(tuple, rans.digests(spark, files).collect()), key=lambda r: r[1])
    assert found == library_rows(pairs)
    whole = {}
    for r in rans.read(spark, files).filter("doc_id = 5").orderBy("at").collect():
        whole.setdefault(r["first"], []).append(bytes(r["ids"]))
    (parts,) = whole.values()
    assert len(parts) > 1 and len(b"".join(parts)) == 4 * next(n for d, _, n, _ in found if d == 5)
    empty = rans.write(rans.text_ids(rows_of(spark, [])))
    assert rans.digests(spark, empty).collect() == []
