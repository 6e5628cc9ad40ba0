"""The stages of the corpus pipeline against plain versions, each on what the one before has kept."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from foliate.llm import quality, secret_scan  # noqa: E402
from foliate.llm.common import materialise  # noqa: E402

from test_contracts import WORD, components, library, repeat_words  # noqa: E402, F401


def keeps(text: str | None) -> bool:
    """The quality rules, word by word."""
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    if n < 20 or 100 * repeat_words(words) > 30 * n:
        return False
    stops = sum(re.sub(r"[.,;:!?]*$", "", w).lower() in quality.STOP_WORDS for w in words)
    chars = sum(map(len, words))
    value = {
        "mean_word_length": chars / n,
        "symbol_ratio": sum(c in quality.SYMBOLS for c in text) / chars,
        "bar_word_ratio": sum(w in ("|", "||") for w in words) / n,
        "shout_ratio": sum(w.endswith("!!") for w in words) / n,
        "dup_line_ratio": (len(lines) - len(set(lines))) / len(lines),
        "stop_word_ratio": stops / n,
        "distinct_word_ratio": len(set(words)) / n,
    }
    return all(n < r.min_words or (r.least is None or value[r.measure] >= r.least) and (r.most is None or value[r.measure] <= r.most) for r in quality.RULES)


def redacted(text: str) -> str:
    found = sorted((m.start(), k, m.end(), r.kind) for k, r in enumerate(secret_scan.RULES) for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.least)
    out, at = "", 0
    for start, _, end, kind in found:
        if start >= at:
            out += text[at:start] + f"[{kind}]"
        at = max(at, end)
    return out + text[at:]


@pytest.fixture(scope="module")
def stages(spark, tiny):
    """What each stage read and returned."""
    docs, out = spark.read.parquet(f"{tiny}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        found = materialise(stage(spark, docs, tiny), name)
        out[name] = (docs, found)
        docs = found
    return out


def texts(df) -> dict:
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_every_stage_but_the_last_returns_the_columns_of_documents(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "toxicity", "near_dedup", "secret_scans", "packing"]
    first = stages[names[0]][0].columns
    assert all(stages[n][1].columns == first for n in names[:-1])


def test_quality_stage(stages):
    before, after = map(texts, stages["quality_rules"])
    assert after == {d: t for d, t in before.items() if keeps(t)} and len(after) < len(before)


def test_toxicity_stage(spark, tiny, stages):
    before, after = map(texts, stages["toxicity"])
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()}
    gone = set(before) - set(after)
    clean = [d for d in before if label.get(d) == 0]
    toxic = [d for d in before if label.get(d) == 1]
    assert len(gone & set(clean)) <= 0.03 * len(clean) and len(gone & set(toxic)) >= 0.6 * len(toxic)  # few labels here; larger tables catch more (test_contracts)


def test_near_dedup_stage(stages):
    before, after = map(texts, stages["near_dedup"])
    want = components(before, 5, 80)
    assert after == {d: t for d, t in before.items() if want[d] == d}


def test_secrets_stage(spark, tiny, stages):
    docs, found = stages["secret_scans"]
    assert texts(found) == {d: redacted(t or "") for d, t in texts(docs).items()}
    planted = docs.withColumn("text", F.concat("text", F.lit(f" é password: hunter22 AKIA{'B' * 16} "), "text"))  # few texts here hold one
    after = texts(corpus_pipeline.secrets(spark, planted, tiny))
    assert after == {d: redacted(t or "") for d, t in texts(planted).items()}
    assert all("[assign] [access]" in t for t in after.values())


def test_packing_stage_and_the_whole(spark, tiny, stages, library):  # noqa: F811
    docs = texts(stages["packing"][0])
    want = {d: [*library.encode(t or "", add_special_tokens=False).ids, 1] for d, t in docs.items()}
    for packed in (stages["packing"][1], corpus_pipeline.run(spark, tiny)):
        got: dict = {}
        for r in packed.collect():
            got.setdefault(r["doc_id"], {}).update(enumerate(np.frombuffer(r["ids"], "<u4").tolist(), r["start"]))
        assert {d: [ids[k] for k in range(len(ids))] for d, ids in got.items()} == want


def test_stages_of_an_empty_table_and_of_clashing_names(spark, tiny):
    given = spark.read.parquet(f"{tiny}/documents.parquet")
    odd = given.withColumns({c: F.lit(k) for k, c in enumerate(("__id", "__found", "__blob", "__verdict", "__row", "queue", "hub", "n"))})
    empty, clashing = odd.limit(0), odd.limit(60)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, tiny).count() == 0
        found = materialise(stage(spark, clashing, tiny), name)
        assert found.count() > 0
        if name != "packing":
            assert found.columns == odd.columns
            clashing = found
