"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

from __future__ import annotations

import numpy as np
import pytest

from foliate.llm import bpe, chat, media, minhash, packing, quality, secret_scan, sharding, toxicity, url_filter
from foliate.llm.bpe import Vocabulary, vocabulary_path

CLASH = "doc_id long, text string, lang string, source string, n int, size int, words string, __x string, fp string, part int, votes int, found int, row int"
LONG = "alpha beta gamma delta " * 30_000 + "x" * 5_000


def make(spark, rows):
    full = [(i, t, lang, src, 1, 2, "w", None, "f", 3, 4, 5, 6) for i, t, lang, src in rows]
    return spark.createDataFrame(full, CLASH)


ROWS = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \t\n ", "en", "a"),
    (4, "one two three four five six", "en", "a"),
    (5, "one two three four five six", "de", None),
    (5, "one two three four five six", "de", None),
    (6, LONG, "fr", "b"),
    (7, "One TWO three four five six", "en", "b"),
    (8, "hi", "en", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, ROWS)


@pytest.fixture(scope="module")
def nothing(spark):
    return make(spark, [])


def test_near_dedup(docs, nothing):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, minhash.QUERY).collect()}
    assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in got.items()} == {
        1: (0, 1, True), 2: (0, 2, True), 3: (0, 3, True), 4: (4, 4, True), 5: (4, 4, False),
        6: (got[6]["n_shingles"], 6, True), 7: (4, 4, False), 8: (1, 8, True),
    }
    assert minhash.near_duplicates(nothing).count() == 0
    assert minhash.keep_one(docs, minhash.QUERY).columns == docs.columns


def test_sketches_merge_and_estimate():
    p = minhash.Params()
    a, b = (np.unique(np.random.default_rng(k).integers(0, 2**63, 4000).astype(np.uint64)) for k in (1, 2))
    whole = np.union1d(a, b)
    ra, rb, rw = minhash.sketch([a, b, whole], p)
    assert (minhash.merge(ra, rb) == rw).all()
    big = np.union1d(a, b[:1000])
    (rx,) = minhash.sketch([big], p)
    est = minhash.similarity(ra[None], rx[None], np.array([len(a)], float), np.array([len(big)], float), p)[0]
    assert abs(est - len(a) / len(big)) < 0.12


def test_packing(docs, nothing):
    rows = packing.pack(docs).collect()
    assert packing.pack(nothing).count() == 0
    assert sum(r["length"] for r in rows if r["doc_id"] == 5) == 2 * next(r["doc_tokens"] for r in rows if r["doc_id"] == 5)
    assert [(r["length"], r["ids"][:4]) for r in rows if r["doc_id"] in (1, 2)] == [(1, bytes([1, 0, 0, 0]))] * 2


def round_robin(tokens: dict, weights: dict, length: int, grain: int, unit: int) -> list:
    """The output of a plain deficit round-robin over queues of tokens; all arithmetic in whole units."""
    names = sorted(tokens, key=lambda q: (q is not None, q))
    whole = sum(weights[q] for q in names)
    quantum = {q: max(1, round(weights[q] / whole * length * unit)) for q in names}
    deficit, at, out = dict.fromkeys(names, 0), dict.fromkeys(names, 0), []
    while any(at[q] < len(tokens[q]) for q in names):
        for q in names:
            left = len(tokens[q]) - at[q]
            if not left:
                continue
            deficit[q] += quantum[q]
            earned = deficit[q] // unit
            step = grain if quantum[q] < grain * unit else 1
            send = left if earned >= left else earned // step * step
            out += tokens[q][at[q] : at[q] + send]
            at[q] += send
            deficit[q] -= send * unit
    return out


@pytest.mark.parametrize(("sources", "weighted"), [(3, False), (3, True), (20, False), (20, True), (70, False), (70, True)])
def test_packing_is_a_round_robin(spark, sources, weighted):
    rows = [(k, "word " * (40 + k * 37 % 300), "en", None if k % sources == 1 else f"s{k % sources:02d}") for k in range(6 * sources)]
    weights = {q: float(1 + 30 * (k == 0) + k % 3) for k, q in enumerate(sorted({r[3] for r in rows}, key=lambda q: (q is not None, q)))}
    docs = make(spark, rows).repartition(3)
    packed = packing.pack(docs, packing.Mixture(weights=weights if weighted else None, length=512)).collect()
    own, source = {}, {r[0]: r[3] for r in rows}
    for r in packed:
        ids = np.frombuffer(r["ids"], "<u4")
        own.setdefault(r["doc_id"], {}).update({r["start"] + i: (r["sequence_id"] * 512 + r["offset"] + i, int(x)) for i, x in enumerate(ids)})
    # the order of a queue's documents is the packing's own; all else must be the loop's
    first = sorted(own, key=lambda d: own[d][0])
    tokens: dict = {}
    for d in first:
        tokens.setdefault(source[d], []).extend((d, i) for i in range(len(own[d])))
    target = weights if weighted else {q: float(len(t)) for q, t in tokens.items()}
    want = round_robin(tokens, target, 512, packing.Mixture().grain, packing.units(sources))
    got = {own[d][i][0]: (d, i) for d in own for i in own[d]}
    assert [got[k] for k in range(len(got))] == want


def test_every_window_holds_the_mixture(spark):
    rows = [(k, "word " * (100 + k % 200), "en", f"s{k % 20:02d}") for k in range(400)]
    packed = packing.pack(make(spark, rows), packing.Mixture(weights={f"s{k:02d}": 1.0 for k in range(20)})).collect()
    share: dict = {}
    for r in packed:
        held = share.setdefault(r["sequence_id"], [0] * 20)
        held[r["doc_id"] % 20] += r["length"]
    least = min(sum(r["length"] for r in packed if r["doc_id"] % 20 == k) for k in range(20))
    full = [s for k, s in share.items() if (k + 2) * 2048 / 20 < least]
    assert len(full) > 10 and all(sum(abs(x / 2048 - 0.05) for x in s) < 0.02 for s in full)


def test_more_sources_than_one_table_of_quanta_keep_their_weights(spark, monkeypatch):
    rows = [(k, "word " * (100 + k % 300), "en", None if k % 70 == 69 else f"s{k % 70:02d}") for k in range(1400)]
    mixture = packing.Mixture(weights={"s00": 30.0, None: 10.0, **{f"s{k:02d}": 1.0 for k in range(1, 69)}}, grain=2)
    packed = packing.pack(make(spark, rows), mixture).collect()
    early = [r for r in packed if r["sequence_id"] < 4]
    share = [sum(r["length"] for r in early if r["doc_id"] % 70 == k) / (4 * 2048) for k in (0, 69)]
    assert abs(share[0] - 30 / 108) < 0.02 and abs(share[1] - 10 / 108) < 0.02
    monkeypatch.setattr(packing, "MAX_QUEUES", 100)
    assert sorted(map(tuple, packing.pack(make(spark, rows), mixture).collect())) == sorted(map(tuple, packed))
    assert {len(r["ids"]) - 4 * r["length"] for r in packed} == {0}


def test_text_ids_equal_the_library():
    path = vocabulary_path()
    ids, library = packing.TextIds(path, bpe.split_pattern()), packing._tokenizer(path)
    texts = ["", " ", "it's  a\n\n test 123", "naïve café", "日本語 text", "a<|endoftext|>b", "y" * 3000 + " z", "\x1c\x85\xa0 q"]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids.encode(t), "<u2").tolist() == want, t[:20]
    vocab = Vocabulary(path)
    assert all(vocab.merge(b) == [i] for b, i in list(vocab.ids.items())[::50] if i not in vocab.special.values())


def test_quality(docs, nothing):
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert got[1]["n_words"] == got[3]["n_words"] == 0 and got[1]["base_failed"]
    assert got[6]["n_repeat_words"] > 0 and got[6]["base_failed"]
    assert quality.judge(nothing).count() == 0 and quality.keep(docs).columns == docs.columns


def test_toxicity(spark, docs, nothing):
    labels = spark.createDataFrame([(4, 0), (4, 1), (7, None), (None, 1)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(scored) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.score(nothing, toxicity.train(nothing, labels.limit(0))).count() == 0


def test_chat(spark):
    rows = [(1, 2, "assistant", None), (1, 1, None, "a<|im_end|>"), (None, 1, "user", "x"), (1, 2, "assistant", None)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS n_turns", "'p' AS part")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"], r["rewritten"]) for r in chat.digests(c).collect()}
    assert got == {1: (3, 0, False), None: (1, 0, False)}
    assert chat.digests(c.limit(0)).count() == 0


def test_templates_that_rewrite_history_are_found():
    def last_only(turns):
        return "".join(f"[{r}]{t if k == len(turns) - 1 else ''}" for k, (r, t) in enumerate(turns))

    turns = [("user", "a"), ("assistant", "b")]
    assert chat.rewrites_history(last_only, turns) and not chat.rewrites_history(chat.chatml, turns)
    for text in ("<|x", "<\\|", "<\\\\|im_end|>", "plain", "<<||"):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_long_conversations_are_rendered_from_their_first_turn(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"t{k}<|") for k in range(150)] + [(2, 0, "user", "x")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = [(role, text) for conv, _, role, text in rows if conv == 1]

    def numbered(ts):
        return "".join(chat.chatml([(r, f"{k} of {ts[0][1]}: {t}" if k else t)]) for k, (r, t) in enumerate(ts))

    def forgetful(ts):  # what it shows of the first turn changes at the hundredth
        return ("late" if len(ts) > 100 else "") + chat.chatml(ts)

    def by_turn(template):
        got = chat.formatted(c, template).filter("conv_id = 1").orderBy("turn_number").collect()
        assert [r["turn_number"] for r in got] == list(range(150))
        return got

    assert "".join(r["part"] for r in by_turn(numbered)) == numbered(turns)
    assert [r["turn_number"] for r in by_turn(forgetful) if r["rewritten"]] == [100]
    got = {r["conv_id"]: (r["n_turns"], r["rewritten"]) for r in chat.digests(c, forgetful).collect()}
    assert got == {1: (149, True), 2: (1, False)}
    assert chat.digests(c, numbered).filter("rewritten").count() == 0
    assert all(r["rewritten"] for r in by_turn(lambda ts: chat.chatml(ts[-70:]))[70:])


def test_secrets(spark, docs, nothing):
    ledger = secret_scan.ledger_path(spark)
    secret = make(spark, [(1, "é password: abcdef AKIA" + "A" * 16, "en", "a"), (2, None, None, None), (3, "token=" + "0" * 30, "en", "a")])
    first = {r["doc_id"]: [tuple(s) for s in r["found"]] for r in secret_scan.scan(secret, ledger).collect()}
    assert first == {1: [(2, 0, 18), (19, 1, 39)], 2: [], 3: [(0, 0, 36), (6, 2, 36)]}
    n = spark.read.parquet(ledger).count()
    assert secret_scan.scan(secret, ledger).count() == 3 and spark.read.parquet(ledger).count() == n == 3  # all seen before
    assert secret_scan.scan(nothing, secret_scan.ledger_path(spark)).count() == 0
    text = {r["doc_id"]: r["text"] for r in secret_scan.redact(secret).collect()}
    assert text[1] == "é [assign] [access]" and text[2] is None and text[3] == "[assign]"
    assert secret_scan.scan(docs, secret_scan.ledger_path(spark)).count() == len(ROWS)


def test_documents_without_an_id_lose_secrets_and_copies(spark):
    words = "one two three four five six seven eight nine ten eleven twelve"
    texts = [f"{words} password: abcdef", "token=" + "0" * 30, f"{words} password: abcdef", "other words stand here and there", "other words stand here and there"]
    docs = make(spark, [(None if k < 4 else 7, t, "en", "a") for k, t in enumerate(texts)])
    clean = sorted(r["text"] for r in secret_scan.redact(docs).collect())
    assert clean == sorted([f"{words} [assign]", "[assign]", f"{words} [assign]", *texts[3:]])
    rows = minhash.near_duplicates(docs, minhash.QUERY).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in rows) == [
        (0, 0, False), (0, 0, True), (0, 0, True), (0, 7, False), (7, 7, True),
    ]
    kept = minhash.keep_one(docs, minhash.QUERY)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(0, texts[0]), (0, texts[1]), (7, texts[4])])
    everything = make(spark, [(None, t, "en", "a") for t in texts])
    assert minhash.keep_one(everything, minhash.QUERY).count() == 3


def test_shards(docs, nothing):
    got = sharding.shard(docs, shards=4).collect()
    assert len(got) == len(ROWS) and {r["shard"] for r in got} <= {0, 1, 2, 3}
    assert sharding.shard(nothing, shards=4).count() == 0


def test_media(docs, nothing):
    rows = {r["doc_id"]: r for r in media.read_media(media.store_texts(docs)).collect()}
    assert rows[1]["data"] == b"\xff" * 576 and rows[6]["data"].startswith(LONG.encode()) and not rows[6]["errors"]
    assert media.store_texts(nothing).count() == 0
    whole = media.store(b"a" * 576 * 40)
    lost = whole[: 188 * 6] + whole[188 * 7 :]
    assert "continuity:1" in media.read(lost).errors and media.read(whole[188:]).errors == ["tables"]
    s = media.read(whole)
    assert len(s.times) == 40 and len(s.access_at) == 2 and (np.diff(s.times) > 0).all()


def test_urls(spark):
    model = url_filter.Model(-1.0, [0.0] * url_filter.CELLS)
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://WWW.Example.COM/en/71?x"), (4, "http://a.com"), (4, "http://a.com"), (5, "s://net/de/#f"), (6, "://")]
    p = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS path", "3 AS rule")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(p, model).fillna("-", ["rule"]).collect())
    assert got == [
        (1, "", "", "-", "allow"), (2, "", "", "-", "allow"), (3, "www.example.com", "/en/71", "example.com/en/7", "allow"),
        (4, "a.com", "", "-", "allow"), (4, "a.com", "", "-", "allow"), (5, "net", "/de/", "net/de/", "block"), (6, "", "", "-", "allow"),
    ]


def test_bpe(spark, docs, nothing):
    lexicon = bpe.build_lexicon(docs, words=50)
    rows = bpe.decode(bpe.encode(docs, lexicon)).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == {d: t or "" for d, t, _, _ in ROWS}
    empty = bpe.build_lexicon(nothing)
    assert bpe.encode(nothing, empty).count() == 0 and bpe.encode(docs, empty).count() == len(ROWS)


def test_texts_under_one_doc_id_are_one_document(spark):
    words = "one two three four five six seven eight nine ten"
    docs = make(spark, [(1, words, "en", "a"), (2, words, "en", "a"), (2, "short text", "en", "a"), (3, "short text", "en", "a"), (2, None, "en", "b")])
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, minhash.QUERY).collect()}
    assert got == {(1, 8, 1, True), (2, 8, 1, False), (3, 1, 3, True)}
    assert sorted(r["doc_id"] for r in minhash.keep_one(docs, minhash.QUERY).collect()) == [1, 3]


def test_a_changed_rule_is_scanned_anew_and_alone(spark):
    assign, access, hexes = secret_scan.BASE
    docs = make(spark, [(1, "token=abcdefgh AKIA" + "B" * 16, "en", "a"), (2, "0" * 30, "en", "a")] + [(3, "secret: zzzzzzzz", "en", "a")] * 3)
    ledger = secret_scan.ledger_path(spark)
    listed = lambda rules: sorted((r["doc_id"], tuple(rules[s["rank"]].kind for s in r["found"])) for r in secret_scan.scan(docs, ledger, rules).collect())
    entries = lambda: {(r["rules"], r["n"]) for r in spark.read.parquet(ledger).groupBy("rules").count().withColumnRenamed("count", "n").collect()}
    assert listed([access]) == [(1, ("access",)), (2, ()), (3, ()), (3, ()), (3, ())]
    assert entries() == {(access.version, 3)}  # one entry for three equal rows
    assert listed([assign, access, hexes]) == [(1, ("assign", "access")), (2, ("hex",)), *[(3, ("assign",))] * 3]
    assert entries() == {(access.version, 3), (f"{assign.version}-{hexes.version}", 3)}  # known pairs were not scanned again
    longer = assign._replace(least=9)
    assert longer.version != assign.version
    assert listed([longer, access]) == [(1, ("access",)), (2, ()), (3, ()), (3, ()), (3, ())]
    assert listed([hexes]) == [(1, ()), (2, ("hex",)), (3, ()), (3, ()), (3, ())] and len(entries()) == 3


def test_secrets_where_texts_are_shuffled(spark, docs, monkeypatch):
    many = make(spark, [(k, f"token=abc{k}def " * (600 if k == 3 else 1) + "é AKIA" + "C" * 16, "en", "a") for k in range(50)])
    want = sorted(map(tuple, secret_scan.digests(secret_scan.scan(many, secret_scan.ledger_path(spark))).collect()))
    monkeypatch.setattr(secret_scan, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, secret_scan.digests(secret_scan.scan(many, secret_scan.ledger_path(spark))).collect())) == want
    assert [r[1] for r in want] == [600 if k == 3 else 1 for k in range(50)]
    text = {r["doc_id"]: r["text"] for r in secret_scan.redact(many).collect()}
    assert text[3] == "[assign] " * 600 + "é [access]" and text[4] == "[assign] é [access]"


def test_names_that_clash_with_the_operators_own(spark):
    rows = [(1, "token=abcdefgh and words", 5, 6, 7, 8), (2, "token=abcdefgh and words", 5, 6, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id int, __found int, __blob int, __row int")
    assert sorted(map(tuple, secret_scan.redact(docs).collect())) == [(k, "[assign] and words", 5, 6, 7, 8) for k in (1, 2)]
    assert [tuple(r) for r in minhash.keep_one(docs).collect()] == rows[:1]
    assert quality.keep(docs).count() == 0 and quality.keep(docs).columns == docs.columns


def test_long_conversations_and_a_role_that_holds_the_probe(spark):
    turns = [("user" if k % 2 else f"assistant{chat.PROBE}", f"text {k}") for k in range(1000)]
    rows = [(1, k, *t) for k, t in enumerate(turns)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (got,) = chat.digests(c).collect()
    assert (got["n_turns"], got["rewritten"], got["formatted_chars"]) == (1000, False, len(chat.chatml(turns)))

    def rewrites_the_first(ts):
        return chat.chatml(ts if len(ts) <= 66 else [("user", "changed"), *ts[1:]])

    for n in (65, 66, 67, 200):
        assert chat.rewrites_history(rewrites_the_first, turns[:n]) == (n > 66)


def plain_kd(rows: list[dict], shards: int, widths: dict) -> list[list[int]]:
    """Documents of each shard by plain recursion over sorted lists."""
    if shards == 1 or not rows:
        return [[r["doc_id"] for r in rows]] + [[]] * (shards - 1)
    width = lambda d: ((max(r[d] for r in rows) >> sharding.TIE_BITS) - (min(r[d] for r in rows) >> sharding.TIE_BITS)) / widths[d]
    by = max(sharding.DIMENSIONS, key=width)
    rows = sorted(rows, key=lambda r: r[by])
    want, at, cut = sum(r["size"] for r in rows) * (shards // 2) / shards, 0, 0
    while cut < len(rows) and at + rows[cut]["size"] < want:
        at, cut = at + rows[cut]["size"], cut + 1
    if cut < len(rows) and at + rows[cut]["size"] - want <= want - at:
        cut += 1
    return plain_kd(rows[:cut], shards // 2, widths) + plain_kd(rows[cut:], shards - shards // 2, widths)


def test_shards_are_those_of_a_plain_tree(spark):
    import random

    pick = random.Random(3)
    rows = [(k * 2**33, "x" * int(pick.expovariate(0.01)), pick.choice(["en", "de", None]), f"s{pick.randrange(9)}") for k in range(400)]
    meta = sharding.metadata(make(spark, rows))
    plain = [r.asDict() for r in meta.collect()]
    widths = {d: max(1, (max(r[d] for r in plain) >> sharding.TIE_BITS) - (min(r[d] for r in plain) >> sharding.TIE_BITS)) for d in sharding.DIMENSIONS}
    for shards in (2, 5, 16):
        placed, _ = sharding.kd_shards(meta, shards)
        got = {}
        for r in placed.collect():
            got.setdefault(r["shard"], []).append(r["doc_id"])
        assert [sorted(got.get(k, [])) for k in range(shards)] == [sorted(x) for x in plain_kd(plain, shards, widths)]
    order = [r["d_order"] for r in sorted(plain, key=lambda r: r["doc_id"])]
    assert order == sorted(order)  # ids beyond 2^20 keep their order


def test_label_model_gives_the_exact_posteriors():
    """Three independent voters with labels for all rows: what is fitted is the table of counts, so Bayes' rule by hand."""
    from itertools import product

    votes = np.array(list(product((-1, 0, 1), repeat=3)))
    p1, p0 = np.array([0.1, 0.2, 0.7]), np.array([0.6, 0.3, 0.1])
    toxic = np.array([1e5 * 0.2 * np.prod(p1[v + 1]) for v in votes])
    clean = np.array([1e5 * 0.8 * np.prod(p0[v + 1]) for v in votes])
    model = toxicity.fit_label_model(votes, np.zeros(27), clean, toxic)
    want = toxic / (toxic + clean)
    assert np.abs(model.posterior(votes) - want).max() < 0.02
    twice = np.column_stack([votes[:, :1]] * 3 + [votes[:, 1:]])  # a voter that is there three times counts once
    assert np.abs(toxicity.fit_label_model(twice, np.zeros(27), clean, toxic).posterior(twice) - want).max() < 0.05


def test_toxicity_without_labels_samples_by_a_hash(spark, monkeypatch):
    docs = make(spark, [(k, "you stupid idiot and moron" if k % 10 == 0 else "a fine day", "en", "a") for k in range(300)])
    nobody = spark.createDataFrame([], "doc_id long, toxic int")
    models = [toxicity.train(docs.repartition(n), nobody, sample_rows=100) for n in (1, 7)]
    assert np.allclose(models[0].weights, models[1].weights) and models[0].bias == pytest.approx(models[1].bias)
    kept = toxicity.keep(docs, nobody)
    assert kept.columns == docs.columns and kept.filter("doc_id % 10 <> 0").count() == 270


def plain_stream(payload: bytes) -> bytes:
    """The transport stream of a payload, packet by packet."""

    def table(pid: int, kind: int, ident: int, body: bytes) -> bytes:
        head = bytes([kind, 0xB0, 5 + len(body) + 4]) + ident.to_bytes(2, "big") + bytes([0xC1, 0, 0]) + body
        section = head + media.crc32_mpeg(head).to_bytes(4, "big")
        return (bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(188, b"\xff")

    out = table(0, 0, 1, bytes([0, 1, 0xE1, 0x00])) + table(0x100, 2, 1, bytes([0xE1, 0x01, 0xF0, 0, 6, 0xE1, 0x01, 0xF0, 0]))
    counter = 0
    for k in range(len(payload) // 576):
        t = k * 576 * 90_000 // 24_000
        stamp = bytes([0x20 | (t >> 30 & 7) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])
        left = bytes([0, 0, 1, 0xBD]) + (3 + 5 + 576).to_bytes(2, "big") + bytes([0x84, 0x80, 5]) + stamp + payload[576 * k : 576 * k + 576]
        field = bytes([7, 0x10 | (0x40 if k % 32 == 0 else 0)]) + (t << 15 | 0x7E00).to_bytes(6, "big")
        start = True
        while left:
            room = 184 - len(field)
            if len(left) < room:  # stuffing
                field = bytes([183 - len(left), 0]) + b"\xff" * (182 - len(left))
                room = len(left)
            out += bytes([0x47, (0x40 if start else 0) | 1, 1, (0x30 if field else 0x10) | counter & 15]) + field + left[:room]
            left, field, start, counter = left[room:], b"", False, counter + 1
    return out


def test_streams_are_those_of_a_plain_writer():
    payload = bytes(np.random.default_rng(1).integers(0, 256, 576 * 70, dtype=np.uint8))
    assert media.store(payload) == plain_stream(payload)
    s = media.read(plain_stream(payload))
    assert s.data == payload and s.times.tolist() == [k * 2160 for k in range(70)] and s.access_times.tolist() == [0, 32 * 2160, 64 * 2160] and not s.errors


def test_a_ledger_of_many_rules(spark, docs):
    """Folder names of fixed length, whatever the number of rules; a changed hint is another rule."""
    rules = [secret_scan.Rule(f"kind{k}", f"needle{k}x+", 0, 8, f"needle{k}x") for k in range(200)]
    found = make(spark, [(k, f"a needle{k}xxx here", "en", "a") for k in range(0, 200, 20)])
    ledger = secret_scan.ledger_path(spark)
    listed = lambda r: sorted((x["doc_id"], [tuple(s) for s in x["found"]]) for x in secret_scan.scan(found, ledger, r).collect())
    assert listed(rules) == [(k, [(2, k, 11 + len(str(k)))]) for k in range(0, 200, 20)]
    base = secret_scan.BASE[1]
    blind = base._replace(hint="nothing like it")
    some = make(spark, [(1, "AKIA" + "B" * 16, "en", "a")])
    of = lambda r: [len(x["found"]) for x in secret_scan.scan(some, ledger, [r]).collect()]
    assert of(blind) == [0] and of(base) == [1] and of(blind) == [0]


def test_repeated_rows_are_spread_over_shards(spark):
    rows = [(7, "the same text", "en", "a")] * 1600
    sizes = sorted(r["count"] for r in sharding.shard(make(spark, rows), shards=16).groupBy("shard").count().collect())
    assert len(sizes) == 16 and sizes[-1] - sizes[0] <= 1
    mixed = rows + [(100 + k, f"text number {k:04d}", "en", "a") for k in range(1600)]
    placed = sharding.shard(make(spark, mixed), shards=16).collect()
    total, each = sum(r["size"] for r in placed), {}
    for r in placed:
        each.setdefault(r["shard"], []).append(r)
    assert len(each) == 16 and all(abs(sum(r["size"] for r in x) - total / 16) <= 4 * 17 for x in each.values())
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in each.values())


def test_a_large_table_is_read_as_it_lies(spark, tmp_path, monkeypatch):
    from foliate.llm import common

    spark.range(200_000).selectExpr("id", "sha2(cast(id as string), 256) AS h").coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    exchange = lambda: "Exchange" in common.table(spark, str(tmp_path), "t")._jdf.queryExecution().toString()
    assert exchange() and common.table(spark, str(tmp_path), "t").count() == 200_000
    monkeypatch.setattr(common, "DEALT_BYTES", 1 << 20)
    assert not exchange()
