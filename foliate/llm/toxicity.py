"""Toxicity by weak supervision.

Many voters, each a lexicon or a pattern, vote toxic (1), clean (-1) or abstain (0) on a text.  A generative label
model over the votes estimates each voter's accuracy and how voters of one class correlate, and turns votes into a
posterior label; voters that say the same thing share their weight.  A linear classifier is trained on these posterior
labels and scores every text by one expression.

Some lexicons are given below, others are stems that training labels set apart (invented or foreign words too).  All
voters read the terms that one pattern finds in one pass over the whole text.  The stems are sought in about
``STEM_ROWS`` labelled training rows.  The label model is fitted on the
counts of vote patterns over all training rows, with the labels of training rows as anchors; the classifier on about
``SAMPLE_ROWS`` labelled training rows, or on as many others where none is labelled, chosen by a hash of their id.  There are fewer
than 2^21 patterns at any size (a vote of 0 or 1 from each lexicon, and 432 cases of the other voters), some hundreds in fact.

Defined results: a null or empty text has no votes but the clean ones and a low score; repeated rows are scored alike;
labels of a doc_id that occur more than once count once (the greatest); without any label the label model runs
unanchored; an empty table gives an empty result; further columns are ignored by :func:`score` and kept by :func:`keep`.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, kept_rows, materialise, table

#: Labelled training rows that the classifier is fitted on.
SAMPLE_ROWS = 40_000
#: Labelled training rows that stems are sought in, the stems kept at most, and what a stem must be: found in this
#: share of the toxic rows (and in five), and so many times likelier there than in clean rows.
STEM_ROWS = 12_000
STEMS = 300
STEM_SHARE, STEM_ROWS_LEAST, STEM_LIFT = 0.006, 5, 15.0
#: Lengths of stems, and the voters that they are dealt to.
STEM_LENGTHS = (4, 5, 6, 7, 8)
STEM_VOTERS = 6

#: Terms of the lexicon voters (natural order).
LEXICON = {
    "intellect": "idiot idiots idiotic moron morons moronic stupid dumb dimwit imbecile cretin fool brainless",
    "worth": "worthless pathetic loser losers trash garbage scum vermin filth parasite nobody",
    "contempt": "disgusting clown clowns freak creep ugly revolting vile despicable repulsive",
    "profanity": "shit shitty fuck fucking fucker bitch bastard asshole crap damn piss whore slut cunt",
    "threat": "kill murder strangle stab lynch exterminate hang",
    "other": "connard salaud abruti débile ordure dummkopf arschloch abschaum wertlos imbécil estúpido basura asqueroso",
}


def _trie(words: list[str]) -> str:
    """An alternation that tests each first letter once."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    out = []
    for head, tails in heads.items():
        if head == "":
            continue
        rest = [t for t in tails if t]
        inner = _trie(rest) + ("?" if "" in tails else "") if rest else ""
        out.append(re.escape(head) + inner)
    return "(?:" + "|".join(out) + ")"


TERMS = {k: v.split() for k, v in LEXICON.items()}


class Terms(NamedTuple):
    """What the lexicon voters look for: whole words by voter, and stems."""

    words: dict[str, list[str]]
    stems: list[str]

    @property
    def pattern(self) -> str:
        words = _trie([w for v in self.words.values() for w in v]) + r"(?!\p{L})"
        return r"(?<!\p{L})(?:" + words + ("|" + _trie(self.stems) if self.stems else "") + ")"

    def voters(self) -> list[list[str]]:
        dealt = [self.stems[k::STEM_VOTERS] for k in range(STEM_VOTERS)]
        return [*self.words.values(), *dealt]


def _labelled(labels: DataFrame) -> DataFrame:
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("label"))
    known = known.filter("label is not null").filter(remainder(F.col("__id")) != 0)
    return known.groupBy("__id").agg(F.max("label").alias("label"))


def _some(known: DataFrame, rows: int, n: int) -> DataFrame:
    """About ``rows`` of the ``n`` labels, by a hash of the id."""
    share = min(1.0, rows / max(n, 1))
    return known.filter(F.pmod(F.xxhash64(F.lit("sample"), "__id"), F.lit(1_000_000)) < int(share * 1_000_000))


def find_stems(docs: DataFrame, some: DataFrame) -> list[str]:
    """Beginnings of words that the toxic ones of ``some`` labelled rows have and the clean ones lack.

    Equal texts count once.  A stem that begins with another one found, or that a given term begins with, is
    left out.
    """
    texts = documents(docs).join(F.broadcast(some), F.col("doc_id") == F.col("__id"))
    low = F.lower(F.coalesce("text", F.lit("")))
    texts = texts.groupBy(F.xxhash64("text").alias("h")).agg(F.max("label").alias("label"), F.first(low).alias("low"))
    texts = materialise(texts.select("label", F.array_distinct(F.split("low", r"[^\p{L}]+")).alias("words")), "stems")
    size = texts.agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = size["toxic"] or 0, size["n"] - (size["toxic"] or 0)
    if not toxic:
        return []
    cut = [F.transform(F.filter("words", _long(n)), _head(n)) for n in STEM_LENGTHS]
    rows = texts.select("label", F.explode(F.array_distinct(F.concat(*cut))).alias("stem"))
    a, b = F.col("a"), F.col("b")
    lift = (a / toxic) / ((b + 1) / max(clean, 1))
    found = (
        rows.groupBy("stem")
        .agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
        .filter((a >= max(STEM_ROWS_LEAST, STEM_SHARE * toxic)) & (lift >= STEM_LIFT))
        .orderBy(F.desc(a * F.log(lift)), "stem")
        .limit(5 * STEMS)
        .collect()
    )
    given = [w for v in TERMS.values() for w in v]
    chosen: list[str] = []
    for r in found:
        stem = r["stem"]
        if len(chosen) < STEMS and not any(stem.startswith(c) for c in chosen) and not any(w.startswith(stem) for w in given):
            chosen.append(stem)
    return chosen


def _long(n: int):
    return lambda w: F.length(w) >= n


def _head(n: int):
    return lambda w: F.substring(w, 1, n)


def with_votes(docs: DataFrame, terms: Terms, carry: bool = False) -> DataFrame:
    """doc_id, the counts that features are made of, and ``votes`` (an array of -1, 0 and 1)."""
    row = ["__row"] * carry
    d = documents(docs, carry).select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"), *row)
    d = d.withColumn("hits", F.regexp_extract_all("text", F.lit(terms.pattern), F.lit(0)))
    n, distinct = F.size("hits"), F.size(F.array_distinct("hits"))
    thousand = F.length("text") / 1000.0
    dense = n / F.greatest(thousand, F.lit(0.1))
    term = terms.pattern
    close = F.when(n > 1, F.col("text").rlike(rf"(?s){term}.{{1,80}}{term}")).otherwise(False)
    address = r"(?s)(?<!\p{L})you(?:'re|\s+are)?(?:\s+(?:an?|such|the))?\s+"
    addressed = F.when(n > 0, F.col("text").rlike(address + term)).otherwise(False)
    one, none = F.lit(1), F.lit(0)
    votes = [
        *[F.when(F.arrays_overlap("hits", _strings(v)), one).otherwise(none) for v in terms.voters()],
        F.when(distinct >= 2, one).when(distinct == 0, -one).otherwise(none),
        F.when(n >= 3, one).otherwise(none),
        F.when((n >= 2) & (dense >= 1.0), one).when(n == 0, -one).otherwise(none),
        F.when(close, one).when(n == 1, -one).otherwise(none),
        F.when(addressed, one).otherwise(none),
        F.when((n == 1) & (thousand >= 0.5), -one).otherwise(none),
        F.when(n == 0, -one).otherwise(none),
    ]
    return d.select(
        "doc_id",
        *row,
        n.alias("n_hits"),
        distinct.alias("n_distinct"),
        dense.alias("density"),
        F.array(*[v.cast("tinyint") for v in votes]).alias("votes"),
    )


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


N_VOTERS = len(TERMS) + STEM_VOTERS + 7


class LabelModel(NamedTuple):
    """P(class), P(vote | class) per voter, the weight that correlation leaves to each voter, and the scale and shift
    of the log odds that make posteriors of labelled rows agree with their labels."""

    prior: np.ndarray
    table: np.ndarray  # voter, class, vote + 1
    weight: np.ndarray
    correlation: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        logs = np.log(self.table)[np.arange(votes.shape[1])[None, :], :, votes + 1]  # row, voter, class
        total = np.log(self.prior)[None, :] + (logs * self.weight[None, :, None]).sum(1)
        return total[:, 1] - total[:, 0]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic) of each row of votes."""
        return 1 / (1 + np.exp(-np.clip(self.scale * self.log_odds(votes) + self.shift, -30, 30)))


def fit_label_model(votes: np.ndarray, unlabelled: np.ndarray, clean: np.ndarray, toxic: np.ndarray, rounds: int = 60) -> LabelModel:
    """Expectation maximisation over distinct vote patterns and their counts; labelled rows keep their label."""
    n_voters = votes.shape[1]
    table = np.full((n_voters, 2, 3), 1 / 3)
    table[:, 1, 2], table[:, 1, 0] = 0.6, 0.1
    table[:, 0, 2], table[:, 0, 0] = 0.1, 0.6
    table /= table.sum(2, keepdims=True)
    model = LabelModel(np.array([0.9, 0.1]), table, np.full(n_voters, 1 / np.sqrt(n_voters)), np.eye(n_voters))
    one_hot = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)
    for _ in range(rounds):
        p = model.posterior(votes)
        mass = np.stack([clean + unlabelled * (1 - p), toxic + unlabelled * p], 1)  # pattern, class
        prior = (mass.sum(0) + 1) / (mass.sum() + 2)
        table = np.einsum("kc,kvs->vcs", mass, one_hot) + 0.5
        table /= table.sum(2, keepdims=True)
        correlation = np.eye(n_voters)
        for c in (0, 1):
            w = mass[:, c] / max(mass[:, c].sum(), 1e-9)
            centred = votes - (w[:, None] * votes).sum(0)
            cov = (w[:, None] * centred).T @ centred
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            correlation = np.maximum(correlation, np.abs(cov / sd[:, None] / sd[None, :]) * (np.diag(cov) > 1e-6)[:, None])
        model = LabelModel(prior, table, 1 / correlation.sum(0), correlation)
    if clean.sum() and toxic.sum():
        odds, n = model.log_odds(votes)[:, None], clean + toxic
        shift, scale = fit_linear(odds[n > 0], (toxic / np.maximum(n, 1))[n > 0], 0.1, weight=n[n > 0])
        if scale[0] > 0:
            model = model._replace(scale=float(scale[0]), shift=shift)
    return model


class Model(NamedTuple):
    terms: Terms
    bias: float
    weights: list[float]
    labels: LabelModel


def features(votes: np.ndarray, n_hits: np.ndarray, n_distinct: np.ndarray, density: np.ndarray) -> np.ndarray:
    return np.column_stack([votes, np.minimum(n_hits, 8), np.minimum(n_distinct, 6), np.minimum(density, 5.0)])


def _feature_columns() -> list[Column]:
    return [
        *[F.get("votes", F.lit(k)).cast("double") for k in range(N_VOTERS)],
        F.least("n_hits", F.lit(8)).cast("double"),
        F.least("n_distinct", F.lit(6)).cast("double"),
        F.least("density", F.lit(5.0)),
    ]


def fit_linear(
    x: np.ndarray, p: np.ndarray, penalty: float = 1.0, rounds: int = 50, weight: np.ndarray | None = None
) -> tuple[float, np.ndarray]:
    """Logistic regression on soft labels by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    weight = np.ones(len(x)) if weight is None else weight
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[0, 0] = 1e-6
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (weight * (q * (1 - q) + 1e-9))[:, None]).T @ x + ridge
        step = np.linalg.solve(curve, x.T @ (weight * (q - p)) + ridge @ w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), w[1:]


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, stem_rows: int = STEM_ROWS) -> Model:
    """Fit on the rows of ``docs`` that are not held out."""
    docs = documents(docs).filter(remainder(F.col("doc_id")) != 0)
    known = _labelled(labels)
    n = known.count()
    terms = Terms(TERMS, find_stems(docs, _some(known, stem_rows, n)))
    rows = with_votes(docs, terms).join(known, F.col("doc_id") == F.col("__id"), "left").drop("__id")
    rows = materialise(rows, "votes")
    found = rows.groupBy("votes").agg(
        F.count_if(F.col("label").isNull()).alias("unlabelled"),
        F.count_if(F.col("label") == 0).alias("clean"),
        F.count_if(F.col("label") == 1).alias("toxic"),
    )
    patterns = found.collect()  # bounded by the number of vote patterns
    if not patterns:
        empty, nothing = np.zeros((1, N_VOTERS), int), np.zeros(1)
        return Model(terms, -5.0, [0.0] * (N_VOTERS + 3), fit_label_model(empty, nothing, nothing, nothing))
    votes = np.array([r["votes"] for r in patterns], int)
    counts = [np.array([r[c] for r in patterns], float) for c in ("unlabelled", "clean", "toxic")]
    labels_model = fit_label_model(votes, *counts)
    some = rows.filter("label is not null").withColumnRenamed("doc_id", "__id")
    columns = ["votes", "n_hits", "n_distinct", "density"]
    every = rows.withColumnRenamed("doc_id", "__id")
    got = _some(some, sample_rows, n).select(*columns).collect() or _some(every, sample_rows, int(sum(c.sum() for c in counts))).select(*columns).collect()
    v = np.array([r["votes"] for r in got], int)
    x = features(v, *[np.array([r[c] for r in got], float) for c in columns[1:]])
    bias, weights = fit_linear(x, labels_model.posterior(v))
    return Model(terms, bias, weights.tolist(), labels_model)


def score(docs: DataFrame, model: Model, carry: bool = False) -> DataFrame:
    """doc_id, score and predicted of every whole text."""
    total = F.lit(model.bias)
    for w, f in zip(model.weights, _feature_columns(), strict=True):
        total = total + F.lit(w) * f
    p = 1 / (1 + F.exp(-F.greatest(F.least(total, F.lit(30.0)), F.lit(-30.0))))
    scored = with_votes(docs, model.terms, carry).select("doc_id", *["__row"] * carry, p.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic; all columns stay."""
    return kept_rows(score(docs, train(docs, labels), carry=True), F.col("predicted") == 0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    return score(docs, train(docs, labels)).select(
        "doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted"
    )
