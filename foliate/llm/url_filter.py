"""URL filters: block and allow rules, then a logistic regression on hashed character n-grams of host and path.

The classifier is trained on the small labelled table below (its size is the bound of what training reads; none of its names is a host of the given pages) by Spark's
own logistic regression; its weights become an array of constants, so a verdict is one expression over the url and a
table of any size is judged in one scan without a shuffle.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged on these;
repeated rows are judged alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Cells that n-grams are hashed to, and the lengths of n-grams.
CELLS = 4096
GRAMS = (3, 4)
REGULARISATION = 0.001


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query (fixed values).
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)

#: The labelled table: what unwanted and wanted sites are called after (invented here; no host of the given pages is
#: among the names), by itself and with three of the neutral words, and under the addresses of FORMS, so that neither those nor the
#: domain nor the path gives a label away.
UNWANTED = (
    "casino poker roulette slots jackpot gambling bets betting pills meds viagra pharmacy-deals adult xxx porn nude cams sex "
    "singles escort spam bulk-mail clickbait link-farm ads adserver ads-network popups banners payday quick-loans warez cracked torrents "
    "keygen malware phishing doubler free-money free-gifts win-prizes lottery fake-bags replica cheap-watches cheap-meds"
).split()
WANTED = (
    "library gardening news weather university documentation books museum recipes travel city astronomy science health school "
    "open-data history radio savings music forum art film birds blood-donors athletics press-review theatre chess "
    "town nation thanks tradition thinking another motion northern southern addresses headlines education speeches "
    "nothing gathering clothing other things bathing"
).split()
NEUTRAL = "hub zone world direct place shop park lane star box online".split()
#: Frequent pairs of English letters; four of them make a word that nobody has seen, which is no reason to block it.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le".split()
PSEUDO_WORDS = 200


def pseudo_word(k: int) -> str:
    """The k-th word of letter pairs: digits of a number in the base of their count, strides apart."""
    n = len(PAIRS)
    return "".join(PAIRS[(k * step + k // n * turn + at) % n] for step, turn, at in ((7, 1, 0), (11, 3, 5), (13, 7, 11), (17, 2, 19)))


FORMS = ("https://{0}.example.com/en/{1}", "http://www.{0}.example.net/de/{1}?page=2", "http://m.{0}.example.org/fr/{1}.html", "https://blog.{0}.example.com/{1}/")


def host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host_: Column, path_: Column, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host_ == r.host) | host_.endswith("." + r.host)) & path_.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def grams(host_: Column, path_: Column) -> Column:
    """The cells of all n-grams of the host and of the path, the one's ends marked apart from the other's."""

    def of(text: Column, kind: str, n: int) -> Column:
        count = F.length(text) - (n - 1)
        at = F.when(count < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(count, F.lit(1))))
        return F.transform(at, lambda i: F.pmod(F.xxhash64(F.lit(kind), text.substr(i, F.lit(n))), F.lit(CELLS)).cast("int"))

    marked = F.concat(F.lit("^"), host_, F.lit("$"))
    return F.concat(*[of(t, k, n) for n in GRAMS for t, k in ((marked, "host"), (path_, "path"))])


def labelled(spark: SparkSession) -> DataFrame:
    """url, label (1: unwanted) and the name that both come from."""
    words = [(w, 1) for w in UNWANTED] + [(w, 0) for w in WANTED]
    names = [(n, label) for k, (w, label) in enumerate(words) for n in (w, f"{w}-{NEUTRAL[k % 11]}", f"{w}-{NEUTRAL[(k + 4) % 11]}", f"{NEUTRAL[(k + 8) % 11]}-{w}")]
    names += [(pseudo_word(k), 0) for k in range(PSEUDO_WORDS)]
    rows = [(form.format(n, k * 7919 % 10007), label, n) for k, (n, label) in enumerate(names) for form in FORMS]
    values = ", ".join(f"('{url}', {label}.0D, '{n}')" for url, label, n in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, label, name)")


class Model(NamedTuple):
    bias: float
    weights: list[float]


def train(table: DataFrame) -> Model:
    """Logistic regression on how many of a url's n-grams fall into each cell; both labels weigh the same."""
    cells = F.transform(grams(host(F.col("url")), path(F.col("url"))), lambda c: c.cast("string"))
    counts = CountVectorizerModel.from_vocabulary([str(k) for k in range(CELLS)], "cells", "features")
    # written once, so that the rounds of the fit don't cut the urls anew; a few hundred rows
    rows = materialise(table.select("label", cells.alias("cells")), "labelled").coalesce(1)
    unwanted = rows.agg(F.avg("label")).first()[0]
    weight = F.when(F.col("label") == 1, 0.5 / max(unwanted, 1e-9)).otherwise(0.5 / max(1 - unwanted, 1e-9))
    rows = counts.transform(rows).withColumn("weight", weight)
    fit = LogisticRegression(maxIter=60, regParam=REGULARISATION, standardization=False, weightCol="weight").fit(rows)
    return Model(float(fit.intercept), [float(w) for w in fit.coefficients])


def score(host_: Column, path_: Column, model: Model) -> Column:
    """Probability that the url is unwanted."""
    weights = F.array(*[F.lit(w) for w in model.weights])
    total = F.aggregate(grams(host_, path_), F.lit(0.0), lambda acc, c: acc + F.get(weights, c))
    return 1 / (1 + F.exp(-(model.bias + total)))


def judge(pages: DataFrame, model: Model, rules: Sequence[Rule] = RULES) -> DataFrame:
    """page_id, host, path, rule, score and verdict of every url."""
    parts = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        host(F.col("url").cast("string")).alias("host"),
        path(F.col("url").cast("string")).alias("path"),
    )
    name, ruled = rule_of(F.col("host"), F.col("path"), rules)
    p = score(F.col("host"), F.col("path"), model)
    learned = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return parts.withColumns({"rule": name, "ruled": ruled, "score": p}).select(
        "page_id", "host", "path", "rule", "score", F.coalesce("ruled", learned).alias("verdict")
    )


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(labelled(spark))
    return judge(table(spark, sf_dir, "pages"), model).select(
        "page_id", "host", "path", "rule", "verdict", "score"
    )
