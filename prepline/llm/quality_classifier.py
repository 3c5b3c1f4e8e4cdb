"""Operator 2, quality classifier: hierarchical empirical Bayes.

Document level: two logistic regressions (poor quality, toxic) over a small set of features:
shares of symbols, capitals, digits, separators, repeated words, lines and so on, and two
lexicon scores. The lexicons are found by empirical Bayes: the odds of a word, or of a word's
first letters, among labelled
positive and negative documents, shrunk towards even odds, kept if the shrunk log odds stand
out; the models are fitted on at most ``SAMPLE_ROWS`` labelled documents (a hash sample), and
are a handful of numbers, so scoring is one expression.

Site level: a host is a source, a path is a language section of it. Grouped aggregation over
all documents gives each host and path its labelled positives and its classifier evidence
(sums of document probabilities, an unlabelled document counting ``SOFT`` of a labelled one).
A host's posterior rate shrinks towards the global rate, a path's towards its host's, with
prior strengths estimated from the spread of the rates (method of moments), so sparse sites
stay near their parents. A document's log odds are its own plus the log odds of its path
relative to the global ones; it is rejected if either probability reaches ``REJECT_AT``.

Defined results: a null text is empty; null sources and languages are sites of their own;
labels with a null value are ignored, repeated labels of a document are averaged; where a
label has fewer than ``MIN_POSITIVE`` documents of either class its model is left out
(probability 0, nothing rejected by it); empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepline.llm.common import WORD, cut, small_batches
from prepline.session import cut_round

SAMPLE_ROWS = 20_000
LEXICON_WORDS = 100
MIN_POSITIVE = 3
SOFT = 0.1
REJECT_AT = 0.5
PREFIX = 4
#: sites up to this many rows are broadcast (their number is checked); more are shuffled
BROADCAST_SITES = 50_000
TARGETS = ("poor", "toxic")
_WORDS = re.compile(WORD)
#: between words: white space and punctuation
_BREAK = re.compile(r"[\x20\x09-\x0D#*$%&|<>!?.,;:\"'()\[\]{}]+")
_BLANKS = " \t\n\x0b\x0c\r"


def tokens_of(text: str) -> set[str]:
    """Distinct lower-case words, and the first letters of longer words marked ^."""
    words = set(_BREAK.split(text.lower()))
    return words | {"^" + w[:PREFIX] for w in words if len(w) > PREFIX}


def dense_of(text: str) -> list[float]:
    words = _WORDS.findall(text)
    n = max(1, len(words))
    ink = max(1, len(text) - sum(map(text.count, _BLANKS)))
    count = lambda chars: sum(map(text.count, chars))
    return [
        math.sqrt(count("#*$%&<>=^~@\\") / ink),
        math.sqrt(count("|") / ink),
        math.sqrt(count("!") / ink),
        count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / ink,
        math.sqrt(count("0123456789") / ink),
        math.sqrt(sum(map(eq, words, words[1:])) / n),
        len(set(words)) / n,
        math.log1p(len(words)),
        min(30.0, ink / n),
        math.log1p(n / (text.count("\n") + 1)),
        count(".,;") / n,
    ]


def inputs_udf(lexicons: dict[str, dict[str, float]]):
    """text -> the dense features and, per target, log(1 + sum of the odds of the lexicon's tokens
    in the document)."""
    books = [lexicons.get(t, {}) for t in TARGETS]

    def inputs(texts: pd.Series) -> pd.Series:
        def one(t: object) -> list[float]:
            t = t if isinstance(t, str) else ""
            tokens = tokens_of(t) if any(books) else set()
            return dense_of(t) + [math.log1p(sum(b[w] for w in tokens & b.keys())) for b in books]

        return pd.Series([one(t) for t in texts], dtype=object)

    return F.pandas_udf(inputs, "array<double>")


def tokens_udf():
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(tokens_of(t)) if isinstance(t, str) else [])

    return F.pandas_udf(tokens, "array<string>")


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled documents: doc_id, text, quality, toxic (in 0..1)."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")


def lexicon(tokens: DataFrame, target: str, pos: int, neg: int) -> dict[str, float]:
    """Tokens (token, target 0/1) that stand out among positives: token -> shrunk log odds."""
    c = tokens.groupBy("token").agg(F.sum(target).alias("p"), F.count(F.lit(1)).alias("n"))
    # the prior is worth two documents at the base rate; a token must carry its odds by itself
    p = (F.col("p") + 2.0 * pos / (pos + neg)) / (F.col("n") + 2.0)
    odds = F.log(p / (1 - p)) - math.log(pos / neg)
    z = (F.col("p") - F.col("n") * pos / (pos + neg)) / F.sqrt(F.col("n") * pos * neg / float(pos + neg) ** 2)
    often = c.where(F.col("p") >= max(3, pos // 200)).withColumns({"odds": odds, "z": z}).where("z > 6 and odds > 2")
    top = often.orderBy(F.desc("z"), "token").limit(LEXICON_WORDS)
    return {r["token"]: float(r["odds"]) for r in top.select("token", "odds").collect()}


class Model:
    """The fitted document classifier: lexicons, and coefficients and intercept per target."""

    def __init__(self, lexicons: dict[str, dict[str, float]], weights: dict[str, tuple[list[float], float]]) -> None:
        self.lexicons, self.weights = lexicons, weights

    def score(self, df: DataFrame) -> DataFrame:
        """df with all its columns and own_<target>: a document's log odds."""
        df = df.withColumn("_x", inputs_udf(self.lexicons)(F.col("text").cast("string")))
        own = {}
        for t, (w, b) in self.weights.items():
            dot = F.lit(b)
            for k, c in enumerate(w):
                dot = dot + F.get("_x", F.lit(k)) * F.lit(c)
            own[f"own_{t}"] = dot
        return df.withColumns(own).drop("_x")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 100) -> tuple[list[float], float]:
    """Ridge logistic regression by Newton's method on standardised inputs."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge * len(x))
    penalty[-1] = 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        curve = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
        change = np.linalg.solve(curve, z.T @ (y - p) - penalty * w)
        change *= min(1.0, 5.0 / max(1e-12, np.abs(change).max()))
        w += change
        if np.abs(change).max() < 1e-6:
            break
    return [float(v) for v in w[:-1] / scale], float(w[-1] - (w[:-1] * mean / scale).sum())


def fit(labelled: DataFrame) -> Model:
    """labelled (doc_id, text, quality, toxic) -> the document classifier."""
    rows = cut(
        labelled.select(
            "text",
            F.when(F.col("quality").isNotNull(), (F.col("quality") < 0.5).cast("int")).alias("poor"),
            F.when(F.col("toxic").isNotNull(), (F.col("toxic") >= 0.5).cast("int")).alias("toxic"),
        )
    )
    lexicons: dict[str, dict[str, float]] = {}
    tokens = rows.select(*TARGETS, F.explode(tokens_udf()("text")).alias("token"))
    for t in TARGETS:
        got = {r[0]: r[1] for r in rows.where(F.col(t).isNotNull()).groupBy(t).count().collect()}
        if min(got.get(0, 0), got.get(1, 0)) >= MIN_POSITIVE:
            lexicons[t] = lexicon(tokens.where(F.col(t).isNotNull()).select(t, "token"), t, got[1], got[0])
    # at most SAMPLE_ROWS rows of a dozen numbers
    got = rows.select(*TARGETS, inputs_udf(lexicons)("text").alias("_x")).toPandas()
    weights = {}
    for t in lexicons:
        known = got[t].notna().to_numpy()
        weights[t] = logistic(np.array(got["_x"][known].tolist()), got[t][known].to_numpy(dtype=float))
    return Model(lexicons, weights)


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def site_posteriors(scored: DataFrame, target: str) -> DataFrame:
    """scored (source, lang, labelled 0/1/null, p) -> per (source, lang) the log odds of the path's
    posterior rate relative to the global rate, column ``shift_<target>``."""
    y = F.col(f"y_{target}")
    weight = F.when(y.isNotNull(), F.lit(1.0)).otherwise(F.lit(SOFT))
    path = scored.groupBy("source", "lang").agg(
        F.sum(weight).alias("n"), F.sum(weight * F.coalesce(y.cast("double"), F.col(f"p_{target}"))).alias("k")
    )
    path = cut(path)
    host = path.groupBy("source").agg(F.sum("n").alias("hn"), F.sum("k").alias("hk"))

    def strength(n: str, k: str):
        """Prior strength in documents: m(1-m) / variance between sites - 1, the variance less
        what sampling makes; evidence of sites only, one aggregated row."""
        m = F.sum(k) / F.sum(n)
        r = F.col(k) / F.col(n)
        return m, F.sum(n), F.sum(F.col(n) * r * r) / F.sum(n) - m * m, F.count(F.lit(1))

    def prior(sites: DataFrame, n: str, k: str) -> tuple[float, float]:
        m, total, var, count = sites.agg(*strength(n, k)).first()
        if not total:
            return 0.5, 1e6
        noise = m * (1 - m) * count / total
        between = (var or 0.0) - noise
        return m, min(1e6, max(2.0, m * (1 - m) / between - 1)) if between > 1e-12 else 1e6

    m, a = prior(host, "hn", "hk")
    _, b = prior(path, "n", "k")
    host = host.withColumn("rate", (F.col("hk") + a * m) / (F.col("hn") + a)).select(F.col("source").alias("hs"), "rate")
    post = path.join(host, F.col("source").eqNullSafe(F.col("hs"))).withColumn("post", (F.col("k") + b * F.col("rate")) / (F.col("n") + b))
    return post.select("source", "lang", (_logit(F.col("post")) - _logit(F.lit(float(m)))).alias(f"shift_{target}"))


def _p(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def sites_of(scored: DataFrame, labels: DataFrame, targets: list[str]) -> DataFrame:
    """The shift of every path (source, lang), from the scores of all documents and the labels."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(
        (F.avg("quality") < 0.5).cast("int").alias("y_poor"), (F.avg("toxic") >= 0.5).cast("int").alias("y_toxic")
    )
    evidence = scored.withColumns({f"p_{t}": _p(F.col(f"own_{t}")) for t in targets}).join(known, "doc_id", "left")
    sites = None
    for t in targets:
        s = site_posteriors(evidence, t)
        sites = s if sites is None else sites.join(
            s.withColumnsRenamed({"source": "s2", "lang": "l2"}),
            F.col("source").eqNullSafe(F.col("s2")) & F.col("lang").eqNullSafe(F.col("l2")),
        ).drop("s2", "l2")
    return cut(sites.withColumnsRenamed({"source": "_site_source", "lang": "_site_lang"}))


def decide(scored: DataFrame, sites: DataFrame | None, targets: list[str]) -> DataFrame:
    """scored rows -> p_poor, p_toxic and kept in place of the own log odds."""
    out = scored
    if sites is not None:
        if sites.count() <= BROADCAST_SITES:
            sites = F.broadcast(sites)
        same = F.col("source").cast("string").eqNullSafe(F.col("_site_source")) & F.col("lang").cast("string").eqNullSafe(F.col("_site_lang"))
        out = out.join(sites, same, "left").withColumns(
            {f"p_{t}": _p(F.col(f"own_{t}") + F.coalesce(F.col(f"shift_{t}"), F.lit(0.0))) for t in targets}
        )
        out = out.drop("_site_source", "_site_lang", *[f"own_{t}" for t in targets], *[f"shift_{t}" for t in targets])
    out = out.withColumns({f"p_{t}": F.lit(0.0) for t in TARGETS if t not in targets})
    return out.withColumn("kept", (F.col("p_poor") < REJECT_AT) & (F.col("p_toxic") < REJECT_AT))


def classify(docs: DataFrame, labels: DataFrame, with_text: bool = True) -> DataFrame:
    """docs -> doc_id, source, lang, p_poor, p_toxic, kept; with_text: all columns of docs and the
    last three, for which docs are written once with their scores (Parquet in the checkpoint folder)
    instead of being scored again or shuffled."""
    with small_batches(docs.sparkSession):
        model = fit(sample(docs, labels))
        targets = list(model.weights)
        whole = model.score(docs)
        if with_text and targets:
            whole = cut_round(whole)
        scored = whole.select("doc_id", *[F.col(c).cast("string").alias(c) for c in ("source", "lang")], *[f"own_{t}" for t in targets])
        if not with_text:
            scored = cut(scored)
    sites = sites_of(scored, labels, targets) if targets else None
    return decide(whole if with_text else scored, sites, targets)


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    from prepline.llm.common import table

    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return classify(d, table(spark, sf_dir, "labels"), with_text=False).select("doc_id", "p_poor", "p_toxic", "kept")
