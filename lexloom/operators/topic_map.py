"""What a topic map shows: scored and relevant words of topics, salience of words, distances of topics and their places on a
plane, and all of it as one JSON.

A word is a row with an array that has a number for each topic, so everything but ranks is an expression in the row, or one
aggregation over the rows. The driver gets topics x topics numbers and the words that are shown.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions.stats import value_ranks

#: Fixed value: what keeps logarithms of shares finite in scores.
_LEAST = 1e-5


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def _literals(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def topic_counts(tokens: DataFrame, topic: str, word: str, topics: list) -> DataFrame:
    """(word, n): how often each word stands in each of the ``topics``."""
    return tokens.groupBy(F.col(word).alias("word")).agg(F.array(*(F.sum(F.when(F.col(topic).eqNullSafe(F.lit(t)), 1).otherwise(0)) for t in topics)).alias("n"))


def topic_totals(counts: DataFrame, k: int) -> tuple[list[float], int]:
    """(tokens of each topic, number of words): one row."""
    r = counts.agg(*(F.sum(F.col("n")[i]) for i in range(k)), F.count("*")).first()
    return [float(x or 0) for x in r[:-1]], r[-1]


def word_shares(counts: DataFrame, k: int, prior: float = 0.1) -> DataFrame:
    """(word, n, p): a word's share of each topic's tokens, with ``prior`` added to every count."""
    totals, size = topic_totals(counts, k)
    return counts.select("word", "n", F.zip_with("n", _literals(t + prior * size for t in totals), lambda n, t: (n + prior) / t).alias("p"))


def topic_scores(counts: DataFrame, k: int) -> DataFrame:
    """(word, n, score): p * (log p - mean of log p over the topics), with p a word's share of the topic's tokens. A word that
    is as frequent in all topics scores 0."""
    totals, _ = topic_totals(counts, k)
    p = F.zip_with("n", _literals(t + _LEAST for t in totals), lambda n, t: n / t)
    logs = counts.select("word", "n", p.alias("p")).withColumn("l", F.transform("p", lambda x: F.log(x + _LEAST)))
    mean = _total(F.col("l")) / k
    return logs.select("word", "n", F.zip_with("p", "l", lambda x, y: x * (y - mean)).alias("score"))


def top_words(scored: DataFrame, column: str, n: int = 10) -> DataFrame:
    """(topic, rank, word, value): the ``n`` words with the largest value in each topic, ties by word."""
    each = scored.select("word", F.posexplode(column).alias("topic", "value")).where("value IS NOT NULL")
    w = Window.partitionBy("topic").orderBy(F.round("value", 12).desc(), "word")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("topic", "rank", "word", "value")


def topic_labels(counts: DataFrame, k: int, n: int = 7, weight: float = 0.5, prior: float = 0.1) -> DataFrame:
    """(measure, topic, rank, word, value): words that name the topics, by probability, lift (probability over the word's
    share of all tokens), score, and frex, the weighted harmonic mean of a word's ranks by exclusiveness (with ``weight``) and
    by frequency in the topic, as shares of the number of words."""
    totals, size = topic_totals(counts, k)
    shares = word_shares(counts, k, prior)
    own = _total(F.col("n")) / F.lit(max(1.0, sum(totals)))
    lift = shares.withColumn("lift", F.transform("p", lambda x: F.try_divide(x, own)))
    each = shares.select("word", F.posexplode(F.transform("p", lambda x: F.struct(x.alias("p"), (x / _total(F.col("p"))).alias("e")))).alias("topic", "v"))
    each = each.select("word", "topic", F.round("v.e", 12).alias("e"), F.round("v.p", 12).alias("p"))
    for c in ("e", "p"):  # a topic's words are not ranked in one task
        ranks = value_ranks(each, ["topic"], c).select(F.col("topic").alias("_t"), F.col(c).alias("_c"), (F.col("rank") / size).alias(f"rank_{c}"))
        each = each.join(ranks, (F.col("topic") == F.col("_t")) & F.col(c).eqNullSafe(F.col("_c"))).drop("_t", "_c")
    frex = each.select("word", "topic", (1 / (weight / F.col("rank_e") + (1 - weight) / F.col("rank_p"))).alias("value"))
    w = Window.partitionBy("topic").orderBy(F.round("value", 12).desc(), "word")
    frex = frex.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    parts = {"probability": top_words(shares, "p", n), "lift": top_words(lift, "lift", n), "score": top_words(topic_scores(counts, k), "score", n), "frex": frex}
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("measure"), "topic", "rank", "word", "value")
        out = part if out is None else out.union(part)
    return out


def saliency(shares: DataFrame, proportions: list[float]) -> DataFrame:
    """(word, p_word, distinctiveness, saliency): how much a word says about the topic, in nats (the divergence of the topics
    given the word from the topics), and that times the word's share of all tokens. proportions: the topics' shares."""
    joint = shares.select("word", F.zip_with("p", _literals(proportions), lambda p, s: p * s).alias("j")).withColumn("p_word", _total(F.col("j")))
    part = F.zip_with("j", _literals(proportions), lambda j, s: F.when(j > 0, j / F.col("p_word") * F.log(j / F.col("p_word") / s)).otherwise(0.0))
    out = joint.select("word", "p_word", _total(part).alias("distinctiveness"))
    return out.withColumn("saliency", F.col("p_word") * F.col("distinctiveness"))


def relevance(shares: DataFrame, proportions: list[float], weights: list[float], n: int = 30) -> DataFrame:
    """(weight, topic, rank, word, value): for each weight the ``n`` most relevant words of each topic, by
    weight * log p + (1 - weight) * log(p / p_word)."""
    p_word = _total(F.zip_with("p", _literals(proportions), lambda p, s: p * s))
    each = shares.select("word", p_word.alias("_pw"), F.posexplode("p").alias("topic", "_p")).where("_p > 0")
    each = each.withColumn("weight", F.explode(_literals(weights)))
    value = F.col("weight") * F.log("_p") + (1 - F.col("weight")) * F.log(F.col("_p") / F.col("_pw"))
    each = each.select("weight", "topic", "word", value.alias("value"))
    w = Window.partitionBy("weight", "topic").orderBy(F.round("value", 12).desc(), "word")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("weight", "topic", "rank", "word", "value")


def topic_distances(shares: DataFrame, k: int) -> DataFrame:
    """(a, b, distance) for topics a < b: the Jensen-Shannon divergence of their words, all pairs in one aggregation."""
    half = lambda x, m: F.when(x > 0, x * F.log(x / m) / 2).otherwise(0.0)
    sums, names = [], []
    for a in range(k):
        for b in range(a + 1, k):
            x, y = F.col("p")[a], F.col("p")[b]
            sums.append(F.sum(half(x, (x + y) / 2) + half(y, (x + y) / 2)))
            names.append((a, b))
    if not sums:
        return shares.select(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0.0).alias("distance")).where("1 = 0")
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), s.alias("distance")) for (a, b), s in zip(names, sums)))
    return shares.agg(rows.alias("r")).select(F.explode("r").alias("r")).select("r.a", "r.b", "r.distance")


def classical_scaling(distances: np.ndarray, dims: int = 2) -> np.ndarray:
    """Points whose distances are close to the given ones: the leading eigenvectors of the doubly centred squares, each with
    its largest entry positive."""
    n = len(distances)
    centre = np.eye(n) - np.full((n, n), 1 / n)
    values, vectors = np.linalg.eigh(-0.5 * centre @ distances**2 @ centre)
    order = np.argsort(-values, kind="stable")[:dims]
    out = np.zeros((n, dims))
    for i, o in enumerate(order):
        v = vectors[:, o]
        out[:, i] = v * np.sign(v[np.abs(v).argmax()]) * np.sqrt(max(0.0, values[o]))
    return out


def proportions(loadings: DataFrame, lengths: DataFrame, keys: list[str], k: int) -> list[float]:
    """The topics' shares of all tokens: loadings (keys, topic, loading) weighted by the documents' lengths (keys, length)."""
    found = {r[0]: r[1] for r in loadings.join(lengths, keys).groupBy("topic").agg(F.sum(F.col("loading") * F.col("length"))).collect()}
    total = sum(found.values()) or 1.0
    return [found.get(i, 0.0) / total for i in range(k)]


def map_terms(shares: DataFrame, shares_of_topics: list[float], tokens: float, weights: list[float], n: int = 30) -> DataFrame:
    """(category, word, freq, total, logprob, loglift): the ``n`` most salient words ("Default", with their places counted
    down in the last two columns), and for each topic ("Topic1", ...) the words that are among the ``n`` most relevant for one
    of the weights. freq: expected tokens of the word in the topic; total: in all. Topics are numbered as they come."""
    k = len(shares_of_topics)
    amount = F.zip_with("p", _literals(shares_of_topics), lambda p, s: p * s * tokens)
    base = shares.select("word", "p", amount.alias("f")).withColumn("total", _total(F.col("f")))
    salient = saliency(shares, shares_of_topics).orderBy(F.round("saliency", 12).desc(), "word").limit(n)
    place = F.row_number().over(Window.orderBy(F.round("saliency", 12).desc(), "word"))  # n rows
    salient = salient.select("word", (n + 1 - place).cast("double").alias("place")).join(base, "word")
    first = salient.select(F.lit("Default").alias("category"), "word", F.col("total").alias("freq"), "total", F.col("place").alias("logprob"), F.col("place").alias("loglift"))
    shown = relevance(shares, shares_of_topics, weights, n).select("topic", "word").distinct()
    rest = base.select("word", "total", F.posexplode(F.arrays_zip("p", "f")).alias("topic", "v")).join(F.broadcast(shown) if len(weights) * n * k <= 100_000 else shown, ["topic", "word"])
    lift = F.log(F.col("v.p") / (F.col("total") / tokens))
    rest = rest.select(F.concat(F.lit("Topic"), F.col("topic") + 1).alias("category"), "word", F.col("v.f").alias("freq"), "total", F.log("v.p").alias("logprob"), lift.alias("loglift"))
    return first.union(rest)


def topic_map(shares: DataFrame, shares_of_topics: list[float], tokens: float, n: int = 30, step: float = 0.01) -> str:
    """One JSON with what an interactive map of topics shows: mdsDat (place, number and share of each topic, by falling share),
    tinfo (the words shown, see ``map_terms``), token.table (the topics' shares of each of these words), R, lambda.step,
    plot.opts and topic.order (numbers of the topics before they were sorted, from 1)."""
    k = len(shares_of_topics)
    order = sorted(range(k), key=lambda i: (-shares_of_topics[i], i))
    sorted_shares = [shares_of_topics[i] for i in order]
    ordered = shares.select("word", F.array(*(F.col("p")[i] for i in order)).alias("p"))
    far = np.zeros((k, k))
    for r in topic_distances(ordered, k).collect():
        far[r["a"], r["b"]] = far[r["b"], r["a"]] = r["distance"]
    at = classical_scaling(far)
    weights = [round(i * step, 10) for i in range(round(1 / step) + 1)]
    terms = map_terms(ordered, sorted_shares, tokens, weights, n).orderBy(F.when(F.col("category") == "Default", 0).otherwise(F.substring("category", 6, 9).try_cast("int")), F.col("freq").desc(), "word").collect()
    words = sorted({r["word"] for r in terms})
    one = shares.sparkSession.createDataFrame([(w,) for w in words], "word string")  # the words that are shown
    cells = ordered.join(F.broadcast(one), "word").select("word", F.zip_with("p", _literals(sorted_shares), lambda p, s: p * s).alias("j")).orderBy("word").collect()
    table = [(r["word"], i + 1, x / sum(r["j"])) for r in cells for i, x in enumerate(r["j"]) if x / sum(r["j"]) * 1000 >= 0.5]
    return json.dumps(
        {
            "mdsDat": {"x": at[:, 0].tolist(), "y": at[:, 1].tolist(), "topics": list(range(1, k + 1)), "cluster": [1] * k, "Freq": [100 * s for s in sorted_shares]},
            "tinfo": {"Term": [r["word"] for r in terms], **{c.capitalize() if c in ("category", "freq", "total") else c: [r[c] for r in terms] for c in ("freq", "total", "category", "logprob", "loglift")}},
            "token.table": {"Term": [x[0] for x in table], "Topic": [x[1] for x in table], "Freq": [x[2] for x in table]},
            "R": n, "lambda.step": step, "plot.opts": {"xlab": "PC1", "ylab": "PC2"}, "topic.order": [i + 1 for i in order],
        }
    )
