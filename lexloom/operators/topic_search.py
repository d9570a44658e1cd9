"""Search for a number of topics: a model for each, and how good it is by measures of its own."""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.models import fit_topics, topic_shares
from lexloom.operators.resample import uniform
from lexloom.scratch import Scratch


def hold_out_words(vectors: DataFrame, keys: list[str], docs_share: float = 0.1, words_share: float = 0.5, seed: str = "s") -> DataFrame:
    """``vectors`` (keys, counts) with a column ``held``: of a share of the documents a share of the tokens goes from
    ``counts`` to ``held``, which is null for the others. Both are chosen by hashes of the keys."""
    from pyspark.ml.linalg import SparseVector, VectorUDT
    from pyspark.sql.types import StructField, StructType

    def split(counts, number):
        n = counts.values.astype(np.int64)
        held = np.random.Generator(np.random.PCG64(number & (2**63 - 1))).multivariate_hypergeometric(n, int(n.sum() * words_share))
        parts = []
        for part in (n - held, held):
            some = np.flatnonzero(part)
            parts.append(SparseVector(counts.size, counts.indices[some], part[some].astype(float)))
        return tuple(parts)

    named = [F.col(k).cast("string") for k in keys]
    chosen = uniform(F.lit(seed), *named) < docs_share
    parts = F.udf(split, StructType([StructField("counts", VectorUDT()), StructField("held", VectorUDT())]))
    kept = vectors.where(~chosen).select(*keys, "counts", F.lit(None).cast(VectorUDT()).alias("held"))
    return kept.unionByName(vectors.where(chosen).withColumn("_parts", parts("counts", F.xxhash64(F.lit(seed), *named))).select(*keys, "_parts.counts", "_parts.held"))


def topic_words(model) -> np.ndarray:
    """Topics by words: the probability of each word in each topic."""
    weights = model.topicsMatrix().toArray().T
    return weights / weights.sum(axis=1, keepdims=True)


def _shares_of_rank(values: np.ndarray) -> np.ndarray:
    """Average-tie ranks of the columns, over their length."""
    out = np.empty(values.shape)
    for j in range(values.shape[1]):
        _, place, n = np.unique(values[:, j], return_inverse=True, return_counts=True)
        out[:, j] = (np.cumsum(n) - (n - 1) / 2)[place]
    return out / len(values)


def most_likely(beta: np.ndarray, top: int) -> np.ndarray:
    """Topics by rank: the places of the ``top`` most likely words, ties by place."""
    return np.argsort(-beta, axis=1, kind="stable")[:, :top]


def exclusivity(beta: np.ndarray, top: int = 10, weight: float = 0.7) -> np.ndarray:
    """Per topic, the sum over its most likely words of the weighted harmonic mean of two shares of rank: of a word's
    exclusiveness to the topic (with ``weight``) and of its frequency in it."""
    words = beta.T
    frex = 1 / (weight / _shares_of_rank(words / words.sum(axis=1, keepdims=True)) + (1 - weight) / _shares_of_rank(words))
    return np.array([frex[best, t].sum() for t, best in enumerate(most_likely(beta, top))])


#: Words at least this probable in a topic are taken one by one where all words are summed up; there are topics / LEAST at most.
LEAST = 1e-3


class AllWords:
    """Sums over all words for the shares of topics in a document, without a step for each word: ``beta`` is topics by words."""

    def __init__(self, beta: np.ndarray):
        k, peak = len(beta), beta.max(axis=0, initial=0.0)
        order = np.argsort(-peak, kind="stable")
        self.peak, self.beta = peak[order], np.ascontiguousarray(beta[:, order])
        self.likely = int(np.searchsorted(-self.peak, -LEAST, side="right"))
        self.powers = np.zeros(k), np.zeros((k, k)), np.zeros((k * k, k))
        for at in range(self.likely, beta.shape[1], 10_000):
            part = self.beta[:, at : at + 10_000]
            pairs = (part[:, None] * part[None]).reshape(k * k, -1)
            for total, more in zip(self.powers, (part.sum(axis=1), part @ part.T, pairs @ part.T)):
                total += more

    def odds(self, theta: np.ndarray) -> float:
        """The sum of q / (1 - q), q = theta @ beta: q + q^2 + q^3 for the unlikely words, which is off by less than q * LEAST^3."""
        q = theta @ self.beta[:, : self.likely]
        one, two, three = self.powers
        return float((q / (1 - q)).sum() + theta @ one + theta @ two @ theta + np.outer(theta, theta).ravel() @ three @ theta)

    def expected(self, theta: np.ndarray, m: float, tol: float) -> int:
        """For how many words m * q is over ``tol``: only those with a topic in which they are as likely can be."""
        upto = int(np.searchsorted(-self.peak, -tol / m * (1 - 1e-9), side="left"))
        return int((theta @ self.beta[:, :upto] * m > tol).sum())


def diagnostics(model, vectors: DataFrame, top: int = 10, weight: float = 0.7, tol: float = 0.01) -> dict[str, float | None]:
    """Of a model and the documents (counts, held) that it was fitted on:

    exclusivity: mean over topics; coherence: mean over topics of the sum over pairs of the most likely words of
    log((documents with both + 0.01) / (documents with the likelier one + 0.01)); held_out: mean over documents of the
    mean log probability of their held-out tokens; residual: dispersion of the counts around their expectation
    (a sum of squared adjusted residuals over the degrees of freedom; null where there are none).

    One pass over the documents: tasks return sums, of which there are topics x top x top and five more. A document takes time
    by its own words and tokens, not by the number of all words."""
    spark = vectors.sparkSession
    beta = topic_words(model)
    topics, size = beta.shape
    best = most_likely(beta, top)
    shared = spark.sparkContext.broadcast((beta, best, AllWords(beta)))  # as large as the model, which the driver holds anyway

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        beta, best, every = shared.value
        both, total = np.zeros((topics, best.shape[1], best.shape[1])), np.zeros(5)
        for pdf in batches:
            for words, counts, held, held_counts, theta in zip(pdf["words"], pdf["n"], pdf["held"], pdf["held_n"], pdf["theta"]):
                if words is not None and len(words):
                    words, n = np.asarray(words), np.asarray(counts)
                    has = np.isin(best, words).astype(float)
                    both += has[:, :, None] * has[:, None, :]
                    theta, m = np.asarray(theta), n.sum()
                    at = theta @ beta[:, words]
                    total += [((n**2 - 2 * n * at * m) / (m * at * (1 - at))).sum() + m * every.odds(theta), every.expected(theta, m, tol), 1, 0, 0]
                if held is not None and len(held):
                    k = np.asarray(held_counts)
                    total += [0, 0, 0, (k * np.log(np.asarray(theta) @ beta[:, np.asarray(held)])).sum() / k.sum(), 1]
        t, i, j = np.nonzero(both)
        yield pd.DataFrame({"t": np.r_[t, [-1] * 5], "i": np.r_[i, range(5)], "j": np.r_[j, [0] * 5], "value": np.r_[both[t, i, j], total]})

    seen, held = F.unwrap_udt("counts"), F.unwrap_udt("held")
    docs = model.transform(vectors).select(seen["indices"].alias("words"), seen["values"].alias("n"), held["indices"].alias("held"), held["values"].alias("held_n"), topic_shares().alias("theta"))
    cells = docs.mapInPandas(sums, "t long, i long, j long, value double").groupBy("t", "i", "j").agg(F.sum("value").alias("value")).collect()
    shared.unpersist()
    both, total = np.zeros((topics, best.shape[1], best.shape[1])), np.zeros(5)
    for r in cells:
        if r["t"] < 0:
            total[r["i"]] = r["value"]
        else:
            both[r["t"], r["i"], r["j"]] = r["value"]
    i, j = np.tril_indices(best.shape[1], -1)
    coherence = np.log(both[:, i, j] + 0.01) - np.log(both[:, j, j] + 0.01)
    free = total[1] - size - (total[2] * (topics - 1) + topics * (size - 1))
    return {
        "exclusivity": float(exclusivity(beta, top, weight).mean()),
        "coherence": float(coherence.sum(axis=1).mean()),
        "held_out": float(total[3] / total[4]) if total[4] else None,
        "residual": float(total[0] / free) if free else None,
    }


def search_k(vectors: DataFrame, keys: list[str], ks: list[int], runs: int = 1, docs_share: float = 0.1, words_share: float = 0.5, top: int = 10, iters: int = 200) -> DataFrame:
    """A row per number of topics and run (which has its own held-out tokens and start): k, run, the diagnostics, bound
    (the variational bound of the documents' log likelihood), lbound (with the logarithm of k! added, for the topics may
    be in any order) and iterations. Fits are made one after the other, each over the whole cluster."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "search-k")
    out = []
    for run in range(1, runs + 1):
        train = scratch.put(hold_out_words(vectors, keys, docs_share, words_share, f"s{run}"), f"train-{run}")
        for k in ks:
            model = fit_topics(train, k, iters, seed=run)
            d = diagnostics(model, train, top)
            bound = float(model.logLikelihood(train))
            out.append((k, run, *(d[x] for x in ("exclusivity", "coherence", "held_out", "residual")), bound, bound + lgamma(k + 1), model.iterations))
        scratch.drop(f"train-{run}")
    return spark.createDataFrame(out, "k int, run int, exclusivity double, coherence double, held_out double, residual double, bound double, lbound double, iterations int")
