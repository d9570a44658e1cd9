"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

1. A logistic model over simple measures and hashed words is fitted on a bounded sample of labelled documents, both
   classes weighing the same. It gives each document the evidence for "good" as a log likelihood ratio.
2. Grouped aggregation adds up, for each host and each path of a host, the labelled outcomes and, for documents
   without a label, the classifier's probability. A path's posterior shrinks to its host's, a host's to the global
   rate; the strength of each prior comes from how much the groups differ.
3. A document's posterior odds are its evidence times the odds of its path's posterior. What the document itself put
   into its path is taken out again first, so that no evidence counts twice.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kit import SPACE, Block, Scratch, _table, bounded_sample, quoted, span_hashes, text_blocks

_BITS = 20
_UPPER = _table(bytes(range(65, 91)))
_LETTER = _table(bytes([*range(65, 91), *range(97, 123)]))
_DIGIT = _table(bytes(range(48, 58)))
_STOP = _table(b".,;:!?")
_SYMBOL = _table(b"#*$%&|<>{}[]\\^~=_+@/")


def measures(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each text: dense measures, and the distinct hashed words (lower-cased, without punctuation at the ends)."""
    block = Block(column, lower=False)
    starts, ends = block.words()
    first, last = block.ranges(starts)
    n_words = np.maximum(last - first, 1)
    size = np.maximum(block.end - block.start, 1)
    letters = np.maximum(block.per_text(_LETTER[block.data]), 1)
    lower = Block(column, lower=True)
    # punctuation and symbols at the end of a word are not part of it, unless it has nothing else
    solid = np.maximum.accumulate(np.where((_STOP | _SYMBOL)[lower.data], -1, np.arange(len(lower.data))))
    tail = np.maximum(starts + 1, solid[ends - 1] + 1) if len(ends) else ends
    hashed = (span_hashes(lower.data, starts, tail) >> np.uint64(64 - _BITS)).astype(np.int64)
    owner = block.owner(starts)
    keys = np.unique(owner << _BITS | hashed)
    at = np.searchsorted(keys, np.arange(len(block) + 1) << _BITS)
    words = [keys[a:b] & ((1 << _BITS) - 1) for a, b in zip(at, at[1:])]
    same = np.zeros(len(starts), bool)
    if len(starts) > 1:
        same[1:] = (hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1])
    repeats = np.concatenate(([0], np.cumsum(same)))
    dense = np.stack(
        [
            np.log1p(last - first), block.per_text(_SYMBOL[block.data]) / n_words, block.per_text(_UPPER[block.data]) / letters, block.per_text(_DIGIT[block.data]) / size,
            block.per_text(_STOP[block.data]) / n_words, (size - block.per_text(SPACE[block.data])) / n_words / 10, np.array([len(w) for w in words]) / n_words,
            (repeats[last] - repeats[first]) / n_words, block.per_text(block.data == 10) / n_words,
        ],
        axis=1,
    )
    return dense, words


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    dense: np.ndarray
    words: np.ndarray
    bias: float
    lexicon: np.ndarray

    def logits(self, dense: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
        dense = np.column_stack((dense, worst_word(self.lexicon, words)))
        row = np.repeat(np.arange(len(words)), [len(w) for w in words])
        flat = np.concatenate(words) if words else np.empty(0, np.int64)
        total = np.bincount(row, self.words[flat], len(words)) / np.sqrt(np.maximum([len(w) for w in words], 1)) if len(flat) else np.zeros(len(words))
        return np.clip(np.clip((dense - self.mean) / self.scale, -5, 5) @ self.dense + total + self.bias, -12, 12)


def bad_lexicon(words: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """For each hashed word a cautious log ratio of its shares in bad and in good documents, 0 at least: what is in
    few bad documents says little."""
    row = np.repeat(good, [len(w) for w in words])
    flat = np.concatenate(words) if words else np.empty(0, np.int64)
    bad_n, good_n = (np.bincount(flat[row == on], minlength=1 << _BITS) for on in (False, True))
    low = np.maximum(bad_n - 1.5 * np.sqrt(bad_n), 0)
    return np.maximum(0, np.log((low + 0.5) / (max(1, (~good).sum()) + 1)) - np.log((good_n + 0.5) / (max(1, good.sum()) + 1)))


def worst_word(lexicon: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    return np.array([lexicon[w].max() if len(w) else 0.0 for w in words])


def fit_logistic(dense: np.ndarray, words: list[np.ndarray], good: np.ndarray, steps: int = 500, rate: float = 0.1, decay: float = 2e-4) -> Logistic:
    """Full-batch Adam on the driver, classes weighted alike. The steps are a fixed number: the loss is flat long before rare
    bad words have their weights, so it is no sign to stop at."""
    # the lexicon that a training document is seen with comes from the other half, as for documents never seen
    half = np.arange(len(words)) % 2 == 0
    worst = np.zeros(len(words))
    for side in (half, ~half):
        lexicon = bad_lexicon([w for w, on in zip(words, side) if on], good[side])
        worst[~side] = worst_word(lexicon, [w for w, on in zip(words, side) if not on])
    dense = np.column_stack((dense, worst))
    mean, scale = dense.mean(axis=0), dense.std(axis=0) + 1e-6
    x = np.clip((dense - mean) / scale, -5, 5)
    sizes = np.array([len(w) for w in words])
    row, flat = np.repeat(np.arange(len(words)), sizes), np.concatenate(words)
    # only words of several documents can tell anything
    common = np.bincount(flat, minlength=1 << _BITS)[flat] > 2
    row = row[common]
    known, flat = np.unique(flat[common], return_inverse=True)
    value = (1 / np.sqrt(np.maximum(sizes, 1)))[row]
    y = good.astype(float)
    weight = np.where(good, 0.5 / max(1, good.sum()), 0.5 / max(1, (~good).sum()))
    theta = np.zeros(x.shape[1] + len(known) + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    d = x.shape[1]
    for step in range(1, steps + 1):
        z = x @ theta[:d] + np.bincount(row, theta[d + flat] * value, len(y)) + theta[-1]
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gradient = np.concatenate((x.T @ error, np.bincount(flat, error[row] * value, len(known)), [error.sum()])) + decay * theta * 0.01
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(1 << _BITS, np.float32)
    weights[known] = theta[d:-1]
    return Logistic(mean, scale, theta[:d].copy(), weights, float(theta[-1]), bad_lexicon(words, good).astype(np.float32))


def _strength(groups: DataFrame, least: float = 2.0, most: float = 500.0) -> float:
    """The worth of a level's prior in documents: the variance of shares within groups over that of the groups' rates.
    groups has n, s and q (number, sum and sum of squares of the shares) and prior. Shares may be outcomes or probabilities, so
    their variance is taken from the data."""
    n, s, p = F.col("n"), F.col("s"), F.col("prior")
    r = groups.agg(F.sum(F.col("q") - s * s / n), F.sum(n - 1), F.sum(F.pow(s - n * p, 2)), F.sum(n), F.sum(n.cast("double") * n)).first()
    if not r[1] or not r[4]:
        return most
    within = max(1e-9, r[0] / r[1])
    between = max(1e-9, (r[2] - within * r[3]) / r[4])
    return min(most, max(least, within / between))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, sites: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, sample_per_class: int = 4000, threshold: float = 0.5) -> DataFrame:
    """A row per row of ``docs``: doc_id, host, path, evidence (log likelihood ratio), site_posterior, posterior, kept.

    labels has doc_id and good (boolean). sites may give doc_id, host and path; else, or where it has no row, the
    expressions ``host`` and ``path`` over docs are used. The classifier is fitted on about ``sample_per_class`` labelled
    documents of each class (a sample by hash, with a share that gives 1.2 times as many on average); scores and site
    statistics cover all documents. site_posterior is what the other documents say of the place: a document's own share
    is left out of its path, its host and the rate of all; only the strengths of the priors, two numbers, come from all.

    Defined cases: null and empty texts have no words and are judged by the measures of an empty text; a null host or
    path is a group of its own; null labels don't count, an id labelled twice is good if all its labels are; without
    labels of both classes the evidence is 0 and everything is kept; null ids never have a label; rows with the same
    id are judged each on their own; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    texts = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"), (host if host is not None else F.lit(None)).cast("string").alias("host"), (path if path is not None else F.lit(None)).cast("string").alias("path"))
    truth = scratch.put(labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("good").cast("boolean").alias("good")).where("good is not null and doc_id is not null").groupBy("doc_id").agg(F.min("good").alias("good")), "truth")
    seen = truth.agg(F.count("*"), F.sum(F.col("good").cast("long"))).first()
    known = ((seen[1] or 0) + 1) / (seen[0] + 2)  # the share of good documents among labelled ones
    model = _fit(texts, truth, sample_per_class)
    held = spark.sparkContext.broadcast(model)

    def evidence(batches):
        model = held.value
        for b in text_blocks(batches):
            logits = model.logits(*measures(b.column("text"))) if model else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("host"), b.column("path"), pa.array(logits)], names=["doc_id", "host", "path", "evidence"])

    scored = scratch.put(texts.mapInArrow(evidence, "doc_id long, host string, path string, evidence double"), "scored")
    if sites is not None:
        given = scratch.put(sites.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.struct("host", "path")).alias("site")), "sites")
        scored = scored.join(given, "doc_id", "left").select("doc_id", F.coalesce("site.host", "host").alias("host"), F.when(F.col("site").isNotNull(), F.col("site.path")).otherwise(F.col("path")).alias("path"), "evidence")
    scored = scored.join(truth, "doc_id", "left").select("doc_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "evidence", F.coalesce(F.col("good").cast("double"), 1 / (1 + F.exp(-F.col("evidence") - _logit(F.lit(known))))).alias("share"))
    scored = scratch.put(scored, "shares")

    by_path = scratch.put(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("share").alias("s"), F.sum(F.col("share") * F.col("share")).alias("q")), "paths")
    by_host = by_path.groupBy("host").agg(*(F.sum(x).alias(x) for x in "nsq"))
    total = by_host.agg(F.sum("n"), F.sum("s")).first()
    rate = ((total[1] or 0.0) + 1) / ((total[0] or 0) + 2)
    by_host = by_host.withColumn("prior", F.lit(rate))
    k_host = _strength(by_host)
    hosts = by_host.select("host", ((F.col("s") + k_host * rate) / (F.col("n") + k_host)).alias("prior"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    paths = scratch.put(by_path.join(hosts, "host"), "priors")
    k_path = _strength(paths)
    # the table of sites is joined as a scan, so that a host with very many documents is split
    joined = scored.join(paths, ["host", "path"])
    # what the other documents say, at every level: a document's own share is in none of the three
    others = (F.lit(total[1] or 0.0) - F.col("share") + 1) / F.lit((total[0] or 0) + 1.0)
    others = (F.col("host_s") - F.col("share") + k_host * others) / (F.col("host_n") - 1 + k_host)
    others = (F.col("s") - F.col("share") + k_path * others) / (F.col("n") - 1 + k_path)
    out = joined.withColumn("site_posterior", others)
    odds = F.col("evidence") + _logit(F.col("site_posterior"))
    out = out.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    kept = F.col("posterior") >= threshold if model else F.lit(True)
    scratch.keep("shares", "priors")
    return out.select("doc_id", "host", "path", "evidence", "site_posterior", "posterior", kept.alias("kept"))


def _fit(texts: DataFrame, truth: DataFrame, per_class: int) -> Logistic | None:
    some = bounded_sample(truth, "doc_id", "good", per_class, "quality").select("doc_id", "good")

    def measure(batches):
        for b in text_blocks(batches):
            dense, words = measures(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("good"), pa.array(list(dense), pa.list_(pa.float64())), pa.array([w.astype(np.int32) for w in words], pa.list_(pa.int32()))], names=["good", "dense", "words"])

    rows = texts.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("good", "text").mapInArrow(measure, "good boolean, dense array<double>, words array<int>").toArrow()  # ``some`` has at most 1.2 * 2 * per_class rows
    good = rows.column("good").to_numpy(zero_copy_only=False).astype(bool)
    if len(good) < 10 or good.all() or not good.any():
        return None
    dense = np.array(rows.column("dense").to_pylist())
    return fit_logistic(dense, [np.array(w, np.int64) for w in rows.column("words").to_pylist()], good)
