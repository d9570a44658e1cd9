"""A spectral start for topic models: anchor words of the word co-occurrence matrix, and the topics that follow from them.

The matrix is a table with a row per word, made from sums over documents. Anchors are found greedily: the row that is
farthest from the span of those before it. Every word's row is then a mixture of the anchors' rows; its weights are found
by exponentiated gradient, each word by itself, in tasks.

A pass over the rows for each anchor; the driver holds the anchors' rows, topics x ``most_words`` numbers at most. The
matrix covers the ``most_words`` most frequent words, so a row and the pairs of one document are bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.scratch import Scratch, ship_package

#: Pairs that a task holds before it adds them up.
_PAIRS = 1 << 21


def bag(vectors: DataFrame, *columns) -> DataFrame:
    """``columns``, and the words and counts (w, n) of the documents in ``vectors``."""
    v = F.unwrap_udt("counts")
    return vectors.select(*columns, v["indices"].alias("w"), v["values"].alias("n"))


def word_totals(docs: DataFrame) -> DataFrame:
    """(w, total, docs) of the documents (w, n)."""
    each = docs.select(F.explode(F.arrays_zip("w", "n")).alias("e")).select("e.w", "e.n")
    return each.groupBy("w").agg(F.sum("n").alias("total"), F.count("*").alias("docs"))


def pair_sums(words: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, value) of the pairs i <= j of a document's words, in pieces: the chance that two of its tokens, drawn without
    putting back, are i and j in this order."""
    total = n.sum()
    if total < 2:
        return
    order = np.argsort(words)
    words, n = words[order], n[order]
    step = max(1, _PAIRS // (2 * len(words)))
    for at in range(0, len(words), step):
        a = slice(at, at + step)
        value = np.outer(n[a], n[at:])
        own = np.arange(len(n[a]))
        value[own, own] -= n[a]  # a token isn't its own partner
        i, j = np.triu_indices(len(n[a]), 0, len(n) - at)
        some = value[i, j] > 0
        i, j = i[some], j[some]
        yield words[at + i], words[at + j], value[i, j] / (total * (total - 1))


def cooccurrence(vectors: DataFrame, size: int, most_words: int = 10_000) -> tuple[DataFrame, int]:
    """(rows, their width). Rows (w, p, js, qs) for each word that stands in a document of two tokens: its share p of the
    pairs, and its partners' shares qs at the places js of a row that adds up to 1. Of ``size`` words the ``most_words`` most
    frequent take part (ties: smaller numbers); places are those among the words that do."""
    spark = vectors.sparkSession
    ship_package(spark)
    docs = bag(vectors)
    if size > most_words:
        kept = [r[0] for r in word_totals(docs).orderBy(F.desc("total"), "w").limit(most_words).select("w").collect()]
        words = np.sort(np.array(kept, np.int64))
    else:
        words = np.arange(size)
    width = len(words)

    def pairs(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        pending = 0

        def added(parts):
            code, back = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return code, np.bincount(back, np.concatenate([v for _, v in parts]))

        def rows(code, value):
            for at in range(0, len(code), 1 << 16):
                c = code[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(c // width), pa.array(c % width), pa.array(value[at : at + (1 << 16)])], names=["i", "j", "q"])

        for b in batches:
            for w, n in zip(b.column("w"), b.column("n")):
                w, n = (x.values.to_numpy(zero_copy_only=False) for x in (w, n)) if w.is_valid else (np.empty(0, np.int32), np.empty(0))
                at = np.minimum(np.searchsorted(words, w), max(0, width - 1))
                some = words[at] == w
                for i, j, value in pair_sums(at[some], n[some]):
                    held.append((i * width + j, value))
                    pending += len(value)
                if pending > 2 * _PAIRS:
                    code, value = added(held)
                    held, pending = [(code, value)], len(code)
                    if pending > _PAIRS:
                        yield from rows(code, value)
                        held, pending = [], 0
        if held:
            yield from rows(*added(held))

    scratch = Scratch(spark, "cooccurrence")
    half = scratch.put(docs.mapInArrow(pairs, "i long, j long, q double").groupBy("i", "j").agg(F.sum("q").alias("q")), "pairs")
    both = half.union(half.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "q"))
    total = half.agg(F.sum(F.when(F.col("i") < F.col("j"), 2.0).otherwise(1.0) * F.col("q"))).first()[0] or 1.0
    lists = both.groupBy("i").agg(F.array_sort(F.collect_list(F.struct(F.col("j").cast("int").alias("j"), "q"))).alias("c"), F.sum("q").alias("_p"))
    if size > most_words:
        named = spark.createDataFrame(list(enumerate(words.tolist())), "i long, w int")
        lists = lists.join(F.broadcast(named), "i")  # most_words rows
    else:
        lists = lists.withColumn("w", F.col("i").cast("int"))
    out = scratch.put(lists.select("w", (F.col("_p") / total).alias("p"), F.transform("c", lambda x: x["j"]).alias("js"), F.transform("c", lambda x: x["q"] / F.col("_p")).alias("qs")), "rows")
    scratch.keep("rows")
    return out, width


def _dense(batch: pa.RecordBatch, width: int) -> Iterator[tuple[slice, np.ndarray]]:
    """The rows of a batch as dense pieces of bounded size."""
    step = max(1, _PAIRS // max(1, width))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        out = np.zeros((part.num_rows, width))
        js, qs = part.column("js"), part.column("qs")
        lengths = np.diff(np.asarray(js.offsets))
        out[np.repeat(np.arange(part.num_rows), lengths), js.flatten().to_numpy()] = qs.flatten().to_numpy()
        yield slice(at, at + part.num_rows), out


def find_anchors(rows: DataFrame, k: int, width: int) -> tuple[list[int], np.ndarray]:
    """(words, their rows) of ``k`` anchors, or of fewer if the rows have a smaller rank: each is the row with the longest
    part that is orthogonal to the anchors before it (ties: the smaller number)."""
    basis, words, found = np.zeros((0, width)), [], []
    for _ in range(k):

        def farthest(batches, basis=basis):
            best: tuple[float, int, np.ndarray] | None = None
            for b in batches:
                numbers = b.column("w").to_numpy()
                for at, x in _dense(b, width):
                    x_left = x - (x @ basis.T) @ basis
                    norm = np.einsum("ij,ij->i", x_left, x_left)
                    order = np.lexsort((numbers[at], -norm))[0]
                    if best is None or (-norm[order], numbers[at][order]) < (-best[0], best[1]):
                        best = (float(norm[order]), int(numbers[at][order]), x[order])
            if best is not None:
                some = np.flatnonzero(best[2])
                yield pa.RecordBatch.from_arrays([pa.array([best[1]], pa.int32()), pa.array([best[0]]), pa.array([some.tolist()], pa.list_(pa.int32())), pa.array([best[2][some].tolist()], pa.list_(pa.float64()))], names=["w", "norm", "js", "qs"])

        r = rows.select("w", "js", "qs").mapInArrow(farthest, "w int, norm double, js array<int>, qs array<double>").orderBy(F.desc("norm"), "w").first()
        if r is None or r["norm"] < 1e-12:
            break
        row = np.zeros(width)
        row[r["js"]] = r["qs"]
        left = row - (row @ basis.T) @ basis
        left -= (left @ basis.T) @ basis  # once more, against rounding
        basis = np.vstack([basis, left / np.linalg.norm(left)])
        words.append(r["w"])
        found.append(row)
    return words, np.array(found).reshape(len(words), width)


def mixture(gram: np.ndarray, y: np.ndarray, tol: float = 1e-10, steps: int = 5000) -> np.ndarray:
    """For each row of ``y`` the weights c on the simplex that minimise c gram c - 2 c y, by exponentiated gradient: steps
    that multiply the weights, longer after a success and shorter after a failure, until the gradient leaves no more
    than ``tol`` to gain."""
    c = np.full(y.shape, 1 / y.shape[1])
    size = np.full(len(y), 1.0 / max(1e-12, np.abs(gram).max()))
    value = np.einsum("ij,jk,ik->i", c, gram, c) - 2 * (c * y).sum(axis=1)
    open_ = np.arange(len(y))
    for _ in range(steps):
        x = c[open_]
        slope = 2 * (x @ gram - y[open_])
        gap = (x * slope).sum(axis=1) - slope.min(axis=1)
        go = gap > tol
        open_, x, slope = open_[go], x[go], slope[go]
        if not len(open_):
            break
        ahead = np.log(np.maximum(x, 1e-300)) - size[open_, None] * slope
        ahead = np.exp(ahead - ahead.max(axis=1, keepdims=True))
        ahead /= ahead.sum(axis=1, keepdims=True)
        now = np.einsum("ij,jk,ik->i", ahead, gram, ahead) - 2 * (ahead * y[open_]).sum(axis=1)
        better = now <= value[open_]
        c[open_[better]], value[open_[better]] = ahead[better], now[better]
        size[open_] *= np.where(better, 1.5, 0.4)
    return c


def recover_topics(rows: DataFrame, anchors: np.ndarray, tol: float = 1e-10) -> DataFrame:
    """(w, c): how much of each topic's words every word is, up to a factor per topic: its mixture of the anchors' rows,
    times its share. Words are independent of each other and are solved in tasks."""
    gram, width = anchors @ anchors.T, anchors.shape[1]

    def solve(batches):
        for b in batches:
            p = b.column("p").to_numpy()
            for at, x in _dense(b, width):
                c = mixture(gram, x @ anchors.T, tol) * p[at, None]
                ends = pa.array(np.arange(len(c) + 1, dtype=np.int32) * c.shape[1])
                yield pa.RecordBatch.from_arrays([b.column("w").slice(at.start, len(c)), pa.ListArray.from_arrays(ends, pa.array(c.ravel()))], names=["w", "c"])

    return rows.mapInArrow(solve, "w int, c array<double>")


@dataclass(frozen=True)
class SpectralStart:
    """``anchors``: a word per topic; ``words``: a table (w, b) with the probabilities of each word in the topics."""

    anchors: list[int]
    words: DataFrame


def spectral_start(vectors: DataFrame, k: int, size: int, most_words: int = 10_000, smooth: float = 0.001) -> SpectralStart:
    """Topics of the documents (counts), over ``size`` words. Words beyond the ``most_words`` have their share of all tokens
    in each topic; ``smooth`` of each topic is spread evenly, so that no word is impossible. If the co-occurrences have a
    smaller rank than ``k``, the topics left over have the words' shares of all tokens."""
    scratch = Scratch(vectors.sparkSession, "spectral")
    rows, width = cooccurrence(vectors, size, most_words)
    anchors, x = find_anchors(rows, k, width)
    totals = word_totals(bag(vectors))
    tokens = totals.agg(F.sum("total")).first()[0] or 1.0
    share = F.col("total") / F.lit(float(tokens))
    blank = F.array(*(F.lit(None).cast("double") for _ in range(len(anchors))))
    found = recover_topics(rows, x) if anchors else rows.select("w", blank.alias("c"))
    joined = scratch.put(totals.select("w", share.alias("share")).join(found, "w", "left"), "recovered")
    whole = joined.agg(*(F.sum(F.coalesce(F.col("c")[i], F.lit(0.0))) for i in range(len(anchors))), F.sum(F.when(F.col("c").isNotNull(), F.col("share")))).first()
    known = whole[-1] or 1.0  # the share of tokens that the spectral words have
    cells = [F.coalesce(F.col("c")[i] / F.lit(whole[i] or 1.0) * F.lit(known), F.col("share")) for i in range(len(anchors))] + [F.col("share")] * (k - len(anchors))
    words = joined.select("w", F.array(*((1 - smooth) * c + F.lit(smooth / size) for c in cells)).alias("b"))
    out = scratch.put(words, "words")
    scratch.keep("words")
    return SpectralStart(anchors, out)
