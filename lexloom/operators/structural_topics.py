"""Structural topic models: the prevalence of topics depends on covariates of the documents, and their words on one more.

A document with covariates x has topic shares softmax(eta, 0) with eta ~ N(x gamma, sigma). With a content covariate of few
values, topic k's words at its value a have probabilities in proportion to exp(m + topic_k + content_a + both_ak), where m
is the log share of a word in all texts and the three deviations are sparse: they have a Laplace prior, whose strength is
chosen for each word by the information criterion along a path. Without it, a topic has one distribution.

Fitted by variational EM from a spectral start. Documents are kept in blocks. In each iteration a block gets the rows of the
model for its own words by a join, a task takes its documents' Newton steps and gives expected counts; these are added up
by word, and the words' regressions are tasks too. Nothing of the size of the vocabulary comes to the driver: it holds
covariates x topics and topics x topics numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators.spectral_topics import bag, spectral_start, word_totals
from lexloom.scratch import Scratch, ship_package

#: Distinct words of documents, added up, that make a block: at most and, where that leaves cores idle, at least.
BLOCK_WORDS = (50_000, 2_000)
#: Distinct words of documents that are worked on at once.
TOGETHER = 100_000


def shares(eta: np.ndarray) -> np.ndarray:
    w = np.exp(np.append(eta, 0.0) - max(0.0, eta.max(initial=0.0)))
    return w / w.sum()


def posterior(n: np.ndarray, beta: np.ndarray, mu: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(eta, its covariance, topics by words expected counts, log density at eta) of a document with the counts ``n`` of
    words that have the probabilities ``beta`` in the topics."""
    eta, around, counts, density = posteriors(n, beta, np.array([len(n)]), mu[None], inverse)
    return eta[0], around[0], counts, float(density[0])


def posteriors(n: np.ndarray, beta: np.ndarray, lengths: np.ndarray, mu: np.ndarray, inverse: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for many documents at once, whose words stand one after the other, ``lengths`` of each: (eta, covariances,
    topics by words expected counts, log densities), with a row of ``mu`` for each document. It is looked for from ``start`` on, or
    from ``mu``."""
    docs, c, k = len(lengths), mu.shape[1], mu.shape[1] + 1
    full = np.cumsum(lengths) - lengths

    def sums(x, size, begins):
        """Of the columns of ``x``, per document; 0 without words."""
        if not size.all():
            out, some = np.zeros((len(x), len(size))), size > 0
            if some.any():
                out[:, some] = np.add.reduceat(x, begins[some], axis=1)
            return out
        return np.add.reduceat(x, begins, axis=1) if len(size) else np.zeros((len(x), 0))

    def theta_of(eta):
        w = np.exp(np.hstack([eta, np.zeros((len(eta), 1))]) - np.maximum(0.0, eta.max(axis=1, initial=0.0))[:, None])
        return w / w.sum(axis=1, keepdims=True)

    def rates(theta, own, size):
        return sum(np.repeat(theta[:, j], size) * own[j] for j in range(k))

    def density(eta, theta, own, count, size, begins, at):
        away = eta - at
        return sums((count * np.log(rates(theta, own, size)))[None], size, begins)[0] - 0.5 * ((away @ inverse) * away).sum(axis=1)

    eta, curved = (mu if start is None else start).copy(), np.empty((docs, c, c))
    live, own, count, size, begins = np.arange(docs), beta, n, lengths, full
    now = density(eta, theta_of(eta), own, count, size, begins, mu)
    for _ in range(200):
        if not len(live):
            break
        x, at = eta[live], mu[live]
        theta = theta_of(x)
        ratio = count / rates(theta, own, size)
        counts = theta * sums(own * ratio, size, begins).T
        total = counts.sum(axis=1)  # tokens
        slope = (counts - total[:, None] * theta)[:, :-1] - (x - at) @ inverse
        outer = theta[:, :c, None] * theta[:, None, :c]
        above = inverse - total[:, None, None] * outer
        above[:, range(c), range(c)] += total[:, None] * theta[:, :c]
        # products of a word's shares of two topics, times its count
        share = ratio * ratio / np.where(count > 0, count, 1)
        exact = above.copy()
        for i in range(c):
            exact[:, i, i] -= counts[:, i]
            for j in range(i + 1):
                both = theta[:, i] * theta[:, j] * sums((own[i] * own[j] * share)[None], size, begins)[0]
                exact[:, i, j] += both
                if i != j:
                    exact[:, j, i] += both
        # where the density isn't concave, the curvature without its convex part is a bound of it
        convex = np.linalg.eigvalsh(exact).min(axis=1, initial=1.0) > 1e-9
        curve = np.where(convex[:, None, None], exact, above)
        step = np.linalg.solve(curve, slope[:, :, None])[:, :, 0]
        curved[live] = curve
        going = np.abs(step).max(axis=1, initial=0.0) >= 1e-7
        gain, width, wait = (slope * step).sum(axis=1), np.ones(len(live)), going.copy()
        while wait.any():
            # all documents, for few go on after the first width
            new = x + width[:, None] * step
            ahead = density(new, theta_of(new), own, count, size, begins, at)
            fits = wait & (ahead >= now[live] + 1e-4 * width * gain)
            eta[live[fits]], now[live[fits]] = new[fits], ahead[fits]
            wait &= ~fits
            width[wait] /= 2
            lost = wait & (width <= 1e-9)
            going, wait = going & ~lost, wait & ~lost
        if not going.all():
            keep = np.repeat(going, size)
            live, own, count, size = live[going], own[:, keep], count[keep], size[going]
            begins = np.cumsum(size) - size
    theta = theta_of(eta)
    phi = np.stack([np.repeat(theta[:, j], lengths) * beta[j] for j in range(k)]) if k else beta
    return eta, np.linalg.inv(curved), phi / phi.sum(axis=0) * n, now


def sparse_rates(counts: np.ndarray, base: np.ndarray, amount: np.ndarray, path: int = 20, least: float = 1e-3, cycles: int = 60, tol: float = 1e-5) -> np.ndarray:
    """Words by contents by topics: the rates of words, without the cells' amounts, from expected counts of that shape.

    A Poisson regression per word on its topic, its content and both, with the offset ``base`` (per word) plus the log
    ``amount`` of each cell, and an absolute-value penalty on every deviation. Deviations are found one after the other,
    each exactly, round and round; the penalty falls along a path of ``path`` values to ``least`` of the first that lets
    a deviation be other than 0, and the one with the smallest information criterion is taken for each word."""
    size, contents, topics = counts.shape
    offset = np.exp(base)[:, None, None] * amount
    b_topic, b_content, b_both = np.zeros((size, 1, topics)), np.zeros((size, contents, 1)), np.zeros(counts.shape)
    rate = offset.copy()
    first = counts - rate
    top = np.maximum.reduce([np.abs(first.sum(axis=1)).max(axis=1), np.abs(first.sum(axis=2)).max(axis=1), np.abs(first).max(axis=(1, 2))])
    best, chosen = np.full(size, np.inf), rate.copy()

    def step(b: np.ndarray, have: np.ndarray, expect: np.ndarray, penalty: np.ndarray) -> np.ndarray:
        """The best value of each deviation, the others being as they are."""
        with np.errstate(divide="ignore", invalid="ignore"):
            up = b + np.log(np.maximum(have - penalty, 0) / expect)
            down = b + np.log((have + penalty) / expect)
        return np.clip(np.where(up > 0, up, np.where(down < 0, down, 0.0)), -20, 20)

    whole = [rate, b_topic, b_content, b_both]
    for strength in np.geomspace(1, least, path):
        penalty = np.maximum(top * strength, 1e-9)
        # words that don't move any more are done with this penalty, whatever others do
        live, (r, topic, content, both), n, limit = np.arange(size), (x.copy() for x in whole), counts, penalty[:, None, None]
        by_topic, by_content = counts.sum(axis=1, keepdims=True), counts.sum(axis=2, keepdims=True)
        for _ in range(cycles):
            if not len(live):
                break
            new = step(topic, by_topic, r.sum(axis=1, keepdims=True), limit)
            r *= np.exp(new - topic)
            moved, topic = np.abs(new - topic).max(axis=(1, 2)), new
            new = step(content, by_content, r.sum(axis=2, keepdims=True), limit)
            r *= np.exp(new - content)
            moved, content = np.maximum(moved, np.abs(new - content).max(axis=(1, 2))), new
            new = step(both, n, r, limit)
            r *= np.exp(new - both)
            moved, both = np.maximum(moved, np.abs(new - both).max(axis=(1, 2))), new
            going = moved >= tol
            if not going.all():
                for x, own in zip(whole, (r, topic, content, both)):
                    x[live[~going]] = own[~going]
                live, r, topic, content, both, n, limit, by_topic, by_content = (x[going] for x in (live, r, topic, content, both, n, limit, by_topic, by_content))
        for x, own in zip(whole, (r, topic, content, both)):
            x[live] = own
        free = (b_topic != 0).sum(axis=(1, 2)) + (b_content != 0).sum(axis=(1, 2)) + (b_both != 0).sum(axis=(1, 2))
        criterion = 2 * (rate.sum(axis=(1, 2)) - (counts * np.log(rate)).sum(axis=(1, 2))) + 2 * free
        better = criterion < best - 1e-9
        best[better], chosen[better] = criterion[better], rate[better]
    return chosen / amount


def dummies(df: DataFrame, column: str) -> dict[str, Column]:
    """A covariate of few values as 0/1 terms, one for each value but the first; null is a value."""
    values = [r[0] for r in df.select(column).distinct().orderBy(F.col(column).asc_nulls_first()).collect()]
    return {f"{column}={v}": F.col(column).eqNullSafe(F.lit(v)).cast("double") for v in values[1:]}


@dataclass
class StructuralTopics:
    """terms: the prevalence's covariates, the intercept first, with ``gamma`` (terms x (topics - 1)) and ``sigma``;
    contents: the content covariate's values; words: a table (w, b) of rates, contents x topics numbers a word, whose sums
    over words are ``scale``; bounds: the variational bound after each iteration."""

    k: int
    size: int
    terms: dict[str, Column]
    content: str | None
    contents: list
    gamma: np.ndarray
    sigma: np.ndarray
    words: DataFrame
    scale: np.ndarray
    anchors: list[int] = field(default_factory=list)
    bounds: list[float] = field(default_factory=list)

    def place(self) -> Column:
        """The number of a row's content value."""
        if self.content is None:
            return F.lit(0)
        at = F.lit(None).cast("int")
        for i, name in enumerate(self.contents):
            at = F.when(F.col(self.content).eqNullSafe(F.lit(name)), i).otherwise(at)
        return at

    def probabilities(self) -> DataFrame:
        """(w, content, topic, probability)."""
        each = self.words.select("w", F.posexplode("b").alias("_i", "_b"))
        scale = F.array(*(F.lit(float(s)) for s in self.scale.ravel()))
        return each.select("w", F.get(F.array(*(F.lit(c).cast("string") for c in self.contents)), F.floor(F.col("_i") / self.k).cast("int")).alias("content"), (F.col("_i") % self.k).alias("topic"), (F.col("_b") / F.get(scale, F.col("_i"))).alias("probability"))

    def beta(self) -> np.ndarray:
        """Contents x topics x words probabilities, on the driver: for small vocabularies."""
        out = np.zeros((self.size, len(self.contents) * self.k))
        for r in self.words.collect():
            out[r["w"]] = r["b"]
        return (out / self.scale.ravel()).T.reshape(len(self.contents), self.k, self.size)

    def loadings(self, vectors: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, topic, loading) of each document of a known content value; one without words has the shares that its
        covariates give."""
        scratch = Scratch(vectors.sparkSession, "topic-loadings")
        docs = _Blocks(vectors, self, keys, scratch)
        gamma, inverse, k = self.gamma, np.linalg.inv(self.sigma), self.k

        def place(batches):
            for block in _parts(batches, k):
                theta = []
                for _, n, beta, lengths, x, _ in block.groups():
                    theta += [shares(eta).tolist() for eta in posteriors(n, beta, lengths, x @ gamma, inverse)[0]]
                yield pa.RecordBatch.from_arrays([block.keys(), pa.array(theta, pa.list_(pa.float64()))], names=["key", "theta"])

        found = docs.with_words(self).mapInArrow(place, f"key {docs.key_type}, theta array<double>")
        return found.select("key.*", F.posexplode("theta").alias("topic", "loading"))


class _Block:
    """A block of documents with the model's rows for its words."""

    def __init__(self, batch: pa.RecordBatch, i: int, k: int):
        self.docs = batch.column("docs")[i].values  # structs
        self.number = batch.column("block")[i].as_py()
        etas = batch.column("etas")[i]
        self.etas = etas.values.to_numpy(zero_copy_only=False).reshape(len(self.docs), -1) if etas.is_valid else None
        rows = batch.column("rows")[i]
        self.vocabulary, self.b = np.empty(0, np.int64), np.empty((0, k))
        if rows.is_valid and len(rows):
            values = rows.values
            self.vocabulary = values.field("w").to_numpy(zero_copy_only=False).astype(np.int64)
            self.b = values.field("b").flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
            order = np.argsort(self.vocabulary)
            self.vocabulary, self.b = self.vocabulary[order], self.b[order]
        self.k = k

    def keys(self) -> pa.Array:
        return self.docs.field("key")

    def groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Documents, about TOGETHER words of them: (places of their words in the block's vocabulary, counts, topics x words, words
        of each document, documents x covariates, contents)."""
        lengths = np.asarray(self.docs.field("w").value_lengths().fill_null(0), np.int64)
        words, counts = np.asarray(self.docs.field("w").flatten(), np.int64), np.asarray(self.docs.field("n").flatten(), float)
        covariates = np.asarray(self.docs.field("x").flatten(), float).reshape(len(lengths), -1)
        contents, ends, first = np.asarray(self.docs.field("g"), np.int64), np.cumsum(lengths), 0
        while first < len(lengths):
            begin = int(ends[first] - lengths[first])
            stop = max(first + 1, int(np.searchsorted(ends, begin + TOGETHER, side="right")))
            own, part = slice(begin, int(ends[stop - 1])), slice(first, stop)
            doc = np.repeat(np.arange(stop - first), lengths[part])
            at = np.minimum(np.searchsorted(self.vocabulary, words[own]), max(0, len(self.vocabulary) - 1))
            known = self.vocabulary[at] == words[own] if len(self.vocabulary) else np.zeros(len(doc), bool)
            at, doc = at[known], doc[known]
            column = contents[part][doc] * self.k
            beta = np.stack([self.b[at, column + j] for j in range(self.k)])
            yield at, counts[own][known], beta, np.bincount(doc, minlength=stop - first), covariates[part], contents[part]
            first = stop


def _parts(batches, k: int) -> Iterator[_Block]:
    for b in batches:
        for i in range(b.num_rows):
            yield _Block(b, i, k)


class _Blocks:
    """Documents in blocks of about as many words as BLOCK_WORDS says, chosen by a hash of keys and words, and the words of each
    block. A block has a document's whole counts, so one that is larger than that is a large block."""

    def __init__(self, vectors: DataFrame, model: StructuralTopics, keys: Sequence[str], scratch: Scratch):
        ship_package(vectors.sparkSession)
        key = F.struct(*(F.col(k) for k in keys)) if keys else F.struct(F.lit(0).alias("_"))
        x = F.array(*(c.cast("double") for c in model.terms.values()))
        docs = bag(vectors, key.alias("key"), x.alias("x"), model.place().alias("g")).where("g is not null")
        self.key_type = docs.schema["key"].dataType.simpleString()
        total = docs.agg(F.sum(F.size("w"))).first()[0] or 0
        blocks = max(1, -(-total // BLOCK_WORDS[0]), min(total // BLOCK_WORDS[1], vectors.sparkSession.sparkContext.defaultParallelism))
        number = F.pmod(F.xxhash64("key", "w", "n"), F.lit(blocks)).alias("block")
        lists = F.array_sort(F.collect_list(F.struct(F.xxhash64("key", "w", "n").alias("h"), "key", "w", "n", "x", "g")))
        self.blocks = scratch.put(docs.groupBy(number).agg(lists.alias("docs")), "blocks")
        self.words = scratch.put(self.blocks.select("block", F.explode(F.array_distinct(F.flatten(F.transform("docs", lambda d: d["w"])))).alias("w")), "block-words")

    def with_words(self, model: StructuralTopics, etas: DataFrame | None = None) -> DataFrame:
        """Blocks with the model's rows for their words, and with what ``etas`` (block, etas) has for their documents."""
        scale = F.array(*(F.lit(float(s)) for s in model.scale.ravel()))
        b = F.zip_with("b", scale, lambda a, s: a / s)
        rows = self.words.join(model.words.select("w", b.alias("b")), "w").groupBy("block").agg(F.collect_list(F.struct("w", "b")).alias("rows"))
        out = self.blocks.join(rows, "block", "left")
        out = out.withColumn("etas", F.lit(None).cast("array<double>")) if etas is None else out.join(etas, "block", "left")
        return out.select("block", "docs", "rows", "etas")


def fit_structural_topics(vectors: DataFrame, k: int, prevalence: dict[str, Column] | None = None, content: str | None = None, iters: int = 75, tol: float = 1e-5, most_words: int = 10_000, ridge: float = 1e-6) -> StructuralTopics:
    """A model of the documents (covariates, counts) with ``k`` >= 2 topics. ``prevalence``: named numeric expressions, beside
    an intercept (see ``dummies`` for covariates of few values); ``content``: a column of few values, of which null is one.

    Starts from spectral topics over the ``most_words`` most frequent words and ends when an iteration changes the bound by
    less than ``tol`` of it. Rows with a null prevalence term count with 0 for it; documents without words count for
    nothing. ``vectors`` is read a few times and should be a table."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "structural-topics")
    size = vectors.select(F.unwrap_udt("counts")["size"].alias("s")).where("s is not null").first()
    size = size[0] if size else 0
    terms = {"intercept": F.lit(1.0)} | {n: F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in (prevalence or {}).items()}
    contents = [None] if content is None else [r[0] for r in vectors.select(content).distinct().orderBy(F.col(content).asc_nulls_first()).collect()]
    start = spectral_start(vectors, k, size, most_words)
    several, p, c = len(contents), len(terms), k - 1
    words = start.words.select("w", F.flatten(F.array(*[F.col("b")] * several)).alias("b"))
    model = StructuralTopics(k, size, terms, content, contents, np.zeros((p, c)), 20.0 * np.eye(c), words, np.ones((several, k)), start.anchors)
    docs = _Blocks(vectors, model, [], scratch)
    totals = word_totals(bag(vectors))
    tokens = float(totals.agg(F.sum("total")).first()[0] or 1.0)
    base = scratch.put(totals.select("w", F.log(F.col("total") / tokens).alias("base")), "base")
    cells, few = several * k, 2 + p * p + p * c + 2 * c * c  # per block: bound, documents, x'x, x'eta, eta'eta, covariances

    etas = None  # where the documents were in the iteration before, from which their steps go on
    for i in range(iters):
        gamma, sigma = model.gamma, model.sigma
        inverse, spread = np.linalg.inv(sigma), float(np.linalg.slogdet(sigma)[1])

        def sums(batches, gamma=gamma, inverse=inverse, spread=spread):
            for block in _parts(batches, k):
                counts, moments = np.zeros((len(block.vocabulary), cells)), np.zeros(few)
                places, first = np.zeros((len(block.docs), c)), 0
                for at, n, beta, lengths, x, g in block.groups():
                    some = lengths > 0  # documents without words count for nothing
                    own, first = first + np.flatnonzero(some), first + len(lengths)
                    lengths, x, g = lengths[some], x[some], g[some]
                    if not len(lengths):
                        continue
                    eta, around, expected, density = posteriors(n, beta, lengths, x @ gamma, inverse, None if block.etas is None else block.etas[own])
                    places[own] = eta
                    column = np.repeat(g, lengths) * k
                    for j in range(k):
                        np.add.at(counts, (at, column + j), expected[j])
                    bound = (density + 0.5 * (np.linalg.slogdet(around)[1] - spread)).sum()
                    moments += np.concatenate([[bound, len(lengths)], (x.T @ x).ravel(), (x.T @ eta).ravel(), (eta.T @ eta).ravel(), around.sum(axis=0).ravel()])
                some = counts.any(axis=1)
                w = pa.array([*block.vocabulary[some].tolist(), None], pa.int32())
                c_ = pa.array([*counts[some].tolist(), moments.tolist()], pa.list_(pa.float64()))
                last = len(w) - 1  # the row of the moments has the documents' places too
                number = pa.array([None] * last + [block.number], pa.int64())
                yield pa.RecordBatch.from_arrays([w, c_, number, pa.array([None] * last + [places.ravel().tolist()], pa.list_(pa.float64()))], names=["w", "c", "block", "etas"])

        found = scratch.put(docs.with_words(model, etas).mapInArrow(sums, "w int, c array<double>, block long, etas array<double>"), f"sums-{i}")
        etas = found.where("block IS NOT NULL").select("block", "etas")
        part = lambda mark, n: [F.expr(f"coalesce(sum(CASE WHEN w IS {mark} NULL THEN get(c, {j}) END), 0D)") for j in range(n)]
        all_ = np.array(found.agg(*part("NOT", cells), *part("", few)).first())
        amount, moments = all_[:cells].reshape(several, k), all_[cells:]
        bound, seen = float(moments[0]), max(1.0, moments[1])
        xx, rest = moments[2 : 2 + p * p].reshape(p, p), moments[2 + p * p :]
        xe, ee, around = rest[: p * c].reshape(p, c), rest[p * c : p * c + c * c].reshape(c, c), rest[p * c + c * c :].reshape(c, c)
        weight = ridge * np.eye(p)
        weight[0, 0] = 1e-12  # the intercept is free
        gamma = np.linalg.solve(xx + weight * seen, xe)
        model.gamma = gamma
        model.sigma = (around + ee - xe.T @ gamma - gamma.T @ xe + gamma.T @ xx @ gamma) / seen + 1e-9 * np.eye(c)
        by_word = found.where("w IS NOT NULL").groupBy("w").agg(F.array(*(F.expr(f"sum(get(c, {j}))") for j in range(cells))).alias("c"))
        if several == 1:
            even = 1e-9 * amount / max(1, size)  # no word becomes impossible
            model.words = scratch.put(by_word.select("w", F.zip_with("c", F.array(*(F.lit(float(e)) for e in even.ravel())), lambda a, e: a + e).alias("b")), f"words-{i}")
        else:
            model.words = scratch.put(_regressions(by_word.join(base, "w"), np.maximum(amount, 1e-9)), f"words-{i}")
        model.scale = np.array(model.words.agg(*(F.expr(f"sum(get(b, {j}))") for j in range(cells))).first(), float).reshape(several, k)
        if i:
            scratch.drop(f"sums-{i - 1}")
            scratch.drop(f"words-{i - 1}")
        model.bounds.append(bound)
        if i and abs(bound - model.bounds[-2]) < tol * abs(model.bounds[-2]):
            break
    return model


def _regressions(words: DataFrame, amount: np.ndarray) -> DataFrame:
    """(w, b) from (w, c, base), each word's regression in a task. Words are few bytes and much work, so they are dealt to all
    cores, however few partitions their bytes would make."""

    def solve(batches):
        for b in batches:
            if b.num_rows:
                counts = b.column("c").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, *amount.shape)
                rates = sparse_rates(counts, b.column("base").to_numpy(zero_copy_only=False), amount)
                ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * amount.size)
                yield pa.RecordBatch.from_arrays([b.column("w"), pa.ListArray.from_arrays(ends, pa.array(rates.ravel()))], names=["w", "b"])

    return words.select("w", "c", "base").repartition(max(1, words.sparkSession.sparkContext.defaultParallelism), "w").mapInArrow(solve, "w int, b array<double>")
