"""Latent Dirichlet allocation by collapsed Gibbs sampling.

Documents are kept in blocks, each with its tokens and their topics: a row of a table, from which the next state is made. In
a round every block sweeps over its own tokens, from the topic counts of all blocks at the round's beginning, which it keeps
up to date for its own changes; then the counts are taken anew from all tokens. With one block this is the sampler
itself, with several its usual distributed form. Draws come from generators seeded by seed, round and block, so a task that
is run again gives the same.

The topic counts, words x topics numbers, go to every task and through the driver: the vocabulary has to be bounded (see
models.vectorise).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.spectral_topics import bag
from lexloom.scratch import Scratch, ship_package

#: Tokens that make a block: at most and, where that leaves cores idle, at least.
BLOCK_TOKENS = (200_000, 5_000)
#: Blocks of a task that are swept over in step: array operations are then long enough to be worth their calls.
AT_ONCE = 8


class Sweeper:
    """Blocks of documents that are swept over in step: each with its tokens' words, documents that end at ``ends``, its topics
    and its own copy of the counts of all blocks (words x topics), of which it takes the rows of its words.

    A block draws the i-th tokens of ``together`` documents at once; in groups of 1 this is the exact sampler. The steps of
    blocks are made at once, as blocks do not see each other: a block's draws are the same alone and with others."""

    def __init__(self, words: list[np.ndarray], ends: list[np.ndarray], z: list[np.ndarray], counts: np.ndarray, together: int):
        self.k, self.docs, self.blocks, self.whole = counts.shape[1], sum(map(len, ends)), len(words), counts
        step, block, owner, places, self.rows, self.bounds = [], [], [], [], [], np.cumsum([0, *map(len, words)])
        docs, own, size = 0, [], 0
        for b, (w, end) in enumerate(zip(words, ends)):
            lengths = np.diff(end, prepend=0)
            order = np.argsort(-lengths, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            first = np.cumsum([0, *lengths[order][::together]])[:-1]  # the steps before those of a group of documents
            at = np.arange(len(w)) - np.repeat(end - lengths, lengths)  # a token's place in its document
            mine = np.repeat(place, lengths)
            step.append((first[mine // together] if len(w) else mine) + at)
            block.append(np.full(len(w), b))
            owner.append(docs + mine)
            places.append(docs + place)
            docs += len(order)
            some, number, often = np.unique(w, return_inverse=True, return_counts=True)
            falling = np.argsort(-often, kind="stable")  # the counts of most tokens are close
            turn = np.empty(len(some), np.int64)
            turn[falling] = np.arange(len(some))
            own.append(size + turn[number])
            self.rows.append(some[falling])
            size += len(some)
        step, block, owner, own, self.places = (np.concatenate([np.empty(0, np.int64), *x]) for x in (step, block, owner, own, places))
        self.tokens = np.lexsort((owner, step))  # owners rise with blocks
        self.block, self.owner, self.words = block[self.tokens], owner[self.tokens], own[self.tokens]
        self.parts = [np.flatnonzero(self.block == b) for b in range(self.blocks)]
        self.steps = np.cumsum([0, *np.bincount(step)]).tolist() if len(step) else [0]
        self.topic = np.concatenate([np.empty(0, np.int64), *z])[self.tokens]
        self.nd = np.bincount(self.topic * docs + self.owner, minlength=docs * self.k).astype(float).reshape(self.k, docs)
        # counts are whole numbers in doubles, a row for each topic
        self.n = np.ascontiguousarray(counts[np.concatenate([np.empty(0, np.int64), *self.rows])].T, float)
        self.nk = np.repeat(counts.sum(axis=0).astype(float)[:, None], self.blocks, axis=1)

    def sweep(self, alpha: float, eta: float, rngs: list[np.random.Generator]) -> None:
        k, docs, size, blocks, rest = self.k, self.docs, self.n.shape[1], self.blocks, eta * len(self.whole)
        flat_d, flat_n, flat_k = self.nd.reshape(-1), self.n.reshape(-1), self.nk.reshape(-1)
        draws = np.empty(len(self.topic))
        for part, rng in zip(self.parts, rngs):
            draws[part] = rng.random(len(part))
        for begin, end in zip(self.steps[:-1], self.steps[1:]):
            w, old, doc, block = self.words[begin:end], self.topic[begin:end], self.owner[begin:end], self.block[begin:end]
            flat_d[old * docs + doc] -= 1  # a document has one of these tokens
            np.subtract.at(flat_n, old * size + w, 1.0)
            flat_k -= np.bincount(old * blocks + block, minlength=len(flat_k))
            chance, near = self.nd.take(doc, axis=1), self.n.take(w, axis=1)
            chance += alpha
            near += eta
            chance *= near
            chance /= (self.nk + rest).take(block, axis=1)
            for j in range(1, k):
                chance[j] += chance[j - 1]
            level, new = draws[begin:end] * chance[-1], np.zeros(end - begin, np.int64)
            for j in range(k - 1):
                new += chance[j] < level
            flat_d[new * docs + doc] += 1
            np.add.at(flat_n, new * size + w, 1.0)
            flat_k += np.bincount(new * blocks + block, minlength=len(flat_k))
            self.topic[begin:end] = new

    def topics(self) -> list[np.ndarray]:
        """Of the tokens of each block, in their own order."""
        z = np.empty(len(self.topic), np.int64)
        z[self.tokens] = self.topic
        return [z[a:b] for a, b in zip(self.bounds[:-1], self.bounds[1:])]


def sweep(words: np.ndarray, ends: np.ndarray, z: np.ndarray, nw: np.ndarray, nk: np.ndarray, alpha: float, eta: float, rng: np.random.Generator, together: int) -> None:
    """One sweep over the tokens of one block: ``z`` and the counts ``nw`` (words x topics) and ``nk`` are changed in place."""
    one = Sweeper([words], [ends], [z], nw, together)
    one.sweep(alpha, eta, [rng])
    z[:], nw[one.rows[0]] = one.topics()[0], one.n.T
    nk[:] = one.nk[:, 0]


def log_likelihood(nw: np.ndarray, eta: float) -> float:
    """Of the words, given the topics of all tokens."""
    if not len(nw):
        return 0.0
    values, times = np.unique(nw, return_counts=True)
    of = sum(t * (math.lgamma(v + eta) - math.lgamma(eta)) for v, t in zip(values.tolist(), times.tolist()) if v)
    return of + sum(math.lgamma(eta * len(nw)) - math.lgamma(n + eta * len(nw)) for n in nw.sum(axis=0).tolist())


@dataclass
class GibbsTopics:
    """counts: (w, n), tokens of a word in each topic; state: the blocks; likelihood: after each round."""

    k: int
    size: int
    alpha: float
    eta: float
    counts: DataFrame
    state: DataFrame
    key_type: str
    sweeps: int
    kept: int
    likelihood: list[float] = field(default_factory=list)

    def documents(self) -> DataFrame:
        """(keys, n, expected): tokens of each document in each topic, after the last sweep and on average over the sweeps
        after the burn-in."""
        k, kept = self.k, max(1, self.kept)

        def run(batches):
            for b in batches:
                for i in range(b.num_rows):
                    ends, z = (np.asarray(b.column(c)[i].values, np.int64) for c in ("ends", "z"))
                    lengths = np.diff(ends, prepend=0)
                    n = np.bincount(np.repeat(np.arange(len(ends)), lengths) * k + z, minlength=len(ends) * k)
                    at = pa.array(np.arange(len(ends) + 1, dtype=np.int32) * k)
                    mean = np.asarray(b.column("expected")[i].values, float) / kept
                    yield pa.RecordBatch.from_arrays([b.column("keys")[i].values, pa.ListArray.from_arrays(at, pa.array(n)), pa.ListArray.from_arrays(at, pa.array(mean))], names=["key", "n", "expected"])

        return self.state.mapInArrow(run, f"key {self.key_type}, n array<long>, expected array<double>").select("key.*", "n", "expected")

    def loadings(self, keys: list[str], mean: bool = False) -> DataFrame:
        """(keys, topic, loading): each topic's share of a document's tokens, after the last sweep or, with ``mean``, on
        average; equal shares for a document without tokens."""
        n = F.col("expected" if mean else "n")
        total = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
        share = F.transform(n, lambda x: F.when(total > 0, x / total).otherwise(F.lit(1.0 / self.k)))
        return self.documents().select(*keys, F.posexplode(share).alias("topic", "loading"))


def _dealt(blocks: DataFrame, number: int) -> DataFrame:
    """Blocks in as many tasks as there are cores, or a multiple if that would be more than AT_ONCE blocks a task; evenly, which
    neither their hashes nor the files of a table would be."""
    cores = max(1, blocks.sparkSession.sparkContext.defaultParallelism)
    tasks = min(number, cores * -(-number // (cores * AT_ONCE)))
    return blocks.repartitionById(tasks, F.col("block") % tasks)


def _number_of_blocks(spark, tokens: int) -> int:
    return max(1, -(-tokens // BLOCK_TOKENS[0]), min(tokens // BLOCK_TOKENS[1], spark.sparkContext.defaultParallelism))


def _blocks(docs: DataFrame, blocks: int, seed: int) -> DataFrame:
    hashed = docs.select(F.xxhash64(F.lit(seed), "key", "w", "n").alias("h"), "key", "w", "n")
    return hashed.groupBy(F.pmod("h", F.lit(blocks)).cast("int").alias("block")).agg(F.array_sort(F.collect_list(F.struct("h", "key", "w", "n"))).alias("docs"))


def fit_gibbs_topics(vectors: DataFrame, keys: list[str], k: int = 12, sweeps: int = 500, alpha: float = 0.1, eta: float = 0.1, burn_in: int = 5, seed: int = 1, together: int = 256, per_round: int = 10) -> GibbsTopics:
    """A model of the documents (keys, counts): ``sweeps`` sweeps over all tokens, of which ``per_round`` are made between two
    exchanges of counts; averages of documents begin after ``burn_in`` sweeps.

    Defined cases: a null vector is a document without tokens; equal documents are sampled each by itself; an empty table
    gives a model without words. The first topics are drawn evenly."""
    spark = vectors.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "gibbs-topics")
    size = vectors.select(F.unwrap_udt("counts")["size"].alias("s")).where("s is not null").first()
    size = size[0] if size else 0
    docs = bag(vectors, F.struct(*(F.col(c) for c in keys)).alias("key"))
    key_type = docs.schema["key"].dataType.simpleString()
    tokens = int(docs.agg(F.sum(F.aggregate("n", F.lit(0.0), lambda a, x: a + x))).first()[0] or 0)
    number = _number_of_blocks(spark, tokens)
    schema = f"block int, keys array<{key_type}>, words array<int>, ends array<long>, z array<int>, expected array<double>, w int, n array<long>"
    names = ["block", "keys", "words", "ends", "z", "expected", "w", "n"]

    def rows(block: pa.Array, key: pa.Array, words: np.ndarray, ends: np.ndarray, z: np.ndarray, expected: np.ndarray):
        """The state, and the block's topic counts of each of its words."""
        one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t))
        yield pa.RecordBatch.from_arrays([block, pa.ListArray.from_arrays(pa.array([0, len(key)], pa.int32()), key), one(words, pa.int32()), one(ends, pa.int64()), one(z, pa.int32()), one(expected, pa.float64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.int64()))], names=names)
        some, at = np.unique(words, return_inverse=True)
        n = np.bincount(at * k + z, minlength=len(some) * k)
        void = [pa.nulls(len(some), t) for t in (pa.int32(), pa.list_(key.type), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([*void, pa.array(some, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * k), pa.array(n))], names=names)

    def begin(batches):
        for b in batches:
            for i in range(b.num_rows):
                part = b.column("docs")[i].values
                words, lengths = [np.empty(0, np.int64)], []
                for w, n in zip(part.field("w"), part.field("n")):
                    own = np.repeat(np.asarray(w.values, np.int64), np.asarray(n.values, np.int64)) if w.is_valid else np.empty(0, np.int64)
                    words.append(own)
                    lengths.append(len(own))
                words, ends = np.concatenate(words), np.cumsum(lengths, dtype=np.int64)
                rng = np.random.Generator(np.random.PCG64([seed, 0, b.column("block")[i].as_py()]))
                yield from rows(b.column("block").slice(i, 1), part.field("key"), words, ends, rng.integers(0, k, len(words)), np.zeros(len(ends) * k))

    def gathered(table: DataFrame) -> np.ndarray:
        """Words x topics, from the counts of all blocks."""
        out = np.zeros((size, k), np.int64)
        sums = F.array(*(F.expr(f"sum(get(n, {j}))") for j in range(k))).alias("n")
        found = table.where("w IS NOT NULL").groupBy("w").agg(sums).toArrow()
        if found.num_rows:
            n = found.column("n").combine_chunks()
            out[found.column("w").to_numpy()] = n.flatten().to_numpy().reshape(-1, k)
        return out

    table = scratch.put(_dealt(_blocks(docs, number, seed), number).mapInArrow(begin, schema), "round-0")
    counts = gathered(table)
    likelihood, done, turn = [], 0, 0
    while done < sweeps:
        turn, now = turn + 1, min(per_round, sweeps - done)
        shared = spark.sparkContext.broadcast(counts)  # as large as the model

        def go(batches, turn=turn, now=now, done=done, shared=shared):
            for b in batches:
                for first in range(0, b.num_rows, AT_ONCE):
                    at = range(first, min(first + AT_ONCE, b.num_rows))
                    words, ends, z = ([np.array(b.column(c)[i].values, np.int64) for i in at] for c in ("words", "ends", "z"))
                    expected = np.concatenate([np.array(b.column("expected")[i].values, float) for i in at])
                    rngs = [np.random.Generator(np.random.PCG64([seed, turn, b.column("block")[i].as_py()])) for i in at]
                    blocks = Sweeper(words, ends, z, shared.value, together)
                    docs, total = np.cumsum([0, *map(len, ends)]), np.zeros_like(blocks.nd)
                    for s in range(done + 1, done + now + 1):
                        blocks.sweep(alpha, eta, rngs)
                        if s > burn_in:
                            total += blocks.nd
                    expected += total.T[blocks.places].ravel()
                    for i, w, e, topics, d in zip(at, words, ends, blocks.topics(), docs):
                        yield from rows(b.column("block").slice(i, 1), b.column("keys")[i].values, w, e, topics, expected[d * k : (d + len(e)) * k])

        table = scratch.put(_dealt(table.where("w IS NULL"), number).mapInArrow(go, schema), f"round-{turn}")
        counts = gathered(table)
        scratch.drop(f"round-{turn - 1}")
        shared.unpersist()
        likelihood.append(log_likelihood(counts, eta))
        done += now
    sums = F.array(*(F.expr(f"sum(get(n, {j}))") for j in range(k))).alias("n")
    by_word = table.where("w IS NOT NULL").groupBy("w").agg(sums)
    return GibbsTopics(k, size, alpha, eta, by_word, table.where("w IS NULL").select("keys", "ends", "z", "expected"), key_type, done, max(0, done - burn_in), likelihood)
