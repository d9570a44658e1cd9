"""Topic models against enumeration, brute force and planted topics; topic maps; dictionaries, matches, keywords, order
statistics and tail probabilities by their definitions."""

import collections
import itertools
import json
import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lexloom.functions import stats
from lexloom.operators import agreement, contexts, descriptives, gibbs_topics, spectral_topics, structural_topics, topic_map, translate, windows


def bags(spark, rows, size, groups=None):
    """Documents (doc_id, g, counts) from dense counts."""
    out = [(i, None if groups is None else groups[i], Vectors.sparse(size, np.flatnonzero(n).tolist(), np.asarray(n, float)[np.flatnonzero(n)].tolist())) for i, n in enumerate(rows)]
    return spark.createDataFrame(out, StructType([StructField("doc_id", LongType()), StructField("g", StringType()), StructField("counts", VectorUDT())]))


def planted(rng, docs, length, beta, alpha=0.2):
    theta = rng.dirichlet(np.full(len(beta), alpha), docs)
    return np.array([rng.multinomial(length, t @ beta) for t in theta]), theta


# ------------------------------------------------------------------ Gibbs sampling


def test_the_sampler_has_the_posterior_of_a_tiny_corpus():
    """How often two tokens share a topic, against all assignments of topics."""
    words, ends, k, size, alpha, eta = np.array([0, 0, 1, 2, 2, 1]), np.array([3, 6]), 2, 3, 0.3, 0.4
    total, same = 0.0, np.zeros((6, 6))
    for z in itertools.product(range(k), repeat=6):
        log = 0.0
        for a, b in ((0, 3), (3, 6)):
            log += sum(math.lgamma(alpha + sum(x == t for x in z[a:b])) for t in range(k))
        for t in range(k):
            own = [w for w, x in zip(words, z) if x == t]
            log += sum(math.lgamma(eta + own.count(w)) for w in range(size)) - math.lgamma(size * eta + len(own))
        p = math.exp(log)
        total += p
        same += p * np.equal.outer(z, z)
    rng, z = np.random.default_rng(1), np.zeros(6, np.int64)
    nw = np.zeros((size, k), np.int64)
    np.add.at(nw, (words, z), 1)
    nk, seen, n = nw.sum(axis=0), np.zeros((6, 6)), 12_000
    for i in range(n + 100):
        gibbs_topics.sweep(words, ends, z, nw, nk, alpha, eta, rng, 1)
        if i >= 100:
            seen += np.equal.outer(z, z)
    assert np.abs(seen / n - same / total).max() < 0.02
    assert (nk == nw.sum(axis=0)).all() and (nw.sum(axis=1) == [2, 2, 2]).all()


def test_gibbs_topics_find_planted_topics(spark, monkeypatch):
    rng = np.random.default_rng(2)
    beta = np.full((3, 30), 0.002)
    for t in range(3):
        beta[t, 10 * t : 10 * t + 10] = 1
    beta /= beta.sum(axis=1, keepdims=True)
    counts, theta = planted(rng, 90, 60, beta)
    monkeypatch.setattr(gibbs_topics, "BLOCK_TOKENS", (2000, 500))  # several blocks
    docs = bags(spark, [*counts, np.zeros(30)], 30).drop("g")
    model = gibbs_topics.fit_gibbs_topics(docs.repartition(4), ["doc_id"], 3, sweeps=30, per_round=5, together=16)
    assert model.state.count() > 2 and model.sweeps == 30 and len(model.likelihood) == 6 and model.likelihood[-1] > model.likelihood[0]
    n = {r.w: r.n for r in model.counts.collect()}
    assert all(sum(n[w]) == counts[:, w].sum() for w in range(30))  # every token has one topic
    found = np.array([n[w] for w in range(30)], float).T
    found /= found.sum(axis=1, keepdims=True)
    order = [int(found[:, 10 * t : 10 * t + 10].sum(axis=1).argmax()) for t in range(3)]
    assert sorted(order) == [0, 1, 2] and np.abs(found[order] - beta).max() < 0.03
    own = {r.doc_id: r for r in model.documents().collect()}
    assert len(own) == 91 and all(sum(own[i].n) == 60 for i in range(90)) and all(sum(own[i].expected) == pytest.approx(60) for i in range(90))
    shares = {(r.doc_id, r.topic): r.loading for r in model.loadings(["doc_id"], mean=True).collect()}
    assert np.abs(np.array([[shares[i, t] for t in order] for i in range(90)]) - theta).mean() < 0.06
    assert [shares[90, t] for t in range(3)] == [1 / 3] * 3
    # the same on other partitions
    again = gibbs_topics.fit_gibbs_topics(docs.repartition(1), ["doc_id"], 3, sweeps=30, per_round=5, together=16)
    assert again.likelihood == model.likelihood
    none = gibbs_topics.fit_gibbs_topics(docs.where("1 = 0"), ["doc_id"], 3, sweeps=2)
    assert none.documents().count() == 0 and none.counts.count() == 0


def test_blocks_swept_in_step_draw_what_they_draw_alone():
    """Each token after the other as the sampler says, against all blocks at once; and calls that do not grow with blocks."""
    rng, k, size, alpha, eta = np.random.default_rng(4), 3, 40, 0.1, 0.2
    words, ends, z = [], [], []
    for lengths in ([5, 0, 9, 9, 1, 30], [], [4, 4], [0], rng.integers(0, 25, 50)):
        ends.append(np.cumsum(np.asarray(lengths, np.int64)))
        words.append(rng.integers(0, size, int(sum(lengths))))
        z.append(rng.integers(0, k, int(sum(lengths))))
    counts = np.zeros((size, k), np.int64)
    for w, t in zip(words, z):
        np.add.at(counts, (w, t), 1)
    joint = gibbs_topics.Sweeper(words, ends, z, counts, 4)
    assert len(joint.steps) - 1 < sum(len(gibbs_topics.Sweeper([w], [e], [t], counts, 4).steps) - 1 for w, e, t in zip(words, ends, z))
    rngs = [np.random.default_rng(b) for b in range(len(words))]
    for _ in range(3):
        joint.sweep(alpha, eta, rngs)
    for b, (w, end, t, got) in enumerate(zip(words, ends, z, joint.topics())):
        t, nw, own = t.copy(), counts.copy(), np.random.default_rng(b)
        lengths, begins = np.diff(end, prepend=0), end - np.diff(end, prepend=0)
        nd = np.array([np.bincount(t[x:y], minlength=k) for x, y in zip(begins, end)]).reshape(-1, k)
        order = sorted(range(len(end)), key=lambda d: (-lengths[d], d))
        for _ in range(3):
            for at in range(0, len(order), 4):
                docs = order[at : at + 4]
                for i in range(lengths[docs[0]]):
                    live = [d for d in docs if lengths[d] > i]
                    for d in live:
                        nd[d, t[begins[d] + i]] -= 1
                        nw[w[begins[d] + i], t[begins[d] + i]] -= 1
                    nk, u = nw.sum(axis=0), own.random(len(live))
                    for d, x in zip(live, u):
                        chance = np.cumsum((nd[d] + alpha) * (nw[w[begins[d] + i]] + eta) / (nk + eta * size))
                        t[begins[d] + i] = (chance < x * chance[-1]).sum()
                    for d in live:
                        nd[d, t[begins[d] + i]] += 1
                        nw[w[begins[d] + i], t[begins[d] + i]] += 1
        assert (got == t).all()
        assert (np.bincount(got, minlength=k) == nd.sum(axis=0)).all()


# ------------------------------------------------------------------ spectral start


def brute_matrix(counts):
    q, docs = np.zeros((counts.shape[1],) * 2), 0
    for n in counts:
        if n.sum() >= 2:
            q += (np.outer(n, n) - np.diag(n)) / (n.sum() * (n.sum() - 1))
            docs += 1
    return q / docs


def brute_anchors(rows, k):
    left, out = rows.copy(), []
    for _ in range(k):
        best = int(np.argmax(np.round((left**2).sum(axis=1), 12)))
        out.append(best)
        b = left[best] / np.linalg.norm(left[best])
        left = left - np.outer(left @ b, b)
    return out


def brute_mixture(anchors, row):
    """The nearest mixture: the best of the least squares on every face of the simplex."""
    k, best = len(anchors), (np.inf, None)
    for size in range(1, k + 1):
        for face in itertools.combinations(range(k), size):
            a = anchors[list(face)]
            system = np.block([[2 * a @ a.T, np.ones((size, 1))], [np.ones((1, size)), np.zeros((1, 1))]])
            c = np.linalg.lstsq(system, np.append(2 * a @ row, 1.0), rcond=None)[0][:size]
            if (c >= -1e-12).all():
                far = ((c @ a - row) ** 2).sum()
                if far < best[0] - 1e-15:
                    full = np.zeros(k)
                    full[list(face)] = c
                    best = far, full
    return best[1]


def test_spectral_start_by_brute_force(spark):
    rng = np.random.default_rng(4)
    beta = rng.dirichlet(np.full(25, 0.15), 3) + 1e-3
    beta /= beta.sum(axis=1, keepdims=True)
    counts, _ = planted(rng, 200, 40, beta, 0.3)
    counts[:, 24] = 0
    counts[0, 24] = 3  # a rare word
    extra = np.zeros(25, int)
    extra[3] = 1  # a document of one token has no pair
    docs = bags(spark, [*counts, extra, np.zeros(25, int)], 25).repartition(5)
    rows, width = spectral_topics.cooccurrence(docs, 25)
    want = brute_matrix(counts)
    got = np.zeros((25, 25))
    for r in rows.collect():
        got[r.w, r.js] = r.qs
        assert r.p == pytest.approx(want[r.w].sum())
    shares = want / want.sum(axis=1, keepdims=True)
    assert width == 25 and np.allclose(got, shares)
    words, anchors = spectral_topics.find_anchors(rows, 3, width)
    assert words == brute_anchors(shares, 3) and np.allclose(anchors, shares[words])
    found = {r.w: np.array(r.c) for r in spectral_topics.recover_topics(rows, anchors).collect()}
    for w in range(25):
        assert found[w] / found[w].sum() == pytest.approx(brute_mixture(anchors, shares[w]), abs=2e-4)
    start = spectral_topics.spectral_start(docs, 3, 25)
    b = {r.w: r.b for r in start.words.collect()}
    assert start.anchors == words and np.allclose(np.sum(list(b.values()), axis=0), 1, atol=1e-3)
    # fewer words in the matrix than there are
    some, width = spectral_topics.cooccurrence(docs, 25, 10)
    top = sorted(range(25), key=lambda w: (-counts[:, w].sum() - extra[w], w))[:10]
    assert width == 10 and {r.w for r in some.collect()} == set(top)
    part = spectral_topics.spectral_start(docs, 3, 25, 10)
    assert part.words.count() == 25 and set(part.anchors) <= set(top)
    # a rank below the number of topics
    flat = spectral_topics.spectral_start(bags(spark, [[1, 1, 0], [2, 2, 0]], 3), 3, 3)
    assert len(flat.anchors) < 3 and all(x > 0 for r in flat.words.collect() for x in r.b)


def test_mixtures_end_at_the_minimum():
    rng = np.random.default_rng(9)
    a = rng.dirichlet(np.ones(12), 4)
    rows = np.vstack([rng.dirichlet(np.ones(4), 20) @ a, rng.dirichlet(np.ones(12), 20), a])
    c = spectral_topics.mixture(a @ a.T, rows @ a.T)
    assert c == pytest.approx(np.array([brute_mixture(a, r) for r in rows]), abs=2e-3)


# ------------------------------------------------------------------ structural topics


def test_sparse_rates_choose_what_the_counts_say():
    amount = np.full((2, 2), 1000.0)
    base = np.log(np.array([0.05, 0.05, 0.05]))
    counts = np.array([[[50, 50], [50, 50]], [[95, 5], [95, 5]], [[95, 5], [5, 95]]], float)
    rates = structural_topics.sparse_rates(counts, base, amount) * amount
    assert rates[0] == pytest.approx(counts[0], rel=1e-6)
    assert rates[1] == pytest.approx(counts[1], rel=0.15) and rates[1][0] == pytest.approx(rates[1][1], rel=1e-6)  # no deviation of the content
    assert rates[2] == pytest.approx(counts[2], rel=0.15)
    rng = np.random.default_rng(0)
    noise = rng.poisson(50, (200, 2, 2)).astype(float)
    plain = structural_topics.sparse_rates(noise, np.full(200, np.log(0.05)), amount) * amount
    assert ((plain - 50) ** 2).mean() < 0.7 * ((noise - 50) ** 2).mean()  # chance is shrunk away


def test_documents_and_words_are_solved_together_as_alone():
    """Documents at once have what each has alone; a word's regression does not depend on the words beside it."""
    rng = np.random.default_rng(8)
    beta, lengths = rng.dirichlet(np.ones(30), 3), np.array([4, 0, 30, 1, 12])
    words, mu = np.concatenate([rng.choice(30, n, False) for n in lengths]), rng.normal(0, 1, (5, 2))
    n, inverse = rng.integers(1, 20, len(words)).astype(float), np.array([[0.5, 0.1], [0.1, 0.4]])
    eta, around, counts, density = structural_topics.posteriors(n, beta[:, words], lengths, mu, inverse)
    for d, end in enumerate(np.cumsum(lengths)):
        own = slice(end - lengths[d], end)
        alone = structural_topics.posterior(n[own], beta[:, words[own]], mu[d], inverse)
        for x, y in zip(alone, (eta[d], around[d], counts[:, own], density[d])):
            assert x == pytest.approx(y, abs=1e-6)
    assert eta[1] == pytest.approx(mu[1]) and around[1] == pytest.approx(np.linalg.inv(inverse))
    base, amount = np.log(rng.dirichlet(np.full(40, 0.3)) + 1e-6), rng.uniform(2e3, 6e3, (2, 3))
    seen = rng.poisson(np.exp(base)[:, None, None] * amount * np.exp(rng.normal(0, 0.5, (40, 2, 3)))).astype(float)
    whole = structural_topics.sparse_rates(seen, base, amount)
    assert all((structural_topics.sparse_rates(seen[i : i + 1], base[i : i + 1], amount)[0] == pytest.approx(whole[i], rel=1e-9)) for i in range(40))


def test_documents_go_on_from_where_they_were(spark, monkeypatch):
    """From the second iteration on, documents' steps begin where the iteration before has left them, not at the prior's mean."""
    rng = np.random.default_rng(6)
    beta, lengths = rng.dirichlet(np.ones(30), 3), np.full(20, 30)
    words, mu, inverse = np.tile(np.arange(30), 20), rng.normal(0, 1, (20, 2)), np.array([[0.5, 0.1], [0.1, 0.4]])
    n = rng.integers(1, 20, len(words)).astype(float)
    cold = structural_topics.posteriors(n, beta[:, words], lengths, mu, inverse)
    warm = structural_topics.posteriors(n, beta[:, words], lengths, mu, inverse, cold[0] + 0.01)
    assert all(x == pytest.approx(y, abs=1e-5) for x, y in zip(cold, warm))
    seen = []
    with_words = structural_topics._Blocks.with_words
    monkeypatch.setattr(structural_topics._Blocks, "with_words", lambda self, model, etas=None: seen.append(etas and [len(r.etas) for r in etas.collect()]) or with_words(self, model, etas))
    v = bags(spark, [rng.multinomial(40, beta[i % 3]) for i in range(30)], 30, ["a"] * 30)
    structural_topics.fit_structural_topics(v, 2, iters=3)
    assert seen[0] is None and all(sum(s) == 30 for s in seen[1:])


def test_structural_topics_find_planted_effects(spark, monkeypatch):
    """Group b says word 1 for word 0 in the first topic; prevalence depends on the group and on a number."""
    monkeypatch.setattr(structural_topics, "BLOCK_WORDS", (500, 200))
    rng = np.random.default_rng(5)
    words = {g: np.array([[0.3, 0.02, 0.3, 0.3, 0.02, 0.02, 0.02, 0.02], [0.02, 0.02, 0.02, 0.02, 0.23, 0.23, 0.23, 0.23]]) for g in "ab"}
    words["b"][0, [0, 1]] = words["b"][0, [1, 0]]
    counts, groups, numbers = [], [], []
    for i in range(240):
        g, x = "ab"[i % 2], float(rng.uniform(-1, 1))
        share = 1 / (1 + np.exp(-rng.normal((0.7 if g == "a" else -0.7) + 1.5 * x, 0.7)))
        counts.append(rng.multinomial(80, np.array([share, 1 - share]) @ (words[g] / words[g].sum(axis=1, keepdims=True))))
        groups.append(g)
        numbers.append(x)
    counts += [np.zeros(8, int), np.array([0, 2, 0, 0, 0, 0, 0, 0])]
    groups, numbers = [*groups, "a", None], [*numbers, 0.5, 0.0]
    v = bags(spark, counts, 8, groups).join(spark.createDataFrame(list(enumerate(numbers)), "doc_id long, x double"), "doc_id").repartition(3).persist()
    terms = structural_topics.dummies(v.where("g is not null"), "g") | {"x": F.col("x")}
    model = structural_topics.fit_structural_topics(v, 2, terms, "g", iters=15)
    assert model.contents == [None, "a", "b"] and list(model.terms) == ["intercept", "g=b", "x"] and model.bounds[-1] > model.bounds[0]
    beta = model.beta()
    assert np.allclose(beta.sum(axis=2), 1)
    first = int(beta[1][:, 2:4].sum(axis=1).argmax())
    assert beta[1][first, 0] > 4 * beta[1][first, 1] and beta[2][first, 1] > 4 * beta[2][first, 0]
    sign = 1 if first == 0 else -1  # the last topic is the one that the others are compared with
    assert sign * model.gamma[1, 0] == pytest.approx(-1.4, abs=0.5) and sign * model.gamma[2, 0] == pytest.approx(1.5, abs=0.5)
    got = model.loadings(v, ["doc_id"]).toPandas().pivot(index="doc_id", columns="topic", values="loading")
    assert sorted(got.index) == list(range(242)) and (got.sum(axis=1) - 1).abs().max() < 1e-9
    assert got.loc[0:239:2, first].mean() > got.loc[1:239:2, first].mean() + 0.15
    assert got.loc[240].to_numpy() == pytest.approx(structural_topics.shares(np.array([1.0, 0.0, 0.5]) @ model.gamma))
    table = model.probabilities().groupBy("content", "topic").agg(F.sum("probability").alias("p")).collect()
    assert len(table) == 6 and all(r.p == pytest.approx(1) for r in table)
    # without a content covariate a topic has one distribution
    plain = structural_topics.fit_structural_topics(v, 2, iters=4)
    assert plain.beta().shape == (1, 2, 8) and np.allclose(plain.beta().sum(axis=2), 1) and len(plain.bounds) == 4
    v.unpersist()


# ------------------------------------------------------------------ topic maps


def test_topic_map_has_its_parts(spark):
    rng = np.random.default_rng(6)
    n = rng.integers(0, 40, (50, 3))
    n[7] = 0
    counts = spark.createDataFrame([(f"w{i:02d}", [int(x) for x in r]) for i, r in enumerate(n)], "word string, n array<long>").repartition(4)
    shares = topic_map.word_shares(counts, 3)
    phi = (n + 0.1) / (n.sum(axis=0) + 0.1 * 50)
    assert {r.word: tuple(r.p) for r in shares.collect()} == {f"w{i:02d}": pytest.approx(tuple(p)) for i, p in enumerate(phi)}
    parts = [0.2, 0.5, 0.3]
    got = json.loads(topic_map.topic_map(shares, parts, 1000.0, 5, 0.25))
    assert got["topic.order"] == [2, 3, 1] and got["mdsDat"]["Freq"] == pytest.approx([50, 30, 20]) and got["R"] == 5
    ordered = phi[:, [1, 2, 0]]
    far = np.zeros((3, 3))
    for a in range(3):
        for b in range(3):
            x, y = ordered[:, a], ordered[:, b]
            m = (x + y) / 2
            far[a, b] = (x * np.log(x / m)).sum() / 2 + (y * np.log(y / m)).sum() / 2
    place = np.array([got["mdsDat"]["x"], got["mdsDat"]["y"]]).T
    assert np.linalg.norm(place[:, None] - place[None], axis=2) == pytest.approx(far, abs=1e-9)  # three points fit on a plane
    p = phi @ parts
    terms = list(zip(*(got["tinfo"][c] for c in ("Term", "Category", "Freq", "Total", "logprob", "loglift"))))
    salient = p * sum(parts[t] * phi[:, t] / p * np.log(phi[:, t] / p) for t in range(3))
    assert {t[0] for t in terms if t[1] == "Default"} == {f"w{i:02d}" for i in np.argsort(-salient)[:5]}
    for t, k in enumerate((1, 2, 0)):
        want = set()
        for w in (0, 0.25, 0.5, 0.75, 1):
            want |= {f"w{i:02d}" for i in np.argsort(-(w * np.log(phi[:, k]) + (1 - w) * np.log(phi[:, k] / p)))[:5]}
        own = [x for x in terms if x[1] == f"Topic{t + 1}"]
        assert {x[0] for x in own} == want
        for word, _, freq, total, logprob, lift in own:
            i = int(word[1:])
            assert (freq, total, logprob, lift) == pytest.approx((1000 * parts[k] * phi[i, k], 1000 * p[i], math.log(phi[i, k]), math.log(phi[i, k] / p[i])))
    table = collections.defaultdict(float)
    for word, _, freq in zip(*(got["token.table"][c] for c in ("Term", "Topic", "Freq"))):
        table[word] += freq
    assert set(table) == {t[0] for t in terms} and all(x == pytest.approx(1, abs=2e-3) for x in table.values())


def test_shares_of_topics_and_scores(spark):
    loaded = spark.createDataFrame([(1, 0, 0.25), (1, 1, 0.75), (2, 0, 1.0), (2, 1, 0.0)], "d int, topic int, loading double")
    lengths = spark.createDataFrame([(1, 100), (2, 300)], "d int, length int")
    assert topic_map.proportions(loaded, lengths, ["d"], 3) == pytest.approx([325 / 400, 75 / 400, 0])
    counts = spark.createDataFrame([("same", [10, 10]), ("one", [10, 0]), ("other", [0, 10])], "word string, n array<long>")
    score = {r.word: r.score for r in topic_map.topic_scores(counts, 2).collect()}
    assert score["same"] == pytest.approx([0, 0], abs=1e-12) and score["one"][0] == pytest.approx(0.5 * (math.log(0.50001) - (math.log(0.50001) + math.log(1e-5)) / 2), rel=1e-3)
    assert [(r.topic, r.word) for r in topic_map.top_words(topic_map.topic_scores(counts, 2), "score", 1).orderBy("topic").collect()] == [(0, "one"), (1, "other")]


# ------------------------------------------------------------------ dictionaries and matches


def brute_closure(entries):
    form = {}
    for w, p in entries:
        form[w] = min(form.get(w, p), p)
    out = {}
    for w in form:
        path, at = [w], form[w]
        while at in form and at not in path:
            path.append(at)
            at = form[at]
        out[w] = (min(path[path.index(at) :]), None) if at in path else (at, len(path))
    return out


def test_dictionaries_are_closed(spark):
    rng = np.random.default_rng(11)
    for n in (1, 5, 40, 300):
        names = [f"w{i}" for i in range(n)]
        entries = [(str(rng.choice(names)), str(rng.choice(names)) if rng.random() < 0.8 else f"f-{rng.integers(9)}") for _ in range(n)]
        got = {r.word: (r.phon, r.steps) for r in translate.close_dictionary(spark.createDataFrame(entries, "word string, phon string")).collect()}
        assert got == brute_closure(entries)
    line = [(f"w{i:03d}", f"w{i + 1:03d}") for i in range(70)]  # a long chain
    assert {r.word: (r.phon, r.steps) for r in translate.close_dictionary(spark.createDataFrame(line, "word string, phon string")).collect()}["w000"] == ("w070", 70)
    own = translate.close_dictionary(spark.createDataFrame([("a", "a"), (None, "b"), ("c", None)], "word string, phon string")).collect()
    assert {r.word: (r.phon, r.steps) for r in own} == {"a": ("a", None), "c": (None, 1)}
    assert translate.close_dictionary(spark.createDataFrame([], "word string, phon string")).count() == 0


def test_substitutions_in_order(spark):
    """Entries are applied one after the other to every word, as a list of substitutions is."""
    rng = np.random.default_rng(12)
    names = [f"w{i}" for i in range(30)]
    entries = [(i, str(rng.choice(names)), str(rng.choice(names)) if rng.random() < 0.7 else f"f-{rng.integers(9)}") for i in range(60)]
    got = {r.word: r.phon for r in translate.close_dictionary(spark.createDataFrame(entries, "o int, word string, phon string"), "o").collect()}
    for w in {e[1] for e in entries}:
        now, first = w, set()
        for _, a, b in entries:
            if a in first:
                continue  # the first entry of a word counts
            first.add(a)
            now = b if now == a else now
        assert got[w] == now, w


def test_unknown_tokens_have_letters_and_are_no_forms(spark):
    d = spark.createDataFrame([("dog", "d-og"), ("é", "e")], "word string, phon string")
    docs = spark.createDataFrame([(1, "dog , d-og 12 !"), (2, "dog été"), (3, "é dog"), (4, "cat"), (5, "... 7"), (6, ""), (7, None)], "utt int, t string")
    got = {r.utt: (r.orth, r.phon, r.n_tokens, r.n_unknown) for r in translate.translate(docs, ["utt"], "t", d).collect()}
    assert got == {1: ("dog , d-og 12 !", "d-og , d-og 12 !", 5, 0), 3: ("é dog", "e d-og", 2, 0), 5: ("... 7", "... 7", 2, 0)}
    assert {r.utt: r.n_unknown for r in translate.translate(docs, ["utt"], "t", d, 0.5).collect()} == {1: 0, 2: 1, 3: 0, 5: 0}


def test_matches_of_whole_texts(spark):
    """The row that is given up after a match is the first one, not the one that matched."""
    left = spark.createDataFrame([("f", i, t) for i, t in enumerate(["b", "a", "b", None, "", "zz"])], "g string, o long, t string")
    right = spark.createDataFrame([("f", i, t) for i, t in enumerate(["x", "a", "b", "a", None, "b b"])], "g string, o long, u string")
    got = {r.left_order: r.right_order for r in translate.greedy_match(left, right, ["g"], "o", "t", "u").collect()}
    assert {k: None if v is None or v != v else int(v) for k, v in got.items()} == {0: 2, 1: 1, 2: 2, 3: None, 4: 3, 5: None}
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab "), 30)) for _ in range(60)]
    parts = list({t[a : a + int(rng.integers(1, 12))] for t in texts for a in rng.integers(0, 20, 5)}) + ["", "nowhere"]
    held = translate.places_of(parts, texts)
    assert {p: list(held[p]) for p in parts} == {p: [i for i, t in enumerate(texts) if p in t] for p in parts}


def test_keywords_on_word_boundaries(spark):
    words = spark.createDataFrame([("play", "pat-a-cake"), ("play", "peek_a_boo"), ("meal", "café"), ("talk", "that's"), ("talk", "hat"), ("none", "-x-"), ("none", ""), ("play", "Peek a  boo")], "context string, word string")
    texts = ["We play Pat-a-Cake!", "that's the hat's", "hats, pat a cake", "peek  a\nboo peek a boo", "CAFÉ cafés", "cafe -x-", "", None, "that'shat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "utt int, t string")
    got = {(r.utt, r.context): r.value for r in contexts.keyword_tags(docs, ["utt"], "t", words).collect()}
    assert got == {(0, "play"): 1, (1, "talk"): 2, (3, "play"): 1, (4, "meal"): 1}
    f = {r.context: (r.total, r.most, r.top_word) for r in descriptives.keyword_frequency(docs, "t", words).collect()}
    assert f == {"play": (3, 2, "peek a boo"), "meal": (1, 1, "café"), "talk": (2, 1, "hat")}
    assert contexts.keyword_tags(docs, ["utt"], "t", words.where("1 = 0")).count() == 0
    tagged = contexts.keyword_tags(docs, ["utt"], "t", words)
    tagged.collect()
    plan = tagged._jdf.queryExecution().executedPlan().toString()  # only what is found is shuffled, and once
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.split("Initial Plan")[0].count("hashpartitioning(utt") <= 1


# ------------------------------------------------------------------ statistics


def test_running_quantiles_by_definition(spark):
    rng = np.random.default_rng(7)
    values = np.round(rng.normal(size=300), 1)
    for p in (0.0, 0.025, 0.5, 0.975, 1.0):
        heap = windows.RunningQuantile(p)
        assert heap.value() is None
        for i, x in enumerate(values, 1):
            heap.add(float(x))
            assert heap.value() == pytest.approx(np.quantile(values[:i], p))
    rows = [(g, i, None if i % 7 == 3 else float(x)) for g in (None, "a") for i, x in enumerate(values[:60])] + [("b", 0, 1.0)]
    got = windows.running_quantiles(spark.createDataFrame(rows, "g string, o int, v double").repartition(3), ["g"], ["o"], "v", {"q": 0.3}, 5).collect()
    for r in got:
        seen = [v for g, o, v in rows if g == r.g and o <= r.o and v is not None]
        assert r.iteration == r.o + 1 and (r.q == pytest.approx(np.quantile(seen, 0.3)) if r.iteration >= 5 else r.q is None)
    assert len(got) == len(rows)


def test_a_long_sequence_takes_n_log_n():
    heap, rng = windows.RunningQuantile(0.975), np.random.default_rng(1)
    values = rng.random(1_000_000)
    for x in values.tolist():
        heap.add(x)
    assert heap.value() == pytest.approx(np.quantile(values, 0.975))


def test_tail_probabilities(spark):
    rows = [(x, float(k)) for x in (0.0, 0.01, 0.5, 3.84, 20.0, 80.0, 300.0) for k in (1, 2, 4, 40, 200)]
    d = spark.createDataFrame(rows, "x double, k double")
    for r in d.select("x", "k", stats.chi_square_upper(F.col("x"), F.col("k")).alias("p")).collect():
        want = math.erfc(math.sqrt(r.x / 2)) if r.k == 1 else math.exp(-r.x / 2) * sum((r.x / 2) ** i / math.factorial(i) for i in range(int(r.k / 2)))
        assert r.p == pytest.approx(want, rel=1e-9, abs=1e-14)
    t = spark.createDataFrame([(x, float(k)) for x in (0.0, 0.1, -1.4, 2.0, 12.0, 60.0) for k in (1, 2, 3, 1000)], "t double, k double")
    for r in t.select("t", "k", stats.student_t_two_sided(F.col("t"), F.col("k")).alias("p")).collect():
        a = abs(r.t)
        want = {1: 1 - 2 * math.atan(a) / math.pi, 2: 1 - a / math.sqrt(2 + a * a), 3: 1 - 2 / math.pi * (math.atan(a / math.sqrt(3)) + a / math.sqrt(3) / (1 + a * a / 3))}.get(int(r.k))
        if want is not None:
            assert r.p == pytest.approx(want, rel=1e-9, abs=1e-12)
    z = spark.createDataFrame([(0.0,), (1.96,), (-3.0,)], "z double").select("z", stats.normal_two_sided(F.col("z")).alias("p")).collect()
    assert all(r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=1e-9) for r in z)
    g = spark.createDataFrame([(0.5,), (1.0,), (7.25,), (1e5,)], "x double").select("x", stats.log_gamma(F.col("x")).alias("g")).collect()
    assert all(r.g == pytest.approx(math.lgamma(r.x), rel=1e-12, abs=1e-12) for r in g)


def test_places_of_patterns(spark):
    """Each place belongs to one pattern, in as many places as it has rows."""
    rows = [(0, 1)] * 13 + [(1, 0)] * 1 + [(1, 1)] * 30
    d = spark.createDataFrame(rows, "a int, b int")
    got = [(r.bucket, r.low, r.high, r.a, r.b) for r in agreement.pattern_ranges(d, ["a", "b"], 5).collect()]
    for place in range(44):
        own = [x for x in got if x[0] == place // 5 and x[1] <= place < x[2]]
        assert len(own) == 1 and own[0][3:] == ((0, 1) if place < 13 else (1, 0) if place == 13 else (1, 1))
    drawn = agreement.multiple_response_bootstrap(d.union(spark.createDataFrame([(None, 1)], "a int, b int")), ["a"], ["b"], 7).collect()
    assert len(drawn) == 7 and all(r.n == 44 for r in drawn)
