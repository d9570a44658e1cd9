"""Steps that have to hold at sizes beyond the test tables: no overflow, no broadcast of what grows, few shuffles."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lexloom.functions import stats
from lexloom.operators import agreement, descriptives, models, ngrams, resample, segment, topic_map, topic_search, variational_topics, windows
from lexloom.plans import analysis, source_queries
from lexloom.plans.queries import ORACLES, QUERIES

from tests.conftest import SMALL


def test_multiple_responses_of_many_rows(spark):
    n = 400_000
    df = spark.range(n).select((F.col("id") % 2).cast("int").alias("a"), (F.col("id") % 4 < 2).cast("int").alias("b"), (F.col("id") % 4 % 3 == 0).cast("int").alias("c"))
    got = agreement.multiple_response_statistic(df, ["a"], ["b", "c"]).first()  # a is independent of b and of c
    assert got.n == n and got.statistic == 0
    same = agreement.multiple_response_statistic(df.withColumn("d", F.col("a")), ["a"], ["d"]).first()
    assert abs(same.statistic - n) < 1e-6
    draws = agreement.multiple_response_bootstrap(df.limit(1000), ["a"], ["b"], 3)
    assert sorted((r["iter"], r.n) for r in draws.collect()) == [(0, 1000), (1, 1000), (2, 1000)]


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_share_of_contexts_among_the_elements_of_one(spark):
    rows = [(1, "x", 1), (1, "a", 1), (1, "b", 0), (2, "x", 1), (2, "a", 1), (2, "a", 2), (3, "a", 5), (4, "x", 0), (4, "a", 7), (None, "x", 1), (None, "a", 9), (5, "x", 1), (5, "x", 1)]
    long = spark.createDataFrame(rows, "id int, context string, value int")
    d = descriptives.percent_match(long, ["id"], "x", ["a", "b", "x", "nowhere"])
    # elements 1, 2, 5 and the one without an id have x; a null id joins with nothing
    assert {r.context: r.share for r in d.collect()} == {"a": 4 / 4, "b": 0.0, "x": 4 / 4}
    assert "Join" not in plan_of(d)
    assert descriptives.percent_match(long, ["id"], "nowhere", ["a"]).count() == 0


def test_marks_spread_and_join_without_broadcast(spark):
    utts = spark.createDataFrame([(f"{f}{i}", f, i, "ba du", "b-a d-u") for f in "fg" for i in range(6)], "utt string, file string, pos int, orth string, phon string")
    marks = spark.createDataFrame([("f1", "p", 1.0), ("f3", "q", 1.0), ("f3", "q", 1.0), ("g5", "p", 1.0), ("g0", "q", 0.0), ("g1", "p", 0.4)], "utt string, context string, value double")
    words = spark.createDataFrame([("ba", "b-a"), ("du", "d-u")], "word string, phon string")
    got = {r.context: (r.n_utts, r.n_tokens, r.n_syl_tokens) for r in analysis.run_analysis(utts, marks, words, stats_used=("tp",), expand=1).collect()}
    assert got == {"p": (5, 10, 20), "q": (3, 6, 12)}
    tokens = analysis.context_tokens(utts, marks)
    assert sorted((r.utt, r.context, r.i) for r in tokens.collect()) == sorted((u, c, i) for u, c in (("f1", "p"), ("f3", "q"), ("g5", "p"), ("g1", "p")) for i in range(4))
    assert "Broadcast" not in plan_of(tokens)


def test_beta_function_is_one_column(spark):
    df = spark.range(3).select(F.lit(0.5).alias("x"), (F.col("id") + 1.0).alias("a"), F.lit(0.5).alias("b"))
    p = df.select(stats.beta_lower(F.col("x"), F.col("a"), F.col("b")).alias("p"))
    assert "aggregate(" not in plan_of(p) and plan_of(p).count("fraction(") <= 6  # no term of the fraction is written out
    assert abs(p.first().p - (1 - 0.5**0.5)) < 1e-12
    assert df.where("id > 5").select(stats.beta_lower(F.col("x"), F.col("a"), F.col("b"))).count() == 0


def test_topics_of_many_documents_at_once(spark):
    rng = np.random.default_rng(2)
    x = np.array([0.05, 0.1, 0.7, 3.0, 40.0, 1e6])
    assert variational_topics.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12)
    assert variational_topics.digamma(x) == pytest.approx([(math.lgamma(v * 1.0001) - math.lgamma(v * 0.9999)) / (v * 0.0002) for v in x], rel=1e-5)
    beta, lengths = rng.dirichlet(np.ones(12), 3), np.array([1, 7, 12, 3])
    words, counts = np.concatenate([rng.choice(12, n, False) for n in lengths]), rng.integers(1, 50, lengths.sum()).astype(float)
    gamma, theta, shares = variational_topics.topics_of(words, counts, lengths, beta, 0.1, 1e-9)
    for d, end in enumerate(np.cumsum(lengths)):
        own = slice(end - lengths[d], end)
        assert shares[own] == pytest.approx(theta[d] @ beta[:, words[own]])
        assert gamma[d] == pytest.approx(0.1 + theta[d] * (beta[:, words[own]] * (counts[own] / shares[own])).sum(axis=1), rel=1e-6)
    rows = [(i, Vectors.sparse(20, {i % 2 * 10 + int(w): 1.0 + int(w) % 3 for w in rng.choice(10, 6, False)})) for i in range(60)] + [(60, Vectors.sparse(20, {}))]
    docs = spark.createDataFrame(rows, ["id", "counts"]).repartition(7)
    model = models.fit_topics(docs, 2)
    found = {r.id: np.array(r.topicDistribution) for r in model.transform(docs).collect()}
    assert found[60].tolist() == [0.5, 0.5] and len({int(found[i].argmax()) for i in range(0, 60, 2)} | {1 - int(found[i].argmax()) for i in range(1, 60, 2)}) == 1
    tokens = sum(r[1].values.sum() for r in rows)
    sums, bound, n = variational_topics.one_pass(docs, model)
    assert n == tokens and sums.sum() == pytest.approx(tokens) and bound == pytest.approx(variational_topics.one_pass(docs.repartition(1), model)[1])
    assert model.iterations < 200 and bound > variational_topics.one_pass(docs, models.fit_topics(docs, 2, 1))[1]


def test_units_of_rows_are_those_between_boundaries(spark):
    rng = np.random.default_rng(5)
    rows = [(g, i, [str(w) for w in rng.choice(list("abcde"), int(rng.integers(0, 9)))]) for g in ("p", "q", None) for i in range(25)]
    utts = spark.createDataFrame(rows, "g string, utt int, s array<string>")
    tokens = utts.select("g", "utt", F.posexplode("s").alias("i", "w"))
    table = ngrams.bigram_table(segment.neighbours(utts, ["g"], "s"), ["g"]).persist()
    same = ngrams.bigram_table(windows.bigrams(tokens, ["g", "utt"], "i", "w"), ["g"])
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, same.collect()))
    for rule in (False, True):
        both = segment.units_of_rows(utts, table, ["g"], ["utt"], "s", ("tp", "mi"), 0.6, rule)
        for stat in ("tp", "mi"):
            want = segment.units(segment.boundaries(tokens, table, ["g"], ["g", "utt"], "i", "w", stat, 0.6, rule), ["g"], ["g", "utt"], "i", "w")
            columns = ["g", "utt", "unit_no", "phon", "n_syl"]
            got = both.where(F.col("stat") == stat).select(columns).collect()
            assert sorted(map(str, got)) == sorted(map(str, want.select(columns).collect())) and (rule or any(r.n_syl > 1 for r in got))
    plan = plan_of(both)
    assert "Window" not in plan and plan.count("_pair") > 0  # tokens are not put in order again


def test_logs_are_not_written_by_one_task(spark):
    plan = source_queries.logged_runs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and f", {spark.conf.get('spark.sql.shuffle.partitions')})" in plan


def test_sums_over_all_words_without_a_step_for_each():
    rng = np.random.default_rng(3)
    beta = rng.dirichlet(np.full(20_000, 0.02), 3)
    every = topic_search.AllWords(beta)
    assert every.likely < 3 / topic_search.LEAST and len(every.peak) == 20_000
    for m, theta in ((1.0, [1.0, 0.0, 0.0]), (250.0, [0.2, 0.3, 0.5]), (1e6, [0.98, 0.01, 0.01])):
        q = np.array(theta) @ beta
        assert every.odds(np.array(theta)) == pytest.approx((q / (1 - q)).sum(), rel=1e-8)
        assert every.expected(np.array(theta), m, 0.01) == (q * m > 0.01).sum()


def test_words_of_a_topic_are_not_ranked_in_one_task(spark):
    rows = [(f"w{i:03d}", [i % 7, (i * i) % 11]) for i in range(300)]
    counts = spark.createDataFrame(rows, "word string, n array<long>").repartition(5)
    ranked = counts.select("word", F.posexplode("n").alias("topic", "x"))
    want = {tuple(r) for r in ranked.withColumn("rank", stats.average_rank(["topic"], F.col("x"))).select("topic", "x", "rank").distinct().collect()}
    assert {tuple(r) for r in stats.value_ranks(ranked, ["topic"], "x").collect()} == want
    labels = topic_map.topic_labels(counts, 2)
    assert "rank(" not in plan_of(labels).replace("row_number", "").replace("frank", "")
    assert labels.groupBy("measure", "topic").count().where("count <> 7").count() == 0


def test_contexts_are_dealt_and_counted_without_copies_of_tokens(spark, monkeypatch):
    monkeypatch.setattr(descriptives, "CELLS", 100)  # tokens are counted in several parts
    said = [(f"c{i % 7}", f"{i}", [f"w{(i * j) % 11}" for j in range(1 + i % 5)]) for i in range(60)]
    said += [("c1", "1", ["again", "w1"]), (None, "9", ["lost"]), ("c0", None, ["lost"] * 3), ("c9", "90", []), ("c9", "91", None)]
    said += [("x|" * i + "x", "x" + "|x" * (200 - i), ["same", f"w{i % 3}"]) for i in range(200)]  # all have the same hash
    marks = [(c, t, "some") for c, t, _ in said[:25]] + [(c, t, "half") for c, t, _ in said[:130]] + [(c, t, "all") for c, t, _ in said] + [("c0", "0", "one"), (None, "9", "one"), ("c0", "0", None)]
    utterances = spark.createDataFrame(said, "conv string, turn string, words array<string>").repartition(3)
    long = spark.createDataFrame([(*m, v) for m in marks for v in (1, 0)], "conv string, turn string, context string, value int")
    null = analysis.null_descriptives(utterances, long, ["conv", "turn"], "words", 4)
    own: dict[tuple[str, str], list[str]] = {}
    for c, t, words in said:
        if words and c and t:
            own[c, t] = own.get((c, t), []) + words
    want = {}
    for it in range(4):
        for context in ("some", "half", "all", "one"):
            n = sum(m[2] == context for m in marks)
            drawn = sorted(own, key=lambda k: (hashlib.md5(f"s|{it}|{context}|{k[0]}|{k[1]}".encode()).hexdigest(), k))[:n]  # noqa: B023
            freq = Counter(w for k in drawn for w in own[k])
            total, top = sum(freq.values()), max(freq.values())
            want[it, context] = (len(drawn), total, len(freq), top, min(w for w in freq if freq[w] == top), total / len(drawn), sum(len(own[k]) == 1 for k in drawn) / len(drawn), len(freq) / total, top / total)
    got = {(r.iter, r.context): (r.n_utts, r.n_tokens, r.n_types, r.highest_freq, r.highest_token, r.mean_per_utt, r.prop_one, r.ttr, r.prop_highest) for r in null.collect()}
    assert got == want
    assert "Join" not in plan_of(null) and "Exchange" not in plan_of(null)  # made once, however often it is read
    assert analysis.null_descriptives(utterances, long.where("value > 1"), ["conv", "turn"], "words", 4).count() == 0
    assert analysis.null_descriptives(utterances.where("turn = '-'"), long, ["conv", "turn"], "words", 4).count() == 0


def test_keyword_frequency_takes_a_text_apart_once(spark):
    docs = spark.createDataFrame([(0, "the cat of the hat " * 4000), (1, ""), (2, None)], "i int, t string")
    words = spark.createDataFrame([("article", "the"), ("relation", "of_the")], "context string, word string")
    found = descriptives.keyword_frequency(docs, "t", words)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
    assert {r.context: r.total for r in found.collect()} == {"article": 8000, "relation": 4000}


def test_many_hashes_at_once():
    before = [b"", b"s|1|place|", b"s|12|place|", b"s|13|place|", b"x" * 50, "s|1|für|".encode()]
    after = [b"", b"1|2", b"123456|78", b"y" * 5, b"y" * 6, b"z" * 200]
    first, last = resample.many_chances(before, after)
    assert [[f"{a:016x}{b:016x}" for a, b in zip(*r)] for r in zip(first.tolist(), last.tolist())] == [[hashlib.md5(b + a).hexdigest() for a in after] for b in before]


def test_null_descriptives_has_the_draws_of_the_reference(spark):
    assert "range(5000)" in ORACLES["null_descriptives"]
    assert {r.iters for r in QUERIES["null_descriptives"](spark, SMALL).select("iters").collect()} == {5000}


def test_topics_of_documents_without_a_model_on_the_driver(spark, monkeypatch):
    """No fit whose words x topics numbers are on the driver is made, and the planted topics are found."""
    monkeypatch.setattr(variational_topics, "one_pass", None)
    monkeypatch.setattr(models, "vectorise", None)
    rng = np.random.default_rng(4)
    own = ["apple pear plum grape".split(), "stone iron steel copper".split()]
    rows = [(i, " ".join(rng.choice(own[i % 2], 30))) for i in range(60)] + [(60, ""), (61, "apple once")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = models.document_loadings(docs, ["doc_id"], "text", 2).toPandas().pivot(index="doc_id", columns="topic", values="loading")
    assert sorted(got.index) == list(range(62)) and np.allclose(got.sum(axis=1), 1) and list(got.loc[60]) == [0.5, 0.5]
    first = int(got.loc[0].to_numpy().argmax())
    assert (got.loc[0:59:2, first] > 0.95).all() and (got.loc[1:59:2, first] < 0.05).all()
    assert len(QUERIES["lda_loadings"](spark, SMALL).select("doc_id").distinct().collect()) == 200
