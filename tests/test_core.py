"""Golden cases, properties, and all queries against their SQL."""

import math
import numbers
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lexloom.functions import stats, text
from lexloom.functions.stemmer import stems
from lexloom.operators import agreement, contexts, models, ngrams, resample, segment, structural_topics, topic_search, translate, windows
from lexloom.plans import analysis
from lexloom.plans.queries import ORACLES, QUERIES
from lexloom.sources import readers, writers
from lexloom.streaming import windowed_counts

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def plain(df):
    cols = sorted(df.columns)
    cell = lambda x: "~" if x is None or x is pd.NA or (isinstance(x, float) and x != x) else repr(round(float(x), 5) + 0.0) if isinstance(x, numbers.Real) and not isinstance(x, bool) else str(x)
    return sorted(tuple(cell(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
    assert len(got) or name in ("min_support_contexts", "bigram_graph_edges", "sequence_marks")


def utterances(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "utt long, phon string")
    return df.select("utt", F.posexplode(text.syllables(F.col("phon"))).alias("i", "w"))


def test_bigrams_and_segmentation_golden_case(spark):
    tok = utterances(spark, ["a b", "a b-c", "a c"])
    table = ngrams.bigram_table(windows.bigrams(tok, ["utt"], "i", "w"))
    got = {(r.a, r.b): (r.ab, r.a1, r.b2, round(r.tp, 6), round(r.mi, 6)) for r in table.collect()}
    assert got == {("b", "c"): (1, 1, 2, 1.0, 1.0), ("a", "b"): (2, 3, 2, 0.666667, 0.415037), ("a", "c"): (1, 3, 2, 0.333333, -0.584963)}
    ranks = {(r.a, r.b): (r.tp_rank, r.mi_rank) for r in ngrams.bigram_ranks(table).collect()}
    assert ranks == {("b", "c"): (1, 1), ("a", "b"): (2, 2), ("a", "c"): (3, 3)}
    share = {r.w: r.share for r in ngrams.type_share(tok, "w").collect()}
    assert share == pytest.approx({"a": 1.0, "b": 2 / 3, "c": 2 / 3})
    for stat in ("tp", "mi"):
        found = segment.units(segment.boundaries(tok, table, [], ["utt"], "i", "w", stat), [], ["utt"], "i", "w")
        assert [r.phon for r in found.orderBy("utt", "unit_no").collect()] == ["a", "b", "a", "b-c", "a", "c"]
    units = segment.unit_table(found, [])
    d = spark.createDataFrame([("A", "a", 1, 3), ("B", "b", 1, 1), ("BC", "b-c", 2, 1), ("AC", "a-c", 2, 1)], "word string, phon string, n_syl long, freq long")
    scored = segment.assess(units, d, [])
    assert {(r.word, r.phon): r.result for r in scored.collect()} == {("A", "a"): "hit", ("B", "b"): "hit", ("BC", "b-c"): "hit", ("AC", "a-c"): "miss", (None, "c"): "false.alarm"}
    s = segment.scores(scored, []).first()
    assert (s.recall, s.precision) == (0.75, 0.75)
    assert {r.phon for r in segment.embedding_rule(units, []).collect()} == {"a", "b-c"}
    assert {r.phon for r in segment.unit_table(found, [], trisyl_limit=True).collect()} == {"a", "b", "c", "b-c"}


def test_tp_sums_to_one_and_units_give_the_stream_back(spark):
    c = spark.read.parquet(f"{SMALL}/conversations.parquet")
    tok = c.select("conv_id", "turn", F.posexplode(text.tokens(text.letters(F.col("text")))).alias("i", "w"))
    table = ngrams.bigram_table(windows.bigrams(tok, ["conv_id", "turn"], "i", "w"))
    assert table.groupBy("a").agg(F.sum("tp").alias("s")).where(F.abs(F.col("s") - 1) > 1e-9).count() == 0
    found = segment.units(segment.boundaries(tok, table, [], ["conv_id", "turn"], "i", "w", frequency_rule=True), [], ["conv_id", "turn"], "i", "w")
    assert found.agg(F.sum("n_syl")).first()[0] == tok.count()


def flags(spark, hits, n):
    return spark.createDataFrame([(i, int(i in hits), "f") for i in range(1, n + 1)], "pos long, hit int, file string")


def test_windows_golden_cases(spark):
    df = flags(spark, {3, 4, 9}, 12)
    assert [r.expanded for r in windows.expand_windows(df, "hit", ["file"], ["pos"]).orderBy("pos").collect()] == [1.5, 1.5, 1, 1, 1.5, 1.5, 1.5, 1.5, 1, 1.5, 1.5, 0]
    assert [r.x for r in df.select("pos", windows.within_k("hit", ["file"], ["pos"], 2, "lag").alias("x")).orderBy("pos").collect()] == [0, 0, 0, 1, 1, 1, 0, 0, 0, 1, 1, 0]
    df = flags(spark, {1, 2, 3, 7, 8}, 10)
    assert sorted(r.chunk_length for r in windows.islands(df, "hit", ["file"], "pos").collect()) == [2, 3]
    assert sorted(r.chunk_length for r in windows.islands(df, "hit", ["file"], "pos", True).collect()) == [1, 3]
    r = windows.continuity(df, "hit", ["file"], "pos").first()
    assert (r.n_hits, r.n_chunks, r.mean_distance, r.min_length, r.max_length) == (5, 2, 1.75, 2, 3)
    df = flags(spark, {1, 2, 9}, 10)
    assert windows.islands(df, "hit", ["file"], "pos").count() == 2 and windows.islands(df, "hit", ["file"], "pos", True).count() == 1
    files = spark.createDataFrame([("a", i) for i in range(65)] + [("b", i) for i in range(30)], "file string, pos long")
    assert sorted(r["count"] for r in windows.tumbling(files, ["file"], ["pos"]).groupBy("file", "window").count().collect()) == [5, 30, 30, 30]


def test_contexts_golden_cases(spark):
    long = spark.createDataFrame([(1, "x", 0.4), (2, "x", 0.6), (3, "x", 0.8), (1, "y", 0.1)], "utt long, context string, value double")
    assert [(r.utt, r.value) for r in contexts.apply_threshold(long, 0.6).orderBy("utt").collect()] == [(1, 0), (2, 0), (3, 1)]
    assert contexts.apply_threshold(long, 0.6, inclusive=True).where("value = 1").count() == 2
    wide = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, None, 1)], "utt long, bath int, meal int")
    assert [r.context for r in contexts.extract_context(wide, ["bath", "meal"]).orderBy("utt").collect()] == ["bath", "ambiguous", "no context tag", "meal"]
    assert {r.utt for r in contexts.remove_ambiguous(wide, ["bath", "meal"]).collect()} == {1, 3}
    codes = spark.createDataFrame([(1, "bath ; play;  "), (2, None)], "utt long, context string")
    assert sorted(r.code for r in contexts.explode_codes(codes, ["utt"], "context").collect()) == ["bath", "play"]
    key = spark.createDataFrame([("bath", "b")], "raw string, clean string")
    assert [r.code for r in contexts.new_codes(spark.createDataFrame([("bath",), ("zoo",)], "c string"), "c", key, "raw").collect()] == ["zoo"]
    votes = contexts.to_wide(contexts.to_long(wide, ["utt"]), ["utt"], ["bath", "meal"])
    assert [r.bath for r in votes.orderBy("utt").collect()] == [1.0, 1.0, 0.0, None]


def test_codes_of_all_lines_of_a_text(spark, tmp_path):
    rows = [(1, "bath, play\r\nmeal.;\n\nnap"), (2, None), (3, ";".join(map(str, range(12))) + "\nlast")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in QUERIES["split_explode_codes"](spark, str(tmp_path)).collect())
    assert got == sorted([(1, 1, "bath"), (1, 1, "play"), (1, 2, "meal"), (1, 4, "nap"), *((3, 1, str(i)) for i in range(10)), (3, 2, "last")])


def test_statistics_golden_cases(spark):
    df = spark.createDataFrame([(float(v), 3.0, "g") for v in (1, 2, 3, 4)], "value double, est double, g string")
    r = stats.bootstrap_test(df, "value", "est", ["g"]).first()
    assert (r.n_above, r.n_below, r.p_hi, r.p_lo, r.p_boot_unsure) == (2, 2, 0.5, 0.5, None)
    for by in (["g"], None):
        assert stats.with_z(df, "value", "est", by).first().z_est == pytest.approx(0.3872983, abs=1e-6)
    one = spark.range(1).select(stats.pbinom(F.lit(5), F.lit(200), 0.025).alias("a"), stats.pbinom(F.lit(120), F.lit(5000), 0.025).alias("b"), stats.student_t_two_sided(F.lit(2.0), F.lit(10.0)).alias("t"), text.p_text(F.lit(0.0421)).alias("p"), text.harmonic(F.lit(1.0), F.lit(0.5)).alias("f")).first()
    assert (one.a, one.b) == pytest.approx((0.6159700, 0.3462035), abs=1e-6) and one.t == pytest.approx(0.0733880, abs=1e-6) and one.p == "p = 0.042" and one.f == pytest.approx(2 / 3)
    ranked = stats.global_rank(spark.range(1000).repartition(7), [F.col("id").desc()], "r")
    assert ranked.where("r <> 1000 - id").count() == 0 and stats.global_rank(spark.range(0), [F.col("id")], "r").count() == 0


def test_agreement_golden_case(spark):
    rows = [(1, "A", "bath"), (2, "A", "bath"), (3, "A", "meal"), (1, "B", "x"), (3, "B", "y"), (4, "B", "y")]
    codes = spark.createDataFrame(rows, "utt long, method string, context string")
    assert {(r.a, r.b): r.n for r in agreement.method_pairs(codes, ["utt"], "A", "B").collect()} == {("bath", "x"): 1, ("bath", "none"): 1, ("meal", "y"): 1, ("none", "y"): 1}
    t = spark.createDataFrame([("a", "x", 10), ("a", "y", 20), ("b", "x", 30), ("b", "y", 5)], "p string, q string, n long")
    r = agreement.chi_square(t, "p", "q").first()
    want = 65 * (10 * 5 - 20 * 30) ** 2 / (30 * 35 * 40 * 25)
    assert r.chi2 == pytest.approx(want) and r.dof == 1 and r.p_value == pytest.approx(math.erfc(math.sqrt(want / 2)), rel=1e-9)
    assert r.report.startswith("chi2(1, N = 65)") and r.report.endswith(f"V = {math.sqrt(want / 65):.2f}")
    many = agreement.chi_square(t.withColumn("g", F.lit("x")).union(t.withColumn("g", F.lit(None))).union(spark.createDataFrame([("a", "x", 5, "one"), (None, "x", 0, "one")], "p string, q string, n long, g string")), "p", "q", by=["g"]).collect()
    assert {m.g: (round(m.chi2, 9), m.dof) for m in many} == {"x": (round(want, 9), 1), None: (round(want, 9), 1), "one": (0.0, 0)}


def test_permutation_keeps_counts_and_does_not_depend_on_partitions(spark):
    elements = spark.range(50).select(F.col("id").alias("utt"))
    long = spark.createDataFrame([(i, c, 1) for i in range(20) for c in ("x", "y")][:30], "utt long, context string, value int")
    a = resample.permute(long, elements, ["utt"], 3)
    b = resample.permute(long.repartition(5), elements.repartition(3), ["utt"], 3)
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}
    assert {tuple(r) for r in a.groupBy("iter", "context").count().collect()} == {(i, c, 15) for i in range(3) for c in ("x", "y")}


def test_few_draws_give_no_stars_that_they_cannot_support(spark):
    observed = spark.createDataFrame([("x", 1e9)], "context string, ttr double")
    marks = {}
    for n in (5, 20, 50, 2000):
        null = spark.range(n).select(F.col("id").alias("iter"), F.lit("x").alias("context"), (F.col("id") % 7).cast("double").alias("ttr"))
        r = analysis.compare_with_null(observed, null)[1].first()
        marks[n] = (r.p_val, r.stars)
    assert marks == {5: (0.0, ""), 20: (0.0, "+"), 50: (0.0, "*"), 2000: (0.0, "***")}


def test_permutation_deals_any_value(spark):
    elements = spark.range(200).select(F.col("id").alias("utt"))
    long = spark.createDataFrame([(i, "x", v) for i, v in enumerate([1.0, 1.5, 0.25, None, 0.0, 0.7] * 10)] + [(i, "y", 1.0) for i in range(200)], "utt long, context string, value double")
    rows = resample.permute(long, elements, ["utt"], 4).collect()
    want = sorted(str(v) for v in [1.0, 1.5, 0.25, None, 0.7] * 10)
    for it in range(4):
        mine = [r for r in rows if r.iter == it and r.context == "x"]
        assert sorted(str(r.value) for r in mine) == want and len({r.utt for r in mine}) == 50
        assert len([r for r in rows if r.iter == it and r.context == "y"]) == 200
    assert len({tuple(sorted(r.utt for r in rows if r.iter == it and r.context == "x")) for it in range(4)}) == 4


def test_artificial_corpus(spark):
    d, u = resample.make_corpus(spark, 90, 50)
    assert d.count() == 90 and d.select(F.explode(F.split("phon", "-")).alias("s")).distinct().count() == d.agg(F.sum("n_syl")).first()[0] == 270
    words = u.select(F.size(F.split("phon", " ")).alias("n")).groupBy("n").count().collect()
    assert {r.n for r in words} <= {3, 4} and sum(r.n * r["count"] for r in words) == d.agg(F.sum("freq")).first()[0]
    assert sorted(r.n_syl for r in d.orderBy(F.desc("freq")).limit(12).collect()) != [2] * 4 + [3] * 4 + [4] * 4  # ranks are shuffled
    flat, said = resample.make_corpus(spark, 300, 400, skewed=False, monosyllabic=True, shortest_first=True)
    assert {r.freq for r in flat.collect()} == {5} and said.count() == 375 and {r.n_syl for r in flat.collect()} == {1, 2, 3}
    whole, short = resample.make_corpus(spark, 1200, 400)
    assert short.select(F.size(F.split("phon", " ")).alias("n")).where("n = 4").count() >= short.count() - 3 and whole.where("freq = 0").count() > 0
    with pytest.raises(ValueError):
        resample.make_corpus(spark, 1800)


def test_quantiles_by_rank(spark):
    rng = np.random.default_rng(5)
    rows = [(str(g), float(v)) for g in range(5) for v in np.round(rng.normal(size=int(rng.integers(1, 90))), 1)] + [("0", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r.g: (r.a, r.b, r.c) for r in stats.grouped_quantiles(df, ["g"], "v", {"a": 0.0, "b": 0.37, "c": 1.0}).collect()}
    for g in got:
        v = [x for k, x in rows if k == g and x is not None]
        assert got[g] == pytest.approx(tuple(np.quantile(v, [0, 0.37, 1])))
    assert stats.grouped_quantiles(df, [], "v", {"m": 0.5}).first().m == pytest.approx(np.median([x for _, x in rows if x is not None]))


def test_cutoffs_by_selection(spark):
    rng = np.random.default_rng(8)
    sets = {"a": rng.normal(size=500), "b": 10.0 ** rng.uniform(-300, 300, 90), "c": np.repeat([1.0, 2.0], [7, 3]), "d": np.array([5.0]), "e": np.array([-1.7e308, 1.7e308, 0.0, 5e-324, 1.0]), None: rng.integers(0, 4, 60).astype(float)}
    rows = [(k, float(v)) for k, vs in sets.items() for v in vs] + [("a", None), ("z", None)]
    df = spark.createDataFrame(rows, "`g k` string, v double").withColumn("w", -F.col("v")).withColumn("_v", F.lit(0)).repartition(5)
    wanted = {"lo": ("v", 0.0), "x": ("v", 0.37), "med": ("w", 0.5), "hi": ("v", 1.0)}
    got = {r[0]: tuple(r[1:]) for r in stats.cutoffs(df, ["g k"], wanted, bins=64).collect()}
    assert got.pop("z") == (None,) * 4 and set(got) == set(sets)
    for k, vs in sets.items():
        sure = ["a", "c", "d", None]
        if k in sure:
            assert got[k] == pytest.approx((vs.min(), np.quantile(vs, 0.37), np.median(-vs), vs.max()), rel=1e-12), k
        else:
            assert (got[k][0], got[k][3]) == (vs.min(), vs.max()), k
    assert stats.cutoffs(df.where("false"), [], wanted).collect() == [(None,) * 4] and stats.cutoffs(df.where("false"), ["g k"], wanted).count() == 0
    odd = spark.createDataFrame([(float(x),) for x in ["-inf", "-inf", 1, 2, 3, "inf", "nan"]], "v double")
    assert [stats.cutoffs(odd, [], {"q": ("v", i / 6)}).first().q for i in range(6)] == [float("-inf"), float("-inf"), 1, 2, 3, float("inf")]


def test_logistic_regressions_match_reweighted_least_squares(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.3 + x @ [1.0, -0.5])))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)] + [(None, 1.0, 1.0)], "a double, b double, y double")
    z = np.column_stack(((x - x.mean(0)) / x.std(0, ddof=1), np.ones(400)))
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ beta))
        w = p * (1 - p)
        beta = beta + np.linalg.solve(z.T @ (z * w[:, None]), z.T @ (y - p))
    errors = np.sqrt(np.diag(np.linalg.inv(z.T @ (z * w[:, None]))))
    rows = {r.term: r for r in models.logistic_regressions(df, ["y"], ["a", "b"], min_n=-1e9).collect()}
    for i, term in enumerate(["a", "b", "(intercept)"]):
        assert (rows[term].estimate, rows[term].std_error) == pytest.approx((beta[i], errors[i]), rel=1e-4)
        assert rows[term].p_value == pytest.approx(math.erfc(abs(beta[i] / errors[i]) / math.sqrt(2)), abs=1e-6)


def test_multiple_response_test(spark):
    rng = np.random.default_rng(7)
    rows = [(int(a), int(a if rng.random() < 0.9 else 1 - a), int(rng.random() < 0.5)) for a in rng.integers(0, 2, 200)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    alike, apart = agreement.multiple_response_test(df, ["a"], ["b"], 100).first(), agreement.multiple_response_test(df, ["a"], ["c"], 100).first()
    t = np.array([[sum(x == i and y == j for x, y, _ in rows) for j in (0, 1)] for i in (0, 1)], float)
    e = np.outer(t.sum(1), t.sum(0)) / 200
    assert alike.statistic == pytest.approx(((t - e) ** 2 / e).sum()) and alike.p_value == pytest.approx(1 / 101) and apart.p_value > 0.01 and alike.iters == 100


def test_whole_analysis_options(spark):
    rows = [(f"u{i}", "f", i, "ba du", "b-a d-u") if i % 2 else (f"u{i}", "f", i, "ba", "b-a") for i in range(1, 41)]
    utts = spark.createDataFrame(rows, "utt string, file string, pos int, orth string, phon string")
    words = spark.createDataFrame([("ba", "b-a"), ("du", "d-u")], "word string, phon string")
    whole = analysis.run_analysis(utts, None, words, stats_used=("tp",)).first()
    assert (whole.context, whole.n_utts, whole.n_tokens, whole.n_types, whole.n_syl_tokens, whole.recall) == ("global", 40, 60, 2, 120, 0.5)  # all pairs have a probability of 1, so "ba du" is one unit
    assert whole.mean_words_per_utt == 1.5 and whole.prop_one_word_utt == 0.5 and whole.prop_one_syl_utt == 0.0 and whole.n_segd_units == 2
    sizes = analysis.run_analysis(utts, None, words, stats_used=("mi",), by_size=(3, 10)).collect()
    assert {r.context: r.n_utts for r in sizes} == {"N.utt10": 10, "N.utt20": 20, "N.utt30": 30}
    shares = utts.select("utt", F.lit("x").alias("context"), F.lit(0.5).alias("value"))
    assert 5 < analysis.run_analysis(utts, shares, words, stats_used=("tp",), prop=True).first().n_utts < 35
    with pytest.raises(ValueError):
        analysis.run_analysis(utts, shares, words, prop=True, expand=2)
    trend = {r.context: (r.trend, r.prop_diff) for r in analysis.results_descriptives(spark.createDataFrame([("a", "tp", 1, 10, 2, 5, 0, 0, 0), ("b", "tp", 1, 10, 2, 15, 0, 0, 0), ("c", "tp", 1, 10, 2, 10, 0, 0, 0)], "context string, stat string, n_utts int, n_tokens int, n_types int, n_segd_units int, hits int, misses int, false_alarms int")).collect()}
    assert trend == {"a": ("under", 0.5), "b": ("over", 0.5), "c": (None, 0.0)}


def test_stream_and_global_windows_cross_sequences(spark):
    tok = utterances(spark, ["a b", "c"])
    assert {(r.a, r.b) for r in windows.stream_bigrams(tok, ["utt", "i"], "w").collect()} == {("a", "b"), ("b", "c")}
    sizes = windows.global_tumbling(spark.range(70).repartition(5), ["id"]).groupBy("window").count().collect()
    assert {r["window"]: r["count"] for r in sizes} == {0: 30, 1: 30, 2: 10}


def test_markdown_says_what_it_leaves_out(spark):
    assert writers.markdown(spark.range(150)).count("\n") == 151
    assert writers.markdown(spark.range(150), 100).endswith("(the first 100 rows)") and not writers.markdown(spark.range(100), 100).endswith(")")


def test_test_coders_end_the_query_where_asked(spark, tmp_path):
    (tmp_path / "coding_doc.txt").write_text("LineNum\tUttNum\tfile\tcoder\tdate\tcontext\tpass\n1\t1\tf\tTEST\t1\tq\t1\n")
    assert readers.coding_documents(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="test coders"):
        readers.coding_documents(spark, str(tmp_path), test_coders="error").collect()


def test_greedy_matches_by_brute_force(spark):
    rng = np.random.default_rng(8)
    left = [("f" if i < 40 else "g", i, str(rng.choice(list("abc")))) for i in range(80)]
    right = [("f" if i < 70 else "g", i, "".join(rng.choice(list("abcd"), 2))) for i in range(140)]
    got = {(r.f, r.left_order): r.right_order for r in translate.greedy_match(spark.createDataFrame(left, "f string, o long, t string"), spark.createDataFrame(right, "f string, o long, u string"), ["f"], "o", "t", "u").collect()}
    want = {}
    for f in "fg":
        rest = [r for r in right if r[0] == f]
        for _, o, t in (x for x in left if x[0] == f):
            at = next((i for i, r in enumerate(rest) if t in r[2]), None)
            want[f, o] = None if at is None else rest[at][1]
            rest = rest if at is None else rest[1:]  # one row is given up, whichever has matched
    assert {k: None if v is None or v != v else int(v) for k, v in got.items()} == want


def test_latent_classes_find_two_groups(spark):
    rows = [(1, 1, 1, 0)] * 40 + [(1, 1, 0, 0)] * 6 + [(0, 0, 0, 1)] * 40 + [(0, 1, 0, 1)] * 6 + [(None, 1, 1, 0)] * 4
    fits, classes, posteriors = models.latent_classes(spark.createDataFrame(rows, "a int, b int, c int, d int"), ["a", "b", "c", "d"], [1, 2], 5)
    assert fits.orderBy("bic_rank").first().k == 2 and classes.where("k = 2").agg(F.sum("prob")).first()[0] == pytest.approx(8.0)
    assert {r["class"] for r in posteriors.where("k = 2 and a = '1'").collect()} != {r["class"] for r in posteriors.where("k = 2 and a = '0'").collect()}


def test_topics(spark):
    v, vocabulary = models.vectorise(spark.read.parquet(f"{SMALL}/documents.parquet").where("lang = 'en'").limit(60), "text")
    model = models.fit_topics(v, 3, 3)
    assert models.top_words(model, vocabulary, 5).count() == 15
    total = models.loadings(model, v, ["doc_id"]).groupBy("doc_id").agg(F.sum("loading").alias("s"))
    assert total.where(F.abs(F.col("s") - 1) > 1e-6).count() == 0


def test_topics_are_fitted_on_every_token_of_every_document(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    v, vocabulary = models.vectorise(docs.select("doc_id", "text"), "text")
    v = v.persist()
    tokens = v.select(F.explode(vector_to_array("counts")).alias("n")).agg(F.sum("n")).first()[0]
    # the topics hold the prior and each token once
    assert models.fit_topics(v, 3, 2).topicsMatrix().toArray().sum() == pytest.approx(tokens + 0.1 * 3 * len(vocabulary), rel=1e-6)
    v.unpersist()
    got = QUERIES["lda_loadings"](spark, SMALL).groupBy("doc_id").agg(F.sum("loading").alias("s")).toPandas()
    assert sorted(got["doc_id"]) == sorted(r[0] for r in docs.select("doc_id").distinct().collect()) and (got["s"] - 1).abs().max() < 1e-6


def test_search_for_a_number_of_topics(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("lang = 'en'").select("doc_id", "text")
    v = models.vectorise(docs.union(spark.createDataFrame([(-1, "")], "doc_id long, text string")), "text")[0].select("doc_id", "counts").persist()
    split = topic_search.hold_out_words(v, ["doc_id"], 0.3).persist()
    whole = {r.doc_id: r.counts.toArray() for r in v.collect()}
    rows = split.collect()
    held = [r for r in rows if r.held is not None]
    assert sorted(r.doc_id for r in rows) == sorted(whole) and 0.15 * len(rows) < len(held) < 0.45 * len(rows)
    for r in rows:
        taken = r.held.toArray() if r.held is not None else 0
        assert (r.counts.toArray() + taken == whole[r.doc_id]).all()
        assert r.held is None or taken.sum() == whole[r.doc_id].sum() // 2
    model = models.fit_topics(split, 3, 4)
    beta, got = topic_search.topic_words(model), topic_search.diagnostics(model, split)
    theta = {r.doc_id: np.array(r.theta) for r in model.transform(split).select("doc_id", models.topic_shares().alias("theta")).collect()}
    best = [sorted(range(beta.shape[1]), key=lambda w: (-b[w], w))[:10] for b in beta]
    n = np.array([r.counts.toArray() for r in rows if r.counts.toArray().any()])
    rank = lambda x: pd.Series(x).rank().to_numpy() / len(x)
    exclusive = [sum(1 / (0.7 / rank(b / beta.sum(axis=0))[w] + 0.3 / rank(b)[w]) for w in top) for b, top in zip(beta, best)]
    coherent = [sum(math.log((((n[:, a] > 0) & (n[:, b] > 0)).sum() + 0.01) / ((n[:, b] > 0).sum() + 0.01)) for i, a in enumerate(top) for b in top[:i]) for top in best]
    likely = [np.average(np.log(theta[r.doc_id] @ beta), weights=r.held.toArray()) for r in held if r.held.toArray().any()]
    q = np.array([theta[r.doc_id] @ beta for r in rows if r.counts.toArray().any()])
    mean = q * n.sum(axis=1, keepdims=True)
    free = (mean > 0.01).sum() - beta.shape[1] - (len(n) * 2 + 3 * (beta.shape[1] - 1))
    # the squared residuals over the variances of the counts
    want = {"exclusivity": np.mean(exclusive), "coherence": np.mean(coherent), "held_out": np.mean(likely), "residual": ((n - mean) ** 2 / (mean * (1 - q))).sum() / free}
    assert got == pytest.approx(want, rel=1e-6)
    found = topic_search.search_k(v, ["doc_id"], [2, 3], runs=2, iters=2).collect()
    assert [(r.k, r.run, r.iterations) for r in found] == [(2, 1, 2), (3, 1, 2), (2, 2, 2), (3, 2, 2)]
    assert all(r.lbound == pytest.approx(r.bound + math.log(math.factorial(r.k))) for r in found)


def test_steps_of_structural_topics_match_brute_force():
    rng = np.random.default_rng(3)
    beta, n = rng.dirichlet(np.ones(6), 2), rng.integers(0, 9, 6).astype(float)
    mu, inverse = np.array([0.4]), np.array([[0.5]])
    eta, around, counts, density = structural_topics.posterior(n, beta, mu, inverse)
    grid = np.linspace(-8, 8, 160_001)
    theta = 1 / (1 + np.exp(-grid))
    values = np.log(theta[:, None] * beta[0] + (1 - theta)[:, None] * beta[1]) @ n - 0.25 * (grid - 0.4) ** 2
    best = values.argmax()
    assert eta[0] == pytest.approx(grid[best], abs=1e-3) and density == pytest.approx(values[best], abs=1e-6)
    curve = (values[best - 100] + values[best + 100] - 2 * values[best]) / (100 * (grid[1] - grid[0])) ** 2
    assert around[0, 0] == pytest.approx(-1 / curve, rel=1e-3) and counts.sum(axis=0) == pytest.approx(n)
    eta, _, _, _ = structural_topics.posterior(np.zeros(0), beta[:, :0], mu, inverse)
    assert eta == pytest.approx(mu)


def test_vocabulary_has_every_term_of_three_documents(spark):
    name = F.translate(F.col("id").cast("string"), "0123456789", "bcdfghjklm")
    words = spark.range(20_500).select(F.concat(F.lit("q"), name).alias("w")).agg(F.array_join(F.collect_list("w"), " ").alias("text"))
    docs = words.crossJoin(spark.range(3)).union(spark.createDataFrame([("zebra qb", 3), ("zebra qb", 4)], "text string, id long"))
    assert len(models.vectorise(docs, "text")[1]) == 20_500


def test_translation_and_matching(spark):
    d = translate.first_entries(spark.createDataFrame([(0, "polly", "p-1"), (1, "polly", "p-2"), (2, "b", "bb")], "o int, word string, phon string"), order="o")
    assert [(r.phon, r.n_unknown) for r in translate.translate(spark.createDataFrame([(1, "polly b"), (2, "polly zz")], "utt long, t string"), ["utt"], "t", d).collect()] == [("p-1 bb", 0)]
    up = translate.update_dictionary(d.select("word", "phon"), spark.createDataFrame([("bee", "b")], "word string, old_word string"), spark.createDataFrame([("c", "cc")], "word string, phon string"))
    assert {r.word for r in up.collect()} == {"polly", "b", "bee", "c"}
    left = spark.createDataFrame([("f", 1, "a"), ("f", 2, "b"), ("f", 3, "a")], "file string, o long, t string")
    right = spark.createDataFrame([("f", 1, "xa"), ("f", 2, "xb"), ("f", 3, "b")], "file string, o long, u string")
    assert [r.right_order for r in translate.greedy_match(left, right, ["file"], "o", "t", "u").orderBy("left_order").collect()] == [1, 2, None]


def test_long_words_are_translated_whole(spark, tmp_path):
    word = "ab" + "c" * 1500
    spark.createDataFrame([(1, word)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, "user", word)], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [r.phon for r in QUERIES["dictionary_translate"](spark, str(tmp_path)).collect()] == ["AB-" + "C" * 1500]


def test_transliteration(spark):
    r = spark.createDataFrame([("@h",)], "w string").select(text.transliterate(F.col("w"), {"@": "eh", "h": "hh"}).alias("a"), text.transliterate_sequential(F.col("w"), {"@": "eh", "h": "hh"}).alias("b")).first()
    assert r.a == "eh hh" and r.b == "ehh  hh"


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "ab12.cha").write_text("@Begin\n@Comment:\tc\n*MOT:\tlook at: that .\n%com:\tx\n*CHI:\thi\n\tmore\n@New Episode\n")
    rows = readers.chat_transcripts(spark, str(tmp_path / "*.cha")).orderBy("line_num").collect()
    assert [(r.line_num, r.speaker, r.utterance, r.utt_num) for r in rows] == [(2, "@Com", "c", None), (3, "*MOT", "look at: that .", 1), (4, "%com", "x", None), (5, "*CHI", "hi", 2), (7, "@New Ep", "...", None)]
    assert readers.chat_transcripts(spark, str(tmp_path / "*.cha"), True).where("utt_num = 2").first().utterance == "hi more"
    assert readers.coding_template(readers.chat_transcripts(spark, str(tmp_path / "*.cha"))).count() == 6
    (tmp_path / "k.csv").write_text("cat,word,context\rx,bath_tub,bath\rx,dog,NA\rx,cat,\r")
    assert [tuple(r) for r in readers.keyword_list(spark, str(tmp_path / "k.csv")).collect()] == [("bath", "bath tub")]
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "coding_doc1.txt").write_text("LineNum\tUttNum\tfile\tcoder\tdate\tcontext\tpass\n1\t1\tf\tAB\t1400000000\tBath, Play/x\t1\n1\t1\tf\tTEST\t1\tq\t1\n")
    assert [r.context for r in readers.coding_documents(spark, str(tmp_path / "d")).collect()] == ["bath; play;x"]
    (tmp_path / "output" / "bathEval").mkdir(parents=True)
    (tmp_path / "output" / "bathEval" / "n500_1.trscore").write_text("p r\n0.5 0.25\n")
    assert [(r.context, r.p, r.r) for r in readers.score_tables(spark, str(tmp_path / "output"), ["p", "r"]).collect()] == [("bath", 0.5, 0.25)]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "meal.out").write_text("x\nP 1 R 0.5 F 0.6 BP 0.7\nP 0 R 0.5 F 0.6 BP 0.9\n")
    (tmp_path / "logs" / "bad.out").write_text("x\n")
    assert {r.context: (r.P, r.BP) for r in readers.score_logs(spark, str(tmp_path / "logs")).collect()} == {"meal": (0.5, pytest.approx(0.8)), "bad": (None, None)}
    (tmp_path / "a.txt").write_text("x\ny\n")
    (tmp_path / "b.txt").write_text("u\nv\nw\n")
    assert [tuple(r) for r in readers.aligned_lines(spark, {"a": str(tmp_path / "a.txt"), "b": str(tmp_path / "b.txt")}).orderBy("line").collect()] == [(0, "x", "u"), (1, "y", "v"), (2, None, "w")]
    out = str(tmp_path / "out")
    writers.context_corpora(spark.createDataFrame([("a-b", "bath", 1), ("c", "bath", 0), ("d", "meal", 1)], "phon string, context string, value int"), out, "phon")
    assert sorted(os.listdir(out))[-2:] == ["context=bath", "context=meal"] and spark.read.text(out).where("context = 'bath'").first().value == "a-b"
    writers.tsv(spark.range(2), str(tmp_path / "t"))
    assert readers.delimited(spark, str(tmp_path / "t"), "id long").count() == 2
    assert writers.markdown(spark.range(1)).splitlines()[0] == "| id |" and readers.grid(spark, k=[1, 2], i=[1, 2, 3]).count() == 6


def test_windowed_counts_on_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "ts", "event_type", F.col("value")).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == events.count()


def test_utterance_ids_and_small_functions(spark):
    parts = text.file_parts(F.col("u"))
    r = spark.createDataFrame([("ab12.cha_7",)], "u string").select(*(c.alias(k) for k, c in parts.items()), text.number_word(F.lit(3), True).alias("w"), text.n_syllables(F.lit("a-b-c")).alias("n"), text.checksum_matches(F.lit("x"), "11f6ad8").alias("ok")).first()
    assert tuple(r) == ("ab", 12, 7, "Three", 3, True)


def test_coding_documents_are_repaired_and_reopened(spark):
    doc = spark.createDataFrame([(1, "RM", 5, "bath", 1), (2, "AB", 5, "bath", 1), (3, None, None, None, 1), (4, "AB", 5, "x", 1)], "utt long, coder string, date long, context string, pass int")
    fixed = contexts.repair_rows(doc)
    assert [r.coder for r in fixed.orderBy("utt").collect()] == [None, "AB", None, None]
    assert [(r.utt, r.n_coders) for r in contexts.coder_counts(fixed, ["utt"]).collect()] == [(2, 1)]
    df = spark.createDataFrame([("f", i, 0 if i == 3 else 5) for i in range(8)], "file string, pos long, n int")
    assert [r.open for r in windows.needs_coding(df, ["file"], ["pos"], "n", 5, 1).orderBy("pos").collect()] == [False, False, True, True, True, False, False, False]


def test_stems(spark):
    # pairs of the algorithm's published vocabulary, and its exceptions
    pairs = """consigned consign, consistency consist, consolatory consolatori, consolidated consolid, conspicuously conspicu, conspirator conspir, constancy constanc, knackeries knackeri, knavish knavish, kneaded knead,
    kneeled kneel, knightly knight, knitting knit, knives knive, knotted knot, knowledge knowledg, cries cri, ties tie, gas gas, kiwis kiwi, hopping hop, hoping hope, luxuriating luxuri, generously generous, by by, say say,
    cry cri, enjoy enjoy, youth youth, boyish boyish, relational relat, sky sky, dying die, proceeded proceed, agreed agre, bled bled, controlling control, beautiful beauti, electricity electr, analogies analog"""
    words, want = zip(*(p.split() for p in pairs.split(",")))
    df = spark.createDataFrame([(1, list(words)), (2, []), (3, None), (4, ["'", "'s'", "", "é"])], "i int, w array<string>")
    assert [r[0] for r in df.orderBy("i").select(stems(F.col("w"))).collect()] == [list(want), [], None, ["'", "s", "", "é"]]
    docs = spark.createDataFrame([(i, "Running dogs ran; a dog runs.") for i in range(3)], "i int, text string")
    assert sorted(models.vectorise(docs, "text", stemmed=True)[1]) == ["dog", "ran", "run"]
