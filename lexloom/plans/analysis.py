"""Whole analyses: segmentation of all contexts at once, null distributions of descriptives, convergence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions import stats, text
from lexloom.operators import descriptives, ngrams, resample, segment, windows
from lexloom.scratch import Scratch, ship_package

#: Utterances in a block, and draws in one at most, of those whose words are counted for many draws at once.
UNITS, DRAWS = 2000, 256
MEASURES = ["n_utts", "n_tokens", "n_types", "highest_freq", "ttr", "prop_highest", "mean_per_utt", "prop_one"]


def context_tokens(utterances: DataFrame, long: DataFrame, utt: str = "utt", phon: str = "phon", name: str = "context", value: str = "value") -> DataFrame:
    """(context, utt, i, syl): the syllables of every utterance once for each context that it has."""
    marked = by_context(utterances.select(utt, phon), long.where(F.col(value) > 0), utt, name)
    return marked.select(utt, name, F.posexplode(text.syllables(F.col(phon))).alias("i", "syl"))


def by_context(utterances: DataFrame, long: DataFrame, utt: str | list[str] = "utt", name: str = "context") -> DataFrame:
    """The utterances, once for each context that ``long`` (utt, context) has for them. Contexts are gathered in a row for each
    utterance and joined to whole utterances, before these are taken apart; marks are as many as utterances, so the join is
    a sorted one, not a broadcast, however well a table of marks compresses."""
    named = long.groupBy(utt).agg(F.collect_set(name).alias("_contexts"))
    return utterances.join(named.hint("merge"), utt).withColumn(name, F.explode("_contexts")).drop("_contexts")


def run_analysis(utterances: DataFrame, long: DataFrame | None, dictionary: DataFrame, cutoff: float = 0.85, stats_used: tuple[str, ...] = ("tp", "mi"), frequency_rule: bool = False, embedding: bool = False, trisyl_limit: bool = False, freq_cutoff: float | None = None, expand: int | None = None, permute: int | None = None, by_size: tuple[int, int] | None = None, prop: bool = False, order: str = "pos", seed: str = "s") -> DataFrame:
    """Recall and precision of segmentation per context and statistic, with descriptives: context, stat, recall, precision,
    hits, misses, false_alarms, n_segd_units (distinct units found), n_utts, n_syl_tokens, n_syl_types, n_tokens and
    n_types (of words), ttr, highest_freq_syl, prop_most_freq, mean_tp, mean_mi, mean_words_per_utt, mean_syls_per_utt,
    prop_one_word_utt, prop_one_syl_utt.

    utterances: utt, file, pos, orth, phon. long: utt, context, value; without it the whole corpus is one context "global".
    dictionary: word, phon. All contexts run together, with the context as leading key. ``by_size`` (sizes, least) takes
    random contexts of growing size instead of ``long``; ``prop`` turns probabilities into marks by chance; ``permute`` deals
    each context to random utterances with that seed number; ``expand`` spreads a context to the k utterances on either
    side. Artificial corpora come from resample.make_corpus, which has the numbers of types and utterances."""
    if expand and prop:
        raise ValueError("expand needs marks of 1, not probabilities")
    scratch = Scratch(utterances.sparkSession, "analysis")
    if by_size:
        long = resample.contexts_by_size(utterances, ["utt"], *by_size, seed).select("utt", F.concat(F.lit("N.utt"), F.col("size")).alias("context"), F.lit(1.0).alias("value"))
    if long is None:
        long = utterances.select("utt", F.lit("global").alias("context"), F.lit(1.0).alias("value"))
    if prop:
        long = resample.bernoulli(long, ["utt"], seed)
    if permute is not None:
        long = resample.permute(long, utterances, ["utt"], 1, f"{seed}{permute}").drop("iter")
    if expand:
        # as windows.expand_windows does for a column, for all contexts of an utterance at once
        named = long.where("value = 1").groupBy("utt").agg(F.collect_set("context").alias("_own"))
        near = Window.partitionBy("file").orderBy(order).rowsBetween(-expand, expand)
        spread = utterances.select("utt", "file", order).join(named.hint("merge"), "utt", "left").select("utt", F.array_distinct(F.flatten(F.collect_list("_own").over(near))).alias("_near"))
        long = spread.select("utt", F.explode("_near").alias("context"), F.lit(1.0).alias("value"))
    long = scratch.put(long.where("value > 0").select("utt", "context", "value").distinct(), "contexts")
    words = text.drop_punctuation_tokens(text.tokens(F.col("orth")))
    none = F.array().cast("array<string>")
    marked = by_context(utterances.select("utt", "phon", "orth"), long).select("context", "utt", F.coalesce(text.syllables(F.col("phon")), none).alias("syls"), F.coalesce(words, none).alias("words"))
    rows = scratch.put(marked, "rows")  # an utterance and context stays a row, from which tokens are made where they are counted
    table = scratch.put(ngrams.bigram_table(segment.neighbours(rows, ["context"], "syls"), ["context"]), "bigrams")
    orth = scratch.put(rows.select("context", F.explode("words").alias("word")).groupBy("context", "word").agg(F.count("*").alias("freq")), "types")
    words = orth.join(dictionary.select("word", "phon"), "word")
    words = scratch.put(words.withColumn("n_syl", text.n_syllables(F.col("phon")).cast("long")), "words")
    syl = scratch.put(rows.select("context", F.explode("syls").alias("phon")).groupBy("context", "phon").agg(F.count("*").alias("freq")), "syllables")
    counts = _descriptives(long, rows, orth, table, syl)
    found = segment.units_of_rows(rows.select("context", "utt", "syls"), table, ["context"], ["utt"], "syls", stats_used, cutoff, frequency_rule)
    all_units = scratch.put(segment.unit_table(found, ["context", "stat"]), "units")
    out: DataFrame | None = None
    for stat in stats_used:
        units = segment.filter_units(all_units.where(F.col("stat") == stat).drop("stat"), ["context"], syl, freq_cutoff, trisyl_limit)
        if embedding:
            units = segment.embedding_rule(units, ["context"])
        s = segment.scores(segment.assess(units, words, ["context"]), ["context"]).withColumn("stat", F.lit(stat))
        s = s.join(units.groupBy("context").agg(F.countDistinct("phon").alias("n_segd_units")), "context", "left")
        out = s if out is None else out.unionByName(s)
    return out.join(counts, "context").select("context", "stat", "recall", "precision", "hits", "misses", "false_alarms", "n_segd_units", *[c for c in counts.columns if c != "context"])


def _descriptives(long: DataFrame, rows: DataFrame, orth: DataFrame, table: DataFrame, syl: DataFrame) -> DataFrame:
    """A row per context; utterances without a syllable or word count 0."""
    one = lambda c: F.avg((F.col(c) == 1).cast("double"))
    sizes = rows.select("context", "utt", F.size("syls").alias("s"), F.size("words").alias("w")).unionByName(long.select("context", "utt", F.lit(0).alias("s"), F.lit(0).alias("w")))
    per = sizes.groupBy("context", "utt").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    utts = per.groupBy("context").agg(F.count("*").alias("n_utts"), F.avg("w").alias("mean_words_per_utt"), F.avg("s").alias("mean_syls_per_utt"), one("w").alias("prop_one_word_utt"), one("s").alias("prop_one_syl_utt"))
    syls = syl.groupBy("context").agg(F.sum("freq").alias("n_syl_tokens"), F.count("*").alias("n_syl_types"))
    words = orth.groupBy("context").agg(F.sum("freq").alias("n_tokens"), F.count("*").alias("n_types"))
    pairs = table.groupBy("context").agg(F.greatest(F.max("a1"), F.max("b2")).alias("highest_freq_syl"), F.avg("tp").alias("mean_tp"), F.avg("mi").alias("mean_mi"))
    out = utts.join(syls, "context", "left").join(words, "context", "left").join(pairs, "context", "left")
    out = out.withColumn("ttr", F.try_divide("n_types", "n_tokens")).withColumn("prop_most_freq", F.try_divide("highest_freq_syl", "n_syl_tokens"))
    return out.select("context", "n_utts", "n_syl_tokens", "n_syl_types", "n_tokens", "n_types", "ttr", "highest_freq_syl", "prop_most_freq", "mean_tp", "mean_mi", "mean_words_per_utt", "mean_syls_per_utt", "prop_one_word_utt", "prop_one_syl_utt")


def results_descriptives(results: DataFrame) -> DataFrame:
    """Results of run_analysis with criterion, trend (under- or over-segmentation) and the proportional difference of the
    numbers of units and word tokens."""
    trend, diff = segment.segmentation_trend(F.col("n_segd_units"), F.col("n_tokens"))
    out = results.select("context", F.upper("stat").alias("criterion"), "n_utts", "n_tokens", "n_types", "n_segd_units", "hits", "misses", "false_alarms")
    return out.withColumn("trend", trend).withColumn("prop_diff", diff)


def observed_descriptives(utterances: DataFrame, long: DataFrame, keys: list[str], words: str, name: str = "context") -> DataFrame:
    """(context, measures): descriptives of the contexts as they are. ``words`` is an array of tokens; rows with the same keys
    are one utterance."""
    scratch = Scratch(utterances.sparkSession, "observed")
    rows = by_context(utterances.select(*keys, words), long, keys, name).select(name, *keys, F.explode(words).alias("_token"))
    return scratch.put(descriptives.describe(rows, [name], keys, "_token"), "measures")  # a row per context


def null_descriptives(utterances: DataFrame, long: DataFrame, keys: list[str], words: str, iters: int, seed: str = "s", name: str = "context", value: str = "value") -> DataFrame:
    """(iter, context, measures): descriptives of contexts dealt to random utterances with tokens, as ``resample.permute`` deals
    them, all iterations in one plan. ``words`` is an array of tokens; rows with the same keys are one utterance.

    Neither marks nor tokens are copied for each draw, an iteration and context. Utterances and draws come in blocks; a task has
    a block of draws and sees all utterances for it, twice: to find the last utterance that each draw takes, and to count."""
    spark = utterances.sparkSession
    ship_package(spark)
    scratch, cores = Scratch(spark, "null"), max(1, spark.sparkContext.defaultParallelism)
    known = utterances.select(*keys, words).dropna(subset=keys).where(F.size(words) > 0)
    said = known.select(*keys, F.explode(words).alias("_token")).groupBy(*keys, "_token").agg(F.count("*").alias("_n"))
    said = scratch.put(said, "said")
    types = scratch.put(stats.global_rank(said.select("_token").distinct(), [F.col("_token")], "_t").select("_token", (F.col("_t") - 1).cast("int").alias("_t")), "types")
    units = scratch.put(stats.global_rank(said.select(*keys).distinct(), [F.col(k) for k in keys], "place"), "units")
    width, total = types.count(), units.count()
    after = F.concat_ws("|", *(F.col(k).cast("string") for k in keys))
    per = said.join(types, said["_token"].eqNullSafe(types["_token"])).groupBy(*keys).agg(F.sum("_n").alias("size"), F.array_sort(F.collect_list(F.struct("_t", "_n"))).alias("tokens"))
    per = per.join(units, keys).select(F.pmod(F.xxhash64("place"), F.lit(max(1, -(-total // UNITS)))).alias("_b"), F.struct("place", after.alias("after"), "size", "tokens").alias("u"))
    each = lambda f: F.transform("us", f)
    flat = lambda c: F.flatten(each(lambda u: F.transform(u["tokens"], lambda t: t[c])))
    lists = per.groupBy("_b").agg(F.collect_list("u").alias("us")).select(each(lambda u: u["place"]).alias("places"), each(lambda u: u["after"]).alias("after"), each(lambda u: u["size"]).alias("sizes"), each(lambda u: F.size(u["tokens"])).alias("lengths"), flat("_t").alias("tokens"), flat("_n").alias("counts"))
    blocks = scratch.put(lists, "blocks")

    cells = long.where(F.col(value).isNull() | (F.col(value) != 0)).where(F.col(name).isNotNull())
    sizes = scratch.put(cells.groupBy(name).agg(F.count("*").alias("n")), "sizes")  # a row per context
    at_once = max(1, min(DRAWS, descriptives.CELLS // max(1, width), -(-iters * sizes.count() // (2 * cores))))
    order = Window.orderBy("iter", name)  # a row per iteration and context
    begin = F.concat(F.lit(f"{seed}|"), F.col("iter").cast("string"), F.lit("|"), F.col(name), F.lit("|"))
    draws = spark.range(iters).select(F.col("id").alias("iter")).crossJoin(F.broadcast(sizes)).withColumn("draw", F.row_number().over(order) - 1)
    draws = scratch.put(draws.withColumn("block", F.floor(F.col("draw") / at_once)).withColumn("before", begin), "draws")
    some = draws.where(F.col("n") < total)  # the others take all units
    last = resample.last_dealt(blocks, some.groupBy("block").agg(F.collect_list("draw").alias("draws"), F.collect_list("before").alias("before"), F.collect_list("n").alias("sizes")), total)
    top = F.lit(-1).cast("long")  # all bits: no hash is above
    whole = draws.where(F.col("n") >= total).select("draw", top.alias("first"), top.alias("last"), top.alias("place"))
    ends = draws.join(last.unionByName(whole), "draw").groupBy("block").agg(*(F.collect_list(c).alias(d) for c, d in (("draw", "draws"), ("before", "before"), ("first", "firsts"), ("last", "lasts"), ("place", "last_places"))))
    counts = scratch.put(descriptives.describe_draws(blocks, ends, width), "counts")
    named = types.select(F.col("_t").cast("long").alias("highest"), F.col("_token").alias("highest_token"))
    out = draws.select("draw", "iter", name).join(counts, "draw").join(named, "highest").drop("draw", "highest")
    out = out.withColumn("ttr", F.col("n_types") / F.col("n_tokens")).withColumn("prop_highest", F.col("highest_freq") / F.col("n_tokens"))
    out = scratch.put(out, "measures")  # a row per iteration and context, read several times
    scratch.keep("measures")
    return out


def compare_with_null(observed: DataFrame, null: DataFrame, measures: list[str] | None = None, name: str = "context") -> tuple[DataFrame, DataFrame]:
    """(values, tests): null values with the observed estimate and Z-scores, and a bootstrap test per context and
    measure with marks of significance. n draws can't show a level below 1/n, so p is taken as 1/n at least for these."""
    measures = measures or [m for m in MEASURES if m in observed.columns]
    doubled = lambda df, keys, v: df.select(*keys, *(F.col(m).cast("double").alias(m) for m in measures)).unpivot(keys, measures, "measure", v)
    values = doubled(null, ["iter", name], "value").join(doubled(observed, [name], "est"), [name, "measure"])
    values = stats.with_z(values, "value", "est", [name, "measure"])
    tests = stats.bootstrap_test(values, "value", "est", [name, "measure"])
    return values, tests.withColumn("stars", text.stars(F.greatest("p_val", 1 / F.col("iters"))))


def convergence(samples: DataFrame, value: str, copies: int, size: int, order: str, ps: dict[str, float] | None = None, tol: float = 1.0, seed: str = "s") -> DataFrame:
    """How estimates settle when samples are drawn again: (copy, draw, iteration, running_mean, quantiles, and for each of
    them whether it is within ``tol`` of that of all samples, the corridor of stability). From 39 draws on a two-sided test
    at .05 has room for an extreme value, so quantiles begin there."""
    ps = ps or {"hi": 0.975, "lo": 0.025}
    numbered = stats.global_rank(samples, [F.col(order)], "_at").withColumn("_at", F.col("_at") - 1).select("_at", value)
    drawn = resample.bootstrap(numbered, "_at", copies, size, seed)
    out = windows.running_quantiles(windows.running_mean(drawn, ["copy"], ["draw"], value), ["copy"], ["draw"], value, ps)
    whole = samples.agg(F.avg(value).alias("_m")).crossJoin(F.broadcast(stats.cutoffs(samples, [], {f"_{n}": (value, p) for n, p in ps.items()})))
    near = {"running_mean": "_m", **{n: f"_{n}" for n in ps}}
    out = out.crossJoin(F.broadcast(whole))  # one row
    return out.select("copy", "draw", "iteration", value, *near, *((F.abs(F.col(n) - F.col(m)) <= tol).alias(f"{n}_stable") for n, m in near.items()))


def clean_results(results: DataFrame, cutoff: int = 85) -> DataFrame:
    """Long results of several experiments (exp, context, stat, recall, precision): criterion (statistic and cutoff), dist,
    the last four alphanumerics of the experiment's name in lower case (null if there are not as many), measure and
    value."""
    dist = F.lower(F.nullif(F.regexp_extract("exp", r"([\p{Alpha}0-9]{4})$", 1), F.lit("")))
    out = results.withColumn("criterion", F.concat(F.col("stat"), F.lit(str(cutoff)))).withColumn("dist", dist)
    keys = ["exp", "dist", "context", "criterion", "stat"]
    return out.select(*keys, "recall", "precision").unpivot(keys, ["recall", "precision"], "measure", "value")


def against_nontext(values: DataFrame, tests: DataFrame, measure: str, name: str = "context") -> DataFrame:
    """What a plot of contexts against their null needs: the null's Z values, the estimate's Z and the stars."""
    return values.where(F.col("measure") == measure).join(tests.select(name, "measure", "p_val", "stars"), [name, "measure"]).select(name, "iter", F.col("z_value").alias("null_z"), F.col("z_est").alias("z"), "p_val", "stars")


def word_cloud(tokens: DataFrame, token: str, least: int = 0) -> DataFrame:
    """Words with their counts, of at least ``least``."""
    return tokens.groupBy(token).agg(F.count("*").alias("freq")).where(F.col("freq") >= least)


def sequence_marks(long: DataFrame, method: str, least: int = 0) -> DataFrame:
    """Marks of a method's contexts that have more than ``least`` of them, for plots along the discourse."""
    own = long.where((F.col("method") == method) & (F.col("value") > 0))
    return own.join(own.groupBy("context").agg(F.count("*").alias("n")).where(F.col("n") > least).select("context"), "context", "left_semi")


def coding_progress(coded: DataFrame, keys: list[str], order: str, n: str, size: int = 30) -> DataFrame:
    """What a plot of the state of coding needs: per sequence and window of ``size`` positions the least and mean number of
    codes, and how many positions have none."""
    at = windows.tumbling(coded, keys, [order], size)
    return at.groupBy(*keys, "window").agg(F.min(order).alias("first"), F.min(n).alias("least"), F.avg(n).alias("mean"), F.count_if(F.coalesce(F.col(n), F.lit(0)) == 0).alias("open"))


def segmentation_points(assessed: DataFrame, by: list[str]) -> DataFrame:
    """What a plot of segmentation results needs: per unit or word its result, syllables, frequency and rank by frequency
    in its group."""
    shown = assessed.select(*by, "phon", "n_syl", "result", "freq")
    w = Window.partitionBy(*by, "result").orderBy(F.col("freq").desc(), "phon")
    return shown.withColumn("rank", F.row_number().over(w))
