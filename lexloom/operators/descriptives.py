"""Descriptive statistics of (sub-)corpora, all contexts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions.stats import cutoffs, standard_error
from lexloom.operators.contexts import keyword_grams, listed_keywords
from lexloom.operators.resample import many_chances

# Counts that a task holds at once, of tokens times draws.
CELLS = 1 << 24


def describe(tokens: DataFrame, by: list[str], unit: list[str], token: str) -> DataFrame:
    """Per context: utterances, tokens, types, type-token ratio, the most frequent token (ties: smallest) and its
    share, mean length of utterances and share of those with one token."""
    unit = [u for u in unit if u not in by]
    per_unit = tokens.groupBy(*by, *unit).agg(F.count("*").alias("k"))
    lengths = per_unit.groupBy(*by).agg(F.count("*").alias("n_utts"), F.avg("k").alias("mean_per_utt"), F.avg((F.col("k") == 1).cast("double")).alias("prop_one"))
    freq = tokens.groupBy(*by, token).agg(F.count("*").alias("f"))
    # the token is the largest by frequency, then the smallest by name: two plain aggregates in one pass
    types = freq.groupBy(*by).agg(F.sum("f").alias("n_tokens"), F.count("*").alias("n_types"), F.max("f").alias("highest_freq"))
    first = freq.join(F.broadcast(types.select(*by, F.col("highest_freq").alias("f"))), [*by, "f"], "left_semi").groupBy(*by).agg(F.min(token).alias("highest_token"))
    out = lengths.join(types, by).join(first, by)
    return out.withColumn("ttr", F.col("n_types") / F.col("n_tokens")).withColumn("prop_highest", F.col("highest_freq") / F.col("n_tokens"))


def describe_draws(units: DataFrame, draws: DataFrame, width: int) -> DataFrame:
    """(draw, n_utts, mean_per_utt, prop_one, n_tokens, n_types, highest_freq, highest) of many draws of units, with the measures of
    ``describe``; draws without a unit are left out. ``units`` has blocks of units (places, after; sizes: their tokens; and their
    distinct tokens one after the other: lengths, tokens, counts), with numbers below ``width`` as tokens, in their order.
    ``draws`` has blocks of draws (block, draws, before, firsts, lasts, places: what ``resample.last_dealt`` says of each).

    A task has some of the draws, sees all units for them, one block of units after the other, and holds a count for each token
    and draw: no count is shuffled."""
    names = ["n_utts", "ones", "n_tokens", "n_types", "highest_freq", "highest"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own = None, None

        def found() -> pa.RecordBatch:
            n = [utts, ones, sums.sum(axis=0, dtype=np.int64), (sums > 0).sum(axis=0), sums.max(axis=0), sums.argmax(axis=0)]
            some = np.flatnonzero(utts)
            return pa.RecordBatch.from_arrays([pa.array(own[some], pa.int32()), *(pa.array(x[some].astype(np.int64)) for x in n)], names=["draw", *names])

        for b in batches:
            for r in range(b.num_rows):
                get = lambda c, b=b, r=r: b.column(c)[r].values.to_numpy(zero_copy_only=False)
                if b.column("block")[r].as_py() != block:
                    if own is not None:
                        yield found()
                    block, own = b.column("block")[r].as_py(), get("draws")
                    before = [x.encode() for x in b.column("before")[r].as_py()]
                    h, l, o = (get(c).astype(np.int64).astype(np.uint64)[:, None] for c in ("firsts", "lasts", "last_places"))
                    sums, utts, ones = np.zeros((width, len(own)), np.int64), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
                first, last = many_chances(before, [x.encode() for x in b.column("after")[r].as_py()])
                places = get("places").astype(np.uint64)
                taken = (first < h) | ((first == h) & ((last < l) | ((last == l) & (places <= o))))
                utts += taken.sum(axis=1)
                ones += taken[:, get("sizes") == 1].sum(axis=1)
                _add_counts(sums, get("tokens"), get("counts"), np.repeat(np.arange(len(places)), get("lengths")), np.ascontiguousarray(taken.T))
        if own is not None:
            yield found()

    blocks = max(1, draws.count())
    pairs = units.crossJoin(F.broadcast(draws)).repartition(blocks, "block").sortWithinPartitions("block")
    out = pairs.mapInArrow(measure, "draw int, " + ", ".join(f"{n} long" for n in names))
    return out.select("draw", "n_utts", (F.col("n_tokens") / F.col("n_utts")).alias("mean_per_utt"), (F.col("ones") / F.col("n_utts")).alias("prop_one"), *names[2:])


def _add_counts(sums: np.ndarray, tokens: np.ndarray, counts: np.ndarray, unit: np.ndarray, inside: np.ndarray) -> None:
    """Adds to ``sums`` (tokens x draws) the counts of the tokens of the units that are in a draw (``inside``, units x draws). Tokens
    of several units are added up by a product of matrices, in which every sum is exact."""
    units, draws = inside.shape
    own, code, often = np.unique(tokens, return_inverse=True, return_counts=True)
    dense = often >= 8
    at = dense[code]
    number = np.cumsum(dense) - 1
    step = max(1, CELLS // max(1, 8 * units))
    weights = inside.astype(np.float64 if len(counts) and int(counts.max()) * units >= 1 << 24 else np.float32)
    shared, code, unit_of, n = own[dense], number[code[at]], unit[at], counts[at]
    for i in range(0, len(shared), step):
        part = (code >= i) & (code < i + step)
        matrix = np.zeros((min(step, len(shared) - i), units), weights.dtype)
        matrix[code[part] - i, unit_of[part]] = n[part]
        sums[shared[i : i + step]] += (matrix @ weights).astype(np.int64)
    rest = np.flatnonzero(~at)
    rest = rest[np.argsort(tokens[rest], kind="stable")]
    step = max(1, (1 << 18) // max(1, draws))
    for i in range(0, len(rest), step):
        some = rest[i : i + step]
        begins = np.flatnonzero(np.diff(tokens[some], prepend=-1))
        sums[tokens[some][begins]] += np.add.reduceat(inside[unit[some]] * counts[some][:, None].astype(np.int64), begins, axis=0)


def hits_and_utterances(long: DataFrame, name: str = "context", value: str = "value") -> DataFrame:
    """Rows with value 1, and rows with any value above 0."""
    return long.groupBy(name).agg(F.count_if(F.col(value) == 1).alias("n_hits"), F.count_if(F.col(value) > 0).alias("n_utterances"))


def top_tokens(tokens: DataFrame, by: list[str], token: str, n: int = 3) -> DataFrame:
    """The n most frequent tokens per group, ties by name. Ranks run on counts, not on tokens."""
    freq = tokens.groupBy(*by, token).agg(F.count("*").alias("freq"))
    w = Window.partitionBy(*by).orderBy(F.col("freq").desc(), F.col(token))
    return freq.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def frequency_quantiles(tokens: DataFrame, by: list[str], token: str, ps: dict[str, float]) -> DataFrame:
    """Quantiles of the token counts per group, and the least and largest count."""
    freq = tokens.groupBy(*by, token).agg(F.count("*").alias("f"))
    out = cutoffs(freq, by, {"least": ("f", 0.0), **{name: ("f", p) for name, p in ps.items()}, "most": ("f", 1.0)})
    return out.withColumn("least", F.col("least").cast("long")).withColumn("most", F.col("most").cast("long"))


def syllable_profile(tokens: DataFrame, dictionary: DataFrame, by: list[str], token: str) -> DataFrame:
    """Per number of syllables (null: not in the dictionary; word, n_syl): types, total, mean, deviation and standard error
    of the word frequencies."""
    freq = tokens.groupBy(*by, token).agg(F.count("*").alias("f")).join(dictionary.select(F.col("word").alias(token), "n_syl"), token, "left")
    return freq.groupBy(*by, "n_syl").agg(F.count("*").alias("n_types"), F.sum("f").alias("total"), F.avg("f").alias("mean"), F.stddev_samp("f").alias("sd"), standard_error("f").alias("se"))


def measure_means(tests: DataFrame, by: list[str], measures: list[str], value: str = "z_est", measure: str = "measure") -> DataFrame:
    """The mean of ``value`` per group, a column per measure."""
    return tests.groupBy(*by).pivot(measure, measures).agg(F.avg(value))


def length_profile(tokens: DataFrame, unit: list[str]) -> DataFrame:
    """Distribution of utterance lengths: length, utterances, percent, with mean and deviation over all."""
    per = tokens.groupBy(*unit).agg(F.count("*").alias("length"))
    total = per.agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"), F.stddev_samp("length").alias("sd_length"))
    out = per.groupBy("length").agg(F.count("*").alias("utterances")).crossJoin(F.broadcast(total))
    return out.withColumn("percent", 100 * F.col("utterances") / F.col("n")).drop("n")


def coverage(tagged: DataFrame, keys: list[str], all_rows: DataFrame, name: str = "context") -> DataFrame:
    """Shares of elements with 0, 1, 2 and 3 or more contexts; ``all_rows`` has the keys of every element."""
    n = tagged.groupBy(*keys).agg(F.countDistinct(name).alias("n"))
    per = all_rows.select(*keys).distinct().join(n, keys, "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    share = lambda c: F.avg(c.cast("double"))
    return per.agg(F.count("*").alias("elements"), share(F.col("n") == 0).alias("none"), share(F.col("n") == 1).alias("one"), share(F.col("n") == 2).alias("two"), share(F.col("n") >= 3).alias("more"))


def keyword_frequency(docs: DataFrame, text: str, words: DataFrame) -> DataFrame:
    """Per context: total, mean and largest count of its keywords, and the most frequent one (ties: smallest). Keywords of
    any number of words are counted wherever they stand in the texts on word boundaries (see contexts.keyword_tags), also
    where they overlap; those that never occur count 0."""
    listed, lengths, firsts = listed_keywords(words)
    # a plain explode makes Spark test the parts' number in a filter on the texts, which takes a text apart again for each of its
    # words; the null of a text without parts joins nothing
    found = keyword_grams(docs, [], text, lengths, firsts).select(F.explode_outer("grams").alias("word"))
    counted = found.join(F.broadcast(listed.select("word").distinct()), "word", "left_semi").groupBy("word").agg(F.count("*").alias("f"))
    counted = listed.join(counted, "word", "left").select("context", "word", F.coalesce("f", F.lit(0)).alias("f"))
    return counted.groupBy("context").agg(F.sum("f").alias("total"), F.avg("f").alias("mean"), F.max("f").alias("most"), F.min_by("word", F.struct(-F.col("f"), F.col("word"))).alias("top_word"))


def median_split(df: DataFrame, n: str, out: str = "above_median") -> DataFrame:
    return df.crossJoin(F.broadcast(cutoffs(df, [], {"_m": (n, 0.5)}))).withColumn(out, F.col(n) > F.col("_m")).drop("_m")


def percent_match(long: DataFrame, keys: list[str], x: str, among: list[str], name: str = "context", value: str = "value") -> DataFrame:
    """Among elements with context x, the mean of each context of ``among``; absent ones count 0. One pass over
    the marks, and no join: an element's marks are added up first."""
    among = list(dict.fromkeys(among))
    own = [F.col(name) == c for c in among]
    marks = long.where(F.col(name).isin(x, *among)).groupBy(*keys).agg(
        F.max((F.col(name) == x) & (F.col(value) == 1)).alias("_x"), *(F.count_if(c).alias(f"_n{i}") for i, c in enumerate(own)), *(F.sum(F.when(c, F.col(value))).alias(f"_s{i}") for i, c in enumerate(own))
    )
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    sums = marks.where("_x").agg(F.count("*").alias("_n"), *(F.count_if(known & (F.col(f"_n{i}") > 0)).alias(f"_n{i}") for i in range(len(among))), *(F.sum(F.when(known, F.col(f"_s{i}"))).alias(f"_s{i}") for i in range(len(among))))
    each = F.array(*(F.struct(F.lit(c).alias(name), F.col(f"_n{i}").alias("n"), (F.col(f"_s{i}") / F.col("_n")).alias("share")) for i, c in enumerate(among)))
    return sums.where("_n > 0").select(F.explode(each).alias("e")).where("e.n > 0").select(F.col(f"e.{name}").alias(name), "e.share")


def occurrence_counts(long: DataFrame, group: list[str], method: str, name: str, value: str) -> DataFrame:
    """In how many groups each context occurs per method, and whether that is once, at least half as often as the
    method's most common context, or as often."""
    occurs = long.groupBy(*group, method, name).agg(F.sum(value).alias("s")).where("s > 0").groupBy(method, name).agg(F.count("*").alias("n"))
    most = F.max("n").over(Window.partitionBy(method))  # contexts of a method
    return occurs.withColumn("most", most).select(method, name, "n", (F.col("n") == 1).alias("once"), (F.col("n") >= F.col("most") / 2).alias("common"), (F.col("n") == F.col("most")).alias("top"))

