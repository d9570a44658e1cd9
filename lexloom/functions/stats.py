"""Statistics as column expressions and small aggregate plans."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.scratch import Scratch, ship_package


def pbinom(k: Column, n: Column, p: float, lower: bool = True) -> Column:
    """P(X <= k) of a binomial, or P(X > k): a sum of terms, each from the one before, in logarithms so that large n
    does not underflow."""
    q = F.lit(p / (1 - p))
    first = F.struct((n * F.log(F.lit(1 - p))).alias("t"), F.lit(0.0).alias("s"))
    cdf = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.greatest(k.cast("long"), F.lit(0).cast("long"))),
        first,
        lambda acc, i: F.struct((acc["t"] + F.log(F.greatest(n - i, F.lit(1e-300)) * q / (i + 1))).alias("t"), (acc["s"] + F.exp(acc["t"])).alias("s")),
        lambda acc: F.least(acc["s"], F.lit(1.0)),
    )
    cdf = F.when(k < 0, 0.0).when(k >= n, 1.0).otherwise(cdf)
    return cdf if lower else 1 - cdf


def with_z(df: DataFrame, value: str, est: str, by: list[str] | None = None, z_est: str = "z_est", z_value: str = "z_value") -> DataFrame:
    """Adds (est - mean) / sd and (value - mean) / sd within groups; null where the deviation is 0 or null."""
    m = df.groupBy(*(by or [])).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))
    joined = df.join(m, by) if by else df.crossJoin(F.broadcast(m))  # without groups m is one row
    sd = F.nullif(F.col("_sd"), F.lit(0.0))
    return joined.withColumn(z_est, (F.col(est) - F.col("_mean")) / sd).withColumn(z_value, (F.col(value) - F.col("_mean")) / sd).drop("_mean", "_sd")


def bootstrap_test(df: DataFrame, value: str, est: str, by: list[str]) -> DataFrame:
    """Per group: iters, n_above (value >= est), n_below, p_hi, p_lo, p_val and p_boot_unsure, the chance of a count as
    extreme if the true level were 0.025."""
    out = df.where(F.col(value).isNotNull() & F.col(est).isNotNull()).groupBy(*by).agg(F.count("*").alias("iters"), F.count_if(F.col(value) >= F.col(est)).alias("n_above"))
    out = out.withColumn("n_below", F.col("iters") - F.col("n_above")).withColumn("p_hi", F.col("n_above") / F.col("iters")).withColumn("p_lo", F.col("n_below") / F.col("iters"))
    out = out.withColumn("p_val", F.least("p_hi", "p_lo"))
    fewer = F.least("n_above", "n_below")
    unsure = F.when(F.col("p_val") < 0.025, pbinom(fewer, F.col("iters"), 0.025)).otherwise(pbinom(fewer, F.col("iters"), 0.025, lower=False))
    return out.withColumn("p_boot_unsure", F.when(F.col("p_hi") != F.col("p_lo"), unsure))


def grouped_quantiles(df: DataFrame, by: list[str], column: str, ps: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation (type 7) per group, without a group's values in one place: counts per
    value, a distributed sort of these, and the offsets of its partitions. Nulls are left out."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    placed = Scratch(df.sparkSession, "quantiles").put(counts.orderBy(*by, column).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    before, total = [F.lit(-1).cast("long"), F.lit(0).cast("long")], 0
    for p, n in sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).agg(F.sum("_n")).collect()):  # a row per partition
        before += [F.lit(p).cast("long"), F.lit(total).cast("long")]
        total += n
    w = Window.partitionBy("_p").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    ends = placed.withColumn("_p", part).withColumn("_end", F.element_at(F.create_map(*before), F.col("_p")) + F.sum("_n").over(w))
    groups = ends.groupBy(*by).agg(F.sum("_n").alias("_all"), F.min(F.col("_end") - F.col("_n")).alias("_first"))
    ends = ends.join(groups, by) if by else ends.crossJoin(F.broadcast(groups))
    end = F.col("_end") - F.col("_first")
    out = []
    for name, p in ps.items():
        at = (F.col("_all") - 1) * F.lit(float(p))
        low, high = (F.max(F.when((end - F.col("_n") <= i) & (i < end), F.col(column).cast("double"))) for i in (F.floor(at), F.ceil(at)))
        share = F.max(at - F.floor(at))
        out.append((low + (high - low) * share).alias(name))
    return ends.groupBy(*by).agg(*out)


def cutoffs(df: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]], bins: int = 1024) -> DataFrame:
    """Exact quantiles with linear interpolation (type 7) of columns, a row per group: ``wanted`` has a column and a share for
    each name. Values are neither sorted nor gathered: the interval that holds the wanted rank is cut into ``bins`` equal
    bins (by turns of the values and of their logarithms), and the bin with that rank is the next interval, from its least to its largest value, until these are the same.
    A step is one aggregation for all groups and names; a task hands on a row per bin at most. A last one finds the value of
    the rank that follows.

    Nulls are left out, a group without values has null, and so has an empty table without ``by``. Groups may be null. NaN
    counts as the largest value. Other columns are ignored."""
    scratch = Scratch(df.sparkSession, "cutoffs")
    keys = [f"_k{i}" for i in range(len(by))]
    group = [*keys, "_i"]
    share = F.element_at(F.array(*(F.lit(float(p)) for _, p in wanted.values())), F.col("_i") + 1)
    columns = F.array(*(F.col(c).cast("double") for c, _ in wanted.values()))
    values = scratch.put(df.select(*(F.col(b).alias(k) for b, k in zip(by, keys)), F.posexplode(columns).alias("_i", "_v")), "values")

    def beside(state: DataFrame) -> DataFrame:
        other = state.select(*(F.col(g).alias(f"{g}_s") for g in group), "lo", "hi", "size", "below", "rank")
        return values.join(other, functools.reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"{g}_s")) for g in group]))

    rank = F.floor((F.col("size") - 1) * share).cast("long")
    first = values.groupBy(*group).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("_v").alias("size"), F.lit(0).cast("long").alias("below"))
    state, step = scratch.put(first.withColumn("rank", rank), "step0"), 0
    # the least and the largest value have bins of their own, so that each step takes them off
    logs = lambda x: F.signum(x) * (F.ln(F.nullif(F.abs(x), F.lit(0.0))) + 800)
    scales = [lambda x: x, lambda x: F.coalesce(logs(x), F.lit(0.0))]

    def bin_of(scale) -> Column:
        v, lo, hi = (scale(F.col(c)) for c in ("_v", "lo", "hi"))
        place = F.least(F.lit(bins - 2.0), F.greatest(F.lit(1.0), F.floor(F.try_divide(v - lo, hi - lo) * bins).cast("double")))
        return F.when(F.col("_v") <= F.col("lo"), 0.0).when(F.col("_v") >= F.col("hi"), bins - 1.0).otherwise(place)

    before = F.col("below") + F.sum("n").over(Window.partitionBy(*group).orderBy("bin")) - F.col("n")
    while state.where("lo <> hi").limit(1).count():
        inside = beside(state.where("lo <> hi")).where("_v >= lo AND _v <= hi").withColumn("bin", bin_of(scales[step % 2]))
        counts = inside.groupBy(*group, "size", "below", "rank", "bin").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        found = counts.withColumn("below", before).where("below <= rank AND rank < below + n").select(*state.columns)
        step += 1
        state = scratch.put(state.where("NOT coalesce(lo <> hi, false)").unionByName(found), f"step{step}")
        scratch.drop(f"step{step - 1}")
    ends = beside(state).groupBy(*group, "lo", "size", "rank").agg(F.count_if(F.col("_v") <= F.col("lo")).alias("upto"), F.min(F.when(F.col("_v") > F.col("lo"), F.col("_v"))).alias("next"))
    part = (F.col("size") - 1) * share - F.col("rank")
    same = (F.col("rank") + 1 < F.col("upto")) | F.col("next").isNull() | (part == 0)
    ends = ends.withColumn("at", F.when(same, F.col("lo")).otherwise(F.col("lo") + (F.col("next") - F.col("lo")) * part))
    out = ends.groupBy(*keys).agg(*(F.max(F.when(F.col("_i") == i, F.col("at"))).alias(n) for i, n in enumerate(wanted)))
    result = scratch.put(out.select(*(F.col(k).alias(b) for k, b in zip(keys, by)), *wanted), "cutoffs")
    scratch.keep("cutoffs")
    return result


def standard_error(column: str) -> Column:
    return F.stddev_samp(column) / F.sqrt(F.count(column))


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds 1..n in the given order without bringing all rows to one task: a distributed sort, written once, then the
    offsets of its partitions (a row per partition)."""
    spark = df.sparkSession
    placed = Scratch(spark, "rank").put(df.orderBy(*order).withColumn("_lexloom_at", F.monotonically_increasing_id()), "sorted")
    sizes = sorted((r[0], r[1]) for r in placed.groupBy(F.shiftright("_lexloom_at", 33).alias("p")).count().collect())
    before, total = [], 0
    for p, n in sizes:
        before += [F.lit(p).cast("long"), F.lit(total).cast("long")]
        total += n
    if not before:
        return placed.drop("_lexloom_at").withColumn(name, F.lit(0).cast("long"))
    start = F.element_at(F.create_map(*before), F.shiftright("_lexloom_at", 33))
    return placed.withColumn(name, start + F.col("_lexloom_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_lexloom_at")


def average_rank(partition: list[str], order: Column) -> Column:
    """Rank in which ties share their mean place. ``order`` is ascending."""
    w = Window.partitionBy(*partition).orderBy(order)
    ties = F.count("*").over(Window.partitionBy(*partition, order))
    return F.rank().over(w) + (ties - 1) / 2


def value_ranks(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """(by, column, rank): ``average_rank`` of each distinct value in its group, without a group in one task: counts of values,
    a distributed sort of these, and the offsets of its partitions. Nulls come first and are one value."""
    counts = df.groupBy(*by, column).agg(F.count("*").alias("_n"))
    placed = Scratch(df.sparkSession, "value-ranks").put(counts.orderBy(*by, column).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    before, total = [F.lit(-1).cast("long"), F.lit(0).cast("long")], 0
    for p, n in sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).agg(F.sum("_n")).collect()):  # a row per partition
        before += [F.lit(p).cast("long"), F.lit(total).cast("long")]
        total += n
    w = Window.partitionBy("_p").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    ends = placed.withColumn("_p", part).withColumn("_end", F.element_at(F.create_map(*before), F.col("_p")) + F.sum("_n").over(w))
    first = ends.groupBy(*by).agg(F.min(F.col("_end") - F.col("_n")).alias("_first"))  # a row per group
    return ends.join(F.broadcast(first), by).select(*by, column, (F.col("_end") - F.col("_first") - (F.col("_n") - 1) / 2).alias("rank"))


def trend(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Correlation and linear trend per group, with the t value of the correlation."""
    r = F.corr(x, y)
    n = F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = df.groupBy(*by).agg(n.alias("n"), r.alias("r"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    return out.withColumn("t", F.try_divide(F.col("r") * F.sqrt(F.col("n") - 2.0), F.sqrt(1 - F.col("r") * F.col("r"))))


# Coefficients of Lanczos' approximation of the gamma function (g = 7, nine terms).
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function, for x of 0.5 and more."""
    z = x - 1
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + c / (z + i)
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(total)


def _not_zero(x: Column) -> Column:
    return F.when(F.abs(x) < 1e-300, 1e-300).otherwise(x)


def _fold(steps: Column, start: dict[str, Column], step, end) -> Column:
    """``step(state, i)`` for i = 1 .. steps, from a state of named doubles, and then ``end(state)``."""
    merge = lambda acc, i: F.struct(*(c.alias(n) for n, c in step(acc, i.cast("double")).items()))
    return F.aggregate(F.sequence(F.lit(1), steps.cast("int")), F.struct(*(c.cast("double").alias(n) for n, c in start.items())), merge, end)


def gamma_upper(a: Column, x: Column) -> Column:
    """The regularised upper incomplete gamma function Q(a, x), a >= 0.5: the series of the lower one for small x, else the
    continued fraction, each of as many terms as a and x ask for."""
    steps = F.lit(60) + 12 * F.sqrt(a + 1)
    front = F.exp(-x + a * F.log(x) - log_gamma(a))
    series = _fold(steps, {"t": 1 / a, "s": 1 / a}, lambda acc, i: {"t": acc["t"] * x / (a + i), "s": acc["s"] + acc["t"] * x / (a + i)}, lambda acc: acc["s"])

    def fraction(acc, i):
        an, b = -i * (i - a), x + 1 - a + 2 * i
        d = 1 / _not_zero(an * acc["d"] + b)
        c = _not_zero(b + an / acc["c"])
        return {"c": c, "d": d, "h": acc["h"] * d * c}

    begin = 1 / _not_zero(x + 1 - a)
    tail = _fold(steps, {"c": F.lit(1e300), "d": begin, "h": begin}, fraction, lambda acc: acc["h"])
    return F.when(x <= 0, 1.0).when(x < a + 1, F.greatest(F.lit(0.0), 1 - front * series)).otherwise(front * tail)


def _beta_fraction(x, a, b):
    """The continued fraction of the incomplete beta function for arrays, with as many terms as the largest a + b asks for."""
    not_zero = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    d = 1 / not_zero(1 - (a + b) * x / (a + 1))
    c, h = np.ones_like(x), d
    for i in range(1, 61 + int(6 * np.sqrt(np.nanmax(a + b, initial=0.0)))):
        for term in (i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i)), -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1))):
            d, c = 1 / not_zero(1 + term * d), not_zero(1 + term / c)
            h = h * d * c
    return h


def beta_lower(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b), a and b >= 0.5, by its continued fraction, from the side on which
    that converges fast. The fraction is taken for a batch of rows at once: as a column expression, each of its terms would
    write out the one before several times."""
    ship_package(SparkSession.active())

    @F.pandas_udf("double")
    def fraction(y: pd.Series, p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series(_beta_fraction(*(v.to_numpy(float) for v in (y, p, q))))

    swap = x > (a + 1) / (a + b + 2)
    y, p, q = (F.when(swap, other).otherwise(own).cast("double") for other, own in ((1 - x, x), (b, a), (a, b)))
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + p * F.log(y) + q * F.log(1 - y)) / p
    value = F.when(y <= 0, 0.0).otherwise(front * fraction(y, p, q))
    return F.when(swap, 1 - value).otherwise(value)


def chi_square_upper(chi2: Column, dof: Column) -> Column:
    """The upper tail of the chi-square distribution; 1 without a degree of freedom."""
    return F.when(dof < 1, 1.0).otherwise(gamma_upper(dof / 2, chi2 / 2))


def student_t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t value."""
    return beta_lower(df / (df + t * t), df / 2, F.lit(0.5))


def normal_two_sided(z: Column) -> Column:
    """Two-sided p-value of a z value."""
    return gamma_upper(F.lit(0.5), z * z / 2)
