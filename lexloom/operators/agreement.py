"""Agreement of tagging methods: cross tables, chi-square, Cramér's V, and tests for multiple responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions.stats import chi_square_upper
from lexloom.functions.text import p_text
from lexloom.operators.resample import uniform


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def method_pairs(codes: DataFrame, keys: list[str], left: str, right: str, method: str = "method", name: str = "context", drop_ambiguous_both: bool = False) -> DataFrame:
    """(a, b, n): contexts that two methods give the same element, "none" where one gives none. Elements with several
    contexts are left out per method, or, with ``drop_ambiguous_both``, for both methods."""
    single = codes.groupBy(*keys, method).agg(F.countDistinct(name).alias("k"), F.min(name).alias(name))
    bad = single.where("k > 1").select(*keys).distinct()
    one = single.where("k = 1")
    if drop_ambiguous_both:
        one = one.join(bad, keys, "left_anti")
    a, b = (one.where(F.col(method) == m).select(*keys, F.col(name).alias(x)) for m, x in ((left, "a"), (right, "b")))
    return crosstab(a.join(b, keys, "full").fillna("none", ["a", "b"]), "a", "b")


def chi_square(cells: DataFrame, a: str, b: str, n: str = "n", by: list[str] | None = None) -> DataFrame:
    """A row per table of counts (one for each value of ``by``): by, chi2, dof, total, cramers_v, phi, p_value and report, a
    text with all of them. Cells that don't occur count 0: they need no row, since the statistic is
    total * (sum of n^2 / (row sum * column sum) - 1)."""
    by = by or []
    cells = cells.groupBy(*by, a, b).agg(F.sum(n).alias("_o")).where("_o > 0")
    rows, cols = cells.groupBy(*by, a).agg(F.sum("_o").alias("_ra")), cells.groupBy(*by, b).agg(F.sum("_o").alias("_cb"))
    grid = cells.join(rows.select(*(F.col(k).alias(f"_r_{k}") for k in [*by, a]), "_ra"), _same([*by, a], "_r_")).join(cols.select(*(F.col(k).alias(f"_c_{k}") for k in [*by, b]), "_cb"), _same([*by, b], "_c_"))
    out = grid.groupBy(*by).agg(F.sum("_o").alias("total"), F.sum(F.col("_o").cast("double") * F.col("_o") / (F.col("_ra").cast("double") * F.col("_cb"))).alias("_s"))
    sides = [x.groupBy(*by).agg(F.count("*").alias(name)) for x, name in ((rows, "_r"), (cols, "_c"))]
    for side in sides:
        out = out.join(side.select(*(F.col(k).alias(f"_k_{k}") for k in by), side.columns[-1]), _same(by, "_k_")).drop(*(f"_k_{k}" for k in by)) if by else out.crossJoin(F.broadcast(side))  # one row
    chi2 = F.greatest(F.lit(0.0), F.col("total") * (F.col("_s") - 1))
    least = F.least(F.col("_r") - 1, F.col("_c") - 1)
    out = out.select(*by, chi2.alias("chi2"), ((F.col("_r") - 1) * (F.col("_c") - 1)).alias("dof"), "total", F.sqrt(F.try_divide(chi2, F.col("total") * least)).alias("cramers_v"), F.sqrt(chi2 / F.col("total")).alias("phi"))
    out = out.withColumn("p_value", chi_square_upper(F.col("chi2"), F.col("dof")))
    shown = F.concat(F.lit("chi2("), F.col("dof"), F.lit(", N = "), F.col("total"), F.lit(") = "), F.format_string("%.2f", "chi2"), F.lit(", "), p_text(F.col("p_value")), F.when(F.col("cramers_v").isNull(), "").otherwise(F.concat(F.lit(", V = "), F.format_string("%.2f", "cramers_v"))))
    return out.withColumn("report", shown)


def _same(keys: list[str], prefix: str) -> Column:
    """Whether ``keys`` are equal to the columns of these names with a prefix; null is a value."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return out


def multiple_response_statistic(wide: DataFrame, left: list[str], right: list[str], by: list[str] | None = None) -> DataFrame:
    """Sum over all pairs of items of the 2x2 chi-square: a row (by, statistic, n) for each value of ``by``, else one.
    Multiple responses are allowed."""
    by = by or []
    aggs = [F.count("*").alias("n")] + [F.sum(F.col(c)).alias(f"_{c}") for c in [*left, *right]] + [F.sum(F.col(x) * F.col(y)).alias(f"_{x}_{y}") for x in left for y in right]
    out = wide.groupBy(*by).agg(*aggs)
    total = F.lit(0.0)
    double = lambda c: F.col(c).cast("double")  # noqa: E731  (a product of four counts is beyond long from 100,000 rows on)
    n = double("n")
    for x in left:
        for y in right:
            a, b, ab = double(f"_{x}"), double(f"_{y}"), double(f"_{x}_{y}")
            total = total + F.coalesce(F.try_divide(n * F.pow(n * ab - a * b, 2), a * b * (n - a) * (n - b)), F.lit(0.0))
    return out.select(*by, total.alias("statistic"), "n")


def pattern_ranges(wide: DataFrame, items: list[str], bucket: int) -> DataFrame:
    """(bucket, low, high, items): each pattern of the items has the places low .. high - 1 of as many as it has rows,
    in the order of the patterns, and a row for each bucket of ``bucket`` places that these are in. Patterns are few."""
    counts = wide.groupBy(*items).agg(F.count("*").alias("_n"))
    high = F.sum("_n").over(Window.orderBy(*items).rowsBetween(Window.unboundedPreceding, 0))  # as many rows as there are patterns
    ranges = counts.withColumn("high", high).withColumn("low", F.col("high") - F.col("_n"))
    every = F.sequence(F.floor(F.col("low") / bucket), F.floor((F.col("high") - 1) / bucket))
    return ranges.select(F.explode(every).alias("bucket"), "low", "high", *items)


def multiple_response_bootstrap(wide: DataFrame, left: list[str], right: list[str], iters: int = 200, seed: str = "s") -> DataFrame:
    """Null distribution of the statistic: (iter, statistic, n). In each iteration as many elements as there are get a
    pattern of each side, drawn with replacement and independently of the other side: a hash of the draw gives a place
    among the rows in the order of their patterns, and the pattern whose places it is in comes by a join on buckets of
    places, of which there are 1,000 and one more for each pattern. Rows with a null are left out."""
    spark = wide.sparkSession
    known = wide.dropna("any", subset=[*left, *right])
    n = known.count()
    bucket = max(1, n // 1000)
    out = spark.range(iters * n).select(F.floor(F.col("id") / max(1, n)).alias("iter"), (F.col("id") % max(1, n)).alias("draw"))
    for side, items in (("l", left), ("r", right)):
        place = F.floor(uniform(F.lit(seed), F.lit(side), F.col("iter").cast("string"), F.col("draw").cast("string")) * n)
        out = out.withColumn("_at", place).withColumn("bucket", F.floor(F.col("_at") / bucket))
        ranges = pattern_ranges(known, items, bucket)
        out = out.join(F.broadcast(ranges), "bucket").where((F.col("low") <= F.col("_at")) & (F.col("_at") < F.col("high"))).drop("bucket", "low", "high", "_at")
    return multiple_response_statistic(out, left, right, ["iter"])


def multiple_response_test(wide: DataFrame, left: list[str], right: list[str], iters: int = 200, seed: str = "s") -> DataFrame:
    """One row: statistic, n, iters and p_value, the share of draws under independence that reach the statistic, counting the
    sample itself as one of them, so that it is never 0."""
    seen = multiple_response_statistic(wide.dropna("any", subset=[*left, *right]), left, right)
    drawn = multiple_response_bootstrap(wide, left, right, iters, seed).select("iter", F.col("statistic").alias("_drawn"))
    both = drawn.crossJoin(F.broadcast(seen))  # one row
    reached = F.count_if(F.col("_drawn") >= F.col("statistic") * (1 - 1e-9))
    return both.groupBy("statistic", "n").agg(F.count("*").alias("iters"), ((reached + 1) / (F.count("*") + 1)).alias("p_value"))
