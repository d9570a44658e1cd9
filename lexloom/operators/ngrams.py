"""Transitional probability and mutual information of neighbouring tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.stats import cutoffs, global_rank
from lexloom.scratch import Scratch


def bigram_table(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per distinct pair (a, b), in each group of ``by``: ab, a1, b2, the shares p_ab, p_a1, p_b2, tp = p_ab / p_a1 and
    mi = log2(p_ab / (p_a1 * p_b2)).

    The marginals are aggregates of the pair counts, not of the tokens, so tokens are shuffled once."""
    by = by or []
    # written once, as the marginals, the total and the result all read it
    ab = Scratch(pairs.sparkSession, "bigrams").put(pairs.groupBy(*by, "a", "b").agg(F.count("*").alias("ab")), "ab")
    a1 = ab.groupBy(*by, "a").agg(F.sum("ab").alias("a1"))
    b2 = ab.groupBy(*by, "b").agg(F.sum("ab").alias("b2"))
    n = ab.groupBy(*by).agg(F.sum("ab").alias("n"))
    out = ab.join(a1, [*by, "a"]).join(b2, [*by, "b"])
    out = out.join(F.broadcast(n), by) if by else out.crossJoin(F.broadcast(n))  # a row per context, or one row
    out = out.withColumns({"p_ab": F.col("ab") / F.col("n"), "p_a1": F.col("a1") / F.col("n"), "p_b2": F.col("b2") / F.col("n")})
    return out.withColumns({"tp": F.col("p_ab") / F.col("p_a1"), "mi": F.log2(F.col("p_ab") / (F.col("p_a1") * F.col("p_b2")))})


def type_share(tokens: DataFrame, token: str, by: list[str] | None = None) -> DataFrame:
    """Token frequency over the number of types, per token (as the bigram table's unused marginals have it)."""
    by = by or []
    freq = tokens.groupBy(*by, token).agg(F.count("*").alias("freq"))
    types = freq.groupBy(*by).agg(F.count("*").alias("types"))
    out = freq.join(F.broadcast(types), by) if by else freq.crossJoin(F.broadcast(types))
    return out.withColumn("share", F.col("freq") / F.col("types"))


def bigram_ranks(table: DataFrame) -> DataFrame:
    """Adds tp_rank (largest tp first, ties by ab, a, b) and mi_rank (largest mi first, ties by tp_rank)."""
    ranked = global_rank(table, [F.round("tp", 9).desc(), F.col("ab").desc(), F.col("a"), F.col("b")], "tp_rank")
    return global_rank(ranked, [F.round("mi", 9).desc(), F.col("tp_rank")], "mi_rank")


def bigram_graph(table: DataFrame, p: float = 0.85, largest: float = 0.03, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of the directed graph of pairs: edges with mi at or above its p quantile, between vertices of
    size freq / (largest * max freq) of at least ``least``."""
    cut = cutoffs(table, [], {"cut": ("mi", p)})
    v = table.groupBy(F.col("a").alias("token")).agg(F.sum("ab").alias("freq"))
    top = v.agg(F.max("freq").alias("top"))
    v = v.crossJoin(F.broadcast(top)).withColumn("size", F.col("freq") / (largest * F.col("top"))).where(F.col("size") >= least).drop("top")
    e = table.crossJoin(F.broadcast(cut)).where(F.col("mi") >= F.col("cut") - 1e-12).drop("cut")
    e = e.join(v.select(F.col("token").alias("a")), "a", "left_semi").join(v.select(F.col("token").alias("b")), "b", "left_semi")
    return v, e


def cooccurrence(long: DataFrame, keys: list[str], name: str = "context", value: str = "value") -> DataFrame:
    """Edges between contexts of the same element: (a, b, n) with a < b. The contexts of an element are few and are
    paired inside the row."""
    sets = long.where(F.col(value) > 0).groupBy(*keys).agg(F.array_sort(F.collect_set(name)).alias("c"))
    edges = F.expr("flatten(transform(c, (x, i) -> transform(slice(c, i + 2, size(c)), y -> named_struct('a', x, 'b', y))))")
    return sets.where(F.size("c") > 1).select(F.explode(edges).alias("e")).groupBy("e.a", "e.b").agg(F.count("*").alias("n"))
