"""Row windows over ordered sequences. The order is an explicit column; sequences are given by partition columns, so
windows run in parallel and never cross a sequence."""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexloom.functions.stats import global_rank
from lexloom.operators.resample import uniform
from lexloom.scratch import ship_package


def expand_windows(df: DataFrame, hit: str, partition: list[str], order: list[str], k: int = 2, out: str = "expanded") -> DataFrame:
    """1 where the row is a hit, 1.5 where one of the k rows before or after is, else 0. New marks do not spread."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(-k, k)
    near = F.max((F.coalesce(F.col(hit), F.lit(0)) == 1).cast("int")).over(w)
    return df.withColumn(out, F.when(F.col(hit) == 1, 1.0).when(near == 1, 1.5).otherwise(0.0))


def within_k(hit: str, partition: list[str], order: list[str], k: int, kind: str) -> Column:
    """1 if one of the k rows before (lag), after (lead) or on either side is a hit; the row itself does not count."""
    w = Window.partitionBy(*partition).orderBy(*order)
    flag = (F.coalesce(F.col(hit), F.lit(0)) == 1).cast("int")
    lag = F.coalesce(F.max(flag).over(w.rowsBetween(-k, -1)), F.lit(0))
    lead = F.coalesce(F.max(flag).over(w.rowsBetween(1, k)), F.lit(0))
    return {"lag": lag, "lead": lead, "either": F.greatest(lag, lead)}[kind]


def bigrams(tokens: DataFrame, unit: list[str], order: str, token: str) -> DataFrame:
    """Neighbouring tokens of a unit: the unit, order, and columns a, b."""
    w = Window.partitionBy(*unit).orderBy(order)
    return tokens.select(*unit, order, F.col(token).alias("a"), F.lead(token).over(w).alias("b")).where(F.col("b").isNotNull())


def stream_bigrams(tokens: DataFrame, order: list[str], token: str) -> DataFrame:
    """Neighbouring tokens of one stream over all utterances (a, b and the place of a): pairs may cross utterances. Places
    come from a distributed sort, and neighbours meet by an equi-join, as a window over everything is one task."""
    placed = global_rank(tokens.select(*order, F.col(token).alias("a")), [F.col(c) for c in order], "place").select("place", "a")
    return placed.join(placed.select((F.col("place") - 1).alias("place"), F.col("a").alias("b")), "place")


def global_tumbling(df: DataFrame, order: list[str], size: int = 30, out: str = "window") -> DataFrame:
    """Numbers windows of ``size`` rows over the whole table, as one sequence."""
    return global_rank(df, [F.col(c) for c in order], "_place").withColumn(out, F.floor((F.col("_place") - 1) / size).cast("long")).drop("_place")


def islands(df: DataFrame, hit: str, partition: list[str], position: str, legacy_last_hit: bool = False) -> DataFrame:
    """Runs of hits at neighbouring positions: partition, chunk start, length. With ``legacy_last_hit`` the last hit of
    each partition is not counted."""
    w = Window.partitionBy(*partition).orderBy(position)
    hits = df.where(F.col(hit) > 0).select(*partition, position)
    if legacy_last_hit:
        hits = hits.withColumn("_next", F.lead(position).over(w)).where(F.col("_next").isNotNull()).drop("_next")
    key = F.col(position) - F.row_number().over(w)
    return hits.withColumn("_island", key).groupBy(*partition, "_island").agg(F.min(position).alias("chunk_start"), F.count("*").alias("chunk_length")).drop("_island")


def continuity(df: DataFrame, hit: str, partition: list[str], position: str, legacy_last_hit: bool = False) -> DataFrame:
    """Per partition with a hit: number and lengths of chunks, distances between neighbouring hits."""
    length = F.col("chunk_length")
    chunks = islands(df, hit, partition, position, legacy_last_hit).groupBy(*partition).agg(
        F.count("*").alias("n_chunks"), F.avg(length).alias("mean_length"), F.stddev_samp(length).alias("sd_length"), F.min(length).alias("min_length"), F.percentile(length, 0.5).alias("med_length"), F.max(length).alias("max_length")
    )
    w = Window.partitionBy(*partition).orderBy(position)
    gaps = df.where(F.col(hit) > 0).select(*partition, (F.lead(position).over(w) - F.col(position)).alias("d"))
    gaps = gaps.groupBy(*partition).agg(F.count("*").alias("n_hits"), F.avg("d").alias("mean_distance"), F.percentile("d", 0.5).alias("med_distance"), F.stddev_samp("d").alias("sd_distance"))
    return gaps.join(chunks, partition, "left")


def tumbling(df: DataFrame, partition: list[str], order: list[str], size: int = 30, out: str = "window") -> DataFrame:
    """Numbers windows of ``size`` rows within each sequence; the last one may be short."""
    return df.withColumn(out, F.floor((F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1) / size).cast("long"))


def window_text(df: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """The texts of each window in order, joined by blanks. A window has a fixed number of rows."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.array_join(F.transform(parts, lambda x: x[text]), " ").alias("text"))


def offset_windows(counts: DataFrame, keys: list[str], n: str, start: int, size: int = 30) -> DataFrame:
    """Windows of ``size`` positions from ``start`` on, per sequence with ``n`` positions: first, last."""
    return counts.where(F.col(n) >= start).select(*keys, F.explode(F.sequence(F.lit(start), F.col(n).cast("int"), F.lit(size))).alias("first"), F.col(n)).select(*keys, "first", F.least(F.col("first") + size - 1, F.col(n)).cast("long").alias("last"))


def coding_windows(counts: DataFrame, keys: list[str], n: str, coded: DataFrame, position: str, seed: str = "s", size: int = 30, step: int = 3) -> DataFrame:
    """The windows that are left to code: (keys, first, last, open). A sequence's windows start at a random one of 1, 4, 7,
    .. up to ``size``; ``coded`` has the keys and positions that are coded; windows without an open position are left out."""
    places = F.floor(uniform(F.lit(seed), *(F.col(k).cast("string") for k in keys)) * (size // step)).cast("int") * step + 1
    starts = counts.withColumn("_start", F.least(places, F.col(n).cast("int"))).select(*keys, F.col(n), F.explode(F.sequence(F.col("_start"), F.col(n).cast("int"), F.lit(size))).alias("first"), "_start")
    found = starts.select(*keys, "first", "_start", F.least(F.col("first") + size - 1, F.col(n)).cast("long").alias("last"))
    # a position's window follows from the start, so coded positions meet their window by an equi-join
    own = coded.select(*keys, position).distinct().join(starts.select(*keys, "_start").distinct(), keys).where(F.col(position) >= F.col("_start"))
    done = own.groupBy(*keys, (F.floor((F.col(position) - F.col("_start")) / size) * size + F.col("_start")).cast("int").alias("first")).agg(F.count("*").alias("_done"))
    out = found.join(done, [*keys, "first"], "left").withColumn("open", F.col("last") - F.col("first") + 1 - F.coalesce("_done", F.lit(0)))
    return out.where("open > 0").select(*keys, "first", "last", "open")


def running_mean(df: DataFrame, partition: list[str], order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("iteration", F.row_number().over(w)).withColumn("running_mean", F.avg(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))


class RunningQuantile:
    """The quantile ``p`` (type 7) of the numbers so far, as they come: two heaps meet at it, and a number more moves one
    entry at most from one to the other, so n numbers take n log n steps."""

    def __init__(self, p: float):
        self.p, self.low, self.high = p, [], []  # the low numbers are negative, so that the largest is at hand

    def add(self, x: float) -> None:
        if self.low and x < -self.low[0]:
            heapq.heappush(self.low, -x)
        else:
            heapq.heappush(self.high, x)
        wanted = math.floor(self.p * (len(self.low) + len(self.high) - 1)) + 1
        while len(self.low) < wanted:
            heapq.heappush(self.low, -heapq.heappop(self.high))
        while len(self.low) > wanted:
            heapq.heappush(self.high, -heapq.heappop(self.low))

    def value(self) -> float | None:
        if not self.low:
            return None
        at = self.p * (len(self.low) + len(self.high) - 1)
        share, below = at - math.floor(at), -self.low[0]
        return below if not share else below * (1 - share) + self.high[0] * share


def running_quantiles(df: DataFrame, partition: list[str], order: list[str], value: str, ps: dict[str, float], start: int = 39) -> DataFrame:
    """Quantiles of the values so far, from the ``start``-th row on; nulls have a row, but are no value. A sequence is one
    group, read in order once, with its values in two heaps."""
    numbered = df.withColumn("iteration", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))

    def run(table):
        table = table.sort_by("iteration")
        heaps = {name: (RunningQuantile(p), []) for name, p in ps.items()}
        for i, x in enumerate(table.column(value).to_pylist(), 1):
            for heap, out in heaps.values():
                if x is not None:
                    heap.add(float(x))
                out.append(heap.value() if i >= start else None)
        for name, (_, out) in heaps.items():
            table = table.append_column(name, pa.array(out, pa.float64()))
        return table

    ship_package(df.sparkSession)
    schema = T.StructType([*numbered.schema.fields, *(T.StructField(name, T.DoubleType()) for name in ps)])
    return numbered.groupBy(*partition).applyInArrow(run, schema)


def next_pass(df: DataFrame, keys: list[str], number: str, coded: Column) -> DataFrame:
    """Per sequence element the lowest pass that is not coded, else one more than the largest."""
    return df.groupBy(*keys).agg(F.coalesce(F.min(F.when(~coded, F.col(number))), F.max(number) + 1).alias("next_pass"))


def needs_coding(df: DataFrame, partition: list[str], order: list[str], n: str, criterion: int, k: int = 30) -> DataFrame:
    """Marks rows that have fewer than ``criterion`` codes, and the k rows on either side of them, so that windows to be
    coded have their surroundings."""
    few = df.withColumn("_few", (F.coalesce(F.col(n), F.lit(0)) < criterion).cast("int"))
    return few.withColumn("open", (F.col("_few") == 1) | (within_k("_few", partition, order, k, "either") == 1)).drop("_few")
