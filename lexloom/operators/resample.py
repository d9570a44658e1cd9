"""Permutation, sampling and generated corpora. Chance comes from hashes of keys, so results do not depend on the
number of partitions and come out the same again."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions.stats import global_rank


def chance(*parts: Column | str) -> Column:
    """A hash in hexadecimal of the parts: its order is a random order."""
    return F.md5(F.concat_ws("|", *(p if isinstance(p, Column) else F.col(p) for p in parts)).cast("binary"))


def uniform(*parts: Column | str) -> Column:
    """A number from 0 to 1 made of the first 13 digits of the hash."""
    return F.conv(F.substring(chance(*parts), 1, 13), 16, 10).cast("double") / float(16**13)


def permute(long: DataFrame, elements: DataFrame, keys: list[str], iters: int, seed: str = "s", name: str = "context", value: str = "value") -> DataFrame:
    """(iter, keys, context, value): in each iteration every context's values are dealt to other elements. Cells that are
    absent or 0 are the rest; all other values, null ones too, are dealt as they are: of a context with n of them the j-th
    (in ``keys``) goes to the element with the j-th least hash.

    Only hashes under a bound that n of them pass (by 10 standard deviations and 30) are sorted, all contexts and
    iterations in one distributed sort."""
    cells = long.where(F.col(value).isNull() | (F.col(value) != 0)).select(F.col(name), *keys, F.col(value))
    marks = _rank_within(cells, [name], keys, "_r").select(name, "_r", value)
    sizes = marks.groupBy(name).agg(F.count("*").alias("_n"))  # a row per context
    total = elements.select(*keys).distinct().agg(F.count("*").alias("_all"))
    it = elements.sparkSession.range(iters).select(F.col("id").alias("iter"))
    grid = elements.select(*keys).distinct().crossJoin(F.broadcast(it)).crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(total))
    h = chance(F.lit(seed), F.col("iter").cast("string"), F.col(name), *(F.col(k).cast("string") for k in keys))
    near = _least_hashes(grid.withColumn("_h", h), "_n", "_all")
    ranked = _rank_within(near.select("iter", name, "_h", *keys, "_n"), ["iter", name], ["_h", *keys], "_r").where(F.col("_r") <= F.col("_n"))
    return ranked.join(marks, [name, "_r"]).select("iter", *keys, name, value)


_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]


def many_chances(before: list[bytes], after: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of ``chance`` for every text of ``before`` with every one of ``after``, as two arrays of 64 bits each: the first
    and the last 16 digits. MD5 of short texts (55 bytes at most) is taken for many texts at once in arrays."""
    first, last = (np.empty((len(before), len(after)), np.uint64) for _ in range(2))
    sizes = np.array([len(x) for x in after], np.int64)
    for length in sorted({len(x) for x in before}):
        rows = [i for i, x in enumerate(before) if len(x) == length]
        some = np.flatnonzero(sizes + length <= 55)
        if len(some):
            blocks = np.zeros((len(some), 64), np.uint8)
            n = sizes[some]
            begins = np.cumsum(n) - n
            at = np.arange(n.sum()) - np.repeat(begins, n)
            blocks[np.repeat(np.arange(len(some)), n), length + at] = np.frombuffer(b"".join(after[i] for i in some), np.uint8)
            blocks[np.arange(len(some)), length + n] = 0x80
            blocks[:, 56:58] = ((length + n) * 8).astype("<u2").view(np.uint8).reshape(-1, 2)
            tails = np.ascontiguousarray(blocks.view("<u4").T)
            step = max(1, (1 << 16) // len(some))
            for r in range(0, len(rows), step):
                heads = np.array([np.frombuffer(before[i].ljust(64, b"\0"), "<u4") for i in rows[r : r + step]])
                words = [tails[i][None] | heads[:, i, None] if 4 * i < length else tails[i][None] for i in range(16)]
                cells = np.ix_(rows[r : r + step], some)
                first[cells], last[cells] = _md5(words, (len(heads), len(some)))
        for j in np.flatnonzero(sizes + length > 55):
            for i in rows:
                digest = hashlib.md5(before[i] + after[j]).digest()
                first[i, j], last[i, j] = int.from_bytes(digest[:8], "big"), int.from_bytes(digest[8:], "big")
    return first, last


def _md5(words: list[np.ndarray], shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(shape, x) for x in start)
    for i in range(64):
        kind = i // 16
        f = d ^ (b & (c ^ d)) if kind == 0 else c ^ (d & (b ^ c)) if kind == 1 else b ^ c ^ d if kind == 2 else c ^ (b | ~d)
        f += a
        f += words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16]
        f += _SINES[i]
        turn = _TURNS[kind][i % 4]
        high = f << np.uint32(turn)
        f >>= np.uint32(32 - turn)
        high |= f
        high += b
        a, b, c, d = d, high, b, c
    a, b, c, d = ((x + s).byteswap().astype(np.uint64) for x, s in zip((a, b, c, d), start))
    return (a << np.uint64(32)) | b, (c << np.uint64(32)) | d


def last_dealt(units: DataFrame, draws: DataFrame, total: int) -> DataFrame:
    """(draw, first, last, place) of the last unit, by hash and place, that each draw takes. ``units`` has blocks of units (places,
    after: what their hashes are taken of, without the beginning), ``draws`` blocks of draws (block, draws: their numbers, before:
    how the texts of their hashes begin, sizes: how many of the ``total`` units they take, fewer than all).

    Selection, not a sort: units under a bound are counted, only those near the place where the hash has to be (by 6 standard
    deviations and 30) are held; where it isn't there, the bounds are moved apart and it is looked for again."""
    schema = "draw int, first long, last long, place long"
    spark, width, out = units.sparkSession, 1, []
    blocks = max(1, draws.count())

    def select(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
        block, own = None, []

        def found():
            rows = []
            for draw, n, below, near in own:
                h, l, o = (np.concatenate([x[i] for x in near]) if near else np.empty(0, np.uint64) for i in range(3))
                if 0 < n - below <= len(h):
                    at = np.lexsort((o, l, h))[n - below - 1]
                    rows.append((draw, h[at].astype(np.int64), l[at].astype(np.int64), int(o[at])))
                else:
                    rows.append((draw, None, None, None))
            return pa.RecordBatch.from_pylist([dict(zip(("draw", "first", "last", "place"), map(lambda x: None if x is None else int(x), r))) for r in rows], pa.schema([("draw", pa.int32()), *((c, pa.int64()) for c in ("first", "last", "place"))]))

        for b in batches:
            for r in range(b.num_rows):
                if b.column("block")[r].as_py() != block:
                    if own:
                        yield found()
                    block, before, sizes = (b.column(c)[r].as_py() for c in ("block", "before", "sizes"))
                    own = [[d, n, 0, []] for d, n in zip(b.column("draws")[r].as_py(), sizes)]
                    off = [(6 * math.sqrt(n * (1 - n / total)) + 30) * width for n in sizes]
                    lo = [np.uint64(max(0, int((n - x) / total * 2**64))) for n, x in zip(sizes, off)]
                    hi = [np.uint64(min(2**64 - 1, int((n + x) / total * 2**64))) for n, x in zip(sizes, off)]
                    before = [x.encode() for x in before]
                places = b.column("places")[r].values.to_numpy().astype(np.uint64)
                first, last = many_chances(before, [x.encode() for x in b.column("after")[r].as_py()])
                for i, o in enumerate(own):
                    o[2] += int((first[i] < lo[i]).sum())
                    near = np.flatnonzero((first[i] >= lo[i]) & (first[i] <= hi[i]))
                    o[3].append((first[i][near], last[i][near], places[near]))
        if own:
            yield found()

    while draws is not None:
        pairs = units.select("places", "after").crossJoin(F.broadcast(draws)).repartition(blocks, "block").sortWithinPartitions("block")
        rows = pairs.mapInArrow(functools.partial(select, width=width), schema).collect()  # a row per draw
        out += [tuple(r) for r in rows if r["first"] is not None]
        missing = [r["draw"] for r in rows if r["first"] is None]
        width *= 8
        draws = None if not missing else _some_draws(draws, missing)
    return spark.createDataFrame(out, schema)


def _some_draws(draws: DataFrame, numbers: list[int]) -> DataFrame:
    each = draws.select("block", F.explode(F.arrays_zip("draws", "before", "sizes")).alias("d")).where(F.col("d.draws").isin(numbers))
    return each.groupBy("block").agg(*(F.collect_list(f"d.{c}").alias(c) for c in ("draws", "before", "sizes")))


def _least_hashes(df: DataFrame, n: str, total: str) -> DataFrame:
    """Rows whose hash ``_h`` is under a bound that ``n`` of ``total`` pass, by 10 standard deviations and 30."""
    bound = (F.col(n) + 10 * F.sqrt(F.col(n).cast("double")) + 30) / F.col(total)
    return df.where(F.conv(F.substring("_h", 1, 13), 16, 10).cast("double") / float(16**13) <= bound)


def _rank_within(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Adds 1..n in each of few groups, without bringing a group to one task."""
    placed = global_rank(df, [F.col(c) for c in [*group, *order]], "_place")
    first = placed.groupBy(*group).agg(F.min("_place").alias("_first"))
    same = functools.reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group])
    first = first.select(*(F.col(g).alias(f"_g_{g}") for g in group), "_first")
    return placed.join(F.broadcast(first), same).withColumn(out, F.col("_place") - F.col("_first") + 1).drop("_place", "_first", *(f"_g_{g}" for g in group))


def shuffled(df: DataFrame, keys: list[str], seed: str = "s", out: str = "place") -> DataFrame:
    """Rows with their place in a random order."""
    return global_rank(df.withColumn("_h", chance(F.lit(seed), *(F.col(k).cast("string") for k in keys))), [F.col("_h"), *map(F.col, keys)], out).drop("_h")


def bernoulli(long: DataFrame, keys: list[str], seed: str = "s", name: str = "context", value: str = "value") -> DataFrame:
    """1 with the probability that the cell has, else 0."""
    u = uniform(F.lit(seed), F.col(name), *(F.col(k).cast("string") for k in keys))
    return long.withColumn(value, (u < F.col(value)).cast("int"))


def contexts_by_size(elements: DataFrame, keys: list[str], sizes: int, least: int, seed: str = "s") -> DataFrame:
    """Random contexts of ``sizes`` sizes spread evenly from ``least`` to n - least: (keys, size)."""
    n = elements.select(*keys).distinct().agg(F.count("*").alias("_n"))
    step = (F.col("_n") - 2 * least) / max(1, sizes - 1)
    wanted = n.select(F.explode(F.sequence(F.lit(0), F.lit(sizes - 1))).alias("i"), "_n").select("i", F.floor(least + F.col("i") * step + 0.5).cast("long").alias("size"))
    grid = elements.select(*keys).distinct().crossJoin(F.broadcast(wanted)).crossJoin(F.broadcast(n))
    h = chance(F.lit(seed), F.col("i").cast("string"), *(F.col(k).cast("string") for k in keys))
    near = _least_hashes(grid.withColumn("_h", h), "size", "_n")
    return _rank_within(near.select("i", "_h", *keys, "size"), ["i"], ["_h", *keys], "_r").where(F.col("_r") <= F.col("size")).select(*keys, "size")


def sample_per_group(df: DataFrame, group: list[str], key: list[str], n: int, seed: str = "s") -> DataFrame:
    """At most n rows per group, by least hash. Ranks within parts first, so that a large group is not one task."""
    h = chance(F.lit(seed), *(F.col(k).cast("string") for k in key))
    parted = df.withColumn("_h", h).withColumn("_p", F.pmod(F.xxhash64(*key), F.lit(32)))
    first = parted.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_p").orderBy("_h", *key))).where(F.col("_r") <= n)
    return first.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy("_h", *key))).where(F.col("_r") <= n).drop("_h", "_p", "_r")


def process_codes(codes: DataFrame, keys: list[str], coder: str, code: str, least: int, most: int, seed: str = "s") -> DataFrame:
    """One code per element and coder; elements with ``least`` to ``most`` coders are kept, of those with more,
    ``most`` are drawn; others go."""
    named = codes.where(F.trim(code) != "").withColumn(coder, F.upper(coder))
    one = sample_per_group(named, [*keys, coder], [*keys, coder, code], 1, seed)
    n = one.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return sample_per_group(one.join(n.select(*keys), keys, "left_semi"), keys, [*keys, coder], most, seed)


def bootstrap(values: DataFrame, key: str, copies: int, size: int, seed: str = "s") -> DataFrame:
    """Draws with replacement: (copy, draw, key and columns of the row drawn). Rows are numbered 0..n-1 in ``key``."""
    n = values.agg(F.count("*").alias("_n"))
    spark = values.sparkSession
    draws = spark.range(copies * size).select(F.floor(F.col("id") / size).alias("copy"), (F.col("id") % size).alias("draw")).crossJoin(F.broadcast(n))
    draws = draws.withColumn(key, F.floor(uniform(F.lit(seed), F.col("copy").cast("string"), F.col("draw").cast("string")) * F.col("_n")).cast("long")).drop("_n")
    return draws.join(values, key)


def weighted_repetition(df: DataFrame, value: str) -> DataFrame:
    """Each row as often as its value says."""
    return df.where(F.col(value) >= 1).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(value).cast("int"))))


def hold_out(tokens: DataFrame, doc: list[str], order: list[str], docs_share: float = 0.1, tokens_share: float = 0.5, seed: str = "s") -> DataFrame:
    """Marks held-out tokens: half of the tokens of a tenth of the documents."""
    d = uniform(F.lit(seed), *(F.col(c).cast("string") for c in doc)) < docs_share
    t = uniform(F.lit(seed + "t"), *(F.col(c).cast("string") for c in [*doc, *order])) < tokens_share
    return tokens.withColumn("held_out", d & t)


# The consonants and vowels of artificial syllables, each of which is consonant, vowel, consonant.
CONSONANTS = ["b", "c", "ch", "d", "f", "g", "h", "j", "k", "l", "m", "n", "p", "r", "s", "sh", "t", "v", "w", "z"]
VOWELS = ["a", "e", "i", "o", "u", "a1", "e1", "i1", "o1", "u1"]


def make_corpus(spark: SparkSession, n_types: int = 1200, n_utts: int = 1000, skewed: bool = True, monosyllabic: bool = False, shortest_first: bool = False, words_per_utt: int = 4, seed: str = "s") -> tuple[DataFrame, DataFrame]:
    """(dictionary, utterances) of an artificial language. A third of the types each has 2, 3 and 4 (or 1, 2 and 3)
    syllables, no syllable is used twice. Word frequencies are equal, or fall with 1/rank, rounded half to even; ranks are
    shuffled, or in the order of making with ``shortest_first``. The words are spoken in random order, in utterances of
    four words; if that leaves a remainder, the last utterances have one word less.

    dictionary: word, phon, n_syl, freq (0 for words too rare to be spoken). utterances: utt, orth, phon."""
    sizes = [1, 2, 3] if monosyllabic else [2, 3, 4]
    n = 3 * round(n_types / 3)
    need, there = sum(sizes) * n // 3, len(CONSONANTS) ** 2 * len(VOWELS)
    if need > there:
        raise ValueError(f"{n} words need {need} syllables, there are {there}")
    nc, nv = len(CONSONANTS), len(VOWELS)
    part = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (F.floor(at) + 1).cast("int"))
    syl = spark.range(0, there, 1, 1).select(F.concat(part(CONSONANTS, F.col("id") / (nv * nc)), part(VOWELS, F.col("id") / nc % nv), part(CONSONANTS, F.col("id") % nc)).alias("syl"))
    syl = syl.withColumn("at", F.row_number().over(Window.orderBy(chance(F.lit(seed), F.col("syl")), "syl")) - 1)  # 4000 rows
    words = spark.range(0, n, 1, 1).select(F.col("id").alias("made"), F.element_at(F.array(*map(F.lit, sizes)), (F.col("id") % 3 + 1).cast("int")).alias("n_syl"))
    first = F.floor(F.col("made") / 3) * sum(sizes) + F.element_at(F.array(*(F.lit(sum(sizes[:i])) for i in range(3))), (F.col("made") % 3 + 1).cast("int"))
    spread = words.withColumn("first", first).select("made", "n_syl", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n_syl") - 1)).alias("at"))
    formed = spread.join(syl, "at").groupBy("made", "n_syl").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "syl"))), lambda x: x["syl"]), "-").alias("phon"))
    order = [F.col("made")] if shortest_first else [chance(F.lit(seed + "r"), F.col("phon")), F.col("phon")]
    formed = formed.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # at most 4000 rows
    total = n_utts * words_per_utt
    scale = total / sum(1 / (i + 1) for i in range(n))
    freq = F.bround(F.lit(scale) / F.col("rank"), 0) if skewed else F.bround(F.lit(total / n), 0)
    dictionary = formed.select(F.translate("phon", "-", "").alias("word"), "phon", F.col("n_syl").cast("int"), freq.cast("long").alias("freq"))
    spoken = shuffled(weighted_repetition(dictionary, "freq"), ["word", "copy"], seed + "u", "n")
    words_spoken = spoken.agg(F.count("*")).first()[0]
    utts = -(-words_spoken // words_per_utt) or 1
    short, longer = divmod(words_spoken, utts)
    at = F.col("n") - 1
    number = F.when(at < longer * (short + 1), F.floor(at / (short + 1))).otherwise(longer + F.floor((at - longer * (short + 1)) / max(1, short)))
    said = F.transform(F.array_sort(F.collect_list(F.struct("n", "phon"))), lambda x: x["phon"])  # four words
    out = spoken.withColumn("utt", F.concat(F.lit("utt"), (number + 1).cast("long").cast("string"))).groupBy("utt").agg(F.array_join(said, " ").alias("phon"))
    return dictionary, out.select("utt", F.translate("phon", "-", "").alias("orth"), "phon")
