"""Secrets in texts: patterns, and a battery of randomness tests with control of false discoveries.

Patterns find assignments, access keys and long hexadecimal strings. Beyond these, every run of 16 or more characters of
the usual encodings is tested. Its encoding is the smallest alphabet that holds it; over that alphabet

* a chi-squared test asks whether the symbols are uniform,
* a runs test whether symbols of the two halves of the alphabet alternate as chance has it,
* a serial correlation test whether neighbours depend on each other,

and Fisher's method combines the three: a string that chance could have made passes. Short strings pass easily, words too;
so a string is only reported if *ordinary text* of its length would hardly look like it. The text of the corpus itself
gives that null: with the frequencies of its characters a string of the length would have more collisions (the sum
behind the chi-squared statistic), and with its rate of changes between small letters, capitals and digits fewer changes. The
two tails are combined, and the Benjamini-Hochberg rule is applied to all distinct strings of the corpus, in classes of
length, so that many short strings can't hide the long ones or pass on their strength.

Counts and thresholds come from all documents: one pass gathers character counts and the distinct strings' statistics, an
aggregation gives the thresholds (a bounded histogram), a second pass gives the spans.
"""

from __future__ import annotations

import itertools
import math
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import Scratch, id_and_text, text_blocks

KINDS = ("assign", "access", "hex", "random")

#: Fixed patterns. Letters of the names in either case, A-Z only.
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a shorter run has no part that is longer

#: Strings that are tested.
SHORTEST = 16
_STRING = re.compile(rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}")

#: Fixed alphabets, from small to large; of those of one size the first that holds a string is its encoding.
_LOWER, _UPPER, _DIGIT = string.ascii_lowercase, string.ascii_uppercase, string.digits
ENCODINGS = {
    "digits": _DIGIT, "hex": _DIGIT + "abcdef", "HEX": _DIGIT + "ABCDEF", "lower": _LOWER, "UPPER": _UPPER, "base32": _UPPER + "234567", "base36": _DIGIT + _LOWER,
    "BASE36": _DIGIT + _UPPER, "base62": _UPPER + _LOWER + _DIGIT, "base64": _UPPER + _LOWER + _DIGIT + "+/", "base64url": _UPPER + _LOWER + _DIGIT + "-_",
}
_NAMES = list(ENCODINGS)
_SETS = [frozenset(a.encode()) for a in ENCODINGS.values()]
_PLACE = np.full((len(ENCODINGS), 128), -1, np.int64)
for _i, _a in enumerate(ENCODINGS.values()):
    _PLACE[_i, list(_a.encode())] = np.arange(len(_a))
_CLASS = np.zeros(256, np.int8)
for _i, _a in enumerate((_LOWER, _UPPER, _DIGIT, "+/_-")):
    _CLASS[list(_a.encode())] = _i + 1

#: Classes of length, by their smallest members.
CLASSES = (16, 20, 24, 32, 48, 64)
#: Histogram of -log(p): steps per unit, and bins.
_STEPS, _BINS = 10, 7000


def _tail(z: float) -> float:
    """The upper tail of the normal distribution."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def _fisher(*p: float) -> float:
    """Fisher's combination of p-values: the tail of a chi-squared variable with two degrees of freedom for each."""
    t = -sum(math.log(max(x, 1e-300)) for x in p)
    return min(1.0, math.exp(-t) * sum(t**i / math.factorial(i) for i in range(len(p))))


def encoding_of(symbols: bytes) -> int | None:
    """The number of the smallest alphabet that holds all symbols."""
    have = set(symbols)
    return next((i for i, a in enumerate(_SETS) if have <= a), None)


@dataclass(frozen=True)
class Looks:
    """What is known of a string: its encoding, length, equal pairs, changes of class, and how likely a random string
    is to look less random."""

    encoding: int
    length: int
    collisions: int
    changes: int
    p_random: float


def looks_of(symbols: bytes) -> Looks | None:
    """The battery's statistics; none if no encoding holds the string."""
    encoding = encoding_of(symbols)
    if encoding is None:
        return None
    data = np.frombuffer(symbols, np.uint8)
    place, a, n = _PLACE[encoding][data], len(_SETS[encoding]), len(symbols)
    count = np.bincount(place, minlength=a)
    collisions = int((count * (count - 1) // 2).sum())
    # chi-squared: its exact mean and variance under uniformity, and the cube-root approximation of the tail
    chi, mean, var = a / n * (2 * collisions + n) - n, a - 1, 2 * (a - 1) * (n - 1) / n
    freedom = 2 * mean * mean / var
    p_uniform = _tail(((max(chi, 0.0) / mean) ** (1 / 3) - 1 + 2 / (9 * freedom)) / math.sqrt(2 / (9 * freedom)))
    # runs of symbols of the lower and the upper half of the alphabet
    high = place >= a / 2
    n1 = int(high.sum())
    n0 = n - n1
    if n1 and n0:
        runs, expected = 1 + int((high[1:] != high[:-1]).sum()), 2 * n1 * n0 / n + 1
        spread = math.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 1e-9))
        p_runs = 2 * _tail(max(0.0, abs(runs - expected) - 0.5) / spread)
    else:
        p_runs = 2.0 ** max(1 - n, -900)
    # correlation of neighbours
    centred = place - place.mean()
    total = float((centred * centred).sum())
    p_serial = 2 * _tail(abs(float((centred[1:] * centred[:-1]).sum()) / total + 1 / n) * math.sqrt(n)) if total else 0.0
    kind = _CLASS[data]
    return Looks(encoding, n, collisions, int((kind[1:] != kind[:-1]).sum()), _fisher(p_uniform, min(1.0, p_runs), min(1.0, p_serial)))


@dataclass(frozen=True)
class Background:
    """Ordinary text: for each encoding the sums of squares and of cubes of its characters' shares, and the rate of changes
    of class between neighbours in words."""

    squares: tuple[float, ...]
    cubes: tuple[float, ...]
    rate: float

    @staticmethod
    def of(counts: np.ndarray, pairs: int, changes: int) -> Background:
        """From the counts of the 128 ASCII characters; one is added to each, so that none is impossible."""
        squares, cubes = [], []
        for a in _SETS:
            p = counts[sorted(a)] + 1.0
            p /= p.sum()
            squares.append(float((p**2).sum()))
            cubes.append(float((p**3).sum()))
        return Background(tuple(squares), tuple(cubes), (changes + 1) / (pairs + 2))

    def p_ordinary(self, x: Looks) -> float:
        """How likely ordinary text of this length looks as random: as few collisions and as many changes of class."""
        n, s, c = x.length, self.squares[x.encoding], self.cubes[x.encoding]
        mean = n * (n - 1) / 2 * s
        var = n * (n - 1) / 2 * (s - s * s) + n * (n - 1) * (n - 2) * max(0.0, c - s * s)
        few = _tail((mean - x.collisions - 0.5) / math.sqrt(max(var, 1e-9)))
        share, rate = x.changes / (n - 1), min(self.rate, 1 - 1e-9)
        many = 1.0
        if share > rate:  # Chernoff's bound on the binomial tail
            many = math.exp(-(n - 1) * (share * math.log(share / rate) + ((1 - share) * math.log((1 - share) / (1 - rate)) if share < 1 else 0.0)))
        return _fisher(few, many)

    def bin(self, x: Looks) -> int:
        return min(_BINS - 1, int(-math.log(max(self.p_ordinary(x), 1e-300)) * _STEPS))


def length_class(n: int) -> int:
    return sum(n >= c for c in CLASSES) - 1


def least_bin(histogram: dict[int, int], tested: int, fdr: float) -> int:
    """Benjamini-Hochberg on a histogram of -log(p): the smallest bin that is discovered. Of a bin's p-values the largest
    that it may hold counts."""
    found, least = 0, _BINS
    for b in sorted(histogram, reverse=True):
        found += histogram[b]
        if math.exp(-b / _STEPS) <= fdr * found / tested:
            least = b
    return least


def _strings(text: str):
    """(start, end, bytes) of the runs that are tested."""
    for m in _STRING.finditer(text):
        yield m.start(), m.end(), m[0].encode()


def _gather(texts: DataFrame) -> DataFrame:
    """A row per distinct string of a block (h: its 128-bit hash as two longs), and, without hash, a row per task with the
    counts of ASCII characters and of neighbours in words."""

    def run(batches):
        counts, pairs, changes = np.zeros(256, np.int64), 0, 0
        for block in text_blocks(batches):
            seen: dict[bytes, Looks] = {}
            for text in block.column("text").to_pylist():
                if not text:
                    continue
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                counts += np.bincount(data, minlength=256)
                kind = _CLASS[data]
                inside = (kind[1:] > 0) & (kind[:-1] > 0)
                pairs += int(inside.sum())
                changes += int((inside & (kind[1:] != kind[:-1])).sum())
                for _, _, symbols in _strings(text):
                    key = xxhash.xxh3_128_digest(symbols)
                    if key not in seen and (x := looks_of(symbols)):
                        seen[key] = x
            if seen:
                key = np.frombuffer(b"".join(seen), np.int64).reshape(-1, 2)
                rows = list(zip(*((x.encoding, x.length, x.collisions, x.changes, x.p_random) for x in seen.values())))
                yield pa.RecordBatch.from_arrays([pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy()), *(pa.array(r, t) for r, t in zip(rows, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))), pa.nulls(len(seen), pa.list_(pa.int64()))], names=names)
        none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64())]
        yield pa.RecordBatch.from_arrays([*none, pa.array([[*counts[:128].tolist(), pairs, changes]], pa.list_(pa.int64()))], names=names)

    names = ["h1", "h2", "encoding", "length", "collisions", "changes", "p_random", "counts"]
    return texts.select("text").mapInArrow(run, "h1 long, h2 long, encoding int, length long, collisions long, changes long, p_random double, counts array<long>")


@dataclass(frozen=True)
class Thresholds:
    """The background, the least probability of the battery, and for each class of length the first bin discovered."""

    background: Background
    p_random: float
    least: tuple[int, ...]

    def reported(self, symbols: bytes) -> bool:
        x = looks_of(symbols)
        return x is not None and x.p_random >= self.p_random and self.background.bin(x) >= self.least[length_class(x.length)]


def learn_thresholds(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.05, p_random: float = 0.01) -> Thresholds:
    """Thresholds from all texts: at most a share ``fdr`` of the distinct strings reported is expected to be ordinary text,
    and a share ``p_random`` of random strings is lost to the battery."""
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = scratch.put(_gather(id_and_text(docs, id_col, text_col)), "strings")
    found = rows.where("counts IS NOT NULL").agg(*(F.expr(f"coalesce(sum(counts[{i}]), 0)") for i in range(130))).first()
    background = Background.of(np.array(found[:128], np.float64), found[128], found[129])

    def place(batches):
        tally: dict[tuple[int, int], int] = {}
        for b in batches:
            for e, n, c, x, p in zip(*(b.column(i).to_pylist() for i in range(5))):
                looks = Looks(e, n, c, x, p)
                at = (length_class(n), background.bin(looks) if p >= p_random else -1)
                tally[at] = tally.get(at, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in tally], pa.int32()), pa.array([k[1] for k in tally], pa.int32()), pa.array(list(tally.values()), pa.int64())], names=["class", "bin", "n"])

    distinct = rows.where("counts IS NULL").dropDuplicates(["h1", "h2"]).select("encoding", "length", "collisions", "changes", "p_random")
    histogram: list[dict[int, int]] = [{} for _ in CLASSES]
    for r in distinct.mapInArrow(place, "class int, bin int, n long").groupBy("class", "bin").agg(F.sum("n")).collect():
        histogram[r[0]][r[1]] = r[2]
    scratch.close()
    least = tuple(least_bin({b: n for b, n in h.items() if b >= 0}, sum(h.values()), fdr) for h in histogram)
    return Thresholds(background, p_random, least)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of what the patterns find, leftmost first and without overlap in each kind."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def random_spans(text: str, base: list[tuple[int, int, int]], thresholds: Thresholds) -> list[tuple[int, int, int]]:
    """Strings that the tests report and no base span covers."""
    reach = [0, *itertools.accumulate((b[2] for b in base), max)]  # furthest end of the spans that start up to here
    starts = [b[0] for b in base]
    out, at = [], 0
    for start, end, symbols in _strings(text):
        while at < len(starts) and starts[at] <= start:
            at += 1
        if reach[at] < end and thresholds.reported(symbols):
            out.append((start, 3, end))
    return out


SPAN = "array<struct<kind: string, start: long, end: long>>"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.05, p_random: float = 0.01, thresholds: Thresholds | None = None) -> DataFrame:
    """A row per row of ``docs``: doc_id, base (spans of the patterns) and spans (these and the strings that the tests
    report), arrays of kind, start and end in code points, end exclusive, by start and then kind (assign, access,
    hex, random). An assignment's span begins with its name and ends with its value.

    ``thresholds`` of another corpus can be given; by default they are learned from all of ``docs``.

    Defined cases: null and empty texts have no spans; null and repeated ids are carried through, each row is scanned
    by itself; a string that many documents hold counts once for the thresholds; an empty table gives an empty
    table; other columns are ignored, whatever their names; a text is scanned whole, however long, within memory for a
    few copies of it."""
    known = thresholds or learn_thresholds(docs, id_col, text_col, fdr, p_random)
    inner = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def pack(spans: list[list[tuple[int, int, int]]]) -> pa.Array:
        ends = pa.array(np.cumsum([0, *map(len, spans)]).astype(np.int32))
        flat = list(itertools.chain.from_iterable(spans))
        return pa.ListArray.from_arrays(ends, pa.array([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in flat], inner))

    def run(batches):
        for block in text_blocks(batches):
            base, spans = [], []
            for text in block.column("text").to_pylist():
                base.append(base_spans(text) if text else [])
                spans.append(sorted(base[-1] + random_spans(text, base[-1], known)) if text else [])
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pack(base), pack(spans)], names=["doc_id", "base", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, base {SPAN}, spans {SPAN}")
