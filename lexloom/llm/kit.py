"""Plumbing shared by the training-data operators.

* scratch tables (see lexloom.scratch): lineage is cut by writing Parquet into the folder that the cluster names in
  ``spark.checkpoint.dir``, shared by driver and executors;
* text blocks: the texts of an Arrow batch are handled as one byte string of a few MB, so that NumPy works on
  many documents at once and memory does not depend on the number of rows in a batch;
* hashing: words, lines and chunks get 64-bit hashes from one prefix sum over the block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.scratch import Scratch, scoped, ship_package

__all__ = ["Block", "Scratch", "bounded_sample", "column_at", "id_and_text", "map_whole_rows", "mix", "quoted", "scoped", "ship_package", "text_blocks", "text_bytes"]

#: Bytes of text handled at once.
BLOCK_BYTES = 2 << 20

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)

# --------------------------------------------------------------------------- text blocks


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that an operator reads, under fixed names; other columns can't clash with its own."""
    ship_package(docs.sparkSession)
    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))


def map_whole_rows(rows: DataFrame, function: Callable, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for tables whose columns may have any names: ``function`` gets record batches with the columns of
    ``rows`` in their order and gives lists of arrays, in the order of ``schema``."""
    inside = [f"c{i}" for i in range(len(schema))]

    def run(batches):
        for arrays in function(batches):
            yield pa.RecordBatch.from_arrays(arrays, names=inside)

    given = T.StructType([T.StructField(n, f.dataType) for n, f in zip(inside, schema)])
    return rows.toDF(*(f"c{i}" for i in range(len(rows.columns)))).mapInArrow(run, given).toDF(*schema.names)


def column_at(df: DataFrame, name: str) -> int:
    """The place of a column, whatever the case of its name."""
    return next(i for i, c in enumerate(df.columns) if c.lower() == name.lower())


def text_blocks(batches: Iterable[pa.RecordBatch], column: str | int = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices batches into blocks of about ``size`` bytes of text, of one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def text_bytes(column: pa.Array) -> list[memoryview]:
    """The UTF-8 bytes of each text; null counts as empty."""
    array = pc.fill_null(column, "").cast(pa.large_string())
    n = len(array)
    if not n:
        return []
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, array.offset * 8).tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    return [view[a:b] for a, b in zip(at, at[1:])]


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: What separates words: [\x20\x09-\x0D].
SPACE = _table(b" \t\n\x0b\x0c\r")


class Block:
    """Texts as one byte string, with a newline before, between and after them.

    ``data`` has the bytes; text i is ``data[start[i]:end[i]]``.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        parts = text_bytes(column)
        raw = b"\n" + b"\n".join(parts) + b"\n"
        self.raw = raw.lower() if lower else raw  # bytes.lower() changes A-Z only
        self.data = np.frombuffer(self.raw, np.uint8)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        self.end = np.cumsum(lengths + 1)
        self.start = self.end - lengths

    def __len__(self) -> int:
        return len(self.start)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin and end."""
        space = SPACE[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        return edge[0::2], edge[1::2]

    def ranges(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text, which of the sorted positions lie in it: from, to."""
        return np.searchsorted(starts, self.start), np.searchsorted(starts, self.end)

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """The text that each position lies in."""
        return np.searchsorted(self.start, positions, side="right") - 1

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return total[self.end] - total[self.start]


# --------------------------------------------------------------------------- hashing

_MULTIPLIER = 0xD6E8FEB86659FD93
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
#: Odd factors for sequences of hashes.
FACTORS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_powers: list[np.ndarray] = []
#: Bytes up to which a span is hashed by the polynomial.
_POLYNOMIAL = 256


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            made.append(np.multiply.accumulate(row))
        _powers[:] = made
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, segment: int = 4 << 20) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]] for sorted spans that don't overlap. Equal bytes get equal hashes,
    wherever they stand. Works in segments, so that one very long text takes no more memory.

    Short spans get a polynomial mod 2^64 from one prefix sum; for longer ones there are texts of two letters that all
    such polynomials take for equal (Thue-Morse words, from 1,024 letters on), so these are hashed one by one."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, low + segment, side="right")))
        high = int(ends[stop - 1])
        powers, inverse = _power_tables(high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data[low:high]] * powers[: high - low], out=total[1:])
        a, b = starts[at:stop] - low, ends[at:stop] - low
        out[at:stop] = (total[b] - total[a]) * inverse[a]
        at = stop
    for i in np.flatnonzero(ends - starts > _POLYNOMIAL).tolist():
        out[i] = xxhash.xxh3_64_intdigest(np.ascontiguousarray(data[starts[i] : ends[i]]))
    return mix(out)


def sequence_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k neighbours."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n] * FACTORS[0]
    for j in range(1, k):
        out += hashes[j : n + j] * FACTORS[j]
    return mix(out)


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct k-word shingles of a document's word hashes; with fewer words, the sequence as one."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64)
    if n < k:
        return mix((hashes * FACTORS[32 : 32 + n]).sum(dtype=np.uint64, keepdims=True) + np.array([n], np.uint64) * _GOLD)
    return np.unique(sequence_hashes(hashes, k))


# --------------------------------------------------------------------------- sampling


def bounded_sample(rows: DataFrame, key: str, group: str, per_group: int, seed: str) -> DataFrame:
    """At most about ``per_group`` rows of each group, chosen by a hash of ``key``; the same rows in every run.

    One pass counts the groups (their number must be small: classes, not keys), a second one filters, so no group
    meets in one task. The exact bound is kept by the caller, who takes the smallest hashes."""
    counts = {r[0]: r[1] for r in rows.groupBy(group).count().collect()}
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 40)).alias("_u")
    cut = F.lit(-1).cast("long")
    for value, n in counts.items():
        if value is not None:
            cut = F.when(F.col(group) == F.lit(value), F.lit(int(min(1.0, 1.2 * per_group / n) * (1 << 40)))).otherwise(cut)
    return rows.withColumn("_u", u).where(F.col("_u") < cut)
