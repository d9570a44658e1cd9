"""Best-fit packing by a configuration linear program over the length histogram.

The texts become token pieces (mapped, no shuffle). Only the histogram of piece lengths, with at most ``capacity``
entries, reaches the driver. There a linear program over *configurations* (multisets of lengths that fit a sequence)
is solved by multiplicative weights: each step prices the lengths, a knapsack dynamic program gives the most valuable
configuration and, from the same table, the most valuable one through each length, and those within ``slack`` of the best
are used, which lowers the prices of what they cover. Amounts are rounded as they are given out: down to whole numbers,
one at least, never more than there are pieces, so that all pieces are covered in the end. The last configurations have
little to choose from; what they would hold, up to ``tail`` of the tokens, is placed by best fit where that needs fewer
sequences. The plan is a table of intervals: the pieces of length l with rank a..b go to sequences s..s+(b-a) at one
offset. Its size depends on the capacity and the steps, not on the number of documents. Pieces are ranked within their
length in cells of bounded size and look their place up.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import struct
from collections.abc import Callable, Iterable, Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kit import Scratch, id_and_text, text_blocks

# --------------------------------------------------------------------------- tokens

# Up to U+024F the classes of letters, numbers and white space are stable and the same in all Unicode versions.
_L, _N, _W = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
_PIECES = re.compile(rf" ?[{_L}]+| ?[{_N}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_W}{_L}{_N}]+|[{_W}]+(?![^{_W}])|[{_W}]+")
_BEYOND = re.compile("[^\x00-ɏ]")
_SPACE_AFTER_SPACE = re.compile(rf"[{_W}] ")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself where it is printable in Latin-1,
    else the next free character from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = {}, 256
    for b in range(256):
        if b in own:
            out[chr(b)] = b
        else:
            out[chr(free)] = b
            free += 1
    return out


class _Parts(dict):
    """Ids of parts of texts, each with ``before`` in front of it; at most ``keep`` are kept."""

    def __init__(self, before: str, one: Callable[[bytes], list[int]], keep: int):
        self.before, self.one, self.keep = before, one, keep

    def __missing__(self, part: str) -> bytes:
        whole = self.before + part
        if part.isalpha():  # letters up to U+024F are one piece
            ids = self.one(whole.encode())
        else:
            ids = [i for p in _PIECES.findall(whole) for i in self.one(p.encode())]
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < self.keep:
            self[part] = found
        return found


class Encoder:
    """Texts to token ids (little-endian 32-bit), the same ids as ``Tokenizer.from_file(path).encode(text,
    add_special_tokens=False).ids``.

    For byte-level BPE files, texts are split where the tokenizer's own pattern always splits, and the ids of each
    part are kept for the next time it is met (at most ``keep`` parts). Texts with characters beyond U+024F or with
    the name of a special token, and other kinds of tokenizer files, go to the tokenizer itself.
    """

    def __init__(self, path: str, keep: int = 600_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = self._byte_bpe(spec)
        if self.fast:
            import tiktoken

            names = [t["content"] for t in spec["added_tokens"]]
            self.special = re.compile("|".join(map(re.escape, names))) if names else None
            byte = _byte_of_char()
            ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in names}
            self.bpe = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
            one = self.bpe.encode_single_piece
            self.spaced, self.plain = _Parts(" ", one, keep), _Parts("", one, keep // 20)

    @staticmethod
    def _byte_bpe(spec: dict) -> bool:
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        plain = not spec.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        if not (plain and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and model.get("type") == "BPE"):
            return False
        # ids must be in the order of the merges, so that they serve as ranks
        vocab = model["vocab"]
        pairs = ((m.split(" ") if isinstance(m, str) else m) for m in model["merges"])
        made = [vocab.get("".join(p), -1) for p in pairs]
        return all(a < b for a, b in zip(made, made[1:])) and made[:1] > [255]

    def encode(self, text: str) -> bytes:
        if not self.fast or _BEYOND.search(text) or (self.special and self.special.search(text)):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not text:
            return b""
        spaced, plain = self.spaced, self.plain
        if _SPACE_AFTER_SPACE.search(text):
            return b"".join([spaced[p[1:]] if p[0] == " " else plain[p] for p in _PIECES.findall(text)])
        # No space follows white space, so the pattern splits before each space.
        head, *parts = text.split(" ")
        return (plain[head] if head else b"") + b"".join(map(spaced.__getitem__, parts))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


PIECES = "doc_id long, piece int, start long, length int, ids binary"


def token_pieces(docs: DataFrame, tokenizer: str | None, capacity: int, end_id: int) -> DataFrame:
    """A row per piece of each document (doc_id, text): its ids are those of the text and then ``end_id``. Documents
    of more than ``capacity`` tokens are cut so that all pieces but the first are full."""

    def make(batches):
        encoder, tail = Encoder(tokenizer or default_tokenizer()), np.array([end_id], "<u4").tobytes()
        for block in text_blocks(batches):
            rows: list[tuple] = []
            for doc, text in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist()):
                ids = encoder.encode(text or "") + tail
                total = len(ids) // 4
                at, piece = 0, 0
                while at < total:
                    n = (total - 1) % capacity + 1 if not piece else capacity
                    rows.append((doc, piece, at, n, ids[4 * at : 4 * (at + n)]))
                    at, piece = at + n, piece + 1
            c = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.mapInArrow(make, PIECES)


# --------------------------------------------------------------------------- the linear program


#: Fixed point of prices, and steps of the covered share that they depend on.
_ONE, _SHARES = 1 << 40, 1 << 10


@functools.cache
def decay(eta: Fraction) -> np.ndarray:
    """exp(-eta * i / _SHARES) for i = 0 .. _SHARES in fixed point, by integers alone: the same on every CPU."""
    scale, step = 1 << 80, eta / _SHARES
    ratio, term, i = Fraction(0), Fraction(1), 0
    while abs(term) * scale > 1:  # the series of exp(-step)
        ratio += term
        i += 1
        term *= -step / i
    ratio, value, out = int(ratio * scale), scale, []
    for _ in range(_SHARES + 1):
        out.append(value * _ONE // scale)
        value = value * ratio // scale
    return np.array(out, np.int64)


def knapsack(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to ``capacity`` the value of the best multiset of the sorted ``lengths``, and one of its lengths (0
    if the room is as good with one less): an unbounded knapsack by dynamic programming in integers."""
    best, pick = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
    price = values[lengths]
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        n = fitting[room]
        if n:
            offers = price[:n] + best[room - lengths[:n]]
            at = int(offers.argmax())
            if offers[at] > best[room]:
                best[room], pick[room] = offers[at], lengths[at]
    return best, pick


def _multiset(pick: np.ndarray, room: int, length: int) -> dict[int, int]:
    """The best multiset of a room, and ``length`` beside it."""
    found = {length: 1}
    while room > 0:
        one = int(pick[room])
        if one:
            found[one] = found.get(one, 0) + 1
            room -= one
        else:
            room -= 1
    return found


def solve_configurations(counts: Mapping[int, int], capacity: int, eta: Fraction, share: Fraction, slack: Fraction) -> list[tuple[dict[int, int], int]]:
    """A cover of ``counts`` (length -> pieces) by configurations in whole amounts: [(configuration, times)].

    Multiplicative weights: length l has the price l * exp(-eta * covered share). A configuration is used to ``share`` of
    the amount at which it would first cover one of its lengths in full, rounded down, once at least. Prices and all
    that is compared are integers, so the cover does not depend on the CPU."""
    need = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        need[length] = n
    left = need.copy()
    size, falling = np.arange(capacity + 1), decay(eta)
    out: list[tuple[dict[int, int], int]] = []
    while left.any():
        lengths = np.flatnonzero(left)
        values = size * falling[(need - left) * _SHARES // np.maximum(need, 1)]
        best, pick = knapsack(values, lengths, capacity)
        through = values[lengths] + best[capacity - lengths]
        floor, used = int((1 - slack) * int(best[capacity])), False
        for i in np.lexsort((-lengths, -through)).tolist():
            length = int(lengths[i])
            if used and through[i] < floor:
                break
            if left[length] < 1:
                continue
            # not more of a length than there is left
            found = {x: min(k, int(left[x])) for x, k in _multiset(pick, capacity - length, length).items() if left[x] >= 1}
            if used and sum(int(values[x]) * k for x, k in found.items()) < floor:
                continue
            room = min(int(left[x]) // k for x, k in found.items())
            times = max(1, min(room, min(int(need[x]) * share.numerator // (share.denominator * k) for x, k in found.items())))
            for x, k in found.items():
                left[x] -= k * times
            out.append((found, times))
            used = True
    return out


class _Bins:
    """Sequences with room, equal ones together, and best fit on them."""

    def __init__(self, groups: Iterable[tuple[int, int, int]]):
        self.by_room: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []
        for group in groups:
            self.put(*group)

    def put(self, room: int, first: int, n: int) -> None:
        if room > 0:
            if room not in self.by_room:
                self.by_room[room] = []
                bisect.insort(self.rooms, room)
            self.by_room[room].append((first, n))

    def fit(self, left: Mapping[int, int], capacity: int, sequences: int, take: Callable[[int, int, int, int], None]) -> int:
        """Places what is ``left``, longest first, into the bins with the least room; gives the number of sequences."""
        for length in sorted(left, reverse=True):
            n = left[length]
            while n > 0:
                at = bisect.bisect_left(self.rooms, length)
                if at == len(self.rooms):
                    new = -(-n // (capacity // length))
                    self.put(capacity, sequences, new)
                    sequences += new
                    continue
                room = self.rooms[at]
                first, bins = self.by_room[room].pop()
                if not self.by_room[room]:
                    del self.by_room[room]
                    self.rooms.pop(at)
                times = min(bins, n)
                if times < bins:
                    self.put(room, first + times, bins - times)
                take(length, times, first, capacity - room)
                self.put(room - length, first, times)
                n -= times
        return sequences


#: (eta, share, slack) of the runs of the linear program. The next is only tried while the plan needs more sequences than
#: the volume, and those after the second only while it needs more than best fit alone.
EFFORT = tuple(tuple(map(Fraction, x)) for x in (("0.35", "1", "0.001"), ("6", "0.25", "0.05"), ("1", "0.5", "0.01"), ("0.1", "1", "0.001"), ("3", "0.25", "0.02"), ("12", "0.1", "0.1")))
#: The shares of the tokens that best fit may place at the end.
TAILS = tuple(map(Fraction, ("0", "0.01", "0.03", "0.1", "0.2", "0.3")))


class Plan:
    """Intervals of ranks per length and the sequences and offsets they go to. ``by_program`` is the number of pieces that
    the linear program has placed, ``pieces`` that of all. A plan depends on the counts alone, not on the machine, and never
    needs more sequences than best fit: should no run of the program reach that, best fit places everything."""

    def __init__(self, counts: Mapping[int, int], capacity: int, effort: tuple[tuple[Fraction, Fraction, Fraction], ...] = EFFORT, tails: tuple[Fraction, ...] = TAILS):
        total = {x: n for x, n in sorted(counts.items()) if n}
        tokens = sum(a * b for a, b in total.items())
        volume, alone = -(-tokens // capacity), self._count(total, capacity, [])
        best: tuple[int, list[tuple[dict[int, int], int]]] | None = None
        for i, setting in enumerate(effort):
            if best and (best[0] == volume or i > 1 and best[0] <= alone):
                break
            solution = solve_configurations(total, capacity, *setting)
            # full configurations first, so that the tail has those with room
            solution.sort(key=lambda x: sum(a * b for a, b in x[0].items()), reverse=True)
            for tail in tails:
                rest, cut = tokens, len(solution)
                for j, (found, times) in enumerate(solution):
                    if rest <= tail * tokens:
                        cut = j
                        break
                    rest -= times * sum(a * b for a, b in found.items())
                n = self._count(total, capacity, solution[:cut])
                if best is None or n < best[0]:
                    best = n, solution[:cut]
                if n == volume:
                    break
        if best and best[0] > alone:
            best = alone, []
        left, used, rows, groups, self.sequences = dict(total), dict.fromkeys(total, 0), [], [], 0

        def take(length: int, n: int, first: int, offset: int) -> None:
            rows.append((length, used[length], first, offset))
            used[length] += n
            left[length] -= n

        merged: dict[tuple, int] = {}
        for found, times in best[1] if best else ():
            key = tuple(sorted(found.items(), reverse=True))
            merged[key] = merged.get(key, 0) + times
        for key, times in sorted(merged.items(), key=lambda x: (-x[1], x[0])):
            offset = 0
            for length, k in key:
                for _ in range(k):
                    take(length, times, self.sequences, offset)
                    offset += length
            groups.append((capacity - offset, self.sequences, times))
            self.sequences += times
        self.pieces, self.by_program = sum(total.values()), sum(used.values())
        self.sequences = _Bins(groups).fit(dict(left), capacity, self.sequences, take)
        assert used == total
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 4)
        self.length, self.rank, self.first, self.offset = (np.ascontiguousarray(table[:, i]) for i in range(4))

    @staticmethod
    def _count(total: Mapping[int, int], capacity: int, chosen: list[tuple[dict[int, int], int]]) -> int:
        left, groups, n = dict(total), [], 0
        for found, times in chosen:
            for x, k in found.items():
                left[x] -= k * times
            groups.append((capacity - sum(a * b for a, b in found.items()), n, times))
            n += times
        return _Bins(groups).fit(left, capacity, n, lambda *_: None)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces with these lengths and ranks."""
        key = self.length << 44 | self.rank
        at = np.searchsorted(key, length << 44 | rank, side="right") - 1
        return self.first[at] + rank - self.rank[at], self.offset[at]


# --------------------------------------------------------------------------- the operator


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0, digests: Mapping[str, Column] | None = None, keep_ids: bool = True) -> tuple[DataFrame | None, DataFrame]:
    """(pieces, places). pieces has a row per piece with its token ids: row (a number of its own), doc_id, piece, start,
    length, ids (little-endian 32-bit); with ``keep_ids=False`` the ids are not written and pieces is None. places has row,
    doc_id, piece, start, length, sequence_id and offset of each, and the columns of ``digests``, expressions over pieces
    that are carried along.

    Each document's ids are those of its text and then ``end_id``; documents of more than ``capacity`` tokens are cut
    into pieces of which only the first may be shorter.

    Defined cases: null and empty texts have the end id only; rows with null or repeated ids are packed each on their
    own; ties in length are packed in any order; an empty table gives empty tables; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    made = token_pieces(id_and_text(docs, id_col, text_col), tokenizer, capacity, end_id).withColumn("row", F.monotonically_increasing_id())
    pieces = scratch.put(made, "pieces", compression="zstd") if keep_ids else None
    carried = dict(digests or {})
    meta = scratch.put((made if pieces is None else pieces).select("row", "doc_id", "piece", "start", "length", *(c.alias(n) for n, c in carried.items())), "meta")

    counts = {int(r[0]): int(r[1]) for r in meta.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = Plan(counts, capacity)
    # ranks within a length: cells of bounded size, numbered one after the other
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cell = max(1, sum(counts.values()) // (4 * partitions))
    parts = np.ones(capacity + 1, np.int64)
    for length, n in counts.items():
        parts[length] = -(-n // cell)
    spread = F.element_at(F.lit(parts.tolist()), F.col("length") + 1)
    meta = meta.withColumn("_cell", F.pmod(F.xxhash64("row"), spread).cast("int"))
    cells = sorted((int(r[0]), int(r[1]), int(r[2])) for r in meta.groupBy("length", "_cell").count().collect())  # at most capacity + 4 * partitions
    base = np.cumsum(parts) - parts
    before = np.zeros(int(parts.sum()), np.int64)
    for (length, c, _), n in zip(cells, _offsets(cells)):
        before[base[length] + c] = n
    ranked = meta.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_cell").orderBy("row")) - 1)
    held = spark.sparkContext.broadcast((plan, base, before))
    names = ["row", "doc_id", "piece", "start", "length", *carried]

    def place(batches):
        plan, base, before = held.value
        for b in batches:
            length, cell, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_cell", "_rank"))
            sequence, offset = plan.place(length, rank + before[base[length] + cell])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ranked.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return pieces, ranked.mapInArrow(place, schema)


def _offsets(cells: Iterable[tuple[int, int, int]]) -> list[int]:
    """For sorted (length, cell, n): how many pieces of the length stand in earlier cells."""
    out, at, last = [], 0, None
    for length, _, n in cells:
        if length != last:
            at, last = 0, length
        out.append(at)
        at += n
    return out


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves. A sequence has at most ``capacity`` pieces."""
    joined = places.join(pieces.select("row", "ids"), "row")
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return joined.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
