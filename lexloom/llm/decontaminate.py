"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are compared in a normal form (A-Z lower-cased, runs of ASCII punctuation and white space as
one blank). An item of n characters (bytes of the normal form) may be found with up to k = rate * n edits. By the
q-gram lemma such a region shares at least t = n + 1 - q - k * q q-grams with the item, on diagonals that differ by at
most k. So shared q-grams are counted per item in diagonal bands of width 2(k+1) that overlap by half; bands that
reach t are kept, and their regions are verified by a banded alignment.

Items of fewer than q characters have no q-gram; they are looked for exactly, as whole words.

The benchmark is a stated query set: it is read in blocks of bounded size, one at a time; a block's items are broadcast,
executors index them, and all documents are read against them without a shuffle. Shared q-grams are expanded in pieces of
bounded size, so repetitive texts and items need time, not memory.
"""

from __future__ import annotations

import bisect
import functools
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import Scratch, column_at, id_and_text, map_whole_rows, mix, quoted, ship_package, text_blocks, text_bytes

_U = np.uint64
_SLOTS = 21
#: Pairs of equal q-grams that are expanded at once.
_PIECE = 1 << 19


def _folded() -> bytes:
    out = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        out[b] = ord(c.lower()) if c.isalnum() else 32
    return bytes(out)


_FOLD = _folded()


def normal_form(text: bytes) -> tuple[bytes, np.ndarray]:
    """(normal form, for each of its bytes where it stood)."""
    data = np.frombuffer(text.translate(_FOLD), np.uint8)
    blank = data == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    at = np.flatnonzero(keep)
    return data[at].tobytes(), at


def _grams(raw: bytes, q: int) -> np.ndarray:
    """A 64-bit code of each q-gram, 8 <= q <= 16."""
    n = len(raw) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    head = np.ndarray((n,), "<u8", buffer=raw, strides=(1,))
    tail = np.ndarray((n,), "<u8", buffer=raw, offset=q - 8, strides=(1,))
    code = head * _U(0x9FB21C651E98DF25)
    code ^= code >> _U(32)
    code += tail
    code *= _U(0xD6E8FEB86659FD93)
    return code


def align(item: np.ndarray, region: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """(edits, end) of the best alignment of the whole item with a part of the region, on the diagonals low..high
    (region position minus item position). Each row of the band is one step of NumPy."""
    width = high - low + 1
    far = len(item) + len(region) + 1
    columns = np.arange(width)
    at = low + columns  # how many region bytes stand before each cell of row 0
    row = np.where((at >= 0) & (at <= len(region)), 0, far)
    padded = np.full(len(region) + 2 * (width + len(item)) + 2, -1, np.int64)
    shift = width + len(item)
    padded[shift : shift + len(region)] = region
    for i in range(1, len(item) + 1):
        at = i + low + columns
        near = padded[np.clip(at - 1 + shift, 0, len(padded) - 1)]
        new = row + (near != item[i - 1])  # same diagonal: the region byte before this cell
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new[(at < 0) | (at > len(region))] = far
        new = np.minimum.accumulate(new - columns) + columns
        new[(at < 0) | (at > len(region))] = far
        row = new
    best = int(row.argmin())
    return int(row[best]), len(item) + low + best


@dataclass
class Index:
    """Items, and the positions of the q-grams of those that are long enough for the lemma; shorter ones by length."""

    q: int
    ids: np.ndarray
    items: list[bytes]
    budget: np.ndarray
    needed: np.ndarray
    codes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    known: np.ndarray
    short: dict[int, dict[bytes, list[int]]] = field(default_factory=dict)

    @classmethod
    def build(cls, rows: list[tuple[int, str]], q: int, rate: float) -> Index:
        ids, items, codes, owner, offset = [], [], [], [], []
        short: dict[int, dict[bytes, list[int]]] = {}
        for item_id, text in rows:
            form = normal_form(text.encode("utf-8", "surrogatepass"))[0].strip(b" ")
            if not form:
                continue
            if len(form) < q:
                short.setdefault(len(form), {}).setdefault(form, []).append(len(items))
            else:
                grams = _grams(form, q)
                codes.append(grams)
                owner.append(np.full(len(grams), len(items), np.int32))
                offset.append(np.arange(len(grams), dtype=np.int32))
            ids.append(item_id)
            items.append(form)
        size = np.array([len(x) for x in items], np.int64)
        budget = np.maximum(0, np.minimum((rate * size).astype(np.int64), (size - q) // q))
        code = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        item, off = (np.concatenate(x) if x else np.empty(0, np.int32) for x in (owner, offset))
        order = np.argsort(code, kind="stable")
        code, item, off = code[order], item[order], off[order]
        distinct, first = np.unique(code, return_index=True)
        known = np.zeros(1 << _SLOTS, bool)
        known[(distinct >> _U(64 - _SLOTS)).astype(np.int64)] = True
        return cls(q, np.array(ids, np.int64), items, budget, size + 1 - q - budget * q, distinct, np.append(first, len(code)), item, off, known, short)

    def _bands(self, at: np.ndarray, gram: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(key, count, text, item, lowest diagonal) of the bands that the q-grams ``gram`` at ``at`` fall into, piece by
        piece; a band may come in several pieces."""
        n = self.first[gram + 1] - self.first[gram]
        total = np.concatenate(([0], np.cumsum(n)))
        for low in range(0, int(total[-1]), _PIECE):
            # a piece may begin and end inside the occurrences of one q-gram
            pair = np.arange(low, min(low + _PIECE, int(total[-1])))
            which = np.searchsorted(total, pair, side="right") - 1
            place = self.first[gram[which]] + pair - total[which]
            position, item = at[which], self.item[place].astype(np.int64)
            diagonal = position - self.offset[place]
            text = np.searchsorted(start, position, side="right") - 1
            half = self.budget[item] + 1
            for shift in (0, 1):
                band = (diagonal + shift * half) // (2 * half)
                key = mix((text.astype(np.uint64) << _U(32) | item.astype(np.uint64)) * _U(0x9E3779B97F4A7C15) + (2 * band + shift).astype(np.uint64))
                _, one, count = np.unique(key, return_index=True, return_counts=True)
                yield key[one], count, text[one], item[one], band[one] * 2 * half[one] - shift * half[one]

    def regions(self, raw: bytes, start: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, lowest diagonal, width) of the bands that reach the bound, in joined texts that begin at
        ``start``."""
        if not len(self.codes):
            return []
        codes = _grams(raw, self.q)
        at = np.flatnonzero(self.known[(codes >> _U(64 - _SLOTS)).astype(np.int64)])
        gram = np.searchsorted(self.codes, codes[at])
        gram[gram == len(self.codes)] = 0
        same = self.codes[gram] == codes[at]
        at, gram = at[same], gram[same]
        kept: tuple[np.ndarray, ...] | None = None
        pending: list[tuple[np.ndarray, ...]] = []

        def merged() -> tuple[np.ndarray, ...]:
            parts = [np.concatenate(c) for c in zip(*pending, *([kept] if kept else []))]
            _, one, back = np.unique(parts[0], return_index=True, return_inverse=True)
            return (parts[0][one], np.bincount(back, parts[1], len(one)).astype(np.int64), *(c[one] for c in parts[2:]))

        for part in self._bands(at, gram, start):
            pending.append(part)
            if sum(len(p[0]) for p in pending) > max(4 * _PIECE, len(kept[0]) if kept else 0):
                kept, pending = merged(), []
        if not pending and not kept:
            return []
        _, count, text, item, low = merged() if pending else kept
        good = np.flatnonzero(count >= self.needed[item])
        good = good[np.lexsort((low[good], item[good], text[good]))]
        return [(int(text[i]), int(item[i]), int(low[i]), int(2 * (self.budget[item[i]] + 1))) for i in good]

    def whole_words(self, raw: bytes, start: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Matches of the short items, which stand between blanks or the ends of a text."""
        data = np.frombuffer(raw, np.uint8)
        edge = (data == 32) | (data == 0)
        begins = np.flatnonzero(np.concatenate(([True], edge[:-1])) & ~edge)
        out = []
        for length, forms in self.short.items():
            fit = begins[(begins + length < len(data))]
            for at in fit[edge[fit + length]].tolist():
                for item in forms.get(raw[at : at + length], ()):
                    text = int(np.searchsorted(start, at, side="right")) - 1
                    out.append((text, item, at - int(start[text]), at - int(start[text]) + length, 0))
        return out

    @staticmethod
    def verify(form: bytes, part: bytes, low: int, width: int, k: int) -> tuple[int, int, int] | None:
        """(from, to, edits) of the best alignment in the band, if it keeps to the budget k."""
        x, y = np.frombuffer(form, np.uint8).astype(np.int64), np.frombuffer(part, np.uint8).astype(np.int64)
        edits, end = align(x, y, low - k, low + width + k)
        if edits > k:
            return None
        # the same from the end backwards gives the beginning
        back, length = align(x[::-1], y[:end][::-1], -k, k)
        return end - (length if back <= k else len(form)), end, edits

    def matches(self, forms: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, from, to, edits) of the verified regions of each text; of those of one item that overlap the best,
        by place within text and item."""
        raw = b"\0".join([*forms, b"\0" * 8])
        size = np.array([len(f) for f in forms], np.int64)
        start = np.cumsum(size + 1) - size - 1
        found = self.whole_words(raw, start) if self.short else []
        aligned: dict[tuple[int, int, bytes], tuple[int, int, int] | None] = {}
        for text, item, low, width in self.regions(raw, start):
            form, k = self.items[item], int(self.budget[item])
            low -= int(start[text])
            a = max(0, low - k)
            b = min(len(forms[text]), low + width + len(form) + k)
            part = forms[text][a:b]
            exact = part.find(form)
            if exact >= 0:
                while exact >= 0:  # all of them, as a band of a repetitive text holds several
                    found.append((text, item, a + exact, a + exact + len(form), 0))
                    exact = part.find(form, exact + len(form))
                continue
            key = (item, low - a, part)  # the regions of a repetitive text are equal
            if key not in aligned:
                if len(aligned) >= 1000:
                    aligned.clear()
                aligned[key] = self.verify(form, part, low - a, width, k)
            if aligned[key]:
                begin, end, edits = aligned[key]
                found.append((text, item, a + begin, a + end, edits))
        found.sort(key=lambda m: (m[0], m[1], m[4], m[2]))
        out: list[tuple[int, int, int, int, int]] = []
        taken: list[tuple[int, int]] = []  # places of the matches of this text and item, in order
        last = None
        for m in found:
            if m[:2] != last:
                last, taken = m[:2], []
            i = bisect.bisect_left(taken, (m[2], m[3]))
            if (i and taken[i - 1][1] > m[2]) or (i < len(taken) and taken[i][0] < m[3]):
                continue
            taken.insert(i, (m[2], m[3]))
            out.append(m)
        return out


_built: dict[str, Index] = {}


def _index_blocks(benchmark: DataFrame, item_col: str, text_col: str, q: int, rate: float, block_chars: int) -> tuple[int, Callable[[int], Callable[[], Index]]]:
    """(number of blocks, block -> what gives executors its index). A block's items are collected when it is asked for and
    broadcast as they are; a worker builds the index at first use and keeps one at a time."""
    spark = benchmark.sparkSession
    ship_package(spark)
    rows = benchmark.select(F.col(quoted(item_col)).cast("long").alias("item"), F.col(quoted(text_col)).cast("string").alias("text")).where("item is not null and text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))

    def block(i: int) -> Callable[[], Index]:
        items = [(r[0], r[1]) for r in rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == i).orderBy("item", "text").collect()]
        held, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def index() -> Index:
            if name not in _built:
                _built.clear()
                _built[name] = Index.build(held.value, q, rate)
            return _built[name]

        return index

    return blocks, block


def _block_matches(block: pa.RecordBatch, column: str | int, index: Index) -> list[tuple[int, int, int, int, int]]:
    """Matches of a block with places in code points of the original texts."""
    texts = [bytes(t) for t in text_bytes(block.column(column))]
    forms = [normal_form(t) for t in texts]
    out, last, before = [], None, np.empty(0, np.int64)
    for text, item, a, b, edits in index.matches([f for f, _ in forms]):
        at = forms[text][1]
        if text != last:
            # how many characters begin before each byte
            before = np.concatenate(([0], np.cumsum((np.frombuffer(texts[text], np.uint8) & 0xC0) != 0x80)))
            last = text
        start, stop = int(at[a]), int(at[b - 1]) + 1
        out.append((text, item, int(before[start + 1]) - 1, int(before[stop]), edits))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = 10, rate: float = 0.06, block_chars: int = 2 << 20) -> DataFrame:
    """A row per region of a document that holds a benchmark item: doc_id, item_id, start, stop (code points of the
    text), edits. Of overlapping regions of one item the one with the fewest edits is given. Documents without such
    a region have no row.

    An item whose normal form has n characters is found with up to min(rate * n, (n - q) / q) edits, both rounded down;
    the second is what the lemma can find, and the smaller one for a few n below 25 only. Items of fewer than q
    characters are found exactly, as whole words.

    Defined cases: null and empty texts match nothing; null ids and repeated rows are carried through; items with a
    null id or text, and items without a letter or digit, are not looked for; items with the same id are looked for
    each; an empty table of documents or items gives an empty table; very long and repetitive texts take time in
    proportion to the q-grams that they share with items, and bounded memory. With several blocks of items the matches of
    each are written before the next block is read.
    """
    texts = id_and_text(docs, id_col, text_col)
    schema = "doc_id long, item_id long, start long, stop long, edits long"
    blocks, block_at = _index_blocks(benchmark, item_col, item_text_col, q, rate, block_chars)
    scratch = Scratch(docs.sparkSession, "contamination") if blocks > 1 else None
    parts = []
    for i in range(blocks):
        index_of = block_at(i)

        def find(batches, index_of=index_of):
            for block in text_blocks(batches):
                index = index_of()
                ids = block.column("doc_id").to_pylist()
                rows = [(ids[t], int(index.ids[i]), a, b, e) for t, i, a, b, e in _block_matches(block, "text", index)]
                c = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], names=["doc_id", "item_id", "start", "stop", "edits"])

        found = texts.mapInArrow(find, schema)
        parts.append(scratch.put(found, f"block-{i}") if scratch else found)
    return functools.reduce(DataFrame.union, parts)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = 10, rate: float = 0.06, block_chars: int = 2 << 20) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns, whatever their names. With one block of
    items nothing is shuffled; with several, the hashes of texts with a match are written per block, and then taken out
    by an anti-join."""
    blocks, block_at = _index_blocks(benchmark, item_col, item_text_col, q, rate, block_chars)
    if blocks == 1:
        index_of, at = block_at(0), column_at(docs, text_col)

        def clean(batches):
            for block in text_blocks(batches, at):
                keep = np.ones(block.num_rows, bool)
                keep[[m[0] for m in _block_matches(block, at, index_of())]] = False
                yield block.filter(pa.array(keep)).columns

        return map_whole_rows(docs, clean, docs.schema)
    text = F.col(quoted(text_col)).cast("string")
    digests = [F.xxhash64(text), F.xxhash64(F.lit("lexloom"), text)]
    texts = docs.select(digests[0].alias("a"), digests[1].alias("b"), text.alias("text")).where("text is not null")
    scratch, found = Scratch(docs.sparkSession, "contamination"), []
    for i in range(blocks):
        index_of = block_at(i)

        def hits(batches, index_of=index_of):
            for block in text_blocks(batches):
                at = pa.array(sorted({m[0] for m in _block_matches(block, "text", index_of())}), pa.int64())
                yield pa.RecordBatch.from_arrays([block.column("a").take(at), block.column("b").take(at)], names=["a", "b"])

        found.append(scratch.put(texts.mapInArrow(hits, "a long, b long").distinct(), f"block-{i}"))
    gone = functools.reduce(DataFrame.union, found).distinct().select(F.col("a").alias("_lexloom_a"), F.col("b").alias("_lexloom_b"))
    return docs.join(gone, (digests[0] == F.col("_lexloom_a")) & (digests[1] == F.col("_lexloom_b")), "left_anti")
