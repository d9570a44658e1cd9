"""Quality rules as a short-circuit cascade.

Base tests and further rules are one cascade: on a bounded sample each rule's cost, with the measures that it needs, and
the share it rejects are taken, the rules are put in order of rejections per second, and each rule, and each measure,
looks only at documents that no earlier rule has rejected. The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kit import SPACE, Block, _table, column_at, id_and_text, map_whole_rows, mix, sequence_hashes, span_hashes, text_blocks

_U = np.uint64
_SYMBOL = _table(b"#*$%&|<>")
_UPPER = _table(bytes(range(65, 91)))
_LETTER = _table(bytes([*range(65, 91), *range(97, 123)]))
#: First bytes of the characters of words.
_IN_WORD = ~SPACE & np.array([(b & 0xC0) != 0x80 for b in range(256)])
_WINDOW = 5

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


class Texts:
    """A block of documents and its words. Measures are taken when a rule asks for them, of the documents it asks
    for, and kept."""

    def __init__(self, column: pa.Array):
        self.block = block = Block(column)
        self.starts, self.ends = block.words()
        self.first, self.last = block.ranges(self.starts)
        self.n_words = self.last - self.first
        self._kept: dict[str, np.ndarray] = {"n_words": self.n_words}

    def __len__(self) -> int:
        return len(self.block)

    def forget(self) -> None:
        self._kept = {"n_words": self.n_words}

    def measure(self, name: str, which: np.ndarray) -> np.ndarray:
        """A measure of the documents ``which`` (sorted numbers)."""
        kept = self._kept.setdefault(name, np.full(len(self), -1, np.int64))
        open_ = which[kept[which] < 0]
        if len(open_):
            kept[open_] = getattr(self, f"_{name}")(open_)
        return kept[which]

    def bytes_of(self, i: int) -> np.ndarray:
        return self.block.data[self.block.start[i] : self.block.end[i]]

    def marked(self, table: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Marked bytes of each document."""
        return np.fromiter((np.count_nonzero(table[self.bytes_of(i)]) for i in which), np.int64, len(which))

    def _word_chars(self, which: np.ndarray) -> np.ndarray:
        return self.marked(_IN_WORD, which)

    def _n_symbols(self, which: np.ndarray) -> np.ndarray:
        return self.marked(_SYMBOL, which)

    def _n_lines(self, which: np.ndarray) -> np.ndarray:
        return 1 + np.fromiter((np.count_nonzero(self.bytes_of(i) == 10) for i in which), np.int64, len(which))

    def _n_dup_lines(self, which: np.ndarray) -> np.ndarray:
        """Lines with a word that are equal to an earlier line of the text."""
        out = np.zeros(len(which), np.int64)
        for j, i in enumerate(which.tolist()):
            lines = self.block.raw[self.block.start[i] : self.block.end[i]].split(b"\n")
            if len(lines) > 1:
                full = [x for x in lines if x.strip(b" \t\n\x0b\x0c\r")]
                out[j] = len(full) - len(set(full))
        return out

    def _n_repeat_words(self, which: np.ndarray) -> np.ndarray:
        """Words in 5-word windows that are found at least twice in the text."""
        n = self.n_words[which]
        end = np.cumsum(n)
        total = int(end[-1]) if len(end) else 0
        if total < _WINDOW:
            return np.zeros(len(which), np.int64)
        begin = end - n
        word = np.repeat(self.first[which] - begin, n) + np.arange(total)
        owner = np.repeat(np.arange(len(which)), n)
        keys = sequence_hashes(span_hashes(self.block.data, self.starts[word], self.ends[word]), _WINDOW)
        at = np.flatnonzero(owner[: total - _WINDOW + 1] == owner[_WINDOW - 1 :])
        keys = mix(keys[at] + owner[at].astype(np.uint64) * _U(0x9E3779B97F4A7C15))
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(total + 1, np.int64)
        cover[at[twice]] += 1
        cover[at[twice] + _WINDOW] -= 1
        marked = np.concatenate(([0], np.cumsum(np.cumsum(cover[:total]) > 0)))
        return marked[end] - marked[begin]


@dataclass(frozen=True)
class Rule:
    """``rejects(texts, which)`` returns a mask over the documents ``which``; ``base`` rules are the base tests."""

    name: str
    rejects: Callable[[Texts, np.ndarray], np.ndarray]
    base: bool = False


def _few_words(t: Texts, which: np.ndarray) -> np.ndarray:
    return t.n_words[which] < 10


def _repeat_words(t: Texts, which: np.ndarray) -> np.ndarray:
    return 100 * t.measure("n_repeat_words", which) > 20 * t.n_words[which]


def _word_length(t: Texts, which: np.ndarray) -> np.ndarray:
    chars, n = t.measure("word_chars", which), t.n_words[which]
    return (chars < 2 * n) | (chars > 15 * n)


def _symbols(t: Texts, which: np.ndarray) -> np.ndarray:
    return 10 * t.measure("n_symbols", which) > 3 * t.n_words[which]


def _dup_lines(t: Texts, which: np.ndarray) -> np.ndarray:
    return 10 * t.measure("n_dup_lines", which) > 3 * t.measure("n_lines", which)


def _upper_case(t: Texts, which: np.ndarray) -> np.ndarray:
    return 2 * t.marked(_UPPER, which) > t.marked(_LETTER, which)


def _no_letters(t: Texts, which: np.ndarray) -> np.ndarray:
    """More than a third of the words have neither a letter A-Z nor a character beyond ASCII."""
    out = np.zeros(len(which), bool)
    for j, i in enumerate(which):
        a, data = t.block.start[i], t.bytes_of(i)
        lettered = np.concatenate(([0], np.cumsum(_LETTER[data] | (data >= 128))))
        starts, ends = t.starts[t.first[i] : t.last[i]] - a, t.ends[t.first[i] : t.last[i]] - a
        out[j] = 3 * int(np.count_nonzero(lettered[ends] == lettered[starts])) > t.n_words[i]
    return out


#: Fixed limits: at least ten words; at most a fifth of the words in repeated windows; mean word of 2 to 15 characters; at
#: most 0.3 symbols a word; at most 30 % of lines repeated; at most half of the letters A-Z in upper case; at most a
#: third of the words without letters.
RULES = (
    Rule("few_words", _few_words, True), Rule("repeat_words", _repeat_words, True), Rule("word_length", _word_length), Rule("symbols", _symbols),
    Rule("dup_lines", _dup_lines), Rule("upper_case", _upper_case), Rule("no_letters", _no_letters),
)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = 2000) -> list[int]:
    """The rules' numbers in order of rejections per second, measured on about ``sample`` documents (doc_id, text).
    Each rule is timed with its measures not yet taken. The sample's bound is the parameter; it only decides the order
    of the work."""
    total = docs.count()
    share = int(min(1.0, sample / max(1, total)) * (1 << 30))
    some = docs.where(F.pmod(F.xxhash64(F.lit("rules"), "doc_id"), F.lit(1 << 30)) <= share).limit(2 * sample)

    def measure(batches):
        spent, rejected = np.zeros(len(rules)), np.zeros(len(rules), np.int64)
        for b in text_blocks(batches):
            t = Texts(b.column("text"))
            which = np.arange(len(t))
            for i, rule in enumerate(rules):
                t.forget()
                began = time.perf_counter()
                rejected[i] += int(rule.rejects(t, which).sum())
                spent[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rules))), pa.array(spent), pa.array(rejected)], names=["rule", "spent", "rejected"])

    found = some.mapInArrow(measure, "rule long, spent double, rejected long").groupBy("rule").agg(F.sum("spent"), F.sum("rejected")).collect()
    gain = {r[0]: r[2] / (r[1] + 1e-6) for r in found}
    return sorted(range(len(rules)), key=lambda i: (-gain.get(i, 0.0), i))


def cascade(t: Texts, rules: tuple[Rule, ...], order: list[int]) -> np.ndarray:
    """The documents that no rule rejects; each rule sees those that the rules before it let through."""
    alive = np.arange(len(t))
    for i in order:
        if len(alive):
            alive = alive[~rules[i].rejects(t, alive)]
    return alive


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample: int = 2000) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, kept (boolean).

    Defined cases: null and empty texts have no words and fail the base tests; null and repeated ids are carried
    through, each row is judged on its own; an empty table gives an empty table; other columns are ignored.
    """
    texts = id_and_text(docs, id_col, text_col)
    order = order_rules(texts, rules, sample)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(m, T.LongType()) for m in MEASURES), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    def judge(batches):
        for b in text_blocks(batches):
            t = Texts(b.column("text"))
            every, kept, failed = np.arange(len(t)), np.zeros(len(t), bool), np.zeros(len(t), bool)
            kept[cascade(t, rules, order)] = True
            for rule in rules:
                if rule.base:
                    failed |= rule.rejects(t, every)
            # the columns that are asked for need the measures of all documents
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(t.measure(m, every).astype(np.int64)) for m in MEASURES), pa.array(failed), pa.array(kept)], names=schema.names)

    return texts.mapInArrow(judge, schema)


def keep_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample: int = 2000) -> DataFrame:
    """The rows of ``docs`` that all rules let through, with all their columns, whatever their names; no shuffle. Null and
    empty texts have no words and go."""
    order = order_rules(id_and_text(docs, id_col, text_col), rules, sample)
    at = column_at(docs, text_col)

    def judge(batches):
        for b in text_blocks(batches, at):
            yield b.take(pa.array(cascade(Texts(b.column(at)), rules, order))).columns

    return map_whole_rows(docs, judge, docs.schema)
