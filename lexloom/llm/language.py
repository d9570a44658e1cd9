"""Language identification with string kernels.

The kernel of two texts is a blended spectrum: of the letter n-grams (1 to 3) that the landmark texts have, those that
both texts have, over the geometric mean of how many each has. Landmarks are drawn from a bounded sample of labelled
texts; the Nyström map K_mm^(-1/2) turns kernel rows into features, on which ridge regression is fitted one versus
rest. Map and weights are one matrix, so a block of texts is scored by two matrix products: presence matrix times
landmark presence, normalised, times weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import bounded_sample, id_and_text, quoted, ship_package, text_blocks

_U = np.uint64
_SLOTS = 20
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _codes(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For n = 1, 2, 3 the n-gram codes of the texts (lower-cased, other characters as one blank; letters and single blanks
    only, one blank before and after each text) with the text that each belongs to, and whether a text has a letter. No
    n-gram reaches into another text."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("".join(f" {t} " for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in lowered])
    letter = _letter_table()[points]
    some = np.bincount(owner[letter], minlength=len(texts)) > 0
    chars = np.where(letter, points, np.uint32(32)).astype(np.uint64)
    keep = letter.copy()
    # a blank counts after a letter, and before the first one
    keep[1:] |= letter[:-1]
    keep[np.flatnonzero(np.diff(owner, prepend=-1))] = True
    chars, owner = chars[keep], owner[keep]
    # a text that begins with other characters has one blank there too
    twice = np.zeros(len(chars), bool)
    twice[1:] = (chars[1:] == 32) & (chars[:-1] == 32) & (owner[1:] == owner[:-1])
    chars, owner = chars[~twice], owner[~twice]
    out, code = [(chars, owner)], chars
    for n in (2, 3):
        code = code[:-1] << _U(21) | chars[n - 1 :]
        whole = owner[: len(code)] == owner[n - 1 :]
        out.append((code[whole], owner[: len(code)][whole]))
    return out, some


class Grams:
    """The n-grams of the landmarks, each with a column of the presence matrix."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.unique(codes)
        # a table of slots; n-grams whose slot is taken go to a further table under another hash, until all have one
        self.tables: list[tuple[np.uint64, np.ndarray]] = []
        left, rng = np.arange(len(self.codes)), np.random.default_rng(5)
        while len(left):
            factor = _U(rng.integers(1, 2**63)) * _U(2) + _U(1)
            slots = self._slot(self.codes[left], factor)
            _, first = np.unique(slots, return_index=True)
            table = np.full(1 << _SLOTS, -1, np.int32)
            table[slots[first]] = left[first]
            self.tables.append((factor, table))
            left = np.delete(left, first)

    @staticmethod
    def _slot(codes: np.ndarray, factor: np.uint64) -> np.ndarray:
        return ((codes * factor) >> _U(64 - _SLOTS)).astype(np.int64)

    def _mark(self, out: np.ndarray, owner: np.ndarray, codes: np.ndarray) -> None:
        for factor, table in self.tables:
            column = table[self._slot(codes, factor)]
            taken = column >= 0
            column, owner, codes = column[taken], owner[taken], codes[taken]
            same = self.codes[column] == codes
            out[owner[same], column[same]] = 1
            # whoever met another n-gram may be in the next table
            owner, codes = owner[~same], codes[~same]

    def presence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(a row per text with 1 where it has the n-gram, whether it has a letter)."""
        out = np.zeros((len(texts), len(self.codes)), np.float32)
        orders, some = _codes(texts)
        for codes, owner in orders:
            self._mark(out, owner, codes)
        return out, some

    def presence_of_sets(self, sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), len(self.codes)), np.float32)
        for i, codes in enumerate(sets):
            self._mark(out, np.full(len(codes), i), codes)
        return out


def gram_set(text: str) -> np.ndarray:
    """The distinct n-grams of a text."""
    return np.unique(np.concatenate([c for c, _ in _codes([text])[0]]))


@dataclass
class LanguageModel:
    languages: list[str]
    grams: Grams
    landmarks: np.ndarray  # columns: presence of each landmark over the root of its number of n-grams
    weights: np.ndarray  # landmarks x languages: Nyström map times ridge weights

    def kernel(self, presence: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(presence.sum(axis=1), 1))
        return (presence @ self.landmarks) / size[:, None]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score (the margin brought to 0..1) of each text."""
        presence, some = self.grams.presence(texts)
        # rounded, because the last digits of a product depend on the size of the block
        margins = np.round((self.kernel(presence) @ self.weights).astype(np.float64), 5)
        best = margins.argmax(axis=1)
        score = np.clip((margins[np.arange(len(texts)), best] + 1) / 2, 0, 1)
        return [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), some)], np.where(some, score, 0.0)


def fit(sets: list[np.ndarray], labels: list[str], per_language: int = 40, ridge: float = 1e-2, seed: int = 11) -> LanguageModel:
    """Fits on the driver, on the n-gram sets of the texts. Landmarks: the first ``per_language`` texts of each language in
    a shuffled order."""
    languages = sorted(set(labels))
    order = np.random.default_rng(seed).permutation(len(sets))
    sets, labels = [sets[i] for i in order], [labels[i] for i in order]
    taken = dict.fromkeys(languages, 0)
    marks = []
    for i, label in enumerate(labels):
        if taken[label] < per_language:
            taken[label] += 1
            marks.append(i)
    grams = Grams(np.concatenate([sets[i] for i in marks]))
    rows = grams.presence_of_sets(sets)
    size = np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
    landmarks = np.ascontiguousarray((rows[marks] / size[marks]).T)
    k = (rows / size) @ landmarks
    values, vectors = np.linalg.eigh(k[marks].astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = k @ root
    target = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # each class weighs the same
    weight = np.array([1 / labels.count(x) for x in languages])[[languages.index(x) for x in labels]][:, None]
    gram = features.T @ (features * weight) + ridge * np.eye(features.shape[1]) / 10
    return LanguageModel(languages, grams, landmarks, (root @ np.linalg.solve(gram, features.T @ (target * weight))).astype(np.float32))


def identify(docs: DataFrame, learn: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_per_language: int = 300, per_language: int = 40) -> DataFrame:
    """A row per row of ``docs``: doc_id, lang_pred, score (0 to 1).

    The model is fitted on a sample of ``learn`` (id, text, label) of at most ``sample_per_language`` labelled texts
    per language, chosen by a hash of the id; executors turn these into sets of n-grams, so whole texts don't reach the
    driver. That bound is the only one, predictions use whole texts. A text's prediction does not depend on the rows
    around it.

    Defined cases: null texts and texts without a letter are ``und`` with score 0; rows of ``learn`` with a null
    label, text or id, or without a letter, are not used; if none is left, everything is ``und``; with one language, that
    one is predicted; ties go to the first language by name; null and repeated ids are carried through; an empty table
    gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    given = learn.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"), F.col(quoted(label_col)).cast("string").alias("label")).where("label is not null and text is not null and doc_id is not null")

    def sets_of(batches):
        for b in batches:
            for i, text in enumerate(b.column("text").to_pylist()):
                one = b.slice(i, 1)
                if any(map(str.isalpha, text)):
                    yield pa.RecordBatch.from_arrays([one.column("label"), one.column("_u"), one.column("doc_id"), pa.array([gram_set(text).astype(np.int64)], pa.list_(pa.int64()))], names=["label", "u", "doc_id", "grams"])

    some = bounded_sample(given, "doc_id", "label", sample_per_language, "language").select("label", "_u", "doc_id", "text")
    found = some.mapInArrow(sets_of, "label string, u long, doc_id long, grams array<long>").collect()
    counted: dict[str, int] = {}
    kept = []
    for r in sorted(found, key=lambda r: (r["label"], r["u"], r["doc_id"], r["grams"])):
        counted[r["label"]] = counted.get(r["label"], 0) + 1
        if counted[r["label"]] <= sample_per_language:
            kept.append((np.array(r["grams"], np.int64).astype(np.uint64), r["label"]))
    model = fit([t for t, _ in kept], [x for _, x in kept], per_language) if kept else None
    held = spark.sparkContext.broadcast(model)  # landmarks x their n-grams: bounded by the sample

    def score(batches):
        model = held.value
        for b in text_blocks(batches, size=1 << 20):
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                names, scores = model.predict(texts) if model else (["und"] * len(texts), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores.astype(np.float64))], names=["doc_id", "lang_pred", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(score, "doc_id long, lang_pred string, score double")
