"""Substring deduplication with content-defined chunking.

A gear hash rolls over the last 16 bytes; where it is small, a chunk ends. Boundaries depend on the bytes just before
them only, so an insertion changes the chunks it touches and no others. Chunks are compared by digest: a digest that
more than one document has is repeated, and runs of neighbouring repeated chunks make repeated passages. Passages of
at least ``min_words`` words are reported; a copied passage loses at each end what does not fill a chunk (about 50
bytes), so a copied passage of 50 words nearly always leaves over 15.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kit import SPACE, Block, Scratch, column_at, id_and_text, map_whole_rows, quoted, span_hashes, text_blocks

_U = np.uint32
_GEAR = np.random.Generator(np.random.PCG64(977)).integers(0, 2**32, 256, dtype=np.uint32)
WINDOW = 16
#: Another order of the byte values, for the second half of a digest.
_OTHER = np.random.Generator(np.random.PCG64(978)).permutation(256).astype(np.uint8)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the 16 bytes that end there: each byte's value, shifted by its distance."""
    h = _GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] = h[step:] + (h[:-step] << _U(step))
        step *= 2
    return h


def chunk_ends(block: Block, mean: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of the chunks of a block's texts, in order. A boundary is set after a byte whose hash is small,
    unless one of the ``least`` bytes before it in the text has a small hash too; chunks of more than ``most`` bytes are
    cut. A text's chunks do not depend on the texts around it."""
    h = gear_hashes(block.data)
    small = np.flatnonzero(h < _U(2**32 // mean)) + 1
    owner = block.owner(small)
    # the first bytes of a text have other texts in their window: they set no boundary and hinder none
    inside = (small >= block.start[owner] + WINDOW) & (small < block.end[owner])
    small, owner = small[inside], owner[inside]
    if len(small) > 1:
        small = small[np.concatenate(([True], (np.diff(small) >= least) | (owner[1:] != owner[:-1])))]
    size = block.end - block.start
    cuts = np.unique(np.concatenate((small, block.start[size > 0], block.end[size > 0])))
    gaps = np.diff(cuts)
    long = np.flatnonzero(gaps > most)
    if len(long):
        n = (gaps[long] - 1) // most
        more = np.repeat(cuts[long], n) + most * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1)
        cuts = np.unique(np.concatenate((cuts, more)))
    starts, ends = cuts[:-1], cuts[1:]
    inside = ends <= block.end[block.owner(starts)]
    return starts[inside], ends[inside]


CHUNKS = "doc_id long, t long, start int, stop int, words int, d1 long, d2 int"


def chunks(docs: DataFrame, mean: int, least: int, most: int) -> DataFrame:
    """(doc_id, t, start, stop (bytes of the text), words, d1, d2: a 96-bit digest) for each chunk of each row
    (doc_id, t, text)."""

    def make(batches):
        for b in text_blocks(batches, size=1 << 20):
            block = Block(b.column("text"))
            starts, ends = chunk_ends(block, mean, least, most)
            d1 = span_hashes(block.data, starts, ends)
            # a second hash of the same bytes, under other values of the bytes
            d2 = (span_hashes(_OTHER[block.data], starts, ends) >> np.uint64(32)).astype(np.uint32)
            owner = block.owner(starts)
            begins = np.zeros(len(block.data) + 1, np.int64)
            space = SPACE[block.data]
            begins[2:] = np.cumsum(space[:-1] & ~space[1:])
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").take(at), b.column("t").take(at), pa.array((starts - block.start[owner]).astype(np.int32)), pa.array((ends - block.start[owner]).astype(np.int32)),
                    pa.array((begins[ends] - begins[starts]).astype(np.int32)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int32)),
                ],
                names=["doc_id", "t", "start", "stop", "words", "d1", "d2"],
            )

    return docs.mapInArrow(make, CHUNKS)


PASSAGES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("first_doc", T.LongType()), T.StructField("repeated", T.BooleanType())])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 15, mean: int = 24, least: int = 6, most: int = 512) -> DataFrame:
    """A row per repeated passage of a document: doc_id, text_hash (xxhash64 of the text it is in), start, stop (bytes of the
    UTF-8 text), n_words, first_doc (the smallest id of a document that has the passage's first chunk) and repeated
    (false where this document is the first for all of the passage's chunks, so that it is kept there). A run of repeated
    chunks of ``min_words`` words is a passage for each stretch that is repeated, or that is not: where another document
    has only part of a run first, the rest stays here, and each chunk stays somewhere.

    Defined cases: null and empty texts have no chunks; rows with a null id are not compared; rows with the same id
    count as one document, so a passage they share is not repeated, and each of the id's texts has its own passages; equal
    rows have theirs once; an empty table gives an empty table. Very long texts are cut like any other; the passages of
    one text are found in one row's memory.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    texts = id_and_text(docs, id_col, text_col).where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("t"), "text")
    found = scratch.put(chunks(texts, mean, least, most), "chunks")
    # counted with pre-aggregation, so that a chunk of very many documents is a few rows per task
    shared = found.groupBy("d1", "d2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("other")).where("first_doc <> other").drop("other")
    shared = scratch.put(shared, "shared")
    hits = scratch.put(found.join(shared, ["d1", "d2"]).select("doc_id", "t", "start", "stop", "words", "first_doc"), "hits")
    scratch.keep("hits")
    # by text: an id with very many rows is no group, and equal rows are one
    lists = hits.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set(F.struct("start", "stop", "words", "first_doc"))).alias("c"))

    def merge(batches):
        for b in batches:
            rows = []
            for doc, t, c in zip(b.column("doc_id").to_pylist(), b.column("t").to_pylist(), b.column("c")):
                values = c.values
                start, stop, words, first = (values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
                gap, again = start[1:] > stop[:-1], first != doc
                run = np.concatenate(([0], np.cumsum(gap)))
                whole = np.bincount(run, words)[run]  # words of the run that each chunk is in
                new = np.flatnonzero(np.concatenate(([True], gap | (again[1:] != again[:-1]))))
                ends = np.append(new[1:], len(start))
                for x, y in zip(new.tolist(), ends.tolist()):
                    if whole[x] >= min_words:
                        rows.append((doc, t, int(start[x]), int(stop[x:y].max()), int(words[x:y].sum()), int(first[x]), bool(again[x])))
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in columns[:6]), pa.array(columns[6], pa.bool_())], names=PASSAGES.names)

    return lists.mapInArrow(merge, PASSAGES)


def drop_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated passages cut out of their texts, all but each passage's first occurrence.

    A passage is cut from the rows with its id and text only, so unlike texts of one id lose nothing to each other; all
    columns stay as they are, whatever their names; null texts stay null."""
    cuts = passages.where("repeated").groupBy(F.col("doc_id").alias("_lexloom_id"), F.col("text_hash").alias("_lexloom_t"))
    cuts = cuts.agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("_lexloom_cuts"))
    own_id, own_t = F.col(quoted(id_col)).cast("long"), F.xxhash64(F.col(quoted(text_col)).cast("string"))
    joined = docs.join(cuts, (own_id == F.col("_lexloom_id")) & (own_t == F.col("_lexloom_t")), "left")
    joined = joined.select(*(F.col(quoted(c)) for c in docs.columns), "_lexloom_cuts")
    at, last = column_at(docs, text_col), len(docs.columns)

    def cut(batches):
        for b in text_blocks(batches, at):
            texts = []
            for text, spans in zip(b.column(at).to_pylist(), b.column(last).to_pylist()):
                if text and spans:
                    raw, place, parts = text.encode(), 0, []
                    for s in spans:
                        parts.append(raw[place : s["start"]])
                        place = s["stop"]
                    text = b"".join([*parts, raw[place:]]).decode("utf-8", "ignore")
                texts.append(text)
            yield [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(last)]

    return map_whole_rows(joined, cut, docs.schema)
