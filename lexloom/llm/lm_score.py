"""Cross-entropy difference between two matched n-gram models.

Tokens are the bytes of the UTF-8 text, so the target and the background model share one vocabulary, of 256 values,
with nothing out of vocabulary. Both are n-gram models of the same order with the same recursive smoothing

    p_n(w | h) = (c(h, w) + strength * p_(n-1)(w | h')) / (c(h) + strength),    p_0 = 1 / 256,

and matched in size: the background counts are scaled to the target's number of tokens. All documents are counted.
Documents are dealt to two folds by id; each is scored by the models of the other fold, so that no document is scored by
models that have counted it.

Documents are dealt to blocks of bounded size, each of one fold. Counting gives each block's distinct n-grams with their
numbers. The model is a table with a row per n-gram; it is not broadcast, because it grows with the corpus. The blocks'
n-grams are joined to it and the losses come back to the block's texts, so the shuffle carries each n-gram once per block,
and a frequent n-gram no more often than there are blocks. A block that one id has made too large is split by text, and
what is then still too large, rows of one text, is dealt to parts that each get the block's n-grams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kit import Scratch, id_and_text, text_blocks, text_bytes

_U = np.uint64


def ngrams(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the texts as 64-bit values, the last byte highest, and where each text's begin and end. Before
    a text's beginning there are zero bytes, so each byte has one n-gram of the full order."""
    parts = text_bytes(column)
    pad = b"\0" * order
    raw = b"\0" * 8 + pad.join([b"", *parts]) + b""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    end = 8 + np.cumsum(lengths + order)
    view = np.ndarray((len(raw) - 7,), "<u8", buffer=raw, strides=(1,))
    start = end - lengths
    mask = np.zeros(len(raw) + 1, np.int8)
    np.add.at(mask, start, 1)
    np.add.at(mask, end, -1)
    at = np.flatnonzero(np.cumsum(mask[:-1]))
    stop = np.cumsum(lengths)
    return view[at - 7] >> _U(64 - 8 * order), np.concatenate(([0], stop))


def _block_of(doc_id: Column, text: Column, blocks: int) -> Column:
    """A document's block, by its id, so that ids alone can be dealt to the blocks of their documents. Even and odd blocks
    are the two folds."""
    return F.pmod(F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(doc_id)), F.lit(blocks)).cast("int")


BLOCK = ["block", "sub", "part"]


def deal(docs: DataFrame, target: DataFrame, blocks: int, block_bytes: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(docs with block, sub and part, target ids with them, (block, sub, parts) of the blocks in several parts, if any).
    A row's part may be another one each time the table is read."""
    docs = docs.withColumn("block", _block_of(F.col("doc_id"), F.col("text"), blocks))
    target = target.withColumn("block", _block_of(F.col("doc_id"), F.lit(""), blocks))
    size = F.sum(F.octet_length("text"))
    large = scratch.put(docs.groupBy("block").agg(size.alias("bytes")).where(F.col("bytes") > 3 * block_bytes).select("block", F.ceil(F.col("bytes") / block_bytes).cast("int").alias("subs")), "large")
    if large.isEmpty():
        zero = {"sub": F.lit(0), "part": F.lit(0)}
        return docs.withColumns(zero), target.withColumns(zero), None
    docs = docs.join(large, "block", "left").withColumn("sub", F.coalesce(F.pmod(F.xxhash64("text"), F.col("subs")).cast("int"), F.lit(0))).drop("subs")
    target = target.join(large, "block", "left").withColumn("sub", F.explode(F.sequence(F.lit(0), F.coalesce("subs", F.lit(1)) - 1))).drop("subs")
    parts = scratch.put(docs.groupBy("block", "sub").agg(size.alias("bytes")).where(F.col("bytes") > 3 * block_bytes).select("block", "sub", F.ceil(F.col("bytes") / block_bytes).cast("int").alias("parts")), "parts")
    docs = docs.join(parts, ["block", "sub"], "left").withColumn("part", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    return docs, _to_parts(target, parts), parts


def _to_parts(rows: DataFrame, parts: DataFrame | None) -> DataFrame:
    """Rows of a block, once for each of its parts."""
    if parts is None:
        return rows.withColumn("part", F.lit(0))
    return rows.join(parts, ["block", "sub"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")


def block_ngrams(docs: DataFrame, target: DataFrame, order: int) -> DataFrame:
    """(block, sub, code, t, b): how often a block of (doc_id, text) has each n-gram in target documents (doc_id) and in
    others; each part of a block has rows of its own."""

    def count(key, texts, ids):
        if not texts.num_rows:
            return pa.table({"block": pa.array([], pa.int32()), "sub": pa.array([], pa.int32()), "code": pa.array([], pa.int64()), "t": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        chosen = ids.column("doc_id").combine_chunks()
        codes, t, b = [], [], []
        for part in text_blocks(texts.to_batches()):
            grams, at = ngrams(part.column("text"), order)
            on = np.repeat(pc.is_in(part.column("doc_id"), value_set=chosen).to_numpy(zero_copy_only=False), np.diff(at))
            for side, counted in ((True, t), (False, b)):
                code, number = np.unique(grams[on == side], return_counts=True)
                codes.append(code)
                t.append(number if side else np.zeros(len(code), np.int64))
                b.append(np.zeros(len(code), np.int64) if side else number)
        code = np.concatenate(codes)
        place = np.argsort(code, kind="stable")
        code = code[place]
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.empty(0, np.int64)
        t, b = (np.add.reduceat(np.concatenate(x)[place], first) if len(first) else np.empty(0, np.int64) for x in (t, b))
        return pa.table({**{n: pa.array(np.full(len(first), key[i].as_py(), np.int32)) for i, n in enumerate(BLOCK[:2])}, "code": pa.array(code[first].view(np.int64)), "t": pa.array(t), "b": pa.array(b)})

    return docs.groupBy(*BLOCK).cogroup(target.groupBy(*BLOCK)).applyInArrow(count, "block int, sub int, code long, t long, b long")


SIDES = ("t0", "b0", "t1", "b1")


def loss_table(counts: DataFrame, order: int, strength: float) -> DataFrame:
    """(code, lt0, lb0, lt1, lb1): the loss in bits of the last byte of each n-gram, in the target and the background model
    of either fold. ``counts`` has code and the counts t0, b0, t1, b1."""
    total = counts.agg(*(F.sum(x) for x in SIDES)).first()
    scale = {x: 1.0 for x in SIDES}
    for i in (0, 1):
        t, b = (total[2 * i] or 0), (total[2 * i + 1] or 0)
        scale[f"b{i}"] = t / max(1, b) if t else 1.0
    below: DataFrame | None = None
    for n in range(1, order + 1):
        code = F.shiftrightunsigned("code", 8 * (order - n)).alias("code") if n < order else F.col("code")
        grams = counts.groupBy(code).agg(*((F.sum(x) * scale[x]).alias(x) for x in SIDES)) if n < order else counts.select("code", *((F.col(x) * scale[x]).alias(x) for x in SIDES))
        grams = grams.withColumn("h", F.col("code").bitwiseAND(F.lit((1 << (8 * (n - 1))) - 1)))
        contexts = grams.groupBy("h").agg(*(F.sum(x).alias("h" + x) for x in SIDES))
        joined = grams.join(contexts, "h")
        if below is None:
            joined = joined.withColumns({"p" + x: F.lit(1 / 256) for x in SIDES})
        else:
            joined = joined.withColumn("suffix", F.shiftrightunsigned("code", 8)).join(below, "suffix")
        p = ((F.col(x) + strength * F.col("p" + x)) / (F.col("h" + x) + strength) for x in SIDES)
        below = joined.select(F.col("code").alias("suffix"), *(v.alias("p" + x) for x, v in zip(SIDES, p)))
    return below.select(F.col("suffix").alias("code"), *((-F.log2("p" + x)).cast("float").alias("l" + x) for x in SIDES))


def cross_entropy_difference(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 5, strength: float = 8.0, block_bytes: int = 16 << 20) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_tokens, target_loss and background_loss (mean bits per token) and score,
    their difference: the lower, the more like the target.

    ``target`` has the doc_id of the documents that the target models are trained on; the background models are trained
    on all others. Both are trained on the fold that the document is not in (the fold is pmod(xxhash64(doc_id), 2), or
    that of the text where the id is null).

    Defined cases: null and empty texts have no tokens, losses and score of 0; null ids are background; rows with the
    same id count each and are in one fold; without target documents in a fold (or with nothing else) that model is the
    uniform one, smoothed; an empty table gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    if not 1 <= order <= 7:
        raise ValueError("order must be 1 to 7")
    scratch = Scratch(spark, "lm")
    given = id_and_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 2 * max(1, -(-size // (2 * block_bytes)))
    chosen = target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    dealt, chosen, parts = deal(given, chosen, blocks, block_bytes, scratch)
    grams = scratch.put(block_ngrams(dealt, chosen, order), "grams")
    fold = F.col("block") % 2
    counts = scratch.put(grams.groupBy("code").agg(*(F.sum(F.when(fold == i, F.col(x)).otherwise(0)).alias(f"{x}{i}") for i in (0, 1) for x in "tb")), "counts")
    losses = scratch.put(loss_table(counts, order, strength), "losses")
    known = grams.select("block", "sub", "code") if parts is None else grams.select("block", "sub", "code").distinct()
    answers = known.join(losses, "code").select("block", "sub", "code", *(F.when(fold == 0, F.col(f"l{x}1")).otherwise(F.col(f"l{x}0")).alias(f"l{x}") for x in "tb"))
    answers = _to_parts(answers, parts)

    def score(key, texts, model):
        code = model.column("code").to_numpy().view(np.uint64)
        order_ = np.argsort(code)
        code, lt, lb = code[order_], model.column("lt").to_numpy()[order_].astype(np.float64), model.column("lb").to_numpy()[order_].astype(np.float64)
        ids, tokens, sums = [], [], []
        for b in text_blocks(texts.to_batches()):
            grams, at = ngrams(b.column("text"), order)
            found, back = np.unique(grams, return_inverse=True)
            row = np.searchsorted(code, found)[back]
            ids.append(b.column("doc_id"))
            tokens.append(np.diff(at))
            sums.append([np.diff(np.concatenate(([0.0], np.cumsum(x[row])))[at]) if len(row) else np.zeros(b.num_rows) for x in (lt, lb)])
        n = np.concatenate(tokens) if tokens else np.empty(0, np.int64)
        t, b_ = (np.concatenate([s[i] for s in sums]) / np.maximum(n, 1) if sums else np.empty(0) for i in (0, 1))
        return pa.table({"doc_id": pa.chunked_array(ids, pa.int64()), "n_tokens": pa.array(n), "target_loss": pa.array(t), "background_loss": pa.array(b_), "score": pa.array(t - b_)})

    return dealt.groupBy(*BLOCK).cogroup(answers.groupBy(*BLOCK)).applyInArrow(score, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
