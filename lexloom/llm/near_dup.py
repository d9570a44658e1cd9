"""MinHash near-duplicate detection: universal hash minima, banding, verification, connected components.

1. One pass over the texts gives each document its distinct 5-word shingles as 64-bit hashes, from them ``perms``
   minima under multiply-shift hashes, the hashes of ``bands`` bands, one byte of each minimum as signature, and a
   128-bit digest of the whole set.
2. Documents with equal sets form a class with one representative row (copies are never paired). Classes are told
   apart by row numbers, not by ids, so an id may come with several texts.
3. Representatives that share a band are candidates. In each bucket a *star* is compared first: the smallest id
   against the others. Pairs whose signatures make the similarity very unlikely are dropped; the others are confirmed
   on full sets.
4. Components come from alternating large-star and small-star steps.
5. Where members of a bucket are then still in several components, the pairs across components are compared in blocks
   of bounded size, first by signature, then on full sets, as matrices inside a task. So candidate pairs are never
   listed, and none that could join two components is lost. What this finds joins the components.

With 32 bands of 4 rows a pair of similarity 0.75 is missed by all bands with probability 5e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kit import FACTORS, Block, Scratch, id_and_text, mix, quoted, shingle_set, span_hashes, text_blocks

_U = np.uint64

FEATURES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("t", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("signature", T.BinaryType())])


def document_sets(batches, k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Blocks of documents with their shingle sets."""
    for block in text_blocks(batches):
        texts = Block(block.column("text"), lower=True)
        starts, ends = texts.words()
        hashes = span_hashes(texts.data, starts, ends)
        first, last = texts.ranges(starts)
        yield block, [shingle_set(hashes[a:b], k) for a, b in zip(first.tolist(), last.tolist())]


def _minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = None
    for at in range(0, len(shingles), 2048):
        values = np.multiply.outer(a, shingles[at : at + 2048])
        values += b[:, None]
        part = values.min(axis=1)
        low = part if low is None else np.minimum(low, part)
    return low


def features(docs: DataFrame, k: int, perms: int, bands: int, seed: int) -> DataFrame:
    """A row per row of (doc_id, t, text): set size, set digest, band hashes, signature."""

    def make(batches):
        rng = np.random.Generator(np.random.PCG64(seed))
        a, b = rng.integers(1, 2**63, perms, dtype=np.uint64) * _U(2) + _U(1), rng.integers(0, 2**63, perms, dtype=np.uint64)
        rows = perms // bands
        number = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for block, sets in document_sets(batches, k):
            n = len(sets)
            size, d1, d2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            low = np.zeros((n, perms), np.uint64)
            for i, s in enumerate(sets):
                if len(s):
                    size[i], d1[i], d2[i] = len(s), s.sum(dtype=np.uint64), mix(s * FACTORS[1]).sum(dtype=np.uint64)
                    low[i] = _minima(s, a, b)
            parts = low.reshape(n, bands, rows)
            keys = parts[:, :, 0] * FACTORS[0]
            for j in range(1, rows):
                keys += parts[:, :, j] * FACTORS[j]
            keys = mix(keys + number)
            signature = np.ascontiguousarray((mix(low) >> _U(56)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id"), block.column("t"), pa.array(size), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.view(np.int64).ravel())),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * perms), pa.py_buffer(signature)]),
                ],
                names=FEATURES.names,
            )

    return docs.mapInArrow(make, FEATURES)


class _Texts:
    """The texts (doc_id, t, text) that representatives (id, doc_id, t) are read from again."""

    def __init__(self, texts: DataFrame, reps: DataFrame, repeats: bool, k: int):
        self.texts, self.reps, self.repeats, self.k = texts, reps, repeats, k

    def sets(self, ids: DataFrame) -> DataFrame:
        """Full shingle sets of ``ids`` (id): (id, shingles as little-endian 64-bit values)."""
        k = self.k

        def make(batches):
            for block, sets in document_sets(batches, k):
                yield pa.RecordBatch.from_arrays([block.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])

        keys = self.reps.select("id", "doc_id", "t").join(ids, "id", "left_semi")
        found = self.texts.join(keys, ["doc_id", "t"]).select("id", "text").mapInArrow(make, "id long, shingles binary")
        # a row that is there several times is read several times
        return found.groupBy("id").agg(F.first("shingles").alias("shingles")) if self.repeats else found


def _likely(pairs: DataFrame, floor: float) -> DataFrame:
    """Pairs (u, v, su, sv) whose signatures agree in a share of at least ``floor``."""

    def keep(batches):
        for b in batches:
            if b.num_rows:
                su, sv = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("su", "sv"))
                share = ((su == sv).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
                yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], names=["u", "v"]).filter(pa.array(share >= floor))

    return pairs.mapInArrow(keep, "u long, v long")


def _confirmed(pairs: DataFrame, above: int, below: int) -> DataFrame:
    """Pairs (u, v, a, b) with below * |a & b| >= above * |a | b| on full sets."""

    def keep(batches):
        for b in batches:
            found, last = [], None
            for left, right in zip(b.column("a"), b.column("b")):
                if last is None or left != last[0]:
                    last = left, np.frombuffer(left.as_py(), np.uint64)
                x, y = last[1], np.frombuffer(right.as_py(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                found.append(below * both >= above * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], names=["u", "v"]).filter(pa.array(found, pa.bool_()))

    return pairs.mapInArrow(keep, "u long, v long")


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(id, component) for each end of ``edges`` (u, v); component is the smallest id that is reachable.

    Alternates large-star and small-star steps until the edges no longer change, when each edge leads from a
    vertex to its component. A vertex's neighbours are never gathered: each step takes a minimum per vertex, which
    is pre-aggregated, and joins it to the edges."""
    state, at = None, 0
    now = scratch.put(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"{name}-0")
    while True:
        for large in (True, False):
            both = now.union(now.select("v", "u")) if large else now
            low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
            # as a table of its own, so that a vertex with very many edges can be split in the join
            low = scratch.put(low, f"{name}-low-{at}-{int(large)}")
            joined = both.join(low, F.col("u") == F.col("w"))
            if large:
                out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            else:
                out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
            at += 1
            now = scratch.put(out.where("u <> v").distinct(), f"{name}-{at}")
            scratch.drop(f"{name}-{at - 1}")
            scratch.drop(f"{name}-low-{at - 1}-{int(large)}")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = seen


def _classes(docs: DataFrame, id_col: str, text_col: str, k: int, threshold: tuple[int, int], perms: int, bands: int, floor: float, seed: int, link_ids: bool, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows, components). rows: row, doc_id, t, n_shingles, rep (the representative row of the set's class) and rep_id
    (its id); rep is null where there is no id or no shingle. components: rep, first, the smallest (id, row) of the
    representatives that are linked with it; classes that are linked with no other are left out."""
    texts = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("t"), "text")
    feats = scratch.put(features(texts, k, perms, bands, seed).withColumn("row", F.monotonically_increasing_id()), "features")
    filled = feats.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    classes = scratch.put(classes.select("d1", "d2", F.col("first.doc_id").alias("rep_id"), F.col("first.row").alias("rep")), "classes")
    rows = feats.select("row", "doc_id", "t", "n_shingles", "d1", "d2").withColumn("_in", (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    rows = rows.join(classes.withColumn("_in", F.lit(True)), ["d1", "d2", "_in"], "left").select("row", "doc_id", "t", "n_shingles", "rep", "rep_id")
    rows = scratch.put(rows, "rows")
    reps = feats.join(classes.select(F.col("rep").alias("row")), "row", "left_semi")
    reps = scratch.put(reps.select(F.col("row").alias("id"), "doc_id", "t", "bands", "signature", F.col("n_shingles").alias("n")), "reps")
    scratch.drop("features")
    repeats = not rows.where("doc_id = rep_id and row <> rep").isEmpty()
    read = _Texts(texts, reps, repeats, k)

    member = reps.select("id", "n", F.explode("bands").alias("bucket"))
    shared = scratch.put(member.groupBy("bucket").agg(F.min("id").alias("centre"), F.count("*").alias("size")).where("size > 1"), "buckets")
    member = scratch.put(member.join(shared, "bucket").select("bucket", "id", "centre", "n"), "members")
    signatures = reps.select("id", "signature")

    pairs = scratch.put(member.where("id <> centre").select(F.col("centre").alias("u"), F.col("id").alias("v")).distinct(), "pairs")
    edges = _verify(read, pairs, signatures, scratch, threshold, floor)
    if link_ids:
        # an id that comes with several texts links their classes
        several = rows.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high")
        edges = edges.union(rows.where("rep is not null").join(several.select("doc_id", "low"), "doc_id").where("rep <> low").select("rep", "low").distinct())
    labels = connected_components(edges, scratch, "stars")
    # buckets whose members are still in several components; in those of two the only pair is done
    current = member.join(labels, "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("c"))
    mixed = current.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("size")).where("low <> high and size > 2").select("bucket")
    mixed = scratch.put(mixed, "mixed")
    if not mixed.isEmpty():
        more = _open_pairs(read, current.join(mixed, "bucket"), signatures, scratch, threshold, floor)
        if not more.isEmpty():
            labels = connected_components(labels.select(F.col("id").alias("u"), F.col("component").alias("v")).union(more), scratch, "all")
    labels = labels.union(labels.select("component", "component").distinct())
    first = labels.join(reps.select("id", "doc_id"), "id").groupBy("component").agg(F.min(F.struct("doc_id", "id")).alias("first"))
    components = scratch.put(labels.join(first, "component").select(F.col("id").alias("rep"), "first"), "components")
    scratch.keep("rows", "components")
    return rows, components


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: tuple[int, int] = (75, 100), perms: int = 128, bands: int = 32, floor: float = 0.5, seed: int = 17) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked when ``100 * intersection >= 75 * union`` of their sets of k-word shingles (words are
    lower-cased in A-Z and split at ASCII white space). component_id is the smallest linked id, kept marks it.

    Defined cases: null or empty texts and texts without words have an empty set and are linked with nothing;
    texts with fewer than k words count as one shingle; rows with a null id are linked with nothing, have a null
    component_id and are kept; the same row twice gives the same row twice; an id that comes with several texts is one
    document of several texts, which links whatever any of them is linked with (rows of that id without words stay by
    themselves). An empty table gives an empty table; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    rows, components = _classes(docs, id_col, text_col, k, threshold, perms, bands, floor, seed, True, scratch)
    out = rows.join(components, "rep", "left").withColumn("component_id", F.coalesce("first.doc_id", "rep_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: tuple[int, int] = (75, 100), perms: int = 128, bands: int = 32, floor: float = 0.5, seed: int = 17) -> DataFrame:
    """``docs`` with one row of each group of near-duplicate texts, the one with the smallest id.

    Texts are grouped, not ids: of an id that comes with several unlike texts each group keeps its own row, so no text
    is lost.

    Defined cases: rows with a null id and rows whose text has no words stay; of rows that are equal in id and text one
    stays. An empty table gives an empty table; other columns stay as they are, whatever their names."""
    scratch = Scratch(docs.sparkSession, "neardup")
    rows, components = _classes(docs, id_col, text_col, k, threshold, perms, bands, floor, seed, False, scratch)
    placed = rows.where("rep is not null").join(components, "rep", "left")
    placed = placed.select("doc_id", "t", "row", F.coalesce("first.id", "rep").alias("stays"))
    # rows of equal id and text are in one group: they go, or one of them stays
    keys = placed.groupBy("doc_id", "t").agg(F.max((F.col("row") == F.col("stays")).cast("int")).alias("stays"), F.count("*").alias("n"))
    keys = scratch.put(keys.where("stays = 0 or n > 1").select(F.col("doc_id").alias("_lexloom_id"), F.col("t").alias("_lexloom_t"), "stays"), "keys")
    names = [F.col(quoted(c)) for c in docs.columns]
    own_id, own_t = F.col(quoted(id_col)).cast("long"), F.xxhash64(F.col(quoted(text_col)).cast("string"))
    gone = keys.select("_lexloom_id", "_lexloom_t")
    out = docs.join(gone, (own_id == F.col("_lexloom_id")) & (own_t == F.col("_lexloom_t")), "left_anti")
    again = keys.where("stays = 1").select("_lexloom_id", "_lexloom_t")
    if not again.isEmpty():
        twice = docs.join(again, (own_id == F.col("_lexloom_id")) & (own_t == F.col("_lexloom_t")))
        one = twice.groupBy("_lexloom_id", "_lexloom_t").agg(F.first(F.struct(*names)).alias("_lexloom_row"))
        out = out.union(one.select("_lexloom_row.*"))
    return out


def _block_pairs(rows: DataFrame, blocks: Column) -> DataFrame:
    """Deals the members of each group to ``blocks`` blocks and repeats each for the pairs of blocks it is in: the
    members of one pair of blocks (x <= y) meet in one task's group of bounded size."""
    dealt = rows.withColumn("blocks", blocks).withColumn("own", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("other", "blocks")


def _size_groups(members: DataFrame, threshold: tuple[int, int], scratch: Scratch) -> DataFrame:
    """Members (bucket, id, c, n) by size of set: a group has the members of one class of sizes and of the next. Sizes of
    linked sets differ by the factor below / above at most, which is the width of a class, so each pair that can be
    linked has a group; groups whose members are all in one component are left out."""
    above, below = threshold
    level = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(below / above)) if above < below else 1e-9) + 1e-9).cast("long")
    spread = members.withColumn("level", level).withColumn("size_group", F.explode(F.array(F.col("level"), F.col("level") - 1)))
    # as a table, so that a large group is split in the join
    spread = scratch.put(spread, "spread")
    of = ["bucket", "size_group"]
    open_ = spread.groupBy(*of).agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("size"), F.max((F.col("level") == F.col("size_group")).cast("int")).alias("own")).where("low <> high and own = 1")
    return spread.join(open_.select(*of, "size"), of).withColumn("upper", F.col("level") != F.col("size_group")).drop("level")


def _crossing(own: np.ndarray, c: np.ndarray, x: int, y: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Index sets whose products hold every pair of a member of block x and one of block y that are in different
    components. Pairs inside the largest component are left out."""
    names, count = np.unique(c, return_counts=True)
    most = names[count.argmax()]
    left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
    return [(left[c[left] != most], right), (left[c[left] == most], right[c[right] != most])]


def _open_pairs(read: _Texts, members: DataFrame, signatures: DataFrame, scratch: Scratch, threshold: tuple[int, int], floor: float) -> DataFrame:
    """Links (u, v) between members (bucket, id, n, c) of the same bucket that are in different components.

    First blocks of signatures, then, for members whose signature is close to one of another component, blocks of
    full sets are compared as matrices inside a task. Tasks return members and links, never candidate pairs. Pairs whose
    set sizes rule a link out are in no common group."""
    above, below = threshold
    group = ["bucket", "size_group"]

    def close(key, table):
        own, c, n, upper = table.column("own").to_numpy(), table.column("c").to_numpy(), table.column("n").to_numpy(), table.column("upper").to_numpy(zero_copy_only=False)
        codes = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(len(own), -1)
        least = (floor * (1 - 1 / 256) + 1 / 256) * codes.shape[1]
        near = np.zeros(len(own), bool)
        for rows, columns in _crossing(own, c, key[2].as_py(), key[3].as_py()):
            for at in range(0, len(rows), 64):
                part = rows[at : at + 64]
                agree = (codes[part][:, None, :] == codes[columns][None, :, :]).sum(axis=2, dtype=np.int32)
                hit = (agree >= least) & (c[part][:, None] != c[columns][None, :]) & ~(upper[part][:, None] & upper[columns][None, :])
                hit &= below * np.minimum(n[part][:, None], n[columns][None, :]) >= above * np.maximum(n[part][:, None], n[columns][None, :])
                near[part[hit.any(axis=1)]] = True
                near[columns[hit.any(axis=0)]] = True
        return table.select(["bucket", "size_group", "id", "c", "upper"]).filter(pa.array(near))

    sized = _size_groups(members, threshold, scratch)
    dealt = _block_pairs(sized, F.ceil(F.col("size") / 1024).cast("int")).join(signatures, "id")
    near = dealt.select(*group, "x", "y", "id", "c", "n", "upper", "own", "signature").groupBy(*group, "x", "y").applyInArrow(close, "bucket long, size_group long, id long, c long, upper boolean")
    near = scratch.put(near.distinct(), "near")
    ids = scratch.put(near.select("id").distinct(), "near-ids")
    sets = scratch.put(read.sets(ids), "near-sets")
    size = scratch.put(near.join(sets.select("id", F.octet_length("shingles").alias("bytes")), "id").groupBy(*group).agg(F.sum("bytes").alias("bytes")), "near-sizes")

    def links(key, table):
        own, c, upper = table.column("own").to_numpy(), table.column("c").to_numpy(), table.column("upper").to_numpy(zero_copy_only=False)
        parts = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        lengths = np.array([len(s) for s in parts])
        values, place, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        # what one member alone has is in no intersection
        shared = np.cumsum(count > 1) - 1
        row = np.repeat(np.arange(len(parts)), lengths)
        keep = count[place] > 1
        row, column, width = row[keep], shared[place[keep]], int((count > 1).sum())
        at = np.searchsorted(row, np.arange(len(parts) + 1))

        def matrix(which, low, high):
            out = np.zeros((len(which), high - low), np.float32)
            for i, r in enumerate(which):
                cells = column[at[r] : at[r + 1]]
                out[i, cells[(cells >= low) & (cells < high)] - low] = 1
            return out

        found = set()
        for rows, columns in _crossing(own, c, key[2].as_py(), key[3].as_py()):
            for a in range(0, len(rows), 256):
                left = rows[a : a + 256]
                for b in range(0, len(columns), 256):
                    right = columns[b : b + 256]
                    both = np.zeros((len(left), len(right)), np.float32)
                    for low in range(0, width, 8192):
                        both += matrix(left, low, min(width, low + 8192)) @ matrix(right, low, min(width, low + 8192)).T
                    union = lengths[left][:, None] + lengths[right][None, :] - both
                    hit = (below * both >= above * union) & (c[left][:, None] != c[right][None, :]) & ~(upper[left][:, None] & upper[right][None, :])
                    for i, j in np.argwhere(hit):
                        # one link between two components is enough
                        pair = tuple(sorted((int(c[left[i]]), int(c[right[j]]))))
                        found.add(pair)
        u, v = zip(*sorted(found)) if found else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    blocks = F.greatest(F.lit(1), F.ceil(F.col("bytes") / (2 << 20))).cast("int")
    dealt = _block_pairs(near.join(size, group), blocks).join(sets, "id")
    return scratch.put(dealt.select(*group, "x", "y", "id", "c", "upper", "own", "shingles").groupBy(*group, "x", "y").applyInArrow(links, "u long, v long").distinct(), "open-edges")


def _verify(read: _Texts, pairs: DataFrame, signatures: DataFrame, scratch: Scratch, threshold: tuple[int, int], floor: float) -> DataFrame:
    """The pairs (u, v) that are linked: by signature first, then on full sets."""
    left = signatures.select(F.col("id").alias("u"), F.col("signature").alias("su"))
    right = signatures.select(F.col("id").alias("v"), F.col("signature").alias("sv"))
    likely = scratch.put(_likely(pairs.join(left, "u").join(right, "v").select("u", "v", "su", "sv"), floor), "likely")
    ids = scratch.put(likely.select(F.col("u").alias("id")).union(likely.select("v")).distinct(), "ids")
    # only texts of candidates are read into sets again
    sets = scratch.put(read.sets(ids), "sets")
    # a centre with very many partners is dealt to several tasks: 64 partners meet one copy of its set
    sizes = likely.groupBy("u").agg(F.ceil(F.count("*") / 64).cast("int").alias("parts"))
    centres = sets.join(sizes, F.col("id") == F.col("u")).select("u", F.col("shingles").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    partners = likely.join(sizes, "u").join(sets, F.col("id") == F.col("v")).select("u", "v", F.col("shingles").alias("b"), F.expr("cast(pmod(xxhash64(v), parts) as int)").alias("part"))
    return scratch.put(_confirmed(partners.join(centres, ["u", "part"]).select("u", "v", "a", "b"), *threshold), "edges")
