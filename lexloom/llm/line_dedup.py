"""Line deduplication with levelled sorted runs of line hashes.

A store holds, for each line key, in how many documents it was found and the largest id of these, as *runs*: tables
that are bucketed and sorted by key. Batches of documents come with falling ids. A batch's keys are merge-anti-joined
with each run, without an exchange or a sort of the run: a key that is already settled there (found in ``min_docs``
documents, the last of them with a larger id) needs no further record, the others are added as a run of the batch's own
at level 0. When a level has ``fanout`` runs they are compacted into one run of the next level, so that a key is
rewritten once per level and a batch meets a logarithmic number of runs. A store on a path can be opened again.
"""

from __future__ import annotations

import contextlib
import functools
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kit import Scratch, id_and_text, map_whole_rows, quoted, text_blocks

_STRIP = " \t\n\x0b\x0c\r"
KEY = ["k1", "k2"]


def line_key(line: str, min_chars: int) -> bytes | None:
    """A 128-bit key of the line, stripped of ASCII white space at both ends and with A-Z lower-cased; none for
    lines of fewer than ``min_chars`` code points."""
    line = line.strip(_STRIP)
    if len(line) < min_chars:
        return None
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass").lower())


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, t, k1, k2) for each distinct keyed line of each row (doc_id, t, text); t is a hash of the text."""

    def make(batches):
        for block in text_blocks(batches):
            rows, keys = [], []
            for i, text in enumerate(block.column("text").to_pylist()):
                if text:
                    found = {line_key(x, min_chars) for x in text.split("\n")}
                    found.discard(None)
                    keys += found
                    rows += [i] * len(found)
            parts = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([block.column("doc_id").take(at), block.column("t").take(at), pa.array(np.ascontiguousarray(parts[:, 0])), pa.array(np.ascontiguousarray(parts[:, 1]))], names=["doc_id", "t", *KEY])

    return docs.mapInArrow(make, "doc_id long, t long, k1 long, k2 long")


@contextlib.contextmanager
def sorted_scans(spark: SparkSession, buckets: int) -> Iterator[None]:
    """Plans that are run inside use the order of buckets that are one file each, and shuffle batches to as many
    partitions as there are buckets, so that runs need no exchange and no sort."""
    wanted = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.shuffle.partitions": str(buckets)}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


RUN = "k1 BIGINT, k2 BIGINT, n_docs BIGINT, last BIGINT"


class LineRuns:
    """Levelled sorted runs of (k1, k2, n_docs, last) below ``path``. What is there already is opened again; then
    ``min_docs``, ``fanout`` and the number of buckets are those of the store."""

    def __init__(self, spark: SparkSession, path: str, min_docs: int = 3, fanout: int = 3, buckets: int | None = None):
        self.spark, self.path = spark, path
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.min_docs, self.fanout, self.buckets = min_docs, fanout, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self._names: dict[str, str] = {}
        if self._fs.exists(self._fs_path(f"{path}/manifest")):
            kept = json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first()[0])
            self.min_docs, self.fanout, self.buckets, self.levels = kept["min_docs"], kept["fanout"], kept["buckets"], kept["levels"]

    def _delete(self, name: str) -> None:
        self._fs.delete(self._fs_path(f"{self.path}/{name}"), True)

    def _save(self) -> None:
        """The manifest is replaced after the runs it names are written and before those it doesn't are deleted."""
        text = json.dumps({"min_docs": self.min_docs, "fanout": self.fanout, "buckets": self.buckets, "levels": self.levels})
        out = self._fs.create(self._fs_path(f"{self.path}/manifest.new"), True)
        out.write(bytearray(text.encode()))
        out.close()
        self._delete("manifest")
        self._fs.rename(self._fs_path(f"{self.path}/manifest.new"), self._fs_path(f"{self.path}/manifest"))

    def run(self, name: str) -> DataFrame:
        if name not in self._names:
            table = f"lexloom_run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {table} ({RUN}) USING parquet CLUSTERED BY (k1, k2) SORTED BY (k1, k2) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
            self._names[name] = table
        return self.spark.table(self._names[name])

    def _write(self, rows: DataFrame) -> str:
        name, table = f"run-{uuid.uuid4().hex}", f"lexloom_run_{uuid.uuid4().hex}"
        rows.select(*KEY, "n_docs", "last").write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.path}/{name}").saveAsTable(table)
        self._names[name] = table
        return name

    def _merge(self, names: list[str]) -> DataFrame:
        # read as plain files: Spark 4.1 takes a union of bucketed scans as partitioned by key and leaves the exchange out,
        # although equal keys may be in several tasks (with nine batches 31 of 36 settled keys were found)
        runs = functools.reduce(DataFrame.union, [self.spark.read.schema(RUN).parquet(f"{self.path}/{name}") for name in names])
        return runs.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last").alias("last"))

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The keys of a batch (doc_id, k1, k2; a row per document and key) that the runs have not settled."""
        own = batch.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last"))
        for name in self.runs():
            done = self.run(name).where(F.col("n_docs") >= self.min_docs).select(*KEY, F.col("last").alias("_last"))
            own = own.join(done.hint("merge"), [own[k] == done[k] for k in KEY] + [own["last"].isNull() | (own["last"] < done["_last"])], "left_anti")
        return own

    def add(self, batch: DataFrame) -> None:
        """Adds a batch (doc_id, k1, k2) of documents that no earlier batch had. Any order of batches is right; with
        falling ids the most keys are found to be settled."""
        with sorted_scans(self.spark, self.buckets):
            if not self.levels:
                self.levels.append([])
            self.levels[0].append(self._write(self.fresh(batch)))
            gone, level = [], 0
            while len(self.levels[level]) >= self.fanout:
                full, self.levels[level] = self.levels[level], []
                if len(self.levels) == level + 1:
                    self.levels.append([])
                self.levels[level + 1].append(self._write(self._merge(full)))
                gone += full
                level += 1
            self._save()
            for name in gone:
                self._forget(name)
                self._delete(name)

    def settled(self) -> DataFrame:
        """(k1, k2, last) of the keys found in at least ``min_docs`` documents."""
        names = self.runs()
        if not names:
            return self.spark.createDataFrame([], "k1 long, k2 long, last long")
        return self._merge(names).where(F.col("n_docs") >= self.min_docs).select(*KEY, "last")

    def _forget(self, name: str) -> None:
        if name in self._names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._names.pop(name)}")  # the files stay

    def close(self) -> None:
        """Takes the runs' names out of the session's catalogue; the store can be opened again."""
        for name in list(self._names):
            self._forget(name)


def repeated_lines(docs: DataFrame, scratch: Scratch, min_chars: int, min_docs: int, batches: int, fanout: int) -> tuple[DataFrame, DataFrame]:
    """(lines, settled): lines has (doc_id, t, k1, k2) of all rows (doc_id, t, text), settled (k1, k2, last) of keys found
    in at least ``min_docs`` documents."""
    ids = docs.select("doc_id")
    # rows that share an id are one document, whose lines count once
    several = scratch.put(ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_id")), "several")
    cuts = sorted(set(ids.where("doc_id is not null").stat.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)), reverse=True) if batches > 1 else []
    number = F.lit(len(cuts))
    for i, cut in reversed(list(enumerate(cuts))):
        number = F.when(F.col("doc_id") >= int(cut), i).otherwise(number)
    path = f"{scratch.root}/lines"
    found = line_keys(docs, min_chars).withColumn("batch", number)
    found.write.partitionBy("batch").parquet(path)
    lines = docs.sparkSession.read.schema(found.schema).parquet(path)
    unique = several.isEmpty()
    store = LineRuns(docs.sparkSession, f"{scratch.root}/runs", min_docs, fanout)
    for i in range(len(cuts) + 1):
        part = lines.where(F.col("batch") == i).select("doc_id", *KEY)
        if not unique:  # seldom
            same = F.col("doc_id").eqNullSafe(F.col("_id"))
            part = part.join(several, same, "left_anti").union(part.join(several, same, "left_semi").distinct())
        store.add(part)
    settled = scratch.put(store.settled(), "settled")
    store.close()
    scratch.drop("runs")
    return lines, settled


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3, counts: bool = True, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and, with ``counts``, n_lines (before) and n_dropped (long).

    A line's key is the line stripped of ASCII white space at both ends, A-Z lower-cased. Keys of at least
    ``min_chars`` code points that are found in at least ``min_docs`` documents lose all their lines except in the
    document with the largest id. The lines that stay are joined by newlines. With ``drop_emptied`` rows that lost
    lines and have no word left go.

    Defined cases: a null text counts as empty, an empty one as one empty line; rows with a null id count together
    as one document with the smallest id; rows with equal ids are one document; with ``counts`` columns of ``docs`` named
    n_lines or n_dropped in any case are replaced, all others stay as they are, whatever their names. An empty table gives an
    empty table.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    t = F.xxhash64(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")))
    texts = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text")
    lines, settled = repeated_lines(texts, scratch, min_chars, min_docs, batches, fanout)
    # by text, so that an id of very many rows is no group: a group has the lines of one text
    drops = lines.join(settled, KEY).where("doc_id is null or doc_id < last").groupBy("doc_id", "t").agg(F.collect_set(F.struct(*KEY)).alias("_lexloom_drop"))
    drops = scratch.put(drops.select(F.col("doc_id").alias("_lexloom_id"), F.col("t").alias("_lexloom_t"), F.col("_lexloom_drop.k1").alias("_lexloom_k1"), F.col("_lexloom_drop.k2").alias("_lexloom_k2")), "drops")
    scratch.keep("drops")
    scratch.drop("lines")

    replaced = ("n_lines", "n_dropped") if counts else ()
    fields = [T.StructField(f.name, T.StringType()) if f.name.lower() == text_col.lower() else f for f in docs.schema if f.name.lower() not in replaced]
    # always a sorted merge: whether the drops would fit a broadcast changes with the input, the plan should not
    joined = docs.join(drops.hint("merge"), F.col(quoted(id_col)).cast("long").eqNullSafe(F.col("_lexloom_id")) & (t == F.col("_lexloom_t")), "left")
    joined = joined.select(*(F.col(quoted(f.name)) for f in fields), "_lexloom_k1", "_lexloom_k2")
    at = next(i for i, f in enumerate(fields) if f.name.lower() == text_col.lower())
    schema = T.StructType(fields + ([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())] if counts else []))

    def rebuild(batches):
        for block in text_blocks(batches, at):
            texts, n_lines, n_dropped, stays = [], [], [], []
            k1, k2 = block.column(len(fields)), block.column(len(fields) + 1)
            for i, text in enumerate(block.column(at).to_pylist()):
                text = "" if text is None else str(text)
                n, drop = text.count("\n") + 1, k1[i].values
                n_lines.append(n)
                if drop is not None and len(drop):
                    pairs = np.column_stack((drop.to_numpy(zero_copy_only=False), k2[i].values.to_numpy(zero_copy_only=False)))
                    gone = {p.tobytes() for p in np.ascontiguousarray(pairs)}
                    kept = [x for x in text.split("\n") if line_key(x, min_chars) not in gone]
                    text, n = "\n".join(kept), n - len(kept)
                else:
                    n = 0
                texts.append(text)
                n_dropped.append(n)
                stays.append(not (drop_emptied and n and not text.strip(_STRIP)))
            columns = [pa.array(texts, pa.string()) if i == at else block.column(i) for i in range(len(fields))]
            if counts:
                columns += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield [c.filter(pa.array(stays, pa.bool_())) for c in columns] if drop_emptied else columns

    return map_whole_rows(joined, rebuild, schema)
