"""The training-data pipeline over documents: quality rules, line dedup, MinHash near-dedup, benchmark
decontamination, best-fit packing. Each stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.decontaminate import drop_contaminated
from lexloom.llm.kit import Scratch, scoped
from lexloom.llm.line_dedup import dedup_lines
from lexloom.llm.near_dup import drop_near_duplicates
from lexloom.llm.packing import pack
from lexloom.llm.rules import keep_quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_quality(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars, where there is such a column, follows the text. A document that has lost all its
    lines goes too."""
    out = dedup_lines(docs, counts=False, drop_emptied=True)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicate texts stays: the one with the smallest id. Rows are kept, not ids,
    so that of an id with several unlike texts none is lost."""
    return drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per token piece with its place in the packed sequences."""
    _, places = pack(docs, digests={"ids_crc32": F.crc32("ids")}, keep_ids=False)
    return places.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


STAGES = [("quality rules", quality_stage), ("line dedup", line_stage), ("MinHash near-dedup", near_dup_stage), ("benchmark decontamination", decontamination_stage), ("best-fit packing", packing_stage)]

#: Tokenization and packing are beyond SQL; run() is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next; scratch tables and the stage
    before go as soon as a stage stands.

    Defined cases: null, empty and very short texts are rejected by the rules; rows with a null id go through line dedup
    as one document, are never near-duplicates, and are packed; of rows that are equal in id and text one is packed; an
    id with several unlike texts keeps them all; ties go to the smallest id; further columns of documents, whatever
    their names, are carried through all stages but the last. An empty table gives an empty table."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        with scoped():
            docs = scratch.put(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            scratch.drop(f"stage-{i - 1}")
    return docs
