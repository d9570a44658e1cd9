"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions.stats import global_rank

#: Headers that are kept beside utterances.
KEPT_HEADERS = ("@Com", "@Sit", "@Act", "@New Ep", "%com", "@Par")
# Long header names and their short forms.
SHORT_HEADERS = {"@Comment": "@Com", "@Situation": "@Sit", "@Activities": "@Act", "@New Episode": "@New Ep"}

CODING_SCHEMA = "LineNum int, UttNum int, file string, coder string, date bigint, context string, pass int"


def chat_transcripts(spark: SparkSession, path: str, merge_continuations: bool = False, name: str = "([^/]*)$") -> DataFrame:
    """Files of ``*SPK:<tab>utterance`` lines: file, line_num, speaker, utterance, utt_num (null for headers). With
    ``merge_continuations`` lines that begin with a tab belong to the line before. Files are the unit of reading; a
    transcript has thousands of lines, not millions. ``name`` takes the file's name out of its path."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), name, 1).alias("file"), "value")
    text = F.regexp_replace("value", "\r\n?", "\n")
    if merge_continuations:
        text = F.regexp_replace(text, "\n\t", " ")
    lines = files.select("file", F.posexplode(F.split(text, "\n")).alias("at", "line")).where("line <> ''")
    speaker = F.split("line", ":\t", 2)[0]
    for long, short in SHORT_HEADERS.items():
        speaker = F.when(speaker == long, F.lit(short)).otherwise(speaker)
    out = lines.select("file", (F.col("at") + 1).alias("line_num"), speaker.alias("speaker"), F.coalesce(F.try_element_at(F.split("line", ":\t", 2), F.lit(2)), F.lit("")).alias("utterance"))
    out = out.where(F.col("speaker").startswith("*") | F.col("speaker").isin(*KEPT_HEADERS))
    is_utt = F.col("speaker").startswith("*").cast("int")
    number = F.sum(is_utt).over(Window.partitionBy("file").orderBy("line_num").rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("utt_num", F.when(is_utt == 1, number.cast("int"))).withColumn("utterance", F.when(F.col("speaker") == "@New Ep", F.lit("...")).otherwise(F.col("utterance")))


def coding_template(transcripts: DataFrame, passes: int = 3) -> DataFrame:
    """A blank coding document: each utterance once per pass."""
    each = F.explode(F.sequence(F.lit(1), F.lit(passes))).alias("pass")
    return transcripts.where("utt_num is not null").select(F.col("line_num").alias("LineNum"), F.col("utt_num").alias("UttNum"), "file", F.lit(None).cast("string").alias("coder"), F.lit(None).cast("bigint").alias("date"), F.lit(None).cast("string").alias("context"), each)


def delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = True, line_sep: str | None = None, quote: str = "") -> DataFrame:
    """Delimited text with a given schema; ``line_sep='\\r'`` for files with bare carriage returns."""
    reader = spark.read.option("sep", sep).option("header", header).option("quote", quote).option("mode", "PERMISSIVE")
    return (reader.option("lineSep", line_sep) if line_sep else reader).schema(schema).csv(path)


def dictionary(spark: SparkSession, path: str, updated: bool = True) -> DataFrame:
    return delimited(spark, path, "word string, phon string", "\t" if updated else " ", updated)


def keyword_list(spark: SparkSession, path: str) -> DataFrame:
    """(context, word) of a keyword CSV; 'NA' and blanks are no context, '_' joins the parts of a word."""
    rows = delimited(spark, path, "category string, word string, context string", ",", True, "\r", '"')
    return rows.where("context is not null and context not in ('', 'NA')").select("context", F.replace("word", F.lit("_"), F.lit(" ")).alias("word"))


def numbered_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(line, name) of a text file of any size: lines are numbered from 0 by the place of their part of the file, so the
    file is read by many tasks."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias(name))
    ranked = global_rank(t, [F.col("_file"), F.col("_start"), F.col("_at")], "line")
    return ranked.select((F.col("line") - 1).alias("line"), name)


def aligned_lines(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Parallel files by line number: line, and a column per file."""
    out: DataFrame | None = None
    for name, path in paths.items():
        t = numbered_lines(spark, path, name)
        out = t if out is None else out.join(t, "line", "full")
    return out


def coding_documents(spark: SparkSession, path: str, pattern: str = "coding_doc*.txt", test_coders: str = "drop") -> DataFrame:
    """All coded rows below a folder: separators to ';', lower case, duplicates once. Rows of test coders are an error of
    the data: they are left out, or end the query with ``test_coders="error"``."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("sep", "\t").option("header", True).option("quote", "").schema(CODING_SCHEMA).csv(path)
    rows = rows.where("coder is not null and coder <> ''")
    test = F.upper("coder").isin("RM", "TEST")
    if test_coders == "error":
        rows = rows.withColumn("coder", F.when(test, F.raise_error(F.lit("rows of test coders"))).otherwise(F.col("coder")))
    else:
        rows = rows.where(~test)
    return rows.withColumn("context", F.lower(F.translate("context", ",/", ";;"))).withColumn("date", F.timestamp_seconds("date")).dropDuplicates()


def score_tables(spark: SparkSession, path: str, columns: list[str], keep: str = "n500_", context: str = r".*output/(.*)Eval/.*", pattern: str = "*.trscore") -> DataFrame:
    """White-space tables of scores below a folder; the context comes from the path."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.col("file").contains(keep))
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.trim("value").isin("") & F.try_element_at(parts, F.lit(1)).try_cast("double").isNotNull())
    return rows.select("file", F.nullif(F.regexp_extract("file", context, 1), F.lit("")).alias("context"), *(F.try_element_at(parts, F.lit(i + 1)).try_cast("double").alias(c) for i, c in enumerate(columns)))


def score_logs(spark: SparkSession, path: str, context: str = r"([^/]*)\.out$", pattern: str = "*.out") -> DataFrame:
    """Log files with lines like ``P 1.0 R 2.0 F 3.0 BP ...``: a row per file, the mean of each measure; null where a
    file has no such line."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    files = lines.select("file").distinct()
    pair = r"([A-Z]{1,2})\s+([0-9.eE+-]+)"
    maps = F.map_from_arrays(F.regexp_extract_all("value", F.lit(pair), F.lit(1)), F.regexp_extract_all("value", F.lit(pair), F.lit(2)))
    found = lines.where(F.col("value").rlike(r"^P ")).select("file", F.explode(maps).alias("measure", "v")).groupBy("file").pivot("measure", ["P", "R", "F", "BP", "BR", "BF", "LP", "LR", "LF"]).agg(F.avg(F.col("v").try_cast("double")))
    return files.join(found, "file", "left").withColumn("context", F.regexp_extract("file", context, 1))


def batch_results(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet results of all jobs below a folder."""
    return spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(path)


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def grid(spark: SparkSession, **axes: list) -> DataFrame:
    """All combinations of a few short lists."""
    out: DataFrame | None = None
    for name, values in axes.items():
        t = spark.createDataFrame([(v,) for v in values], [name])
        out = t if out is None else out.crossJoin(t)
    return out


def preview(tables: dict[str, DataFrame], n: int = 6) -> dict[str, DataFrame]:
    return {k: t.limit(n) for k, t in tables.items()}
