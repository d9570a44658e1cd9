"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tsv(df: DataFrame, path: str, sep: str = "\t", mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("sep", sep).option("header", True).option("quote", "" if sep == "\t" else '"').csv(path)


def context_corpora(long: DataFrame, path: str, text: str, name: str = "context", value: str = "value", iteration: Column | None = None, mode: str = "errorifexists") -> None:
    """One folder of headerless text per context and iteration with the utterances that have it."""
    it = iteration if iteration is not None else F.lit(0)
    long.where(F.col(value) == 1).select(F.col(text).alias("value"), F.col(name).alias("context"), it.alias("iter")).write.mode(mode).partitionBy("context", "iter").text(path)


def json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode(mode).text(path)


def markdown(df: DataFrame, limit: int | None = None) -> str:
    """A Markdown table of all rows, which must be few, or of the first ``limit`` with a line that says so."""
    rows = [[("" if v is None else str(v).replace("|", "\\|")) for v in r] for r in (df.limit(limit + 1) if limit is not None else df).collect()]
    more = limit is not None and len(rows) > limit
    lines = ["| " + " | ".join(r) + " |" for r in [df.columns, ["-"] * len(df.columns), *rows[:limit]]]
    return "\n".join([*lines, "", f"(the first {limit} rows)"] if more else lines)
