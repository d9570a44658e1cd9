"""Contexts of utterances in long form: (keys, context, value). Wide tables are made at the edges only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import split_codes


def to_long(wide: DataFrame, keys: list[str], columns: list[str] | None = None, name: str = "context", value: str = "value") -> DataFrame:
    columns = columns or [c for c in wide.columns if c not in keys]
    return wide.select(*keys, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(keys, columns, name, value)


def to_wide(long: DataFrame, keys: list[str], contexts: list[str], name: str = "context", value: str = "value", fill: float | None = None) -> DataFrame:
    """One column per context; the list is given, so no extra pass looks for it. Absent cells are null or ``fill``."""
    out = long.groupBy(*keys).pivot(name, contexts).agg(F.first(value, ignorenulls=True))
    return out.fillna(fill, contexts) if fill is not None else out


def with_prefix(wide: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """The keys and the columns whose names begin with ``prefix``."""
    return wide.select(*keys, *(c for c in wide.columns if c.startswith(prefix) and c not in keys))


def known_columns(wide: DataFrame, names: list[str]) -> DataFrame:
    """The columns of ``names`` that there are, in that order; unknown names are passed over."""
    return wide.select(*(c for c in names if c in wide.columns))


def drop_empty_columns(wide: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Without the columns that have nothing but nulls; one pass counts them all."""
    columns = columns or wide.columns
    filled = wide.agg(*(F.count(c).alias(c) for c in columns)).first()
    return wide.select(*(c for c in wide.columns if c not in columns or filled[c]))


def binarise(value: Column) -> Column:
    """1 above 0, else 0; null stays null."""
    return F.when(value.isNull(), None).when(value > 0, 1).otherwise(0)


def apply_threshold(long: DataFrame, threshold: float, inclusive: bool = False, name: str = "context", value: str = "value") -> DataFrame:
    """0/1 by a strict threshold; contexts that no row reaches are left out."""
    over = F.col(value) >= threshold if inclusive else F.col(value) > threshold
    marked = long.withColumn(value, F.when(over, 1).otherwise(0))
    return marked.join(marked.where(F.col(value) == 1).select(name).distinct(), name, "left_semi")


def threshold_sweep(long: DataFrame, keys: list[str], thresholds: list[float], value: str = "value") -> DataFrame:
    """Per threshold: mean number of contexts per element and the shares with none, one, one or two, two, more; the
    best threshold is the smallest with the largest share of one or two. Each element is spread over the list."""
    each = F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold")
    per = long.select(*keys, value, each).groupBy(*keys, "threshold").agg(F.count_if(F.col(value) > F.col("threshold")).alias("n"))
    share = lambda c: F.avg(c.cast("double"))
    n = F.col("n")
    out = per.groupBy("threshold").agg(F.avg("n").alias("mean_n"), share(n == 0).alias("zero"), share(n == 1).alias("one"), share(n.isin(1, 2)).alias("one_or_two"), share(n == 2).alias("two"), share(n > 2).alias("more"))
    best = out.agg(F.max(F.struct("one_or_two", -F.col("threshold"))).alias("b")).select((-F.col("b.col2")).alias("best"))
    return out.crossJoin(F.broadcast(best)).withColumn("best", F.col("threshold") == F.col("best"))  # one row


def remove_ambiguous(wide: DataFrame, contexts: list[str]) -> DataFrame:
    """Rows with fewer than two contexts; a null in a context makes the sum null and drops the row."""
    return wide.where(sum((F.col(c) for c in contexts[1:]), F.col(contexts[0])) < 2)


def extract_context(wide: DataFrame, contexts: list[str], out: str = "context") -> DataFrame:
    """The context's name where there is one, "ambiguous" for several, "no context tag" for none."""
    n = sum((F.coalesce(F.col(c), F.lit(0)) for c in contexts[1:]), F.coalesce(F.col(contexts[0]), F.lit(0)))
    only = F.coalesce(*(F.when(F.col(c) == 1, F.lit(c)) for c in contexts))
    return wide.withColumn(out, F.when(n > 1, F.lit("ambiguous")).when(n == 0, F.lit("no context tag")).otherwise(only))


def fuzzy_code(wide: DataFrame, contexts: list[str]) -> DataFrame:
    """Each context's share of the row's total; a total of 0 counts as 1."""
    total = sum((F.col(c) for c in contexts[1:]), F.col(contexts[0]))
    total = F.when(total == 0, 1).otherwise(total)
    return wide.select(*(c for c in wide.columns if c not in contexts), *((F.col(c) / total).alias(c) for c in contexts))


def min_support(long: DataFrame, least: float, strict: bool = True, name: str = "context", value: str = "value") -> DataFrame:
    """Contexts whose values add up to more than (or at least) ``least``: (context, total)."""
    total = long.groupBy(name).agg(F.sum(value).alias("total"))
    return total.where(F.col("total") > least if strict else F.col("total") >= least)


#: What words are made of; a keyword begins and ends where words do.
WORD = r"[\p{L}\p{M}\p{N}_]+"


def keyword_form(text: Column) -> Column:
    """Lower case, with runs of white space as one blank: the form in which texts and keywords are compared."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\x0B\f\r]+", " "))


def keyword_grams(docs: DataFrame, keys: list[str], text: str, lengths: list[int], firsts: list[str]) -> DataFrame:
    """(keys, grams): the parts of each text that begin with a word of ``firsts``, end with a word and have as many words as
    ``lengths`` says, with all that stands between the words; a part that occurs twice is there twice."""
    other = WORD.replace("[", "[^")
    parts = F.regexp_extract_all(keyword_form(F.col(text)), F.lit(f"{WORD}|{other}"), F.lit(0))  # words and what is between them, in turn
    # words and the rest take turns, and the rest is no keyword's first word
    starts = F.filter(F.sequence(F.lit(1), F.size("_parts")), lambda i: F.get("_parts", i - 1).isin(firsts))

    def grams(n: int) -> Column:
        last = F.size("_parts") - (2 * n - 2)
        return F.transform(F.filter("_starts", lambda i: i <= last), lambda i: F.array_join(F.slice("_parts", i, F.lit(2 * n - 1)), ""))

    # the parts are a column of their own, so that they are made once
    spread = docs.select(*keys, parts.alias("_parts")).select(*keys, "_parts", F.when(F.size("_parts") > 0, starts).alias("_starts"))
    return spread.select(*keys, F.flatten(F.array(*map(grams, lengths))).alias("grams") if lengths else F.array().cast("array<string>").alias("grams"))


def listed_keywords(words: DataFrame) -> tuple[DataFrame, list[int], list[str]]:
    """(distinct keywords (context, word) in the form of texts, with blanks for '_'; the numbers of words that they have; their
    first words). Keywords that don't begin and end with a letter, mark, digit or '_' are nowhere on word boundaries and go."""
    form = keyword_form(F.replace("word", F.lit("_"), F.lit(" ")))
    listed = words.select("context", form.alias("word")).where(F.col("word").rlike(f"^{WORD}(.*{WORD})?$")).distinct()
    own = F.regexp_extract_all("word", F.lit(WORD), F.lit(0))
    lengths, firsts = listed.agg(F.collect_set(F.size(own)), F.collect_set(F.get(own, F.lit(0)))).first()
    return listed, sorted(lengths), sorted(firsts)


def keyword_tags(docs: DataFrame, keys: list[str], text: str, words: DataFrame) -> DataFrame:
    """(keys, context, value): how many of a context's keywords an utterance has. words has (context, word); a word may have
    several parts, joined by blanks, '_', hyphens, apostrophes or whatever else stands between words.

    A keyword is found where it stands in the text as it is, in either case, between word boundaries: "that's" in "that's
    it", and "that" too, but not "hat's". An equi-join on parts of the texts, of the numbers of words that occur, not a
    regular expression per pair. Keywords are few and go to the texts, so that only what is found is shuffled."""
    listed, lengths, firsts = listed_keywords(words)
    found = keyword_grams(docs, keys, text, lengths, firsts).select(*keys, F.explode(F.array_distinct("grams")).alias("word"))
    return found.join(F.broadcast(listed), "word").groupBy(*keys, "context").agg(F.count("*").alias("value"))


def exactly_one(long: DataFrame, keys: list[str], method: str = "method", name: str = "context", value: str = "value") -> DataFrame:
    """The context of each element and method that has exactly one."""
    return long.where(F.col(value) == 1).groupBy(*keys, method).agg(F.count("*").alias("n"), F.min(name).alias(name)).where("n = 1").drop("n")


def full_join(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of several methods' wide tables on the same keys."""
    out: DataFrame | None = None
    for method, t in tables.items():
        t = t.select(*keys, *(F.col(c).alias(f"{method}_{c}") for c in t.columns if c not in keys))
        out = t if out is None else out.join(t, keys, "full")
    return out


def explode_codes(docs: DataFrame, keys: list[str], cell: str, most: int | None = 10) -> DataFrame:
    """A row per code of a cell like 'a ; b'."""
    return docs.select(*keys, F.explode(split_codes(F.col(cell), most)).alias("code"))


def vote_counts(codes: DataFrame, keys: list[str], category: str, coder: str, coders: int) -> DataFrame:
    """Distinct coders for each category of an element, and their share of all coders."""
    return codes.groupBy(*keys, category).agg(F.countDistinct(coder).alias("votes")).withColumn("share", F.col("votes") / coders)


def bad_rows(coder: Column, date: Column, context: Column, number: Column) -> Column:
    """Rows of a coding document that need repair: test coders, a date without a coder or without a real context, or a
    pass below 1."""
    dated = date.isNotNull()
    return F.coalesce(coder.isin("RM", "TEST"), F.lit(False)) | (F.coalesce(coder == "", F.lit(False)) & dated) | (F.coalesce(F.length(context) < 3, F.lit(False)) & dated) | F.coalesce(number < 1, F.lit(False))


def recode(column: Column, names: dict[str, str]) -> Column:
    out = column
    for k, v in names.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def clean_key(docs: DataFrame, column: str, key: DataFrame, raw: str, clean: str) -> DataFrame:
    """Values replaced through a key table; values that the key does not have are kept."""
    k = key.select(F.col(raw).alias("_raw"), F.col(clean).alias("_clean")).dropDuplicates(["_raw"])
    return docs.join(k, F.col(column) == F.col("_raw"), "left").withColumn(column, F.coalesce("_clean", column)).drop("_raw", "_clean")


def new_codes(docs: DataFrame, column: str, key: DataFrame, raw: str) -> DataFrame:
    """Values that the key table does not have."""
    return docs.select(F.col(column).alias("code")).distinct().join(key.select(F.col(raw).alias("code")), "code", "left_anti")


def repair_rows(doc: DataFrame, coder: str = "coder", date: str = "date", context: str = "context", number: str = "pass") -> DataFrame:
    """A coding document in which bad rows are blank again; no row is lost."""
    bad = bad_rows(F.col(coder), F.col(date), F.col(context), F.col(number))
    return doc.select(*(F.when(~bad, F.col(c)).alias(c) if c in (coder, date, context) else F.col(c) for c in doc.columns))


def coder_counts(codes: DataFrame, keys: list[str], coder: str = "coder") -> DataFrame:
    """Distinct coders per element."""
    return codes.where(F.col(coder).isNotNull() & (F.col(coder) != "")).groupBy(*keys).agg(F.countDistinct(coder).alias("n_coders"))
