"""Dictionary substitution and sequential text matching."""

from __future__ import annotations

import bisect
from array import array

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions.text import tokens
from lexloom.scratch import Scratch, ship_package

# Alternate spellings, and the dictionary word whose form each takes.
SPELLINGS: list[tuple[str, str]] = [
    ("shh", "sh"), ("ssh", "sh"), ("mummie", "mummy"), ("mummie's", "mummy's"), ("mummmy's", "mummy's"), ("mummie'll", "mummy'll"), ("tellie", "telly"), ("handie", "handy"), ("pottie", "potty"), ("bathie", "bathy"),
    ("ruskie", "rusky"), ("headie", "heady"), ("chinnie", "chinny"), ("hankie", "hanky"), ("nappie", "nappy"), ("drinkie", "drinkee"), ("rolly", "roley"), ("rollie", "roley"), ("polly", "poley"), ("pollie", "poley"),
    ("deary", "dearie"), ("hiccough", "hiccup"), ("hiccoughs", "hiccups"), ("poo", "pooh"), ("lew", "lu"), ("&hmm", "hmm"), ("&er", "er"), ("&eh", "eh"), ("&ha", "ha"), ("&mm", "mm"), ("&ah", "aah"), ("&uh", "uh"),
    ("&hah", "ha"), ("whee", "wee"), ("treas", "treazh"), ("hee", "he"), ("oo", "ooh"),
]


def first_entries(dictionary: DataFrame, word: str = "word", order: str | None = None) -> DataFrame:
    """One entry per word: the first in ``order``."""
    if order is None:
        return dictionary.dropDuplicates([word])
    return dictionary.withColumn("_r", F.row_number().over(Window.partitionBy(word).orderBy(order))).where("_r = 1").drop("_r")


def update_dictionary(dictionary: DataFrame, spellings: DataFrame, additions: DataFrame) -> DataFrame:
    """Adds alternate spellings (word, old_word), which take the old word's form, and further entries (word, phon)."""
    alternates = spellings.join(dictionary.withColumnRenamed("word", "old_word"), "old_word").select("word", "phon")
    return dictionary.select("word", "phon").union(alternates).join(additions.select("word", "phon"), ["word", "phon"], "full").distinct()


def close_dictionary(dictionary: DataFrame, order: str | None = None) -> DataFrame:
    """(word, phon, steps): every word with the form that it has after all substitutions. A form that is itself a word is
    replaced by that word's form, and so on, ``steps`` times in all.

    With ``order`` the entries are applied one after the other in that order, as by a list of substitutions: a form is
    replaced by later entries only, and of a word's entries the first counts. Without it forms are followed until one is no
    word (of a word's entries the one with the smallest form counts); a word whose forms come back to where they were takes
    the smallest form of that cycle, with null steps.

    Chains are followed by doubling: a word's step is joined with the step from where it leads, so n steps take log n
    joins, of those words only whose forms are words."""
    spark = dictionary.sparkSession
    scratch = Scratch(spark, "dictionary")
    if order is None:
        entries = dictionary.where("word IS NOT NULL").groupBy("word").agg(F.min("phon").alias("phon"), F.lit(0).alias("_o"))
    else:
        entries = dictionary.where("word IS NOT NULL").groupBy("word").agg(F.min_by("phon", order).alias("phon"), F.min(order).alias("_o"))
    entries = scratch.put(entries, "entries")
    later = F.lit(True) if order is None else F.col("b._o") > F.col("a._o")
    chained = entries.alias("a").join(entries.alias("b"), (F.col("a.phon") == F.col("b.word")) & later).select("a.word", F.col("a.phon").alias("at"), F.col("a.phon").alias("low"))
    # where a chain has come to, the smallest form on the way, the steps so far, and whether it goes on
    going = scratch.put(chained, "chained")
    state = going.withColumn("steps", F.lit(1).cast("long")).join(going.select(F.col("word").alias("at"), F.lit(True).alias("open")), "at", "left")
    state = scratch.put(state.select("word", "at", "low", "steps", F.coalesce("open", F.lit(False)).alias("open")), "steps-0")
    chains, turn = state.count(), 0
    # after as many steps as there are chains, a chain that still goes on is in a cycle, and ``low`` has seen all of it
    while (1 << turn) <= chains and state.where("open").limit(1).count():
        turn += 1
        ahead = state.select(F.col("word").alias("at"), F.col("at").alias("_at"), F.col("low").alias("_low"), F.col("steps").alias("_steps"), F.col("open").alias("_open"))
        doubled = state.where("open").join(ahead, "at").select("word", F.col("_at").alias("at"), F.least("low", "_low").alias("low"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_open").alias("open"))
        state = scratch.put(state.where("not open").unionByName(doubled), f"steps-{turn}")
    ends = state.where("not open").join(entries.select(F.col("word").alias("at"), "phon"), "at").select("word", F.col("phon").alias("_end"), (F.col("steps") + 1).alias("_steps"))
    round_ = state.where("open").select("word", "at").join(state.select(F.col("word").alias("at"), F.col("low").alias("_end")), "at").select("word", "_end", F.lit(None).cast("long").alias("_steps"))
    found = entries.join(ends.union(round_).withColumn("_chain", F.lit(True)), "word", "left")
    return found.select("word", F.coalesce("_end", "phon").alias("phon"), F.when(F.col("_chain"), F.col("_steps")).otherwise(F.lit(1).cast("long")).alias("steps"))


def translate(docs: DataFrame, keys: list[str], text: str, dictionary: DataFrame, max_unknown: float = 0.0) -> DataFrame:
    """(keys, orth, phon, n_tokens, n_unknown): every token by its form; utterances with a larger share of unknown tokens go.
    A token is unknown if it has a letter and is neither a word nor a form of the dictionary, so punctuation and numbers
    stay as they are. dictionary has one entry (word, phon) per word; see ``close_dictionary`` for forms that are words."""
    forms = dictionary.select(F.col("phon").alias("word")).distinct().withColumn("_form", F.lit(True))
    known = dictionary.select("word", "phon").join(forms, "word", "full").select("word", F.coalesce("phon", "word").alias("phon"))
    spread = docs.select(*keys, F.posexplode(tokens(F.col(text))).alias("i", "word")).join(known, "word", "left")
    parts = F.array_sort(F.collect_list(F.struct("i", "word", F.coalesce("phon", "word").alias("form"))))
    unknown = F.col("phon").isNull() & F.col("word").rlike(r"\p{L}")
    out = spread.groupBy(*keys).agg(parts.alias("p"), F.count("*").alias("n_tokens"), F.count_if(unknown).alias("n_unknown"))
    out = out.where(F.col("n_unknown") <= max_unknown * F.col("n_tokens"))
    return out.select(*keys, F.array_join(F.transform("p", lambda x: x["word"]), " ").alias("orth"), F.array_join(F.transform("p", lambda x: x["form"]), " ").alias("phon"), "n_tokens", "n_unknown")


def places_of(parts: list[str], texts: list[str | None]) -> dict[str, array]:
    """For each of ``parts`` the places of the texts that contain it, in order; one pass over the texts finds all."""
    import ahocorasick

    found = {p: array("q") for p in parts if p}
    if found:
        machine = ahocorasick.Automaton()
        for p in found:
            machine.add_word(p, p)
        machine.make_automaton()
        for place, text in enumerate(texts):
            for _, p in machine.iter(text or ""):
                at = found[p]
                if not at or at[-1] != place:
                    at.append(place)
    if "" in parts:
        found[""] = array("q", (i for i, t in enumerate(texts) if t is not None))
    return found


def greedy_match(left: DataFrame, right: DataFrame, group: list[str], order: str, left_text: str, right_text: str) -> DataFrame:
    """For each left row in turn the first of the remaining right rows whose text contains its text: (group, left order,
    right order or null). The first right row of those that remain is given up after each match, whichever row has
    matched, so a right row may match several times, and later ones before earlier ones.

    Sequential by nature; the groups (files) run in parallel, each in the memory of one task. Where texts are found comes
    from one pass over the right texts of a group. A null text matches nothing, an empty left text any."""

    def match(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values(order), b.sort_values(order)
        wanted, places = a[left_text].tolist(), b[order].tolist()
        held = places_of(list({t for t in wanted if t is not None}), b[right_text].tolist())
        gone, out = 0, []
        for t in wanted:
            rows = held.get(t, ()) if t is not None else ()
            at = bisect.bisect_left(rows, gone)
            out.append(places[rows[at]] if at < len(rows) else None)
            gone += at < len(rows)
        return pd.DataFrame({**{g: [k] * len(a) for g, k in zip(group, key)}, "left_order": a[order].tolist(), "right_order": pd.array(out, dtype="Int64")})

    ship_package(left.sparkSession)
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in left.schema if f.name in group] + ["left_order long", "right_order long"])
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(match, schema)
