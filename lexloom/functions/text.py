"""Scalar text functions: normalisation, tokens, syllables, transliteration, small formatters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substitutions that bring transcripts to the dictionary's spelling; their order matters.
#: (pattern, replacement, is a regular expression)
TRANSCRIPT_CLEANING: list[tuple[str, str, bool]] = [
    ("@[A-Za-z]+", "", True),
    ("[?]", "", True),
    ("[.]", "", True),
    ("[!]", "", True),
    ("[;]", "", True),
    ("mummmy", "mummy", False),
    ("nosy", "nosey", False),
    ("loulou", "lou-lou", False),
    ("tata's", "ta-ta's", False),
    ("cmon", "c'mon", False),
    ("uhuh", "uh-huh", False),
    ("tumtum", "tum tum", False),
    ("haha", "ha ha", False),
    ("ahhah", "aah ha", False),
    (r"\[.*\]", "", True),
    ("bath+room", "bathroom", False),
    ("play+mate", "playmate", False),
    ("t+shirt", "t-shirt", False),
    ("sack+cloth", "sackcloth", False),
    ("+", " ", False),
    ("_", " ", False),
    ("(i)t", "it", False),
    ("y(ou)", "you", False),
    ("(i)f", "if", False),
    ("d(o)", "do", False),
    ("t(o)", "to", False),
    ("(h)ave", "'ave", False),
    ("(h)ere", "'ere", False),
    (r"\(.*\)", "", True),
    ("[:]", "", True),
]


def letters(text: Column) -> Column:
    """Lower case, letters a-z only, single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z]+", " "))


def tokens(text: Column, sep: str = " ") -> Column:
    """The parts between separators, without empty ones."""
    return F.filter(F.split(text, sep), lambda t: t != "")


def clean_utterance(text: Column, rules: Sequence[tuple[str, str, bool]] = TRANSCRIPT_CLEANING) -> Column:
    """Ordered substitutions, then lower case and single blanks."""
    for pattern, to, regex in rules:
        text = F.regexp_replace(text, pattern, to) if regex else F.replace(text, F.lit(pattern), F.lit(to))
    return F.trim(F.regexp_replace(F.lower(text), "[ \t]+", " "))


def drop_punctuation_tokens(words: Column) -> Column:
    """Without words that are only punctuation or only white space."""
    return F.filter(words, lambda w: ~w.rlike(r"^(\p{Punct}*|\s*)$"))


def n_syllables(phon: Column) -> Column:
    """Syllables of a word form, joined by '-'."""
    return F.when(phon.isNotNull() & (phon != ""), F.size(F.split(phon, "-"))).otherwise(0)


def syllables(phon: Column) -> Column:
    """All syllables of an utterance: blanks and '-' separate."""
    return tokens(F.translate(phon, "-", " "))


def transliterate(word: Column, phones: Mapping[str, str], sep: str = " ") -> Column:
    """Each character by its phone in one pass; characters without one go."""
    table = F.create_map(*(x for k, v in sorted(phones.items()) for x in (F.lit(k), F.lit(v))))
    return F.array_join(F.filter(F.transform(F.split(word, ""), lambda c: F.try_element_at(table, c)), lambda c: c.isNotNull()), sep)


def transliterate_sequential(word: Column, phones: Mapping[str, str]) -> Column:
    """Legacy: one replacement after the other, so that output can be replaced again."""
    for k, v in sorted(phones.items(), key=lambda x: x[1]):
        word = F.replace(word, F.lit(k), F.lit(v + " "))
    return F.trim(word)


def split_codes(cell: Column, most: int | None = 10) -> Column:
    """The codes of a cell like 'a ; b', without blank ones; of the first ``most`` fields."""
    parts = F.split(cell, r"[ \t]*;[ \t]*")
    parts = F.slice(parts, 1, most) if most else parts
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def number_word(n: Column, capital: bool = False) -> Column:
    """0 to 9 as words, else null."""
    names = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
    table = F.create_map(*(x for i, w in enumerate(names) for x in (F.lit(i), F.lit(w.capitalize() if capital else w))))
    return F.try_element_at(table, n.cast("int"))


def stars(p: Column) -> Column:
    """Marks of significance."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p < 0.1, "+").otherwise("")


def p_text(p: Column) -> Column:
    return F.when(p < 0.001, F.lit("p < .001")).otherwise(F.concat(F.lit("p = "), F.format_string("%.3f", F.bround(p, 3))))


def harmonic(a: Column, b: Column) -> Column:
    return F.try_divide(2 * a * b, a + b)


def percent_repair(v: Column) -> Column:
    """Shares given as fractions become percentages."""
    return F.when(v < 1, v * 100).otherwise(v)


def smoothed_share(x: Column, total: Column, prior: float, n: int) -> Column:
    """(x + prior) / (total + n * prior): the share of one of n categories under an even prior."""
    return (x + prior) / (total + n * prior)


def file_parts(utt: Column) -> dict[str, Column]:
    """child, age in weeks and number of an id like 'ab12.cha_7'; null where it has no such form."""
    form = r"^([a-z]{2})([0-9]{2})\.cha_([0-9]+)$"
    return {"child": F.nullif(F.regexp_extract(utt, form, 1), F.lit("")), "age_weeks": F.regexp_extract(utt, form, 2).try_cast("int"), "utt_num": F.regexp_extract(utt, form, 3).try_cast("int")}


def checksum_matches(content: Column, prefix: str) -> Column:
    """Whether the SHA-1 of the content begins with a prefix of at least 6 digits."""
    if len(prefix) < 6:
        raise ValueError("at least 6 digits are needed")
    return F.sha1(content.cast("binary")).startswith(prefix.lower())
