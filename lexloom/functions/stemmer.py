"""English stems by the Snowball project's published algorithm (Porter2)."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeiouy"

# Word lists and endings of the published algorithm.
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
UNCHANGED_SINGULARS = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
LONG_PREFIXES = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
BEFORE_LI = "cdeghkmnrt"
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")


def _vowel(c: str) -> bool:
    return c in VOWELS


def _region(word: str, start: int) -> int:
    """Where the part after the first consonant that follows a vowel begins, from ``start``."""
    for i in range(start + 1, len(word)):
        if _vowel(word[i - 1]) and not _vowel(word[i]):
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return _vowel(word[0]) and not _vowel(word[1])
    return len(word) > 2 and not _vowel(word[-3]) and _vowel(word[-2]) and not _vowel(word[-1]) and word[-1] not in "wxY"


def _ending(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _singular(word: str) -> str:
    end = _ending(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        return word[:-2]
    if end in ("ied", "ies"):
        return word[:-2] if len(word) > 4 else word[:-1]
    if end == "s" and any(map(_vowel, word[:-2])):
        return word[:-1]
    return word


def _without_ed_ing(word: str, r1: int) -> str:
    end = _ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end is None:
        return word
    rest = word[: -len(end)]
    if end in ("eed", "eedly"):
        return rest + "ee" if len(rest) >= r1 else word
    if not any(map(_vowel, rest)):
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if rest.endswith(DOUBLES):
        return rest[:-1]
    return rest + "e" if len(rest) <= r1 and _short_end(rest) else rest


@lru_cache(maxsize=1 << 18)
def stem_word(word: str) -> str:
    """The stem of a word in lower case."""
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS or word in UNCHANGED:
        return EXCEPTIONS.get(word, word)
    word = word[1:] if word[0] == "'" else word
    marked = ""
    for i, c in enumerate(word):  # a y that is a consonant is written Y
        marked += "Y" if c == "y" and (i == 0 or _vowel(marked[-1])) else c
    word = marked
    prefix = next((p for p in LONG_PREFIXES if word.startswith(p)), None)
    r1 = len(prefix) if prefix else _region(word, 0)
    r2 = _region(word, r1)
    end = _ending(word, ("'", "'s", "'s'"))
    word = _singular(word[: -len(end)] if end else word)
    if word in UNCHANGED_SINGULARS:
        return word
    word = _without_ed_ing(word, r1)
    if len(word) > 2 and word[-1] in "yY" and not _vowel(word[-2]):
        word = word[:-1] + "i"
    end = _ending(word, STEP_2)
    rest = word[: -len(end)] if end else word
    if end and len(rest) >= r1 and (end != "ogi" or rest.endswith("l")) and (end != "li" or rest[-1:] in tuple(BEFORE_LI)):
        word = rest + STEP_2[end]
    end = _ending(word, STEP_3)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + STEP_3[end]
    end = _ending(word, STEP_4)
    rest = word[: -len(end)] if end else word
    if end and len(rest) >= r2 and (end != "ion" or rest.endswith(("s", "t"))):
        word = rest
    if word.endswith("e") and (len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_end(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def stems(words: Column) -> Column:
    """The stems of a list of words."""

    @F.pandas_udf("array<string>")
    def each(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: None if x is None else [stem_word(w) for w in x])

    return each(words)
