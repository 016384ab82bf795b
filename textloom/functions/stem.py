"""English suffix stripping after Porter (1980), as a vectorised function over token arrays."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The suffix tables of the published algorithm, steps 2 to 4.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """v and c for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short_end(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _inflection(word: str) -> str:
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        ending = _longest(word, ("ed", "ing"))
        stem = word[: -len(ending)] if ending else ""
        if "v" in _shape(stem):
            word = stem
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word[-1:] == word[-2:-1] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    return word


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words with other than a-z, or of two letters, stay (diacritics fall first)."""
    word = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)))
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    word = _inflection(word)
    for table in (STEP2, STEP3):
        ending = _longest(word, table)
        if ending and _measure(word[: -len(ending)]):
            word = word[: -len(ending)] + table[ending]
    ending = _longest(word, STEP4)
    if ending:
        rest = word[: -len(ending)]
        if _measure(rest) > 1 and (ending != "ion" or rest.endswith(("s", "t"))):
            word = rest
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(ArrayType(StringType()))
def _stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda words: None if words is None else [stem(w) for w in words])


def stems(tokens: Column) -> Column:
    """The stems of an array of lower-case tokens; null stays null."""
    return _stems(tokens)


@F.pandas_udf(StringType())
def stem_word(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The stem of a lower-case word."""
    for batch in batches:
        yield batch.map(stem, na_action="ignore")
