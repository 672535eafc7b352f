"""Porter's stemmer, as full-text indexes with a ``porter`` tokenizer use it.

Suffix rules depend on the measure of the stem before them, the number of its vowel-consonant runs, which column
expressions can only reach by some sixty regular expressions a word. So words go to Python in Arrow batches of arrays,
where a bounded cache answers the frequent ones.
"""

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words beyond these lengths stay as they are, so a cached word is short.
SHORTEST, LONGEST = 3, 64
#: Suffixes and what stands for them, from the published algorithm with its author's later changes (fixed values).
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """``v`` or ``c`` for each letter; a y after a consonant is a vowel."""
    out = ""
    for k, letter in enumerate(word):
        out += "v" if letter in "aeiou" or (letter == "y" and k and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _cvc(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _suffix(word: str, suffixes) -> str:
    """The longest of the suffixes that leaves a stem, or the empty text."""
    return max((s for s in suffixes if word.endswith(s) and len(word) > len(s)), key=len, default="")


def _plural(word: str) -> str:
    if not word.endswith("s") or word.endswith("ss"):
        return word
    return word[:-2] if _suffix(word, ("sses", "ies")) else word[:-1]


def _past(word: str) -> str:
    found = _suffix(word, ("eed", "ed", "ing"))
    stem = word[: len(word) - len(found)]
    if found == "eed":
        return stem + "ee" if _measure(stem) else word
    if not found or "v" not in _shape(stem):
        return word
    if _suffix(stem, ("at", "bl", "iz")):
        return stem + "e"
    if len(stem) > 1 and stem[-1] == stem[-2] and stem[-1] not in "aeioulsz":
        return stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _cvc(stem) else stem


def _replaced(word: str, rules: dict[str, str]) -> str:
    found = _suffix(word, rules)
    stem = word[: len(word) - len(found)]
    return stem + rules[found] if found and _measure(stem) else word


def _bare(word: str) -> str:
    found = _suffix(word, FOURTH)
    stem = word[: len(word) - len(found)]
    if not found or _measure(stem) < 2 or (found == "ion" and stem[-1] not in "st"):
        return word
    return stem


def _tidy(word: str) -> str:
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _cvc(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


@lru_cache(1 << 16)
def _stem(word: str) -> str:
    word = _past(_plural(word))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    return _tidy(_bare(_replaced(_replaced(word, SECOND), THIRD)))


def stem(word: str) -> str:
    """The stem of a word in lower case; words of under three or over 64 bytes stay as they are."""
    return _stem(word) if SHORTEST <= len(word.encode()) <= LONGEST else word


def stems(words: Column) -> Column:
    """The stems of an array of words, in order; a null array or word stays null."""

    @F.pandas_udf("array<string>")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda ws: None if ws is None else [None if w is None else stem(w) for w in ws])

    return each(words)
