"""Word stems by Porter's suffix rules of 1980."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Endings and what they become, step by step; of a step's endings the longest that fits counts.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_VOWELS = "aeiou"


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in _VOWELS or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c", re.sub("^c*", "", _shape(word))))


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _by_table(word: str, endings, least: int) -> str:
    """``word`` with its longest ending of the table replaced, if the rest measures more than ``least``."""
    for end in sorted(endings, key=len, reverse=True):
        if word.endswith(end):
            rest = word[: -len(end)]
            return rest + endings[end] if _measure(rest) > least else word
    return word


def porter(word: str) -> str:
    """The stem of a lower-case word; words of two letters or fewer are stems."""
    if len(word) <= 2:
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif (cut := next((e for e in ("ed", "ing") if w.endswith(e)), None)) and "v" in _shape(w[: -len(cut)]):
        w = w[: -len(cut)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _by_table(w, STEP_2, 0)
    w = _by_table(w, STEP_3, 0)
    end = next((e for e in sorted(STEP_4, key=len, reverse=True) if w.endswith(e)), None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e"):
        rest = w[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _short(rest)):
            w = rest
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def _stems(words: pd.Series) -> pd.Series:
    return words.map({w: None if w is None else porter(w) for w in words.unique()})


def stems(column: Column | str) -> Column:
    """``porter`` of a column, each distinct word of a batch once."""
    return F.pandas_udf(_stems, StringType())(column)
