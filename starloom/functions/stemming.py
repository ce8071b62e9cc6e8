"""Porter stemming (Porter 1980, with the usual NLTK extensions).

``stem_text`` stems inside a text, for streams and short texts: each Python worker remembers the
words it has met. Corpora are stemmed by their distinct words (``stem_words``), which are far fewer.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Irregular forms.
_IRREGULAR = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
              "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
              "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
              "exceed": "exceed", "succeed": "succeed"}

# Suffix rules of steps 2 to 4 of the published algorithm.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
          ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
          ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
          ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
          ("fulli", "ful"), ("logi", "log")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
          ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
          "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(stem: str) -> str:
    """Consonant/vowel string, e.g. 'tree' -> 'ccvv'; y after a consonant is a vowel."""
    out = ""
    for letter in stem:
        vowel = letter in "aeiou" or (letter == "y" and out.endswith("c"))
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _ends_cvc(word: str) -> bool:
    shape = _shape(word)
    if len(word) == 2:
        return shape == "vc"
    return shape.endswith("cvc") and word[-1] not in "wxy"


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word).endswith("c")


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("s") and not word.endswith("ss"):
        return word[:-1]
    return word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if "v" not in _shape(stem):
                return word
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double_consonant(stem):
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _ends_cvc(stem) else stem
    return word


def _final_y(word: str) -> str:
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1]).endswith("c"):
        return word[:-1] + "i"
    return word


def _swap(word: str, rules: list[tuple[str, str]]) -> str:
    for suffix, replacement in rules:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            measured = word[:-3] if suffix == "logi" else stem
            if _measure(measured) > 0:
                shorter = stem + replacement
                return _swap(shorter, rules) if suffix == "alli" else shorter
            return word
    return word


def _drop_suffix(word: str) -> str:
    for suffix in _STEP4:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                return stem
            return word
    return word


def _final_e(word: str) -> str:
    if not word.endswith("e"):
        return word
    stem = word[:-1]
    measure = _measure(stem)
    return stem if measure > 1 or (measure == 1 and not _ends_cvc(stem)) else word


def _final_l(word: str) -> str:
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


@lru_cache(maxsize=1_000_000)
def stem_word(word: str) -> str:
    word = word.lower()
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _final_y(_past(_plural(word)))
    return _final_l(_final_e(_drop_suffix(_swap(_swap(word, _STEP2), _STEP3))))


def stem_text(text: Column | str) -> Column:
    """Stem every blank-separated word of a text column."""

    @F.pandas_udf("string")
    def stems(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else " ".join(stem_word(w) for w in v.split()))

    return stems(F.col(text) if isinstance(text, str) else text)


def stem_words(words: DataFrame, word: str = "form", stem: str = "lemma") -> DataFrame:
    """(word, stem) of a table of distinct words."""

    @F.pandas_udf("string")
    def stems(values: pd.Series) -> pd.Series:
        return values.map(stem_word, na_action="ignore")

    return words.select(word, stems(F.col(word)).alias(stem))
