"""The English Snowball stemmer (Porter2), from its published definition.

Stems are made in an Arrow-batched UDF, once for each distinct word of a batch;
the most frequent ones are kept by the process.  Nothing is shuffled for them.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the published definition.
_IRREGULAR = {
    "skis": "ski",
    "skies": "sky",
    "dying": "die",
    "lying": "lie",
    "tying": "tie",
    "idly": "idl",
    "gently": "gentl",
    "ugly": "ugli",
    "early": "earli",
    "only": "onli",
    "singly": "singl",
    "sky": "sky",
    "news": "news",
    "howe": "howe",
    "atlas": "atlas",
    "cosmos": "cosmos",
    "bias": "bias",
    "andes": "andes",
}
_KEPT_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_STEP_2 = {
    "ization": "ize",
    "ational": "ate",
    "fulness": "ful",
    "ousness": "ous",
    "iveness": "ive",
    "tional": "tion",
    "biliti": "ble",
    "lessli": "less",
    "entli": "ent",
    "ation": "ate",
    "alism": "al",
    "aliti": "al",
    "ousli": "ous",
    "iviti": "ive",
    "fulli": "ful",
    "enci": "ence",
    "anci": "ance",
    "abli": "able",
    "izer": "ize",
    "ator": "ate",
    "alli": "al",
    "bli": "ble",
}
_STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_VOWELS = "aeiouy"
_SHORT_END = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_REGION = re.compile(r"[aeiouy][^aeiouy]")


def _regions(word: str) -> tuple[int, int]:
    """Where the two regions begin in which most suffixes must lie."""
    head = re.match(r"gener|commun|arsen", word)
    if head:
        first = head.end()
    else:
        found = _REGION.search(word)
        first = found.end() if found else len(word)
    found = _REGION.search(word, first)
    return first, found.end() if found else len(word)


def _longest(word: str, endings: object) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith(("us", "ss")) or not word.endswith("s"):
        return word
    return word[:-1] if re.search("[aeiouy]", word[:-2]) else word


def _past(word: str, first: int) -> str:
    if word.endswith(("eed", "eedly")):
        end = len(word) - (5 if word.endswith("ly") else 3)
        return word[: end + 2] if end >= first else word
    ending = _longest(word, ("ed", "edly", "ing", "ingly"))
    stem = word[: len(word) - len(ending)]
    if not ending or not re.search("[aeiouy]", stem):
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if stem.endswith(_DOUBLES):
        return stem[:-1]
    return stem + "e" if first >= len(stem) and _SHORT_END.search(stem) else stem


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-cased word; words of up to two letters stay as they are."""
    if len(word) <= 2:
        return word
    word = word.lstrip("'")
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    word = re.sub(r"(^|[aeiouy])y", r"\1Y", word)
    first, second = _regions(word)
    word = re.sub(r"'s?'?$", "", word) if "'" in word else word
    word = _plural(word)
    if word in _KEPT_AFTER_1A:
        return word
    word = _past(word, first)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    ending = _longest(word, (*_STEP_2, "ogi", "li"))
    at = len(word) - len(ending)
    if ending and at >= first:
        if ending in _STEP_2:
            word = word[:at] + _STEP_2[ending]
        elif ending == "ogi" and word[:at].endswith("l") or ending == "li" and word[:at].endswith(tuple("cdeghkmnrt")):
            word = word[: at + (2 if ending == "ogi" else 0)]
    ending = _longest(word, (*_STEP_3, "ative"))
    at = len(word) - len(ending)
    if ending and at >= first:
        if ending in _STEP_3:
            word = word[:at] + _STEP_3[ending]
        elif at >= second:
            word = word[:at]
    ending = _longest(word, (*_STEP_4, "ion"))
    at = len(word) - len(ending)
    if ending and at >= second and (ending != "ion" or word[:at].endswith(("s", "t"))):
        word = word[:at]
    if word.endswith("e"):
        at = len(word) - 1
        if at >= second or at >= first and not _SHORT_END.search(word[:at]):
            word = word[:at]
    elif word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word.lower()


@F.pandas_udf(StringType())
def stemmed(word: pd.Series) -> pd.Series:
    """Stems of a column of words; each distinct word of a batch is stemmed once."""
    codes, distinct = pd.factorize(word)
    stems = pd.Series([stem(w) for w in distinct] + [None], dtype=object)
    return stems.take(codes).reset_index(drop=True)


def stem_terms(rows: DataFrame) -> DataFrame:
    """``rows`` with ``term`` stemmed; null stays null."""
    return rows.withColumn("term", stemmed("term"))
