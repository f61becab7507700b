"""Text functions: tokens, stems, set similarity, labels."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NON_WORD = r"[^\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    """Lower-cased words in order, repeats kept."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NON_WORD), lambda w: w != "")


def tokens(text: Column, shortest: int = 3) -> Column:
    """Distinct lower-cased words of at least three characters."""
    return F.array_distinct(F.filter(words(text), lambda w: F.length(w) >= shortest))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b)).cast("double")
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(0.0)


def query_terms(query: str) -> list[str]:
    """The words of a query, in order, repeats kept."""
    return [w for w in re.split(r"[^\w]+", query.lower()) if w]


def normalised_tag(tag: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(tag)), r"\s+", "-")


def csv_list(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def excerpt(content: Column, most: int = 200) -> Column:
    """Collapsed white space, cut at the last space within ``most`` characters."""
    flat = F.trim(F.regexp_replace(content, r"\s+", " "))
    cut = F.substring(flat, 1, most)
    head = F.regexp_extract(cut, r"^(.*) [^ ]*$", 1)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.when(head != "", head).otherwise(cut), F.lit(" …")))


def embedding_input(title: Column, content: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(content, F.lit("")))


def estimated_tokens(*parts: Column) -> Column:
    return F.floor(sum((F.length(p) for p in parts), F.lit(0)) / 4)


@F.pandas_udf(T.StringType())
def sorted_metadata(text: pd.Series) -> pd.Series:
    """JSON objects with sorted keys; null for anything else."""

    def one(value: str | None) -> str | None:
        try:
            found = json.loads(value) if value else None
        except ValueError:
            return None
        return json.dumps(found, sort_keys=True) if isinstance(found, dict) else None

    return text.map(one)




def _shape(stem: str) -> str:
    """c and v for the letters; y is a vowel after a consonant."""
    out = []
    for i, ch in enumerate(stem):
        out.append("v" if ch in "aeiou" or (ch == "y" and i and out[i - 1] == "c") else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(re.findall(r"v+c+", _shape(stem)))


def _ends_cvc(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


# The suffix rules of Porter's algorithm, longest first within a step.
STEP_2 = {
    "ational": "ate", "ization": "ize", "iveness": "ive", "fulness": "ful", "ousness": "ous", "tional": "tion", "biliti": "ble",
    "entli": "ent", "ousli": "ous", "ation": "ate", "alism": "al", "aliti": "al", "iviti": "ive", "enci": "ence", "anci": "ance",
    "izer": "ize", "abli": "able", "alli": "al", "ator": "ate", "eli": "e",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic ou".split()


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """The Porter stem of a lower-cased word."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            stem = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in _shape(stem):
                word = stem
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _ends_cvc(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP_2, STEP_3):
        for suffix, instead in rules.items():
            if word.endswith(suffix):
                stem = word[: -len(suffix)]
                word = stem + instead if _measure(stem) > 0 else word
                break
    for suffix in STEP_4:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _ends_cvc(stem)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(T.StringType())
def stem(column: pd.Series) -> pd.Series:
    """The Porter stems of words; meant for a distinct vocabulary."""
    return column.map(lambda w: porter(w) if w is not None else None)


def summary(now_score: Column) -> Column:
    """A memory's full summary as one struct, its score to four places."""
    return F.struct("id", "namespace", "type", "title", "content", "confidence", "created_at", "updated_at", "last_accessed", "last_confirmed", "access_count", "pinned", F.sort_array("tags").alias("tags"), F.round(now_score, 4).alias("score"))


@F.pandas_udf(T.BinaryType())
def packed_vector(column: pd.Series) -> pd.Series:
    """Vectors as little-endian 32-bit floats."""
    return column.map(lambda v: np.asarray(v, "<f4").tobytes() if v is not None else None)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpacked_vector(column: pd.Series) -> pd.Series:
    """The floats of packed vectors; null where the length isn't that of whole floats."""
    return column.map(lambda b: np.frombuffer(b, "<f4").tolist() if b is not None and len(b) % 4 == 0 else None)
