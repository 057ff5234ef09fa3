"""Word sets and exact set similarity, as Spark expressions and in Python."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NEAR_SAME = 0.8

#: The same word rule for Java's and Python's engines: a Chinese character is a word by itself.
JAVA_WORD = r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"
_HAN = "\u2e80-\u2fdf\u3005\u3007\u3021-\u3029\u3038-\u303b\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af"
PY_WORD = re.compile(rf"[{_HAN}]|[^\W_{_HAN}]+")


def word_list(text: Column) -> Column:
    """Lower-cased words in text order, repeats kept; null for a null text. Texts of ASCII alone take a plainer pattern."""
    plain = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.when(F.octet_length(text) == F.char_length(text), plain).otherwise(F.regexp_extract_all(F.lower(text), F.lit(JAVA_WORD), F.lit(0)))


def word_set(text: Column) -> Column:
    """Sorted distinct words; an empty array for a text without words."""
    return F.sort_array(F.array_distinct(word_list(text)))


def set_key(words: Column) -> Column:
    """16 bytes that stand for a word set (or sequence)."""
    return F.unhex(F.md5(F.concat_ws(" ", words)))


def py_words(text: str) -> list[str]:
    return PY_WORD.findall(text.lower())


def may_be_near(a_size: str, b_size: str, *bitmaps: tuple[str, str]) -> Column:
    """Lossless pre-check of a pair by set sizes and word bitmaps.

    Each differing word flips at most one bitmap position, and a Jaccard similarity of 0.8 leaves at most a ninth of the
    summed sizes as symmetric difference.
    """
    flips = " + ".join(f"bit_count({a} ^ {b})" for a, b in bitmaps)
    return F.expr(f"9 * ({flips}) <= {a_size} + {b_size} and 5 * least({a_size}, {b_size}) >= 4 * greatest({a_size}, {b_size})")


def near_same(a_words: str, b_words: str) -> Column:
    """Exact: words in both are at least 0.8 of words in either (whole numbers, no rounding)."""
    both = f"size(array_intersect({a_words}, {b_words}))"
    return F.expr(f"{both} > 0 and 5 * {both} >= 4 * (size({a_words}) + size({b_words}) - {both})")
