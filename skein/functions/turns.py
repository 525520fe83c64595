"""Turn-id parsers and small scalar functions, as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def turn_or_null(turn_id: Column) -> Column:
    """turn-12 -> 12; null unless the whole id is of that form."""
    return F.regexp_extract(turn_id, r"^turn-(\d+)$", 1).try_cast("bigint")


def turn_or_zero(turn_id: Column) -> Column:
    return F.coalesce(turn_or_null(turn_id), F.lit(0).cast("bigint"))


def first_digits_or_zero(text: Column) -> Column:
    """The first run of digits anywhere, else 0."""
    return F.coalesce(F.regexp_extract(text, r"(\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def turn_anywhere(text: Column) -> Column:
    return F.regexp_extract(text, r"turn-(\d+)", 1).try_cast("bigint")


def turn_band(turn: Column) -> Column:
    return F.when(turn <= 20, "1-20").when(turn <= 50, "21-50").when(turn <= 100, "51-100").otherwise("101+")


def token_estimate(text: Column) -> Column:
    """A third of the code points, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.char_length(text) / 3)).cast("bigint")


def needle(pattern: str) -> str:
    """The longest plain text that every match of the pattern holds; empty where alternatives at the top leave none.

    Groups, classes and characters that may be left out or repeated are no part of it.
    """
    flat = pattern
    while (inner := re.sub(r"\((?:\?:)?[^()]*\)[?*+]*", "\0", flat)) != flat:
        flat = inner
    flat = re.sub(r"\[[^\]]*\][?*+]*|\\.[?*+]*|.[?*]\??|\.", "\0", flat)
    return "" if "|" in flat else max(re.split("[^a-z ]+", flat), key=len)


def _may(folded: Column, pattern: str) -> Column:
    """Whether the plain part of a pattern is in the text: a byte search that spares most texts the pattern."""
    plain = needle(pattern)
    return folded.contains(plain) if plain else F.lit(True)


def has_word(folded: Column, pattern: str) -> Column:
    """Whether lower-cased text holds the pattern between word boundaries of any script."""
    return _may(folded, pattern) & folded.rlike(rf"(?U)\b(?:{pattern})\b")


def count_word(folded: Column, pattern: str) -> Column:
    return F.when(_may(folded, pattern), F.regexp_count(folded, F.lit(rf"(?U)\b(?:{pattern})\b"))).otherwise(0)


def first_word(folded: Column, pattern: str) -> Column:
    """The first match between word boundaries, else empty."""
    return F.when(_may(folded, pattern), F.regexp_extract(folded, rf"(?U)\b({pattern})\b", 1)).otherwise("")


def normal_name(name: Column) -> Column:
    """Lower-cased, without a leading article, runs of other characters than letters and digits as one space."""
    flat = F.trim(F.regexp_replace(F.lower(name), r"(?U)[^\p{L}\p{N}]+", " "))
    return F.regexp_replace(flat, r"^(the|an|a) ", "")


def estimated_day(turn: Column, anchor_turn: int = 1, anchor_day: int = 0, days_per_turn: float = 3.5) -> Column:
    """Days from an anchor, halves to even."""
    return (F.lit(anchor_day) + F.bround((turn - anchor_turn) * F.lit(days_per_turn))).cast("bigint")


def day_confidence(turn: Column, anchor_turn: int = 1) -> Column:
    d = F.abs(turn - anchor_turn)
    return F.when(d <= 10, 0.7).when(d <= 50, 0.5).when(d <= 150, 0.3).otherwise(0.2)
