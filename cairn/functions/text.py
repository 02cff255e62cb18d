"""Column expressions on text shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: a maximal run of Unicode letters and digits.
WORD = r"[\p{L}\p{N}]+"
#: A character other than white space, with the four ASCII separators counted as white space.
VISIBLE = r"[^\p{IsWhite_Space}\x1c-\x1f]"


def raw_words(text: Column) -> Column:
    """Array of the words of ``text`` as written; null for null."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return ~F.coalesce(F.regexp_like(text, F.lit(VISIBLE)), F.lit(False))


def tokens(text: Column, max_bytes: int = 40) -> Column:
    """Index terms of ``text``: its words, lower-cased, those of ``max_bytes`` bytes or more left out. Null gives an empty array.

    The text is lower-cased as a whole; the one letter whose lower case would split a word is folded beforehand.
    """
    folded = F.lower(F.replace(text, F.lit("İ"), F.lit("i")))
    words = F.regexp_extract_all(folded, F.lit(WORD), F.lit(0))
    return F.coalesce(F.filter(words, lambda w: F.octet_length(w) < max_bytes), F.array().cast("array<string>"))
