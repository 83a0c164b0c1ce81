"""Text expressions: folding, tokens, masks, whitespace."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python counts as white space.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
LINE_BREAK = "\\r\\n|[\\n-\\r\\x1c-\\x1e\\x85\\u2028\\u2029]"
STEM_LENGTH = 6


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Lower-case letters of any script with the one letter each decomposes to; combining marks have no target."""
    source, target, marks = [], [], []
    for char in map(chr, range(0x80, sys.maxunicode + 1)):
        if unicodedata.combining(char):
            marks.append(char)
        elif unicodedata.decomposition(char) and char == char.lower():
            base = "".join(c for c in unicodedata.normalize("NFD", char) if not unicodedata.combining(c))
            if len(base) == 1 and base != char:
                source.append(char)
                target.append(base)
    return "".join(source + marks), "".join(target)


def fold(text: Column) -> Column:
    """Lower case without accents. ``translate`` deletes characters without a target."""
    source, target = _fold_table()
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), source, target)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def collapse_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, SPACE_CLASS + "+", " "))


def lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def index_tokens(text: Column) -> Column:
    """Folded letter/digit runs: the words of the search index."""
    return F.regexp_extract_all(fold(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def query_terms(query: Column, stems: bool = False, most: int | None = None) -> Column:
    """Distinct search terms of a query, in order; with ``most`` only its first words count.

    With ``stems`` a word longer than six letters also searches for its first six.
    """
    words = index_tokens(query)
    if most is not None:
        words = F.slice(words, 1, most)
    if stems:
        words = F.flatten(
            F.transform(
                words,
                lambda w: F.when(F.length(w) > STEM_LENGTH, F.array(w, F.left(w, F.lit(STEM_LENGTH)))).otherwise(
                    F.array(w)
                ),
            )
        )
    return F.array_distinct(words)


def words_of(text: Column, min_length: int) -> Column:
    """Distinct folded words (underscore included) of at least ``min_length`` characters."""
    found = F.regexp_extract_all(fold(text), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: F.length(w) >= min_length))


def digits(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", "")


def mask_email(email: Column) -> Column:
    """Keep two characters of the mailbox and the domain; text without ``@`` is left alone."""
    at = F.instr(email, "@")
    user = F.left(email, at - 1)
    stars = F.repeat(F.lit("*"), F.greatest(F.length(user) - 2, F.lit(1)))
    masked = F.concat(F.left(user, F.lit(2)), stars, F.lit("@"), F.substr(email, at + 1))
    return F.when(at > 0, masked).otherwise(email)


def mask_phone(phone: Column, compat: bool = False) -> Column:
    """First and last four characters stay. ``compat=False`` also hides numbers of eight or fewer."""
    size = F.length(phone)
    masked = F.concat(
        F.left(phone, F.lit(4)),
        F.repeat(F.lit("*"), F.greatest(size - 8, F.lit(0))),
        F.right(phone, F.lit(4)),
    )
    if not compat:
        masked = F.when(size <= 8, F.repeat(F.lit("*"), size)).otherwise(masked)
    return F.when(size == 0, phone).otherwise(masked)
