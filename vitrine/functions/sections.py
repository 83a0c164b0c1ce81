"""Document expressions: numbered sections and size-bounded pieces of one text.

A document is one row, so cutting it needs no shuffle: its lines, sections and pieces are arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions import values as V
from vitrine.functions.text import SPACE_CLASS, collapse_spaces, lines, strip

HEADING = f"^(\\p{{Nd}}+(?:\\.\\p{{Nd}}+)*)\\.?{SPACE_CLASS}+([^\\t-\\r\\x1c-\\x20].*)$"
NUMBER = "^(\\p{Nd}+(?:\\.\\p{Nd}+)*)"
SENTENCE_GAP = f"(?<=[.;:]){SPACE_CLASS}+"
TAG = "^\\[[^\\]]*\\]\\n?"


def content_lines(text: Column, running_header: str | None = None) -> Column:
    """Trimmed lines without blank ones, page footers and (when given) running headers."""

    def keep(line: Column) -> Column:
        wanted = (line != "") & ~F.rlike(line, F.lit(V.PAGE_FOOTER))
        return wanted if running_header is None else wanted & ~F.rlike(line, F.lit(running_header))

    return F.filter(F.transform(lines(text), strip), keep)


def is_heading(line: Column) -> Column:
    """A number and a title of at most 90 characters that does not end like a sentence."""
    title = F.regexp_extract(line, HEADING, 2)
    return (title != "") & (F.length(title) <= V.MAX_TITLE_CHARS) & ~F.rlike(title, F.lit("[.,;:]$"))


def heading_title(line: Column) -> Column:
    return F.concat(F.regexp_extract(line, HEADING, 1), F.lit(". "), strip(F.regexp_extract(line, HEADING, 2)))


def section_number(title: Column) -> Column:
    return F.regexp_extract(title, NUMBER, 1)


def number_and_ancestors(number: Column) -> Column:
    """``4.2.1`` -> ``4``, ``4.2``, ``4.2.1``."""
    parts = F.split(number, "\\.")
    return F.transform(parts, lambda p, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "."))


def cut_sections(content: Column, heads: Column) -> Column:
    """Array of (section, body) from content lines and the 0-based positions of the headings.

    Lines before the first heading form the cover section. Sections without a body drop out.
    """
    opens = F.concat(F.array(F.lit(-1)), heads)
    ends = F.concat(heads, F.array(F.size(content)))
    cut = F.zip_with(
        opens,
        ends,
        lambda a, b: F.struct(
            F.when(a < 0, F.lit(V.COVER_SECTION)).otherwise(heading_title(F.get(content, a))).alias("section"),
            F.replace(
                collapse_spaces(F.array_join(F.slice(content, a + 2, b - a - 1), " ")), F.lit("—"), F.lit("-")
            ).alias("body"),
        ),
    )
    return F.filter(cut, lambda s: s["body"] != "")


def pack(text: Column, limit: int = V.MAX_CHUNK_CHARS) -> Column:
    """Split a text into pieces of at most ``limit`` characters, at sentence ends, filling each in turn.

    A sentence longer than the limit stays whole.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, sentence: Column) -> Column:
        full = (state["open"] != "") & (F.length(state["open"]) + F.length(sentence) + 1 > limit)
        joined = F.when(state["open"] == "", sentence).otherwise(F.concat(state["open"], F.lit(" "), sentence))
        return F.struct(
            F.when(full, F.array_append(state["done"], state["open"])).otherwise(state["done"]).alias("done"),
            F.when(full, sentence).otherwise(joined).alias("open"),
        )

    packed = F.aggregate(
        F.split(text, SENTENCE_GAP),
        start,
        add,
        lambda s: F.when(s["open"] != "", F.array_append(s["done"], s["open"])).otherwise(s["done"]),
    )
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(packed)


def add_tag(tag: str, section: Column, text: Column) -> Column:
    shown = F.when(section == V.COVER_SECTION, V.COVER_TAG).otherwise(section)
    return F.concat(F.lit(f"[{tag} - "), shown, F.lit("]\n"), text)


def drop_tag(text: Column) -> Column:
    return F.regexp_replace(text, TAG, "")
