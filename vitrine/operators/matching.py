"""Prefix and substring matching as equi-joins.

A join on ``startswith``/``contains`` runs as a nested loop over both tables. Here the data side
lists the keys it could be asked for (its prefixes or substrings, only at lengths that some request
really uses) and joins the distinct requested strings by equality. The join emits true matches only,
so a string shared by a third of all rows costs its own matches and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.sources.checkpoint import cut


def spread(rows: DataFrame) -> DataFrame:
    """Few bytes but much work per row: keep all shuffle partitions instead of merging small ones."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *rows.columns)


def asked_lengths(needles: DataFrame, needle: str, when: Column | None = None) -> Column:
    """The distinct lengths of the requested strings: a scalar, bounded by the longest string."""
    size = F.length(needle)
    return needles.agg(F.sort_array(F.collect_set(size if when is None else F.when(when, size)))).scalar()


def prefixes(words: Column, lengths: Column) -> Column:
    """Distinct prefixes of an array of words, at the given lengths."""
    return F.array_distinct(
        F.flatten(
            F.transform(
                words,
                lambda w: F.transform(F.filter(lengths, lambda n: n <= F.length(w)), lambda n: F.left(w, n)),
            )
        )
    )


WINDOW = 256


def _windows(word: Column, longest: Column) -> Column:
    """A very long word as overlapping windows, so that cutting it stays linear; other words as they are.

    Each window holds 256 characters and the ``longest - 1`` that follow.
    """
    blocks = F.regexp_extract_all(word, F.lit(f"(?s).{{1,{WINDOW}}}"), F.lit(0))
    after = F.ceil(longest / WINDOW).cast("int")
    overlapping = F.transform(
        blocks,
        lambda b, i: F.concat(b, F.left(F.array_join(F.slice(blocks, i + 2, after), ""), longest - 1)),
    )
    return F.when(F.length(word) <= 2 * WINDOW, F.array(word)).otherwise(overlapping)


def _substrings(words: DataFrame, lengths: Column) -> DataFrame:
    """``(_word, _part)``: the substrings of each word at the given lengths.

    Plain row generators, so the whole step is generated code. It makes far more work than bytes, hence
    the fixed number of partitions.
    """
    pieces = spread(words.select("_word")).withColumn("_lengths", lengths)
    windows = F.explode(_windows(F.col("_word"), F.array_max("_lengths")))
    return (
        pieces.select("_word", "_lengths", windows.alias("_piece"))
        .select("_word", "_lengths", "_piece", F.explode(F.sequence(F.lit(1), F.length("_piece"))).alias("_at"))
        .select("_word", "_piece", "_at", F.explode("_lengths").alias("_size"))
        .where(F.col("_at") + F.col("_size") - 1 <= F.length("_piece"))
        .select("_word", F.substring(F.col("_piece"), F.col("_at"), F.col("_size")).alias("_part"))
    )


def _word_pairs(rows: DataFrame, ids: list[str], scope: list[str], parts: DataFrame) -> DataFrame:
    """``(ids..., scope..., _part)`` where a space-separated word of ``_text`` contains the part.

    Only the distinct words of the whole table are cut into substrings; rows then join on equal words.
    """
    keep = list(dict.fromkeys([*ids, *scope]))
    words = rows.select(*keep, F.explode(F.array_distinct(F.split("_text", " "))).alias("_word")).where("_word != ''")
    wanted = parts.select("_part").distinct()
    known = _substrings(words.select("_word").distinct(), asked_lengths(wanted, "_part")).join(wanted, "_part")
    pairs = words.join(known, "_word").select(*keep, "_part")
    if scope:
        pairs = pairs.join(parts, [*scope, "_part"], "left_semi")
    return pairs.distinct()


def _two_longest(parts: Column) -> Column:
    distinct = F.array_distinct(F.filter(parts, lambda w: w != ""))
    return F.slice(F.array_sort(distinct, lambda a, b: F.length(b) - F.length(a)), 1, 2)


def contains_pairs(
    haystack: DataFrame,
    ids: list[str],
    text: str,
    needles: DataFrame,
    needle: str,
    scope: list[str] | None = None,
    phrases: bool = True,
) -> DataFrame:
    """All ``(ids..., needle)`` where ``text`` contains ``needle`` (and the ``scope`` columns agree).

    A needle without a space lies inside one word, so its word matches are the answer. A phrase must
    match with its two longest parts; only rows holding the rarer of them are then compared with it.
    ``phrases=False`` is for needles that never hold a space. Empty needles match nothing.
    """
    scope = scope or []
    wanted = (
        needles.select(*scope, F.col(needle).alias("_needle"))
        .where("_needle is not null")
        .distinct()
        .withColumn("_parts", _two_longest(F.split("_needle", " ")))
    )
    rows = haystack.select(*list(dict.fromkeys([*ids, *scope])), F.col(text).alias("_text")).where("_text is not null")
    parts = wanted.select(*scope, F.explode("_parts").alias("_part")).distinct()
    pairs = _word_pairs(rows, ids, scope, parts)
    if phrases:
        pairs = cut(pairs, "matches")  # read three times below
    plain = wanted.where(~F.contains("_needle", F.lit(" "))).select(*scope, F.col("_needle").alias("_part"))
    found = pairs.join(plain, [*scope, "_part"], "left_semi").select(*ids, F.col("_part").alias(needle))
    if not phrases:
        return found

    spaced = wanted.where(F.contains("_needle", F.lit(" ")))
    sizes = pairs.groupBy(*scope, "_part").agg(F.count("*").alias("_rows"))
    rarest = (
        spaced.select(*scope, "_needle", F.size("_parts").alias("_n"), F.explode("_parts").alias("_part"))
        .join(sizes, [*scope, "_part"])
        .groupBy(*scope, "_needle", "_n")
        .agg(F.min(F.struct("_rows", "_part"))["_part"].alias("_part"), F.count("*").alias("_matched"))
        .where("_matched = _n")
        .select(*scope, "_needle", "_part")
    )
    phrase_hits = (
        pairs.join(rarest, [*scope, "_part"])
        .select(*list(dict.fromkeys([*ids, *scope])), "_needle")
        .join(rows, list(dict.fromkeys([*ids, *scope])))
        .where(F.contains("_text", F.col("_needle")))
        .select(*ids, F.col("_needle").alias(needle))
    )
    return found.unionByName(phrase_hits)
