"""Similar words by shared letter pairs, as an equi-join on the rare parts of their pair sets.

Two sets of sizes a and b with a Dice score of at least ``floor`` share at least o = ceil(floor (a + b) / 2) pairs. In one
global order, rarest pair first, the first a - o + k pairs of one and the first b - o + k of the other then share at least
k. So each word lists, for every size b that the other side has, the combinations of k of its first a - o + k pairs, and
words that agree in none of them never meet. Larger k makes more keys and far fewer candidates; every k gives the same
result. Candidates are compared in full once, so a key may be a hash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.sources.checkpoint import cut

#: Most combinations of one word for one size of the other: beyond, fewer pairs are combined.
COMBINATIONS = 256
#: Known words from which one more pair is combined.
DEPTHS = (2_000, 20_000, 100_000)


def letter_pairs(word: Column) -> Column:
    """Distinct pairs of neighbouring letters, the word's ends counted as letters."""
    padded = F.concat(F.lit("_"), word, F.lit("_"))
    starts = F.sequence(F.lit(1), F.length(word) + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.substr(padded, i, F.lit(2))))


def dice(a: Column, b: Column) -> Column:
    """Twice the shared letter pairs of two words over the pairs of both."""
    left, right = letter_pairs(a), letter_pairs(b)
    return 2.0 * F.size(F.array_intersect(left, right)) / (F.size(left) + F.size(right))


def pair_counts(words: DataFrame, word: str) -> DataFrame:
    """``(pair, n)``: in how many of the distinct words a pair stands."""
    pairs = words.select(word).distinct().select(F.explode(letter_pairs(F.col(word))).alias("pair"))
    return pairs.groupBy("pair").agg(F.count("*").alias("n"))


def rarest_first(words: DataFrame, word: str, counts: DataFrame) -> DataFrame:
    """``(word, pairs, size)`` of the distinct words, their pairs in the global order. A list is as long as its word."""
    pairs = words.where(F.col(word).isNotNull()).select(word).distinct()
    pairs = pairs.select(word, F.explode(letter_pairs(F.col(word))).alias("pair")).join(counts, "pair", "left")
    ranked = F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pair")))
    listed = pairs.groupBy(word).agg(F.transform(ranked, lambda p: p["pair"]).alias("pairs"))
    return listed.withColumn("size", F.size("pairs"))


def needed(a: Column, b: Column, floor: float) -> Column:
    """Pairs that sets of these sizes must share."""
    return F.greatest(F.lit(1), F.ceil(floor / 2 * (a + b) - 1e-9).cast("int"))


def _combined(size: Column, k: int) -> Column:
    """Combinations of k of ``size`` things, as a double."""
    return reduce(lambda out, i: out * (size - F.lit(i)) / F.lit(i + 1), range(k), F.lit(1.0))


def together(a: Column, b: Column, floor: float, depth: int) -> Column:
    """How many pairs a key combines for these sizes: the same from either side."""
    o = needed(a, b, floor)
    out = F.lit(1)
    for k in range(2, depth + 1):
        fits = (o >= k) & (_combined(F.greatest(a, b) - o + k, k) <= COMBINATIONS)
        out = F.when(fits, F.lit(k)).otherwise(out)
    return out


def _choices(first: Column, k: int) -> Column:
    """Hashes of all combinations of k elements of an array, each in the array's order."""
    if k == 1:
        return F.transform(first, lambda p: F.xxhash64(p))

    def after(start: Column, left: int, held: list[Column]) -> Column:
        # The last ``left - 1`` places are for the elements that follow.
        last = F.size(first) - left
        places = F.when(start <= last, F.sequence(start, last)).otherwise(F.array().cast("array<int>"))
        if left == 1:
            return F.transform(places, lambda i: F.xxhash64(*held, F.get(first, i)))
        return F.flatten(F.transform(places, lambda i: after(i + 1, left - 1, [*held, F.get(first, i)])))

    return after(F.lit(0), k, [])


def keyed(words: DataFrame, word: str, sizes: Column, floor: float, depth: int, asked: bool) -> DataFrame:
    """``(key, word)``: the keys of each word for every size of the other side that the floor allows."""
    rows = words.withColumn("_sizes", sizes).select(word, "pairs", "size", F.explode("_sizes").alias("_other"))
    rows = rows.where(2.0 * F.least("size", "_other") >= floor * (F.col("size") + F.col("_other")) - 1e-9)
    o, k = needed(F.col("size"), F.col("_other"), floor), together(F.col("size"), F.col("_other"), floor, depth)
    rows = rows.withColumn("_k", k).withColumn("_first", F.slice("pairs", F.lit(1), F.col("size") - o + F.col("_k")))
    choices = F.when(F.col("_k") == 1, _choices(F.col("_first"), 1))
    for i in range(2, depth + 1):
        choices = choices.when(F.col("_k") == i, _choices(F.col("_first"), i))
    both = ("size", "_other") if asked else ("_other", "size")
    rows = rows.select(word, *both, "_k", F.explode(choices).alias("_choice"))
    return rows.select(F.xxhash64(*both, "_k", "_choice").alias("key"), word)


def candidates(asked: DataFrame, known: DataFrame, floor: float, depth: int | None = None) -> DataFrame:
    """``(asked, known)``: the distinct words of the columns ``asked`` and ``known`` that agree in a key."""
    counts = cut(pair_counts(known, "known"), "pairs")
    theirs = cut(rarest_first(known, "known", counts), "known")
    ours = cut(rarest_first(asked, "asked", counts), "asked")
    if depth is None:
        n = theirs.count()
        depth = 1 + sum(n >= size for size in DEPTHS)
    sizes = [side.agg(F.sort_array(F.collect_set("size"))).scalar() for side in (theirs, ours)]
    met = keyed(ours, "asked", sizes[0], floor, depth, asked=True).join(
        keyed(theirs, "known", sizes[1], floor, depth, asked=False), "key"
    )
    return met.select("asked", "known").distinct()


def similar_words(asked: DataFrame, known: DataFrame, floor: float, depth: int | None = None) -> DataFrame:
    """``(asked, known, score)`` of the words of the columns ``asked`` and ``known`` that score at least ``floor``."""
    met = candidates(asked, known, floor, depth)
    return met.withColumn("score", dice(F.col("asked"), F.col("known"))).where(F.col("score") >= floor)
