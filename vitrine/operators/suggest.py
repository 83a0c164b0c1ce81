"""Similar product names for queries that found nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import values as V
from vitrine.functions.store import sellable
from vitrine.functions.text import strip, words_of
from vitrine.operators.matching import spread
from vitrine.operators.setjoin import similar_words
from vitrine.sources.checkpoint import merged

NAME_RATIO = 0.4
WORD_RATIO = 0.6


def _page_of_names(catalogue: DataFrame, page: int) -> DataFrame:
    """Distinct names among the ``page`` cheapest sellable products: at most ``page`` rows."""
    return (
        catalogue.where(sellable(F.col("status")))
        .orderBy("price_brl", "product_id")
        .limit(page)
        .select("name")
        .distinct()
    )


def _questions(missed: DataFrame) -> DataFrame:
    return spread(missed.select(F.lower(strip(F.col("query"))).alias("q")).distinct())


def suggest_names(
    missed: DataFrame, catalogue: DataFrame, floor: float = WORD_RATIO, shown: int = V.SUGGESTIONS_SHOWN
) -> DataFrame:
    """``(request_id, suggestions, score)``: up to ``shown`` names that have a word like one of the query's, in
    alphabetical order, and the best score among them.

    All sellable names count. A list of first names only needs the first names of each word, so a word that is in
    very many names costs no more than one that is in few.
    """
    names = catalogue.where(sellable(F.col("status"))).select("name").distinct()
    worded = names.select("name", F.explode(words_of(F.col("name"), 1)).alias("known"))
    first = worded.withColumn("_n", F.row_number().over(Window.partitionBy("known").orderBy("name")))
    first = first.where(F.col("_n") <= shown).drop("_n")
    asked = _questions(missed).select("q", F.explode(words_of(F.col("q"), 1)).alias("asked"))
    hits = asked.join(similar_words(asked, worded, floor), "asked").join(first, "known")
    scored = hits.groupBy("q", "name").agg(F.max("score").alias("score"))
    page = scored.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy("name"))).where(F.col("_n") <= shown)
    found = page.groupBy("q").agg(F.sort_array(F.collect_list("name")).alias("names"), F.max("score").alias("score"))
    return _per_request(missed, found, "score")


def suggest_names_lev(
    missed: DataFrame,
    catalogue: DataFrame,
    floor: float = NAME_RATIO,
    page: int = V.SUGGESTION_PAGE,
    shown: int = V.SUGGESTIONS_SHOWN,
) -> DataFrame:
    """As ``suggest_names`` with ``1 - edit distance / longer length`` on whole names, all in the JVM."""
    names = _page_of_names(catalogue, page).agg(F.sort_array(F.collect_set("name"))).scalar()
    close = F.filter(
        "_names",
        lambda n: 1 - F.levenshtein(F.col("q"), F.lower(n)) / F.greatest(F.length("q"), F.length(n)) > F.lit(floor),
    )
    scored = (
        _questions(missed)
        .withColumn("_names", names)
        .select("q", F.slice(close, 1, shown).alias("names"))
        .where(F.size("names") > 0)
    )
    return _per_request(missed, scored)


def _per_request(missed: DataFrame, scored: DataFrame, *more: str) -> DataFrame:
    return (
        merged(missed.select("request_id", F.lower(strip(F.col("query"))).alias("q")))
        .join(scored, "q")
        .select("request_id", F.array_join("names", ", ").alias("suggestions"), *more)
    )
