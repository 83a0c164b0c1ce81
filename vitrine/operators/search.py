"""Product search for whole tables of requests.

``search_batch`` answers "cheapest k products matching any term, within the request's filters" without
ever pairing a request with a posting list. Per *stored list* (word, category, sold or not, in stock or not)
products are numbered by price, once for each version of the catalogue (``SearchIndex``). A question looks up
which lists its terms, category and flags mean and where its minimum price starts in each, and fetches the next
k numbers by equality. So a term found in a third of the catalogue and asked by a third of the requests
costs (lists of its words) x k, not postings x requests.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.functions import values as V
from vitrine.functions.store import sellable
from vitrine.functions.text import blank_to_null, fold, index_tokens, query_terms, words_of
from vitrine.operators.matching import asked_lengths, contains_pairs, prefixes
from vitrine.operators.ranking import positions
from vitrine.sources.checkpoint import cut, merged, scratch

LIST = ["term", "category_filter", "in_stock_only", "include_discontinued"]
STORED = ["token", "category_key", "sellable", "in_stock"]
# Prices are counted in blocks of 100.00, so no window ever holds more than 10,000 distinct prices.
PRICE_BLOCK = 100
ANY = "*"
#: Tasks that can share the promotions of one word, where they are written out for every request.
PROMO_SHARES = 16


def search_tokens() -> Column:
    """The indexed words of a catalogue row: name, description and category."""
    return F.array_distinct(index_tokens(F.concat_ws(" ", "name", "description", "category")))


def build_index(catalogue: DataFrame) -> DataFrame:
    """Inverted index ``(token, product_id)``."""
    return catalogue.select(F.explode(search_tokens()).alias("token"), "product_id")


def index_stats(catalogue: DataFrame) -> DataFrame:
    """Products per indexed word."""
    return build_index(catalogue).groupBy("token").agg(F.count("*").alias("n_products"))


@dataclass(frozen=True)
class SearchIndex:
    """The stored index of one version of the catalogue: written once, read by every search.

    A stored list is a word ('' for all products), a category (or any), and one of four disjoint classes: sold or not, in
    stock or not. ``postings`` numbers the products of each list by price, ``prices`` counts them per price,
    ``dictionary`` holds the words and ``categories`` the categories with their folded names.
    """

    postings: DataFrame
    prices: DataFrame
    dictionary: DataFrame
    categories: DataFrame

    @classmethod
    def build(cls, listing: DataFrame, path: str | None = None) -> SearchIndex:
        """Write the index of ``listing`` to ``path``, or beside the checkpoints."""
        spark = listing.sparkSession
        path = path or scratch(spark, "index")
        words = F.array_union(search_tokens(), F.array(F.lit("")))
        rows = listing.select(
            F.explode(words).alias("token"),
            "category",
            F.coalesce(sellable(F.col("status")), F.lit(False)).alias("sellable"),
            F.coalesce(F.col("stock_quantity") > 0, F.lit(False)).alias("in_stock"),
            "price_brl",
            "product_id",
        ).withColumn("category_key", F.explode(F.array(F.lit(ANY), F.col("category"))))
        placed = positions(rows.drop("category"), "number", F.col("price_brl"), F.col("product_id"), key=tuple(STORED))
        placed.select(*STORED, "number", "price_brl", "product_id").write.parquet(f"{path}/postings")
        postings = spark.read.parquet(f"{path}/postings")
        postings.groupBy(*STORED, "price_brl").agg(F.count("*").alias("n")).write.parquet(f"{path}/prices")
        tokens = postings.where("token != ''").select("token").distinct()
        tokens.write.parquet(f"{path}/dictionary")
        names = listing.select("category", fold(F.col("category")).alias("folded")).distinct()
        names.write.parquet(f"{path}/categories")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SearchIndex:
        return cls(*[spark.read.parquet(f"{path}/{name}") for name in ("postings", "prices", "dictionary", "categories")])


def terms_table(requests: DataFrame, stems: bool = False) -> DataFrame:
    """One row per (request, position, term)."""
    return requests.select("request_id", F.posexplode(query_terms(F.col("query"), stems)).alias("pos", "term"))


def _postings(catalogue: DataFrame, terms: DataFrame, *columns: str) -> DataFrame:
    """``(term, columns...)`` for each distinct product with a word that starts with the term ('' matches all)."""
    keys = prefixes(F.col("_tokens"), F.col("_lengths"))
    return (
        catalogue.withColumn("_tokens", search_tokens())
        .withColumn("_lengths", asked_lengths(terms, "term", F.col("term") != ""))
        .select(F.explode(F.array_union(keys, F.array(F.lit("")))).alias("term"), *columns)
    )


def normalise_requests(requests: DataFrame) -> DataFrame:
    """Fill optional columns and defaults. A negative limit is an error."""
    optional = {
        "query": "string",
        "category": "string",
        "max_price": "decimal(12,2)",
        "min_price": "decimal(12,2)",
        "in_stock_only": "boolean",
        "include_discontinued": "boolean",
        "limit": "int",
    }
    have = requests.columns
    columns = [(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in optional.items()]
    rest = [c for c in have if c not in optional]
    limit = F.coalesce("limit", F.lit(V.DEFAULT_LIMIT))
    return (
        requests.select(*rest, *columns)
        .withColumn("in_stock_only", F.coalesce("in_stock_only", F.lit(False)))
        .withColumn("include_discontinued", F.coalesce("include_discontinued", F.lit(False)))
        .withColumn("limit", F.when(limit < 0, F.raise_error(F.lit("limit must not be negative"))).otherwise(limit))
    )


def _with_spec(requests: DataFrame, stems: bool) -> DataFrame:
    """Attach the distinct question a request asks. Equal questions are answered once."""
    terms = F.array_sort(query_terms(F.col("query"), stems))
    parts = [
        F.when(F.size(terms) == 0, F.array(F.lit(""))).otherwise(terms).alias("terms"),
        F.coalesce(fold(F.nullif(F.col("category"), F.lit(""))), F.lit("")).alias("category_filter"),
        "min_price",
        "max_price",
        "in_stock_only",
        "include_discontinued",
        "limit",
    ]
    return requests.withColumn("_q", F.struct(*parts)).withColumn("spec", F.to_json("_q"))


def _asked_lists(index: SearchIndex, lists: DataFrame) -> DataFrame:
    """``(LIST..., STORED...)``: the stored lists that make up each asked list, disjoint but for products with several
    words of one prefix."""
    known = index.dictionary.withColumn("_lengths", asked_lengths(lists, "term", F.col("term") != ""))
    starts = known.select("token", F.explode(prefixes(F.array("token"), F.col("_lengths"))).alias("term"))
    tokens = starts.join(lists.select("term").distinct(), "term", "left_semi")
    everything = lists.where("term = ''").select("term").distinct().withColumn("token", F.lit(""))
    filters = lists.where("category_filter != ''").select("category_filter").distinct()
    named = contains_pairs(index.categories, ["category"], "folded", filters, "category_filter")
    keyed = (
        lists.where("category_filter = ''")
        .withColumn("category_key", F.lit(ANY))
        .unionByName(lists.join(named, "category_filter").withColumnRenamed("category", "category_key"))
    )
    yes, both = F.array(F.lit(True)), F.array(F.lit(True), F.lit(False))
    return (
        keyed.join(tokens.select("term", "token").unionByName(everything.select("term", "token")), "term")
        .withColumn("sellable", F.explode(F.when(F.col("include_discontinued"), both).otherwise(yes)))
        .withColumn("in_stock", F.explode(F.when(F.col("in_stock_only"), yes).otherwise(both)))
        .select(*LIST, *STORED)
    )


def _places(index: SearchIndex, starts: DataFrame) -> DataFrame:
    """``(STORED..., min_price, before, total)``: how many products of each stored list are cheaper than each asked
    minimum (NULL: none), and how many it has. Prices are added up by block of prices and within each block."""
    block = F.floor(F.col("price_brl") / PRICE_BLOCK)
    asked = starts.select(*STORED).distinct()
    marks = starts.where("min_price is not null").select(
        *STORED, F.col("min_price").alias("price_brl"), F.lit(0).cast("long").alias("n")
    )
    cells = index.prices.join(asked, STORED, "left_semi").select(*STORED, "price_brl", "n").unionByName(marks)
    cells = cells.groupBy(*STORED, "price_brl").agg(F.sum("n").alias("n")).withColumn("block", block)
    by_block = Window.partitionBy(*STORED).orderBy("block")
    blocks = (
        cells.groupBy(*STORED, "block")
        .agg(F.sum("n").alias("m"))
        .withColumn("block_before", F.sum("m").over(by_block) - F.col("m"))
        .withColumn("total", F.sum("m").over(Window.partitionBy(*STORED)))
        .drop("m")
    )
    by_price = Window.partitionBy(*STORED, "block").orderBy("price_brl")
    counted = (
        cells.withColumn("in_block", F.sum("n").over(by_price) - F.col("n"))
        .join(blocks, [*STORED, "block"])
        .select(*STORED, "price_brl", (F.col("block_before") + F.col("in_block")).alias("before"), "total")
    )
    counted = cut(counted, "price_counts")
    at_min = counted.withColumnRenamed("price_brl", "min_price").join(
        starts.where("min_price is not null"), [*STORED, "min_price"], "left_semi"
    )
    totals = counted.groupBy(*STORED).agg(F.max("total").alias("total"))
    none = F.lit(None).cast("decimal(12,2)")
    whole = totals.select(*STORED, none.alias("min_price"), F.lit(0).cast("long").alias("before"), "total")
    return at_min.select(*whole.columns).unionByName(whole)


def search_batch(requests: DataFrame, catalogue: DataFrame | SearchIndex, stems: bool = False) -> DataFrame:
    """Per request its ``limit`` cheapest matching products: ``(request_id, rank, product_id)``.

    ``requests``: request_id, query, and optionally category, max_price, min_price (on base prices),
    in_stock_only, include_discontinued, limit. A query without words asks for everything.
    ``catalogue`` is a stored index, or a table with the columns of ``catalogue.listing``, whose index is then written for
    this call; ``with_products`` adds the payload. The distinct questions and their lists are written once, as several
    steps read them.
    """
    index = catalogue if isinstance(catalogue, SearchIndex) else SearchIndex.build(catalogue)
    asked = _with_spec(normalise_requests(requests), stems)
    specs = cut(asked.select("spec", "_q.*").distinct(), "questions")
    seeks = specs.withColumn("term", F.explode("terms")).drop("terms")
    lists = cut(_asked_lists(index, seeks.select(*LIST).distinct()), "lists")
    starts = seeks.select(*LIST, "min_price").distinct().join(lists, LIST).select(*STORED, "min_price").distinct()
    places = _places(index, starts).withColumnRenamed("min_price", "_from")

    of_list = [F.col(f"s.{c}") == F.col(f"p.{c}") for c in STORED]
    fetches = (
        seeks.join(lists, LIST)
        .alias("s")
        .join(places.alias("p"), [*of_list, F.col("s.min_price").eqNullSafe(F.col("p._from"))])
        .select("s.*", "p.before", "p.total")
        .withColumn("first", F.col("before") + 1)
        .withColumn("last", F.least(F.col("first") + F.col("limit") - 1, F.col("total")))
        .where("first <= last")
        .withColumn("number", F.explode(F.sequence("first", "last")))
        .select("spec", *STORED, "number", "max_price", "limit")
    )
    cheapest = Window.partitionBy("spec").orderBy("price_brl", "product_id")
    answers = (
        fetches.join(index.postings, [*STORED, "number"])
        .where("max_price is null or price_brl <= max_price")
        .withColumn("rank", F.dense_rank().over(cheapest))
        .where(F.col("rank") <= F.col("limit"))
        .groupBy("spec", "rank")
        .agg(F.first("product_id").alias("product_id"))
    )
    return merged(asked.select("request_id", "spec")).join(answers, "spec").select("request_id", "rank", "product_id")


def with_products(hits: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Brief product columns for search hits."""
    brief = catalogue.select("product_id", "name", "category", "price_brl", "promo", "stock_quantity", "status")
    return hits.join(brief, "product_id")


def search_products(
    catalogue: DataFrame,
    query: str | None = None,
    category: str | None = None,
    max_price=None,
    min_price=None,
    in_stock_only: bool = False,
    include_discontinued: bool = False,
    limit: int = V.DEFAULT_LIMIT,
    stems: bool = False,
) -> DataFrame:
    """One question with literal filters: they reach the scan, and the page is a distributed top-k."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    found = catalogue
    if not include_discontinued:
        found = found.where(sellable(F.col("status")))
    if max_price is not None:
        found = found.where(F.col("price_brl") <= F.lit(str(max_price)).cast("decimal(12,2)"))
    if min_price is not None:
        found = found.where(F.col("price_brl") >= F.lit(str(min_price)).cast("decimal(12,2)"))
    if in_stock_only:
        found = found.where("stock_quantity > 0")
    if category:
        found = found.where(F.contains(fold(F.col("category")), fold(F.lit(category))))
    if query:
        terms = query_terms(F.lit(query), stems)
        hit = F.exists(search_tokens(), lambda w: F.exists(terms, lambda t: F.startswith(w, t)))
        found = found.where((F.size(terms) == 0) | hit)
    return found.orderBy("price_brl", "product_id").limit(limit)


def category_page(catalogue: DataFrame, category: str, page: int | None = None) -> DataFrame:
    """A whole category, or its cheapest ``page`` products, with how many matched and how many are returned."""
    matching = catalogue.where(sellable(F.col("status"))).where(
        F.contains(fold(F.col("category")), fold(F.lit(category)))
    )
    rows = matching if page is None else search_products(catalogue, category=category, limit=page)
    matched = matching.agg(F.count("*")).scalar()
    returned = F.col("matched") if page is None else F.least(F.col("matched"), F.lit(page))
    return rows.withColumn("matched", matched).withColumn("returned", returned)


def first_match(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One product per request: its ``product_id`` if that exists, else the lowest id matching ``name``.

    The lowest id of a request is the lowest over its terms, so lists shrink to one row per term.
    """
    by_id = requests.where("product_id is not null").join(catalogue.select("product_id"), "product_id", "left_semi")
    terms = requests.where("name is not null").select(
        "request_id", F.explode(query_terms(F.col("name"))).alias("term")
    )
    lowest = (
        _postings(catalogue, terms, "product_id")
        .join(terms.select("term").distinct(), "term", "left_semi")
        .groupBy("term")
        .agg(F.min("product_id").alias("product_id"))
    )
    by_name = terms.join(lowest, "term").select("request_id", F.lit(2).alias("way"), "product_id")
    return (
        by_id.select("request_id", F.lit(1).alias("way"), "product_id")
        .unionByName(by_name)
        .groupBy("request_id")
        .agg(F.min(F.struct("way", "product_id"))["product_id"].alias("product_id"))
    )


def detail_level(requests: DataFrame, hits: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Hits with coverage: does the name hold every query word, which hit gets full detail, is advice due.

    A hit is shown in full when it is the only hit, or the only one whose name covers the query.
    """
    per_request = Window.partitionBy("request_id")
    words = requests.select("request_id", words_of(F.col("query"), 2).alias("qwords"))
    products = catalogue.select(
        "product_id", "name", "category", "price_brl", "stock_quantity", "status", "description", "specs_raw",
        *[c for c in catalogue.columns if c == "promo"],
    )
    covers = (F.size("qwords") > 0) & (F.size(F.array_except("qwords", words_of(F.col("name"), 2))) == 0)
    return (
        hits.join(merged(words), "request_id")
        .join(products, "product_id")
        .withColumn("covers", covers)
        .withColumn("n_hits", F.count("*").over(per_request))
        .withColumn("n_covering", F.sum(F.col("covers").cast("int")).over(per_request))
        .withColumn("full", (F.col("n_hits") == 1) | (F.col("covers") & (F.col("n_covering") == 1)))
        .withColumn("partial", (F.size("qwords") > 0) & (F.col("n_covering") == 0))
        .drop("qwords")
    )


def missed(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """Requests with a query that found nothing."""
    return requests.where(blank_to_null(F.col("query")).isNotNull()).join(
        merged(hits.select("request_id")), "request_id", "left_anti"
    )


def advice(requests: DataFrame, detailed: DataFrame) -> DataFrame:
    """The notice due per request: nothing found, or hits that do not cover the query."""
    partial = detailed.where("partial").select("request_id").distinct()
    return (
        missed(requests, detailed)
        .select("request_id", F.lit(V.ADVICE_NOTHING).alias("advice"))
        .unionByName(partial.select("request_id", F.lit(V.ADVICE_PARTIAL).alias("advice")))
    )


def promo_terms(requests: DataFrame) -> DataFrame:
    """The promotion lists a request refers to: one per word of four or more letters, or ``*`` for all."""
    words = words_of(F.col("query"), 4)
    return requests.select(
        "request_id", F.explode(F.when(F.size(words) > 0, words).otherwise(F.array(F.lit(ANY)))).alias("term")
    )


def promo_lists(terms: DataFrame, promotions: DataFrame) -> DataFrame:
    """``(term, promotion...)``: active promotions whose folded product name contains the term.

    A list is stored once however many requests refer to it; a request's promotions are the union of
    its lists. ``*`` lists every promotion. Other columns of ``terms``, which then has one row for each term, come along:
    they meet the product names that hold the term, so the lists themselves are not shuffled by term.
    """
    if terms.columns == ["term"]:
        terms = terms.distinct()
    names = promotions.select("product", fold(F.col("product")).alias("_folded")).distinct()
    words = terms.where(F.col("term") != ANY)
    named = contains_pairs(names, ["product"], "_folded", words, "term", phrases=False)
    keyed = promotions.join(named.join(words, "term"), "product")
    every = terms.where(F.col("term") == ANY).limit(1).select(F.struct(*terms.columns)).scalar()
    whole = promotions.withColumn("_every", every).where("_every is not null").select(*promotions.columns, "_every.*")
    return keyed.unionByName(whole)


def written_promotions(requests: DataFrame, promotions: DataFrame) -> DataFrame:
    """``(request_id, promotion...)``: the promotions of each request, written out: the union of its lists, each once.

    The lists, stored by term, meet the words of the requests last, and a promotion stays with the first of the words that
    its product's name holds. So what is written and shuffled grows with the lists and the requests, and only the rows that
    come out grow with both. A few words can make most of these, so each list is dealt into ``PROMO_SHARES``.
    """
    words = words_of(F.col("query"), 4)
    named = promotions.withColumn("_name", fold(F.col("product")))
    lists = promo_lists(promo_terms(requests).select("term"), named)
    lists = lists.withColumn("_share", F.pmod(F.xxhash64(*lists.columns), F.lit(PROMO_SHARES)).cast("int"))
    asked = requests.select("request_id", F.when(F.size(words) > 0, words).otherwise(F.array(F.lit(ANY))).alias("_words"))
    asked = asked.select("request_id", "_words", F.posexplode("_words").alias("_pos", "term"))
    asked = asked.select("request_id", "term", F.slice("_words", F.lit(1), F.col("_pos")).alias("_before"))
    asked = asked.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(PROMO_SHARES - 1))))
    earlier = F.exists("_before", lambda word: F.contains(F.col("_name"), word))
    met = lists.join(merged(asked), ["term", "_share"])
    return met.where((F.size("_before") == 0) | ~earlier).drop("term", "_share", "_name", "_before")
