"""Catalogue: best promotion per product, effective prices, category counts, promotion lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions import values as V
from vitrine.functions.store import promo_price, sellable
from vitrine.operators.ranking import positions


def best_promo(promotions: DataFrame) -> DataFrame:
    """The largest active discount per product; ties go to the first description, then the lowest id.

    One ``min`` over a struct combines map-side, so a product with a third of all promotions sends
    one row per task.
    """
    ranked = F.min(F.struct((-F.col("discount_percent")).alias("d"), "description", "promotion_id"))
    return (
        promotions.where("is_active")
        .where("discount_percent is not null")
        .groupBy("product_id")
        .agg(ranked.alias("best"))
        .select(
            "product_id",
            (-F.col("best.d")).cast("decimal(5,2)").alias("discount_percent"),
            F.col("best.description").alias("promo_name"),
            F.col("best.promotion_id").alias("promotion_id"),
        )
    )


def listing(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Products with their category name: what a search reads.

    Products without a known category drop out; ``quality.audit`` reports them.
    """
    return products.join(categories.select("category_id", F.col("name").alias("category")), "category_id")


def build_catalogue(products: DataFrame, categories: DataFrame, promotions: DataFrame) -> DataFrame:
    """The listing with nested promo (NULL when there is none or it is 0 %) and effective price."""
    promo = F.when(
        F.coalesce(F.col("discount_percent"), F.lit(0)) != 0,
        F.struct(
            F.col("promo_name").alias("name"),
            "discount_percent",
            promo_price(F.col("price_brl"), F.col("discount_percent")).alias("promo_price_brl"),
        ),
    )
    return (
        listing(products, categories)
        .join(best_promo(promotions).drop("promotion_id"), "product_id", "left")
        .withColumn("promo", promo)
        .withColumn("effective_price", F.coalesce("promo.promo_price_brl", "price_brl"))
        .drop("discount_percent", "promo_name")
    )


def category_counts(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Active products per category, empty categories included; ``seq`` is the place by name.

    Counting before the join leaves one row per category to shuffle.
    """
    counts = products.where(F.col("status") == V.ACTIVE).groupBy("category_id").agg(F.count("*").alias("n"))
    counted = categories.join(counts, "category_id", "left").select(
        "category_id", "name", "description", F.coalesce("n", F.lit(0).cast("long")).alias("product_count")
    )
    return positions(counted, "seq", F.col("name"), F.col("category_id"))


def active_promotions(promotions: DataFrame, products: DataFrame) -> DataFrame:
    """Every active promotion with its product, whatever the product's status."""
    priced = products.select("product_id", F.col("name").alias("product"), "price_brl")
    return (
        promotions.where("is_active")
        .join(priced, "product_id")
        .select(
            "promotion_id",
            "product_id",
            "product",
            F.col("description").alias("promo_name"),
            F.col("price_brl").alias("original_price_brl"),
            "discount_percent",
            promo_price(F.col("price_brl"), F.col("discount_percent")).alias("promo_price_brl"),
        )
    )


def ranked_promotions(active: DataFrame) -> DataFrame:
    """Active promotions with their place ``seq``: largest discount first, NULL last."""
    ties = [F.col(c) for c in ("promotion_id", "product_id", "promo_name")]
    return positions(active, "seq", F.col("discount_percent").desc_nulls_last(), *ties)


def catalogue_index(catalogue: DataFrame, page: int | None = None) -> DataFrame:
    """All sellable products, or the cheapest ``page`` of them: name, category, price, promo."""
    index = catalogue.where(sellable(F.col("status")))
    if page is not None:
        index = index.orderBy("price_brl", "product_id").limit(page)
    return index.select("product_id", "name", "category", "price_brl", "promo")
