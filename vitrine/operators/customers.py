"""Customer lookup by phone, e-mail or name; masked contact data; customers with their orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import digits, mask_email, mask_phone
from vitrine.operators.matching import contains_pairs
from vitrine.sources.checkpoint import cut, merged

PHONE, EMAIL, NAME = 1, 2, 3


def _ways(phone: Column, email: Column, name: Column, compat: bool) -> Column:
    """The lookups a request can use, in order of preference: array of (way, key)."""
    number = digits(phone)
    usable = F.length(number) >= (1 if compat else 4)
    ways = F.array(
        F.when(usable, F.struct(F.lit(PHONE).alias("way"), number.alias("key"))),
        F.when(F.coalesce(email, F.lit("")) != "", F.struct(F.lit(EMAIL).alias("way"), F.lower(email).alias("key"))),
        F.when(F.coalesce(name, F.lit("")) != "", F.struct(F.lit(NAME).alias("way"), F.lower(name).alias("key"))),
    )
    return F.filter(ways, lambda w: w.isNotNull())


def _matches(asked: DataFrame, customers: DataFrame) -> DataFrame:
    """``(way, key, customer_id)`` for the distinct keys of each way."""
    phones = customers.select("customer_id", digits(F.col("phone")).alias("text"))
    names = customers.select("customer_id", F.lower("name").alias("text"))
    emails = customers.select("customer_id", F.lower("email").alias("key"))
    keys = asked.select("way", "key").distinct()

    def of(way: int) -> DataFrame:
        return keys.where(F.col("way") == way).select("key")

    by_phone = contains_pairs(phones, ["customer_id"], "text", of(PHONE), "key", phrases=False)
    by_name = contains_pairs(names, ["customer_id"], "text", of(NAME), "key")
    by_email = emails.join(of(EMAIL), "key")
    parts = [(PHONE, by_phone), (EMAIL, by_email), (NAME, by_name)]
    out = [m.select(F.lit(way).alias("way"), "key", "customer_id") for way, m in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def lookup_lists(requests: DataFrame, customers: DataFrame, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """The answers in two tables: ``(request_id, way, key)`` names the list of each request that finds any customer, and
    ``(way, key, customer_id)`` holds each list once, however many requests ask for it.

    ``requests``: request_id, phone, email, name. Phone matches on contained digits, e-mail on equality,
    name on containment, all without regard to case. ``compat=False`` ignores phones of under 4 digits.
    The first way that finds any customer counts. Matching works on distinct keys; only the choice of the way happens per
    request (three rows each).
    """
    asked = requests.select(
        "request_id", F.inline(_ways(F.col("phone"), F.col("email"), F.col("name"), compat))
    )
    matches = cut(_matches(asked, customers), "lists")
    hits = matches.select("way", "key").distinct()
    chosen = (
        merged(asked).join(hits, ["way", "key"])
        .groupBy("request_id")
        .agg(F.min(F.struct("way", "key")).alias("best"))
        .select("request_id", "best.*")
    )
    return chosen, matches


def lookup(requests: DataFrame, customers: DataFrame, compat: bool = False) -> DataFrame:
    """``(request_id, way, customer_id)``: the lists of ``lookup_lists``, written out for every request."""
    chosen, matches = lookup_lists(requests, customers, compat)
    return chosen.join(matches, ["way", "key"]).select("request_id", "way", "customer_id")


def masked(customers: DataFrame, compat: bool = False) -> DataFrame:
    """Customers with phone and e-mail masked."""
    return customers.select(
        "customer_id",
        "name",
        "city",
        mask_phone(F.col("phone"), compat).alias("phone"),
        mask_email(F.col("email")).alias("email"),
    )


def customer_orders(found: DataFrame, customers: DataFrame, orders: DataFrame, compat: bool = False) -> DataFrame:
    """Found customers (masked) with each of their orders; a customer without orders keeps one row."""
    keyed = orders.select("customer_id", *[c for c in orders.columns if c not in ("customer_id", "customer_name")])
    return found.join(masked(customers, compat), "customer_id").join(keyed, "customer_id", "left")
