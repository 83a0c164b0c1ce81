"""Answers and payloads that hold every line, on small invented tables."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from vitrine.operators import orders as O
from vitrine.operators import router as R
from vitrine.operators import search as S
from vitrine.plans.registry import QUERIES

DAY = dt.date(2026, 1, 5)


@pytest.fixture(scope="module")
def tables(spark):
    orders = [
        (1, 7, DAY, "shipped", Decimal("10.00"), "pix", "TRK0000001BR", DAY, None),
        (2, 7, None, "delivered", Decimal("20.00"), None, None, DAY, "x"),
        (3, 8, DAY, "pending", Decimal("30.00"), "pix", None, None, None),
    ]
    kind = (
        "order_id long, customer_id long, order_date date, status string, total_brl decimal(12,2), payment_method string,"
        " tracking_code string, estimated_delivery date, notes string"
    )
    items = [(1, 1, 2), (1, 2, 1), (1, 2, 1), (1, 99, 5), *[(2, 1, n) for n in range(2500)]]
    return (
        spark.createDataFrame(orders, kind),
        spark.createDataFrame([(7, "Ana"), (8, "Bea")], "customer_id long, name string"),
        spark.createDataFrame(items, "order_id long, product_id long, quantity int"),
        spark.createDataFrame([(1, "Lua", Decimal("5.00")), (2, "Sol", Decimal("6.50"))], "product_id long, name string, price_brl decimal(12,2)"),
    )


def test_whole_payloads_hold_every_line(tables):
    pages = {}
    for r in O.whole_payloads(*tables, "2026-01-31").collect():
        pages.setdefault(r.order_id, []).append((r.page, r.pages, json.loads(r.payload)["items"]))
    assert set(pages) == {1, 2, 3}
    sun, moon = {"quantity": 1, "name": "Sol", "price_brl": 6.5}, {"quantity": 2, "name": "Lua", "price_brl": 5.0}
    assert pages[1] == [(0, 1, [sun, sun, moon])] and pages[3] == [(0, 1, [])]
    assert len(pages[2]) <= 3 and {n for _, n, _ in pages[2]} == {3}
    assert sorted(i["quantity"] for _, _, items in pages[2] for i in items) == list(range(2500))


def test_every_failed_session_is_known(spark, tmp_path):
    users = [(1, "error"), (3, "error"), (6, "error"), (6, "error"), (9, "view")]
    spark.createDataFrame(users, "user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    talks = [(i, turn, "user", "x") for i in (1, 3, 5, 6, 9) for turn in (1, 0)]
    kind = "conv_id long, turn long, role string, text string"
    spark.createDataFrame(talks, kind).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, QUERIES["sessions_upsert"](spark, str(tmp_path)).collect()))
    assert got == [("s5", 0), ("s9", 0)]


def test_lookup_numbers_repeated_and_nameless_orders(tables, spark):
    orders = tables[0].unionByName(tables[0].where("order_id = 2").withColumn("notes", F.lit("y"))).unionByName(
        tables[0].where("order_id = 3").withColumn("order_id", F.lit(None).cast("long")).withColumn("customer_id", F.lit(7).cast("long"))
    )
    asked = spark.createDataFrame(
        [(1, 2, None, None), (2, None, " trk0000001br", None), (3, None, None, 7), (4, None, None, 7), (5, None, None, None)],
        "request_id long, order_id long, tracking_code string, customer_id long",
    )
    got = {}
    for r in O.lookup(asked, orders).orderBy("seq").collect():
        got.setdefault(r.request_id, []).append((r.key, r.seq, r.order_id))
    assert got[1] == [("order_id", 1, 2), ("order_id", 2, 2)] and got[2] == [("tracking_code", 1, 1)]
    assert got[3] == got[4] == [("customer_id", i, o) for i, o in enumerate((None, 1, 2, 2), 1)]


def test_promotion_lists_bring_the_columns_of_their_terms(spark):
    promos = spark.createDataFrame([(1, "Red Bolt"), (2, "Bolt"), (3, None)], "promotion_id long, product string")
    terms = spark.createDataFrame([("bolt", 5), ("*", 2), ("rings", 9)], "term string, requests long")
    got = sorted((r.term, r.requests, r.promotion_id) for r in S.promo_lists(terms, promos).collect())
    assert got == [("*", 2, 1), ("*", 2, 2), ("*", 2, 3), ("bolt", 5, 1), ("bolt", 5, 2)]
    assert sorted(r.promotion_id for r in S.promo_lists(terms.where("term = 'bolt'"), promos).collect()) == [1, 2]


def test_written_promotions_are_the_union_of_the_lists(spark):
    promos = [(1, "Red Bolt"), (2, "Bolt"), (2, "Bolt"), (3, None), (4, "Rédbolts nut"), (5, "Ring")]
    rows = spark.createDataFrame(promos, "promotion_id long, product string")
    asked = [(1, "bolt REDB red_"), (1, "bolt REDB red_"), (2, "rings"), (3, "a b"), (4, None), (5, "ring nut bolt"), (None, "ring")]
    got = sorted(map(tuple, S.written_promotions(spark.createDataFrame(asked, "request_id long, query string"), rows).select("request_id", "promotion_id").collect()), key=repr)
    every, bolts = [1, 2, 2, 3, 4, 5], [1, 2, 2, 4]
    held = {1: bolts * 2, 3: every, 4: every, 5: [*bolts, 5], None: [5]}
    assert got == sorted([(k, p) for k, ps in held.items() for p in ps], key=repr)


def test_sides_that_grow_with_the_requests_are_not_broadcast(tables, spark):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    asked = spark.createDataFrame([(1, "sol"), (2, "zz")], "request_id long, query string")
    hits = spark.createDataFrame([(1, 1, 2)], "request_id long, rank long, product_id long")
    missed = S.missed(asked, hits)
    assert [r.request_id for r in missed.collect()] == [2] and "BroadcastHashJoin" not in plan(missed)
    orders = spark.createDataFrame([(1, 2, None, None)], "request_id long, order_id long, tracking_code string, customer_id long")
    found = O.lookup(orders, tables[0])
    assert [r.order_id for r in found.collect()] == [2]
    payloads = R._payloads(found, Shop(*tables), "2026-01-31")
    assert [json.loads(r.payload)["items"] for r in payloads.collect()] == [{"list": 2, "count": 2500}]
    ruled = R._with_rule(asked)
    settled = R._settle(ruled, asked.select("request_id"), tables[0], compat=False)
    assert settled.count() == 2 and "BroadcastHashJoin" not in plan(settled)


class Shop:
    def __init__(self, *tables):
        self.orders, self.customers, self.order_items, self.products = tables


def test_list_sizes_count_every_promotion_once(spark):
    promos = [(1, "Red Bolt"), (2, "Bolt"), (2, "Bolt"), (3, None), (4, "Ring")]
    rows = spark.createDataFrame(promos, "promotion_id long, product string")
    asked = spark.createDataFrame([(1, "bolt nuts"), (2, "a"), (3, "bolt")], "request_id long, query string")
    got = sorted((r.request_id, json.loads(r.payload)["list"], json.loads(r.payload)["count"]) for r in R.answer_promotions(asked, rows).collect())
    assert got == [(1, "bolt", 3), (2, "*", 5), (3, "bolt", 3)]


def test_routing_looks_up_unsure_texts_only(spark, monkeypatch):
    seen = []
    found = R.find_customers
    monkeypatch.setattr(R, "find_customers", lambda ruled, *rest: seen.append(ruled) or found(ruled, *rest))
    asked = spark.createDataFrame([(1, "#1", "pedidos"), (2, "Ana Lua", "auto"), (3, "a@b", "auto"), (4, "Zezinho", "auto")], "request_id long, query string, entity string")
    people = spark.createDataFrame([(7, "Ana Luar", "(67) 91234-5678", "a@b")], "customer_id long, name string, phone string, email string")
    orders = spark.createDataFrame([], "tracking_code string")
    got = {r.request_id: r.kind for r in R.route(asked, people, orders, compat=True).collect()}
    assert got == {1: "customer", 2: "customer", 3: "email", 4: "product"}
    assert sorted(r.request_id for r in seen[0].collect()) == [2, 4]


def test_list_places_equal_brute_force_with_repeated_rows(tables, spark):
    orders = tables[0].unionByName(tables[0].where("order_id = 1"))
    lists = spark.createDataFrame([(1, "9", 7), (1, "9", 8), (1, "9", 8), (3, "a", 8), (3, "b", 99), (1, "9", None)], "way int, key string, customer_id long")
    placed, ranked = R._placed_orders(lists, Holder(orders))
    got = sorted(map(tuple, R._list_refs(placed, ranked, ("way", "key")).collect()))
    assert got == sorted([(1, "9", 1, 1), (1, "9", 1, 2), (1, "9", 2, 3), (1, "9", 3, 4), (1, "9", 3, 5), (3, "a", 3, 1)])


class Holder:
    def __init__(self, orders):
        self.orders = orders
