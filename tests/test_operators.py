"""Operators against brute force on small tables, with hot keys and awkward rows."""

import datetime as dt
import json
import random
import re
import unicodedata
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from vitrine.functions import values as V
from vitrine.operators import catalogue as C
from vitrine.operators import chatlog as M
from vitrine.operators import customers as K
from vitrine.operators import documents as D
from vitrine.operators import orders as O
from vitrine.operators import quality as Q
from vitrine.operators import router as R
from vitrine.operators import search as S
from vitrine.operators.matching import contains_pairs
from vitrine.operators.ranking import positions
from vitrine.operators.suggest import suggest_names
from vitrine.sources.schemas import TABLES
from vitrine.sources.store import Store


def table(spark, name, rows):
    kinds = TABLES[name].columns
    return spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in kinds.items()))


def money(x):
    return Decimal(str(x)).quantize(Decimal("0.01"))


@pytest.fixture(scope="module")
def store(spark):
    categories = [(1, "Guitarras", "elétricas"), (2, "Violões", "acústicos"), (3, "Sopro", None)]
    products = [
        (1, "Solvanto LM45 Bruma", 2, money(1873), "violão de aço", 5, "active", '{"top": "cedro"}', dt.date(2021, 1, 1)),
        (2, "Prazela Lira NY", 2, money(388.5), "violão nylon", 15, "active", "sem json", None),
        (3, "Quorvel D18", 2, money(641.25), None, 0, "active", None, None),
        (4, "Belkaro Vento", 1, money(4720), "guitarra", 2, "coming_soon", None, None),
        (5, "Belkaro Antiga", 1, money(100), "fora de linha", 1, "discontinued", None, None),
        (6, "Órfão", 99, money(10), "sem categoria", 1, "active", None, None),
        (7, "Ukelê Infantil", 3, money(641.25), "parece um violão", 3, "active", None, None),
    ]
    customers = [
        (1, "Noa Prates", "(31) 97204-1586", "noa.p@example.com", "Aurora"),
        (2, "Ivo Salgado", "(48) 96613-7702", "ivo@example.com", "Aurora"),
        (3, "Noa Vidal", "(85) 2041-4400", None, "Belém"),
    ]
    orders = [
        (1, 1, dt.date(2024, 3, 6), "delivered", money(912.4), "pix", "BRKQ9081726BR", dt.date(2024, 3, 18), None),
        (8, 1, dt.date(2025, 12, 1), "shipped", money(50), "credit_3x", "brxw5566778br", None, "frágil"),
        (9, 2, None, "pending", money(1), None, None, None, None),
        (10, 77, dt.date(2025, 1, 1), "pending", money(1), None, None, None, None),
    ]
    items = [(1, 1, 2), (1, 3, 1), (1, 3, 1), (8, 2, 1), (8, 555, 1)]
    promotions = [
        (1, 1, money(10), "b", True),
        (2, 1, money(10), "a", True),
        (3, 1, money(50), "parada", False),
        (4, 4, money(0), "nada", True),
        (5, 2, money(20), "Semana", True),
    ]
    rows = dict(
        categories=categories, products=products, customers=customers, orders=orders, order_items=items, promotions=promotions
    )
    return Store(**{name: table(spark, name, r) for name, r in rows.items()})


def test_catalogue_promos(store):
    rows = {r.product_id: r for r in store.catalogue.collect()}
    assert 6 not in rows
    assert rows[1].promo.name == "a" and rows[1].promo.promo_price_brl == money(1685.7)
    assert rows[4].promo is None and rows[3].promo is None
    assert rows[2].effective_price == money(310.8)


def test_category_counts_keep_empty_and_count_active_only(store):
    got = {r.name: r.product_count for r in C.category_counts(store.products, store.categories).collect()}
    assert got == {"Guitarras": 0, "Violões": 3, "Sopro": 1}


def test_active_promotions_lists_all_active(store):
    assert sorted(r.promotion_id for r in store.active_promotions.collect()) == [1, 2, 4, 5]


def test_accent_free_search_and_description_match(store):
    found = [r.product_id for r in S.search_products(store.listing, "violao", max_price=1000, in_stock_only=True).collect()]
    assert found == [2, 7]


REQUEST = (
    "request_id long, query string, category string, max_price decimal(12,2), min_price decimal(12,2), "
    "in_stock_only boolean, include_discontinued boolean, limit int"
)


def fold(t):
    return "".join(c for c in unicodedata.normalize("NFD", (t or "").lower()) if not unicodedata.combining(c))


def words(t):
    return "".join(c if c.isalnum() else " " for c in fold(t)).split()


def brute_search(request, products):
    rid, query, category, top, low, stock, gone, limit = request
    terms = words(query)[:8]
    hits = []
    for pid, name, cat, price, text, have, status in products:
        tokens = words(f"{name} {text or ''} {cat}")
        if terms and not any(t.startswith(q) for t in tokens for q in terms):
            continue
        if not gone and status not in ("active", "coming_soon"):
            continue
        if stock and have <= 0 or category and fold(category) not in fold(cat):
            continue
        if top is not None and price > top or low is not None and price < low:
            continue
        hits.append((price, pid))
    return [(rid, i + 1, pid) for i, (_, pid) in enumerate(sorted(hits)[: 6 if limit is None else limit])]


def test_search_batch_equals_brute_force_with_hot_terms_and_prices(spark):
    rng = random.Random(7)
    names = ["violão", "violino", "baixo", "Baixo elétrico", "flauta doce"]
    cats = ["Cordas", "Sopro", "Cordas Orquestrais"]
    products = [
        (
            i,
            f"{rng.choice(names)} {rng.randint(1, 30)}",
            rng.choice(cats),
            money(rng.choice([50, 50, 50, 149.99, 150, 250.5, rng.randint(1, 400)])),
            rng.choice([None, "comum", "comum raro"]),
            rng.randint(0, 2),
            rng.choice(["active", "active", "coming_soon", "discontinued"]),
        )
        for i in range(300)
    ]
    catalogue = spark.createDataFrame(
        products,
        "product_id long, name string, category string, price_brl decimal(12,2), description string, "
        "stock_quantity int, status string",
    )
    queries = ["vio", "comum", "violão 1", "baixo raro", None, "", "nada", "VIOLINO_2", "c", "elétrico flauta doce 3"]
    requests = [
        (
            i,
            rng.choice(queries),
            rng.choice([None, None, "cord", "SOPRO", "xyz"]),
            rng.choice([None, money(150), money(60.5)]),
            rng.choice([None, money(50), money(149.99), money(100)]),
            rng.choice([True, False]),
            rng.choice([True, False]),
            rng.choice([None, 0, 1, 3, 500]),
        )
        for i in range(150)
    ]
    got = sorted(map(tuple, S.search_batch(spark.createDataFrame(requests, REQUEST), catalogue).collect()))
    assert got == sorted(row for r in requests for row in brute_search(r, products))


def test_negative_limit_is_an_error(spark, store):
    bad = spark.createDataFrame([(1, "x", None, None, None, False, False, -1)], REQUEST)
    with pytest.raises(Exception, match="negative"):
        S.search_batch(bad, store.listing).collect()


def test_first_match_prefers_id(spark, store):
    asked = spark.createDataFrame(
        [(1, 4, "quorvel"), (2, 404, "quorvel"), (3, None, "solvanto quorvel"), (4, None, "zzz")],
        "request_id long, product_id int, name string",
    )
    got = {r.request_id: r.product_id for r in S.first_match(asked, store.listing).collect()}
    assert got == {1: 4, 2: 3, 3: 1}


def test_contains_pairs_equals_brute_force(spark):
    rng = random.Random(3)
    hay = [(i, i % 3, "".join(rng.choice("ab c") for _ in range(rng.randint(0, 16)))) for i in range(200)]
    hay.append((999, 0, "x" * 700 + "needle" + "y" * 700))
    needles = {(rng.randint(0, 2), "".join(rng.choice("ab c") for _ in range(rng.randint(1, 5)))) for _ in range(90)}
    needles |= {(0, "xneedley"), (0, "x" * 300 + "ne"), (1, "needle")}
    needles = [n for n in needles if n[1].strip()]
    got = contains_pairs(
        spark.createDataFrame(hay, "id int, g int, t string"), ["id"], "t",
        spark.createDataFrame(needles, "g int, k string"), "k", scope=["g"],
    )
    assert sorted(map(tuple, got.collect())) == sorted((i, k) for i, g, t in hay for h, k in needles if g == h and k in t)


def test_customer_cascade(spark, store):
    asked = spark.createDataFrame(
        [
            (1, "97204-1586", None, None),
            (2, "0000-0000-1", "IVO@example.com", "noa"),
            (3, None, "none@example.com", "noa"),
            (4, "2041", None, None),
            (5, "15", None, "ivo"),
            (6, None, None, "ninguém"),
            (7, "", "", ""),
            (8, None, None, "noa v"),
        ],
        "request_id long, phone string, email string, name string",
    )

    def run(compat):
        got = {}
        for r in K.lookup(asked, store.customers, compat).collect():
            got.setdefault(r.request_id, set()).add(r.customer_id)
        return got

    assert run(True) == {1: {1}, 2: {2}, 3: {1, 3}, 4: {1, 3}, 5: {1}, 8: {3}}
    assert run(False)[5] == {2}


def test_order_lookup_key_order_and_case(spark, store):
    asked = spark.createDataFrame(
        [(1, 1, "x", 2), (2, None, " BRXW5566778br ", 2), (3, None, "", 1), (4, None, None, None), (5, 404, None, 1)],
        "request_id long, order_id int, tracking_code string, customer_id int",
    )
    got = sorted((r.request_id, r.order_id) for r in O.lookup(asked, store.orders).collect())
    assert got == [(1, 1), (2, 8), (3, 1), (3, 8)]


def test_order_payloads(store):
    rows = O.order_payloads(store.orders, store.customers, store.order_items, store.products, "2026-01-01").collect()
    payloads = {r.order_id: json.loads(r.payload) for r in rows}
    assert set(payloads) == {1, 8, 9}
    assert payloads[1]["items"] == {"list": 1, "count": 3}
    lines = O.item_lines(store.order_items, store.products)
    blocks = {r.order_id: r["items"] for r in O.item_blocks(lines).collect()}
    assert [(i.quantity, i.name) for i in blocks[1]] == [(1, "Quorvel D18"), (1, "Quorvel D18"), (2, "Solvanto LM45 Bruma")]
    assert payloads[1]["payment_method"] == "PIX" and payloads[1]["deadlines"]["arrependimento_7d_expirado"] is True
    assert "EXPIRADOS" in payloads[1]["deadlines"]["caminho_sugerido"]
    assert payloads[8]["deadlines"] is None and "recebimento" in payloads[8]["deadlines_note"]
    assert payloads[9]["items"] == {"list": 9, "count": 0} and payloads[9]["order_date"] is None


def test_an_order_of_many_lines_has_one_payload_and_numbered_lines(spark, store):
    known = [r.product_id for r in store.products.collect()]
    rows = [(1, known[i % len(known)], i % 3) for i in range(2300)] + [(1, known[0], 7)] * 200 + [(8, -1, 1)]
    items = spark.createDataFrame(rows, "order_id long, product_id long, quantity int")
    payloads = O.order_payloads(store.orders, store.customers, items, store.products, "2026-01-01").collect()
    assert sorted(r.order_id for r in payloads) == [1, 8, 9]
    assert {r.order_id: json.loads(r.payload)["items"]["count"] for r in payloads} == {1: 2500, 8: 0, 9: 0}
    lines = O.item_lines(items, store.products)
    got = sorted((r.line, r.quantity, r.product_id) for r in lines.collect())
    assert [line for line, _, _ in got] == list(range(1, 2501))
    assert sorted((1, p, q) for _, q, p in got) == sorted(rows[:-1])
    assert [q for _, q, _ in got] == sorted(q for _, _, q in rows[:-1])
    blocks = sorted(O.item_blocks(lines).collect(), key=lambda r: r.block)
    assert [(r.block, len(r["items"])) for r in blocks] == [(0, 1000), (1, 1000), (2, 500)]


def test_positions_equal_a_window_over_all_rows(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(40)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, v int, id int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for key in ((), ("k",)):
            order = (F.col("v").desc_nulls_last(), F.col("id"))
            got = {r.id: r.place for r in positions(df, "place", *order, key=key).collect()}
            groups = {}
            for k, v, i in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2])):
                groups.setdefault(k if key else None, []).append(i)
            assert got == {i: n for some in groups.values() for n, i in enumerate(some, 1)}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert positions(df.limit(0), "place", F.col("v")).count() == 0


def test_orders_of_a_request_come_newest_first_and_undated_last(spark):
    dates = ["2025-01-02", None, "2025-03-01", "2025-01-02"]
    orders = spark.createDataFrame([(i, 7, d, f"CODE{i}") for i, d in enumerate(dates)], "order_id long, customer_id long, d string, tracking_code string")
    orders = orders.withColumn("order_date", F.to_date("d"))
    asked = spark.createDataFrame([(r, None, None, 7) for r in range(3)] + [(9, 2, None, None), (10, None, " code3 ", 7)], "request_id long, order_id long, tracking_code string, customer_id long")
    got = {}
    for r in O.lookup(asked, orders).orderBy("seq").collect():
        got.setdefault(r.request_id, []).append((r.seq, r.order_id))
    assert got == {**{r: [(1, 2), (2, 0), (3, 3), (4, 1)] for r in range(3)}, 9: [(1, 2)], 10: [(1, 3)]}


def test_equal_requests_share_one_list(spark, store):
    name = store.customers.orderBy("customer_id").first().name
    asked = spark.createDataFrame([(i, name) for i in range(10_000)], "request_id long, query string")
    own, kept, lists = R.answer_lists(asked, store, "2026-01-01")
    assert kept.count() == 10_000 and kept.select("way", "key").distinct().count() == 1
    customers = lists.where("part = 'clientes'").count()
    assert customers == store.customers.where(F.lower("name").contains(name.lower())).count() and own.count() == 0
    whole = R.answer(asked, store, "2026-01-01")
    assert whole.count() == 10_000 * lists.count()
    assert whole.groupBy("request_id", "part", "seq").count().where("count > 1").isEmpty()


def test_searches_share_a_stored_index(spark, store, tmp_path):
    asked = spark.createDataFrame(
        [(1, "solvanto", None, None, True, 3), (2, "so", "guit", None, False, 4), (3, "", None, 900.0, False, 5),
         (4, "q", None, None, False, 50), (5, "nada", None, None, False, 6)],
        "request_id long, query string, category string, min_price double, in_stock_only boolean, limit int",
    )
    path = str(tmp_path / "index")
    indexed = store.indexed(path)
    before = sorted(tuple(r) for r in S.search_batch(asked, store.listing).collect())
    assert before and sorted(tuple(r) for r in S.search_batch(asked, indexed.searchable).collect()) == before
    # A second reader opens what the first has written.
    again = S.SearchIndex.open(spark, path)
    assert sorted(tuple(r) for r in S.search_batch(asked, again).collect()) == before
    lists = again.postings.groupBy(*S.STORED)
    counts = lists.agg(F.count("*").alias("n"), F.max("number").alias("most"), F.countDistinct("number").alias("numbers"))
    assert counts.where("n <> most or n <> numbers").isEmpty()


def test_suggestions_follow_the_similarity_rule(spark, store):
    names = sorted(r.name for r in store.listing.where("status != 'discontinued'").collect())
    queries = ["solvanta lm4", "quorvex", "belkar", "ukele", "zzzz", "ventto", "guitarra solvanto", "!!"]

    def pairs(w):
        return {f"_{w}_"[i : i + 2] for i in range(len(w) + 1)}

    def words(text):
        plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
        return re.findall(r"\w+", plain)

    def score(q, n):
        tries = [2 * len(pairs(a) & pairs(b)) / (len(pairs(a)) + len(pairs(b))) for a in words(q) for b in words(n)]
        return max(tries, default=0)

    expected = {}
    for i, q in enumerate(queries):
        page = [n for n in names if score(q, n) >= 0.6][:5]
        if page:
            expected[i] = (", ".join(page), max(score(q, n) for n in page))
    missed = spark.createDataFrame(list(enumerate(queries)), "request_id long, query string")
    got = {r.request_id: (r.suggestions, r.score) for r in suggest_names(missed, store.listing).collect()}
    assert got == expected and len(expected) >= 3


MANUAL = "\n".join(
    ["Manual da loja", "", "1. Sobre", "Loja — de música.", "Página 2", "4 Trocas", "4.1. Arrependimento", "Em 7 dias.",
     "4.2. Defeito", "Em 30 dias: troca. " + " ".join(f"Caso {i}." for i in range(300)), "40. Outro", "30 dias corridos.",
     "5. Vazia", "1. Sobre", "Endereço: rua A."]
)


@pytest.fixture(scope="module")
def sections(spark):
    return D.doc_sections(spark.createDataFrame([(1, MANUAL), (2, "só texto"), (3, None)], "doc_id long, text string")).cache()


def test_sections(sections):
    got = [(r.section, r.body[:20]) for r in sorted(sections.collect(), key=lambda r: r.section_no) if r.doc_id == 1]
    assert [s for s, _ in got] == ["Capa", "1. Sobre", "4.1. Arrependimento", "4.2. Defeito", "40. Outro", "1. Sobre"]
    assert got[1][1] == "Loja - de música."
    assert got[4][1] == "30 dias corridos."


def test_chunks_rejoin_to_sections(spark, sections):
    docs = spark.createDataFrame([(1, MANUAL), (2, "só texto")], "doc_id long, text string")
    chunks = D.doc_chunks(docs).collect()
    assert all(len(c.text.split("\n", 1)[1]) <= 1200 for c in chunks)
    assert [c.chunk_no for c in chunks if c.doc_id == 1] == list(range(1, len([c for c in chunks if c.doc_id == 1]) + 1))
    for block in (2, 1000):
        joined = D.rejoin_sections(D.doc_chunks(docs), block).collect()
        ours = sorted((r.doc_id, r.first_chunk, r.section, r.text.replace("\n", " ")) for r in joined)
        theirs = sorted((r.doc_id, r.section_no, r.section, r.body) for r in sections.collect())
        assert [(d, s, t) for d, _, s, t in ours] == [(d, s, t) for d, _, s, t in theirs]


def test_retrieve(spark, sections):
    asked = spark.createDataFrame(
        [(1, "4"), (1, "4."), (1, "xpto"), (1, "ENDERECO"), (1, None), (2, "9"), (1, "rua a")], "doc_id long, section string"
    )
    got = {}
    for r in D.retrieve(asked, sections).collect():
        got.setdefault((r.doc_id, r.key, r.found), set()).add(r.section)
    assert got[(1, "4", True)] == {"4.1. Arrependimento", "4.2. Defeito"}
    assert got[(1, "endereco", True)] == got[(1, "rua a", True)] == {"1. Sobre"}
    assert len(got[(1, "xpto", False)]) == 5 and len(got[(1, "", True)]) == 5
    assert got[(2, "9", False)] == {"Capa"}


def test_history_reset_and_transcript(spark):
    rows = [("a", i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(30)] + [("b", 5, "user", "oi")]
    log = spark.createDataFrame(rows, "session_id string, message_id long, role string, content string")
    kept = sorted((r.message_id, r.turn_no) for r in M.last_n(log).where("session_id = 'a'").collect())
    assert kept == [(i + 6, i + 1) for i in range(24)]
    text = {r.session_id: r.transcript for r in M.render(log, "m1").collect()}
    assert text["b"] == "model: m1\n\n**Cliente:** oi\n" and text["a"].count("**Agente:**") == 12
    context = {r.session_id: r.context for r in M.prompt_context(log, "Hoje {today}", "2026-01-02").collect()}
    assert context["b"][0].content == "Hoje 02/01/2026" and len(context["a"]) == 25
    left = M.reset(log, spark.createDataFrame([("a",)], "session_id string"))
    assert [r.session_id for r in left.collect()] == ["b"]


def test_fallback_reply(spark):
    replies = spark.createDataFrame([("a", " "), ("a", "ok"), ("b", None)], "session_id string, content string")
    got = {r.session_id: (r.replies, r.fallbacks) for r in M.fallback_rate(replies).collect()}
    assert got == {"a": (2, 1), "b": (1, 1)}
    assert "Pode tentar de novo" in M.with_fallback(replies).where("session_id = 'b'").first().content


def test_audit(store):
    names = ("categories", "products", "customers", "orders", "order_items", "promotions")
    got = {(r.table, r.rule): r.violations for r in Q.audit({n: getattr(store, n) for n in names}).collect() if r.violations}
    assert got == {
        ("products", "references(category_id)"): 1,
        ("orders", "references(customer_id)"): 1,
        ("order_items", "references(product_id)"): 1,
    }


ROUTES = [
    (1, "noa.p@example.com", "auto", "email"),
    (2, "(31) 97204-1586", "auto", "phone"),
    (3, "8", "auto", "order_id"),
    (4, "BRXW5566778br", "auto", "tracking"),
    (5, "noa prates", "auto", "customer"),
    (6, "violao", "auto", "product"),
    (7, "Rui", "auto", "product"),
    (8, "ivo", "clientes", "customer"),
    (9, "abcdefghijkl", "auto", "tracking"),
    (10, "quorvel", "produtos", "product"),
    (11, "prazela", "promocoes", "promotion"),
    (12, "", "auto", "product"),
    (13, "solvanta xz", "auto", "product"),
    (14, "ninguem", "clientes", "customer"),
    (15, "ivo salgado", "pedidos", "customer"),
]


def test_routes(spark, store):
    asked = spark.createDataFrame([r[:3] for r in ROUTES], "request_id long, query string, entity string")
    got = {r.request_id: r.kind for r in R.route(asked, store.customers, store.orders, compat=True).collect()}
    assert got == {r[0]: r[3] for r in ROUTES}
    fixed = {r.request_id: r.kind for r in R.route(asked, store.customers, store.orders, compat=False).collect()}
    assert fixed == {**got, 9: "product"}


def test_answers(spark, store):
    asked = spark.createDataFrame([r[:3] for r in ROUTES], "request_id long, query string, entity string")
    got = {}
    for r in R.answer(asked, store, "2026-01-01", compat=True).collect():
        got.setdefault(r.request_id, {}).setdefault(r.part, []).append((r.seq, r.payload))
    assert json.loads(got[1]["clientes"][0][1])["email"] == "no***@example.com"
    numbers = {i: [(s, json.loads(p)["order_id"]) for s, p in sorted(parts.get("pedidos", []))] for i, parts in got.items()}
    assert sorted(n for _, n in numbers[2]) == [1, 8] and [s for s, _ in numbers[2]] == [1, 2]
    assert numbers[3] == numbers[4] == [(1, 8)]
    assert [json.loads(p)["product_id"] for _, p in sorted(got[6]["produtos"])] == [2, 7, 1]
    assert got[6]["aviso"] == [(0, V.ADVICE_PARTIAL)]
    full = json.loads(got[10]["produtos"][0][1])
    assert full["name"] == "Quorvel D18" and "specs" in full and "aviso" not in got[10]
    assert json.loads(got[11]["promocoes"][0][1]) == {"list": "prazela", "count": 1}
    assert len(got[12]["produtos"]) == 5 and "promocoes" not in got[12]
    assert "Solvanto LM45 Bruma" in got[13]["aviso"][0][1]
    assert got[14]["aviso"] == [(0, V.ADVICE_NOTHING)]
    assert numbers[15] == [(1, 9)]


def test_whole_answers_write_the_promotions_out(spark, store):
    asked = spark.createDataFrame(
        [(1, "prazela lira", "promocoes"), (2, "", "promocoes"), (3, "solvanta vento prazela", "produtos"), (4, "xyzw", "promocoes")],
        "request_id long, query string, entity string",
    )
    got = {}
    for r in R.answer(asked, store, "2026-01-01", compat=True, whole=True).where("part = 'promocoes'").collect():
        got.setdefault(r.request_id, []).append((r.seq, json.loads(r.payload)))
    lira = {"product": "Prazela Lira NY", "promo_name": "Semana", "original_price_brl": 388.5, "discount_percent": 20.0, "promo_price_brl": 310.8}
    assert got[1] == [(1, lira)] and set(got) == {1, 2, 3}
    assert [(seq, p["product"], p["promo_name"]) for seq, p in sorted(got[2], key=lambda x: x[0])] == [
        (1, "Prazela Lira NY", "Semana"), (2, "Solvanto LM45 Bruma", "b"), (3, "Solvanto LM45 Bruma", "a"), (4, "Belkaro Vento", "nada"),
    ]
    assert sorted(seq for seq, _ in got[3]) == [1, 4]


def test_tool_calls_never_fail(spark, store):
    calls = spark.createDataFrame(
        [
            (1, "search_store", '{"query": "violao", "max_price": 600}', 1),
            (2, "nope", "{}", 1),
            (3, "search_store", '{"query": ', 1),
            (4, "search_store", '{"x": 1}', 1),
            (5, "load_context", "{}", 1),
            (6, "load_context", '{"source": "manual", "section": "4."}', 1),
            (7, "search_store", "[1]", 1),
            (8, "search_store", None, 1),
            (9, "search_store", '{"query": "violao", "limit": -1}', 1),
            (10, "search_store", '{"query": "violao", "max_price": "cheap"}', 1),
            (11, "search_store", '{"query": null}', 1),
        ],
        "call_id long, name string, arguments string, doc_id long",
    )
    got = {}
    for r in R.run_calls(calls, store, "2026-01-01").collect():
        got.setdefault(r.call_id, []).append((r.part, r.payload))
    assert all(json.loads(p)["price_brl"] <= 600 for part, p in got[1] if part == "produtos")
    assert got[2] == [("error", "ferramenta desconhecida: nope")]
    assert [got[i][0][0] for i in (3, 4, 5, 7, 9, 10)] == ["error"] * 6
    assert got[9] == [("error", "ValueError: limit must not be negative")]
    assert got[10] == [("error", "TypeError: not a valid value of argument max_price")]
    assert [part for part, _ in got[11]] == [part for part, _ in got[8]]
    assert json.loads(got[6][0][1]) == {"source": "manual", "doc_id": 1, "key": "4"}
    assert len([1 for part, _ in got[8] if part == "produtos"]) == 5


def test_context_answers(spark, store, sections):
    asked = spark.createDataFrame(
        [("manual", 1, "4"), ("manual", 1, "xpto"), ("catalogo", None, "viol"), ("catalogo", None, None),
         ("promocoes", None, None), ("outra", None, None), ("catalogo", None, "zzz")],
        "source string, doc_id long, section string",
    )
    got = {}
    for r in R.context_answers(asked, store, sections).collect():
        got.setdefault((r.source, r.key), {}).setdefault(r.part, []).append(r.payload)
    assert len(got[("manual", "4")]["secoes"]) == 2 and len(got[("manual", "xpto")]["secoes_disponiveis"]) == 6
    assert got[("catalogo", "viol")]["total"] == ["3"] and got[("catalogo", "zzz")] == {"total": ["0"]}
    assert len(got[("catalogo", "")]["produtos"]) == 5 and len(got[("catalogo", "")]["categorias"]) == 3
    assert len(got[("promocoes", "")]["promocoes"]) == 4
    assert got[("outra", "")]["error"] == ["fonte desconhecida: outra"]
