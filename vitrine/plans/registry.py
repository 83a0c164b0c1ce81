"""The registered queries: each operator over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.functions import text as X
from vitrine.functions.store import payment_label, sellable
from vitrine.operators import catalogue as C
from vitrine.operators import chatlog as M
from vitrine.operators import customers as K
from vitrine.operators import documents as D
from vitrine.operators import orders as O
from vitrine.operators import quality as Q
from vitrine.operators import router as R
from vitrine.operators import search as S
from vitrine.operators import suggest as G
from vitrine.plans import views as W
from vitrine.sources import files, sessions, sinks
from vitrine.sources.checkpoint import cut, scratch
from vitrine.sources.schemas import TABLES
from vitrine.sources.store import Store, parsed_specs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    """Register a query. Decimals come out as doubles, dates as ISO text, counts as longs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = build(spark, sf_dir)
        shown = []
        for field in df.schema.fields:
            kind = field.dataType.typeName()
            to = {"decimal": "double", "date": "string", "integer": "long"}.get(kind)
            shown.append(F.col(field.name).cast(to).alias(field.name) if to else F.col(field.name))
        return df.select(*shown)

    run.__name__ = build.__name__
    run.__doc__ = build.__doc__
    QUERIES[build.__name__] = run
    return build


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.store(spark, sf_dir).catalogue


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.store(spark, sf_dir).listing


_indexes: dict[tuple[str, str], S.SearchIndex] = {}


def _index(spark: SparkSession, sf_dir: str) -> S.SearchIndex:
    """The search index of the whole catalogue, written by the first search of an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        _indexes[key] = S.SearchIndex.build(_listing(spark, sf_dir))
    return _indexes[key]


def _store(spark: SparkSession, sf_dir: str) -> Store:
    return replace(W.store(spark, sf_dir), index=_index(spark, sf_dir))


def _flat_promo(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("promo_name", F.col("promo.name"))
        .withColumn("discount_percent", F.col("promo.discount_percent"))
        .withColumn("promo_price_brl", F.col("promo.promo_price_brl"))
        .drop("promo")
    )


# ---- catalogue ------------------------------------------------------------------------------------


@query
def catalogue_effective_price(spark, sf_dir):
    """Every sellable product with its best promotion and effective price."""
    offered = _catalogue(spark, sf_dir).where(sellable(F.col("status")))
    return _flat_promo(offered).select(
        "category", "product_id", "name", "price_brl", "promo_name", "discount_percent",
        "promo_price_brl", "effective_price", "stock_quantity", "status",
    )


@query
def best_promo(spark, sf_dir):
    return C.best_promo(W.promotions(spark, sf_dir))


@query
def active_promotions(spark, sf_dir):
    """Largest discount first: ``seq`` is the place."""
    return C.ranked_promotions(W.store(spark, sf_dir).active_promotions)


@query
def category_counts(spark, sf_dir):
    return C.category_counts(W.products(spark, sf_dir), W.categories(spark, sf_dir))


@query
def catalogue_index(spark, sf_dir):
    return _flat_promo(C.catalogue_index(_catalogue(spark, sf_dir)))


@query
def search_price_band(spark, sf_dir):
    found = S.search_products(
        _catalogue(spark, sf_dir), max_price=950, min_price="905.5", in_stock_only=True, limit=50
    )
    return found.select("product_id", "name", "price_brl", "stock_quantity", "effective_price")


@query
def search_by_category(spark, sf_dir):
    page = S.category_page(_catalogue(spark, sf_dir), "ECONÔM")
    return page.select("product_id", "name", "category", "price_brl", "matched", "returned")


# ---- search ---------------------------------------------------------------------------------------


@query
def text_fold(spark, sf_dir):
    return W.table(spark, sf_dir, "documents").select("doc_id", X.fold(F.col("text")).alias("folded"))


@query
def query_terms(spark, sf_dir):
    return S.terms_table(W.search_requests(spark, sf_dir))


@query
def search_index_stats(spark, sf_dir):
    return S.index_stats(_listing(spark, sf_dir))


@query
def search_batch(spark, sf_dir):
    hits = S.search_batch(W.search_requests(spark, sf_dir), _index(spark, sf_dir))
    return _flat_promo(S.with_products(hits, _catalogue(spark, sf_dir)))


@query
def search_stem_widened(spark, sf_dir):
    return S.search_batch(W.search_requests(spark, sf_dir), _index(spark, sf_dir), stems=True)


@query
def search_detail_level(spark, sf_dir):
    requests, catalogue = W.search_requests(spark, sf_dir), _listing(spark, sf_dir)
    hits = S.detail_level(requests, S.search_batch(requests, _index(spark, sf_dir)), catalogue)
    return hits.select(
        "request_id", "product_id", "rank", "covers", "n_hits", "n_covering", "full", "partial",
        F.when(F.col("full"), F.col("description")).alias("description"),
        F.when(F.col("full"), F.col("specs_raw")).alias("specs"),
    )


@query
def search_no_hit_advice(spark, sf_dir):
    requests, catalogue = W.search_requests(spark, sf_dir), _listing(spark, sf_dir)
    hits = S.search_batch(requests, _index(spark, sf_dir))
    return S.advice(requests, S.detail_level(requests, hits, catalogue))


@query
def promos_by_keyword(spark, sf_dir):
    terms = S.promo_terms(W.search_requests(spark, sf_dir))
    used = terms.groupBy("term").agg(F.count("*").alias("requests"))
    lists = S.promo_lists(used, W.store(spark, sf_dir).active_promotions)
    return lists.select(
        "term", "requests", "promotion_id", "product", "promo_name", "original_price_brl", "discount_percent",
        "promo_price_brl",
    )


def _missed(spark, sf_dir):
    requests, catalogue = W.search_requests(spark, sf_dir), _listing(spark, sf_dir)
    return cut(S.missed(requests, S.search_batch(requests, _index(spark, sf_dir)))), catalogue


@query
def suggest_names(spark, sf_dir):
    return G.suggest_names(*_missed(spark, sf_dir))


@query
def suggest_names_lev(spark, sf_dir):
    return G.suggest_names_lev(*_missed(spark, sf_dir))


@query
def product_first_match(spark, sf_dir):
    requests = W.search_requests(spark, sf_dir).select(
        "request_id",
        F.when(F.col("request_id") % 3 == 0, F.col("request_id")).alias("product_id"),
        F.col("query").alias("name"),
    )
    return S.first_match(requests, _listing(spark, sf_dir))


# ---- customers and orders -------------------------------------------------------------------------


@query
def customers_masked(spark, sf_dir):
    return K.masked(W.customers(spark, sf_dir), compat=True)


@query
def customers_masked_whole(spark, sf_dir):
    """Short phones are hidden whole; every fourth customer has one."""
    short = F.when(F.col("customer_id") % 4 == 0, F.right("phone", F.lit(8))).otherwise(F.col("phone"))
    return K.masked(W.customers(spark, sf_dir).withColumn("phone", short))


@query
def customer_lookup_cascade(spark, sf_dir):
    return K.lookup(W.customer_requests(spark, sf_dir), W.customers(spark, sf_dir), compat=True)


@query
def customer_orders(spark, sf_dir):
    store = W.store(spark, sf_dir)
    found = K.lookup(W.customer_requests(spark, sf_dir), store.customers, compat=True)
    return K.customer_orders(found, store.customers, store.orders, compat=True).select(
        "request_id", "customer_id", "name", "city", "phone", "email", "order_id", "order_date", "status", "total_brl"
    )


@query
def payment_labels(spark, sf_dir):
    return W.orders(spark, sf_dir).select(
        "order_id", "payment_method", payment_label(F.col("payment_method")).alias("label")
    )


@query
def order_deadlines(spark, sf_dir):
    return O.with_deadlines(W.orders(spark, sf_dir), W.AS_OF).select(
        "order_id", "status", "deadlines.*", "deadlines_note"
    )


@query
def order_lookup_batch(spark, sf_dir):
    store = W.store(spark, sf_dir)
    orders = O.with_deadlines(O.orders_of(store.orders, store.customers), W.AS_OF)
    return O.lookup(W.order_requests(spark, sf_dir), orders).select(
        "request_id", "key", "seq", "order_id", "customer_name", "order_date", "status", "total_brl", "payment_label",
        "tracking_code", "deadlines.caminho_sugerido", "deadlines_note",
    )


@query
def orders_with_items(spark, sf_dir):
    store = W.store(spark, sf_dir)
    lines = O.order_lines(store.orders.select("order_id", "customer_id"), store.order_items, store.products)
    return lines.select("order_id", "customer_id", "product_id", "product", "quantity", "price_brl")


@query
def order_payload_json(spark, sf_dir):
    store = W.store(spark, sf_dir)
    return O.whole_payloads(store.orders, store.customers, store.order_items, store.products, W.AS_OF)


@query
def order_item_lines(spark, sf_dir):
    """Numbered lines of every order; the first line of each order is moved to one very large order."""
    return O.item_lines(W.items_with_large_order(spark, sf_dir), W.products(spark, sf_dir))


@query
def order_item_blocks(spark, sf_dir):
    """The same lines nested in blocks of 1,000."""
    lines = O.item_lines(W.items_with_large_order(spark, sf_dir), W.products(spark, sf_dir))
    return O.item_blocks(lines).withColumn("n", F.size("items")).withColumn("items", F.to_json("items"))


# ---- documents ------------------------------------------------------------------------------------


@query
def doc_lines(spark, sf_dir):
    return D.doc_lines(W.documents(spark, sf_dir))


@query
def doc_sections(spark, sf_dir):
    return D.doc_sections(W.documents(spark, sf_dir))


@query
def doc_chunks(spark, sf_dir):
    return D.doc_chunks(W.documents(spark, sf_dir))


@query
def sections_rejoined(spark, sf_dir):
    return D.rejoin_sections(cut(D.doc_chunks(W.documents(spark, sf_dir)), "chunks"))


def _sections(spark, sf_dir):
    """The section table, written once as retrieval reads it several times."""
    return cut(D.doc_sections(W.documents(spark, sf_dir)), "sections")


def _asked_sections(spark, sf_dir):
    asked = W.section_requests(spark, sf_dir).select(
        "doc_id", F.coalesce(D.section_key(F.col("section")), F.lit("")).alias("key")
    )
    return asked, _sections(spark, sf_dir)


@query
def sections_by_number(spark, sf_dir):
    return D.by_number(*_asked_sections(spark, sf_dir))


@query
def sections_by_keyword(spark, sf_dir):
    return D.by_keyword(*_asked_sections(spark, sf_dir))


@query
def sections_miss_fallback(spark, sf_dir):
    return D.retrieve(W.section_requests(spark, sf_dir), _sections(spark, sf_dir))


# ---- conversations --------------------------------------------------------------------------------


@query
def history_last_n(spark, sf_dir):
    return M.last_n(W.messages(spark, sf_dir), 3)


def _failed_sessions(spark, sf_dir):
    """Sessions with an error event."""
    return W.table(spark, sf_dir, "events").where("event_type = 'error'").select(
        "user_id", F.concat(F.lit("s"), "user_id").alias("session_id")
    )


def _replayed_sessions(spark, sf_dir):
    """Sessions with an error event, but for every third: some sessions stay, some go."""
    return _failed_sessions(spark, sf_dir).where("user_id % 3 > 0").select("session_id")


@query
def sessions_upsert(spark, sf_dir):
    """Every session with an error event is known already."""
    return M.new_sessions(_failed_sessions(spark, sf_dir), W.messages(spark, sf_dir))


@query
def session_reset(spark, sf_dir):
    return M.reset(W.messages(spark, sf_dir), _replayed_sessions(spark, sf_dir))


def _merged_log(spark, sf_dir):
    """The log merged in two changes: the second repeats a turn and resets every third session up to turn 4."""
    log = W.messages(spark, sf_dir).withColumn("created_at", F.timestamp_seconds("message_id"))
    reset = F.pmod(F.substring("session_id", 2, 20).cast("long"), F.lit(3)) == 0
    resets = log.where(reset).select("session_id").distinct().select(
        "session_id", F.lit(4).cast("long").alias("message_id"), F.lit("reset").alias("role"),
        F.lit(None).cast("string").alias("content"), F.lit(None).cast("timestamp").alias("created_at"),
    )
    base = scratch(spark, "session_log")
    sessions.merge(spark, base, log.where("message_id < 3"))
    sessions.merge(spark, base, log.where("message_id >= 2").unionByName(resets))
    return sessions.read(spark, base)


@query
def session_log(spark, sf_dir):
    return _merged_log(spark, sf_dir).messages.drop("created_at")


@query
def session_registry(spark, sf_dir):
    return _merged_log(spark, sf_dir).sessions.drop("created_at")


@query
def chunk_table(spark, sf_dir):
    """The chunk table after a second load in which every third document changed and every seventh is gone."""
    docs, base = W.documents(spark, sf_dir), scratch(spark, "chunk_table")
    sinks.replace_chunks(spark, base, docs.where("doc_id is not null"))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Novo. "), "text")).otherwise(F.col("text"))
    sinks.replace_chunks(spark, base, docs.where("doc_id % 7 > 0").withColumn("text", text))
    return sinks.read_chunks(spark, base)


@query
def transcript_render(spark, sf_dir):
    return M.render(W.long_messages(spark, sf_dir), "desk-1")


@query
def prompt_context(spark, sf_dir):
    context = M.prompt_context(W.long_messages(spark, sf_dir), "Atendimento. Hoje: {today}.", W.AS_OF)
    return context.select("session_id", F.to_json("context").alias("context"))


def _replies(spark, sf_dir):
    return W.messages(spark, sf_dir).where("role = 'assistant'").withColumn(
        "content", F.when(F.length("content") % 5 == 0, F.lit(" \n")).otherwise(F.col("content"))
    )


@query
def fallback_rate(spark, sf_dir):
    return M.fallback_rate(_replies(spark, sf_dir))


@query
def scenario_expand(spark, sf_dir):
    scenarios = W.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("s"), "doc_id").alias("session_id"), F.split("text", "\n").alias("messages")
    )
    return M.replay(W.messages(spark, sf_dir), scenarios)


@query
def pii_audit(spark, sf_dir):
    return M.pii_audit(W.spread(W.table(spark, sf_dir, "documents")), "text", "lang", "source")


# ---- routing --------------------------------------------------------------------------------------


@query
def route_queries(spark, sf_dir):
    store = W.store(spark, sf_dir)
    routed = R.route(W.route_requests(spark, sf_dir), store.customers, store.orders, compat=True)
    return routed.select("request_id", "q", "entity", "kind")


@query
def route_and_answer(spark, sf_dir):
    """Every answer written out, with the items of each order."""
    return R.answer(W.whole_route_requests(spark, sf_dir), _store(spark, sf_dir), W.AS_OF, compat=True, whole=True)


@query
def route_lists(spark, sf_dir):
    """Which customer list answers each routed request."""
    return R.routed_lists(W.route_requests(spark, sf_dir), W.store(spark, sf_dir), compat=True)[1]


@query
def list_answers(spark, sf_dir):
    """What each customer list answers, once however many requests name it."""
    store = W.store(spark, sf_dir)
    lists = R.routed_lists(W.route_requests(spark, sf_dir), store, compat=True)[2]
    return R.customer_answers(cut(lists, "lists"), store, W.AS_OF, compat=True)


@query
def context_load(spark, sf_dir):
    store, sections = W.store(spark, sf_dir), _sections(spark, sf_dir)
    return R.context_answers(W.context_requests(spark, sf_dir), store, sections)


@query
def tool_calls_batch(spark, sf_dir):
    return R.run_calls(W.tool_calls(spark, sf_dir), _store(spark, sf_dir), W.AS_OF, compat=True)


@query
def json_props(spark, sf_dir):
    events = W.table(spark, sf_dir, "events")
    raw = F.when(F.col("event_type") == "error", F.substr("props", F.lit(2))).otherwise(F.col("props"))
    parsed = parsed_specs(F.col("raw"))
    return events.withColumn("raw", raw).select(
        "event_id", F.try_variant_get(parsed, "$.k", "string").alias("k"), F.when(parsed.isNull(), F.col("raw")).alias("unparsed")
    )


# ---- ingest and quality ---------------------------------------------------------------------------


def _text_feed(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def _write_csv(df: DataFrame, path: str) -> str:
    _text_feed(df).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return path


@query
def ingest_trim_null(spark, sf_dir):
    padded = W.customers(spark, sf_dir).select(
        "customer_id",
        F.concat(F.lit("  "), "name", F.lit(' "x", y\n z \t')).alias("name"),
        F.when(F.col("customer_id") % 3 == 0, F.lit("   ")).otherwise(F.col("phone")).alias("phone"),
        F.when(F.col("customer_id") % 4 > 0, F.col("email")).alias("email"),
        F.col("city"),
    )
    return files.read_csv(spark, _write_csv(padded, scratch(spark, "ingest_trim_null")))


@query
def ingest_typed_cast(spark, sf_dir):
    feed = W.products(spark, sf_dir).select(
        "product_id",
        "name",
        F.when(F.col("product_id") % 9 == 0, F.lit("x1")).otherwise(F.col("category_id").cast("string")).alias("category_id"),
        F.when(F.col("product_id") % 7 == 0, F.lit("R$ 5")).otherwise(F.col("price_brl").cast("string")).alias("price_brl"),
        "description",
        F.when(F.col("product_id") % 8 > 0, F.col("stock_quantity")).alias("stock_quantity"),
        "status",
        F.col("specs_raw").alias("specs"),
        F.when(F.col("product_id") % 5 == 0, F.lit("2025-2-30")).otherwise(F.col("created_at").cast("string")).alias("created_at"),
    )
    path = _write_csv(feed, scratch(spark, "ingest_typed_cast"))
    raw = files.read_csv(spark, path)
    rows = files.typed(raw, TABLES["products"], strict=False)
    filled = files.typed(raw, TABLES["products"], strict=False, defaults=True)
    filled = filled.select("product_id", F.col("stock_quantity").alias("stock_filled"))
    rows = rows.withColumn("cast_errors", F.array_join("cast_errors", ",")).drop("description")
    return rows.join(filled, "product_id")


@query
def load_counts(spark, sf_dir):
    store = W.store(spark, sf_dir)
    target = scratch(spark, "load_counts")
    feeds = {}
    for name in TABLES:
        df = getattr(store, name)
        if name == "products":
            df = df.withColumnRenamed("specs_raw", "specs")
        if name == "promotions":
            df = df.withColumn("is_active", F.col("is_active").cast("int"))
        feeds[name] = _write_csv(df, f"{target}/feeds/{name}")
    counts = files.load_all(spark, feeds, f"{target}/tables", multi_line=False)
    chunks = D.doc_chunks(W.documents(spark, sf_dir))
    return counts.unionByName(files.table_counts({"policy_chunks": chunks}))


@query
def dq_constraint_audit(spark, sf_dir):
    store = W.store(spark, sf_dir)
    tables = {
        "categories": store.categories,
        "products": store.products.withColumn(
            "price_brl", F.when(F.col("stock_quantity") > 0, F.col("price_brl"))
        ).withColumn(
            "category_id",
            F.when(F.col("product_id") % 50 == 7, F.lit(99)).when(F.col("product_id") % 50 != 8, F.col("category_id")),
        ),
        "customers": store.customers,
        "orders": store.orders.withColumn(
            "customer_id", F.when(F.col("order_id") % 40 == 3, -F.col("order_id")).otherwise(F.col("customer_id"))
        ),
        "order_items": store.order_items.withColumn(
            "product_id", F.when(F.col("quantity") == 13, F.lit(-13)).otherwise(F.col("product_id"))
        ),
        "promotions": store.promotions,
    }
    # The index lacks every thirtieth product and holds one that is none.
    entries = S.build_index(store.listing).where("product_id % 30 > 0")
    ghost = spark.range(1).select(F.lit("fantasma").alias("token"), F.lit(-1).cast("long").alias("product_id"))
    return Q.audit(tables, entries.unionByName(ghost))


@query
def dq_state_audit(spark, sf_dir):
    """The rules of chunks, sessions and messages, with repeated chunks, empty contents and messages without session."""
    log = W.messages(spark, sf_dir).withColumn("created_at", F.timestamp_seconds("message_id"))
    first = F.min(F.struct("message_id", "created_at")).alias("first")
    known = log.groupBy("session_id").agg(first).select(
        "session_id", F.col("first.message_id").alias("first_message_id"), "first.created_at"
    )
    chunks = D.doc_chunks(W.documents(spark, sf_dir))
    return Q.audit(
        {
            "policy_chunks": chunks.unionByName(chunks.where("doc_id % 10 = 0 and chunk_no = 1")),
            "sessions": known.where("cast(substring(session_id, 2) as long) % 4 > 0"),
            "messages": log.withColumn("content", F.when(F.col("message_id") > 1, F.col("content"))),
        }
    )
