"""The store model on the driver's tables, and request tables that grow with them.

Every view is a projection (or one join/aggregate) of whole tables; ``BASE_SQL`` says the same for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.sources.store import Store

AS_OF = "1998-09-02"
EMPTY_CATEGORY = (7, "Sopro (Metais)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a table whose files give fewer tasks than that; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


CATEGORY_ID = "cast(array_position(array('ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'), p_type) as int)"
CATEGORY_NAME = "case p_type when 'ECONOMY' then 'Econômico' when 'PROMO' then 'Promoção' else p_type end"


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "part").select("p_type").distinct()
    empty = spark.range(1).select(*[F.lit(v).alias(c) for c, v in zip(("category_id", "name"), EMPTY_CATEGORY)])
    return (
        used.selectExpr(f"{CATEGORY_ID} as category_id", f"{CATEGORY_NAME} as name")
        .unionByName(empty)
        .withColumn("description", F.concat(F.lit("linha "), "name"))
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part")).selectExpr(
        "p_partkey as product_id",
        "p_name as name",
        f"{CATEGORY_ID} as category_id",
        "cast(p_retailprice as decimal(12,2)) as price_brl",
        "concat(p_brand, case p_size % 3 when 0 then ' violão' when 1 then ' percussão' else ' clássico' end) as description",
        "greatest(p_size - 5, 0) as stock_quantity",
        "case p_partkey % 20 when 0 then 'discontinued' when 1 then 'coming_soon' else 'active' end as status",
        "case when p_partkey % 10 = 0 then concat('size ', p_size)"
        " else concat('{\"brand\":\"', p_brand, '\",\"size\":\"', p_size, '\"}') end as specs_raw",
        "date_add(date'2020-01-01', cast(p_partkey % 1000 as int)) as created_at",
    )


def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 8 + l_linenumber as promotion_id",
        "l_partkey as product_id",
        "cast(round(l_discount * 100) as decimal(5,2)) as discount_percent",
        "concat(l_returnflag, '-', l_linenumber) as description",
        "l_linestatus = 'O' as is_active",
    )


CUSTOMER_CODE = "translate(lpad(cast(c_custkey as string), 9, '0'), '0123456789', 'aeioubcdfg')"
CUSTOMER_PHONE = (
    "concat('(67) 9', lpad(cast((c_custkey div 10000) % 10000 as string), 4, '0'),"
    " '-', lpad(cast(c_custkey % 10000 as string), 4, '0'))"
)
CUSTOMER_EMAIL = "concat(lower(replace(c_name, '#', '.')), '@example.com')"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cities = table(spark, sf_dir, "nation").selectExpr("n_nationkey as c_nationkey", "n_name as city")
    return (
        table(spark, sf_dir, "customer")
        .join(cities, "c_nationkey")
        .selectExpr(
            "c_custkey as customer_id",
            f"concat('Cliente ', {CUSTOMER_CODE}) as name",
            f"{CUSTOMER_PHONE} as phone",
            f"{CUSTOMER_EMAIL} as email",
            "city",
        )
    )


TRACKING = "concat('BRAB', lpad(cast(o_orderkey as string), 7, '0'), 'BR')"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.max("l_shipdate").alias("last_ship"))
    )
    return (
        table(spark, sf_dir, "orders")
        .join(shipped, "o_orderkey", "left")
        .selectExpr(
            "o_orderkey as order_id",
            "o_custkey as customer_id",
            "cast(o_orderdate as date) as order_date",
            "case o_orderstatus when 'F' then 'delivered' when 'O' then 'shipped' else 'pending' end as status",
            "cast(o_totalprice as decimal(12,2)) as total_brl",
            "case when o_orderkey % 11 = 0 then null when o_orderkey % 11 = 1 then 'voucher'"
            " else case left(o_orderpriority, 1) when '1' then 'pix' when '2' then 'debit' when '3' then 'boleto'"
            " when '4' then 'credit_6x' else 'credit_12x' end end as payment_method",
            f"case when o_orderstatus in ('F', 'O') then {TRACKING} end as tracking_code",
            "cast(last_ship as date) as estimated_delivery",
            "case when o_orderkey % 5 = 0 then 'entregar à tarde' end as notes",
        )
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as order_id", "l_partkey as product_id", "cast(l_quantity as int) as quantity"
    )


LARGE_ORDER = "case when l_linenumber = 1 then 0 else l_orderkey end"


def items_with_large_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines where order 0 holds the first line of every order: about a quarter of all."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        f"{LARGE_ORDER} as order_id", "l_partkey as product_id", "cast(l_quantity as int) as quantity"
    )


def store(spark: SparkSession, sf_dir: str) -> Store:
    views = (categories, products, customers, orders, order_items, promotions)
    return Store(**{view.__name__: view(spark, sf_dir) for view in views})


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "concat('s', conv_id) as session_id", "turn as message_id", "role", "text as content"
    )


def long_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight conversations after each other as one session: longer than the history bound."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "concat('s', conv_id div 8) as session_id", "conv_id % 8 * 1000 + turn as message_id", "role", "text as content"
    )


HEADING_NUMBER = "if(i % 15 = 0, cast(i div 15 + 1 as string), concat(i div 15 + 1, '.', (i % 15) div 5))"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, with a numbered heading put before every fifth line after the first five lines."""
    return spread(table(spark, sf_dir, "documents")).selectExpr(
        "doc_id",
        "array_join(transform(split(text, '\\n'), (line, n) -> if(n >= 5 and n % 5 = 0,"
        f" concat(transform(array(n - 5), i -> {HEADING_NUMBER})[0], if(n % 2 = 0, '. Parte ', ' Seção '), lang, '\\n', line),"
        " line)), '\\n') as text",
    )


# ---- requests -------------------------------------------------------------------------------------

SEARCH_QUERY = """case p_partkey % 8
 when 0 then p_name
 when 1 then p_brand
 when 2 then concat('  ', upper(p_name), '!')
 when 3 then concat('violao ', split_part(p_name, ' ', 1))
 when 4 then translate(p_name, 'aeiou', 'eioua')
 when 5 then null
 when 6 then concat(left(p_name, 4), ' zz yy xx ww vv uu tt ', p_brand)
 else concat('percussao_', split_part(p_name, ' ', 2)) end"""


def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per product (by name, brand, misspelt, accent-free, blank...) and one per user message."""
    by_part = table(spark, sf_dir, "part").selectExpr(
        "p_partkey * 2 as request_id",
        f"{SEARCH_QUERY} as query",
        "case when p_size % 6 = 0 then left(lower(p_type), 5) end as category",
        "case when p_size % 3 = 0 then cast(p_retailprice + 5 as decimal(12,2)) end as max_price",
        "case when p_size % 4 = 0 then cast(p_retailprice - 10 as decimal(12,2)) end as min_price",
        "p_size % 2 = 0 as in_stock_only",
        "p_size % 5 = 0 as include_discontinued",
        "case when p_size % 7 > 0 then p_size % 7 end as limit",
    )
    spoken = table(spark, sf_dir, "conversations").where("role = 'user'").selectExpr(
        "(conv_id * 1000 + turn) * 2 + 1 as request_id",
        "text as query",
        "cast(null as string) as category",
        "cast(null as decimal(12,2)) as max_price",
        "cast(null as decimal(12,2)) as min_price",
        "false as in_stock_only",
        "false as include_discontinued",
        "cast(null as int) as limit",
    )
    return by_part.unionByName(spoken)


def customer_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup per customer: by phone (whole, last digits, wrong), e-mail (upper case, wrong) or name."""
    way = "c_custkey % 6"
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as request_id",
        f"case {way} when 0 then {CUSTOMER_PHONE} when 3 then right({CUSTOMER_PHONE}, 9)"
        f" when 4 then '00000-0000-0000' when 5 then '(99) 1234' end as phone",
        f"case when {way} in (1, 4) then upper({CUSTOMER_EMAIL}) when {way} = 5 then 'nobody@example.com' end as email",
        f"case {way} when 2 then upper(concat('cliente ', {CUSTOMER_CODE})) when 5 then {CUSTOMER_CODE}"
        f" when 0 then 'cliente' end as name",
    )


def order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup per order: by number, tracking code, customer, unknown number, or nothing."""
    way = "o_orderkey % 5"
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as request_id",
        f"case {way} when 0 then o_orderkey when 3 then -1 - o_orderkey end as order_id",
        f"case when {way} in (0, 1) then concat(' ', lower({TRACKING}), ' ') end as tracking_code",
        f"case when {way} in (1, 2) then o_custkey end as customer_id",
    )


def section_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section question per document: number, sub-number, word, unknown word, phrase, whole document."""
    return table(spark, sf_dir, "documents").selectExpr(
        "'manual' as source",
        "doc_id",
        "case doc_id % 6 when 0 then '1' when 1 then ' 1.1. ' when 2 then upper(split_part(text, ' ', 2))"
        " when 3 then concat('xpto', doc_id) when 4 then concat(split_part(text, ' ', 3), ' ', split_part(text, ' ', 4)) end as section",
    )


def context_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section questions, a category page per product type, the full index, promotions, unknown sources."""
    other = table(spark, sf_dir, "part").selectExpr(
        "case p_partkey % 4 when 3 then 'promocoes' when 2 then concat('fonte', p_size) else 'catalogo' end as source",
        "cast(null as long) as doc_id",
        "case p_partkey % 4 when 0 then left(lower(p_type), 5) end as section",
    )
    return section_requests(spark, sf_dir).unionByName(other)


def route_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text questions about every customer, order and product, some with a forced entity."""
    by_customer = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey * 3 as request_id",
        f"case c_custkey % 5 when 0 then {CUSTOMER_PHONE} when 1 then upper({CUSTOMER_EMAIL})"
        f" when 2 then {CUSTOMER_CODE} when 3 then concat(' cliente ', {CUSTOMER_CODE}) else {CUSTOMER_CODE} end as query",
        "case when c_custkey % 10 = 4 then 'clientes' when c_custkey % 10 = 9 then 'pedidos' else 'auto' end as entity",
    )
    by_order = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey * 3 + 1 as request_id",
        f"case o_orderkey % 3 when 0 then cast(o_orderkey as string) when 1 then lower({TRACKING})"
        " else concat('#', o_orderkey) end as query",
        "case when o_orderkey % 2 = 0 then 'pedidos' else 'auto' end as entity",
    )
    by_part = table(spark, sf_dir, "part").selectExpr(
        "p_partkey * 3 + 2 as request_id",
        "case p_partkey % 4 when 0 then p_name when 1 then concat(p_name, ' ', lower(p_type))"
        " when 2 then concat(upper(p_name), ' zzqx')"
        " else if(p_partkey % 8 = 7, concat(replace(p_name, ' ', 'x '), 'x'), split_part(p_name, ' ', 1)) end as query",
        "case p_partkey % 6 when 0 then 'produtos' when 1 then 'promocoes' else 'auto' end as entity",
    )
    return by_customer.unionByName(by_order).unionByName(by_part)


def whole_route_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions of ``route_requests``, with the first word of every fourth product asked for beside its misspelt name."""
    part = table(spark, sf_dir, "part").where("p_partkey % 8 = 7")
    entity = "case p_partkey % 6 when 0 then 'produtos' when 1 then 'promocoes' else 'auto' end as entity"
    words = part.selectExpr("-1 - p_partkey as request_id", "split_part(p_name, ' ', 1) as query", entity)
    return route_requests(spark, sf_dir).unionByName(words)


CALL_CODE = "translate(lpad(cast(user_id as string), 9, '0'), '0123456789', 'aeioubcdfg')"
CALL_QUERY = (
    f"case event_id % 6 when 0 then 'hot bolt' when 1 then 'hotx boltx' when 2 then {CALL_CODE} when 3 then 'anvil'"
    f" when 4 then 'ring' else concat('zzzzz', {CALL_CODE}) end"
)
CALL_ENTITY = "case event_id % 6 when 3 then 'promocoes' when 4 then 'produtos' else 'auto' end"
CALL_PRICE = "cast(value as decimal(12,2)) + 900"


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool call per event: searches for orders, products, misspelt products, promotions and customers, context loads,
    unknown tools and broken arguments."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as call_id",
        "case event_type when 'view' then 'search_store' when 'click' then 'load_context'"
        " when 'purchase' then 'search_store' when 'signup' then 'load_context'"
        " else if(event_id % 2 = 0, 'drop_table', 'search_store') end as name",
        "case event_type"
        " when 'view' then concat('{\"query\": \"', user_id, '\", \"entity\": \"pedidos\"}')"
        " when 'click' then concat('{\"source\": \"manual\", \"section\": \"', get_json_object(props, '$.k'), '\"}')"
        f" when 'purchase' then concat('{{\"query\": \"', {CALL_QUERY}, '\", \"entity\": \"', {CALL_ENTITY}, '\", \"max_price\": ', {CALL_PRICE}, ', \"limit\": 2}}')"
        " when 'signup' then if(event_id % 2 = 0, '{\"source\": \"catalogo\"}', '{\"section\": \"1\"}')"
        " else if(event_id % 4 = 1, '{\"query\": ', concat('{\"q\": ', user_id, '}')) end as arguments",
        "user_id as doc_id",
    )
