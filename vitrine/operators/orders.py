"""Order lookup, order items and return deadlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.store import as_date, deadlines, deadlines_note, json_text, payment_label, tracking_key
from vitrine.operators.paging import PAGE_ROWS, paged_lists
from vitrine.operators.ranking import positions
from vitrine.sources.checkpoint import cut, merged


#: Lines of a block.
BLOCK_LINES = 1000


def with_deadlines(orders: DataFrame, as_of) -> DataFrame:
    """Add ``deadlines`` (struct), ``deadlines_note`` and ``payment_label``. Expressions only, no shuffle."""
    dates = (F.col("status"), F.col("estimated_delivery"), F.col("order_date"))
    return (
        orders.withColumn("deadlines", deadlines(*dates, as_date(as_of)))
        .withColumn("deadlines_note", deadlines_note(*dates))
        .withColumn("payment_label", payment_label(F.col("payment_method")))
    )


def order_lines(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """One row per order line with the product's current price; an order without lines keeps one row.

    Lines of unknown products drop out, as the item join is an inner join.
    """
    names = products.select("product_id", F.col("name").alias("product"), "price_brl")
    return orders.join(items.join(names, "product_id"), "order_id", "left")


def item_lines(items: DataFrame, products: DataFrame) -> DataFrame:
    """``(order_id, line, product_id, name, quantity, price_brl, payload)``: order lines, numbered from 1 in each order.

    An order of any size is a set of rows; equal lines are counted before they are numbered. Lines of unknown products
    drop out.
    """
    fields = ["product_id", "name", "quantity", "price_brl"]
    names = products.select("product_id", "name", F.col("price_brl").cast("double").alias("price_brl"))
    equal = items.join(names, "product_id").groupBy("order_id", *fields).agg(F.count("*").alias("_n"))
    order = [F.col(c) for c in ("quantity", "name", "price_brl", "product_id")]
    placed = positions(equal, "_first", *order, key=("order_id",), weight="_n")
    lines = F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1))
    payload = json_text("quantity", "name", "price_brl")
    return placed.select("order_id", lines.alias("line"), *fields, payload.alias("payload"))


def item_blocks(lines: DataFrame, size: int = BLOCK_LINES) -> DataFrame:
    """``(order_id, block, items)``: the lines of each order nested in arrays of ``size``, the last one shorter."""
    block = F.floor((F.col("line") - 1) / size).cast("long")
    item = F.struct("line", "quantity", "name", "price_brl")
    blocks = lines.groupBy("order_id", block.alias("block")).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    fields = ("quantity", "name", "price_brl")
    nested = F.transform("_items", lambda i: F.struct(*[i[f].alias(f) for f in fields]))
    return blocks.select("order_id", "block", nested.alias("items"))


def order_payloads(orders: DataFrame, customers: DataFrame, items: DataFrame, products: DataFrame, as_of) -> DataFrame:
    """``(order_id, customer_name, payload)``: each order as one JSON text, whatever its size. It names the list of its
    items and their number; ``item_lines`` holds their rows, ``item_blocks`` nests them, ``whole_payloads`` holds them in
    the text."""
    known = merged(products.select("product_id"))
    lines = items.join(known, "product_id").groupBy("order_id").agg(F.count("*").alias("_n"))
    listed = F.struct(F.col("order_id").alias("list"), F.coalesce("_n", F.lit(0).cast("long")).alias("count"))
    return with_payload(orders_of(orders, customers).join(lines, "order_id", "left"), as_of, listed).select(
        "order_id", "customer_name", "payload"
    )


def whole_payloads(
    orders: DataFrame,
    customers: DataFrame,
    items: DataFrame,
    products: DataFrame,
    as_of,
    page_rows: int = PAGE_ROWS,
) -> DataFrame:
    """``(order_id, customer_name, page, pages, payload)``: each order as JSON with its items nested.

    Orders of up to ``page_rows`` lines give one payload; a larger one repeats its header on each page.
    """
    names = products.select("product_id", "name", F.col("price_brl").cast("double").alias("price_brl"))
    lines = items.join(names, "product_id").select("order_id", "quantity", "name", "price_brl")
    nested = paged_lists(lines, "order_id", ["quantity", "name", "price_brl"], "items", page_rows)
    none = F.from_json(F.lit("[]"), "array<struct<quantity:int,name:string,price_brl:double>>")
    paged = orders_of(orders, customers).join(nested, "order_id", "left")
    return with_payload(paged, as_of, F.coalesce("items", none)).select(
        "order_id",
        "customer_name",
        F.coalesce("page", F.lit(0)).cast("long").alias("page"),
        F.coalesce("pages", F.lit(1)).cast("long").alias("pages"),
        "payload",
    )


def orders_of(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders with the customer's name; orders of unknown customers drop out."""
    return orders.join(customers.select("customer_id", F.col("name").alias("customer_name")), "customer_id")


def with_payload(orders: DataFrame, as_of, items: Column) -> DataFrame:
    payload = json_text(
        "order_id",
        "customer_name",
        F.col("order_date").cast("string").alias("order_date"),
        "status",
        F.col("total_brl").cast("double").alias("total_brl"),
        F.col("payment_label").alias("payment_method"),
        "tracking_code",
        F.col("estimated_delivery").cast("string").alias("estimated_delivery"),
        "deadlines",
        "deadlines_note",
        items.alias("items"),
        "notes",
    )
    return with_deadlines(orders, as_of).withColumn("payload", payload)


def request_key() -> Column:
    """Which key an order request uses: order id before tracking code before customer id."""
    return (
        F.when(F.col("order_id").isNotNull(), F.lit("order_id"))
        .when(F.coalesce("tracking_code", F.lit("")) != "", F.lit("tracking_code"))
        .when(F.col("customer_id").isNotNull(), F.lit("customer_id"))
    )


def lookup(requests: DataFrame, orders: DataFrame) -> DataFrame:
    """``(request_id, key, order columns..., seq)`` for requests (request_id, order_id, tracking_code, customer_id).

    ``seq`` numbers the orders of a request from the newest; orders without date come last. Orders are found and numbered
    once for each distinct key, however many requests ask for it; their numbers travel, their other columns join last.
    """
    rows = cut(orders.withColumn("_row", F.monotonically_increasing_id()), "orders")
    kinds = {
        "order_id": (F.col("order_id"), F.col("order_id")),
        "tracking_code": (tracking_key(F.col("tracking_code")), tracking_key(F.col("tracking_code"))),
        "customer_id": (F.col("customer_id"), F.col("customer_id")),
    }
    value = F.coalesce(*[F.when(F.col("key") == kind, theirs.cast("string")) for kind, (theirs, _) in kinds.items()])
    asked = requests.withColumn("key", request_key()).select("request_id", "key", value.alias("_value"))
    wanted = asked.select("key", "_value").where("_value is not null").distinct()
    known = [
        rows.select("_row", "order_id", "order_date", F.lit(k).alias("key"), ours.cast("string").alias("_value"))
        for k, (_, ours) in kinds.items()
    ]
    found = known[0].unionByName(known[1]).unionByName(known[2]).join(merged(wanted), ["key", "_value"], "left_semi")
    newest = (F.col("order_date").desc_nulls_last(), F.col("order_id"))
    placed = positions(found, "seq", *newest, key=("key", "_value")).select("key", "_value", "_row", "seq")
    chosen = merged(asked).join(placed, ["key", "_value"]).drop("_value")
    return merged(chosen).join(rows, "_row").select("request_id", "key", *orders.columns, "seq")
