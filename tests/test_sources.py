import json

import pytest
from pyspark.sql import functions as F

from vitrine.operators import chatlog as M
from vitrine.sources import files, sinks
from vitrine.sources.schemas import TABLES
from vitrine.sources.store import Store, parsed_specs

FEEDS = {
    "categories": 'category_id,name,description\n1, Violões ,"aço, nylon"\n2,Sopro,\n',
    "products": (
        "product_id,price_brl,name,category_id,description,stock_quantity,status,specs,created_at\n"
        '10,641.25,"Violão ""A""",1,"duas\nlinhas",3,active,"{""top"":""cedro""}",2021-03-15\n'
        "11,763,Flauta,2,   ,0,active,,2021-02-30\n"
    ),
    "customers": "customer_id,name,phone,email,city\n1,Noa,(31) 97204-1586,,Aurora\n",
    "orders": (
        "order_id,customer_id,order_date,status,total_brl,payment_method,tracking_code,estimated_delivery,notes\n"
        "1,1,2024-03-06,delivered,2417,pix,,20240318,\n"
    ),
    "order_items": "order_id,quantity,product_id\n1,2,10\n",
    "promotions": "promotion_id,product_id,discount_percent,description,is_active\n1,10,10,Oferta,1\n2,10,15,Velha,0\n",
}


@pytest.fixture()
def feeds(tmp_path):
    out = {}
    for name, text in FEEDS.items():
        path = tmp_path / f"{name}.csv"
        path.write_text(text, encoding="utf-8")
        out[name] = str(path)
    return out


def test_load_all_and_open(spark, feeds, tmp_path):
    target = str(tmp_path / "store")
    for _ in range(2):
        counts = {r.table: r.rows for r in files.load_all(spark, feeds, target).collect()}
        assert counts == {"categories": 2, "products": 2, "customers": 1, "orders": 1, "order_items": 1, "promotions": 2}
    store = Store.open(spark, target)
    a, b = sorted(store.products.collect())
    assert a.name == 'Violão "A"' and a.description == "duas\nlinhas" and json.loads(a.specs_raw) == {"top": "cedro"}
    assert b.description is None and b.specs_raw is None and b.created_at is None
    assert str(store.orders.first().estimated_delivery) == "2024-03-18"
    assert [r.is_active for r in store.promotions.orderBy("promotion_id").collect()] == [True, False]
    broken = tmp_path / "broken.csv"
    broken.write_text("promotion_id,product_id,discount_percent,description,is_active\nx,10,5,p,1\n", encoding="utf-8")
    empty = tmp_path / "empty.csv"
    empty.write_text("category_id,name,description\n", encoding="utf-8")
    with pytest.raises(Exception, match="not a valid long"):
        files.load_all(spark, {"categories": str(empty), "promotions": str(broken)}, target)
    again = Store.open(spark, target)
    assert (again.categories.count(), again.promotions.count()) == (2, 2)
    files.load_all(spark, {"categories": str(empty)}, target)
    again = Store.open(spark, target)
    assert (again.categories.count(), again.promotions.count()) == (0, 2)
    assert store.order_items.first().asDict() == {"order_id": 1, "product_id": 10, "quantity": 2}


def test_specs_keep_types_and_refuse_other_text(spark):
    cases = ['{"a": 6, "b": {"c": [1, true]}}', '{"a":"x"} junk', "{'a':'x'}", "[1,2]", "12", "1,2", "madeira", "", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, raw string")
    rows = df.select("i", F.to_json(F.struct(parsed_specs(F.col("raw")).alias("v"))).alias("v")).orderBy("i").collect()
    kept = {0: {"a": 6, "b": {"c": [1, True]}}, 3: [1, 2], 4: 12}
    assert [json.loads(r.v).get("v") for r in rows] == [kept.get(i) for i in range(len(cases))]


def test_junk_number_raises_or_is_listed(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("category_id,name,description\nx1,Nome,\n12.0,Outro,\n", encoding="utf-8")
    raw = files.read_csv(spark, str(path))
    with pytest.raises(Exception, match="not a valid long"):
        files.typed(raw, TABLES["categories"]).collect()
    rows = files.typed(raw, TABLES["categories"], strict=False).collect()
    assert [(r.category_id, r.cast_errors) for r in rows] == [(None, ["category_id"])] * 2


def test_transcripts_and_json_sinks(spark, tmp_path):
    log = spark.createDataFrame([("a", 1, "user", "oi")], "session_id string, message_id long, role string, content string")
    sinks.append_messages(log, str(tmp_path / "log"))
    sinks.append_messages(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    sinks.write_transcripts(M.render(log, "m"), str(tmp_path / "out"))
    assert sinks.read_transcripts(spark, str(tmp_path / "out"), "a").first().transcript.startswith("model: m")
    sinks.write_json(log.withColumn("x", F.lit(None).cast("string")), str(tmp_path / "json"))
    assert '"x":null' in spark.read.text(str(tmp_path / "json")).first().value
