import datetime as dt
import time

from vitrine.operators import chatlog as M
from vitrine.streaming import messages as T


def write(spark, path, rows):
    spark.createDataFrame(rows, T.MESSAGE).coalesce(1).write.mode("append").parquet(path)


def at(i):
    return dt.datetime(2026, 1, 1, 12, 0, i % 60)


def test_ingest_drops_replays_across_restarts(spark, tmp_path):
    source, log, check = (str(tmp_path / n) for n in ("in", "log", "check"))
    first = [("a", i, "user", f"m{i}", at(i)) for i in range(5)]
    write(spark, source, first + first[:2])
    for extra in ([], [*first[3:], ("b", 1, "user", "x", at(9))]):
        if extra:
            write(spark, source, extra)
        T.ingest(spark.readStream.schema(T.MESSAGE).parquet(source), log, check).awaitTermination()
    got = sorted((r.session_id, r.message_id) for r in spark.read.parquet(log).collect())
    assert got == [("a", i) for i in range(5)] + [("b", 1)]


def test_ingest_keeps_late_messages_and_drops_late_replays(spark, tmp_path):
    source, log, check = (str(tmp_path / n) for n in ("in", "log", "check"))
    day = dt.timedelta(days=1)
    old = [("a", i, "user", f"m{i}", at(i)) for i in range(4)]
    late = [("c", 1, "user", "late", at(0) - 40 * day), *old[:2], ("a", None, "user", "none", None)]
    for part in (old, [("b", 1, "user", "x", at(9) + 30 * day)], late, late):
        write(spark, source, part)
        T.ingest(spark.readStream.schema(T.MESSAGE).parquet(source), log, check).awaitTermination()
    got = sorted((r.session_id, r.message_id or 0, r.content) for r in spark.read.parquet(log).collect())
    assert got == [("a", 0, "m0"), ("a", 0, "none"), ("a", 1, "m1"), ("a", 2, "m2"), ("a", 3, "m3"), ("b", 1, "x"), ("c", 1, "late")]


def test_running_history_equals_batch(spark, tmp_path):
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    rows = [("a", i, "user", f"m{i}", at(i)) for i in range(9)] + [("b", i, "user", f"n{i}", at(i)) for i in range(4)]
    state = {}

    def keep(batch, _):
        changed = {}
        for r in batch.collect():
            changed.setdefault(r.session_id, []).append(r.message_id)
        state.update(changed)

    for part in (rows[:4], rows[4:]):
        write(spark, source, part)
        stream = spark.readStream.schema(T.MESSAGE).parquet(source)
        query = T.running_history(stream, 3).writeStream.foreachBatch(keep).outputMode("update")
        query.option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    log = spark.createDataFrame(rows, T.MESSAGE)
    batch = {}
    for r in M.last_n(log, 3).orderBy("message_id").collect():
        batch.setdefault(r.session_id, []).append(r.message_id)
    assert {k: sorted(v) for k, v in state.items()} == batch


def test_reset_holds_for_messages_that_arrive_late(spark, tmp_path):
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    seen = {}

    def keep(batch, _):
        for r in batch.collect():
            seen.setdefault(r.session_id, set()).add(r.message_id)

    parts = [
        [("a", 1, "user", "x", at(1)), ("a", 5, T.RESET, "", at(5))],
        [("a", 3, "user", "late", at(3)), ("a", 6, "user", "new", at(6))],
    ]
    for part in parts:
        write(spark, source, part)
        query = T.running_history(spark.readStream.schema(T.MESSAGE).parquet(source), 3).writeStream.foreachBatch(keep)
        query.outputMode("update").option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    assert seen == {"a": {6}}


def test_enrich_joins_current_catalogue(spark, tmp_path):
    source = str(tmp_path / "q")
    spark.createDataFrame([(1, 10), (2, 99)], "request_id long, product_id int").write.parquet(source)
    catalogue = spark.createDataFrame(
        [(10, "A", "c", 1.0, 1.0, 2, "active")],
        "product_id int, name string, category string, price_brl double, effective_price double, stock_quantity int, status string",
    )
    stream = spark.readStream.schema("request_id long, product_id int").parquet(source)
    out = T.enrich(stream, catalogue).writeStream.format("memory").queryName("enriched").trigger(availableNow=True).start()
    out.awaitTermination()
    assert sorted((r.request_id, r.known) for r in spark.table("enriched").collect()) == [(1, True), (2, False)]


def run_history(spark, source, check, sink, idle_ms):
    stream = T.running_history(spark.readStream.schema(T.MESSAGE).parquet(source), 3, idle_ms)
    query = stream.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", check)
    # A stream with idle times asks for a further, empty batch for ever; a run that is to end turns these off.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        run = query.trigger(availableNow=True).start()
        ended = run.awaitTermination(90)
        run.stop()
    finally:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    assert ended


def test_idle_state_is_dropped_and_a_late_message_still_gives_the_right_history(spark, tmp_path):
    parts = [
        [("a", i, "user", f"m{i}", at(i)) for i in range(1, 6)] + [("b", 1, "user", "b1", at(1)), ("c", 2, "reset", "", at(2))],
        [("a", 0, "user", "late", at(0)), ("b", 2, "user", "b2", at(2)), ("c", 1, "user", "old", at(1)), ("c", 3, "user", "c3", at(3))],
    ]
    for idle_ms in (None, 1500):
        source, log, check = (str(tmp_path / f"{n}{idle_ms}") for n in ("in", "log", "check"))
        histories, partial = {}, {}

        def keep(batch, _):
            batch.persist()
            partial.update({r.session_id: r.partial for r in batch.collect()})
            whole = {}
            for r in T.completed(batch, spark.read.schema(T.MESSAGE).parquet(log), 3).collect():
                whole.setdefault(r.session_id, []).append(r.message_id)
            histories.update({s: sorted(ids) for s, ids in whole.items()})
            batch.unpersist()

        for part in parts:
            write(spark, source, part)
            write(spark, log, part)
            run_history(spark, source, check, keep, idle_ms)
            if part is parts[0]:
                time.sleep(2)
        assert histories == {"a": [3, 4, 5], "b": [1, 2], "c": [3]}, idle_ms
        # With its state dropped, a session that had its three messages is partial again.
        assert partial == dict.fromkeys("abc", idle_ms is not None)


def test_state_in_use_is_kept(spark, tmp_path):
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    seen = []
    for i in range(1, 5):
        write(spark, source, [("a", i, "user", f"m{i}", at(i))])
        run_history(spark, source, check, lambda batch, _: seen.extend([sorted((r.message_id, r.partial) for r in batch.collect())] if not batch.isEmpty() else []), 600_000)
    assert seen == [[(1, True)], [(1, True), (2, True)], [(1, False), (2, False), (3, False)], [(2, False), (3, False), (4, False)]]
