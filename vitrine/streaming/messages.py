"""Message streams: replay-safe ingest, running last-N history, catalogue enrichment."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from vitrine.functions import values as V
from vitrine.operators.chatlog import last_n

MESSAGE = "session_id string, message_id long, role string, content string, created_at timestamp"
HISTORY = "session_id string, message_id long, role string, content string"
RESET = "reset"


def ingest(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a message stream to the log, one folder per day, without the messages that the log already holds.

    A message is known by session, number and day of creation, however late it comes: late new messages are kept, late
    replays are not. Only the log's days that a batch touches are read. A repeated batch adds nothing.
    """
    logged = f"{MESSAGE}, day date"
    key = ["session_id", "message_id", "day"]
    messages.sparkSession.createDataFrame([], logged).write.mode("append").partitionBy("day").parquet(path)

    def append(batch: DataFrame, _: int) -> None:
        new = batch.withColumn("day", F.to_date("created_at")).dropDuplicates(key)
        days = new.select(F.col("day").alias("_day")).distinct()
        log = batch.sparkSession.read.schema(logged).parquet(path)
        seen = log.join(days, F.col("day").eqNullSafe(F.col("_day")), "left_semi").select(*[F.col(k).alias(f"_{k}") for k in key])
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
        new.join(seen, same, "left_anti").write.mode("append").partitionBy("day").parquet(path)

    return (
        messages.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def running_history(messages: DataFrame, n: int = V.HISTORY_LIMIT, idle_ms: int | None = None) -> DataFrame:
    """After each micro-batch, the last ``n`` messages of every session that changed.

    A message with the role ``reset`` empties its session, also for older messages that arrive later. State of sessions
    that got no message for ``idle_ms`` is dropped. A session without state starts anew: until it has ``n`` messages
    again, its rows are marked ``partial``, and ``completed`` takes them from the log. Without ``idle_ms`` nothing is
    dropped and no row is partial. With it Spark runs an empty batch after each, to see what grew old: a run that is to end
    (``availableNow``) needs ``spark.sql.streaming.noDataMicroBatches.enabled=false``. The processor is defined here so that it travels to the workers whole.
    """
    reset = RESET

    class LastMessages(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.kept = handle.getListState("kept", "message_id long, role string, content string", idle_ms)
            self.cleared = handle.getValueState("cleared", "message_id long", idle_ms)
            # Whether the state holds all that the last n messages can be.
            self.whole = handle.getValueState("whole", "whole boolean", idle_ms)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            columns = ["message_id", "role", "content"]
            kept = pd.DataFrame(list(self.kept.get()), columns=columns)
            cleared = self.cleared.get()[0] if self.cleared.exists() else None
            whole = idle_ms is None or (self.whole.exists() and self.whole.get()[0])
            for batch in rows:
                # Cut to n rows batch by batch, so a busy session never holds more.
                kept = pd.concat([kept, batch[columns]]) if len(kept) else batch[columns]
                resets = kept.loc[kept["role"] == reset, "message_id"]
                if len(resets):
                    cleared = max(int(resets.max()), -1 if cleared is None else cleared)
                if cleared is not None:
                    kept = kept[kept["message_id"] > cleared]
                kept = kept.drop_duplicates("message_id").sort_values("message_id").tail(n)
            whole = bool(whole or len(kept) == n or cleared is not None)
            # All states are written, so that they grow old together.
            self.whole.update((whole,))
            if cleared is not None:
                self.cleared.update((cleared,))
            if len(kept):
                self.kept.put([(int(r.message_id), r.role, r.content) for r in kept.itertuples()])
            else:
                self.kept.clear()
            yield kept.assign(session_id=key[0], partial=not whole)[["session_id", *columns, "partial"]]

        def close(self) -> None:
            pass

    return messages.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=LastMessages(),
        outputStructType=f"{HISTORY}, partial boolean",
        outputMode="Update",
        timeMode="None" if idle_ms is None else "ProcessingTime",
    )


def completed(changed: DataFrame, log: DataFrame, n: int = V.HISTORY_LIMIT) -> DataFrame:
    """Rows of a micro-batch of ``running_history`` with those of partial sessions taken from ``log``, which holds the
    messages of the batch already. Only the messages of these sessions are read from it."""
    columns = [c.split()[0] for c in HISTORY.split(", ")]
    asked = changed.where("partial").select("session_id").distinct()
    known = log.join(asked, "session_id", "left_semi")
    resets = known.where(F.col("role") == RESET).groupBy("session_id").agg(F.max("message_id").alias("_until"))
    alive = known.join(resets, "session_id", "left").where("_until is null or message_id > _until")
    unique = alive.dropDuplicates(["session_id", "message_id"])
    whole = last_n(unique, n).select(*columns)
    return changed.where("not partial").select(*columns).unionByName(whole)


def enrich(queries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Product questions of a stream joined with the catalogue as it is when the batch runs."""
    brief = catalogue.select("product_id", "name", "category", "price_brl", "effective_price", "stock_quantity", "status")
    return queries.join(brief, "product_id", "left").withColumn("known", F.col("name").isNotNull())
