"""The session registry: sessions, their messages and resets, merged change by change.

A change is a table of messages (session_id, message_id, role, content, created_at); the role ``reset`` removes its session
with all messages up to that number, also those that arrive later. A session has a row from its first message that no
reset removed. Messages are known by session and number, so a replayed change adds nothing. All tables of a change are
switched at once (``versions``), from a batch job or from a stream.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from vitrine.sources import versions

MESSAGE = "session_id string, message_id long, role string, content string, created_at timestamp"
SESSION = "session_id string, first_message_id long, created_at timestamp"
RESETS = "session_id string, until long"
BUCKETED = ", bucket int"
RESET = "reset"
#: Folders of a version by session: a change reads only those of its own sessions.
BUCKETS = 16


@dataclass(frozen=True)
class Sessions:
    messages: DataFrame
    sessions: DataFrame
    resets: DataFrame


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).cast("int"))


def _stored(spark: SparkSession, base: str) -> Sessions:
    tables = {"messages": MESSAGE, "sessions": SESSION, "resets": RESETS}
    return Sessions(**{name: versions.read(spark, base, name, kind + BUCKETED).drop("version") for name, kind in tables.items()})


def _last_resets(resets: DataFrame) -> DataFrame:
    return resets.groupBy("session_id").agg(F.max("until").alias("until"))


def _after(rows: DataFrame, resets: DataFrame, number: str) -> DataFrame:
    """Rows that no reset removed: one row per session on the right, however busy the session."""
    joined = rows.join(_last_resets(resets), "session_id", "left")
    return joined.where(F.col("until").isNull() | (F.col(number) > F.col("until"))).drop("until")


def _live(stored: Sessions) -> Sessions:
    sessions = _after(stored.sessions, stored.resets, "first_message_id").groupBy("session_id")
    first = F.min(F.struct("first_message_id", "created_at")).alias("first")
    return Sessions(
        _after(stored.messages, stored.resets, "message_id").drop("bucket"),
        sessions.agg(first).select("session_id", "first.*"),
        _last_resets(stored.resets),
    )


def read(spark: SparkSession, base: str) -> Sessions:
    """Messages and sessions as they are after all committed changes."""
    return _live(_stored(spark, base))


def _touched(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of the changed sessions; the join on the bucket prunes folders."""
    keys = changes.select("bucket", "session_id").distinct()
    return rows.join(keys, ["bucket", "session_id"], "left_semi")


def merge(spark: SparkSession, base: str, changes: DataFrame, batch: str | None = None) -> DataFrame:
    """Merge a change; returns ``(table, added, removed)``. A ``batch`` that is committed already changes nothing."""
    if versions.has_batch(spark, base, batch):
        return spark.createDataFrame([("messages", 0, 0), ("sessions", 0, 0)], "table string, added long, removed long")
    version = versions.new_version()
    to = {name: versions.folder(base, name, version) for name in ("messages", "sessions", "resets")}
    named = changes.where("session_id is not null").select(*[c.split()[0] for c in MESSAGE.split(", ")])
    given = _bucketed(named)
    resets = given.where(F.col("role") == RESET).groupBy("bucket", "session_id").agg(F.max("message_id").alias("until"))
    given_messages = given.where(F.coalesce("role", F.lit("")) != RESET).dropDuplicates(["session_id", "message_id"])

    stored = _stored(spark, base)
    old = Sessions(*[_touched(t, given) for t in (stored.messages, stored.sessions, stored.resets)])
    _write(resets, to["resets"])
    all_resets = old.resets.unionByName(spark.read.schema(RESETS + BUCKETED).parquet(to["resets"]))
    keys = old.messages.select("session_id", F.col("message_id").alias("_known"))
    same = F.col("message_id").eqNullSafe(F.col("_known"))
    fresh = given_messages.alias("g").join(
        keys.alias("k"), (F.col("g.session_id") == F.col("k.session_id")) & same, "left_anti"
    )
    added = {"messages": _write(_after(fresh, all_resets, "message_id"), to["messages"])}

    written = spark.read.schema(MESSAGE + BUCKETED).parquet(to["messages"])
    first = F.min(F.struct("message_id", "created_at")).alias("first")
    opened = written.groupBy("bucket", "session_id").agg(first).select(
        "bucket", "session_id", F.col("first.message_id").alias("first_message_id"), "first.created_at"
    )
    standing = _after(old.sessions, all_resets, "first_message_id").select("session_id").distinct()
    added["sessions"] = _write(opened.join(standing, "session_id", "left_anti"), to["sessions"])

    before, ended = _live(old), _last_resets(spark.read.schema(RESETS + BUCKETED).parquet(to["resets"]))
    gone = {
        "messages": before.messages.join(ended, "session_id").where("message_id <= until").count(),
        "sessions": before.sessions.join(ended, "session_id").where("first_message_id <= until").count(),
    }
    versions.commit(spark, base, version, batch)
    rows = [(name, added[name], gone[name]) for name in added]
    return spark.createDataFrame(rows, "table string, added long, removed long")


def _write(rows: DataFrame, path: str) -> int:
    """Write a table by bucket; the count comes from the write itself."""
    seen = Observation()
    counted = rows.repartition("bucket", "session_id").observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.partitionBy("bucket").parquet(path)
    return int(seen.get["rows"])


def compact(spark: SparkSession, base: str) -> None:
    """Write what stands as one version, which readers then use alone. Resets stay: they also hold for late messages."""
    now, version = read(spark, base), versions.new_version()
    for name in ("messages", "sessions", "resets"):
        _write(_bucketed(getattr(now, name)), versions.folder(base, name, version))
    versions.commit(spark, base, version, whole=True)


def follow(messages: DataFrame, base: str, checkpoint: str) -> StreamingQuery:
    """Merge a message stream, micro-batch by micro-batch. A batch that is run again after a failure adds nothing."""

    def apply(batch: DataFrame, number: int) -> None:
        merge(batch.sparkSession, base, batch, f"{checkpoint}#{number}")

    return (
        messages.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
