"""Writers: message log, chunks, transcripts, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.operators.documents import doc_chunks
from vitrine.sources import versions

CHUNK = "doc_id long, chunk_no int, section string, text string"
DIGEST = "doc_id long, digest string"
#: Transcripts of one file.
PER_FILE = 1000


def append_messages(messages: DataFrame, path: str) -> None:
    messages.write.mode("append").parquet(path)


def _digests(spark: SparkSession, base: str) -> DataFrame:
    """``(doc_id, digest, version)``: the last state of each document; NULL digests are documents that went."""
    order = spark.createDataFrame(list(enumerate(versions.committed(spark, base))), "_order long, version string")
    known = versions.read(spark, base, "digests", DIGEST).join(order, "version")
    last = known.groupBy("doc_id").agg(F.max_by(F.struct("digest", "version"), "_order").alias("last"))
    return last.select("doc_id", "last.*")


def read_chunks(spark: SparkSession, base: str) -> DataFrame:
    """``(doc_id, chunk_no, section, text)`` of the documents as they were last written."""
    current = _digests(spark, base).where("digest is not null").select("doc_id", "version")
    return versions.read(spark, base, "chunks", CHUNK).join(current, ["doc_id", "version"], "left_semi").drop("version")


def replace_chunks(spark: SparkSession, base: str, documents: DataFrame, **options) -> DataFrame:
    """Make the chunk table that of ``documents`` (doc_id, text), writing chunks only for documents whose text changed.

    Returns ``(table, written, removed)``: documents and chunks. Document ids must be unique; options are those of
    ``doc_chunks`` and hold for the documents written.
    """
    version = versions.new_version()
    digests, texts = (versions.folder(base, name, version) for name in ("digests", "chunks"))
    given = documents.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")
    )
    known = _digests(spark, base).select("doc_id", F.col("digest").alias("_known"))
    joined = given.select("doc_id", "digest").join(known, "doc_id", "full")
    changed = joined.where(~F.col("digest").eqNullSafe(F.col("_known")))
    states, wrote = Observation(), Observation()
    counts = [F.count_if(F.col("digest").isNotNull()).alias("kept"), F.count_if(F.col("digest").isNull()).alias("gone")]
    marked = changed.select("doc_id", "digest").observe(states, *counts)
    marked.write.parquet(digests)
    new = spark.read.schema(DIGEST).parquet(digests).where("digest is not null")
    chunks = doc_chunks(given.join(new.select("doc_id"), "doc_id", "left_semi"), **options)
    chunks = chunks.observe(wrote, F.count(F.lit(1)).alias("rows"))
    chunks.write.parquet(texts)
    if states.get["kept"] or states.get["gone"]:
        versions.commit(spark, base, version)
    rows = [("documents", states.get["kept"], states.get["gone"]), ("chunks", wrote.get["rows"], None)]
    return spark.createDataFrame(rows, "table string, written long, removed long")


def write_transcripts(transcripts: DataFrame, path: str, per_file: int = PER_FILE) -> None:
    """Transcripts (session_id, transcript) in files of about ``per_file``, with a manifest of where each one stands.

    ``path/manifest`` holds ``(session_id, bucket, start, size)`` in bytes, ``path/texts`` one file per bucket.
    """
    files = max(1, -(-transcripts.count() // per_file))
    text = F.coalesce("transcript", F.lit(""))
    rows = transcripts.select("session_id", text.alias("value"), F.octet_length(text).cast("long").alias("size"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(files)).cast("int"))
    before = Window.partitionBy("bucket").orderBy("session_id", "value").rowsBetween(Window.unboundedPreceding, -1)
    # Each text ends with a line feed, which the manifest leaves out.
    placed = rows.withColumn("start", F.coalesce(F.sum(F.col("size") + 1).over(before), F.lit(0)))
    placed.select("session_id", "bucket", "start", "size").write.mode("overwrite").parquet(f"{path}/manifest")
    ordered = rows.repartition(files, "bucket").sortWithinPartitions("bucket", "session_id", "value")
    ordered.select("bucket", "value").write.mode("overwrite").partitionBy("bucket").text(f"{path}/texts")


def read_transcripts(spark: SparkSession, path: str, *sessions: str) -> DataFrame:
    """``(session_id, transcript)`` of the named sessions, cut from the files that hold them."""
    manifest = spark.read.parquet(f"{path}/manifest").where(F.col("session_id").isin(*sessions))
    files = spark.read.format("binaryFile").load(f"{path}/texts").select("bucket", "content")
    part = F.substring("content", F.col("start").cast("int") + 1, F.col("size").cast("int"))
    return manifest.join(files, "bucket").select("session_id", F.decode(part, "UTF-8").alias("transcript"))


def write_json(answers: DataFrame, path: str) -> None:
    """Answers as JSON lines; NULL fields are kept."""
    answers.write.mode("overwrite").option("ignoreNullFields", False).json(path)
