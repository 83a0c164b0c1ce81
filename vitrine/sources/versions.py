"""A list of committed versions: what a reader may read, extended by one small file at a time.

A change first writes its tables to a folder of its own and is then committed by one row. Readers see all of it or
nothing. A change that names its batch is committed once, however often it is repeated.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "version string, batch string, whole boolean, committed long"


def new_version() -> str:
    return f"v{uuid.uuid4().hex}"


def folder(base: str, name: str, version: str) -> str:
    """Where a version of a table is written."""
    return f"{base}/{name}/version={version}"


def commit(spark: SparkSession, base: str, version: str, batch: str | None = None, whole: bool = False) -> None:
    """``whole`` versions stand for all earlier ones."""
    row = spark.createDataFrame([(version, batch, whole, time.time_ns())], COMMIT)
    row.coalesce(1).write.mode("append").parquet(f"{base}/commits")


def _commits(spark: SparkSession, base: str) -> DataFrame:
    try:
        return spark.read.schema(COMMIT).parquet(f"{base}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)  # nothing committed yet


def committed(spark: SparkSession, base: str) -> list[str]:
    """The versions to read, oldest first: one row per change since the last whole version."""
    rows = _commits(spark, base).orderBy("committed").collect()
    start = max((i for i, r in enumerate(rows) if r.whole), default=0)
    return [r.version for r in rows[start:]]


def has_batch(spark: SparkSession, base: str, batch: str | None) -> bool:
    return batch is not None and not _commits(spark, base).where(F.col("batch") == batch).isEmpty()


def read(spark: SparkSession, base: str, name: str, schema: str) -> DataFrame:
    """The rows of table ``name`` in all committed versions, with their ``version``."""
    schema = f"{schema}, version string"
    folders = [folder(base, name, v) for v in committed(spark, base)]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{base}/{name}").parquet(*folders)
