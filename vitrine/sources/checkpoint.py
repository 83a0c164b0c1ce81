"""Materialise a shared intermediate result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``, shared by driver and executors. A local master
    without one uses the warehouse; any other stops here, as its executors could not read each other's files."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return folder


def cut(df: DataFrame, name: str = "shared") -> DataFrame:
    """Write ``df`` as a table beside the checkpoints and read it back: for results that several branches read.

    The lineage ends there, so a lost executor costs a re-read, and the plan knows the table's size.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """``df`` for a join whose sides both grow with the tables: it is sorted and merged, never sent whole to the driver.

    Spark plans a broadcast by the size of the files read, and a few columns of a compressed file can be thirty times that
    in memory.
    """
    return df.hint("merge")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path beside the checkpoints, for files written and read back by one job."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
