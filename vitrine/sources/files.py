"""CSV feeds to typed tables, and the full-refresh load."""

from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.store import iso_date
from vitrine.functions.text import blank_to_null
from vitrine.sources.schemas import SOURCE_NAMES, TABLES, Table

#: The loads of each table, in order of ``loaded``.
CURRENT = "table string, version string, loaded long"


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """CSV with a header, all cells as text, bound by name: trimmed, blank cells NULL.

    ``multi_line`` allows line breaks inside quoted cells, at the price of one task per file; feeds
    without such cells can turn it off so that large files split.
    """
    raw = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("encoding", "UTF-8")
        .csv(path)
    )
    return clean_cells(raw)


def clean_cells(raw: DataFrame) -> DataFrame:
    return raw.select(*[blank_to_null(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def _typed(text: Column, kind: str) -> Column:
    if kind == "string":
        return text
    if kind == "date":
        return iso_date(text)
    if kind == "boolean":
        return text.try_cast("int") != 0
    return text.try_cast(kind)


def typed(raw: DataFrame, table: Table, strict: bool = True, defaults: bool = False) -> DataFrame:
    """Cast the text cells to the table's types. With ``defaults``, blank cells of columns that declare one get it.

    A number that does not parse is an error; with ``strict=False`` it becomes NULL and its column is
    listed in ``cast_errors``. Dates that do not parse are NULL either way.
    """
    columns, errors = [], []
    for name, kind in table.columns.items():
        text = F.col(SOURCE_NAMES.get(name, name))
        value = _typed(text, kind)
        broken = text.isNotNull() & value.isNull()
        if strict and kind not in ("string", "date"):
            message = F.concat(F.lit(f"{table.name}.{name}: not a valid {kind}: "), text)
            value = F.when(broken, F.raise_error(message)).otherwise(value)
        if defaults:
            value = default_filled(table, name, text, value)
        if kind != "string":
            errors.append(F.when(broken, F.lit(name)))
        columns.append(value.alias(name))
    if not strict:
        columns.append(F.filter(F.array(*errors), lambda e: e.isNotNull()).alias("cast_errors"))
    return raw.select(*columns)


def default_filled(table: Table, name: str, text: Column, value: Column) -> Column:
    """``value``, or the column's declared default where the cell is blank. A cell that does not parse stays as it is."""
    if name not in table.defaults:
        return value
    return F.when(text.isNull(), F.lit(table.defaults[name]).cast(table.columns[name])).otherwise(value)


def load_all(
    spark: SparkSession,
    feeds: dict[str, str],
    target: str,
    strict: bool = True,
    multi_line: bool = True,
    defaults: bool = False,
) -> DataFrame:
    """Replace every table under ``target`` from its CSV feed; returns ``(table, rows)``.

    ``defaults`` fills blank cells of columns that declare a default; without it they stay NULL, and the audit names them.

    Each table is written in one pass to a new folder; the counts come from the write itself. The list of current
    folders is extended in one commit when all are written, so a feed that fails leaves every table as it was.
    """
    version = uuid.uuid4().hex

    def load(name: str) -> tuple[str, int]:
        seen = Observation(f"load_{name}")
        rows = typed(read_csv(spark, feeds[name], multi_line), TABLES[name], strict, defaults)
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{target}/{version}/{name}")
        return name, int(seen.get["rows"])

    with ThreadPoolExecutor(max(1, len(feeds))) as pool:  # the writes overlap; one that fails ends the load
        counts = list(pool.map(load, feeds))
    current = [(name, version, time.time_ns()) for name in feeds]
    spark.createDataFrame(current, CURRENT).coalesce(1).write.mode("append").parquet(f"{target}/current")
    return spark.createDataFrame(counts, "table string, rows long")


def current_folders(spark: SparkSession, target: str) -> dict[str, str]:
    """The folder of each table's last complete load: one row per table."""
    loads = spark.read.schema(CURRENT).parquet(f"{target}/current")
    last = loads.groupBy("table").agg(F.max_by("version", "loaded").alias("version"))
    return {r.table: f"{target}/{r.version}/{r.table}" for r in last.collect()}


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table, rows)`` for a set of tables."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
