"""Constraint audit: keys, required columns, references, casts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.sources.schemas import STATE_TABLES, TABLES, Table


def _result(table: str, rule: str, count) -> tuple:
    violations = F.coalesce(count, F.lit(0)).cast("long").alias("violations")
    return F.lit(table).alias("table"), F.lit(rule).alias("rule"), violations


def _row_rules(df: DataFrame, table: Table) -> DataFrame:
    """All row-level rules of a table in one scan: required columns and casts that failed."""
    checks = {f"not_null({c})": F.count_if(F.col(c).isNull()) for c in table.required}
    if "cast_errors" in df.columns:
        checks["valid_cast"] = F.count_if(F.size("cast_errors") > 0)
    counts = df.agg(*[n.alias(f"_{i}") for i, n in enumerate(checks.values())])
    return _as_rules(counts, table, checks)


def _as_rules(counts: DataFrame, table: Table, rules: Iterable[str]) -> DataFrame:
    """One row of counts ``_0``, ``_1``, ... as a row for each rule."""
    pairs = [F.struct(F.lit(rule).alias("rule"), F.col(f"_{i}").alias("n")) for i, rule in enumerate(rules)]
    return counts.select(F.explode(F.array(*pairs)).alias("r")).select(
        F.lit(table.name).alias("table"), F.col("r.rule").alias("rule"), F.col("r.n").alias("violations")
    )


def _duplicates(df: DataFrame, table: Table) -> DataFrame:
    key = (table.key,) if isinstance(table.key, str) else table.key
    repeated = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return repeated.agg(F.count("*").alias("n")).select(*_result(table.name, f"unique({', '.join(key)})", F.col("n")))


def _orphans(child: DataFrame, table: Table, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """References are counted per value before the join, so a value on a third of the rows is one row."""
    used = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_ref")).agg(F.count("*").alias("n"))
    lost = used.join(parent.select(F.col(parent_key).alias("_ref")), "_ref", "left_anti")
    return lost.agg(F.sum("n").alias("n")).select(*_result(table.name, f"references({column})", F.col("n")))


def _unlinked(child: DataFrame, table: Table) -> DataFrame:
    """References that are NULL, all of a table in one scan."""
    counts = child.agg(*[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(table.references)])
    return _as_rules(counts, table, [f"linked({c})" for c in table.references])


def indexed(products: DataFrame, index: DataFrame) -> DataFrame:
    """Products without a row in the search index, and ids in the index that are no product: both ways in one join."""
    entries = index.select(F.col("product_id").alias("_entry")).distinct()
    both = products.select("product_id").join(entries, F.col("product_id") == F.col("_entry"), "full")
    alone = F.count_if(F.col("product_id").isNull() | F.col("_entry").isNull())
    return both.agg(alone.alias("n")).select(*_result("products", "indexed(product_id)", F.col("n")))


def audit(tables: dict[str, DataFrame], index: DataFrame | None = None) -> DataFrame:
    """``(table, rule, violations)`` for the declared constraints of the given tables.

    ``unique`` counts repeated keys; the other rules count rows. ``references`` skips NULLs, which ``linked`` counts.
    With the search ``index`` (token, product_id), ``indexed`` counts what only one of index and products has.
    """
    parts = []
    for name, df in tables.items():
        table = {**TABLES, **STATE_TABLES}[name]
        if table.required or "cast_errors" in df.columns:
            parts.append(_row_rules(df, table))
        if table.key:
            parts.append(_duplicates(df, table))
        if table.references:
            parts.append(_unlinked(df, table))
        for column, (parent, parent_key) in table.references.items():
            if parent in tables:
                parts.append(_orphans(df, table, column, tables[parent], parent_key))
    if index is not None and "products" in tables:
        parts.append(indexed(tables["products"], index))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
