"""Nested lists of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE_ROWS = 1000


def paged_lists(rows: DataFrame, key: str, columns: list[str], name: str, page_rows: int = PAGE_ROWS) -> DataFrame:
    """``(key, page, pages, name)``: the rows of each key as sorted arrays of about ``page_rows`` elements.

    A key with few rows gets one page with all of them. A large key is spread over several pages by a
    hash of the row, and a row that occurs very often over several blocks, so no task or array ever
    holds a whole large group and nothing is dropped. Equal rows are counted before the shuffle.
    """
    counted = rows.groupBy(key, *columns).agg(F.count("*").alias("_n"))
    totals = counted.groupBy(key).agg(F.sum("_n").alias("_total"))
    blocks = counted.withColumn("_block", F.explode(F.expr(f"sequence(0L, (_n - 1) div {page_rows})"))).withColumn(
        "_copies", F.least(F.lit(page_rows), F.col("_n") - F.col("_block") * page_rows).cast("int")
    )
    pages = F.expr(f"(_total + {page_rows - 1}) div {page_rows}")
    return (
        blocks.join(totals, key)
        .withColumn("pages", pages)
        .withColumn("page", F.pmod(F.xxhash64(*columns, "_block"), F.col("pages")))
        .groupBy(key, "page", "pages")
        .agg(
            F.flatten(
                F.transform(
                    F.sort_array(F.collect_list(F.struct(*columns, "_block", "_copies"))),
                    lambda r: F.array_repeat(F.struct(*[r[c].alias(c) for c in columns]), r["_copies"]),
                )
            ).alias(name)
        )
    )
