"""Places in an order, for tables and groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.sources.checkpoint import cut


def positions(
    df: DataFrame, name: str, *order: Column, key: tuple[str, ...] = (), weight: str | None = None
) -> DataFrame:
    """``df`` with the place, from 1, of each row in ``order``: in the whole table, or among the rows of its ``key``.

    The rows are dealt to ranges of key and order. A place is that within the range, after the sizes of the ranges before,
    so no task holds a whole table or group; the ranges themselves are one row each. ``order`` must tell all rows of a
    key apart. Rows with a NULL in the key form one group. With ``weight`` a row takes as many places as that column says,
    and has the first of them.
    """
    keys = [F.col(k) for k in key]
    ranged = cut(df, "ranked").repartitionByRange(*keys, *order)
    ranged = cut(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    places = F.lit(1) if weight is None else F.col(weight)
    sizes = ranged.groupBy(*key, "_range").agg(F.sum(places).alias("_size"))
    before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select(
        *[F.col(k).alias(f"_{k}") for k in key], F.col("_range").alias("_at"), F.sum("_size").over(before).alias("_ahead")
    )
    same = F.col("_range") == F.col("_at")
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = Window.partitionBy(*key, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("_here", F.sum(places).over(inside) - places + 1).join(ahead, same)
    place = (F.col("_here") + F.coalesce("_ahead", F.lit(0))).cast("long")
    return placed.withColumn(name, place).drop("_here", "_range", "_at", "_ahead", *[f"_{k}" for k in key])
