"""Helpers of the training-data operators: table access, written intermediates, byte and word hashing, classes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"


def reach(spark: SparkSession) -> None:
    """Let local Python workers import this package from where the driver did; a cluster ships it with --py-files."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back: lineage ends at files every executor sees."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "spark-warehouse/checkpoints"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo; NULL for a NULL id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def in_ranges(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """``df`` written in ranges of key and order, with the number of each row's range in ``part``.

    A key of any size is spread over ranges whose numbers follow its order, so that no task needs all its rows."""
    ranged = df.repartitionByRange(F.col(key), *order)
    return cut(ranged.withColumn("part", F.spark_partition_id()), "ranges")


def positions(df: DataFrame, key: str, name: str, *order: Column) -> DataFrame:
    """``df`` with the place, from 1, of each row among those of its key: its place in its range of the key, after the
    sizes of the ranges before."""
    ranged = in_ranges(df, key, *order)
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(key, "part").agg(F.count("*").alias("size"))
    sizes = sizes.select(F.col(key).alias("_key"), F.col("part").alias("_part"), F.sum("size").over(before).alias("_ahead"))
    here = F.row_number().over(Window.partitionBy(key, "part").orderBy(*order))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("part") == F.col("_part"))
    return (
        ranged.withColumn(name, here.cast("long"))
        .join(sizes, same)
        .withColumn(name, F.col(name) + F.coalesce("_ahead", F.lit(0)))
        .drop("part", "_key", "_part", "_ahead")
    )


def text_key(column: str):
    """128 bits that stand for a text; NULL counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(column), F.lit("")).cast("binary")))


def blobs(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The UTF-8 bytes of a text column; NULL is empty."""
    return [b or b"" for b in batch.column(name).cast(pa.large_binary()).to_pylist()]


MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and their inverses, at least ``n`` of each."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 20)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = _tables[base] = (out[0], out[1])
    return have


def prefix_hash(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Prefix sums from which ``span_hash`` reads the hash of any span."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(len(values), base)[0][: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), base)[1][start])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _fold() -> np.ndarray:
    out = np.zeros(256, dtype=np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 128 or c.isalnum():
            out[b] = ord(c.lower()) if b < 128 else b
    return out


FOLD = _fold()


def words(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word: a run of ASCII letters, digits and non-ASCII bytes, ASCII case folded."""
    v = FOLD[np.frombuffer(buf, dtype=np.uint8)]
    inside = np.zeros(len(v) + 2, dtype=np.int8)
    inside[1:-1] = v != 0
    edges = np.flatnonzero(np.diff(inside))
    start, end = edges[::2], edges[1::2]
    return span_hash(prefix_hash(v), start, end), start, end


def word_chunks(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts in chunks of about ``size`` bytes: index of the first text, word hashes, and each text's word bounds."""
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) <= size):
            total += len(texts[j]) + 1
            j += 1
        h, start, _ = words(b"\n".join(texts[i:j]))
        begins = np.cumsum([0] + [len(t) + 1 for t in texts[i:j]])
        yield i, h, np.searchsorted(start, begins)
        i = j


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, y): each node of a task's edges and the least node of the class that these edges make."""
    above: dict = {}

    def top(node):
        while above[node] != node:
            above[node] = node = above[above[node]]
        return node

    schema = None
    for batch in batches:
        schema = batch.schema
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
            for node in (x, y):
                above.setdefault(node, node)
            x, y = top(x), top(y)
            above[max(x, y)] = min(x, y)
    nodes = list(above)
    for first in range(0, len(nodes), 10_000):
        part = nodes[first : first + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, schema.field("x").type), pa.array(map(top, part), schema.field("y").type)], names=["x", "y"])


def classes(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected classes of ``edges``: (node, root), root the least node of the class.

    Tasks first join the edges that they read to stars, again while half as many tasks can read these; where one can, its
    stars are the classes. Otherwise each round takes the least root among a node's neighbours and then jumps to that root's
    root; both steps combine before the shuffle, so a hub costs no more than its edges. Every round is a written table.
    """
    kind = edges.schema[a].dataType.simpleString()
    near, tasks = edges.select(F.col(a).alias("x"), F.col(b).alias("y")), None
    while True:
        near = cut(near.mapInArrow(stars, f"x {kind}, y {kind}"), "edges")
        before, tasks = tasks, near.rdd.getNumPartitions()
        if tasks <= 1:
            return cut(near.mapInArrow(stars, f"x {kind}, y {kind}").toDF("node", "root"), "roots")
        if before is not None and 2 * tasks > before:
            break
    ends = F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    both = cut(near.select(F.inline(ends)), "edges")
    roots = cut(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("root")), "roots")
    while True:
        near = (
            both.join(roots, both.y == roots.node).groupBy(F.col("x").alias("node")).agg(F.min("root").alias("near"))
        )
        low = roots.join(near, "node").select("node", F.least("root", "near").alias("via"), F.col("root").alias("old"))
        jump = roots.select(F.col("node").alias("via"), F.col("root").alias("next"))
        new = cut(
            low.join(jump, "via").select("node", F.least("via", "next").alias("root"), "old"),
            "roots",
        )
        roots = new.select("node", "root")
        if new.filter("root <> old").isEmpty():
            return roots


def edit_distance(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of two sequences, or ``most + 1`` if above ``most``: a band of 2 * most + 1 diagonals, whose
    differences between neighbouring cells are the bits of two integers that move one cell down per column."""
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    skip = 0
    while skip < min(len(a), len(b)) and a[skip] == b[skip]:
        skip += 1
    a, b = a[skip:], b[skip:]
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return max(len(a), len(b))
    n, m, width = len(a), len(b), 2 * most + 1
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << width) - 1
    # Bit k in column j is row j - most + k (rows from 1); bits of rows below 1 count as matching steps.
    plus, minus = full & ~((1 << most) - 1), 0
    if most == 0:
        plus = full
    score = most  # value in the lowest cell of the band in column 0 is row `most`
    for j in range(1, m + 1):
        low = j - most
        bits = where.get(b[j - 1], 0)
        eq = (bits >> (low - 1) if low >= 1 else bits << (1 - low)) & full
        d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        hp = minus | (full & ~(d0 | plus))
        hn = d0 & plus
        score += 0 if d0 >> (width - 1) & 1 else 1
        plus = hn | (full & ~((d0 >> 1) | hp))
        minus = (d0 >> 1) & hp
        last = (plus, minus, score)
    plus, minus, score = last
    # The lowest cell is row m + most; walk up the column to row n.
    for k in range(width - 1, n - (m - most) - 0, -1):
        if k <= 0:
            break
        score -= (plus >> (k - 1) & 1) - (minus >> (k - 1) & 1)
    return score if score <= most else most + 1


def best_match(item: list[int], region: list[int]) -> tuple[int, int]:
    """Least edit distance between ``item`` and any stretch of ``region``, and where that stretch ends."""
    where: dict[int, int] = {}
    for i, x in enumerate(item):
        where[x] = where.get(x, 0) | 1 << i
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, (m, 0)
    for j, x in enumerate(region, 1):
        eq = where.get(x, 0)
        d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        hp = minus | (full & ~(d0 | plus))
        hn = d0 & plus
        score += (1 if hp & top else 0) - (1 if hn & top else 0)
        hp, hn = hp << 1 & full, hn << 1 & full
        plus = hn | (full & ~(d0 | hp))
        minus = d0 & hp
        best = min(best, (score, j))
    return best
