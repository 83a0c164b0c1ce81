"""Exact top-k by inner product from sorted lists alone (aggregation without random access).

Components are integers, floor(scale * x). Equal vectors are one candidate, named by their least id. Candidates are dealt
to shards; a shard is one row of a written table that holds, per dimension, its candidates in the order of that
component. Queries are the distinct vectors of the query rows, in blocks; every block meets every shard.

In a shard the queries of a block read the lists of all dimensions together, each from its better end. What is read of a
candidate adds to its sum; what is not yet read is, list by list, no better than the entry just read, and altogether
within the product of the unread lengths of query and candidate (a list entry carries its candidate's whole length). That
gives each candidate, read or not, a lower and an upper bound. A query stops reading once all but ``HOLD`` k candidates are
bound below its k-th lower bound; their scores are then resolved in full. The best of all shards are merged
per query, copies are put back, and a query's own id is left out.

Vectors that are NULL or hold NULL, NaN or infinite components take no part, nor do rows without id. Shorter vectors count
as filled up with zeros, so empty vectors score 0. Repeated rows of one id and vector are one row; an id with several
vectors is several candidates and, as a query, gets a list for each. Ties go to smaller ids. Scores beyond 64 bits are an
error. An empty table, or one without query rows, gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import cut

SCALE = 1024
#: Candidates of a shard, queries of a block, blocks that one task reads at most.
SHARD, BLOCK, BLOCKS = 4096, 256, 16
#: Shares of the lists after which bounds are compared.
DEPTHS = (0.5, 0.7, 0.85, 1.0)
#: Candidates still in the running, as a multiple of k, at which their scores are resolved.
HOLD = 4

PACKED = "number bigint, ids binary, kind string, size bigint, width bigint, order_ binary, matrix binary"


def vectors(df: DataFrame, id_column: str, column: str, scale: int = SCALE) -> DataFrame:
    """Distinct ``(vec_id, v)`` of the rows that take part, components as integers."""
    x = F.col(f"`{column}`").cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    usable = F.col(f"`{id_column}`").isNotNull() & x.isNotNull() & finite
    whole = F.transform(x, lambda e: F.floor(e * scale))
    return df.where(usable).select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), whole.alias("v")).distinct()


def matrix_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a batch, one row each, filled up with zeros."""
    column = batch.column("v")
    bounds = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.int64)[bounds[0] : bounds[-1]]
    sizes = np.diff(bounds)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return batch.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64), out


def stacked(parts: list[np.ndarray]) -> np.ndarray:
    width = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])


def narrow(values: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    low, high = int(values.min(initial=0)), int(values.max(initial=0))
    for kind in (np.int16, np.int32):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return values.astype(kind)
    return values


def packed(rows: DataFrame, size: int, sort: bool) -> DataFrame:
    """``rows`` (vec_id, v) in groups of at most ``size``: one row per group. With ``sort`` it holds the sorted lists."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0

        def flush():
            all_ids, x = np.concatenate(ids), stacked(parts)
            for low in range(0, len(all_ids), size):
                yield group(all_ids[low : low + size], x[low : low + size])

        def group(some: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(x, axis=0, kind="stable").T if sort else np.zeros((0, 0))
            values = narrow(np.take_along_axis(x.T, order, 1) if sort else x)
            row = [int(some[0]), some.tobytes(), values.dtype.str, len(some), x.shape[1]]
            row += [order.astype(np.uint16).tobytes(), values.tobytes()]
            kinds = [pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            names = [c.split()[0] for c in PACKED.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, kinds)], names=names)

        for batch in batches:
            if batch.num_rows:
                some, x = matrix_of(batch)
                ids.append(some)
                parts.append(x)
                held += len(some)
            if held >= size:
                yield from flush()
                ids, parts, held = [], [], 0
        if held:
            yield from flush()

    return rows.mapInArrow(pack, PACKED)


class Lists:
    """A shard's sorted lists, read from both ends: the better end of a list depends on the sign of a query's component."""

    def __init__(self, order: np.ndarray, values: np.ndarray, squares: np.ndarray):
        self.order, self.values, self.squares = order, values.astype(float), squares
        self.size = len(squares)

    def read(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What stands in the first ``depth`` places, from the upper ends and from the lower ends: whether a candidate
        was met (a row per list, a column per candidate), its component there, and the component at the last place."""
        width = len(self.order)
        met = np.zeros((2 * width, self.size))
        held = np.zeros((2 * width, self.size))
        ends = ((slice(self.size - depth, None), self.size - depth), (slice(0, depth), depth - 1))
        front = []
        for half, (places, last) in enumerate(ends):
            rows = slice(half * width, (half + 1) * width)
            np.put_along_axis(met[rows], self.order[:, places], 1.0, 1)
            np.put_along_axis(held[rows], self.order[:, places], self.values[:, places], 1)
            front.append(self.values[:, last])
        return met, held, np.concatenate(front)


def survivors(queries: np.ndarray, lists: Lists, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each query, the candidates that may be among its ``k`` best, and how deep its lists were read."""
    size = lists.size
    out = [np.arange(size)] * len(queries)
    depths = np.zeros(len(queries), dtype=np.int64)
    if size <= HOLD * k or queries.shape[1] == 0:
        return out, depths
    q = queries.astype(float)
    signed = np.hstack([np.maximum(q, 0), np.minimum(q, 0)])  # by the end that a list is read from
    total = (q * q).sum(axis=1)
    slack = 1e-9 * (1 + np.sqrt(total * lists.squares.max()))
    open_ = np.flatnonzero(total > 0)
    for share in DEPTHS:
        if len(open_) == 0:
            break
        depth = max(1, int(share * size))
        met, held, front = lists.read(depth)
        s = signed[open_]
        seen = s @ held
        ahead = s * front
        ahead = ahead.sum(axis=1, keepdims=True) - ahead @ met  # lists not yet read, at their best
        left = np.maximum(total[open_, None] - (s * s) @ met, 0)
        left *= np.maximum(lists.squares - (s != 0).astype(float) @ (held * held), 0)
        angle = np.sqrt(left)
        lower = seen - angle
        bound = np.partition(lower, size - k, axis=1)[:, size - k] - 2 * slack[open_]
        alive = seen + np.minimum(ahead, angle) >= bound[:, None]
        done = alive.sum(axis=1) <= HOLD * k
        if depth == size:
            done[:] = True
        for i in np.flatnonzero(done):
            out[open_[i]] = np.flatnonzero(alive[i])
        depths[open_] = depth
        open_ = open_[~done]
    return out, depths


def resolved(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact products of ``q`` with the rows of ``x``."""
    if np.sqrt((q.astype(float) ** 2).sum() * (x.astype(float) ** 2).sum(axis=1).max(initial=0)) < 2.0**62:
        return x @ q
    exact = [sum(int(a) * int(b) for a, b in zip(row, q)) for row in x]
    if any(not -(2**63) <= s < 2**63 for s in exact):
        raise OverflowError("a score does not fit 64 bits")
    return np.array(exact, dtype=np.int64)


def best_of_shards(k: int):
    """The ``k`` best candidates of each query of a block in a shard: (query, vec_id, score) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                shape = (row["width"], row["size"])
                order = np.frombuffer(row["order_"], np.uint16).reshape(shape).astype(np.int64)
                values = np.frombuffer(row["matrix"], row["kind"]).reshape(shape).astype(np.int64)
                asked = np.frombuffer(row["q_ids"], np.int64)
                queries = np.frombuffer(row["q_matrix"], row["q_kind"]).reshape(row["q_size"], row["q_width"])
                width = min(shape[0], queries.shape[1])
                order, values = order[:width], values[:width]
                x = np.zeros((row["size"], width), dtype=np.int64)
                np.put_along_axis(x.T, order, values, 1)
                squares = (x.astype(float) ** 2).sum(axis=1)
                queries = queries[:, :width].astype(np.int64)
                out = []
                for number, q, alive in zip(asked, queries, survivors(queries, Lists(order, values, squares), k)[0]):
                    scores = resolved(q, x[alive])
                    first = np.lexsort((ids[alive], -scores))[:k]
                    out.append((np.full(len(first), number), ids[alive][first], scores[first]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], names=["query", "vec_id", "score"]
                )

    return run


def search(
    df: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", column: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` other rows of largest integer inner product for each row that
    meets ``is_query``, a condition on ``vec_id``."""
    rows = cut(vectors(df, id_column, column, scale), "vectors")
    same = Window.partitionBy("v").orderBy("vec_id")
    # A query's own id may be among its best: k + 1 are enough, of copies too.
    ranked = rows.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1)
    members = cut(ranked.withColumn("first", F.min("vec_id").over(Window.partitionBy("v"))), "members")
    candidates = members.where("copy = 1").select("vec_id", "v")
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v")
    queries = cut(asked.join(candidates, "v").select("query_id", F.col("vec_id").alias("query")), "queries")

    lists = cut(packed(candidates, SHARD, sort=True), "lists")
    kept = candidates.join(queries.select("query").distinct(), F.col("vec_id") == F.col("query"), "left_semi")
    blocks = cut(packed(kept, BLOCK, sort=False), "blocks")
    slots, groups = max(1, lists.count()), max(1, -(-blocks.count() // BLOCKS))
    asked_blocks = blocks.select(
        *[F.col(c).alias(f"q_{c}") for c in ("ids", "kind", "size", "width", "matrix")],
        F.pmod(F.xxhash64("number"), F.lit(groups)).alias("group"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("slot"),
    )
    shards = lists.select(
        "*",
        F.pmod(F.xxhash64("number"), F.lit(slots)).alias("slot"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"),
    ).repartition(slots * groups, "slot", "group")
    met = shards.join(asked_blocks, ["slot", "group"])
    found = cut(met.mapInArrow(best_of_shards(k + 1), "query bigint, vec_id bigint, score bigint"), "found")

    better = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(better)).where(F.col("rank") <= k + 1).drop("rank")
    copies = members.select(F.col("first").alias("named"), F.col("vec_id").alias("copy_id"))
    whole = best.join(copies, best.vec_id == copies.named).select("query", F.col("copy_id").alias("vec_id"), "score")
    whole = whole.withColumn("rank", F.row_number().over(better)).where(F.col("rank") <= k + 1).drop("rank")
    answers = queries.join(whole, "query").where("vec_id <> query_id")
    final = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return (
        answers.withColumn("rank", F.row_number().over(final))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
