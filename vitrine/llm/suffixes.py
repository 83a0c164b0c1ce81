"""Removal of repeated byte strings by sorted suffixes.

A byte goes if a string of ``LENGTH`` bytes covers it that starts anywhere else too, in the same text or another. Every
window of ``LENGTH`` bytes elects the least of its ``LEADING``-byte strings by a hash (the last of equal ones); equal
windows elect at equal offsets, so repeats show up among the elected places alone, about one in 170 bytes. The suffixes
at these places are sorted in three rounds, each on the tokens (128-bit or 64-bit hashes of stretches) that the round
before could not decide:

1. By the leading string, then by the whole stretch that windows electing the place can cover. Suffixes with an equal
   neighbour in both are repeats throughout; those with an equal neighbour in the first only are open.
2. Open places' windows in groups of ``GROUP`` neighbours, by the stretch common to the group's windows.
3. The single windows of groups whose common stretch has an equal neighbour, by their whole content.

Each sort is a range partition by sampled splitters; a bucket refines its order token by token where rows still tie, and
equal neighbours are found in the bucket and across its borders. Rows of one content are told apart by text and place,
so a content of any frequency is split over buckets.

NULL and texts under ``LENGTH`` bytes lose nothing. Equal texts repeat each other. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import blobs, cut, mix, prefix_hash, span_hash, text_key

LENGTH, LEADING, GROUP = 400, 64, 32
REACH = LENGTH - LEADING  # how far a window can begin before the place it elects
SECOND = 0xC2B2AE3D27D4EB4F | 1
#: Longest stretch read at once; longer texts are read in stretches that share LENGTH - 1 bytes.
STRETCH = 1 << 22


class Text:
    """Hashes of one text's stretches."""

    def __init__(self, raw: bytes):
        self.size = len(raw)
        values = np.frombuffer(raw, dtype=np.uint8)
        self.first, self.second = prefix_hash(values), prefix_hash(values, SECOND)

    def one(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return span_hash(self.first, start, end)

    def two(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return span_hash(self.second, start, end, SECOND)


def places(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elected places of a text, and the first and last start of the windows that elect each."""
    out = []
    for low in range(0, max(1, len(raw) - LENGTH + 1), STRETCH):
        out.append(elected(raw[low : low + STRETCH + LENGTH - 1], low))
    return tuple(np.concatenate(c) for c in zip(*out))


def elected(raw: bytes, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw) - LENGTH + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    start = np.arange(len(raw) - LEADING + 1)
    values = prefix_hash(np.frombuffer(raw, dtype=np.uint8))
    place = np.uint64((1 << 24) - 1)
    rank = (span_hash(values, start, start + LEADING) & ~place) | (place - start.astype(np.uint64))
    width = REACH + 1
    blocks = -(-len(rank) // width)
    grid = np.full(blocks * width, np.uint64((1 << 64) - 1))
    grid[: len(rank)] = rank
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    winner = (place - (least & place)).astype(np.int64)
    turn = np.flatnonzero(np.concatenate([[True], winner[1:] != winner[:-1]]))
    last = np.append(turn[1:] - 1, n - 1)
    return winner[turn] + low, turn + low, last + low


def refined(tokens: list[np.ndarray]) -> np.ndarray:
    """Order of the rows by several tokens; each further token is looked at only where rows tie so far."""
    order = np.argsort(tokens[0], kind="stable")
    group = np.cumsum(np.concatenate([[False], np.diff(tokens[0][order]) != 0])) if len(order) else order
    for token in tokens[1:]:
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        rows = order[tied]
        again = np.lexsort((token[rows], group[tied]))
        order[tied] = rows[again]
        value = token[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | ((size[group[1:]] > 1) & (value[1:] != value[:-1]))])
        group = np.cumsum(new) - 1
    return order


def runs(tokens: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Number of the run of equal tokens that each sorted row is in."""
    new = np.zeros(len(order), dtype=bool)
    for token in tokens:
        new[1:] |= token[order][1:] != token[order][:-1]
    return np.cumsum(new)


def sorted_buckets(df: DataFrame, tokens: list[str], schema: str, judge, names: list[str]) -> DataFrame:
    """Range-partitions ``df`` by its tokens and places and gives each bucket to ``judge(table, columns)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            bucket = pa.Table.from_batches(held)
            columns = [bucket.column(t).to_numpy() for t in tokens]
            order = refined(columns)
            out = judge(bucket, columns, order)
            for batch in out.combine_chunks().to_batches(max_chunksize=50_000):
                yield batch.select(names)

    return df.repartitionByRange(*tokens, "key", "place").mapInArrow(run, schema)


def first_round(docs: DataFrame, text: str) -> DataFrame:
    """(key, place, open, shown): places whose leading string may occur elsewhere. ``open`` places are undecided, the
    others are repeats; ``shown`` places take part in the next round, the open ones and one of each kind they may meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, parts = [], []
            for i, raw in enumerate(blobs(batch, "t")):
                if len(raw) < LENGTH:
                    continue
                text_of, (x, _, _) = Text(raw), places(raw)
                low, high = np.maximum(x - REACH, 0), np.minimum(x + LENGTH, len(raw))
                shape = ((x - low) * 1000 + (high - x)).astype(np.uint64)
                at.append(np.full(len(x), i))
                parts.append((text_of.one(x, x + LEADING), mix(text_of.one(low, high) + shape), mix(text_of.two(low, high) + shape), x))
            if at:
                a, b, c, x = (np.concatenate(p) for p in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v.view(np.int64)) for v in (a, b, c)] + [batch.column("key").take(pa.array(np.concatenate(at))), pa.array(x)],
                    names=["a", "b", "c", "key", "place"],
                )

    found = cut(
        docs.select(text_key(text).alias("key"), F.col(text).alias("t"))
        .filter(F.octet_length("t") >= LENGTH)
        .mapInArrow(run, "a bigint, b bigint, c bigint, key binary, place bigint"),
        "suffixes",
    )

    def judge(bucket: pa.Table, columns: list[np.ndarray], order: np.ndarray) -> pa.Table:
        lead, whole = runs(columns[:1], order), runs(columns, order)
        size = np.bincount(whole)[whole]
        begins = np.concatenate([[True], whole[1:] != whole[:-1]])
        kinds = np.bincount(lead, begins)[lead]
        rim = (lead == lead[0]) | (lead == lead[-1])  # may go on in the next bucket
        opened = size == 1
        shown = (opened | begins) & ((kinds > 1) | rim)
        keep = (size > 1) | (kinds > 1) | rim
        out = bucket.take(pa.array(order[keep]))
        return out.append_column("open", pa.array(opened[keep])).append_column("shown", pa.array(shown[keep]))

    return sorted_buckets(found, ["a", "b", "c"], "key binary, place bigint, open boolean, shown boolean", judge, ["key", "place", "open", "shown"])


def groups(raw: bytes, wanted: dict[int, tuple[bool, bool]]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Flat (first, last) starts of decided windows; and per group of undecided windows its first and last start and
    the hash of what they have in common."""
    x, first, last = places(raw)
    chosen = np.isin(x, list(wanted))
    x, first, last = x[chosen], first[chosen], last[chosen]
    opened = np.array([wanted[p][0] for p in x.tolist()], dtype=bool)
    shown = np.array([wanted[p][1] for p in x.tolist()], dtype=bool)
    done = np.stack([first[~opened], last[~opened]], axis=1).ravel().tolist()
    x, first, last = x[shown], first[shown], last[shown]
    low_group, high_group = (x - last) // GROUP, (x - first) // GROUP
    number = high_group - low_group + 1
    which = np.repeat(np.arange(len(x)), number)
    g = np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number) + low_group[which]
    begin = np.maximum(first[which], x[which] - g * GROUP - GROUP + 1)
    end = np.minimum(last[which], x[which] - g * GROUP)
    common = x[which] - g * GROUP
    h = Text(raw).one(common, common + LENGTH - GROUP + 1)
    return done, begin, end, mix(h + g.astype(np.uint64))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans that cover the given ones; spans that touch are one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], np.append(reach[:-1][new[1:]], reach[-1])


def removed(raw: bytes, windows: list[tuple[int, int]]) -> tuple[int, int, str]:
    """(bytes removed, spans, digest of the rest) for first and last starts of repeated windows."""
    flat = np.array(windows, dtype=np.int64).reshape(-1, 2)
    starts, ends = merged(flat[:, 0], flat[:, 1] + LENGTH)
    rest, at = hashlib.sha256(), 0
    for s, e in zip(starts.tolist(), ends.tolist()):
        rest.update(raw[at:s])
        at = e
    rest.update(raw[at:])
    return int((ends - starts).sum()), len(starts), rest.hexdigest()


RESULT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of ``docs``."""
    kind = docs.schema[doc_id].dataType.simpleString()
    per_place = first_round(docs, text).groupBy("key", "place").agg(
        F.min("open").alias("open"), F.max("shown").alias("shown")
    )
    per_text = per_place.groupBy("key").agg(F.collect_list(F.struct("place", "open", "shown")).alias("places"))
    joined = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"), text_key(text).alias("key")).join(
        per_text, "key", "left"
    )

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(10)]
            for raw, key, wanted in zip(blobs(batch, "t"), batch.column("key").to_pylist(), batch.column("places")):
                known = {p["place"]: (p["open"], p["shown"]) for p in wanted.as_py() or ()}
                done, begin, end, common = groups(raw, known) if known else ([], *([np.zeros(0, np.int64)] * 3))
                ready = not len(begin)
                values = removed(raw, list(zip(done[::2], done[1::2]))) if ready else (None, None, None)
                held = (None, None) if ready else (key, raw)
                lists = (done, begin.tolist(), end.tolist(), common.view(np.int64).tolist())
                for column, value in zip(out, (len(raw), *values, *held, *lists), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()] + [pa.list_(pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column("d"), *(pa.array(c, k) for c, k in zip(out, kinds))], names=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "key", "raw", "done", "begin", "end", "common"]
    state = cut(
        joined.mapInArrow(
            second,
            f"doc_id {kind}, {RESULT}, key binary, raw binary, done array<bigint>, begin array<bigint>, end array<bigint>, common array<bigint>",
        ),
        "judged",
    )
    waiting = state.filter("key is not null")

    def near(bucket: pa.Table, columns: list[np.ndarray], order: np.ndarray) -> pa.Table:
        run = runs(columns, order)
        keep = (np.bincount(run)[run] > 1) | (run == run[0]) | (run == run[-1])
        return bucket.take(pa.array(order[keep]))

    commons = cut(
        waiting.select("key", F.explode(F.arrays_zip("common", "begin", "end")).alias("g"))
        .select(F.col("g.common").alias("a"), "key", F.col("g.begin").alias("place"), F.col("g.end").alias("end"))
        .distinct(),
        "commons",
    )
    alike = sorted_buckets(commons, ["a"], "key binary, place bigint, end bigint", near, ["key", "place", "end"])
    per_text = alike.groupBy("key").agg(F.collect_list(F.struct("place", "end")).alias("groups"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, parts = [], []
            for i, (raw, found) in enumerate(zip(blobs(batch, "raw"), batch.column("groups").to_pylist())):
                p = np.concatenate([np.arange(g["place"], g["end"] + 1) for g in found])
                content = Text(raw)
                at.append(np.full(len(p), i))
                parts.append((content.one(p, p + LENGTH), content.two(p, p + LENGTH), p))
            if at:
                a, b, p = (np.concatenate(c) for c in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), batch.column("key").take(pa.array(np.concatenate(at))), pa.array(p)],
                    names=["a", "b", "key", "place"],
                )

    one_each = waiting.dropDuplicates(["key"])
    single = cut(
        one_each.select("key", "raw").join(per_text, "key").mapInArrow(windows, "a bigint, b bigint, key binary, place bigint"),
        "windows",
    )

    def equal(bucket: pa.Table, columns: list[np.ndarray], order: np.ndarray) -> pa.Table:
        run = runs(columns, order)
        repeats = np.bincount(run)[run] > 1
        rim = np.zeros(len(order), dtype=np.int64)
        rim[0], rim[-1] = 1, 2 if len(order) > 1 else 3
        keep = repeats | (rim > 0)
        out = bucket.take(pa.array(order[keep]))
        part = TaskContext.get().partitionId()
        inner = rim[keep] == 0  # only the rows at the rim are compared again
        for name in ("a", "b"):
            place = out.schema.get_field_index(name)
            out = out.set_column(place, name, pa.array(out.column(name).to_numpy(), mask=inner))
        return (
            out.append_column("repeats", pa.array(repeats[keep]))
            .append_column("rim", pa.array(rim[keep]))
            .append_column("part", pa.array(np.full(len(out), part)))
        )

    judged = cut(
        sorted_buckets(
            single, ["a", "b"],
            "a bigint, b bigint, key binary, place bigint, repeats boolean, rim bigint, part bigint",
            equal, ["a", "b", "key", "place", "repeats", "rim", "part"],
        ),
        "repeats",
    )
    rims = judged.filter("rim > 0").select("part", "rim", "a", "b").collect()  # two rows of each bucket
    firsts = sorted((r for r in rims if r.rim in (1, 3)), key=lambda r: r.part)
    lasts = sorted((r for r in rims if r.rim in (2, 3)), key=lambda r: r.part)
    met = {(x.a, x.b) for x, y in zip(lasts, firsts[1:]) if (x.a, x.b) == (y.a, y.b)}
    also = F.lit(False)
    for a, b in sorted(met):
        also = also | ((F.col("a") == a) & (F.col("b") == b))
    hits = (
        judged.filter(F.col("repeats") | ((F.col("rim") > 0) & also))
        .groupBy("key")
        .agg(F.collect_list("place").alias("hits"))
    )

    def third(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for raw, done, found in zip(blobs(batch, "raw"), batch.column("done").to_pylist(), batch.column("hits").to_pylist()):
                spans = list(zip(done[::2], done[1::2])) + [(p, p) for p in found or ()]
                for column, value in zip(out, removed(raw, spans)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
                names=names[:5],
            )

    late = waiting.select("key", "doc_id", "n_bytes", "raw", "done").join(hits, "key", "left").mapInArrow(third, f"doc_id {kind}, {RESULT}")
    return state.filter("key is null").select(*names[:5]).unionByName(late)
