"""Language-model scores from Brown word classes.

A text is its words (runs of anything but ASCII white space, A-Z lowered) and one end token. All counts are over all
training texts. Words begin in classes by byte length, the ``LEADING`` most frequent in ``CLASSES`` further ones; the end
has a class of its own. Every word moves to the class that raises the mutual information of neighbouring classes most:
the leading words in turn, in ``SWEEPS`` sweeps; then all other words of the vocabulary at once, each against the classes
its neighbours had before, as in distributed exchange (a word beside itself is beside its former class). Words that
training lacks stay in the class of their length. The model multiplies the transition between neighbouring classes,
add-one smoothed, with the emission (c + 1) / (N + V + 1) of the word in its class, where N and V are the class's tokens
and words in training; the one is for all unseen words of the class.

Counts and classes of the words that are frequent (at most ``KNOWN`` words) travel to the tasks; each document's other
words meet theirs in a join, so no task holds the vocabulary.

NULL counts as an empty text: its one token is the end. Rows without an id neither train nor are held out. With no
training rows every probability is that of unseen words.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat
from operator import neg

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import blobs, cut

KNOWN, LEADING, CLASSES, SWEEPS = 150_000, 512, 32, 4
#: Classes by byte length: 1 to 15, and longer.
SIZES = 16
#: Distinct words, and words in all, that a task counts before it passes them on.
HOLD, HELD = 300_000, 1_500_000


def tokens(raw: bytes) -> list[bytes]:
    return raw.lower().split()  # on bytes, both are ASCII only


def count(docs: DataFrame, text: str) -> DataFrame:
    """(token, c) over ``docs``; the end token is NULL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        ends = 0

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([*held, None], pa.binary()), pa.array([*held.values(), ends], pa.int64())], names=["token", "n"]
            )

        for batch in batches:
            for raw in blobs(batch, "t"):
                held.update(tokens(raw))
                ends += 1
                if len(held) > HOLD:
                    yield passed()
                    held, ends = Counter(), 0
        yield passed()

    found = docs.select(F.col(text).alias("t")).mapInArrow(run, "token binary, n bigint")
    return found.groupBy("token").agg(F.sum("n").alias("c")).filter("c > 0")


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words in order, at most ``most``: those above a count that few enough words reach."""
    level = F.floor(F.log2("c") * 16)
    bins = counts.filter("token is not null").groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("c"))
    total, least = 0, None
    for row in sorted(bins.collect(), key=lambda r: -r.level):
        total += row.n
        if total > most:
            break
        least = row.c
    if least is None:
        return []
    rows = counts.filter((F.col("c") >= least) & F.col("token").isNotNull()).collect()
    return sorted(((bytes(r.token), r.c) for r in rows), key=lambda x: (-x[1], x[0]))


def pairs(docs: DataFrame, top: list[bytes], text: str) -> np.ndarray:
    """Counts of neighbouring symbols in all texts: the leading words, the length classes, and the rim of a text."""
    rim = len(top) + SIZES
    shared = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(top)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, size = shared.value.get, rim + 1
        total = np.zeros(size * size, dtype=np.int64)
        for batch in batches:
            for raw in blobs(batch, "t"):
                words = tokens(raw)
                s = np.full(len(words) + 2, rim, dtype=np.int64)
                s[1:-1] = list(map(get, words, map(neg, map(len, words))))
                s[s < 0] = len(shared.value) - 1 + np.minimum(-s[s < 0], SIZES)
                np.add.at(total, s[:-1] * size + s[1:], 1)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "n"])

    rows = (
        docs.select(F.col(text).alias("t")).mapInArrow(run, "code bigint, n bigint")
        .groupBy("code").agg(F.sum("n").alias("n")).collect()
    )
    out = np.zeros((rim + 1) ** 2, dtype=np.float64)
    for r in rows:
        out[r.code] = r.n
    return out.reshape(rim + 1, rim + 1)


def weight(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(between: np.ndarray, n: int) -> np.ndarray:
    """Class of each symbol; the first ``n`` symbols are moved between classes, the others keep one each."""
    size = len(between)
    k = min(CLASSES, n)
    of = np.concatenate([np.arange(n) % max(1, k), k + np.arange(size - n)])
    total = k + size - n
    after, before = np.zeros((size, total)), np.zeros((size, total))  # counts of a word with each class
    np.add.at(after.T, of, between.T)
    np.add.at(before.T, of, between)
    joint = np.zeros((total, total))
    np.add.at(joint, of, after)
    own = np.arange(k)
    for _ in range(SWEEPS):
        moved = False
        for w in range(n):
            old, self = of[w], between[w, w]
            out, into = after[w].copy(), before[w].copy()
            out[old] -= self
            into[old] -= self
            joint[old] -= out
            joint[:, old] -= into
            joint[old, old] -= self
            rows, cols = joint.sum(axis=1), joint.sum(axis=0)
            gain = (weight(joint[:k] + out) - weight(joint[:k])).sum(axis=1)
            gain += (weight(joint[:, :k] + into[:, None]) - weight(joint[:, :k])).sum(axis=0)
            cell = joint[own, own]
            gain -= weight(cell + out[:k]) + weight(cell + into[:k]) - 2 * weight(cell)
            gain += weight(cell + out[:k] + into[:k] + self) - weight(cell)
            gain -= weight(rows[:k] + out.sum() + self) - weight(rows[:k])
            gain -= weight(cols[:k] + into.sum() + self) - weight(cols[:k])
            best = int(gain.argmax())
            if gain[best] <= gain[old] + 1e-9:
                best = old
            if best != old:
                of[w], moved = best, True
                for table, counts in ((after, between[:, w]), (before, between[w])):
                    table[:, old] -= counts
                    table[:, best] += counts
            joint[best] += out
            joint[:, best] += into
            joint[best, best] += self
        if not moved:
            break
    return of


def neighbours(docs: DataFrame, start: dict[bytes, int], first: int, text: str) -> DataFrame:
    """(token, packed): how often each word that is not in ``start`` stands before and after each class, as 32-bit pairs
    of code and count. ``first`` is the class of length 1; codes are classes after the word, then classes before it."""
    rim = first + SIZES
    shared = docs.sparkSession.sparkContext.broadcast(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, width = shared.value.get, 2 * (rim + 1)
        ids: defaultdict = defaultdict()
        ids.default_factory = ids.__len__
        held, size = [], 0

        def passed() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate([*held, np.zeros(0, np.int64)]), return_counts=True)
            data = np.stack([code % width, n], axis=1).astype(np.int32)
            ends = np.searchsorted(code, np.arange(len(ids) + 1) * width) * 8
            packed = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
            return pa.RecordBatch.from_arrays([pa.array(list(ids), pa.binary()), packed.cast(pa.binary())], names=["token", "packed"])

        for batch in batches:
            for raw in blobs(batch, "t"):
                words = tokens(raw)
                s = np.full(len(words) + 2, rim, dtype=np.int64)
                s[1:-1] = list(map(get, words, map(neg, map(len, words))))
                at = np.flatnonzero(s < 0)
                s[at] = first - 1 + np.minimum(-s[at], SIZES)
                row = np.array([ids[words[i]] for i in (at - 1).tolist()], dtype=np.int64) * width
                held += [row + s[at + 1], row + rim + 1 + s[at - 1]]
                size += len(at)
                if len(ids) > HOLD or size > HELD:
                    yield passed()
                    ids.clear()
                    held, size = [], 0
        yield passed()

    found = docs.select(F.col(text).alias("t")).mapInArrow(run, "token binary, packed binary")
    return found.groupBy("token").agg(F.collect_list("packed").alias("packed"))


def moved(row: np.ndarray, code: np.ndarray, n: np.ndarray, old: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """Class that each word moves to from its class ``old``, given its counts ``n`` by word ``row`` and ``code``, in that
    order and each once; the last class of ``joint`` takes no words."""
    size, words = len(joint), len(old)
    k = size - 1
    own = np.arange(k)
    sides = np.zeros((2, words, size))
    sides[code // size, row, code % size] = n
    gain = np.zeros((words, k))
    for side, table in ((0, joint), (1, joint.T)):
        here = code // size == side
        r, j, c = row[here], code[here] % size, n[here, None]
        cell = table[:k, j].T - c * (own == old[r, None])  # without the word itself
        cell = np.maximum(cell - sides[1 - side][r, :k] * (j == old[r])[:, None], 0)
        if len(r):
            starts = np.flatnonzero(np.diff(r, prepend=-1))
            gain[r[starts]] += np.add.reduceat(weight(cell + c) - weight(cell), starts)
        total = table.sum(axis=1)[:k] - sides[side].sum(axis=1)[:, None] * (own == old[:, None])
        gain -= weight(total + sides[side].sum(axis=1)[:, None]) - weight(np.maximum(total, 0))
    out, into = sides[0][:, :k], sides[1][:, :k]
    r, c = np.nonzero((out > 0) & (into > 0))  # both meet in the cell of the class with itself
    x, y = out[r, c], into[r, c]
    cell = np.maximum(joint[c, c] - (x + y) * (c == old[r]), 0)
    np.add.at(gain, (r, c), weight(cell + x + y) - weight(cell + x) - weight(cell + y) + weight(cell))
    best = gain.argmax(axis=1)
    at = np.arange(words)
    return np.where(gain[at, best] > gain[at, old] + 1e-9, best, old)


def assigned(near: DataFrame, joint: np.ndarray, first: int) -> DataFrame:
    """(token, c, class) of ``neighbours``."""
    shared = near.sparkSession.sparkContext.broadcast(joint)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 10_000):
                part = batch.slice(low, 10_000)
                packed, owner = part.column("packed").flatten(), pc.list_parent_indices(part.column("packed")).to_numpy()
                data = np.frombuffer(b"".join(packed.to_pylist()), dtype=np.int32).reshape(-1, 2).astype(np.int64)
                row = np.repeat(owner, pc.binary_length(packed).to_numpy() // 8)
                lengths = pc.binary_length(part.column("token")).to_numpy().astype(np.int64)
                old = first - 1 + np.minimum(lengths, SIZES)
                code, n = data[:, 0], data[:, 1].astype(np.float64)
                whole, at = np.unique(row * 2 * len(shared.value) + code, return_inverse=True)
                n = np.bincount(at, n)
                row, code = np.divmod(whole, 2 * len(shared.value))
                c = np.bincount(row, n * (code < len(shared.value)), len(old)).astype(np.int64)
                of = moved(row, code, n, old, shared.value)
                yield pa.RecordBatch.from_arrays([part.column("token"), pa.array(c), pa.array(of)], names=["token", "c", "class"])

    return near.mapInArrow(run, "token binary, c bigint, class bigint")


class Words:
    """Counts and classes of frequent words; the class of length 1, and how often a text ends."""

    def __init__(self, known: list[tuple[bytes, int]], of: dict[bytes, int], first: int, ends: int):
        self.index = {w: i for i, (w, _) in enumerate(known)}
        self.of = np.array([of[w] for w, _ in known], dtype=np.int64)
        self.logs = np.log10(np.array([c for _, c in known], dtype=np.float64) + 1)
        self.first, self.ends = first, ends


def encoded(docs: DataFrame, training: Column, words: DataFrame, frequent_words: Words, text: str, doc_id: str) -> DataFrame:
    """doc_id, learn, n_tokens, n_known, logs, of: the sum of log10(c + 1) and the classes of the words of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_words)
    kind = docs.schema[doc_id].dataType.simpleString()

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        get = m.index.get
        for batch in batches:
            columns: list[list] = [[] for _ in range(5)]
            for raw in blobs(batch, "t"):
                here = tokens(raw)
                ids = np.array(list(map(get, here, repeat(-1))), dtype=np.int64)
                of = m.of[ids] if len(m.of) else ids.copy()
                rare = np.flatnonzero(ids < 0)
                strange: defaultdict = defaultdict()
                strange.default_factory = strange.__len__
                of[rare] = [-1 - strange[here[i]] for i in rare.tolist()]
                columns[0].append(len(here) + 1)
                columns[1].append(len(here) - len(rare) + (m.ends > 0))
                columns[2].append(float(m.logs[ids[ids >= 0]].sum()) + math.log10(m.ends + 1))
                columns[3].append(of.astype(np.int32))
                columns[4].append(list(strange))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("d"), batch.column("learn"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "learn", "n_tokens", "n_known", "logs", "of", "tail"],
            )

    def flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Values of all lists, where each list begins in them, and how many it has."""
        values, n = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        return values, np.cumsum(n) - n, n

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            words, begins, lengths = flat(batch.column("of"))
            tail, places, _ = flat(batch.column("tail"))
            found, _, found_n = flat(batch.column("found"))
            of = words.to_numpy().copy()
            classes = m.first - 1 + np.minimum(pc.binary_length(tail).to_numpy(zero_copy_only=False), SIZES)
            c = np.zeros(len(tail), dtype=np.int64)
            k, count_, class_ = (x.to_numpy(zero_copy_only=False) for x in found.flatten())
            at = np.repeat(places, found_n) + k
            classes[at], c[at] = class_, count_
            rare = np.flatnonzero(of < 0)
            row = np.repeat(np.arange(len(lengths)), lengths)[rare]
            which = places[row] - 1 - of[rare]
            of[rare] = classes[which]
            known = batch.column("n_known").to_numpy() + np.bincount(row[c[which] > 0], minlength=len(lengths))
            logs = batch.column("logs").to_numpy() + np.bincount(row, np.log10(c[which] + 1), len(lengths))
            out = pa.ListArray.from_arrays(pa.array(np.append(begins, len(of)).astype(np.int32)), pa.array(of))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in ("doc_id", "learn", "n_tokens")), pa.array(known), pa.array(logs), out],
                names=["doc_id", "learn", "n_tokens", "n_known", "logs", "of"],
            )

    facts = f"doc_id {kind}, learn boolean, n_tokens bigint, n_known bigint, logs double, of array<int>"
    first = cut(
        docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"), F.coalesce(training, F.lit(False)).alias("learn"))
        .mapInArrow(common, facts + ", tail array<binary>")
        .withColumn("row", F.monotonically_increasing_id()),
        "encoded",
    )
    tail = first.select("row", F.posexplode("tail").alias("k", "token")).join(words, "token")
    found = tail.groupBy("row").agg(F.collect_list(F.struct("k", "c", "class")).alias("found"))
    return cut(first.join(found, "row", "left").drop("row").mapInArrow(whole, facts), "classes")


def transitions(docs: DataFrame, size: int) -> np.ndarray:
    """Counts of neighbouring classes of ``encoded`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, dtype=np.int64)
        for batch in batches:
            for of in batch.column("of"):
                s = np.full(len(of) + 2, size - 1, dtype=np.int64)
                s[1:-1] = of.values.to_numpy()
                total += np.bincount(s[:-1] * size + s[1:], minlength=size * size)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "n"])

    out = np.zeros(size * size, dtype=np.float64)
    for r in docs.select("of").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r.code] = r.n
    return out.reshape(size, size)


def scores(docs: DataFrame, training: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row of ``docs``, learnt from the
    rows where ``training`` holds."""
    spark = docs.sparkSession
    learn = docs.filter(training)
    counts = cut(count(learn, text), "counts")
    n, v, ends = counts.agg(F.sum("c"), F.count("*"), F.max(F.when(F.col("token").isNull(), F.col("c")))).first()
    n, v, ends = n or 0, v or 0, ends or 0
    known = frequent(counts, KNOWN)
    top = [w for w, _ in known[:LEADING]]
    between = pairs(learn, top, text)
    of = exchange(between, len(top))
    size = int(of.max()) + 1
    first = size - SIZES - 1
    half = np.zeros((size, len(between)))
    np.add.at(half, of, between)
    joint = np.zeros((size, size))
    np.add.at(joint.T, of, half.T)
    start = {w: int(k) for w, k in zip(top, of)}
    words = cut(assigned(neighbours(learn, start, first, text), joint, first), "words")
    least = known[-1][1] if known else 0
    classes = {bytes(r.token): r["class"] for r in words.filter(F.col("c") >= least).select("token", "class").collect()} if known else {}
    frequent_words = Words(known, {**classes, **start}, first, ends)
    rows = encoded(docs, training, words, frequent_words, text, doc_id)
    trans = transitions(rows.filter("learn"), size)
    log_trans = np.log10((trans + 1) / (trans.sum(axis=1, keepdims=True) + size))
    total, kinds = np.zeros(size), np.zeros(size)
    np.add.at(total, of[: len(top)], [c for _, c in known[: len(top)]])
    np.add.at(kinds, of[: len(top)], 1)
    for r in words.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        total[r["class"]] += r.c
        kinds[r["class"]] += r.v
    shared = spark.sparkContext.broadcast((log_trans, np.log10(total + kinds + 1)))  # and an emission's denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_trans, floor = shared.value
        for batch in batches:
            model = []
            for of in batch.column("of"):
                s = np.full(len(of) + 2, size - 1, dtype=np.int64)
                s[1:-1] = of.values.to_numpy()
                model.append(float(log_trans[s[:-1], s[1:]].sum() - floor[s[1:-1]].sum()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "n_tokens", "n_known", "logs")), pa.array(model, pa.float64())],
                names=["doc_id", "n_tokens", "n_known", "logs", "model"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return (
        rows.drop("learn")
        .mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_known bigint, logs double, model double")
        .select(
            "doc_id",
            "n_tokens",
            "n_known",
            F.lit(n).cast("long").alias("train_tokens"),
            (F.col("logs") - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
            (F.col("logs") + F.col("model") - math.log10(ends + 1)).alias("score"),
        )
        .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
    )
