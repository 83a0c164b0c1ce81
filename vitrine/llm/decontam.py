"""Benchmark passages in documents, despite small edits.

Texts are sequences of words (runs of letters, digits and non-ASCII characters, ASCII case folded). The CGK walk embeds
a sequence by copying the current word to the output at each step and then, by a random bit of (step, word), moving on
or staying: a small edit distance becomes a small Hamming distance, as the walks of two similar sequences meet again.
Each repetition draws its own walk and samples ``BITS`` output steps as the key of a window; an item and a window with
equal keys are compared by exact edit distance.

Windows have the size of the items: items fall into classes of length, and each document has one window of a class at
every word. A window whose words are too rarely words of that class's items cannot be within the allowed distance and is not
embedded; that test loses nothing.

A passage matches if its edit distance in words is at most (1 - SIMILARITY) times the item's words. NULL, empty and
wordless texts or items match nothing; repeated rows each give their matches; an empty benchmark gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.common import best_match, blobs, mix, word_chunks, words

SIMILARITY = 0.8
#: Independent walks, and sampled output steps of each. Of the steps of two similar walks some 70 to 95 % agree, so one
#: repetition finds a pair with 20 to 80 %; eighteen find it with 98 % or more.
WALKS, BITS = 18, 4
#: Words of benchmark text that travel with a job; a larger benchmark is searched in several passes.
BLOCK_WORDS = 2_000_000


def lengths(most: int) -> list[int]:
    """Window sizes, each about a quarter above the one before."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return out


def embed(h: np.ndarray, start: np.ndarray, end: np.ndarray, size: int, walk: int) -> np.ndarray:
    """The sampled key of the windows ``h[start:end]`` under one walk; past its end a window reads as zeros."""
    rng = np.random.default_rng([size, walk])
    steps = np.sort(rng.choice(2 * size, min(BITS, 2 * size), replace=False))
    turns = rng.integers(1, 1 << 63, 2 * size, dtype=np.uint64) | np.uint64(1)
    at = start.copy()
    key = np.full(len(start), size * 1000 + walk, dtype=np.uint64)
    sampled = set(steps.tolist())
    for step in range(int(steps[-1]) + 1):
        inside = at < end
        word = np.where(inside, h[np.minimum(at, end - 1)], np.uint64(0))
        if step in sampled:
            key = mix(key * np.uint64(31) + word)
        at += inside & ((word * turns[step]) >> np.uint64(63) == 1)
    return key


class Index:
    """The items of one block and their keys."""

    def __init__(self, items: list[tuple[object, bytes]]):
        self.items: dict[int, tuple[object, list[int]]] = {}
        sizes: dict[int, list[int]] = {}
        hashed = [(i, words(text)[0]) for i, text in items]
        grid = lengths(max((len(h) for _, h in hashed), default=1))
        for n, (item, h) in enumerate(hashed):
            if len(h):
                self.items[n] = (item, h.tolist())
                sizes.setdefault(max(g for g in grid if g <= len(h)), []).append(n)
        self.vocabulary = np.unique(np.concatenate([h for _, h in hashed])) if hashed else np.zeros(0, np.uint64)
        self.classes = []
        origin = np.zeros(1, np.int64)
        for size, members in sorted(sizes.items()):
            spare = max(self.allowed(n) for n in members)
            keys: list[tuple[int, int]] = []
            for walk in range(WALKS):
                for n in members:
                    h = np.array(self.items[n][1], dtype=np.uint64)
                    keys.append((int(embed(h, origin, origin + size, size, walk)[0]), n))
            keys.sort()
            codes = np.array([k for k, _ in keys], dtype=np.uint64)
            own = np.isin(self.vocabulary, np.concatenate([hashed[n][1] for n in members]))
            self.classes.append((size, size - spare, np.append(own, False), codes, [n for _, n in keys]))

    def allowed(self, n: int) -> int:
        return int((1 - SIMILARITY) * len(self.items[n][1]) + 1e-9)

    def search(self, h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, object, int, int]]:
        """(text, item, end word, distance) of every match; ``bounds`` are the texts' first words in ``h``."""
        if not len(self.vocabulary) or not len(h):
            return
        at = np.searchsorted(self.vocabulary, h)
        at[self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] != h] = len(self.vocabulary)
        place = np.arange(len(h))
        text = np.searchsorted(bounds, place, side="right") - 1
        last = bounds[text + 1]
        found: dict[tuple[int, int], set[int]] = {}
        seen = np.zeros(len(h) + 1, dtype=np.int32)
        for size, least, own, codes, owners in self.classes:
            np.cumsum(own[at], out=seen[1:])
            ends = np.minimum(place + size, last)
            start = np.flatnonzero(seen[ends] - seen[:-1] >= least)
            if not len(start):
                continue
            for walk in range(WALKS):
                key = embed(h, start, ends[start], size, walk)  # windows end with their text
                low = np.searchsorted(codes, key)
                hit = np.flatnonzero((low < len(codes)) & (codes[np.minimum(low, len(codes) - 1)] == key))
                for i in hit:
                    j = int(low[i])
                    while j < len(codes) and codes[j] == key[i]:
                        found.setdefault((int(text[start[i]]), owners[j]), set()).add(int(start[i]))
                        j += 1
        for (doc, n), starts in sorted(found.items()):
            item, sequence = self.items[n]
            most, best = self.allowed(n), None
            for begin in sorted(starts):
                low = max(int(bounds[doc]), begin - most)
                high = min(int(bounds[doc + 1]), begin + len(sequence) + 2 * most)
                distance, end = best_match(sequence, h[low:high].tolist())
                if distance <= most and (best is None or distance < best[0]):
                    best = (distance, low + end - int(bounds[doc]))
            if best:
                yield doc, item, best[1], best[0]


def blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[Index]:
    """The benchmark in blocks of bounded size; the driver holds one at a time."""
    held: list[tuple[object, bytes]] = []
    size = 0
    for row in benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).toLocalIterator():
        raw = (row.t or "").encode()
        held.append((row.i, raw))
        size += len(raw) // 4
        if size >= BLOCK_WORDS:
            yield Index(held)
            held, size = [], 0
    if held:
        yield Index(held)


def matches(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item: str = "item_id"
) -> DataFrame:
    """(doc_id, item_id, distance, item_words, end_word): the best place of each item found in each row of ``docs``."""
    spark = docs.sparkSession
    id_type, item_type = docs.schema[doc_id].dataType, benchmark.schema[item].dataType
    schema = T.StructType(
        [T.StructField("doc_id", id_type), T.StructField("item_id", item_type)]
        + [T.StructField(c, T.LongType()) for c in ("distance", "item_words", "end_word")]
    )
    out = None
    for index in blocks(benchmark, item, text):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sizes = {i: len(s) for i, s in shared.value.items.values()}
            for batch in batches:
                ids, rows = batch.column("d"), []
                for first, h, bounds in word_chunks(blobs(batch, "t")):
                    for doc, i, end, distance in shared.value.search(h, bounds):
                        rows.append((first + doc, i, distance, sizes[i], end))
                if rows:
                    at, *rest = map(list, zip(*rows))
                    columns = [ids.take(pa.array(at)), *(pa.array(c) for c in rest)]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

        part = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, with all their columns."""
    for index in blocks(benchmark, item, text):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad: set[int] = set()
                for first, h, bounds in word_chunks(blobs(batch, text)):
                    bad |= {first + doc for doc, *_ in shared.value.search(h, bounds)}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
