"""Language by rank-order n-gram profiles.

Training counts the letter n-grams (1 to 3 characters, words framed by blanks) of each language over all its texts and
keeps the most frequent in rank order. A text is ranked the same way and goes to the language whose profile is least out
of place: per n-gram the difference of ranks, or the profile length where the profile lacks it.

NULL texts and texts without a letter give ``und`` and score 0; equal distances go to the language first by name. Rows
without a language do not train. With no training rows every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: N-grams in a profile.
PROFILE = 300
#: Distinct n-grams that a task holds before it passes its counts on.
HOLD = 1_000_000
_fold: np.ndarray | None = None


def fold() -> np.ndarray:
    """Code point to lower-case letter, others to 0; the table is built once per worker."""
    global _fold
    if _fold is None:
        out = np.zeros(0x110000, dtype=np.int64)
        for point in range(0x110000):
            c = chr(point)
            if c.isalpha():
                out[point] = ord(c.lower()[0])
        _fold = out
    return _fold


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, in code order, and their counts. One n-gram is up to three 21-bit code points."""
    points = fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    letter = points > 0
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    framed = np.zeros(len(points) + 2, dtype=np.int64)
    framed[1:-1] = points
    live = np.ones(len(framed), dtype=bool)
    live[1:] = (framed[1:] > 0) | (framed[:-1] > 0)  # one blank between words
    x = framed[live]
    a, b = x[:-1], x[1:]
    two = a << 21 | b
    three = (two[:-1] << 21 | x[2:])[x[1:-1] > 0]
    one, two = x[x > 0], two[(a > 0) | (b > 0)]
    return np.unique(np.concatenate([one, two | 1 << 62, three | -1 << 63]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return codes[np.argsort(-counts, kind="stable")[:PROFILE]]


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang") -> list[tuple[str, list[int]]]:
    """(language, n-grams in rank order) of every language; at most PROFILE numbers each reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return codes, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                codes, counts = merged(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(counts)],
                    names=["lang", "gram", "n"],
                )

        for batch in batches:
            for t, name in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                part = grams(t or "")
                if len(part[0]):
                    held.setdefault(name, []).append(part)
                    size += len(part[0])
                if size > HOLD:
                    held = {k: [merged(v)] for k, v in held.items()}
                    size = sum(len(v[0][0]) for v in held.values())
                    if size > HOLD // 2:
                        yield from flush()
                        held, size = {}, 0
        yield from flush()

    counts = (
        docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
        .select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
        .mapInArrow(count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= PROFILE)
    rows = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "gram"))).alias("grams")).collect()
    return sorted((r.lang, [g.gram for g in r.grams]) for r in rows)


def identify(docs: DataFrame, known: list[tuple[str, list[int]]], text: str = "text") -> Column:
    """A struct (lang, score) for each text; 1 is a perfect match of ranks, 0 is none."""
    every = np.array(sorted({g for _, p in known for g in p}), dtype=np.int64)
    places = np.full((len(known), len(every) + 1), PROFILE, dtype=np.int64)
    for i, (_, profile) in enumerate(known):
        places[i, np.searchsorted(every, np.array(profile, dtype=np.int64))] = np.arange(len(profile))
    names = [n for n, _ in known]

    @F.arrow_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def place(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for t in texts.to_pylist():
            own = ranked(*grams(t or ""))
            if not len(own) or not names:
                langs.append("und")
                scores.append(0.0)
                continue
            at = np.searchsorted(every, own)
            at[at == len(every)] = 0
            at[every[at] != own] = len(every)
            rank = np.arange(len(own))
            found = places[:, at]
            far = np.where(found == PROFILE, PROFILE, np.abs(found - rank)).sum(axis=1)
            best = int(far.argmin())
            langs.append(names[best])
            scores.append(1 - float(far[best]) / (PROFILE * len(own)))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)], names=["lang", "score"])

    return place(F.col(text))
