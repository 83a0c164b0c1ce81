"""Top-k by sorted lists against brute force."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitrine.llm import common, topk

SCHEMA = "vec_id bigint, embedding array<float>, v string, query bigint, score double"


def brute(rows, every, k, scale=1024):
    usable = sorted(
        {
            (i, tuple(math.floor(scale * float(np.float32(x))) for x in e))
            for i, e, *_ in rows
            if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)
        }
    )
    out = []
    for i, q in usable:
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in usable if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return sorted(out)


def searched(spark, rows, every, k):
    common.reach(spark)
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % every == 0, k).collect())


def vector(rng, n=16):
    return [rng.gauss(0, 1) for _ in range(n)]


def test_search_equals_brute_force_on_odd_rows(spark):
    rng = random.Random(4)
    copy = vector(rng)
    rows = [(i, vector(rng), "a", 1, 0.5) for i in range(300)]
    rows += [(1000 + i, copy, None, None, None) for i in range(200)]  # a crowd of copies, queries among them
    rows += [(2000 + i, [float(i % 3)] * 16, "", 0, 0.0) for i in range(60)]  # ties
    rows += [
        (3000, None, None, None, None),
        (3010, [1.0, None], None, None, None),
        (3020, [float("nan")] * 16, None, None, None),
        (3030, [float("inf")] * 16, None, None, None),
        (None, vector(rng), None, None, None),
        (3040, [], None, None, None),
        (3050, [2.5], None, None, None),
        (3060, vector(rng, 20), None, None, None),
        (3070, [0.0] * 16, None, None, None),
        (3080, [1e5] * 16, None, None, None),
        (7, rows[7][1], "repeat", 1, 1.0),
    ]
    assert searched(spark, rows, 10, 5) == brute(rows, 10, 5)


def test_fewer_rows_than_k_and_empty_tables(spark):
    rows = [(0, [1.0, 2.0], None, None, None), (1, [0.5, 0.5], None, None, None)]
    assert searched(spark, rows, 1, 10) == brute(rows, 1, 10)
    assert searched(spark, rows, 50, 10) == brute(rows, 50, 10)
    assert searched(spark, [], 1, 10) == []


def lists_of(x):
    order = np.argsort(x, axis=0, kind="stable").T
    return topk.Lists(order, np.take_along_axis(x.T, order, 1), (x.astype(float) ** 2).sum(axis=1))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 200), st.integers(1, 6), st.sampled_from([2, 50, 3000]))
def test_survivors_hold_the_best(seed, n, width, most):
    rng = np.random.default_rng(seed)
    x, q = rng.integers(-most, most + 1, (n, width)), rng.integers(-most, most + 1, width)
    found, _ = topk.survivors(np.stack([q, -q]), lists_of(x), 5)
    for asked, alive in zip((q, -q), found):
        best = np.lexsort((np.arange(n), -(x @ asked)))[:5]
        assert set(best) <= set(alive)


def test_reading_stops_before_the_lists_end():
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(4096, 16)) * 1024).astype(np.int64)
    found, depths = topk.survivors(x[:20], lists_of(x), 10)
    assert depths.max() < 4096 and max(map(len, found)) <= topk.HOLD * 10


def test_scores_beyond_64_bits_are_an_error():
    big = np.full(4, 2**61, dtype=np.int64)
    with pytest.raises(OverflowError):
        topk.resolved(big, big[None, :])
    assert topk.resolved(big, np.array([[1, -1, 0, 1]])).tolist() == [2**61]
