"""Similar words by the rare parts of their letter-pair sets, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from vitrine.operators import setjoin


def pairs(word):
    padded = f"_{word}_"
    return {padded[i : i + 2] for i in range(len(padded) - 1)}


def brute(asked, known, floor):
    out = {}
    for a in asked:
        for b in known:
            p, q = pairs(a), pairs(b)
            score = 2.0 * len(p & q) / (len(p) + len(q))
            if score >= floor and p & q:
                out[a, b] = score
    return out


def column(spark, words, name):
    return spark.createDataFrame([(w,) for w in words], f"{name} string")


def found(spark, asked, known, floor, depth=None):
    rows = setjoin.similar_words(column(spark, asked, "asked"), column(spark, known, "known"), floor, depth).collect()
    out = {(r.asked, r.known): r.score for r in rows}
    assert len(out) == len(rows)
    return out


def invented(n, seed):
    rng = random.Random(seed)
    syllables = [a + b for a in "bcdfglmnprstv" for b in ("a", "e", "i", "o", "u", "an", "er", "il", "on")]
    return ["".join(rng.choice(syllables) for _ in range(rng.choice([1, 2, 3, 3, 4, 5]))) for _ in range(n)]


@pytest.mark.parametrize("floor", [0.4, 0.6, 0.85, 1.0])
def test_every_depth_finds_what_all_pairs_find(spark, floor):
    asked = [*invented(120, 1), "violão", "a", "", "aaaa", "ab" * 300, "abc" * 100]
    known = [*invented(150, 2), "violao", "a", "b", "aaaaaa", "ab" * 290 + "c", "abc" * 101, "abc" * 101]
    expected = brute(set(asked), set(known), floor)
    assert expected
    for depth in (None, 1, 2, 3, 4):
        assert found(spark, asked, known, floor, depth) == expected


def test_null_and_empty_tables_give_nothing(spark):
    assert found(spark, [], ["abc"], 0.6) == {} and found(spark, ["abc"], [], 0.6) == {}
    assert found(spark, [None, "abc"], [None, "abc"], 0.6) == {("abc", "abc"): 1.0}


def test_candidates_stay_near_the_result_on_a_large_vocabulary(spark):
    known = sorted(set(invented(400_000, 3)))[:100_000]
    asked = random.Random(4).sample(known, 300)
    met = setjoin.candidates(column(spark, asked, "asked"), column(spark, known, "known"), 0.6, depth=4)
    score = setjoin.dice(F.col("asked"), F.col("known"))
    row = met.agg(F.count("*").alias("all"), F.count_if(score >= 0.6).alias("good")).first()
    assert row["all"] <= 5 * row["good"], row


def test_the_plan_joins_on_one_key(spark):
    met = setjoin.similar_words(column(spark, ["abc"], "asked"), column(spark, ["abd"], "known"), 0.6)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
