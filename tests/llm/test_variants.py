"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

from vitrine.llm import common, variants

SCHEMA = "doc_id bigint, text string, word string, n bigint, number string"


def counted(rows, least_n=3):
    out = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= least_n}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    form, close = {}, {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        close[w] = len(others)
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = []
    for w, n in counts.items():
        last = w
        while form[last] is not None:
            last = form[last]
        out.append((w, form[w], last, n, close[w], counts[form[w]] if form[w] else None))
    return sorted(out)


def found(spark, rows):
    common.reach(spark)
    docs = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in variants.variants(docs).collect())


def row(doc_id, text):
    return (doc_id, text, "clash", 1, None)


def test_variants_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for d in range(120):
        made = ["".join(rng.choice("abA") for _ in range(rng.choice([5, 5, 6, 6, 7]))) for _ in range(150)]
        rows.append(row(d, rng.choice([" ", ", ", "1", "\n"]).join(made)))
    rows += [row(1000 + d, "Étude étude Ètude etude etudes " * (1 + d)) for d in range(9)]
    expected = brute(counted(rows))
    assert len(expected) > 100 and any(r[1] for r in expected) and any(r[2] != r[1] for r in expected if r[1])
    assert found(spark, rows) == expected


def test_deletions_by_the_checksum_are_counted(spark):
    rows = [row(d, "harbours lanterns moorings capstans bulwarks") for d in range(3000)]
    expected = brute(counted(rows))
    assert len(expected) > 5 and found(spark, rows) == expected


def test_odd_texts(spark):
    long = "ab" * 20_000
    rows = [row(None, "tables tables tables"), row(None, None), row(1, ""), row(2, "123 ... \x00")]
    rows += [row(5, "stones stones"), row(5, "stones stones"), row(6, f"{long} {long}c {long} {long}c {long} {long}c")]
    rows += [row(7, "aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaa aaaaaaa aaaaaaa aaaaaaa"), row(8, "abcd abcd abcd ab×÷c ab×÷c ab×÷c")]
    assert found(spark, rows) == brute(counted(rows))
    assert found(spark, []) == [] and found(spark, [row(1, None)]) == []


def test_chains_of_forms_end_at_the_largest(spark):
    words = ["seven", "sevens", "sevenst", "sevenstu", "sevenstuv", "sevenstuvw"]
    counts = spark.createDataFrame([(w, 3 * 2**i) for i, w in enumerate(words)], "word string, n bigint")
    out = {r.word: r for r in variants.grouped(counts).collect()}
    assert all(r.root == words[-1] for r in out.values())
    assert [out[w].form for w in words] == words[1:] + [None]
    assert [out[w].n_near for w in words] == [1, 2, 2, 2, 2, 1]
