"""Collocations against brute force, in one range and in many."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from vitrine.llm import collocations, common

SCHEMA = "doc_id bigint, text string, lang string, phrase string, f bigint, part int, size int"


def brute(rows, floor=10, top=2000):
    counts = Counter()
    sums = Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            sums[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i : i + size])] += 1
    kept = {key: n for key, n in counts.items() if n >= floor and len(key[1]) > 1}
    by_lang = {}
    for (lang, words), a in kept.items():
        longer = [n for (x, w), n in kept.items() if x == lang and len(w) > len(words) and words in (w[:2], w[1:])]
        if any(100 * n >= 50 * a for n in longer):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        phrase = " ".join(words)
        by_lang.setdefault(lang, []).append((-score, -a, phrase.encode(), phrase, left, right))
    out = []
    for lang, found in by_lang.items():
        for rank, (score, a, _, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase, -a, left, right, sums[lang], -score))
    return sorted(out)


def row(doc_id, text, lang):
    return (doc_id, text, lang, "clash", 1, 2, 3)


def found(spark, rows, **options):
    common.reach(spark)
    docs = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in collocations.collocations(docs, **options).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocabulary = "the of and river stone marsh Éclair naïve green x y z".split()
    out = []
    for d in range(150):
        parts = [rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for _ in range(60)]
        out.append(row(d, "".join(parts), rng.choice(["en", "en", "fr", None])))
    out += [row(200 + i, "New York city hall, New York City. new\tyork  city", "en") for i in range(14)]
    out += [row(300, "la la " * 30 + "la", "fr"), row(301, None, "en"), row(302, "", "de"), row(303, None, None)]
    out += [row(304, " .,;\n\t ", "fr"), row(305, "one", "und"), row(300, "la la " * 30 + "la", "fr")]
    out += [row(306, "nul\x00 byte joined " * 12, "fr"), row(None, "no id here " * 11, None)]
    return out


def test_collocations_equal_brute_force(spark, rows):
    expected = brute(rows)
    assert len(expected) > 100
    assert found(spark, rows) == expected
    assert found(spark, rows, top=3) == [r for r in expected if r[1] <= 3]


def test_what_a_range_remembers_is_handed_on(spark, rows):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert found(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_empty_tables_give_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [row(1, None, "en")]) == []


def test_long_texts_are_read_in_stretches(monkeypatch):
    monkeypatch.setattr(collocations, "STRETCH", 7)
    text = " ".join(random.Random(1).choice(["a", "bb", "ccc", "d.", "e\n"]) for _ in range(400)).encode()
    for size in (1, 2, 3):
        some = Counter(p for part in collocations.phrases(collocations.normal(text), size) for p in part)
        pieces = [re.findall(rb"[^ \t]+", p) for p in re.split(rb"[.,;:!?\n-\r]", text)]
        assert some == Counter(b" ".join(w[i : i + size]) for w in pieces for i in range(len(w) - size + 1))


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 10**14 + 7, 3 * 10**14 + 1, 2 * 10**14 + 3
    df = spark.createDataFrame([(a, left, right)], "a bigint, l bigint, r bigint")
    out = df.select(collocations.whole_score(df.a, df.l, df.r).alias("s"))
    assert out.first().s == 1_000_000 * a * a // (left * right) and dict(out.dtypes)["s"] == "bigint"


def test_bits_of_short_parts_only_drop_phrases_below_the_floor():
    v = collocations.normal(b"a b a b c")
    none = np.zeros(collocations.BITS // 8, dtype=np.uint8)
    assert [p for part in collocations.phrases(v, 2, "en", none) for p in part] == []
    assert [p for part in collocations.phrases(v, 2, "en", ~none) for p in part] == [b"a b", b"b a", b"a b", b"b c"]
