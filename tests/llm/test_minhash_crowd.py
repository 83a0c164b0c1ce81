"""Near-duplicates in a crowd that shares a passage, against all pairs."""

import random

import numpy as np

from vitrine.llm import common, minhash

SCHEMA = "doc_id bigint, text string, `odd.name` string"


def crowd():
    """Texts that share 240 words and have 80 of their own; some are edited copies of others, by 2 to 20 % of the words."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(words) for _ in range(240)]
    texts = [passage + [rng.choice(words) for _ in range(80)] for _ in range(200)]
    for i in range(100):
        source = texts[i % 20] if i < 60 else texts[20 + i]  # sixty copies of twenty texts, forty single pairs
        copy = list(source)
        for _ in range(int(rng.choice([0.02, 0.05, 0.1, 0.15, 0.2]) * len(copy))):
            at = rng.randrange(len(copy))
            kind = rng.random()
            if kind < 0.6:
                copy[at] = rng.choice(words)
            elif kind < 0.8:
                del copy[at]
            else:
                copy.insert(at, rng.choice(words))
        texts.append(copy)
    return texts


def test_classes_of_a_crowd_equal_those_of_all_pairs(spark):
    common.reach(spark)
    texts = crowd()
    numbers = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    coded = [[numbers[w] for w in t] for t in texts]
    parent = list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = []
    for a in range(len(coded)):
        for b in range(a + 1, len(coded)):
            most = int(0.2 * max(len(coded[a]), len(coded[b])) + 1e-9)
            if common.edit_distance(coded[a], coded[b], most) <= most:
                pairs.append((a, b))
                parent[top(a)] = top(b)
    assert len(pairs) > 100
    docs = spark.createDataFrame([(i, " ".join(t), "x") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.class_id for r in minhash.classed(docs).collect()}
    joined = sum(got[a] == got[b] for a, b in pairs)
    assert joined >= 0.9 * len(pairs), (joined, len(pairs))
    # Nothing is joined that all pairs keep apart.
    assert all(top(i) == top(c) for i, c in got.items())
    kept = minhash.representatives(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(got.values()))


def test_pairs_far_apart_are_not_allowed():
    import pyarrow as pa

    bag = lambda words: minhash.bag(common.words(words.encode())[0])
    a, b = "one two three four five six seven eight nine ten", "one two three four five six seven eight nine eleven"
    c = "q w e r t y u i o p"
    columns = {"a": [b"1", b"2"], "b": [b"3", b"4"], "size_a": [10, 10], "size_b": [10, 10], "bag_a": [bag(a), bag(a)], "bag_b": [bag(b), bag(c)]}
    out = list(minhash.allowed(iter([pa.RecordBatch.from_pydict(columns)])))
    assert out[0].column("a").to_pylist() == [b"1"]


def test_near_copies_are_joined_by_few_pairs(spark):
    common.reach(spark)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    source = [rng.choice(words) for _ in range(300)]
    texts = []
    for _ in range(120):
        copy = list(source)
        for _ in range(15):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    rows = minhash.classed(docs).collect()
    assert {r.class_id for r in rows} == {0}
    assert sum(r.links for r in rows) <= 2 * (4 + 1) * len(texts)


def test_rows_of_representatives_travel_once(spark):
    common.reach(spark)
    docs = spark.createDataFrame([(i, f"text {i % 7} of some words", "x") for i in range(30)] + [(None, "a b", "y")] * 2, SCHEMA)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = minhash.representatives(docs)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        rows = {(r.doc_id, r.text) for r in kept.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 2, plan  # the rows and the choice
    assert rows == {(i, f"text {i} of some words") for i in range(7)} | {(None, "a b")}


def test_only_texts_to_align_travel(spark):
    keyed = spark.range(20_000).selectExpr("unhex(md5(cast(id as string))) as key", "cast(id as string) as t")
    involved = keyed.filter("t % 400 = 0").select("key").union(spark.createDataFrame([(b"elsewhere",)], "key binary"))
    found = minhash.sought(keyed, involved.distinct())
    assert found.columns == ["key", "t"]
    got = {int(r.t) for r in found.collect()}
    assert got >= set(range(0, 20_000, 400)) and len(got) <= 60
    assert minhash.sought(keyed, involved.limit(0)).count() == 0 and minhash.sought(keyed.limit(0), involved).count() == 0


def near_and_far_pairs():
    rng, out = random.Random(3), []
    for _ in range(300):
        size = rng.choice([1, 2, 9, 40, 63, 64, 65, 150, 160, 161, 300])
        few = rng.random() < 0.4
        a = [rng.randrange(7) * 987654321987 if few else rng.randrange(1 << 63) for _ in range(size)]
        b = list(a)
        for _ in range(int(rng.random() * 0.4 * size) + rng.randrange(2)):
            word = rng.choice(a) if rng.random() < 0.5 else rng.randrange(1 << 63)
            at, kind = rng.randrange(len(b)), rng.random()
            if kind < 0.4 or len(b) == 1:
                b[at] = word
            elif kind < 0.7:
                del b[at]
            else:
                b.insert(at, word)
        out.append((np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)))
    return out + [(np.zeros(0, dtype=np.uint64), out[0][0])]


def test_pairs_tested_side_by_side_are_those_of_single_alignments():
    pairs = near_and_far_pairs()
    most = [int(0.2 * max(len(a), len(b)) + 1e-9) for a, b in pairs]
    exact = [common.edit_distance(a.tolist(), b.tolist(), k) for (a, b), k in zip(pairs, most)]
    far = minhash.far_apart(pairs)
    assert not any(x and d <= k for x, d, k in zip(far.tolist(), exact, most))
    assert far.sum() >= 0.95 * sum(d > k for d, k in zip(exact, most)) > 50
    at = [i for i, (a, b) in enumerate(pairs) if abs(len(a) - len(b)) <= most[i]]
    least = minhash.lower_bounds([pairs[i] for i in at], np.array([most[i] for i in at]))
    assert all(x <= exact[i] if exact[i] <= most[i] else True for x, i in zip(least.tolist(), at))
    # Words alike in their last bits only: the bound is less, never more.
    assert minhash.lower_bounds([(np.array([1 << 20, 5], dtype=np.uint64), np.array([1 << 21, 5], dtype=np.uint64))], np.array([1]))[0] == 0


def test_classes_of_chains_read_by_many_tasks(spark):
    common.reach(spark)
    rng = random.Random(8)
    chains = [[f"{c:02d}-{i:03d}" for i in rng.sample(range(60), 60)] for c in range(2)]
    edges = [(c[i], c[i + 1]) for c in chains for i in range(59)] + [("alone", "alone"), (chains[0][3], chains[0][9])]
    rng.shuffle(edges)
    for size, parts in (("128m", 1), ("1k", 12)):  # one task, and some that need the rounds
        before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        try:
            got = common.classes(spark.createDataFrame(edges, "a string, b string").repartition(parts)).collect()
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
        assert {(r.node, r.root) for r in got} == {(n, min(c)) for c in chains for n in c} | {("alone", "alone")}
        assert len(got) == 121
    assert common.classes(spark.createDataFrame([], "a string, b string")).count() == 0


def test_rounds_end_when_they_join_next_to_nothing(spark, monkeypatch):
    common.reach(spark)
    made = []
    monkeypatch.setattr(minhash, "cut", lambda df, name: made.append(name) or common.cut(df, name))
    shared = " ".join(f"shared{k}" for k in range(90))
    texts = [f"{shared} {' '.join(f'own{i}x{k}' for k in range(90))}" for i in range(12)]
    rows = minhash.classed(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.class_id for r in rows} == {i: i for i in range(12)}
    assert made.count("led") == 2 < minhash.LEADERS and made.count("pairs") <= made.count("led")
