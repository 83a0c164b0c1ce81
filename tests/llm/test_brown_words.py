"""Classes of words beyond the leading ones, against the mutual information of all moves."""

import random

import numpy as np
from pyspark.sql import functions as F

from vitrine.llm import brown, common


def test_rare_words_are_classed_by_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(brown, "exchange", lambda between, n: np.arange(len(between)))  # a class for each leading word
    common.reach(spark)
    rng = random.Random(2)
    texts = [" ".join(f"fill{(7 * i + j) % 520:03d}" for j in range(520)) for i in range(6)]
    nouns, verbs = [f"n{i:04d}" for i in range(100)], [f"v{i:04d}" for i in range(100)]
    for _ in range(3):
        rng.shuffle(nouns)
        rng.shuffle(verbs)
        texts.append(" ".join(f"ga fa {x} gb hb fb {y}" for x, y in zip(nouns, verbs)))
        texts.append(" ".join(["ga fa nn gb hb fb vv"] * 100))
    tried = ["fa n0007", "fa v0007", "fb v0007", "fb n0007"]
    docs = spark.createDataFrame([*enumerate(texts), *enumerate(tried, 100)], "doc_id bigint, text string")
    r = {x.doc_id: x for x in brown.scores(docs, F.col("doc_id") < 100).collect()}
    assert r[100].base_score == r[101].base_score
    assert r[100].score > r[101].score + 0.2 and r[102].score > r[103].score + 0.2


def test_words_move_where_mutual_information_is_greatest():
    rng = np.random.default_rng(3)
    size, of = 5, rng.integers(0, 4, 40)
    of[-1] = 4  # the rim
    text = rng.integers(0, 40, 400)
    text = text[np.concatenate([[True], text[1:] != text[:-1]])]
    between = np.zeros((40, 40))
    np.add.at(between, (text[:-1], text[1:]), 1)

    def table(of):
        joint = np.zeros((size, size))
        np.add.at(joint, (of[text[:-1]], of[text[1:]]), 1)
        return joint

    def value(of):
        joint = table(of)
        return brown.weight(joint).sum() - brown.weight(joint.sum(axis=0)).sum() - brown.weight(joint.sum(axis=1)).sum()

    row, code, n = [], [], []
    for w in range(39):
        counts = np.zeros(2 * size)
        np.add.at(counts, of, between[w])
        np.add.at(counts, size + of, between[:, w])
        at = np.flatnonzero(counts)
        row += [w] * len(at)
        code += at.tolist()
        n += counts[at].tolist()
    got = brown.moved(np.array(row), np.array(code), np.array(n), of[:39], table(of))
    for w in range(39):
        trial = [value(np.where(np.arange(40) == w, k, of)) for k in range(4)]
        assert trial[got[w]] >= max(trial) - 1e-6
    none = np.zeros(0, np.int64)
    assert brown.moved(none, none, none.astype(float), none, table(of)).tolist() == []
