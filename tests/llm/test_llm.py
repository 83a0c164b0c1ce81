"""Training-data operators against brute force, and on odd tables: NULLs, empty and long texts, repeats, clashing columns."""

import base64
import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from vitrine.llm import bpe, brown, common, decontam, langid, minhash, pii, quality, suffixes, templates, toolcalls

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def prose(seed, n, words="the of and to in stone river light bring water green hollow marsh ember quill tarn fell".split()):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + ("" if rng.random() < 0.6 else rng.choice("abcdefgh")) for _ in range(n))


def edited(text, seed, rate):
    rng, words = random.Random(seed), text.split()
    for _ in range(int(rate * len(words))):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(99)}"
    return " ".join(words)


BASE = [prose(i, 120) for i in range(12)]
ITEM = prose(77, 30, "alpha beta gamma delta epsilon zeta eta theta iota kappa".split())


@pytest.fixture(scope="module")
def docs(spark):
    common.reach(spark)
    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t)) for i, t in enumerate(BASE)]
    rows += [
        (20, BASE[0], "en", None, None),
        (21, edited(BASE[1], 5, 0.05), "en", "s", 1),
        (22, prose(99, 40) + " " + ITEM + " " + prose(98, 40), "fr", "s", 1),
        (23, prose(97, 40) + " " + edited(ITEM, 3, 0.1), None, "s", 1),
        (24, prose(96, 80) + " mail ann.lee@example.org now, 10.20.30.40 or +1 (555) 010-2233, card 4111111111111111.", "en", "s", 1),
        (25, None, None, None, None),
        (26, "", "en", "s", 0),
        (None, "short one", "en", "s", 9),
        (None, None, None, None, None),
        (27, "long " * 40_000, None, "s", 200_000),
        (28, "%%% $$$ \n\t", "en", "s", 10),
        (29, BASE[2], "en", "s", 1),
        (29, BASE[2], "en", "s", 1),
        (30, "é" * 3000 + "\x00   end", "fr", "s", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    common.reach(spark)
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# -- pieces ------------------------------------------------------------------------------------------------------


def table_distance(a, b, free_start=False):
    row = [0] * (len(b) + 1) if free_start else list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row) if free_start else row[-1]


SMALL = st.lists(st.integers(0, 3), max_size=12)


@given(SMALL, SMALL, st.integers(0, 8))
def test_banded_distance_equals_the_full_table(a, b, most):
    assert common.edit_distance(a, b, most) == min(table_distance(a, b), most + 1)


@given(SMALL.filter(bool), SMALL)
def test_best_match_equals_the_full_table(a, b):
    assert common.best_match(a, b)[0] == table_distance(a, b, free_start=True)


ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@given(st.text(max_size=60) | st.text(alphabet="aeinrst 'é\n0", max_size=60))
def test_prefix_tables_encode_as_the_public_library(text):
    ids = bpe.encode_ids(RANKS, public_tokenizers.PATTERN, text)
    assert ids == ENCODING.encode_ordinary(text)
    assert bpe.encoder(RANKS).decode(ids) == text.encode()


@pytest.mark.parametrize("piece", ["a" * 5000, "ab" * 1000 + "é" * 500, "thetheandin" * 200])
def test_long_pieces_encode_as_the_public_library(piece):
    assert bpe.encode_ids(RANKS, public_tokenizers.PATTERN, piece) == ENCODING.encode_ordinary(piece)


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("write to a.b+c@mail.example.org.", ["email"]),
        ("x@y", []),
        ("1.2.3.4.5 and 300.1.1.1 and 10.0.0.255", ["ip", "ip"]),
        ("4111 1111 1111 1111 or 4111111111111112", ["card"]),
        ("+1 (555) 010-2233 and +12", ["phone"]),
        ("9" * 50_000 + "@" + "." * 1000, []),
    ],
)
def test_patterns(text, kinds):
    assert [pii.KINDS[k] for k, _, _ in pii.base_spans(text)] == kinds


def test_gradient_of_the_tagger():
    import numpy as np

    model, rng = pii.start_model(), np.random.default_rng(0)
    x, y = rng.integers(0, pii.SYMBOLS, (6, 3)), rng.integers(0, pii.LABELS, (6, 3))
    _, grad = pii.learn_step(model, x, y)
    for name in model:
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        ends = []
        for step in (1e-5, -1e-5):
            model[name][at] += step
            ends.append(pii.learn_step(model, x, y)[0])
            model[name][at] -= step
        assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(grad[name][at], rel=1e-4)


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<p>a &amp; b\n c<p>d<br>e", "a & b c\nd e"),
        ("<nav>menu</nav><article><h1>T</h1><p>one <b>two</b></p></article><footer>f</footer>", "T\none two"),
        ("<div class='ad box'>x</div><p>y</p><div id=comments><p>z</p></div>", "y"),
        ("<script>var a='<p>no</p>'</script><p>1 < 2</p><!-- <p>no</p> -->", "1 < 2"),
        ("<p>kept</p><p class=\"cut", "kept"),
        ("<ul><li>a<li>b</ul>" + "<div>" * 3000 + "deep", "a\nb\ndeep"),
    ],
)
def test_main_text(page, text):
    assert (templates.main_text(page) if page else "") == text


# -- operators ---------------------------------------------------------------------------------------------------


def test_language(docs, empty):
    known = langid.profiles(docs)
    found = docs.select("doc_id", "text", langid.identify(docs, known).alias("x")).collect()
    for r in found:
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (r.x.lang, r.x.score) == ("und", 0.0)
        else:
            assert r.x.lang in ("en", "fr") and 0 <= r.x.score <= 1
    assert langid.profiles(empty) == []
    assert {r.x.lang for r in docs.select(langid.identify(docs, []).alias("x")).collect()} == {"und"}


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "%%")], "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in collected(decontam.matches(docs, bench))}
    assert set(found) == {(22, 1), (23, 1)} and found[22, 1]["distance"] == 0 and 0 < found[23, 1]["distance"] <= 6
    left = decontam.clean(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - 2
    assert decontam.matches(empty, bench).count() == 0 and decontam.matches(docs, bench.limit(0)).count() == 0


def test_near_duplicates(docs, empty):
    rows = collected(minhash.classed(docs))
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[20]["class_id"] == by_id[0]["class_id"] == 0 and by_id[20]["links"] == 0
    assert by_id[21]["class_id"] == 1 and by_id[21]["links"] == 1
    assert by_id[29]["class_id"] == 2 and by_id[29]["class_rows"] == 3
    assert by_id[25]["class_id"] == by_id[26]["class_id"] == 25  # NULL counts as empty
    kept = minhash.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in collected(kept)]
    assert not {20, 21, 26} & set(ids) and {0, 1, 2, 25, 28} <= set(ids) and 29 not in ids
    assert minhash.classed(empty).count() == 0 and minhash.representatives(empty).count() == 0


def test_near_duplicates_in_a_crowd_that_shares_a_passage(spark):
    common.reach(spark)
    rng = random.Random(6)
    passage = [f"common{i}" for i in range(240)]
    own = [[f"w{rng.randrange(10**6)}" for _ in range(80)] for _ in range(120)]
    texts = [" ".join(passage + o) for o in own]
    for o in own[:20]:  # near: 40 of 320 words differ, none of them in the shared passage
        changed = set(rng.sample(range(80), 40))
        texts.append(" ".join(passage + [f"x{rng.randrange(10**6)}" if i in changed else w for i, w in enumerate(o)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: (r["class_id"], r["class_rows"]) for r in collected(minhash.classed(df))}
    assert found == {i: (i - 120 if i >= 120 else i, 2 if i < 20 or i >= 120 else 1) for i in range(140)}


def test_blocks_of_a_bucket_meet(spark, monkeypatch):
    import numpy as np

    size, root = np.array([10, 10, 10, 12, 20]), np.array([0, 1, 1, 2, 3])
    bags = np.zeros((5, minhash.BAG), np.int16)
    near = lambda own, across: {(x, k) for x, y in minhash.possible(size, bags, root, own, across) for k in y.tolist()}
    assert near(np.zeros(5), False) == {(0, 1), (0, 2), (0, 3), (1, 3), (2, 3)}
    assert near(np.array([0, 0, 1, 0, 1]), True) == {(0, 2), (2, 3)}


def test_templates(spark):
    pages = [(i, f"http://H.example/{i}", f"<div>All pages say this</div><p>own {i}</p>", "clash", i) for i in range(10)]
    pages += [(90, None, None, "c", 1), (90, "no url", "<p>x</p>", "c", 1)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string, text string, n_chars bigint")
    rows = collected(templates.extract(df))
    assert sorted(r["text"] for r in rows) == sorted([f"own {i}" for i in range(10)] + ["", "x"])
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert templates.extract(df.limit(0)).count() == 0


def test_small_recurring_elements_stay(spark):
    common.reach(spark)
    body = "<article><h2>Summary</h2><p>one<br>two <em>and</em> {i}<hr>end</p><div>x{i}<p></p>y</div></article>"
    pages = [(i, f"http://h.example/{i}", "<div>All pages say this</div>" + body.replace("{i}", str(i))) for i in range(12)]
    pages += [(20 + i, f"http://i.example/{i}", f"a{i}<br>b<div>All pages say this</div>c <em>and</em> d") for i in range(12)]
    pages += [(40, "http://j.example/", pages[0][2])]
    rows = collected(templates.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")))
    found = {r["page_id"]: r["text"] for r in rows}
    want = {i: f"Summary\none two and {i}\nend\nx{i}\ny" for i in range(12)} | {20 + i: f"a{i} b\nc and d" for i in range(12)}
    assert found == want | {40: want[0]}
    long = "<p>a notice of eight words that each page repeats</p>"
    pages = [(i, f"http://h.example/{i}", f"<article>{long}<p>own {i}</p></article>") for i in range(12)]
    rows = collected(templates.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")))
    assert {r["page_id"]: r["text"] for r in rows} == {i: f"own {i}" for i in range(12)}


def test_copies_of_a_page_are_no_template(spark):
    common.reach(spark)
    own = lambda i: f"<div>All pages say this</div><article><p>own text {i}</p></article>"
    pages = [(i, f"http://h.example/{i}", own(i)) for i in range(12)]
    pages += [(100 + i, f"http://h.example/copy{i}", f"<p>at {i}</p><article><p>one article</p></article>") for i in range(12)]
    pages += [(200 + i, "http://i.example/", "<div><p>the same page</p></div>") for i in range(9)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    found = {r["page_id"]: r["text"] for r in collected(templates.extract(df))}
    assert found == {i: f"own text {i}" if i < 100 else "one article" if i < 200 else "the same page" for i, _, _ in pages}
    page = templates.parse("<div><article><p>only</p></article></div>")
    assert templates.blocks(page, frozenset(templates.digest(page))) == ["only"]


def test_brown_scores(docs, empty):
    import math

    rows = collected(brown.scores(docs, F.col("doc_id") < 20))
    words = {r["doc_id"]: brown.tokens((r["text"] or "").encode()) for r in collected(docs)}
    c = Counter(w for i, ws in words.items() if i is not None and i < 20 for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    for r in rows:
        if r["doc_id"] not in (None, 29):
            ws = [*words[r["doc_id"]], None]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
            assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
            assert r["score"] < 0
    assert brown.scores(empty, F.lit(True)).count() == 0
    assert {r["n_known"] for r in collected(brown.scores(docs, F.lit(False)))} == {0}


def test_repeated_strings(spark, docs, empty):
    passage, rng = prose(55, 100), random.Random(4)
    rows = [(i, prose(100 + i, 90) + passage[rng.randrange(50) : 300 + rng.randrange(250)] + prose(200 + i, 90)) for i in range(30)]
    rows += [(50, "ab" * 700), (51, passage[:399]), (52, passage[:399] + "x"), (53, None), (None, "y")]
    rows += [(r["doc_id"], r["text"]) for r in collected(docs) if r["doc_id"] != 27]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    blobs = [(i, (t or "").encode()) for i, t in rows]
    n = suffixes.LENGTH
    seen = Counter(b[p : p + n] for _, b in blobs for p in range(len(b) - n + 1))
    want = []
    for i, b in blobs:
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if seen[b[p : p + n]] > 1:
                gone[p : p + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not h for g, h in zip(gone, b"\0" + bytes(gone[:-1])))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    found = [tuple(r.values()) for r in collected(suffixes.deduplicated(df))]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert suffixes.deduplicated(empty).count() == 0


def test_quality(docs, empty):
    clash = docs.withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(7))
    rows = collected(quality.judged(clash, quality.references(docs)))
    for r in rows:
        text = r["text"] or ""
        words = brown.tokens(text.encode())
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if brown.tokens(x.encode())]
        assert (r["n_words"], r["n_repeat_words"]) == (len(words), len(covered))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert r["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert not (r["base_failed"] and r["kept"])
    assert quality.accepted(clash, quality.references(docs)).columns == clash.columns
    assert quality.references(empty) == [] and quality.judged(empty, []).count() == 0


def test_personal_data(docs, empty):
    model = pii.fit(docs)
    found = {r["doc_id"]: r for r in collected(pii.find(docs, model))}
    assert [found[24][f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1]
    assert found[25]["spans"] == found[26]["spans"] == "" and found[25]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    hidden = {r["doc_id"]: r["text"] for r in collected(pii.mask(docs, model))}
    assert "<EMAIL>" in hidden[24] and "4111" not in hidden[24] and hidden[25] is None and hidden[3] == BASE[3]
    assert pii.fit(empty) is None and pii.find(empty, None).count() == 0


def test_tool_calls(spark):
    common.reach(spark)
    calls = [
        (1, "b", "sum", '{"y": 2, "x": 1}', ["a"]),
        (1, "a", "sum", '{"x":1,"y":[1, 2],"z":null}', []),
        (1, "a", "sum", '{"x":1,"y":[1, 2],"z":null}', []),
        (1, "c", "gone", "{}", ["b", "a"]),
        (2, "p", "sum", "[1]", ["q"]),
        (2, "q", "sum", "no json", ["p"]),
        (2, None, "sum", None, None),
        (2, "r", "sum", '{"x":1}', ["nowhere"]),
        (3, "j", "sum", '{"x":1,"y":2} junk', []),
    ]
    calls = spark.createDataFrame(calls, "conv_id bigint, call_id string, name string, arguments string, needs array<string>")
    results = spark.createDataFrame([(1, "a", 'say "x"\n'), (1, "a", "z"), (9, "a", "other")], "conv_id bigint, call_id string, content string")
    fields = spark.createDataFrame([("sum", "x", "number", True), ("sum", "y", "number", True)], "name string, field string, type string, required boolean")
    every = collected(toolcalls.linked(calls, results, fields))
    rows = {(r["conv_id"], r["call_id"]): r for r in every if r["name"]}
    assert len(rows) == 8 and len(every) == 10
    apart = [(r["conv_id"], r["call_id"], r["position"], r["has_result"], r["valid"], r["errors"], r["message"]) for r in every if not r["name"]]
    assert sorted(apart) == [
        (1, "a", 4, True, False, "further result of a call", '{"arguments":{},"id":"a","name":null,"result":"z"}'),
        (9, "a", 1, True, False, "result without a call", '{"arguments":{},"id":"a","name":null,"result":"other"}'),
    ]
    assert rows[3, "j"]["errors"] == "arguments are no JSON object"
    assert [(rows[1, c]["level"], rows[1, c]["position"]) for c in "abc"] == [(0, 1), (1, 2), (2, 3)]
    assert rows[1, "b"]["valid"] and rows[1, "b"]["message"] == '{"arguments":{"x":1,"y":2},"id":"b","name":"sum","result":null}'
    assert rows[1, "a"]["errors"] == "y is no number; unknown z" and rows[1, "a"]["has_result"]
    assert rows[1, "a"]["message"] == '{"arguments":{"x":1,"y":[1,2]},"id":"a","name":"sum","result":"say \\"x\\"\\n"}'
    assert rows[1, "c"]["errors"] == "unknown tool"
    assert rows[2, "p"]["errors"] == rows[2, "q"]["errors"] == "arguments are no JSON object"
    assert rows[2, "p"]["level"] is rows[2, "q"]["level"] is rows[2, "r"]["level"] is None
    assert rows[2, "r"]["errors"] == "missing y" and not rows[2, None]["has_result"]
    assert toolcalls.linked(calls.limit(0), results.limit(0), fields).count() == 0


def test_levels_of_chains_and_joins(spark):
    common.reach(spark)
    rng, rows, want = random.Random(8), [], {}
    for conv in range(3):
        for i in range(60):
            needs = [] if i == 0 or rng.random() < 0.1 else rng.sample(range(i), min(i, rng.choice([1, 1, 1, 1, 2, 3])))
            if conv == 0 and i:
                needs = [i - 1]
            want[conv, str(i)] = 1 + max((want[conv, str(j)] for j in needs), default=-1)
            rows.append((conv, str(i), [str(j) for j in needs]))
    rows += [(5, "a", ["b"]), (5, "b", ["a"]), (5, "c", ["a"]), (5, "d", ["x"]), (5, "e", ["d", "c"]), (5, "f", [])]
    want[5, "f"] = 0
    calls = spark.createDataFrame(rows, "conv_id bigint, call_id string, needs array<string>")
    assert {(r.conv_id, r.call_id): r.level for r in toolcalls.levels(calls).collect()} == want


def test_conversations_become_calls(spark):
    common.reach(spark)
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "r"), (1, 2, "user", None), (2, 0, "assistant", "x"), (None, 1, "user", "x")]
    calls, results, fields = toolcalls.from_turns(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"))
    every = collected(toolcalls.linked(calls, results, fields))
    rows = sorted((r for r in every if r["conv_id"] == 1), key=lambda r: r["position"])
    assert [(r["call_id"], r["level"], r["has_result"], r["valid"]) for r in rows] == [("call_000000", 0, True, True), ("call_000002", 1, False, True)]
    rest = sorted((r["conv_id"] or 0, r["call_id"], r["name"], r["errors"], r["has_result"]) for r in every if r["conv_id"] != 1)
    assert rest == [(0, None, "answer", "", False), (2, None, None, "result without a call", True)]


def test_no_message_of_a_turn_is_lost(spark):
    common.reach(spark)
    turns = [
        (1, 0, "user", "q"), (1, 0, "user", "q"), (1, 0, "user", "other q"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"),
        (1, 2, "user", "next"), (1, 3, "system", "s"), (1, None, "user", "no turn"), (None, 4, "assistant", "no conversation"),
        (1, 2, "assistant", "said at once"),
    ]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    every = collected(toolcalls.linked(*toolcalls.from_turns(df)))
    spoken = " ".join(r["message"] for r in every)
    for _, _, role, text in turns:
        assert role == "system" or f'"{text}"' in spoken
    assert len(every) == 7 and all(r["message"].count('"q"') <= 1 for r in every)
    calls = [r for r in every if r["name"]]
    assert len({r["call_id"] for r in calls}) == len(calls) == 4
    assert sorted(r["errors"] for r in every if r["errors"]) == ["further result of a call"] * 2 + ["missing turn", "result without a call"]


def test_a_conversation_over_many_ranges(spark):
    roles = random.Random(4).choices(["user", "assistant", "system"], k=900)
    turns = [(conv, n, role, f"t{n}") for conv, size in ((1, 900), (None, 5), (2, 1), (3, 40)) for n, role in enumerate(roles[:size])]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
        assert common.in_ranges(df, "conv_id", F.col("turn").asc()).filter("conv_id = 1").select("part").distinct().count() > 1
        placed = common.positions(df, "conv_id", "position", F.col("turn").asc()).collect()
        assert len(placed) == len(turns) and all(r.position == r.turn + 1 for r in placed)
        calls, results, _ = toolcalls.from_turns(df)
        calls = {(r.conv_id, r.call_id): r.needs for r in calls.filter("conv_id is not null").collect()}
        results = {(r.conv_id, r.call_id, r.content) for r in results.filter("call_id is not null").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want_calls, want_results = {}, set()
    last: dict = {}
    for conv, n, role, text in turns:
        if conv is None:
            continue
        if role == "user":
            want_calls[conv, f"call_{n:06d}"] = [last[conv]] if conv in last else []
            last[conv] = f"call_{n:06d}"
        elif role == "assistant" and conv in last:
            want_results.add((conv, last[conv], text))
    assert calls == want_calls and results == want_results


def test_encoding(docs, empty):
    clash = docs.withColumn("n_tokens", F.lit("x"))
    for r in collected(bpe.encode_texts(clash, RANKS, public_tokenizers.PATTERN)):
        ids = ENCODING.encode_ordinary(r["text"] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.encode_texts(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    assert base64.b64encode(bpe.encoder(RANKS).decode([0])) in open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()


def test_pipeline(spark, docs, empty, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r["doc_id"]: r for r in collected(corpus_pipeline.run(spark, str(tmp_path)))}
    assert {20, 21, 22, 23, 25, 26, 27, 28, None}.isdisjoint(rows) and {0, 1, 2, 3, 24} <= set(rows)
    assert "<EMAIL>" in rows[24]["text"] and rows[24]["n_chars"] == len(rows[24]["text"])
    assert rows[3]["text"] == BASE[3]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
