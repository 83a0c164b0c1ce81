"""Session registry, chunk table and transcripts: what is written, replaced, removed and read back."""

import datetime as dt
import os
import random

import pytest

from vitrine.operators import documents as D
from vitrine.sources import sessions, sinks, versions


def at(i):
    return dt.datetime(2026, 1, 1, 12, 0, i % 60)


def message(session, number, role="user", content="x"):
    return (session, number, role, content, at(number or 0))


def changes(spark, rows):
    return spark.createDataFrame(rows, sessions.MESSAGE)


def state(spark, base):
    now = sessions.read(spark, base)
    return (
        sorted((r.session_id, r.message_id) for r in now.messages.collect()),
        sorted((r.session_id, r.first_message_id) for r in now.sessions.collect()),
    )


def counts(merged):
    return {r.table: (r.added, r.removed) for r in merged.collect()}


def brute(parts):
    """Messages and sessions after ``parts``, change by change."""
    until, messages, opened = {}, {}, {}
    for part in parts:
        for s, n, role, *_ in part:
            if role == sessions.RESET:
                until[s] = max(until.get(s, n), n)
        new = {}
        for s, n, role, *_ in part:
            if role != sessions.RESET and (s, n) not in messages and n > until.get(s, -1):
                new.setdefault(s, set()).add(n)
        opened = {s: n for s, n in opened.items() if n > until.get(s, -1)}
        messages = {k: 1 for k in messages if k[1] > until.get(k[0], -1)}
        for s, numbers in new.items():
            opened.setdefault(s, min(numbers))
            messages.update({(s, n): 1 for n in numbers})
    return sorted(messages), sorted(opened.items())


def test_merges_equal_a_plain_registry(spark, tmp_path):
    base, rng, parts = str(tmp_path / "log"), random.Random(2), []
    for _ in range(4):
        part = [message(rng.choice("abcdef"), rng.randrange(1, 40)) for _ in range(30)]
        part += [message(rng.choice("abcdef"), rng.randrange(1, 25), sessions.RESET) for _ in range(2)]
        parts.append(part)
        before = brute(parts[:-1])
        added = counts(sessions.merge(spark, base, changes(spark, part)))
        now = brute(parts)
        assert state(spark, base) == now
        for i, name in enumerate(("messages", "sessions")):
            assert added[name][0] - added[name][1] == len(now[i]) - len(before[i])
    sessions.compact(spark, base)
    assert state(spark, base) == brute(parts) and len(versions.committed(spark, base)) == 1
    late = [message("a", 1), message("z", 3)]
    parts.append([message("a", 24, sessions.RESET)])
    sessions.merge(spark, base, changes(spark, parts[-1]))
    parts.append(late)
    sessions.merge(spark, base, changes(spark, late))
    assert state(spark, base) == brute(parts)


def test_a_batch_is_merged_once_and_a_failed_change_is_not_seen(spark, tmp_path):
    base = str(tmp_path / "log")
    assert state(spark, base) == ([], [])
    first = [message("a", 1), message("a", 1), message("a", 2), message("b", 1), message(None, 1), message("c", None)]
    assert counts(sessions.merge(spark, base, changes(spark, first), "one")) == {"messages": (4, 0), "sessions": (3, 0)}
    assert counts(sessions.merge(spark, base, changes(spark, [message("q", 9)]), "one")) == {"messages": (0, 0), "sessions": (0, 0)}
    with pytest.raises(Exception):
        sessions.merge(spark, base, changes(spark, [message("d", 1)]).selectExpr("*", "raise_error('no')").withColumnRenamed("raise_error(no)", "role2").drop("role").withColumnRenamed("role2", "role"))
    assert {s for s, _ in state(spark, base)[0]} == {"a", "b", "c"}
    gone = counts(sessions.merge(spark, base, changes(spark, [message("a", 5, sessions.RESET), message("a", 6)])))
    assert gone == {"messages": (1, 2), "sessions": (1, 1)}
    assert ("a", 6) in state(spark, base)[1]


def test_streams_merge_into_the_same_registry(spark, tmp_path):
    base, source, check = (str(tmp_path / n) for n in ("log", "in", "check"))
    parts = [[message("a", 1), message("b", 1)], [message("a", 1), message("a", 2, sessions.RESET), message("b", 2)]]
    for part in parts:
        changes(spark, part).coalesce(1).write.mode("append").parquet(source)
        sessions.follow(spark.readStream.schema(sessions.MESSAGE).parquet(source), base, check).awaitTermination()
    assert state(spark, base) == ([("b", 1), ("b", 2)], [("b", 1)])


def test_chunks_are_written_for_changed_documents_only(spark, tmp_path):
    base = str(tmp_path / "chunks")

    def docs(texts):
        return spark.createDataFrame(list(texts.items()), "doc_id long, text string")

    def put(texts):
        return {r.table: (r.written, r.removed) for r in sinks.replace_chunks(spark, base, docs(texts)).collect()}

    def check(texts):
        want = sorted(tuple(r) for r in D.doc_chunks(docs(texts)).collect())
        assert sorted((r.doc_id, r.chunk_no, r.section, r.text) for r in sinks.read_chunks(spark, base).collect()) == want
        return len(want)

    texts = {i: f"1. Parte {i}\nlinha um.\n2. Outra\nlinha dois {i}." for i in range(20)} | {50: "", 51: None}
    assert put(texts) == {"documents": (22, 0), "chunks": (check(texts), None)}
    assert put(texts) == {"documents": (0, 0), "chunks": (0, None)}
    assert len(versions.committed(spark, base)) == 1
    changed = {**texts, 3: "3. Novo\ntexto.", 60: "Capa só."}
    del changed[7]
    written = put(changed)
    assert written["documents"] == (2, 1) and written["chunks"][0] == 2
    check(changed)
    put(texts)
    check(texts)


def test_many_transcripts_share_few_files(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.range(100_000).selectExpr(
        "concat('s', id) as session_id", "concat('model: m\\n\\n**Olá ', id, ':** é\\n', repeat('x', cast(id % 50 as int))) as transcript"
    )
    sinks.write_transcripts(rows, out)
    files = [f for _, _, names in os.walk(f"{out}/texts") for f in names if f.endswith(".txt")]
    assert len(files) <= 200
    asked = {f"s{i}": f"model: m\n\n**Olá {i}:** é\n" + "x" * (i % 50) for i in (0, 17, 4_242, 99_999)}
    got = {r.session_id: r.transcript for r in sinks.read_transcripts(spark, out, *asked, "unknown").collect()}
    assert got == asked


def test_empty_and_null_transcripts(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([("a", None), ("b", ""), ("c", "x\ny")], "session_id string, transcript string")
    sinks.write_transcripts(rows, out, per_file=1)
    got = {r.session_id: r.transcript for r in sinks.read_transcripts(spark, out, "a", "b", "c").collect()}
    assert got == {"a": "", "b": "", "c": "x\ny"}
    sinks.write_transcripts(rows.limit(0), out)
    assert spark.read.parquet(f"{out}/manifest").count() == 0
