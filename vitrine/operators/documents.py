"""Documents: lines, sections, chunks, and retrieval of sections by number or keyword."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import sections as S
from vitrine.functions import values as V
from vitrine.functions.text import fold, strip
from vitrine.operators.matching import contains_pairs

DOC_TAG = "Manual"
BLOCK = 1000


def doc_lines(documents: DataFrame, running_header: str | None = None) -> DataFrame:
    """``(doc_id, pos, line, is_heading)`` of the lines that carry content."""
    content = S.content_lines(F.col("text"), running_header)
    return documents.select("doc_id", F.posexplode(content).alias("pos", "line")).withColumn(
        "is_heading", S.is_heading(F.col("line"))
    )


def _cut(documents: DataFrame, running_header: str | None) -> DataFrame:
    heads = F.filter(
        F.transform("_lines", lambda line, i: F.when(S.is_heading(line), i)), lambda i: i.isNotNull()
    )
    return (
        documents.withColumn("_lines", S.content_lines(F.col("text"), running_header))
        .withColumn("_heads", heads)
        .select("doc_id", S.cut_sections(F.col("_lines"), F.col("_heads")).alias("sections"))
    )


def doc_sections(documents: DataFrame, running_header: str | None = None) -> DataFrame:
    """``(doc_id, section_no, section, body)``; no shuffle."""
    # The outer form keeps Catalyst from inferring a filter that would cut every document a second time.
    cut = _cut(documents, running_header).select("doc_id", F.posexplode_outer("sections").alias("section_no", "s"))
    return cut.where("s is not null").select("doc_id", "section_no", "s.section", "s.body")


def doc_chunks(
    documents: DataFrame,
    running_header: str | None = None,
    tag: str = DOC_TAG,
    max_chars: int = V.MAX_CHUNK_CHARS,
) -> DataFrame:
    """``(doc_id, chunk_no, section, text)``: section pieces of at most ``max_chars``, tagged, numbered from 1."""
    pieces = F.flatten(
        F.transform(
            "sections",
            lambda s: F.transform(
                S.pack(s["body"], max_chars),
                lambda p: F.struct(s["section"].alias("section"), S.add_tag(tag, s["section"], p).alias("text")),
            ),
        )
    )
    return (
        _cut(documents, running_header)
        .select("doc_id", F.posexplode(pieces).alias("pos", "c"))
        .select("doc_id", (F.col("pos") + 1).alias("chunk_no"), "c.section", "c.text")
    )


def rejoin_sections(chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(doc_id, first_chunk, section, text)``: neighbouring chunks of one section, tags stripped, joined by newlines.

    Chunk numbers are consecutive, so a run starts where the chunk before (an equality join) has another
    section. Runs are carried forward in two steps, within blocks of chunks and across blocks, so a
    document with a third of all chunks is never one task.
    """
    before = chunks.select("doc_id", (F.col("chunk_no") + 1).alias("chunk_no"), F.col("section").alias("_previous"))
    starts = F.when(~F.col("section").eqNullSafe(F.col("_previous")), F.col("chunk_no"))
    marked = (
        chunks.join(before, ["doc_id", "chunk_no"], "left")
        .withColumn("_start", starts)
        .withColumn("_block", F.floor(F.col("chunk_no") / block))
    )
    inside = Window.partitionBy("doc_id", "_block").orderBy("chunk_no")
    across = Window.partitionBy("doc_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        marked.groupBy("doc_id", "_block")
        .agg(F.max("_start").alias("_last"))
        .withColumn("_carried", F.max("_last").over(across))
        .drop("_last")
    )
    run = F.coalesce(F.max("_start").over(inside), F.col("_carried"))
    texts = F.sort_array(F.collect_list(F.struct("chunk_no", S.drop_tag(F.col("text")).alias("text"))))
    return (
        marked.join(carried, ["doc_id", "_block"])
        .withColumn("first_chunk", run)
        .groupBy("doc_id", "first_chunk", "section")
        .agg(F.array_join(F.transform(texts, lambda t: t["text"]), "\n").alias("text"))
    )


def titles(sections: DataFrame) -> DataFrame:
    """``(doc_id, section_no, section)``: the section list of each document."""
    return sections.select("doc_id", "section_no", "section")


def section_key(section: Column) -> Column:
    """What a section argument asks for; trailing dots of a number are dropped."""
    key = fold(strip(section))
    return F.when(F.rlike(key, F.lit("^[\\p{Nd}.]+$")), F.rtrim(key, F.lit("."))).otherwise(key)


def is_number(key: Column) -> Column:
    return F.rlike(key, F.lit("^[\\p{Nd}.]+$"))


def by_number(requests: DataFrame, sections: DataFrame) -> DataFrame:
    """``(doc_id, key, section_no)``: the numbered section and everything below it.

    Sections list their own number and its ancestors and join by equality, so ``4`` never meets ``40``.
    """
    keys = requests.select("doc_id", "key").where(is_number(F.col("key"))).distinct()
    numbered = sections.select(
        "doc_id", "section_no", F.explode(S.number_and_ancestors(S.section_number(F.col("section")))).alias("key")
    ).where("key != ''")
    return numbered.join(keys, ["doc_id", "key"]).select("doc_id", "key", "section_no")


def by_keyword(requests: DataFrame, sections: DataFrame) -> DataFrame:
    """``(doc_id, key, section_no)``: sections whose folded title and body contain the keyword."""
    keys = requests.select("doc_id", "key").where((F.col("key") != "") & ~is_number(F.col("key"))).distinct()
    texts = sections.select("doc_id", "section_no", fold(F.concat_ws(" ", "section", "body")).alias("_folded"))
    return texts.join(keys, "doc_id").where(F.contains("_folded", "key")).select("doc_id", "key", "section_no")


def retrieve(requests: DataFrame, sections: DataFrame) -> DataFrame:
    """``(doc_id, key, found, section_no, section, body)`` for each distinct (doc_id, section) asked.

    A blank section asks for the whole document. A key that finds nothing lists all titles instead:
    ``found`` is false and ``body`` NULL. Requests join the answer on (doc_id, section_key(section)).
    """
    asked = requests.select("doc_id", F.coalesce(section_key(F.col("section")), F.lit("")).alias("key")).distinct()
    picked = by_number(asked, sections).unionByName(by_keyword(asked, sections))
    missed = asked.where("key != ''").join(picked, ["doc_id", "key"], "left_anti")
    hits = picked.join(sections, ["doc_id", "section_no"]).withColumn("found", F.lit(True))
    whole = asked.where("key = ''").join(sections, "doc_id").withColumn("found", F.lit(True))
    listed = (
        missed.join(titles(sections), "doc_id")
        .withColumn("body", F.lit(None).cast("string"))
        .withColumn("found", F.lit(False))
    )
    columns = ["doc_id", "key", "found", "section_no", "section", "body"]
    return hits.select(columns).unionByName(whole.select(columns)).unionByName(listed.select(columns))
