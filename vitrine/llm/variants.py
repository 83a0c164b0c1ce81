"""Spelling variants: words one code point apart, found through a dictionary of pairs of trie nodes.

Words stand in a forward trie and, read backwards, in a reversed one. A word of L code points passes the pairs (prefix
node i, suffix node i) for i = 0..L, its whole places, and (prefix node i, suffix node i + 1) for i < L, its places with one
code point skipped. Two words differ by a replaced code point if they share a skipping pair, and by an inserted one if a
skipping pair of the longer is a whole pair of the shorter. Nodes are numbered by a table of each trie, so that the join
is on two integers; no pattern string is built. A node that only one word passes can join nothing and gets no number.
Where a code point stands in a run of equal ones, only the first may count as inserted, so that each pair of neighbours
meets at one pair of nodes. At a pair of nodes at most one whole word and one word per letter of the alphabet meet.

Nodes are told apart by the code points on their path, summed up as a number modulo the prime 2**127 - 1.

Words come from ``words``: NULL and empty texts have none, NULL ids count as empty text, repeated rows count again, and a
word of any length costs two rows a code point. Ties of counts go to the smaller word in code-point order. An empty table
gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import cut

PRIME = (1 << 127) - 1
BASE = 0x5851F42D4C957F2D14057B7EF767814F % PRIME
#: Rows of one Arrow batch of places.
BATCH = 1 << 16

PLACES = "number bigint, n bigint, whole boolean, first boolean, ahead binary, behind binary"


def words(
    docs: DataFrame, least_size: int = 5, least_n: int = 3, every: int = 97, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``(word, n)`` of runs of Latin letters, A-Z lower-cased. Where ``every`` divides the crc32 ``h`` of ``<id>:<run>``,
    the run's code point h % length is deleted."""
    text = F.translate(F.coalesce(F.col(f"`{text_column}`"), F.lit("")), ascii_uppercase, ascii_lowercase)
    name = F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit(""))
    runs = F.regexp_extract_all(text, F.lit(f"[a-zÀ-ÿ]{{{least_size},}}"), F.lit(0))
    run = F.col("run")
    h = F.crc32(F.encode(F.concat(F.col("name"), F.lit(":"), run), "UTF-8"))
    place = (F.col("h") % F.length(run)).cast("int")
    shorter = F.concat(F.substr(run, F.lit(1), place), F.substr(run, place + 2))
    return (
        docs.select(name.alias("name"), F.explode(runs).alias("run"))
        .withColumn("h", h)
        .select(F.when(F.col("h") % every == 0, shorter).otherwise(run).alias("word"))
        .where(F.length("word") >= least_size)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= least_n)
    )


def paths(points: list[int]) -> list[bytes]:
    """The key of each node from the root along ``points``."""
    out, key = [bytes(16)], 0
    for p in points:
        key = (key * BASE + p + 1) % PRIME
        out.append(key.to_bytes(16, "big"))
    return out


def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word's whole and skipping pairs of node keys."""
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary()]
        names = [c.split()[0] for c in PLACES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    for batch in batches:
        for number, word, n in zip(*(batch.column(c).to_pylist() for c in ("number", "word", "n"))):
            points = [ord(c) for c in word]
            ahead, behind = paths(points), paths(points[::-1])[::-1]
            for i in range(len(points) + 1):
                held.append((number, n, True, True, ahead[i], behind[i]))
                if i < len(points):
                    first = i == 0 or points[i - 1] != points[i]
                    held.append((number, n, False, first, ahead[i], behind[i + 1]))
                if len(held) >= BATCH:
                    yield flush()
                    held = []
    if held:
        yield flush()


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` at nodes of ``key`` that several words pass, with the node's number in place of the key. The root, which
    all words pass, has number -1 and needs no join."""
    inner = rows.where(F.col(key) != F.lit(bytes(16)))
    shared = inner.groupBy(key).agg(F.min("number").alias("low"), F.max("number").alias("high")).where("low < high")
    nodes = cut(shared.select(key, F.monotonically_increasing_id().alias(name)), "nodes")
    root = rows.where(F.col(key) == F.lit(bytes(16))).withColumn(name, F.lit(-1).cast("long"))
    return inner.join(nodes, key).drop(key).unionByName(root.drop(key))


def neighbours(known: DataFrame) -> DataFrame:
    """``(number, n_near, best)`` of the words (number, word, n) that have neighbours: how many, and the one of largest n,
    then least number, as (n, number)."""
    rows = cut(known.select("number", "word", "n").mapInArrow(places, PLACES), "places")
    ahead = cut(numbered(rows, "ahead", "prefix"), "places")
    pairs = numbered(ahead, "behind", "suffix")
    member = F.struct((-F.col("n")).alias("less"), "number", "whole", "first")
    # A pair of nodes fixes all of a word but one letter: the list is no longer than the alphabet.
    met = pairs.groupBy("prefix", "suffix").agg(F.sort_array(F.collect_list(member)).alias("met"))
    met = met.where(F.size("met") > 1).select("met", F.explode("met").alias("x"))
    x = F.col("x")

    def near(y):
        replaced = ~x.whole & ~y.whole
        inserted = (x.whole != y.whole) & x.first & y.first
        return (x.number != y.number) & (replaced | inserted)

    links = met.select(x.number.alias("number"), F.filter("met", near).alias("near")).where(F.size("near") > 0)
    best = F.struct(F.col("near")[0].less.alias("less"), F.col("near")[0].number.alias("number"))
    found = links.select("number", F.size("near").cast("long").alias("count"), best.alias("best"))
    found = found.groupBy("number").agg(F.sum("count").alias("n_near"), F.min("best").alias("best"))
    return found.select("number", "n_near", F.struct((-F.col("best.less")).alias("n"), F.col("best.number").alias("number")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``(number, root)``: where the links (number, up) end. Every round doubles the length of a link."""
    links = cut(forms.select("number", "up"), "forms")
    while True:
        further = links.select(F.col("number").alias("via"), F.col("up").alias("next"))
        longer = links.join(further, F.col("up") == F.col("via"), "left")
        longer = cut(longer.select("number", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "forms")
        links = longer.select("number", "up")
        if longer.where("moved").isEmpty():
            return links.select("number", F.col("up").alias("root"))


def grouped(counts: DataFrame, ratio: int = 2) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of words (word, n): the form is the near word of largest n, if that is
    at least ``ratio`` times the word's; the root is where following forms ends."""
    known = counts.select("word", "n").orderBy("word").withColumn("number", F.monotonically_increasing_id())
    known = cut(known, "words")
    found = known.select("number", "n").join(neighbours(known), "number", "left")
    enough = F.col("best.n") >= ratio * F.col("n")
    found = cut(
        found.select(
            "number",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(enough, F.col("best.number")).alias("up"),
            F.when(enough, F.col("best.n")).alias("form_n"),
        ),
        "near",
    )
    ends = roots(found.where("up is not null"))
    named = known.select("number", "word")
    formed = found.where("up is not null").join(ends, "number")
    forms = named.select(F.col("number").alias("up"), F.col("word").alias("form"))
    lasts = named.select(F.col("number").alias("root"), F.col("word").alias("last"))
    formed = formed.join(forms, "up").join(lasts, "root").select("number", "form", "last")
    out = found.join(named, "number").join(formed, "number", "left")
    return out.select("word", "form", F.coalesce("last", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, **names: str) -> DataFrame:
    """Words of the texts, grouped."""
    return grouped(words(docs, **names))
