"""Phrase collocations from count streams in prefix and suffix order.

Phrases of one to three words are counted per language, longer ones only where both of their parts one word shorter reach
the floor, which loses no phrase that does. Tasks know the parts that reach it by a bit table of fixed size (``BITS``):
bits may stand for several phrases, which costs rows but changes no count.

The counts of all lengths form one stream, a row (language, words, count) each. In prefix order a phrase comes right after
its own beginnings, in suffix order (words reversed) right after its own ends. So a single read in order, which remembers
the last one-word and the last two-word row, meets each phrase with the counts of its left parts, or of its right parts;
read backwards, a two-word phrase meets the mark that one of its extensions left. Streams are cut into ranges of the order,
and what a range remembers at its end is handed to the next one, so a word of any frequency may span many ranges and
nothing is looked up by hash.

Texts are lower-cased (A-Z), split at ``[.,;:!?]`` and line breaks into pieces and at spaces and tabs into words. NULL texts
are empty, NULL languages are ``und``, repeated rows count again, texts of any length are read in stretches of ``STRETCH``
words. Ties of score go to the larger count, then the smaller phrase in byte order; ties of cuts to the earlier. Counts
must stay below 10**15, so that the products fit 38 digits. An empty table gives no rows. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import blobs, cut, in_ranges, mix, prefix_hash, span_hash

#: Bits of the table of parts that reach the floor: 8 MB in each task.
BITS = 1 << 26
#: Words read at once, bytes of short texts read together, and distinct phrases a task holds before it hands them on.
STRETCH, CHUNK, HELD = 1 << 18, 1 << 20, 1 << 18

SPACE, BREAK = 0x20, 0x0A


def _bytes() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[ord("A") : ord("Z") + 1] += 32
    out[0x09] = SPACE
    out[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = BREAK
    return out


TABLE = _bytes()


def normal(raw: bytes) -> np.ndarray:
    """Lower-cased bytes with one space between words and a line feed for every break."""
    v = TABLE[np.frombuffer(raw, dtype=np.uint8)]
    again = np.zeros(len(v), dtype=bool)
    again[1:] = (v[1:] == SPACE) & (v[:-1] == SPACE)
    return v[~again]


def indexes(hashes: np.ndarray, lang: str) -> np.ndarray:
    """Places of phrases of ``lang`` in the bit table."""
    return mix(hashes ^ np.uint64(zlib.crc32(lang.encode()) << 20)) & np.uint64(BITS - 1)


def has(bits: np.ndarray, hashes: np.ndarray, lang: str) -> np.ndarray:
    at = indexes(hashes, lang)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def phrases(v: np.ndarray, size: int, lang: str = "", bits: np.ndarray | None = None) -> Iterator[list[bytes]]:
    """The phrases of ``size`` words within pieces, with repeats, whose two parts of ``size - 1`` words are in ``bits``."""
    if size == 1:
        yield from singles(v.tobytes())
        return
    inside = np.zeros(len(v) + 2, dtype=np.int8)
    inside[1:-1] = (v != SPACE) & (v != BREAK)
    edges = np.flatnonzero(np.diff(inside))
    start, end = edges[::2], edges[1::2]
    last = len(start) - size + 1
    if last <= 0:
        return
    near = (start[1:] == end[:-1] + 1) & (v[end[:-1]] == SPACE)  # words i and i + 1 stand in one piece
    fits = np.ones(last, dtype=bool)
    for i in range(size - 1):
        fits &= near[i : i + last]
    for low in range(0, last, STRETCH):
        fit = fits[low : low + STRETCH]
        first = start[low]
        part = v[first : end[low + len(fit) + size - 2]]
        if bits is not None:
            k = np.arange(low, low + len(fit) + 1)
            known = has(bits, span_hash(prefix_hash(part), start[k] - first, end[k + size - 2] - first), lang)
            fit = fit & known[:-1] & known[1:]
        i = low + np.flatnonzero(fit)
        raw = part.tobytes()
        yield [raw[a:b] for a, b in zip((start[i] - first).tolist(), (end[i + size - 1] - first).tolist())]


def singles(raw: bytes) -> Iterator[list[bytes]]:
    """The words of normal bytes, a stretch at a time."""
    low = 0
    while low < len(raw):
        cuts = [at for at in (raw.find(b" ", low + CHUNK), raw.find(b"\n", low + CHUNK)) if at >= 0]
        high = min(cuts, default=len(raw))
        yield raw[low:high].split()
        low = high


def chunks(langs: list[str], texts: list[bytes]) -> Iterator[tuple[str, bytes]]:
    """Texts by language, short ones joined by a break."""
    by_lang: dict[str, list[bytes]] = {}
    for lang, text in zip(langs, texts):
        by_lang.setdefault(lang, []).append(text)
    for lang, some in by_lang.items():
        held, size = [], 0
        for text in some:
            held.append(text)
            size += len(text)
            if size >= CHUNK:
                yield lang, b"\n".join(held)
                held, size = [], 0
        if held:
            yield lang, b"\n".join(held)


def counted(docs: DataFrame, size: int, floor: int, bits: np.ndarray | None = None) -> DataFrame:
    """``(lang, phrase, f)`` of the phrases (lang, text) of ``size`` words with f >= floor. One-word counts also give each
    language's sum, as the count of the NULL phrase."""
    sent = docs.sparkSession.sparkContext.broadcast(bits) if bits is not None else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        sums: Counter = Counter()
        known = sent.value if sent is not None else None

        def rows(lang: str, counts: dict[bytes | None, int]) -> pa.RecordBatch:
            columns = [
                pa.array([lang], pa.string()).take(pa.array(np.zeros(len(counts), dtype=np.int64))),
                pa.array(counts, pa.binary()).cast(pa.string()),
                pa.array(counts.values(), pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "f"])

        for batch in batches:
            for lang, raw in chunks(batch.column("lang").to_pylist(), blobs(batch, "text")):
                own = held.setdefault(lang, Counter())
                for some in phrases(normal(raw), size, lang, known):
                    own.update(some)
                    sums[lang] += len(some)
                if sum(map(len, held.values())) >= HELD:
                    yield from (rows(*item) for item in held.items() if item[1])
                    held = {}
        yield from (rows(*item) for item in held.items() if item[1])
        if size == 1:
            yield from (rows(lang, {None: n}) for lang, n in sums.items())

    # Tasks have counted already, so rows go to their phrase's task without another count before the shuffle.
    found = docs.mapInArrow(count, "lang string, phrase string, f bigint").repartition("lang", "phrase")
    found = found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    out = cut(found.where((F.col("f") >= floor) | F.col("phrase").isNull()), f"phrases-{size}")
    if sent is not None:
        sent.destroy()
    return out


def bit_table(known: DataFrame) -> np.ndarray:
    """The bit table of the phrases (lang, phrase): ``BITS / 32768`` rows of 4 KB at most reach the driver."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, phrase in zip(batch.column("lang").to_pylist(), blobs(batch, "phrase")):
                by_lang.setdefault(lang, []).append(phrase)
            for lang, some in by_lang.items():
                end = np.cumsum([len(p) + 1 for p in some])
                start = np.concatenate([[0], end[:-1]])
                sums = prefix_hash(np.frombuffer(b"\n".join(some) + b"\n", dtype=np.uint8))
                at = np.unique(indexes(span_hash(sums, start, end - 1), lang)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at >> 15), pa.array(at & 32767)], names=["block", "bit"])

    places = known.select("lang", "phrase").mapInArrow(place, "block bigint, bit bigint")
    bits = np.zeros(BITS // 8, dtype=np.uint8)
    for row in places.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        bits[row["block"] * 4096 : (row["block"] + 1) * 4096] = np.frombuffer(row["bits"], dtype=np.uint8)
    return bits


def remembered(stream: DataFrame, values: dict[str, Column], key: str, down: bool = False) -> DataFrame:
    """``stream``, in ranges ``part`` of (lang, key), with the last of each value that is not NULL up to each row, read
    upwards or downwards."""

    def order(turned: bool) -> list[Column]:
        return [F.col(c).desc() if turned else F.col(c).asc() for c in ("lang", key)]

    inside = Window.partitionBy("part").orderBy(*order(down)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = stream.withColumns({name: F.last(value, ignorenulls=True).over(inside) for name, value in values.items()})
    # What a range hands on stands in its last row; there are no more rows of this kind than ranges.
    place = F.struct("lang", key)
    last = F.min_by(F.struct(*values), place) if down else F.max_by(F.struct(*values), place)
    tails = here.groupBy("part").agg(last.alias("_tail"))
    before = Window.orderBy(F.col("part").desc() if down else F.col("part").asc())
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    handed = [F.last(F.col("_tail")[name], ignorenulls=True).over(before).alias(f"_{name}") for name in values]
    joined = here.join(tails.select(F.col("part").alias("_part"), *handed), F.col("part") == F.col("_part"))
    whole = {name: F.coalesce(name, f"_{name}") for name in values}
    return joined.withColumns(whole).drop("_part", *[f"_{name}" for name in values])


def parts_met(rows: DataFrame, key: str, share: float, names: tuple[str, str, str]) -> DataFrame:
    """``rows`` (lang, phrase, f, size) in the order of ``key``, with the counts of the one and two first words of ``key``
    and whether a phrase one word longer in this order has ``share`` of the count."""
    one, two, covered = names
    stream = in_ranges(rows, "lang", F.col(key))
    counts = {one: F.when(F.col("size") == 1, F.col("f")), two: F.when(F.col("size") == 2, F.col("f"))}
    stream = cut(remembered(stream, counts, key), "stream")
    extended = F.struct("lang", F.slice(key, 1, 2).alias("words"))
    marks = F.when((F.col("size") == 3) & (F.col("f") >= share * F.col(two)), extended)
    stream = remembered(stream, {"mark": marks}, key, down=True)
    own = F.col("mark").eqNullSafe(F.struct("lang", F.col(key).alias("words")))
    return stream.withColumn(covered, own).drop("mark", "part", key)


def whole_score(a: Column, left: Column, right: Column) -> Column:
    """floor(10**6 a a / (left right)), in 38 digits."""
    a, left, right = (c.cast("decimal(19,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (a * a), left * right)


def collocations(
    docs: DataFrame, floor: int = 10, share: float = 0.5, top: int = 2000, lang_column: str = "lang", text_column: str = "text"
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases of two and three words."""
    texts = docs.select(F.coalesce(F.col(f"`{lang_column}`"), F.lit("und")).alias("lang"), F.col(f"`{text_column}`").alias("text"))
    singles = counted(texts, 1, floor)
    known = singles.where("phrase is not null")
    doubles = counted(texts, 2, floor, bit_table(known))
    triples = counted(texts, 3, floor, bit_table(doubles))
    stream = known.unionByName(doubles).unionByName(triples)
    words = F.split("phrase", " ")
    stream = stream.select("lang", "phrase", "f", F.size(words).alias("size"), words.alias("ahead"))
    stream = parts_met(stream, "ahead", share, ("l1", "l2", "extended_right"))
    stream = stream.withColumn("behind", F.reverse(F.split("phrase", " ")))
    stream = parts_met(stream, "behind", share, ("r1", "r2", "extended_left"))

    pair = F.col("size") == 2
    early = whole_score(F.col("f"), F.col("l1"), F.when(pair, F.col("r1")).otherwise(F.col("r2")))
    late = F.when(~pair, whole_score(F.col("f"), F.col("l2"), F.col("r1")))
    scored = stream.where("size > 1 and not (size = 2 and (extended_right or extended_left))")
    scored = scored.withColumn("early", early).withColumn("late", late)
    first = F.col("late").isNull() | (F.col("early") <= F.col("late"))
    scored = scored.select(
        "lang",
        "phrase",
        F.col("f").alias("a"),
        F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(first & ~pair, F.col("r2")).otherwise(F.col("r1")).alias("r"),
        F.when(first, F.col("early")).otherwise(F.col("late")).alias("score"),
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    sums = singles.where("phrase is null").select("lang", F.col("f").alias("n"))
    return best.join(sums, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
