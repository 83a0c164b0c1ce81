"""Near-duplicate texts by Order MinHash, verified by banded alignment.

Texts are sequences of words (runs of letters, digits and non-ASCII characters, ASCII case folded). Each run of
``SHINGLE`` words is labelled with how often it occurred before in its text. A sketch takes the ``PICK`` labelled
shingles that are least under its own random order and writes them in the order of the text, so that texts agree where
they have the same shingles in the same order, which follows edit similarity rather than set overlap.

Texts with a sketch in common are candidates. A candidate pair is a link if its edit distance in words, found in a band
around the diagonal, is at most (1 - SIMILARITY) times the longer text. Linked texts form classes.

Candidates meet in ``LEADERS`` rounds. In each a text meets the leaders, drawn anew, of ``LED`` of its buckets that still
hold several classes; so a crowd of near copies is joined by at most ``LED`` pairs a text and round, whatever its size and
whatever leads its buckets. Rounds end early when one leaves nearly all rows in such buckets. Then, in buckets that still
hold several classes, all pairs of different classes meet. In the
rounds and in the end lengths and counts of hashed words rule out, without an error, nearly all pairs that are too far
apart; only the others are aligned, and at the end only they are written. So two texts that share a bucket are in one
class if they are near, whatever leads their buckets. The tests of
lengths and counts, not the rows written, grow with the square of the texts that share a passage but are no near-duplicates;
they are dealt out in pairs of blocks of some ``BLOCK`` texts.

Equal texts are one node throughout, whatever their number. Texts without a word are near-duplicates only of equal
texts, NULL counts as empty; texts under ``SHINGLE`` words have one shingle, the whole text. Rows with equal or NULL ids
are kept apart; a class is named by its least id, NULL if no row of the class has one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import blobs, classes, cut, edit_distance, mix, text_key, word_chunks, words

SHINGLE, PICK, SIMILARITY = 5, 2, 0.8
#: Sketches per text. At 10 % edited words two texts agree in a sketch with some 17 %, in one of 64 with nearly all; at 15 % with 99 %, at 20 % with 92 %.
SKETCHES = 64
#: Rounds with leaders drawn anew, and buckets whose leaders a text meets in each.
LEADERS, LED = 3, 4
#: A round that leaves this share of the rows or more in buckets of several classes is the last.
STALLED = 0.99
#: Texts of a bucket that one task holds of either side, and word counts per text.
BLOCK, BAG = 1024, 512
#: Bits of the table of the texts that a round aligns: at most 2 MB, whatever the number of texts.
BITS = 1 << 24
#: Pairs that ``far_apart`` tests side by side, at least and at most, and the widest band it takes.
SIDE, WIDEST = (48, 512), 1024
_rng = np.random.default_rng(20)
_turn = _rng.integers(1, 1 << 63, (SKETCHES, 1), dtype=np.uint64) | np.uint64(1)
_salt = _rng.integers(1, 1 << 63, (SKETCHES, 1), dtype=np.uint64)
_step = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of the labelled shingles in text order."""
    n = max(1, len(h) - SHINGLE + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out += h[k : k + n] * _step[k]
    out = mix(out)
    order = np.argsort(out, kind="stable")
    same = np.concatenate([[False], out[order][1:] == out[order][:-1]])
    place = np.arange(n)
    label = np.empty(n, dtype=np.uint64)
    label[order] = place - np.maximum.accumulate(np.where(same, 0, place))
    return mix(out + label * np.uint64(0xA24BAED4963EE407))


def sketches(h: np.ndarray) -> np.ndarray:
    """One hash per sketch."""
    s = shingles(h)
    which = np.arange(SKETCHES)
    ranks = (s ^ _salt) * _turn
    places = np.empty((SKETCHES, min(PICK, len(s))), dtype=np.int64)
    for k in range(places.shape[1]):
        places[:, k] = ranks.argmin(axis=1)
        ranks[which, places[:, k]] = np.uint64((1 << 64) - 1)
    places.sort(axis=1)
    out = which.astype(np.uint64)
    for k in range(places.shape[1]):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + s[places[:, k]])
    return out.view(np.int64)


def bag(h: np.ndarray) -> bytes:
    """How many words fall on each of ``BAG`` values, at most 255."""
    return np.minimum(np.bincount((mix(h) % np.uint64(BAG)).astype(np.int64), minlength=BAG), 255).astype(np.uint8).tobytes()


def possible(size: np.ndarray, bags: np.ndarray, root: np.ndarray, own: np.ndarray, across: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Places, in order of size, and for each the later places of other classes (``across``: and other blocks) that lengths
    and word counts allow to be near. ``d`` edits change the counts by at most 2 d less the difference of the lengths."""
    most = ((1 - SIMILARITY) * size + 1e-9).astype(np.int64)
    ends = np.searchsorted(size - most, size, "right")
    for x in range(len(size) - 1):
        others = root[x + 1 : ends[x]] != root[x]
        if across:
            others &= own[x + 1 : ends[x]] != own[x]
        y = np.flatnonzero(others) + x + 1
        if len(y):
            apart = np.abs(bags[y] - bags[x]).sum(axis=1, dtype=np.int64)
            y = y[apart <= 2 * most[y] - (size[y] - size[x])]
            if len(y):
                yield x, y


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): the pairs of ``possible`` of each bucket and pair of blocks, each pair in the first bucket it shares only;
    rows come sorted by these and by size."""
    held: list[pa.RecordBatch] = []
    group: tuple | None = None

    def passed() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        keys = rows.column("key").to_pylist()
        size = rows.column("size").to_numpy()
        bags = np.frombuffer(b"".join(rows.column("bag").to_pylist()), dtype=np.uint8).reshape(-1, BAG).astype(np.int16)
        root = np.unique(np.array(rows.column("root").to_pylist(), dtype=object), return_inverse=True)[1]
        sketched = rows.column("sketches").combine_chunks().flatten().to_numpy().reshape(-1, SKETCHES)
        before = int((sketched[0] == group[0]).argmax())
        a, b = [], []
        for x, y in possible(size, bags, root, rows.column("own").to_numpy(), group[1] != group[2]):
            for k in y[(sketched[y, :before] != sketched[x, :before]).all(axis=1)].tolist():
                a.append(min(keys[x], keys[k]))
                b.append(max(keys[x], keys[k]))
            if len(a) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        place = np.stack([batch.column(c).to_numpy() for c in ("bucket", "i", "j")])
        starts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(starts, starts[1:]):
            here = tuple(place[:, start].tolist())
            if here != group and held:
                yield from passed()
                held.clear()
            group = here
            held.append(batch.slice(start, end - start))
    if held:
        yield from passed()


def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose lengths and word counts allow them to be near, as ``possible`` tests them."""
    for batch in batches:
        a, b = (batch.column(c).to_numpy() for c in ("size_a", "size_b"))
        counts = [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, BAG) for c in ("bag_a", "bag_b")]
        most = ((1 - SIMILARITY) * np.maximum(a, b) + 1e-9).astype(np.int64)
        apart = np.abs(counts[0].astype(np.int16) - counts[1]).sum(axis=1, dtype=np.int64)
        at = pa.array(np.flatnonzero((np.abs(a - b) <= most) & (apart <= 2 * most - np.abs(a - b))))
        yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("a", "b")], names=["a", "b"])


def lower_bounds(pairs: list[tuple[np.ndarray, np.ndarray]], most: np.ndarray) -> np.ndarray:
    """What the edit distance of each pair is at least, or above its ``most`` if that is: ``edit_distance`` of the last 15 bits of
    the word hashes, in bands of 64-bit words, one line a pair. Words that agree in these bits can only make it less."""

    def short(h: np.ndarray) -> np.ndarray:
        return (h.astype(np.uint16) & np.uint16(0x7FFF)) + np.uint16(1)  # 0 stands beside the text

    count, width = len(pairs), 2 * most + 1
    n, m = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    limbs = int(width.max()) // 64 + 1
    span = limbs * 64
    # Column j compares its word with the rows from j - most on, which stand from place j on.
    rows = np.zeros((count, int(m.max()) + span + 1), dtype=np.uint16)
    columns = np.zeros((int(m.max()) + 1, count, 1), dtype=np.uint16)
    for i, (a, b) in enumerate(pairs):
        take = min(len(a), rows.shape[1] - int(most[i]) - 1)
        rows[i, most[i] + 1 : most[i] + 1 + take] = short(a[:take])
        columns[1 : len(b) + 1, i, 0] = short(b)

    def ones(size: np.ndarray) -> np.ndarray:
        return np.packbits(np.arange(span) < size[:, None], axis=1, bitorder="little").view(np.uint64)

    full = ones(width)
    plus, minus = full & ~ones(most), np.zeros_like(full)
    score, out = most.astype(np.int64), np.zeros(count, dtype=np.int64)
    at, bit = (width - 1) // 64, ((width - 1) % 64).astype(np.uint64)
    lines, one, all_ones = np.arange(count), np.uint64(1), np.uint64((1 << 64) - 1)
    ends: dict[int, list[int]] = {}
    for i, j in enumerate(m.tolist()):
        ends.setdefault(j, []).append(i)
    for j in range(1, int(m.max()) + 1):
        eq = np.packbits(rows[:, j : j + span] == columns[j], axis=1, bitorder="little").view(np.uint64) & full
        x = eq & plus
        total = x + plus
        over = total < x
        carry = over[:, 0]
        for k in range(1, limbs):
            carried = over[:, k] | (carry & (total[:, k] == all_ones))
            total[:, k] += carry
            carry = carried
        d0 = ((total ^ plus) | eq | minus) & full
        hp = minus | (full & ~(d0 | plus))
        hn = d0 & plus
        score += 1 - (d0[lines, at] >> bit & one).astype(np.int64)
        down = d0 >> one
        down[:, :-1] |= d0[:, 1:] << np.uint64(63)
        plus = hn | (full & ~(down | hp))
        minus = down & hp
        for i in ends.get(j, ()):
            # From the lowest cell of the band up to the last row.
            low = int(n[i] - m[i] + most[i])
            above = (1 << max(0, 2 * int(most[i]) - low)) - 1
            up, back = (int.from_bytes(v[i].tobytes(), "little") >> low & above for v in (plus, minus))
            out[i] = score[i] - up.bit_count() + back.bit_count()
    return out


def far_apart(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Which pairs of word hashes are surely too far apart to be near; many of like size are tested side by side."""
    n, m = (np.array([len(p[k]) for p in pairs], dtype=np.int64) for k in (0, 1))
    longer = np.maximum(n, m)
    most = ((1 - SIMILARITY) * longer + 1e-9).astype(np.int64)
    out = np.abs(n - m) > most
    order = np.argsort(longer, kind="stable")
    order = order[~out[order] & (np.minimum(n, m)[order] > 0) & (2 * most[order] < WIDEST)]
    for first in range(0, len(order), SIDE[1]):
        group = order[first : first + SIDE[1]]
        if len(group) >= SIDE[0]:
            out[group] = lower_bounds([pairs[i] for i in group.tolist()], most[group]) > most[group]
    return out


def sought(keyed: DataFrame, involved: DataFrame) -> DataFrame:
    """Rows of ``keyed`` whose key may be among the keys of ``involved``: all that are, and others that share their bit. Tasks
    drop the other rows before these travel; a table that fills up drops fewer."""
    place = F.pmod(F.xxhash64("key"), F.lit(BITS)) + 1
    block, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    known = involved.groupBy(block.alias("_block")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    found = keyed.withColumn("_block", block).join(F.broadcast(known), "_block")
    return found.filter(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*keyed.columns)


def merged(nodes: DataFrame, second: DataFrame) -> DataFrame:
    """(node, root): the classes ``nodes`` joined by further links, which connect roots in place of all members."""
    for end in ("a", "b"):
        root = nodes.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        second = second.join(root, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    second = cut(second.select("root_a", "root_b"), "second")
    tops = classes(second, "root_a", "root_b").select(F.col("node").alias("top"), F.col("root").alias("to"))
    ends = second.select(F.col("root_a").alias("node")).union(second.select("root_b"))
    every = nodes.union(ends.select("node", "node")).groupBy("node").agg(F.min("root").alias("root"))
    return every.join(tops, every.root == tops.top, "left").select("node", F.coalesce("to", "root").alias("root"))


def links(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(a, b, distance): verified links between different texts, named by ``text_key``; and (node, root): the classes of
    linked texts, as ``classes`` gives them."""
    keyed = docs.select(text_key(text).alias("key"), F.col(text).alias("t")).filter(F.col("t").isNotNull())

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out, sizes, bags = [], [], [], []
            for first, h, bounds in word_chunks(blobs(batch, "t")):
                for i in range(len(bounds) - 1):
                    if bounds[i + 1] > bounds[i]:
                        at.append(first + i)
                        out.append(sketches(h[bounds[i] : bounds[i + 1]]))
                        sizes.append(int(bounds[i + 1] - bounds[i]))
                        bags.append(bag(h[bounds[i] : bounds[i + 1]]))
            if at:
                flat = pa.array(np.concatenate(out))
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, SKETCHES, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(at)), rows, pa.array(sizes, pa.int64()), pa.array(bags, pa.binary())],
                    names=["key", "sketches", "size", "bag"],
                )

    sketched = cut(
        keyed.mapInArrow(sketch, "key binary, sketches array<bigint>, size bigint, bag binary")
        .groupBy("key")
        .agg(*(F.first(c).alias(c) for c in ("sketches", "size", "bag"))),
        "sketches",
    )
    rows = sketched.select("key", F.explode("sketches").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.min("key").alias("least"), F.max("key").alias("most"))
    members = cut(rows.join(buckets.filter("least <> most"), "bucket").select("bucket", "key"), "members")

    def verify(batches: Iterator[pa.RecordBatch], sifted: bool = False) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, keep, far = blobs(batch, "s"), blobs(batch, "t"), [], []
            for first in range(0, len(left), SIDE[1]):
                known: dict[bytes, np.ndarray] = {}
                pairs = []
                for s, t in zip(left[first : first + SIDE[1]], right[first : first + SIDE[1]]):
                    for text in (s, t):
                        if text not in known:
                            known[text] = words(text)[0]
                    pairs.append((known[s], known[t]))
                out = far_apart(pairs) if sifted else np.zeros(len(pairs), dtype=bool)
                for i in np.flatnonzero(~out).tolist():
                    a, b = (h.tolist() for h in pairs[i])
                    most = int((1 - SIMILARITY) * max(len(a), len(b)) + 1e-9)
                    distance = edit_distance(a, b, most)
                    if distance <= most:
                        keep.append(first + i)
                        far.append(distance)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").take(take), batch.column("b").take(take), pa.array(far, pa.int64())],
                names=["a", "b", "distance"],
            )

    def verified(pairs: DataFrame, sifted: bool = False) -> DataFrame:
        involved = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
        # Equal texts combine before the shuffle.
        texts = sought(keyed, involved).groupBy("key").agg(F.first("t").alias("t"))
        texts = cut(texts.join(involved, "key", "left_semi"), "texts")
        near = pairs.join(texts.withColumnsRenamed({"key": "b"}), "b").join(
            texts.withColumnsRenamed({"key": "a", "t": "s"}), "a"
        )
        near = near.select("a", "b", "s", "t").mapInArrow(partial(verify, sifted=sifted), "a binary, b binary, distance bigint")
        return cut(near, "links")

    def with_roots(members: DataFrame, nodes: DataFrame) -> DataFrame:
        """(bucket, key, root) of members (bucket, key)."""
        named = members.join(nodes.withColumnsRenamed({"node": "key"}), "key", "left")
        return cut(named.select("bucket", "key", F.coalesce("root", "key").alias("root")), "rooted")

    def with_buckets(rooted: DataFrame, *facts) -> DataFrame:
        """``rooted`` with facts about each bucket, for the buckets that hold several classes."""
        ends = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), *facts)
        return rooted.join(ends.filter("low <> high").drop("low", "high"), "bucket")

    # Buckets with one class stay so, as classes only grow.
    found, nodes = None, members.select(F.col("key").alias("node"), F.col("key").alias("root")).limit(0)
    before = None
    for turn in range(LEADERS):
        leader = F.min_by(F.struct(F.col("key").alias("a"), F.col("root").alias("root_a")), F.xxhash64("key", F.lit(turn)))
        led = cut(with_buckets(with_roots(members, nodes), leader.alias("leader")), "led")
        members, mixed = led.select("bucket", "key"), led.count()
        if before is not None and mixed >= STALLED * before:
            rooted = led.select("bucket", "key", "root")
            break
        before = mixed
        apart = led.select("bucket", "key", "root", "leader.*").filter("root <> root_a")
        drawn = Window.partitionBy("key").orderBy(F.xxhash64("bucket", F.lit(turn)), "bucket")
        apart = apart.withColumn("nth", F.row_number().over(drawn)).filter(F.col("nth") <= LED)
        apart = apart.select(F.least("a", "key").alias("a"), F.greatest("a", "key").alias("b")).distinct()
        known = sketched.select("key", "size", "bag")
        sized = apart.join(known.withColumnsRenamed({"key": "a", "size": "size_a", "bag": "bag_a"}), "a")
        sized = sized.join(known.withColumnsRenamed({"key": "b", "size": "size_b", "bag": "bag_b"}), "b")
        near = verified(cut(sized.mapInArrow(allowed, "a binary, b binary"), "pairs"))
        nodes = cut(merged(nodes, near), "nodes")
        found = near if found is None else found.union(near)
    else:
        rooted = with_roots(members, nodes)
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).alias("own")
    size = F.ceil(F.count("*") / BLOCK).alias("blocks")
    members = with_buckets(rooted, size).select("bucket", "key", "root", "blocks", own)
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    members = members.join(sketched.select("key", "size", "bag", "sketches"), "key").select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "root", "size", "bag", "sketches"
    )
    ordered = members.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "size")
    second = verified(cut(ordered.mapInArrow(meet, "a binary, b binary").distinct(), "pairs"), sifted=True)
    return found.union(second), cut(merged(nodes, second), "nodes")


def classed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, class_id, class_rows, links): one row per row of ``docs``; ``links`` counts the verified links between
    its text and other texts."""
    found, nodes = links(docs, text)
    degree = (
        found.select(F.col("a").alias("key")).union(found.select("b")).groupBy("key").agg(F.count("*").alias("links"))
    )
    ids = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("key"))
    per_text = ids.groupBy("key").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows"))
    placed = per_text.join(nodes.withColumnsRenamed({"node": "key"}), "key", "left").join(degree, "key", "left")
    placed = cut(
        placed.select(
            "key", "low", "rows", F.coalesce("root", "key").alias("root"), F.coalesce("links", F.lit(0)).alias("links")
        ),
        "placed",
    )
    named = placed.groupBy("root").agg(F.min("low").alias("class_id"), F.sum("rows").alias("class_rows"))
    labels = placed.join(named, "root").select("key", "class_id", "class_rows", "links")
    return ids.join(labels, "key").select("doc_id", "class_id", "class_rows", "links")


def representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of ``docs`` per class, with all its columns: the least id, and of equal ids the least text."""
    _, nodes = links(docs, text)
    key = "_omh_key"
    keyed = docs.withColumn(key, text_key(text))
    per_text = keyed.groupBy(key).agg(F.min(doc_id).alias("_omh_low"))
    placed = per_text.join(nodes.withColumnsRenamed({"node": key}), key, "left").withColumn(
        "_omh_root", F.coalesce("root", key)
    )
    best = placed.groupBy("_omh_root").agg(
        F.min(F.struct(F.col("_omh_low").isNull().alias("none"), "_omh_low", key)).alias("best")
    )
    chosen = cut(best.select(F.col(f"best.{key}").alias(key), F.col("best._omh_low").alias("_omh_low")), "chosen")
    # Both steps deal by key and id as one value (NULL ids are equal in it), so that the rows travel once and copies of a
    # text, which differ in id, do not meet in one task.
    row = "_omh_row"
    chosen = chosen.select(F.struct(key, F.col("_omh_low").alias("id")).alias(row))
    rows = keyed.withColumn(row, F.struct(key, F.col(doc_id).alias("id"))).join(chosen, row)
    # Rows with equal id and text: one of them, told apart by their remaining columns.
    return rows.dropDuplicates([row]).select(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
