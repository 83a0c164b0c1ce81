"""Byte-level BPE by dynamic programming over byte prefixes.

For every prefix of a piece there is exactly one token that its encoding ends with. ``last`` stores it per prefix, so a
piece that extends a known prefix is encoded by appending the new bytes alone; ``bpe_edits`` keeps texts encoded through
appends and edits. A token may follow another if encoding the two together gives the two again.

NULL and empty texts have no tokens; a piece of any length costs time in proportion to its length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vitrine.llm.common import blobs

#: Entries that a task keeps of each table; a full table is emptied, which costs time but changes no result.
KEEP = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    """Prefix tables for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        ends: dict[bytes, set[int]] = {}
        for token in ranks:
            ends.setdefault(token[-2:], set()).add(len(token))
        self.lengths = {end: sorted(sizes, reverse=True) for end, sizes in ends.items()}
        self.last: dict[bytes, int] = {}
        self.follows: dict[tuple[int, int], bool] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Plain merging, lowest rank first; used on pairs of tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            found = [(self.ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            found = [x for x in found if x[0] is not None]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, left: int, right: int) -> bool:
        known = self.follows.get((left, right))
        if known is None:
            if len(self.follows) >= KEEP:
                self.follows.clear()
            known = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
            self.follows[left, right] = known
        return known

    def append(self, piece: bytes, end: int) -> int:
        """The token that the encoding of ``piece[:end]`` ends with; shorter prefixes are known."""
        last, ranks = self.last, self.ranks
        for size in self.lengths.get(piece[max(0, end - 2) : end], ()) or ():
            if size > end:
                continue
            token = ranks.get(piece[end - size : end])
            if token is None:
                continue
            if size == end:
                # A whole prefix that is a token is its own encoding only if merging can build it.
                if self.whole(token):
                    return token
            elif self.may_follow(last[piece[: end - size]], token):
                return token
        return ranks[piece[end - 1 : end]]

    def whole(self, token: int) -> bool:
        known = self.follows.get((-1, token))
        if known is None:
            known = self.follows[-1, token] = self.merge(self.tokens[token]) == [token]
        return known

    def encode(self, piece: bytes) -> list[int]:
        if piece in self.ranks:  # a vocabulary entry stands for itself, as in the public libraries
            return [self.ranks[piece]]
        if len(piece) > 256:
            return self.encode_long(piece)
        last = self.last
        if len(last) >= KEEP:
            last.clear()
        known = len(piece)
        while known and piece[:known] not in last:
            known -= 1
        for end in range(known + 1, len(piece) + 1):
            last[piece[:end]] = self.append(piece, end)
        out, end = [], len(piece)
        while end:
            token = last[piece[:end]]
            out.append(token)
            end -= len(self.tokens[token])
        return out[::-1]

    def encode_long(self, piece: bytes) -> list[int]:
        """The same tables by position, for pieces too long to keep their prefixes as keys."""
        ends: list[int] = [-1]
        for end in range(1, len(piece) + 1):
            found = self.ranks[piece[end - 1 : end]]
            for size in self.lengths.get(piece[max(0, end - 2) : end], ()):
                token = self.ranks.get(piece[end - size : end]) if size <= end else None
                if token is not None and (
                    self.whole(token) if size == end else self.may_follow(ends[end - size], token)
                ):
                    found = token
                    break
            ends.append(found)
        out, end = [], len(piece)
        while end:
            out.append(ends[end])
            end -= len(self.tokens[ends[end]])
        return out[::-1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_ready: dict[int, Encoder] = {}


def encoder(ranks: dict[bytes, int]) -> Encoder:
    """One encoder per worker and vocabulary."""
    mark = hash(frozenset(list(ranks.items())[:: max(1, len(ranks) // 64)]))
    if mark not in _ready:
        _ready[mark] = Encoder(ranks)
    return _ready[mark]


def encode_ids(ranks: dict[bytes, int], pattern: str, text: str) -> list[int]:
    known = encoder(ranks)
    return [i for piece in regex.findall(pattern, text) for i in known.encode(piece.encode())]


def encode_texts(docs: DataFrame, ranks: dict[bytes, int], pattern: str, column: str = "text") -> DataFrame:
    """Every column of ``docs`` and n_tokens, ids_sha256, decoded_sha256, each from the whole text.

    Existing columns of these names are replaced. The vocabulary travels with the job: a file of fixed size.
    """
    keep = [c for c in docs.columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256")]
    context = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(context.value)
        split = regex.compile(pattern).findall
        cache: dict[str, tuple[str, int, bytes]] = {}
        for batch in batches:
            counts, ids, back = [], [], []
            for raw in blobs(batch, column):
                pieces = split(raw.decode())
                for piece in set(pieces).difference(cache):
                    got = known.encode(piece.encode())
                    cache[piece] = (" ".join(map(str, got)), len(got), known.decode(got))
                rows = [cache[p] for p in pieces]
                counts.append(sum([r[1] for r in rows]))
                ids.append(hashlib.sha256(" ".join([r[0] for r in rows]).encode()).hexdigest())
                back.append(hashlib.sha256(b"".join([r[2] for r in rows])).hexdigest())
                if len(cache) >= KEEP:
                    cache.clear()
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    from pyspark.sql import types as T

    schema = T.StructType(
        [docs.schema[c] for c in keep]
        + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType())]
        + [T.StructField("decoded_sha256", T.StringType())]
    )
    return docs.mapInArrow(run, schema)
