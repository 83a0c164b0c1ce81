"""Encoded texts that stay encoded: exact appends and edits by the prefix tables of ``bpe``.

``Prefixes`` holds the last token of every byte prefix of one piece. An append computes the entries of the new bytes only.
An edit computes them from its start on and stops as soon as the entries of a whole token length behind it are the old
ones: an entry depends on the bytes and entries of one token length before it, so all later ones are the old ones too.

``Document`` holds a text as pieces. Pieces are matched from left to right and a match depends on the text from its start
on, so an edit matches anew from the piece before it and stops where a new piece begins at the beginning of an old one
behind the edit. The other pieces keep their tokens.
"""

from __future__ import annotations

from bisect import bisect_right

import regex

from vitrine.llm.bpe import Encoder


class Prefixes:
    """The last token of each byte prefix of a piece; ``computed`` counts the entries worked out so far."""

    def __init__(self, encoder: Encoder, piece: bytes = b""):
        self.encoder, self.piece, self.ends, self.computed = encoder, b"", [-1], 0
        self.append(piece)

    def _entry(self, end: int) -> int:
        encoder, piece = self.encoder, self.piece
        self.computed += 1
        for size in encoder.lengths.get(piece[max(0, end - 2) : end], ()):
            token = encoder.ranks.get(piece[end - size : end]) if size <= end else None
            if token is not None and (
                encoder.whole(token) if size == end else encoder.may_follow(self.ends[end - size], token)
            ):
                return token
        return encoder.ranks[piece[end - 1 : end]]

    def append(self, more: bytes) -> None:
        self.piece += more
        for end in range(len(self.ends), len(self.piece) + 1):
            self.ends.append(self._entry(end))

    def edit(self, start: int, stop: int, new: bytes) -> None:
        """Put ``new`` in place of the bytes from ``start`` to ``stop``."""
        old, shift = self.ends, len(new) - (stop - start)
        self.piece = self.piece[:start] + new + self.piece[stop:]
        self.ends = old[: start + 1]
        same, behind = 0, start + len(new)
        for end in range(start + 1, len(self.piece) + 1):
            self.ends.append(self._entry(end))
            # Near the start of the piece an entry also asks whether the whole prefix is a token.
            unchanged = end > behind and end > self.encoder.longest and end - shift > self.encoder.longest
            same = same + 1 if unchanged and self.ends[end] == old[end - shift] else 0
            if same >= self.encoder.longest:
                self.ends += old[end - shift + 1 :]
                return

    def ids(self) -> list[int]:
        if self.piece in self.encoder.ranks:
            return [self.encoder.ranks[self.piece]]
        out, end = [], len(self.piece)
        while end:
            out.append(self.ends[end])
            end -= len(self.encoder.tokens[self.ends[end]])
        return out[::-1]


class Document:
    """A text with its pieces and their tokens; ``encoded`` counts the pieces encoded so far."""

    def __init__(self, encoder: Encoder, pattern: str, text: str = ""):
        self.encoder, self.pattern = encoder, regex.compile(pattern)
        self.text, self.starts, self.tokens, self.encoded = "", [], [], 0
        self.edit(0, 0, text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, stop: int, new: str) -> None:
        """Put ``new`` in place of the characters from ``start`` to ``stop``."""
        shift, behind = len(new) - (stop - start), start + len(new)
        self.text = self.text[:start] + new + self.text[stop:]
        # A match looks at no more than the character after it: all pieces but the last two before the edit stand.
        first = max(0, bisect_right(self.starts, start) - 3)
        begin = self.starts[first] if first < len(self.starts) else 0
        starts, tokens = self.starts[:first], self.tokens[:first]
        old = {at + shift: i for i, at in enumerate(self.starts) if at >= stop}
        for match in self.pattern.finditer(self.text, begin if starts else 0):
            at = match.start()
            if at >= behind and at in old:
                starts += [s + shift for s in self.starts[old[at] :]]
                tokens += self.tokens[old[at] :]
                break
            starts.append(at)
            tokens.append(self.encoder.encode(match.group().encode()))
            self.encoded += 1
        self.starts, self.tokens = starts, tokens

    def ids(self) -> list[int]:
        return [i for piece in self.tokens for i in piece]
