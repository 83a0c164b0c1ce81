"""Appends and edits of encoded texts against encoding anew."""

import random

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from vitrine.llm import bpe, bpe_edits

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
KNOWN = bpe.encoder(RANKS)
PIECES = st.text(alphabet="aeinrstthing é", max_size=60) | st.text(max_size=20)
TEXTS = st.text(alphabet="aeinrst 'dlé\n0 19.,  ", max_size=80) | st.text(max_size=40)
EDITS = st.lists(st.tuples(st.floats(0, 1), st.floats(0, 1), TEXTS), max_size=5)


@settings(max_examples=200, deadline=None)
@given(PIECES, EDITS)
def test_edited_pieces_equal_pieces_encoded_anew(piece, edits):
    raw = piece.encode()
    held = bpe_edits.Prefixes(KNOWN, raw)
    for a, b, new in edits:
        start, stop = sorted((int(a * len(raw)), int(b * len(raw))))
        held.edit(start, stop, new.encode())
        raw = raw[:start] + new.encode() + raw[stop:]
        assert held.piece == raw and held.ends == bpe_edits.Prefixes(KNOWN, raw).ends
        assert held.ids() == KNOWN.encode(raw)


@settings(max_examples=300, deadline=None)
@given(TEXTS, EDITS)
def test_edited_texts_equal_the_public_library(text, edits):
    held = bpe_edits.Document(KNOWN, public_tokenizers.PATTERN, text)
    assert held.ids() == ENCODING.encode_ordinary(text)
    for a, b, new in edits:
        start, stop = sorted((int(a * len(text)), int(b * len(text))))
        held.edit(start, stop, new)
        text = text[:start] + new + text[stop:]
        assert held.text == text and held.ids() == ENCODING.encode_ordinary(text)
        held.append(new)
        text += new
        assert held.ids() == ENCODING.encode_ordinary(text)


def test_an_edit_works_near_its_place_only():
    rng = random.Random(6)
    raw = "".join(rng.choice("aeinrst") for _ in range(20_000)).encode()
    held = bpe_edits.Prefixes(KNOWN, raw)
    before = held.computed
    held.edit(10_000, 10_003, b"xyz")
    assert held.computed - before < 2_000 and held.ids() == KNOWN.encode(raw[:10_000] + b"xyz" + raw[10_003:])
    before = held.computed
    held.append(b"ing")
    assert held.computed - before == 3 and held.ids() == KNOWN.encode(held.piece)
    text = " ".join("".join(rng.choice("aeinrst") for _ in range(6)) for _ in range(3_000))
    whole = bpe_edits.Document(KNOWN, public_tokenizers.PATTERN, text)
    before = whole.encoded
    whole.edit(9_000, 9_010, "new words")
    assert whole.encoded - before < 12 and whole.ids() == ENCODING.encode_ordinary(whole.text)
