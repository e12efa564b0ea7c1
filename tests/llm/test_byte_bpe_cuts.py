"""Cutting long texts leaves their tokens as they are."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quintavote.llm import byte_bpe, registered


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as tokenizers

    return tokenizers.path(registered.RANK_FILE), tokenizers.PATTERN


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_the_pattern_is_the_one_the_cuts_are_made_for(tokenizer):
    assert tokenizer[1] == byte_bpe.CUT_PATTERN


@settings(max_examples=400, deadline=None)
@given(
    st.text(
        alphabet=st.sampled_from(list(" \n\t\r\x0b\x1c 　ab'sdtrelvm19é漢٣½_.-\"🙂")), max_size=60
    ),
    st.integers(1, 8),
    st.integers(1, 4),
)
def test_cuts_do_not_change_tokens(tokenizer, text, chars, long_blank):
    ranks, pattern = tokenizer
    whole = byte_bpe._encoding(ranks, pattern).encode_ordinary(text)
    assert ids(byte_bpe.encode_text(text, ranks, pattern, chars, long_blank)) == whole


def test_texts_that_no_space_cuts(tokenizer):
    """Millions of blanks, and millions of characters without one, in bounded pieces."""
    ranks, pattern = tokenizer
    blanks = " " * 2_000_000
    for text in (blanks + "x", "x" + blanks, "a\n" + blanks + "\nb", blanks + "\tx  y"):
        packed = byte_bpe.encode_text(text, ranks, pattern)
        assert byte_bpe.decode_ids(packed, ranks, pattern) == text.encode()
    # The library manages this length by itself.
    short = " " * 200_000 + "x"
    assert ids(byte_bpe.encode_text(short, ranks, pattern)) == byte_bpe._encoding(ranks, pattern).encode_ordinary(short)
    rng = random.Random(1)
    base = "".join(rng.choice("ABCDEFabcdef0123456789+/=") for _ in range(5_000_000))
    assert max(map(len, byte_bpe.pieces(base))) < byte_bpe.PIECE_CHARS + 200
    assert byte_bpe.decode_ids(byte_bpe.encode_text(base, ranks, pattern), ranks, pattern) == base.encode()
    assert ids(byte_bpe.encode_text(base[:300_000], ranks, pattern)) == byte_bpe._encoding(
        ranks, pattern
    ).encode_ordinary(base[:300_000])


def test_another_pattern_is_not_cut(tokenizer):
    ranks, _ = tokenizer
    text = "ab 12 " * 40_000
    whole = byte_bpe._encoding(ranks, r"(?s).{1,7}").encode_ordinary(text)
    assert ids(byte_bpe.encode_text(text, ranks, r"(?s).{1,7}", 10)) == whole
