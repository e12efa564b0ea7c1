"""Byte-level BPE encoding and decoding by the tiktoken library.

The rank file is a local file that every worker has; its path is a parameter.
Long texts are cut at safe boundaries and encoded piece by piece, so memory besides the
text itself is bounded by one piece, or by one match of the pattern where that is longer
(a text of letters without a break is one match).  Long runs of white space are told apart
beforehand and encoded as the one match that they are.  Token ids travel packed as
little-endian unsigned 32-bit integers, which is what training jobs store.

Null text counts as empty: no tokens.  Bytes that are not UTF-8 are encoded as
the replacement character.  Repeated rows are encoded alike, extra columns are
kept, and a column that has the name of a result is replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quintavote.staging import ship_package

# Characters that are handed to the library at once.
PIECE_CHARS = 1 << 16
# Rows that are encoded before their results are handed on.
ROWS = 256


@lru_cache(maxsize=4)
def _encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {
            base64.b64decode(token): int(rank)
            for token, rank in (line.split() for line in lines if line.strip())
        }
    return tiktoken.Encoding(
        "local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
    )


# Fixed value: the pattern whose matches the cuts below are safe for.
CUT_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# White space of this length is not left to the pattern, which would go back over it.
LONG_BLANK = 4_096


@lru_cache(maxsize=1)
def _boundary():
    import regex

    # One space between two characters that are not white space, or a change between
    # letters, digits and others: matches end there whatever surrounds it.  An apostrophe
    # may begin a match with the letters after it.
    return regex.compile(
        r"(?<=\S) (?=\S)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])"
        r"|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])"
    )


@lru_cache(maxsize=4)
def _long_blank(length: int):
    import regex

    # White space as the library's patterns know it.
    blank = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    return regex.compile(f"{blank}{{{length},}}+")


def pieces(text: str, chars: int = PIECE_CHARS) -> Iterator[str]:
    """Parts of ``text`` whose tokens, put together, are the tokens of ``text``.

    A part is longer than ``chars`` only by the rest of the match that it ends in.
    """
    start = 0
    while len(text) - start > chars:
        cut = _boundary().search(text, start + chars)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def segments(text: str, long_blank: int = LONG_BLANK) -> Iterator[tuple[str, bool]]:
    """Parts of ``text`` and whether each is one match: a long run of white space.

    All of such a run is one match of the pattern but its last character, which goes with
    what follows; at the end of the text that character belongs to it as well.
    """
    start = 0
    for run in _long_blank(long_blank).finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        if start < run.start():
            yield text[start : run.start()], False
        if run.start() < end:
            yield text[run.start() : end], True
        start = end
    if start < len(text):
        yield text[start:], False


def encode_text(
    text: str | None, rank_file: str, pattern: str, chars: int = PIECE_CHARS, long_blank: int = LONG_BLANK
) -> bytes:
    """Packed ids of one text; with another pattern than CUT_PATTERN it is encoded uncut."""
    if not text:
        return b""
    encoding = _encoding(rank_file, pattern)
    if pattern != CUT_PATTERN:
        return encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
    out = []
    for part, one in segments(text, long_blank):
        if one:
            ids = encoding._encode_single_piece(part)
            out.append(np.array(ids, dtype="<u4").tobytes())
            continue
        for piece in pieces(part, chars):
            out.append(encoding.encode_to_numpy(piece, disallowed_special=()).astype("<u4").tobytes())
    return b"".join(out)


def decode_ids(packed: bytes | None, rank_file: str, pattern: str) -> bytes:
    """Raw bytes of packed ids; they need not be UTF-8 on their own."""
    if not packed:
        return b""
    ids = memoryview(bytes(packed)).cast("I").tolist()
    return _encoding(rank_file, pattern).decode_bytes(ids)


def encode(
    df: DataFrame,
    rank_file: str,
    pattern: str,
    text: str = "text",
    ids: str = "ids",
    decoded: str | None = None,
) -> DataFrame:
    """Add the packed ids of ``text`` and their number ``n_tokens``.

    With ``decoded``, the ids are decoded in the same pass into a column of that name.
    """
    ship_package(df.sparkSession)
    made = [ids, "n_tokens", *([decoded] if decoded else [])]
    own = [c for c in df.columns if c.lower() not in {m.lower() for m in made}]
    valid = "valid"
    while valid in own:
        valid += "_"
    clean = F.make_valid_utf8(F.coalesce(F.col(text).cast("string"), F.lit("")))
    given = df.select(*(F.col(c) for c in own), clean.alias(valid))
    schema = T.StructType(
        [*given.schema.fields[:-1], T.StructField(ids, T.BinaryType()), T.StructField("n_tokens", T.LongType())]
        + ([T.StructField(decoded, T.BinaryType())] if decoded else [])
    )

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A few rows at a time: what is held besides the input stays small.
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                packed = [encode_text(x, rank_file, pattern) for x in part.columns[-1].to_pylist()]
                columns = [
                    *part.columns[:-1],
                    pa.array(packed, pa.binary()),
                    pa.array([len(x) // 4 for x in packed], pa.int64()),
                ]
                if decoded:
                    raw = [decode_ids(x, rank_file, pattern) for x in packed]
                    columns.append(pa.array(raw, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[*own, *made])

    return given.mapInArrow(coded, schema)


def decode(
    df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", out: str = "decoded"
) -> DataFrame:
    """Add the raw bytes of packed ids."""
    ship_package(df.sparkSession)

    @F.pandas_udf("binary")
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([decode_ids(x, rank_file, pattern) for x in batch], dtype=object)

    return df.withColumn(out, raw(ids))
