"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs that follows from its code point.  An
n-gram binds the vectors of its letters, each permuted by its place, by
multiplication; a text bundles its n-grams by addition; a language bundles its
unit text vectors.  A text has the language whose prototype has the largest
cosine with it.

Text without a letter, and null text, is ``und`` with score 0.  Ties go to the
language that sorts first.  Rows of equal text get equal results, extra columns
are kept, and without a single learned language everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quintavote.staging import ship_package

DIM = 1024
# Texts that are bundled at once.
ROWS = 512
NGRAM = 3
UNKNOWN = "und"
# Labelled texts that are learned from, for each language: the bound of the sample.
TRAIN_PER_LANGUAGE = 2_000
# Prototypes are sent to every worker; more labels than this are refused.
MAX_LANGUAGES = 2_000
_SPACE = 32
_PIECE = 1 << 18
_GROUP = 1 << 18
_CACHE_ROWS = 1 << 15


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_vectors(codes: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Signs of each code point, the same on every machine."""
    x = codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    x = x + np.arange(1, dim // 64 + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.astype("<u8").view(np.uint8), axis=1)
    return (2 * bits.astype(np.int8) - 1).astype(np.int8)


def ngram_vectors(grams: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Bound vectors of n-grams whose letters are packed 21 bits each."""
    bound = np.ones((len(grams), dim), np.int8)
    for place in range(NGRAM):
        letters, which = np.unique(
            (grams >> (21 * place)) & ((1 << 21) - 1), return_inverse=True
        )
        bound *= np.roll(letter_vectors(letters, dim), place, axis=1)[which]
    return bound


class _Vectors:
    """Vectors of the n-grams met so far; forgotten when there are too many."""

    def __init__(self, dim: int):
        self.dim, self.rows, self.matrix = dim, {}, np.empty((0, dim), np.int8)

    def of(self, grams: np.ndarray) -> np.ndarray:
        if len(grams) > _CACHE_ROWS:
            return ngram_vectors(grams, self.dim).astype(np.float32)
        known = self.rows
        new = np.array([g for g in grams.tolist() if g not in known], np.int64)
        if len(known) + len(new) > _CACHE_ROWS:
            self.__init__(self.dim)
            known, new = self.rows, grams
        if len(new):
            made = ngram_vectors(new, self.dim)
            known.update(zip(new.tolist(), range(len(known), len(known) + len(new)), strict=True))
            need = len(known)
            if need > len(self.matrix):
                grown = np.empty((min(_CACHE_ROWS, max(1024, 2 * need)), self.dim), np.int8)
                grown[: len(self.matrix)] = self.matrix
                self.matrix = grown
            self.matrix[need - len(new) : need] = made
        return self.matrix[[known[g] for g in grams.tolist()]].astype(np.float32)


def _grams(text: str, chars: int | None = None) -> Iterator[np.ndarray]:
    """Packed n-grams of the letters, words set apart by one space; none without a letter.

    The text is read in parts of ``chars`` characters, and n-grams that lie over their borders
    come with the later part.
    """
    chars = chars or _PIECE
    before, was_letter = np.array([_SPACE], np.int64), False
    for start in range(0, len(text), chars):
        part = text[start : start + chars]
        codes = np.frombuffer(part.lower().encode("utf-32-le", "replace"), np.uint32)
        letter = _is_letter()[codes]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] |= was_letter
        was_letter = bool(letter[-1])
        last = [_SPACE] if start + chars >= len(text) else []
        codes = np.concatenate((before, np.where(letter, codes, _SPACE)[keep], last)).astype(np.int64)
        before = codes[1 - NGRAM :]
        packed = codes[: max(0, len(codes) - NGRAM + 1)].copy()
        for place in range(1, NGRAM):
            packed |= codes[place : place + len(packed)] << (21 * place)
        if len(packed):
            yield packed


def bundles(texts: list[str | None], vectors: _Vectors) -> np.ndarray:
    """One summed vector per text; zeros for a text without letters.

    A text of more than 2^18 characters is read in parts of that size.
    """
    out = np.zeros((len(texts), vectors.dim), np.float32)
    group: list[tuple[int, np.ndarray]] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not group:
            return
        every = np.concatenate([g for _, g in group])
        grams, which = np.unique(every, return_inverse=True)
        owner = np.repeat(np.arange(len(group)), [len(g) for _, g in group])
        counts = np.bincount(owner * len(grams) + which, minlength=len(group) * len(grams))
        counts = counts.reshape(len(group), len(grams)).astype(np.float32)
        np.add.at(out, [i for i, _ in group], counts @ vectors.of(grams))
        group.clear()
        held = 0

    for i, text in enumerate(texts):
        for grams in _grams(text or ""):
            group.append((i, grams))
            held += len(grams)
            if held >= _GROUP:
                flush()
    flush()
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def learn(
    labelled: DataFrame,
    text: str = "text",
    label: str = "lang",
    per_language: int = TRAIN_PER_LANGUAGE,
    dim: int = DIM,
) -> dict[str, np.ndarray]:
    """Prototypes of the labels, from about ``per_language`` rows of each, taken by hash.

    Rows with a null label or text are left out.  The result has one vector per
    label and is refused above ``MAX_LANGUAGES`` labels.
    """
    ship_package(labelled.sparkSession)
    rows = labelled.select(F.col(text).alias("text"), F.col(label).alias("lang")).where(
        "text IS NOT NULL AND lang IS NOT NULL"
    )
    counts = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} language labels")
    if not counts:
        return {}
    share = F.create_map(
        *(F.lit(x) for r in counts for x in (r["lang"], min(1.0, per_language / r["count"])))
    )
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(place < share[F.col("lang")])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors, sums = _Vectors(dim), {}
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                part = batch.iloc[start : start + ROWS]
                units = _unit(bundles(part["text"].tolist(), vectors)).astype(np.float64)
                for lang, of in part.groupby("lang").indices.items():
                    sums[lang] = sums.get(lang, 0) + units[of].sum(axis=0)
        yield pd.DataFrame(
            {"lang": list(sums), "bundle": [v.tobytes() for v in sums.values()]}, dtype=object
        )

    def total(parts: pd.DataFrame) -> pd.DataFrame:
        rows = np.stack([np.frombuffer(x, np.float64) for x in parts["bundle"]])
        return pd.DataFrame(
            {"lang": [parts["lang"].iloc[0]], "bundle": [rows.sum(axis=0).tobytes()]}, dtype=object
        )

    schema = "lang string, bundle binary"
    found = (
        sample.mapInPandas(partial, schema).groupBy("lang").applyInPandas(total, schema).collect()
    )
    return {r["lang"]: np.frombuffer(bytes(r["bundle"]), np.float64) for r in found}


def identify(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``, the cosine cut to 0..1."""
    ship_package(df.sparkSession)
    names = sorted(prototypes)
    dim = len(prototypes[names[0]]) if names else DIM
    matrix = _unit(np.stack([prototypes[n] for n in names])) if names else np.zeros((0, dim))
    matrix = matrix.astype(np.float32)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vectors = _Vectors(dim)

        def judged(texts: list) -> pd.DataFrame:
            made = bundles(texts, vectors) if names else np.zeros((len(texts), dim))
            known = made.any(axis=1)
            cosine = _unit(made) @ matrix.T if names else np.zeros((len(texts), 1))
            best = cosine.argmax(axis=1)
            score = np.clip(cosine[np.arange(len(best)), best], 0, 1)
            found = [names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            return pd.DataFrame(
                {
                    "lang_pred": pd.Series(found, dtype=object),
                    "score": np.where(known, score, 0.0).astype(float),
                }
            )

        for batch in batches:
            # A few texts at a time: bundles are wide.
            parts = [judged(batch.iloc[i : i + ROWS].tolist()) for i in range(0, len(batch), ROWS)]
            yield pd.concat(parts, ignore_index=True) if parts else judged([])

    return (
        df.withColumn("lang_pred", predict(F.col(text).cast("string")))
        .withColumn("score", F.col("lang_pred.score"))
        .withColumn("lang_pred", F.col("lang_pred.lang_pred"))
    )


def held_out(key: str = "doc_id"):
    """The fold that is never learned from; a null key belongs to it."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))
