"""Segments of one range: what is settled by hashing and what suffix arrays decide."""

from __future__ import annotations

import numpy as np

from quintavote.llm import suffix_dedup
from quintavote.llm.suffix_dedup import SIZE, runs, segment_answers


def _message(segments: list[tuple[bytes, int, int]]):
    texts, owners, anchors = zip(*segments, strict=True)
    lengths = np.array([len(t) for t in texts], np.int32)
    return b"".join(texts), lengths, np.array(owners, np.int64), np.array(anchors, np.uint32)


def _brute(messages: list[list[tuple[bytes, int, int]]]) -> list[np.ndarray]:
    least: dict[bytes, int] = {}
    for text, owner, _ in (s for m in messages for s in m):
        for i in range(len(text) - SIZE + 1):
            least[text[i : i + SIZE]] = min(owner, least.get(text[i : i + SIZE], owner))
    return [
        np.array([least[t[i : i + SIZE]] < o for t, o, _ in m for i in range(len(t) - SIZE + 1)])
        for m in messages
    ]


def test_only_anchors_with_several_texts_reach_the_suffix_arrays(monkeypatch):
    rng = np.random.default_rng(5)

    def some(n: int) -> bytes:
        return rng.integers(97, 123, n, dtype=np.uint8).tobytes()

    alike = [some(60 + i % 9) for i in range(40)]
    core = some(SIZE + 4)
    messages = [
        [(t, 100 * m + i, i) for i, t in enumerate(alike)]
        + [(some(m) + core + some(2), 7 - m, 99), (core[: SIZE + 1], 30 + m, 99)]
        for m in range(3)
    ]
    seen = []
    kept = suffix_dedup.least_owner

    def counted(data, owner, size):
        seen.append(len(data))
        return kept(data, owner, size)

    monkeypatch.setattr(suffix_dedup, "least_owner", counted)
    for chunk in (1 << 19, 64):
        seen.clear()
        answers = segment_answers([_message(m) for m in messages], SIZE, chunk)
        for answer, expected in zip(answers, _brute(messages), strict=True):
            assert np.array_equal(np.unpackbits(np.frombuffer(answer, np.uint8))[: len(expected)], expected)
        assert sum(seen) == sum(len(t) for t in {t for m in messages for t, _, a in m if a == 99})


def test_runs_cover_every_window_once(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_TILE", 64)
    rng = np.random.default_rng(6)
    lengths = np.array([0, 300, 49, 50, 0, 51, 1, 200, 30, 0])
    data = rng.integers(97, 99, lengths.sum(), dtype=np.uint8)
    data[20:200] = 97
    anchor, first, last, doc = runs(data, lengths)
    ends = np.cumsum(lengths)
    windows = [(d, p) for d, e in enumerate(ends) for p in range(e - lengths[d], e - SIZE + 1)]
    assert [(d, p) for d, a, b in zip(doc, first, last, strict=True) for p in range(a, b + 1)] == windows
    of_text: dict[bytes, int] = {}
    for x, a, b in zip(anchor.tolist(), first, last, strict=True):
        for p in range(a, b + 1):
            assert of_text.setdefault(data[p : p + SIZE].tobytes(), x) == x
