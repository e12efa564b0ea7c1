"""Part codes against brute force, and their corner cases."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quintavote.llm import part_codes, registered
from tests.llm.test_corpus_ops import SMALL

ROW = "vec_id long, embedding array<float>, label int, near string, codes int"


def nearest(part, book):
    return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(book))


def coded_by_force(rows, parts=8, entries=16, rounds=6):
    """Rows are (vec_id, vector of floats, label); returns counted (vec_id, code, error, label_error) and a digest."""
    kept = [
        (i, [int(np.floor(4096 * float(x))) for x in v], lab)
        for i, v, lab in rows
        if v and all(x is not None and np.isfinite(x) for x in v)
    ]
    fit = sorted((i, len(v)) for i, v, _ in kept if i is not None and len(v) % parts == 0)
    if not fit:
        return Counter(), None
    kept = [r for r in kept if len(r[1]) == fit[0][1]]
    width = fit[0][1] // parts
    first = sorted({i for i, _, _ in kept if i is not None})[:entries]
    seeds = [min(v for i, v, _ in kept if i == f) for f in first]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[s[p * width : (p + 1) * width] for s in seeds] for p in range(parts)]
    for _ in range(rounds):
        for p, book in enumerate(books):
            members = defaultdict(list)
            for c in cut:
                members[nearest(c[p], book)[1]].append(c[p])
            books[p] = [
                [sum(col) // len(members[e]) for col in zip(*members[e], strict=True)] if e in members else entry
                for e, entry in enumerate(book)
            ]
    out, by_label = [], Counter()
    for (i, _, lab), c in zip(kept, cut, strict=True):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[lab] += error
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, lab))
    text = ",".join(str(x) for book in books for e in book for x in e)
    digest = hashlib.sha256(text.encode()).hexdigest()
    return Counter((i, code, error, by_label[lab]) for i, code, error, lab in out), digest


def coded(spark, rows, **settings):
    frame = spark.createDataFrame([(*r, "x", 3) for r in rows], ROW).repartition(3)
    found = part_codes.train(frame, **settings)
    if found is None:
        return Counter(), None
    listed = part_codes.with_label_errors(found.rows).collect()
    return (
        Counter((r.id, bytes(r.codes).hex(), r.error, r.label_error) for r in listed),
        part_codes.digest(found.books),
    )


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = registered.op12_part_codes(spark, SMALL).collect()
    want, digest = coded_by_force(rows)
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in got) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_corner_cases(spark):
    rng = np.random.default_rng(3)
    some = [(int(i), rng.normal(0, 3, 16).astype(np.float32).tolist(), int(i) % 3 or None) for i in range(40, 90)]
    odd = [
        (1, None, 1), (2, [], 1), (3, [1.0] * 15 + [None], 1), (4, [float("nan")] + [0.0] * 15, 2),
        (5, [float("-inf")] + [0.0] * 15, 2), (6, [1.0] * 8, 2), (None, [0.5] * 16, 9), (None, None, None),
        (7, [1.0] * 9, 2), (50, [-0.00001] * 16, None), (50, [9.0] * 16, None), (40, some[0][1], some[0][2]),
    ]
    # Id 6 has the least id of those that eight parts can cut, so its width would hold.
    assert coded(spark, some + odd) == coded_by_force(some + odd)
    wide = [r for r in some + odd if r[0] != 6]
    assert coded(spark, wide) == coded_by_force(wide)
    assert coded(spark, wide, entries=5, rounds=3) == coded_by_force(wide, entries=5, rounds=3)
    assert coded(spark, some[:3]) == coded_by_force(some[:3])
    assert coded(spark, some[:1] * 4) == coded_by_force(some[:1] * 4)
    assert coded(spark, []) == (Counter(), None)
    assert coded(spark, [(None, [1.0] * 8, 1)]) == (Counter(), None)
    with pytest.raises(Exception, match="too large to be coded"):
        coded(spark, [(1, [1e30] * 8, 1)])


def test_ties_and_a_third_of_all_rows_alike(spark):
    rng = np.random.default_rng(4)
    grid = [(int(i), rng.integers(-2, 3, 16).astype(np.float32).tolist(), 1) for i in range(300)]
    same = [(1_000 + i, [1.0, 0.0] * 8, 2) for i in range(150)]
    assert coded(spark, grid + same) == coded_by_force(grid + same)


def test_bounds_spare_most_distances(spark, monkeypatch):
    monkeypatch.setattr(part_codes, "CELLS", 5_000)
    frame = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    found = part_codes.train(frame)
    every = 500 * 8 * 16
    assert found.measured[0] == every and all(n < every for n in found.measured[1:])
    assert found.measured[-1] < every / 2
    near = part_codes.decode(found.rows, found.books).select("id", "error", "approximate")
    exact = {r.vec_id: np.floor(4096 * np.array(r.embedding)) for r in frame.collect()}
    for r in near.collect():
        assert round(float(((np.array(r.approximate) * 4096 - exact[r.id]) ** 2).sum())) == r.error


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(2, 20), st.integers(1, 6), st.sampled_from([3, 40, 100_000]))
def test_bounds_hold_through_rounds(seed, size, keep, spread):
    """Codes stay those of a plain search, bounds stay bounds, whatever moves and however b shrinks."""
    rng = np.random.default_rng(seed)
    parts = rng.integers(-spread, spread + 1, (60, 3))
    book = rng.integers(-spread, spread + 1, (size, 3))
    had = min(keep, size - 1)
    code, upper, near, lower = part_codes.measure_all(parts, book, had)
    for _ in range(5):
        new = book + rng.integers(-max(1, spread // 10), spread // 10 + 2, book.shape) * rng.integers(0, 2, (size, 1))
        moves = part_codes._moved(book[None], new[None])[0]
        book, narrower = new, int(rng.integers(1, had + 1))
        code, upper, near, lower, _, _ = part_codes.advance(parts, book, moves, code, upper, near, lower, narrower)
        had = narrower
        squares = part_codes._squares(parts, book)
        assert (code == squares.argmin(axis=1)).all()
        root = np.sqrt(squares.astype(float))
        rows = np.arange(len(parts))
        assert (upper >= root[rows, code]).all() and (np.diff(lower, axis=1) >= 0).all()
        assert (lower[:, :had] <= root[rows[:, None], near]).all()
        root[rows, code] = np.inf
        root[rows[:, None], near] = np.inf
        assert (lower[:, had] <= root.min(axis=1)).all()
