import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brute import neighbours
from quintavote.functions import kernels


def codes(rng, rows, dim=14, distinct=None):
    values = rng.integers(-10_000, 10_001, (rows, dim))
    if distinct:
        values = values[rng.integers(0, min(distinct, rows), rows)]
    return values.astype(float)


@settings(max_examples=40, deadline=None)
@given(
    seed=st.integers(0, 10_000),
    queries=st.integers(1, 30),
    refs=st.integers(1, 60),
    distinct=st.sampled_from([None, 1, 3]),
    skip_self=st.booleans(),
)
def test_block_search_equals_full_comparison(seed, queries, refs, distinct, skip_self):
    rng = np.random.default_rng(seed)
    query_codes, ref_codes = codes(rng, queries), codes(rng, refs, distinct=distinct)
    ref_ids = rng.permutation(refs * 2)[:refs]
    query_ids = np.arange(queries)
    rows, found, dist = kernels.nearest_in_block(
        query_ids, query_codes, ref_ids, ref_codes, 5, skip_self
    )
    wanted = neighbours(
        list(zip(query_ids, query_codes)),
        [(int(i), c, 0) for i, c in zip(ref_ids, ref_codes)],
        skip_self=skip_self,
    )
    for row in range(queries):
        mine = sorted((int(d), int(ref_ids[f])) for r, f, d in zip(rows, found, dist) if r == row)
        assert mine == [(d, i) for d, i, _ in wanted[row]]


def test_block_search_over_several_tiles():
    rng = np.random.default_rng(3)
    query_codes, ref_codes = codes(rng, 300), codes(rng, 5_000, distinct=40)
    rows, found, dist = kernels.nearest_in_block(
        np.arange(300), query_codes, np.arange(5_000), ref_codes, 5, True
    )
    full = ((query_codes[:, None, :] - ref_codes[None]) ** 2).sum(axis=2)
    full[np.arange(300), np.arange(300)] = np.inf
    for row in range(300):
        order = np.lexsort((np.arange(5_000), full[row]))[:5]
        mine = rows == row
        picked = sorted(zip(dist[mine], found[mine]))
        assert [int(f) for _, f in picked] == order.tolist()
        assert [float(d) for d, _ in picked] == full[row][order].tolist()


def test_bounds_keep_ties_and_drop_the_rest():
    refs = np.array([[0.0], [3.0], [3.0], [9.0]])
    rows, found, dist = kernels.nearest_in_block(
        np.array([100]), np.array([[0.0]]), np.arange(4), refs, 5, False, np.array([9])
    )
    assert sorted(found.tolist()) == [0, 1, 2]


def test_oversized_block_is_refused():
    refs = np.full((3, 2), 3e7)
    with pytest.raises(ValueError, match="too large"):
        kernels.nearest_in_block(np.arange(3), refs, np.arange(3), refs, 2, False)


@settings(max_examples=40, deadline=None)
@given(seed=st.integers(0, 10_000), clusters=st.integers(1, 40), n=st.integers(1, 28))
def test_ranking_equals_full_sort(seed, clusters, n):
    rng = np.random.default_rng(seed)
    centers = rng.random((clusters, 14))
    centers[rng.integers(0, clusters, clusters // 3)] = centers[0]  # exact ties
    queries = rng.random((25, 14))
    norms = kernels.squared_norms(centers)
    ranked = kernels.rank_centroids(queries, centers, norms, n)
    for row, query in enumerate(queries):
        dot = centers[:, 0] * query[0]
        for d in range(1, 14):
            dot = dot + centers[:, d] * query[d]
        order = np.lexsort((np.arange(clusters), norms - 2.0 * dot))
        assert ranked[row].tolist() == order[: min(n, clusters)].tolist()


def test_nearest_prefers_the_lower_position():
    centers = np.array([[1.0, 0.0], [0.0, 0.0], [0.0, 0.0], [1.0, 0.0]])
    position, distance = kernels.nearest_centroid(np.array([[0.0, 0.0], [0.9, 0.0]]), centers)
    assert position.tolist() == [1, 0]
    assert distance == pytest.approx([0.0, 0.01])


def test_reachable_never_misses_a_possible_cell():
    rng = np.random.default_rng(5)
    points = codes(rng, 2_000)
    centers = points[:20]
    owner, _ = kernels.nearest_centroid(points, centers)
    gaps = np.sqrt(((points - centers[owner]) ** 2).sum(axis=1))
    radii = np.array([gaps[owner == c].max() for c in range(20)])
    queries = codes(rng, 50)
    full = ((queries[:, None] - points[None]) ** 2).sum(axis=2)
    bounds = np.sort(full, axis=1)[:, 20]
    visited = np.zeros((50, 1), dtype=int)
    counts, cells = kernels.reachable_centroids(queries, bounds, centers, radii, visited)
    split = np.split(cells, np.cumsum(counts)[:-1])
    for row in range(50):
        needed = set(owner[full[row] <= bounds[row]]) - {0}
        assert needed <= set(split[row].tolist())
        assert 0 not in split[row]


def test_ragged_or_null_vectors_are_refused():
    with pytest.raises(ValueError):
        kernels.to_matrix(pa.array([[1.0, 2.0], [1.0]]), 2)
    with pytest.raises(ValueError):
        kernels.to_matrix(pa.array([[1.0, None]]), 2)
    with pytest.raises(ValueError):
        kernels.to_matrix(pa.array([[1.0, 2.0], None]), 2)


@pytest.mark.parametrize("distinct", [None, 3, 1])
@pytest.mark.parametrize("bounded", [False, True])
def test_tree_search_equals_full_comparison(distinct, bounded):
    """Several leaves, copies over more than one leaf, queries of all of them."""
    rng = np.random.default_rng(5)
    refs = codes(rng, 3_000, distinct=distinct)
    queries = np.concatenate([refs[rng.integers(0, 3_000, 500)], codes(rng, 200)])
    ref_ids, query_ids = rng.permutation(6_000)[:3_000], rng.permutation(6_000)[:700]
    full = ((queries[:, None, :] - refs[None]) ** 2).sum(axis=2)
    full[query_ids[:, None] == ref_ids[None]] = np.inf
    bounds = np.sort(full, axis=1)[:, 2].astype(np.int64) if bounded else None
    tree = kernels.ReferenceTree(ref_ids, refs)
    assert len(tree.leaves) > 4
    rows, found, dist = kernels.nearest_in_tree(query_ids, queries, tree, 5, True, bounds)
    for row in range(700):
        order = np.lexsort((ref_ids, full[row]))[:5]
        wanted = [(d, i) for d, i in zip(full[row][order], ref_ids[order]) if not bounded or d <= bounds[row]]
        mine = rows == row
        assert sorted(zip(dist[mine], ref_ids[found[mine]])) == wanted


def test_tree_search_leaves_out_far_leaves():
    """A query compares itself with the leaves near it, not with the whole block."""
    rng = np.random.default_rng(6)
    refs = np.round(rng.random((20_000, 3)) * 10_000)
    tree = kernels.ReferenceTree(np.arange(20_000), refs)
    for leaf in range(len(tree.leaves)):
        if tree.least[leaf, 0] > 4_000:
            tree.leaves[leaf] = None  # reading it fails
    queries = refs[refs[:, 0] < 1_000]
    rows, _, dist = kernels.nearest_in_tree(np.arange(len(queries)), queries, tree, 5, False)
    assert len(rows) == 5 * len(queries) and dist.max() < 3_000**2


def test_reach_looks_at_boxes_of_a_cell():
    """A query between the members of a cell is in its box, yet near none of them."""
    rng = np.random.default_rng(8)
    ends = np.concatenate([codes(rng, 2_000) // 10, 9_000 + codes(rng, 2_000) // 10])
    tree = kernels.ReferenceTree(np.arange(4_000), ends, 64)
    starts = np.array([0, len(tree.least)])
    queries = np.concatenate([np.full((3, 14), 5_000.0), ends[::40]])
    bounds = np.full(len(queries), 1_000.0**2)
    rows, cells = np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64)
    whole = kernels.in_some_box(queries, bounds, rows, cells, starts[:2] * 0 + [0, 1], ends.min(0)[None], ends.max(0)[None])
    assert whole.all()
    found = kernels.in_some_box(queries, bounds, rows, cells, starts, tree.least, tree.largest)
    assert found.tolist() == [False] * 3 + [True] * (len(queries) - 3)


def test_leaf_meets_its_queries_at_once(monkeypatch):
    """Held pairs are bounded, and the result is the same however few are held."""
    rng = np.random.default_rng(9)
    refs, ids = codes(rng, 3_000), rng.permutation(3_000)
    tree = kernels.ReferenceTree(ids, refs)
    whole = kernels.nearest_in_tree(ids[:900], refs[:900], tree, 5, True)
    monkeypatch.setattr(kernels, "_HELD_PAIRS", 50)
    parts = kernels.nearest_in_tree(ids[:900], refs[:900], tree, 5, True)

    def ordered(found):
        return sorted(zip(*[column.tolist() for column in found]))

    assert ordered(whole) == ordered(parts) and len(whole[0]) == 4_500


@pytest.mark.parametrize("bounded", [False, True])
def test_groups_of_queries_are_compared_with_boxes(monkeypatch, bounded):
    """Queries near one another look at all leaves together, not one by one."""
    rng = np.random.default_rng(10)
    refs, ids = codes(rng, 6_000), rng.permutation(6_000)
    tree = kernels.ReferenceTree(ids, refs)
    compared, gaps = [], kernels._gaps

    def counted(low, high, least, largest):
        compared.append(len(low) * len(least))
        return gaps(low, high, least, largest)

    monkeypatch.setattr(kernels, "_gaps", counted)
    bounds = np.full(2_003, 4_000.0**2) if bounded else None
    kernels.nearest_in_tree(ids[:2_003], refs[:2_003], tree, 5, True, bounds)
    assert sum(compared) <= 2_003 * len(tree.leaves) / 8


def test_single_precision_loses_no_pair():
    """Bounds that are met exactly, by sums of squares that single precision does not hold."""
    rng = np.random.default_rng(11)
    refs = rng.integers(-32_768, 32_768, (3_000, 14)).astype(float)
    queries = rng.integers(-32_768, 32_768, (700, 14)).astype(float)
    full = ((queries[:, None, :] - refs[None]) ** 2).sum(axis=2)
    bounds = full.min(axis=1)
    tree = kernels.ReferenceTree(np.arange(3_000), refs, 1)
    rows, _, dist = kernels.nearest_in_tree(np.arange(700), queries, tree, 1, False, bounds)
    assert rows.tolist() == list(range(700)) and (dist == bounds).all()
    starts, every = np.array([0, len(tree.least)]), np.arange(700)
    found = kernels.in_some_box(queries, bounds, every, every * 0, starts, tree.least, tree.largest)
    assert found.all()
    assert not kernels.in_some_box(queries, bounds * 0.99, every, every * 0, starts, tree.least, tree.largest).any()


def test_near_order_is_a_permutation():
    rng = np.random.default_rng(12)
    for points in (codes(rng, 1_001), np.zeros((100, 3)), np.zeros((0, 3)), codes(rng, 7)):
        assert sorted(kernels._near_order(points).tolist()) == list(range(len(points)))


def test_leaf_meets_bounded_numbers_of_queries(monkeypatch):
    """However many queries a leaf has, few keys are held, and the result is the same."""
    rng = np.random.default_rng(13)
    refs, ids = codes(rng, 1_000), rng.permutation(1_000)
    tree = kernels.ReferenceTree(ids, refs)
    whole = kernels.nearest_in_tree(ids, refs, tree, 5, True)
    most, least_keys = [], kernels._least_keys
    monkeypatch.setattr(kernels, "_MEET_ROWS", 37)
    monkeypatch.setattr(kernels, "_least_keys", lambda held, keys, lows: most.append(len(keys)) or least_keys(held, keys, lows))
    parts = kernels.nearest_in_tree(ids, refs, tree, 5, True)
    assert max(most) <= 37
    assert sorted(zip(*[c.tolist() for c in whole])) == sorted(zip(*[c.tolist() for c in parts]))
