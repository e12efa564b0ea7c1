"""Array arithmetic for one Arrow batch or one bounded block of rows.

Spark partitions, shuffles and merges; these helpers only do the dense
products inside a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Rows x columns of one dense product, sized to stay in the processor cache.
_TILE_CELLS = 1 << 18
_TILE_COLUMNS = 2_048
# References of a leaf, queries whose leaves are looked up together, and queries that are worth a tree.
_LEAF_ROWS = 256
_GROUP_ROWS = 16
_TREE_QUERIES = 512
# Boxes of a cell that are looked at as one before each of them is.
_BOX_RUN = 12
# Queries that meet a leaf at once: their keys stay in the processor cache.
_MEET_ROWS = 2_048
# Pairs of a group of queries and a leaf that are looked up at once.
_HELD_PAIRS = 1 << 20
# Keys of a leaf that are compared as one; leaves are filled up to a multiple with a key above all.
_STRIDE = 16
_NO_KEY = 2.0**53
# Sums of some thousand squares in single precision stay within this share, while norms are below this.
_SLACK = 1e-4
_SINGLE_NORMS = 2.0**46


def to_matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Fixed-width list column to a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("vector column holds nulls")
    flat = column.flatten()
    if flat.null_count or len(flat) != len(column) * dim:
        raise ValueError(f"every vector must hold {dim} non-null values")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _tiles(rows: int, columns: int):
    step = max(1, _TILE_CELLS // max(columns, 1))
    for start in range(0, rows, step):
        yield slice(start, min(start + step, rows))


def _in_order_dot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row-wise dot product summed dimension by dimension, as SQL would."""
    total = left[:, 0] * right[:, 0]
    for d in range(1, left.shape[1]):
        total = total + left[:, d] * right[:, d]
    return total


def squared_norms(matrix: np.ndarray) -> np.ndarray:
    return _in_order_dot(matrix, matrix)


def _rows_to_ranks(rows: np.ndarray) -> np.ndarray:
    """Position of each entry within its (sorted, contiguous) row."""
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    return np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))


def rank_centroids(
    queries: np.ndarray, centroids: np.ndarray, norms: np.ndarray, n: int
) -> np.ndarray:
    """Row positions of the ``n`` best centroids per query, by (score, position).

    A matrix product finds everything within rounding distance of the n-th
    best; only those few are scored again with a fixed summation order, so the
    ranking does not depend on how the product was blocked.
    """
    n = min(n, len(centroids))
    ranked = np.empty((len(queries), n), dtype=np.int32)
    slack = 1e-9 * (1.0 + float(np.abs(norms).max(initial=0.0)))
    for tile in _tiles(len(queries), len(centroids)):
        block = queries[tile]
        rough = norms - 2.0 * (block @ centroids.T)
        worst = np.partition(rough, n - 1, axis=1)[:, n - 1]
        margin = slack + 1e-9 * np.abs(worst)
        rows, found = np.nonzero(rough <= (worst + margin)[:, None])
        score = norms[found] - 2.0 * _in_order_dot(centroids[found], block[rows])
        order = np.lexsort((found, score, rows))
        rows, found = rows[order], found[order]
        rank = _rows_to_ranks(rows)
        keep = rank < n
        ranked[tile][rows[keep], rank[keep]] = found[keep]
    return ranked


def score_range(
    queries: np.ndarray, centroids: np.ndarray, norms: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroids scored, best and worst score per query, summed in order."""
    best = np.empty(len(queries))
    worst = np.empty(len(queries))
    for tile in _tiles(len(queries), len(centroids)):
        block = queries[tile]
        dot = np.outer(block[:, 0], centroids[:, 0])
        for d in range(1, centroids.shape[1]):
            dot += np.outer(block[:, d], centroids[:, d])
        score = norms - 2.0 * dot
        best[tile], worst[tile] = score.min(axis=1), score.max(axis=1)
    return np.full(len(queries), len(centroids), dtype=np.int32), best, worst


def nearest_centroid(
    vectors: np.ndarray, centroids: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Position of and squared distance to the nearest centroid; ties go low."""
    position = np.empty(len(vectors), dtype=np.int32)
    distance = np.empty(len(vectors), dtype=np.float64)
    norms = squared_norms(centroids)
    slack = 1e-9 * (1.0 + float(norms.max(initial=0.0)))
    for tile in _tiles(len(vectors), len(centroids)):
        block = vectors[tile]
        rough = norms - 2.0 * (block @ centroids.T)
        best = rough.min(axis=1)
        margin = slack + 1e-9 * np.abs(best)
        rows, found = np.nonzero(rough <= (best + margin)[:, None])
        gap = block[rows] - centroids[found]
        exact = squared_norms(gap)
        order = np.lexsort((found, exact, rows))
        first = order[_rows_to_ranks(rows[order]) == 0]
        position[tile] = found[first]
        distance[tile] = exact[first]
    return position, distance


def reachable_centroids(
    codes: np.ndarray,
    bounds: np.ndarray,
    centers: np.ndarray,
    radii: np.ndarray,
    visited: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Unvisited cells that may hold a member within ``bounds`` of each query.

    A member lies no nearer than the distance to its cell's centre minus the
    cell's radius.  Rounding is met by a slack that only ever adds cells.
    Returns (cells per query, cell positions).
    """
    counts = np.zeros(len(codes), dtype=np.int64)
    cells: list[np.ndarray] = []
    squared = squared_norms(centers)
    for tile in _tiles(len(codes), len(centers)):
        block = codes[tile]
        gaps = squared_norms(block)[:, None] + squared - 2.0 * (block @ centers.T)
        nearest = np.sqrt(np.maximum(gaps, 0.0)) - radii
        reach = np.sqrt(bounds[tile]) + 1.0
        inside = nearest <= reach[:, None]
        inside[np.arange(len(block))[:, None], visited[tile]] = False
        counts[tile] = inside.sum(axis=1)
        cells.append(np.nonzero(inside)[1])
    return counts, np.concatenate(cells) if cells else np.empty(0, dtype=np.int64)


def out_of_box(
    codes: np.ndarray,
    rows: np.ndarray,
    least: np.ndarray,
    largest: np.ndarray,
    cells: np.ndarray,
    bounds: np.ndarray,
) -> np.ndarray:
    """For pairs of a query (``rows``) and a cell (``cells``): whether the cell's box is beyond the bound.

    Codes and boxes are whole numbers, so the sums are exact below 2**53.
    """
    gone = np.zeros(len(rows), dtype=bool)
    for tile in _tiles(len(rows), codes.shape[1]):
        point = codes[rows[tile]]
        gap = np.maximum(least[cells[tile]] - point, point - largest[cells[tile]])
        gone[tile] = squared_norms(np.maximum(gap, 0.0)) > bounds[rows[tile]]
    return gone


def _filled(codes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The right side of a leaf's keys: codes, ones, ``keys``, filled up to a multiple of _STRIDE columns."""
    rows, dim = codes.shape
    leaf = np.zeros((dim + 2, -(-rows // _STRIDE) * _STRIDE))
    leaf[:dim, :rows], leaf[dim, :rows] = codes.T, 1.0
    leaf[-1, :rows], leaf[-1, rows:] = keys, _NO_KEY
    return leaf


def _least_keys(held: np.ndarray, keys: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """The least of ``held`` and ``keys``, as many as are held; ``lows`` are minima of _STRIDE keys each.

    As many minima as are wanted lie at or under the last of them, so no other stride holds a wanted key.
    """
    k = held.shape[1]
    if lows.shape[1] > k:
        strides = np.argpartition(lows, k - 1, axis=1)[:, :k]
        keys = keys.reshape(len(keys), _STRIDE, -1)[np.arange(len(keys))[:, None], :, strides].reshape(len(keys), -1)
    return np.partition(np.concatenate([held, keys], axis=1), k - 1, axis=1)[:, :k]


class ReferenceTree:
    """The references of one block, dealt into leaves of near ones, each with the box around it.

    A leaf is halved at the median of the code that varies most until it holds no more than ``leaf_rows``.
    ``positions`` are places in ref-id order, which break ties.
    """

    def __init__(self, ref_ids: np.ndarray, refs: np.ndarray, leaf_rows: int = _LEAF_ROWS):
        self.by_id = np.argsort(ref_ids, kind="stable")
        self.ids = ref_ids[self.by_id]
        codes = refs[self.by_id]
        self.size = len(codes)
        self.splits: list[tuple[int, float] | None] = []
        order, self.starts = self._halved(codes, leaf_rows)
        self.place = np.empty(self.size, dtype=np.int64)
        self.place[order] = np.arange(self.size)
        codes = codes[order]
        norms = squared_norms(codes)
        self.farthest = norms.max(initial=0.0)
        self.least = np.minimum.reduceat(codes, self.starts[:-1]) if self.size else codes
        self.largest = np.maximum.reduceat(codes, self.starts[:-1]) if self.size else codes
        keys = self.size * norms + order
        self.leaves = [_filled(codes[a:b], keys[a:b]) for a, b in zip(self.starts[:-1], self.starts[1:])]

    def _halved(self, codes: np.ndarray, leaf_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows in the order of leaves, and where leaves start; ``splits`` in the order of the walk."""
        leaves: list[np.ndarray] = []
        open_nodes = [np.arange(len(codes))]
        while open_nodes:
            rows = open_nodes.pop()
            part = codes[rows]
            if len(rows) > leaf_rows and (part == part[0]).all():
                # Copies of one vector: the order of ids is kept.
                pieces = np.array_split(rows, -(-len(rows) // leaf_rows))
                leaves += pieces
                self.splits.append((-1, float(len(pieces))))
            elif len(rows) <= leaf_rows:
                leaves.append(rows)
                self.splits.append((-1, 1.0))
            else:
                # One code at a time, as a block may be wide.
                widest = int(np.argmax([part[:, d].std() for d in range(part.shape[1])]))
                values = part[:, widest]
                middle = np.partition(values, len(rows) // 2)[len(rows) // 2]
                below = values < middle
                if not below.any():
                    below = values <= middle
                self.splits.append((widest, float(values[below].max())))
                open_nodes += [rows[~below], rows[below]]
        order = np.concatenate(leaves) if leaves else np.empty(0, dtype=np.int64)
        return order, np.cumsum([0, *(len(rows) for rows in leaves)])

    def in_leaf_order(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``queries`` in the order of the leaves they would lie in, and each row's leaf."""
        found: list[np.ndarray] = []
        home = np.zeros(len(queries), dtype=np.int64)
        leaf = 0
        open_nodes = [np.arange(len(queries))]
        for code, value in self.splits:
            rows = open_nodes.pop()
            if code < 0:
                found.append(rows)
                home[rows] = leaf
                leaf += int(value)
                continue
            below = queries[rows, code] <= value
            open_nodes += [rows[~below], rows[below]]
        return np.concatenate(found), home


def _gaps(low: np.ndarray, high: np.ndarray, least: np.ndarray, largest: np.ndarray) -> np.ndarray:
    """Squared distance of boxes ``low``..``high`` from boxes ``least``..``largest``, all with all.

    In the precision of the boxes; see ``_reach`` for what they are compared with.
    """
    total = np.zeros((len(low), len(least)), dtype=least.dtype)
    gap, other = np.empty_like(total), np.empty_like(total)
    lows, highs, leasts, largests = (np.ascontiguousarray(side.T) for side in (low, high, least, largest))
    for d in range(low.shape[1]):
        np.subtract(leasts[d], highs[d][:, None], out=gap)
        np.subtract(lows[d][:, None], largests[d], out=other)
        np.maximum(gap, other, out=gap)
        np.maximum(gap, 0.0, out=gap)
        np.square(gap, out=gap)
        total += gap
    return total


def _reach(bounds: np.ndarray, kind: type) -> np.ndarray:
    """What a gap in the precision ``kind`` may be for a pair within ``bounds``, rounding included.

    Differences of codes are exact, squares and their sums only within the slack: it only ever adds pairs.
    """
    return (bounds * (1.0 + _SLACK)).astype(kind)


def _near_order(points: np.ndarray) -> np.ndarray:
    """Rows of ``points`` in an order in which those that follow one another are near."""
    parts: list[np.ndarray] = []
    open_nodes = [np.arange(len(points))]
    while open_nodes:
        rows = open_nodes.pop()
        part = points[rows]
        ends = part.max(axis=0) - part.min(axis=0) if len(rows) > _GROUP_ROWS else np.zeros(1)
        widest = int(ends.argmax())
        if not ends[widest]:
            parts.append(rows)
            continue
        middle = len(rows) // (2 * _GROUP_ROWS) * _GROUP_ROWS or _GROUP_ROWS
        order = np.argpartition(part[:, widest], middle)
        open_nodes += [rows[order[middle:]], rows[order[:middle]]]
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)


def in_some_box(
    codes: np.ndarray,
    bounds: np.ndarray,
    rows: np.ndarray,
    cells: np.ndarray,
    starts: np.ndarray,
    least: np.ndarray,
    largest: np.ndarray,
) -> np.ndarray:
    """For pairs of a query (``rows``) and a cell (``cells``): whether one of the cell's boxes is within the bound.

    Boxes ``starts[cell]`` to ``starts[cell + 1]`` belong to a cell; those that follow one another lie
    together, so runs of them are looked at first.  Rounding only ever finds more.
    """
    within = np.zeros(len(rows), dtype=bool)
    widest = max((np.abs(side).max(initial=0.0) for side in (codes, least, largest)))
    kind = np.float32 if 4.0 * codes.shape[1] * widest**2 < _SINGLE_NORMS else np.float64
    codes, least, largest = (side.astype(kind) for side in (codes, least, largest))
    reach = _reach(bounds, kind)
    by_cell = np.argsort(cells, kind="stable")
    ends = np.flatnonzero(np.r_[np.diff(cells[by_cell]) != 0, True]) + 1 if len(cells) else []
    for start, end in zip([0, *ends[:-1]], ends):
        some = by_cell[start:end]
        cell = cells[some[0]]
        runs = np.arange(starts[cell], starts[cell + 1], _BOX_RUN)
        low = np.minimum.reduceat(least[: starts[cell + 1]], runs)
        high = np.maximum.reduceat(largest[: starts[cell + 1]], runs)
        point, bound = codes[rows[some]], reach[rows[some]]
        near = _gaps(point, point, low, high) <= bound[:, None]
        for run in np.flatnonzero(near.any(axis=0)):
            left = np.flatnonzero(near[:, run] & ~within[some])
            box = slice(runs[run], min(runs[run] + _BOX_RUN, starts[cell + 1]))
            gaps = _gaps(point[left], point[left], least[box], largest[box])
            within[some[left]] = (gaps <= bound[left, None]).any(axis=1)
    return within


def block_tree(ref_ids: np.ndarray, refs: np.ndarray, queries: int) -> ReferenceTree:
    """The tree of a block; halving it often pays off where many queries share it."""
    return ReferenceTree(ref_ids, refs, _LEAF_ROWS if queries >= _TREE_QUERIES else max(_TILE_COLUMNS, len(refs) // 8))


def nearest_in_block(
    query_ids: np.ndarray,
    queries: np.ndarray,
    ref_ids: np.ndarray,
    refs: np.ndarray,
    k: int,
    skip_self: bool,
    bounds: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest rows of one block per query, by (distance, ref id).

    Returns (query row, ref row, distance); see ``nearest_in_tree``.
    """
    tree = block_tree(ref_ids, refs, len(queries))
    return nearest_in_tree(query_ids, queries, tree, k, skip_self, bounds)


def nearest_in_tree(
    query_ids: np.ndarray,
    queries: np.ndarray,
    tree: ReferenceTree,
    k: int,
    skip_self: bool,
    bounds: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest rows of a block per query, by (distance, ref id).

    One float64 key, ``distance * size + position in ref-id order``, ranks a
    pair and breaks its ties.  Codes are integers and every partial sum stays
    below 2**53, so a single product yields exact keys.  A query without a bound
    first meets the leaf it would lie in.  What it has reached then tells the leaves
    that may hold something for it: those whose box is no farther.  Each leaf meets
    all its queries at once.  ``bounds`` drops pairs farther than a distance already
    reached.  Returns (query row, ref row, distance).
    """
    size = tree.size
    query_norms = squared_norms(queries)
    farthest = 2.0 * (query_norms.max(initial=0.0) + tree.farthest)
    if (farthest + 1.0) * size >= 2.0**53:
        raise ValueError(f"a block of {size} rows is too large for exact keys")

    left = np.column_stack([-2.0 * size * queries, size * query_norms, np.ones(len(queries))])
    limit = np.full(len(queries), _NO_KEY)
    if bounds is not None:
        limit = np.minimum((bounds.astype(np.float64) + 1.0) * size, _NO_KEY)
    own = np.full(len(queries), -1)
    if skip_self:
        at = np.searchsorted(tree.ids, query_ids)
        there = at < size
        there[there] = tree.ids[at[there]] == query_ids[there]
        own[there] = tree.place[at[there]]

    best = np.full((len(queries), k), _NO_KEY)
    worst = limit.copy()

    def meet(leaf: int, every: np.ndarray) -> None:
        """Bring in what one leaf holds for the rows ``every``, which are distinct."""
        for start in range(0, len(every), _MEET_ROWS):
            compare(leaf, every[start : start + _MEET_ROWS])

    def compare(leaf: int, rows: np.ndarray) -> None:
        keys = left[rows] @ tree.leaves[leaf]
        if skip_self:
            slot = own[rows] - tree.starts[leaf]
            mine = np.flatnonzero((slot >= 0) & (slot < tree.starts[leaf + 1] - tree.starts[leaf]))
            keys[mine, slot[mine]] = _NO_KEY
        lows = keys.reshape(len(keys), _STRIDE, -1).min(axis=1)
        better = np.flatnonzero(lows.min(axis=1) < worst[rows])
        if len(better):
            found = rows[better]
            held = _least_keys(best[found], keys[better], lows[better])
            best[found] = held
            worst[found] = np.minimum(held.max(axis=1), limit[found])

    order, home = tree.in_leaf_order(queries)
    met = limit == _NO_KEY
    first = order[met[order]]
    for rows in np.split(first, np.flatnonzero(np.diff(home[first])) + 1):
        if len(rows):
            meet(home[rows[0]], rows)

    kind = np.float32 if farthest < _SINGLE_NORMS else np.float64
    least, largest = tree.least.astype(kind), tree.largest.astype(kind)
    step = max(1, _HELD_PAIRS // max(len(least), 1)) * _GROUP_ROWS
    near_rows = _near_order(queries)
    for start in range(0, len(near_rows), step):
        rows = near_rows[start : start + step]
        points = np.ascontiguousarray(queries[rows].T, dtype=kind)
        firsts = np.arange(0, len(rows), _GROUP_ROWS)
        low, high = (f.reduceat(points, firsts, axis=1).T for f in (np.minimum, np.maximum))
        reached = np.maximum.reduceat(worst[rows], firsts)
        # Of each group the leaves that may be in reach of one of its queries, leaf by leaf.
        leaf, group = np.nonzero((_gaps(low, high, least, largest) <= _reach(reached / size, kind)[:, None]).T)
        for one in np.split(np.arange(len(leaf)), np.flatnonzero(np.diff(leaf)) + 1):
            if not len(one):
                continue
            at = (firsts[group[one], None] + np.arange(_GROUP_ROWS)).ravel()
            at = at[: len(at) - (at[-1] >= len(rows)) * (at[-1] + 1 - len(rows))]
            meant, box = rows[at], leaf[one[0]]
            gap = np.take(points, at, axis=1)
            gap -= np.clip(gap, least[box, :, None], largest[box, :, None])
            np.square(gap, out=gap)
            inside = gap.sum(axis=0) <= _reach(worst[meant] / size, kind)
            inside &= (home[meant] != box) | ~met[meant]
            if inside.any():
                meet(box, meant[inside])
    rows, slots = np.nonzero(best < limit[:, None])
    keys = best[rows, slots]
    distances = np.floor_divide(keys, size)
    positions = (keys - distances * size).astype(np.int64)
    return rows, tree.by_id[positions], distances.astype(np.int64)
