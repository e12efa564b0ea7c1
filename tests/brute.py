"""Plain reference implementations for small fixtures."""

import numpy as np


def neighbours(queries, refs, k=5, skip_self=False):
    """(query id -> [(distance, ref id, fraud)]) by comparing all pairs."""
    found = {}
    for query_id, codes in queries:
        pairs = sorted(
            (int(((np.asarray(codes) - np.asarray(other)) ** 2).sum()), ref_id, fraud)
            for ref_id, other, fraud in refs
            if not (skip_self and ref_id == query_id)
        )
        found[query_id] = pairs[:k]
    return found


def collected(df):
    """The same shape from a neighbour frame."""
    found = {}
    for row in df.collect():
        found.setdefault(row["query_id"], []).append((row["dist"], row["ref_id"], row["fraud"]))
    return {key: sorted(value) for key, value in found.items()}
