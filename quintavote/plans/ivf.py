"""Building the inverted-file index and searching it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quintavote.config import DIM, NEIGHBOURS, SCALE, BuildParams, ProbeParams
from quintavote.functions.kernels import to_matrix
from quintavote.functions.scores import is_borderline
from quintavote.operators.clustering import (
    CentroidTable,
    kmeans_fit,
    nearest_centroid,
    train_sample,
)
from quintavote.operators.probing import probe_rows, with_probes, within_reach
from quintavote.operators.scan import (
    NEAR_TYPE,
    REFERENCE_BLOCK,
    StoredBlocks,
    block_boxes,
    fits_in_memory,
    one_pass_scan,
    scan_probes,
    stored_scan,
)
from quintavote.operators.topk import (
    borderline,
    carried_candidates,
    fraud_vote,
    list_bound,
    listed_candidates,
    merged_lists,
    nearest_copies,
    topk_merge,
    topk_neighbors,
    with_lists,
    with_neighbours,
)
from quintavote.operators.vectorize import with_reference_codes
from quintavote.staging import materialize

# Members around which a box of a cluster is drawn, and boxes of an index (7 MB as two matrices of doubles).
BOX_ROWS = 512
MAX_BOXES = 32_768


@dataclass(frozen=True)
class IvfIndex:
    """Centroids, posting lists and the settings both were made with."""

    centroids: DataFrame
    postings: DataFrame
    dim: int = DIM
    scale: int = SCALE
    # Of a stored index: postings in blocks and how they lie in storage.
    stored: StoredBlocks | None = None

    @cached_property
    def table(self) -> CentroidTable:
        """The centroid matrix, fetched once per opened index."""
        return CentroidTable.load(self.centroids, self.dim)

    @cached_property
    def boxes(self) -> Broadcast | None:
        """Of a stored index: ids of clusters, where the boxes of each begin and end, least and largest codes."""
        if self.stored is None:
            return None
        # A few rows a block at the least, and no more than some MAX_BOXES in all.
        blocks = self.stored.layout.agg(F.sum("blocks")).first()[0] or 0
        rows = block_boxes(self.stored, self.dim, max(BOX_ROWS, blocks * REFERENCE_BLOCK // MAX_BOXES)).toArrow()
        if not rows.num_rows:
            return None
        rows = rows.sort_by("cluster_id")
        ids, counts = np.unique(rows["cluster_id"].to_numpy(), return_counts=True)
        held = (
            ids, np.r_[0, np.cumsum(counts)], to_matrix(rows["least"], self.dim), to_matrix(rows["largest"], self.dim),
        )
        return self.centroids.sparkSession.sparkContext.broadcast(held)


def assign_postings(
    references: DataFrame, centroids: DataFrame, dim: int = DIM
) -> DataFrame:
    """Posting rows of all references under the given centroids."""
    coded = with_reference_codes(references)
    assigned = nearest_centroid(coded, CentroidTable.load(centroids, dim))
    return assigned.select("cluster_id", "ref_id", "codes", "fraud")


def build_index(
    references: DataFrame,
    params: BuildParams = BuildParams(),
    dim: int = DIM,
    collapse_copies: bool = False,
    seeds: DataFrame | None = None,
) -> IvfIndex:
    """Sample, train, assign and quantise ``references`` (ref_id, vector, fraud).

    ``collapse_copies`` leaves out references that equal others of lower id in
    their cluster and so can never be chosen; results stay the same, hot vectors
    stop costing.  ``seeds`` replace the seeding.  Sampling, seeding and rounds are fixed by
    the settings, so a build can be repeated.
    """
    sample = materialize(
        train_sample(references, "ref_id", params.train_rows, params.seed), "train"
    )
    centroids = materialize(
        kmeans_fit(
            sample, params.clusters, params.max_iter, params.seed, params.early_stop, dim, seeds
        ),
        "centroids",
    )
    postings = assign_postings(references, centroids, dim)
    if collapse_copies:
        postings = nearest_copies(postings, NEIGHBOURS + 1, "cluster_id")
    return IvfIndex(centroids, materialize(postings, "postings"), dim)


def _ranked(queries: DataFrame, index: IvfIndex, n: int) -> DataFrame:
    probed = with_probes(queries, index.table, n)
    return materialize(probed.select("query_id", "codes", "probes"), "ranked")


def _scan(probes: DataFrame, index: IvfIndex, skip_self: bool, small: bool) -> DataFrame:
    return scan_probes(
        probes, index.postings, index.dim, NEIGHBOURS, skip_self, small, index.stored
    )


def in_reach(bounded: DataFrame, index: IvfIndex, first: int, last: int) -> DataFrame:
    """Probe rows ``first``..``last`` of queries with a ``bound``, without clusters that lie beyond it."""
    if index.boxes is None:
        return probe_rows(bounded, first, last)
    rest = bounded.withColumn("probes", F.slice("probes", first, last - first + 1))
    near = within_reach(rest.select("query_id", "codes", "probes", "bound"), index.boxes, index.dim)
    rows = probe_rows(near, 1, last - first + 1)
    return materialize(rows.withColumn("probe_rank", F.col("probe_rank") + (first - 1)), "probes")


def nearest_lists(ranked: DataFrame, index: IvfIndex, fast: int, skip_self: bool) -> DataFrame:
    """Top five of each query in its ``fast`` nearest clusters of a stored index: query_id, near.

    The nearest cluster is searched first.  What a query finds in one of its blocks bounds the other
    clusters, most of which hold nothing as near: those are neither asked nor do they return rows.
    """
    stored, none = index.stored, F.array().cast(NEAR_TYPE)
    asking = probe_rows(ranked.withColumn("carried", F.col("probes")), 1, 1, "carried")
    asking = asking.withColumnRenamed("carried", "probes")
    found = stored_scan(asking, stored, index.dim, NEIGHBOURS, skip_self, kept=["codes", "probes"])
    # A query whose nearest cluster has no members found nothing yet.
    empty = (
        ranked.withColumn("cluster_id", F.col("probes")[0])
        .join(F.broadcast(stored.layout.select("cluster_id")), "cluster_id", "left_anti")
        .select("query_id", "codes", "probes", none.alias("near"), F.lit(0).alias("block"))
    )
    first = materialize(found.unionByName(empty), "first")
    if fast == 1:
        return merged_lists(first)
    # A query that met several blocks asks from one of them.
    cluster = F.col("probes")[0].alias("cluster_id")
    counts = F.broadcast(stored.layout.select("cluster_id", "blocks"))
    one = first.select("*", cluster).join(counts, "cluster_id", "left").where(
        "block = coalesce(pmod(xxhash64(query_id), blocks), 0)"
    )
    bounded = one.select("query_id", "codes", "probes", list_bound("near").alias("bound"))
    more = stored_scan(in_reach(bounded, index, 2, fast), stored, index.dim, NEIGHBOURS, skip_self, kept=[])
    return merged_lists(first.select("query_id", "near").unionByName(more))


def _nearest(ranked: DataFrame, index: IvfIndex, fast: int, skip_self: bool, small: bool) -> DataFrame:
    """Top five of each query in its ``fast`` nearest clusters, as neighbours."""
    if not small and index.stored is not None:
        return listed_candidates(nearest_lists(ranked, index, fast, skip_self))
    if small or fast == 1:
        return topk_neighbors(_scan(probe_rows(ranked, 1, fast), index, skip_self, small))
    first = materialize(topk_neighbors(_scan(probe_rows(ranked, 1, 1), index, skip_self, False)), "first")
    bounded = with_neighbours(ranked, first).select("query_id", "codes", "probes", "bound")
    return topk_merge(first, _scan(probe_rows(bounded, 2, fast), index, skip_self, False))


def fast_neighbors(
    queries: DataFrame,
    index: IvfIndex,
    params: ProbeParams = ProbeParams(),
    skip_self: bool = False,
    small_queries: bool = False,
) -> DataFrame:
    """Top five of each query (query_id, vector, codes) in its nearest clusters."""
    fast = params.clamped(index.table.size).fast
    return _nearest(_ranked(queries, index, fast), index, fast, skip_self, small_queries)


def fast_votes(queries: DataFrame, index: IvfIndex, passed: DataFrame | None = None, **options) -> DataFrame:
    """Votes of the fast clusters; ``passed`` is a landed ``fast_pass`` of these queries with the same options."""
    if passed is not None:
        return passed.select("query_id", "votes")
    return fraud_vote(queries, fast_neighbors(queries, index, **options))


def fast_pass(
    queries: DataFrame,
    index: IvfIndex,
    params: ProbeParams = ProbeParams(),
    skip_self: bool = False,
    small_queries: bool = False,
) -> DataFrame:
    """The queries ranked for all probes, with what their fast clusters gave: neighbours, votes and bound."""
    params = params.clamped(index.table.size)
    ranked = _ranked(queries, index, params.full)
    if index.stored is not None:
        return with_lists(ranked, nearest_lists(ranked, index, params.fast, skip_self))
    return with_neighbours(ranked, _nearest(ranked, index, params.fast, skip_self, small_queries))


def adaptive_votes(
    queries: DataFrame,
    index: IvfIndex,
    params: ProbeParams = ProbeParams(),
    skip_self: bool = False,
    small_queries: bool = False,
    passed: DataFrame | None = None,
) -> DataFrame:
    """Fast vote, extended to more clusters where it came out at 2 or 3.

    Returns query_id, votes, fast_votes and expanded.  The first pass is landed
    with its neighbours, so the second only reads the clusters that are new;
    ``passed`` is one that was landed before (``fast_pass`` with the same settings).

    With ``small_queries`` and a stored index, a set of queries that fits in memory
    is scored in one read of the postings instead (``one_pass_votes``).
    """
    params = params.clamped(index.table.size)
    if small_queries and index.stored and passed is None:
        found = one_pass_votes(queries, index, params, skip_self)
        if found is not None:
            return found
    lists = index.stored is not None
    fast = passed
    if fast is None:
        fast = materialize(fast_pass(queries, index, params, skip_self, small_queries), "fast")
    fast_votes_only = fast.select("query_id", F.col("votes").alias("fast_votes"))
    if params.full <= params.fast:
        return fast_votes_only.select(
            "query_id", F.col("fast_votes").alias("votes"), "fast_votes", F.lit(False).alias("expanded")
        )

    unsettled = borderline(fast)
    more = in_reach(unsettled, index, params.fast + 1, params.full)
    if lists:
        extra = stored_scan(more, index.stored, index.dim, NEIGHBOURS, skip_self, kept=[])
        merged = listed_candidates(merged_lists(unsettled.select("query_id", "near").unionByName(extra)))
    else:
        merged = topk_merge(carried_candidates(unsettled), _scan(more, index, skip_self, small_queries))
    final = fraud_vote(unsettled, merged).withColumnRenamed("votes", "_final")
    if lists:
        # Written, as the packs that probes are moved in want memory (``staging.materialize``).
        final = materialize(final, "final")
    return fast_votes_only.join(final, "query_id", "left").select(
        "query_id",
        F.coalesce("_final", "fast_votes").alias("votes"),
        "fast_votes",
        F.col("_final").isNotNull().alias("expanded"),
    )


def one_pass_votes(
    queries: DataFrame,
    index: IvfIndex,
    params: ProbeParams = ProbeParams(),
    skip_self: bool = False,
) -> DataFrame | None:
    """``adaptive_votes`` of a small set of queries from one read of a stored index.

    Every task scans all probes of a query and keeps the nearest of its fast clusters and of
    its others apart, so both votes come from what it leaves.  ``queries`` is read twice.
    None when the queries with their probes do not fit in memory; that is decided by bytes.
    """
    params = params.clamped(index.table.size)
    asked = with_probes(queries, index.table, params.full).select("query_id", "codes", "probes")
    held = fits_in_memory(asked, index.dim, params.full)
    if held is None:
        return None
    found = one_pass_scan(held, index.stored, index.dim, params.fast, NEIGHBOURS, skip_self)
    # A row without candidate, so that queries that found nothing are there as well.
    nothing = found.schema["near"].dataType
    every = found.unionByName(queries.select("query_id", F.lit(None).cast(nothing).alias("near")))
    grouped = every.groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))

    def votes(kept: str) -> str:
        return f"aggregate(slice({kept}, 1, {NEIGHBOURS}), 0, (n, x) -> n + x.fraud)"

    counted = grouped.select(
        "query_id",
        F.expr(votes(f"filter(near, x -> x.probe_rank <= {params.fast})")).alias("fast_votes"),
        F.expr(votes("near")).alias("_all"),
    )
    again = is_borderline(F.col("fast_votes")) & F.lit(params.full > params.fast)
    return counted.select(
        "query_id",
        F.when(again, F.col("_all")).otherwise(F.col("fast_votes")).alias("votes"),
        "fast_votes",
        again.alias("expanded"),
    )
