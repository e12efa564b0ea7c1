"""Meeting probes with posting lists.

The join key is the cluster, and a cluster may be hot on either side: a third
of all references may be copies of one vector, a third of all queries may land
in one cluster.  Both sides are therefore cut into bounded blocks, and a block
pair returns at most ``k`` rows per query, so neither a group nor its output
grows with the hottest cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quintavote.config import DIM, MAX_PROBES, NEIGHBOURS
from quintavote.functions.kernels import ReferenceTree, block_tree, nearest_in_block, nearest_in_tree, to_matrix
from quintavote.staging import share, ship_package

# Average sizes of a full block, as rows are dealt by hash; a task holds one block pair
# at a time.
REFERENCE_BLOCK = 131_072
QUERY_BLOCK = 32_768

# Probes up to this size are broadcast instead of moved to the postings' buckets.
MEMORY_BYTES = 64 << 20
# Query blocks of one cluster that one bucket takes; clusters asked for more often are dealt
# out, postings and all.
HELD_BLOCKS = 8
# Clusters up to this number are named in a filter; above it, shelves alone are.
NAMED_CLUSTERS = 1_000
# Candidates held in a task before they are cut to the nearest.
HELD_CANDIDATES = 1 << 20

CANDIDATE_SCHEMA = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("cluster_id", T.IntegerType()),
        T.StructField("probe_rank", T.IntegerType()),
        T.StructField("ref_id", T.LongType()),
        T.StructField("dist", T.LongType()),
        T.StructField("fraud", T.IntegerType()),
    ]
)
# What a scan leaves of a probe where it leaves lists.
NEAR_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("dist", T.LongType()),
            T.StructField("ref_id", T.LongType()),
            T.StructField("fraud", T.IntegerType()),
        ]
    )
)
_ARROW_SCHEMA = pa.schema(
    [
        ("query_id", pa.int64()),
        ("cluster_id", pa.int32()),
        ("probe_rank", pa.int32()),
        ("ref_id", pa.int64()),
        ("dist", pa.int64()),
        ("fraud", pa.int32()),
    ]
)


@dataclass(frozen=True)
class StoredBlocks:
    """Postings as they lie in storage.

    ``blocks`` holds one row a block: cluster_id, block, members (ref_id, codes, fraud) and
    shelf.  It is a table bucketed by (cluster_id, block), so a join on both finds it in place,
    and partitioned by shelf, a run of clusters.  ``layout`` holds the number of blocks of each
    cluster that has members and its least and largest codes (at most MAX_CLUSTERS rows).
    """

    blocks: DataFrame
    layout: DataFrame
    buckets: int
    shelf_clusters: int

    def of_clusters(self, clusters: list[int]) -> DataFrame:
        """The blocks of the shelves that hold ``clusters``, and of those alone if they are few."""
        shelves = sorted({cluster // self.shelf_clusters for cluster in clusters})
        touched = self.blocks.filter(F.col("shelf").isin(shelves))
        return touched.filter(F.col("cluster_id").isin(clusters)) if len(clusters) <= NAMED_CLUSTERS else touched


def _candidates(
    probes: pa.Table,
    probe_codes: np.ndarray,
    postings: pa.Table,
    tree: ReferenceTree,
    k: int,
    skip_self: bool,
    kept: list[str] | None = None,
) -> pa.Table:
    """Top ``k`` of one block of postings, as a tree, for each probe row.

    One row a candidate; with ``kept`` columns, even none, one list a probe instead.
    """
    if not probes.num_rows or not postings.num_rows:
        none = _ARROW_SCHEMA.empty_table()
        return none if kept is None else _lists(probes, none, np.empty(0, dtype=np.int64), kept)
    query_rows, ref_rows, dist = nearest_in_tree(
        probes["query_id"].to_numpy(),
        probe_codes,
        tree,
        k,
        skip_self,
        probes["bound"].to_numpy() if "bound" in probes.column_names else None,
    )
    found = probes.select(["query_id", "cluster_id", "probe_rank"]).take(query_rows)
    near = postings.select(["ref_id", "fraud"]).take(ref_rows)
    columns = [*found.columns, near["ref_id"], pa.array(dist), near["fraud"]]
    whole = pa.table(columns, names=_ARROW_SCHEMA.names).cast(_ARROW_SCHEMA)
    return whole if kept is None else _lists(probes, whole, query_rows, kept)


def _lists(probes: pa.Table, found: pa.Table, rows: np.ndarray, kept: list[str]) -> pa.Table:
    """``found`` (candidates of the probe rows ``rows``, in order) as one list a probe, nearest first.

    Without ``kept`` columns, probes that found nothing are left out.
    """
    order = np.lexsort((found["ref_id"].to_numpy(), found["dist"].to_numpy(), rows))
    near = found.select(["dist", "ref_id", "fraud"]).take(order).combine_chunks()
    ends = np.cumsum(np.bincount(rows, minlength=probes.num_rows))
    structs = pa.StructArray.from_arrays([c.combine_chunks() for c in near.columns], names=near.column_names)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), structs)
    whole = probes.select(["query_id", *kept]).append_column("near", lists)
    return whole if kept else whole.filter(pc.greater(pc.list_value_length(lists), 0))


def probe_columns(probes: DataFrame) -> list[str]:
    """The columns a scan carries; ``bound`` and, for the lists of a scan, ``probes`` are optional."""
    columns = ["query_id", "codes", "probe_rank", "cluster_id"]
    return columns + [name for name in ("bound", "probes") if name in probes.columns]


def shuffled_scan(
    probes: DataFrame,
    postings: DataFrame,
    dim: int = DIM,
    k: int = NEIGHBOURS,
    skip_self: bool = False,
    reference_block: int = REFERENCE_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """Cogroup bounded blocks of probes and postings of the same cluster."""

    ship_package(probes.sparkSession)

    def blocks(side: DataFrame, size: int, name: str) -> DataFrame:
        count = F.ceil(F.count("*") / F.lit(size)).cast("int")
        return side.groupBy("cluster_id").agg(count.alias(name))

    # One row per cluster (bounded by MAX_CLUSTERS).  The inner join also drops
    # postings nobody probes before they are shuffled.
    layout = F.broadcast(
        blocks(probes, query_block, "_query_blocks").join(
            blocks(postings, reference_block, "_ref_blocks"), "cluster_id"
        )
    )

    def all_of(column: str):
        return F.explode(F.sequence(F.lit(0), F.col(column) - 1))

    def one_of(key: str, column: str):
        return F.pmod(F.xxhash64(key), F.col(column)).cast("int")

    left = (
        probes.join(layout, "cluster_id")
        .withColumn("_query_block", one_of("query_id", "_query_blocks"))
        .withColumn("_ref_block", all_of("_ref_blocks"))
        .select(*probe_columns(probes), "_query_block", "_ref_block")
    )
    right = (
        postings.join(layout, "cluster_id")
        .withColumn("_ref_block", one_of("ref_id", "_ref_blocks"))
        .withColumn("_query_block", all_of("_query_blocks"))
        .select("ref_id", "codes", "fraud", "cluster_id", "_query_block", "_ref_block")
    )

    def scan(queries: pa.Table, references: pa.Table) -> pa.Table:
        query_codes = to_matrix(queries["codes"], dim)
        reference_codes = to_matrix(references["codes"], dim)
        tree = block_tree(references["ref_id"].to_numpy(), reference_codes, queries.num_rows)
        return _candidates(queries, query_codes, references, tree, k, skip_self)

    keys = ["cluster_id", "_query_block", "_ref_block"]
    return (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInArrow(scan, schema=CANDIDATE_SCHEMA)
    )


def _members(column: pa.Array, dim: int) -> tuple[pa.Table, np.ndarray]:
    """Posting rows of one block (a list of structs) and their codes as a matrix."""
    rows = column.flatten()
    table = pa.table([rows.field("ref_id"), rows.field("fraud")], names=["ref_id", "fraud"])
    return table, to_matrix(rows.field("codes"), dim)


def stored_scan(
    probes: DataFrame,
    stored: StoredBlocks,
    dim: int = DIM,
    k: int = NEIGHBOURS,
    skip_self: bool = False,
    query_block: int = QUERY_BLOCK,
    held_blocks: int = HELD_BLOCKS,
    kept: list[str] | None = None,
) -> DataFrame:
    """Move probes to the buckets of the stored postings, which stay where they are.

    Returns candidates, or, with ``kept`` columns of the probes, even none, their lists (``scan_pairs``).

    Probes of a cluster are dealt into query blocks, each of which meets every block of the
    cluster's postings.  A cluster asked for by more than ``held_blocks`` query blocks would
    keep one bucket busy, so its postings are copied once for every so many of them and those
    copies moved; they are less than the probes that ask for them.
    """
    ship_package(probes.sparkSession)
    columns = probe_columns(probes)
    asked = probes.groupBy("cluster_id").agg(
        F.ceil(F.count("*") / F.lit(query_block)).cast("int").alias("_query_blocks")
    )
    # One row a cluster, bounded by MAX_CLUSTERS.
    layout = stored.layout.select("cluster_id", "blocks").join(asked, "cluster_id").toArrow()
    held = probes.sparkSession.createDataFrame(layout, "cluster_id int, blocks int, _query_blocks int")
    dealt = (
        probes.join(F.broadcast(held), "cluster_id")
        .withColumn("_query_block", F.pmod(F.xxhash64("query_id"), F.col("_query_blocks")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    keys = ["cluster_id", "block"]
    packed = F.collect_list(F.struct(*[c for c in columns if c != "cluster_id"])).alias("asked")

    clusters = layout["cluster_id"].to_pylist()
    blocks = stored.of_clusters(clusters).select(*keys, "members")
    some = dealt.where(F.col("_query_blocks") <= held_blocks)
    pairs = (
        some.repartition(stored.buckets, *keys)
        .groupBy(*keys, "_query_block")
        .agg(packed)
        .hint("merge")
        .join(blocks, keys)
    )
    crowds = pc.sum(pc.greater(layout["_query_blocks"], held_blocks)).as_py() or 0
    if crowds:
        copy = (F.col("_query_block") / held_blocks).cast("int")
        crowd = held.where(F.col("_query_blocks") > held_blocks).select(
            "cluster_id",
            F.explode(F.sequence(F.lit(0), ((F.col("_query_blocks") - 1) / held_blocks).cast("int"))).alias("_copy"),
        )
        many = dealt.where(F.col("_query_blocks") > held_blocks).withColumn("_copy", copy)
        # Copies are few by construction: one for every so many full query blocks.
        moved = blocks.join(F.broadcast(crowd), "cluster_id")
        pairs = pairs.unionByName(
            many.repartition(*keys, "_copy")
            .groupBy(*keys, "_copy", "_query_block")
            .agg(packed)
            .hint("merge")
            .join(moved, [*keys, "_copy"])
            .drop("_copy")
        )

    names = [c for c in columns if c != "cluster_id"]
    return scan_pairs(pairs, names, dim, k, skip_self, kept)


def scan_pairs(
    pairs: DataFrame, names: list[str], dim: int, k: int, skip_self: bool, kept: list[str] | None = None
) -> DataFrame:
    """Candidates of pairs of blocks: cluster_id, block, asked (a list of probes, fields ``names``), members.

    With ``kept`` (of ``names``) what a probe found in a block is one row: query_id, these columns, ``near``,
    nearest first, and block.  With ``kept`` empty, only query_id and ``near`` of probes that found something.

    One pair is in memory at a time; packs of probes that follow one another in a block share its tree.
    """
    ship_package(pairs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, postings, tree = None, None, None
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                rows = one["asked"].flatten()
                block = (one["cluster_id"][0].as_py(), one["block"][0].as_py())
                if block != held:
                    postings, codes = _members(one["members"], dim)
                    tree = block_tree(postings["ref_id"].to_numpy(), codes, len(rows))
                    held = block
                queries = pa.table([rows.field(c) for c in names], names=names)
                cluster = pa.array(np.full(len(rows), block[0], dtype=np.int32))
                queries = queries.append_column("cluster_id", cluster)
                query_codes = to_matrix(queries["codes"], dim)
                found = _candidates(queries, query_codes, postings, tree, k, skip_self, kept)
                if kept:
                    found = found.append_column("block", pa.array(np.full(len(found), block[1], dtype=np.int32)))
                yield from found.to_batches()

    schema = CANDIDATE_SCHEMA
    if kept is not None:
        probe = pairs.schema["asked"].dataType.elementType
        schema = T.StructType([probe["query_id"], *[probe[name] for name in kept], T.StructField("near", NEAR_TYPE)])
        if kept:
            schema = schema.add("block", T.IntegerType())
    return pairs.select("cluster_id", "block", "asked", "members").mapInArrow(scan, schema)


def block_boxes(stored: StoredBlocks, dim: int, leaf_rows: int) -> DataFrame:
    """Boxes around near members of a block, ``leaf_rows`` of them at most: cluster_id, least, largest."""
    ship_package(stored.blocks.sparkSession)
    codes = T.ArrayType(T.DoubleType())
    schema = T.StructType(
        [T.StructField("cluster_id", T.IntegerType()), T.StructField("least", codes), T.StructField("largest", codes)]
    )

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                postings, found = _members(batch["members"].slice(row, 1), dim)
                tree = ReferenceTree(postings["ref_id"].to_numpy(), found, leaf_rows)
                cluster = np.full(len(tree.least), batch["cluster_id"][row].as_py(), dtype=np.int32)
                ends = [pa.array(list(end), pa.list_(pa.float64())) for end in (tree.least, tree.largest)]
                yield pa.RecordBatch.from_arrays([pa.array(cluster), *ends], names=schema.names)

    return stored.blocks.select("cluster_id", "members").mapInArrow(boxes, schema)


def in_blocks(postings: DataFrame, layout: DataFrame, partitions: int | None = None) -> DataFrame:
    """Postings as one row a block: cluster_id, block, members.

    ``layout`` holds the number of blocks of each cluster (at most MAX_CLUSTERS rows).
    """
    keys = ["cluster_id", "block"]
    dealt = postings.join(F.broadcast(layout), "cluster_id").withColumn(
        "block", F.pmod(F.xxhash64("ref_id"), F.col("blocks")).cast("int")
    )
    placed = dealt.repartition(partitions, *keys) if partitions else dealt.repartition(*keys)
    member = F.struct("ref_id", F.col("codes").cast("array<smallint>").alias("codes"), "fraud")
    return placed.groupBy(*keys).agg(F.sort_array(F.collect_list(member)).alias("members"))


def fits_in_memory(
    asked: DataFrame, dim: int, probes: int, limit: int | None = None
) -> pa.Table | None:
    """``asked`` (query_id, codes, probes) as one table; None if larger than ``limit`` bytes.

    No row is wider than its ids, codes and probes, so no more rows are fetched than fit.
    """
    limit = MEMORY_BYTES if limit is None else limit
    rows = limit // (8 + 2 * dim + 4 * probes)
    held = asked.limit(rows + 1).toArrow()
    return held if held.num_rows <= rows else None


def _nearest_rows(query: np.ndarray, other: np.ndarray, dist: np.ndarray, ref: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` least (dist, ref) of each query, of its fast clusters and others apart."""
    order = np.lexsort((ref, dist, other, query))
    group = query[order] * 2 + other[order]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    rank = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
    return order[rank < k]


def one_pass_scan(
    held: pa.Table,
    stored: StoredBlocks,
    dim: int = DIM,
    fast: int = 0,
    k: int = NEIGHBOURS,
    skip_self: bool = False,
) -> DataFrame:
    """Stream the blocks of all probed clusters past a small set of queries, once.

    ``held`` holds query_id, codes and probes, best first.  A task keeps the ``k`` nearest of
    each query in its first ``fast`` clusters and in its others apart, and leaves them as one
    row a query: query_id, near (dist, ref_id, fraud, probe_rank).  What a query has reached
    bounds what later blocks are searched for.
    """
    spark = stored.blocks.sparkSession
    ship_package(spark)
    clusters = pc.unique(pc.list_flatten(held["probes"])).to_pylist()
    table = share(spark, held.combine_chunks())
    near = T.ArrayType(
        T.StructType(
            [
                T.StructField("dist", T.LongType()),
                T.StructField("ref_id", T.LongType()),
                T.StructField("fraud", T.IntegerType()),
                T.StructField("probe_rank", T.IntegerType()),
            ]
        )
    )
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("near", near)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = table.value
        ids = wanted["query_id"].to_numpy()
        codes = to_matrix(wanted["codes"], dim)
        lists = wanted["probes"].combine_chunks()
        probed = lists.flatten().to_numpy()
        lengths = np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(len(ids)), lengths)
        rank = np.arange(len(probed)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
        by_cluster = np.argsort(probed, kind="stable")
        probed, owner, rank = probed[by_cluster], owner[by_cluster], rank[by_cluster]
        # query, other (a later cluster), dist, ref_id, fraud, probe_rank
        kept = [np.empty(0, dtype=np.int64) for _ in range(6)]
        fresh: list[tuple[np.ndarray, ...]] = []
        bounds = np.full((len(ids), 2), np.iinfo(np.int64).max >> 8)

        def cut() -> None:
            nonlocal kept
            kept = [np.concatenate(columns) for columns in zip(kept, *fresh, strict=True)]
            fresh.clear()
            nearest = _nearest_rows(*kept[:4], k)
            kept = [column[nearest] for column in kept]
            query, other, dist = kept[:3]
            slot = query * 2 + other
            full = np.flatnonzero(np.bincount(slot, minlength=2 * len(ids)) == k)
            last = np.zeros(2 * len(ids), dtype=np.int64)
            np.maximum.at(last, slot, dist)
            bounds.reshape(-1)[full] = last[full]
            # Both sets count for the full vote, so what the fast one reached bounds the other.
            bounds[:, 1] = bounds.min(axis=1)

        for batch in batches:
            for row in range(batch.num_rows):
                cluster = batch["cluster_id"][row].as_py()
                lo, hi = np.searchsorted(probed, [cluster, cluster + 1])
                if lo == hi:
                    continue
                postings, posting_codes = _members(batch["members"].slice(row, 1), dim)
                mine, other = owner[lo:hi], (rank[lo:hi] > fast).astype(np.int64)
                found, refs, dist = nearest_in_block(
                    ids[mine], codes[mine], postings["ref_id"].to_numpy(), posting_codes, k,
                    skip_self, bounds[mine, other],
                )
                fresh.append(
                    (
                        mine[found], other[found], dist, postings["ref_id"].to_numpy()[refs],
                        postings["fraud"].to_numpy()[refs].astype(np.int64), rank[lo:hi][found],
                    )
                )
            if sum(len(columns[0]) for columns in fresh) > HELD_CANDIDATES:
                cut()
        if fresh:
            cut()
        query, _, dist, ref, fraud, place = kept
        if not len(query):
            return
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        structs = pa.StructArray.from_arrays(
            [pa.array(dist), pa.array(ref), pa.array(fraud.astype(np.int32)), pa.array(place.astype(np.int32))],
            names=["dist", "ref_id", "fraud", "probe_rank"],
        )
        offsets = pa.array(np.r_[starts, len(query)].astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[query[starts]]), pa.ListArray.from_arrays(offsets, structs)],
            names=["query_id", "near"],
        )

    return stored.of_clusters(clusters).select("cluster_id", "members").mapInArrow(scan, schema)


def scan_probes(
    probes: DataFrame,
    postings: DataFrame,
    dim: int = DIM,
    k: int = NEIGHBOURS,
    skip_self: bool = False,
    small_queries: bool = False,
    stored: StoredBlocks | None = None,
) -> DataFrame:
    """Candidates for each probe: ``k`` per block of the probed cluster.

    Where ``probes`` carry a ``bound``, a distance their query has already
    reached k times, farther candidates are dropped where they are found.

    Stored postings stay in their buckets and probes move; postings that are not
    stored are moved along.  ``small_queries`` asks to broadcast the probes to stored
    postings, which is done only while they fit in memory.
    """
    if stored is None:
        return shuffled_scan(probes, postings, dim, k, skip_self)
    if small_queries:
        lists = probes.groupBy("query_id", "codes").agg(
            F.sort_array(F.collect_list(F.struct("probe_rank", "cluster_id"))).alias("_p")
        )
        asked = lists.select("query_id", "codes", F.col("_p.cluster_id").alias("probes"))
        held = fits_in_memory(asked, dim, MAX_PROBES)
        if held is not None:
            found = one_pass_scan(held, stored, dim, MAX_PROBES, k, skip_self)
            return found.select("query_id", F.inline("near"))
    return stored_scan(probes, stored, dim, k, skip_self)
