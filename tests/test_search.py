import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import collected, neighbours
from quintavote.config import BuildParams, ProbeParams
from quintavote.operators.clustering import CentroidTable, nearest_centroid, sampled_seeds
from quintavote.operators.knn import knn_exact
from quintavote.operators.probing import probe_rows, with_probes
from quintavote.operators import knn, scan
from quintavote.operators.scan import scan_probes, shuffled_scan, stored_scan
from quintavote.operators.topk import (
    borderline,
    decide,
    fraud_vote,
    leading_lists,
    listed_candidates,
    merged_lists,
    topk_merge,
    topk_neighbors,
)
from quintavote.operators.vectorize import with_query_codes, with_reference_codes
from quintavote.plans import ivf
from quintavote.sources import index_store
from quintavote.staging import fresh_path, materialize

QUERY_SCHEMA = "query_id bigint, vector array<double>"
REF_SCHEMA = "ref_id bigint, vector array<double>, fraud int"


def make(spark, queries=60, refs=400, copies=0, seed=1):
    """Random vectors on a coarse grid; ``copies`` references are one vector."""
    rng = np.random.default_rng(seed)
    ref_values = np.round(rng.random((refs, 14)), 2)
    ref_values[:copies] = ref_values[0]
    query_values = np.round(rng.random((queries, 14)), 2)
    query_values[: queries // 3] = ref_values[0]  # a third of the queries are alike
    fraud = rng.integers(0, 2, refs)
    q = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(query_values)], QUERY_SCHEMA
    )
    r = spark.createDataFrame(
        [(i, [float(x) for x in v], int(f)) for i, (v, f) in enumerate(zip(ref_values, fraud))],
        REF_SCHEMA,
    )
    queries_df = materialize(with_query_codes(q), "q")
    refs_df = materialize(with_reference_codes(r), "r")
    wanted = neighbours(
        [(row["query_id"], row["codes"]) for row in queries_df.collect()],
        [(row["ref_id"], row["codes"], row["fraud"]) for row in refs_df.collect()],
    )
    return queries_df, refs_df, wanted


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the references are copies, a third of the queries meet them."""
    return make(spark, copies=140)


@pytest.fixture(scope="module")
def hot_index(spark, hot):
    _, refs, _ = hot
    seeds = materialize(sampled_seeds(refs, "ref_id", 12, 1), "seeds")
    return ivf.IvfIndex(seeds, materialize(ivf.assign_postings(refs, seeds), "postings"))


def test_exact_search_on_hot_data(hot):
    queries, refs, wanted = hot
    assert collected(knn_exact(queries, refs, cells=16)) == wanted


def test_no_references_no_neighbours(hot):
    queries, refs, _ = hot
    assert knn_exact(queries, refs.limit(0)).count() == 0


@pytest.mark.parametrize("cells", [1, 3, 60])
def test_exact_search_does_not_depend_on_cells(hot, cells):
    queries, refs, wanted = hot
    assert collected(knn_exact(queries, refs, cells=cells)) == wanted


def test_exact_search_in_small_blocks(hot, monkeypatch):
    """Cells of many blocks, among them one with a third of all references."""
    queries, refs, wanted = hot
    monkeypatch.setattr(knn, "BLOCK_ROWS", 9)
    assert collected(knn_exact(queries, refs, cells=5)) == wanted


def test_rows_of_the_exact_search_follow_batches(hot):
    """Queries reach cells in packs, and less than all cells are reached."""
    queries, refs, _ = hot
    table = CentroidTable.load(sampled_seeds(refs, "ref_id", 40, 1))
    postings = materialize(nearest_centroid(refs, table), "postings")
    bounds = knn.cell_bounds(postings, table)
    near = with_probes(queries, table, 2).withColumn("bound", F.lit(400 * 400).cast("long"))
    packs = knn._reached(near.coalesce(1), bounds, 14).collect()
    reached = {(r["query_id"], p["cluster_id"]) for p in packs for r in p["asked"]}
    assert len(packs) <= 40 < len(reached) < 60 * 38
    # Every member within the bound lies in a cell that was probed or is reached.
    probed = {(r["query_id"], c) for r in near.collect() for c in r["probes"]}
    members = postings.select("cluster_id", "codes").collect()
    for q in queries.collect():
        for m in members:
            if sum((a - b) ** 2 for a, b in zip(q["codes"], m["codes"])) <= 400 * 400:
                assert (q["query_id"], m["cluster_id"]) in probed | reached


def test_queries_move_once_a_tile(hot):
    """Cells that lie together are asked in one go, whichever of them a query reaches."""
    queries, refs, _ = hot
    table = CentroidTable.load(sampled_seeds(refs, "ref_id", 40, 1))
    bounds = knn.cell_bounds(materialize(nearest_centroid(refs, table), "postings"), table)
    tiles = knn.Tiles.of(table.ids, table.matrix, np.full(40, 10), 100)
    assert len(set(tiles.tile)) == 4 and (tiles.blocks == 1).all()
    near = with_probes(queries, table, 2).withColumn("bound", F.lit(1 << 50))
    packs = knn._reached(near.coalesce(1), bounds, 14, tiles).collect()
    asked = [(p["cluster_id"], r) for p in packs for r in p["asked"]]
    reached = {(r["query_id"], tile, place) for tile, r in asked
               for place in np.flatnonzero(np.unpackbits(np.frombuffer(r["wanted"], np.uint8), bitorder="little"))}
    assert len(asked) == 4 * 60
    alone = {(r["query_id"], p["cluster_id"]) for p in knn._reached(near, bounds, 14).collect() for r in p["asked"]}
    cell = {(t, p): i for i, t, p in zip(table.ids, tiles.tile, tiles.place)}
    assert {(q, cell[t, p]) for q, t, p in reached} == alone and len(alone) > 60 * 20


def test_large_cells_and_empty_ones_have_tiles():
    tiles = knn.Tiles.of(np.arange(4, dtype=np.int32), np.arange(8.0).reshape(4, 2), np.array([0, 25, 0, 9]), 10)
    assert tiles.blocks.tolist() == [1, 3, 1, 1]
    assert tiles.tile[1] == 1 and (np.delete(tiles.tile, 1) != 1).all()


@pytest.mark.parametrize("copies", [1, 7])
def test_exact_search_of_tiles_in_copies(hot, monkeypatch, copies):
    """Tiles of several cells with boxes, whose copies take a few queries each."""
    queries, refs, wanted = hot
    monkeypatch.setattr(knn, "BLOCK_ROWS", 100)
    monkeypatch.setattr(knn, "_BOX_ROWS", 5)
    monkeypatch.setattr(knn, "_COPY_QUERIES", 60 // copies)
    monkeypatch.setattr(knn, "_LEAST_COPY_QUERIES", 1)
    monkeypatch.setattr(knn, "_PLANNED_QUERIES", 20)
    monkeypatch.setattr(knn, "_FEW_CELLS", 0)
    assert collected(knn_exact(queries, refs, cells=20)) == wanted


def test_only_leading_lists_are_put_together(spark):
    """Of many lists of a query no more than k are held, and the nearest come out."""
    rng = np.random.default_rng(3)
    rows = [
        (q, sorted((int(d), int(r), 0) for d, r in rng.integers(0, 50, (rng.integers(0, 6), 2))))
        for q in range(5) for _ in range(40)
    ]
    lists = spark.createDataFrame(rows, "query_id bigint, near array<struct<dist: bigint, ref_id: bigint, fraud: int>>")
    few = leading_lists(lists)
    assert few.groupBy("query_id").count().agg(F.max("count")).first()[0] == 5
    assert sorted(merged_lists(few).collect()) == sorted(merged_lists(lists).collect())


def test_exact_search_skipping_itself(spark):
    _, refs, _ = make(spark, refs=150, seed=4)
    queries = refs.select(F.col("ref_id").alias("query_id"), "vector", "codes")
    rows = refs.collect()
    wanted = neighbours(
        [(r["ref_id"], r["codes"]) for r in rows],
        [(r["ref_id"], r["codes"], r["fraud"]) for r in rows],
        skip_self=True,
    )
    assert collected(knn_exact(queries, refs, skip_self=True, cells=8)) == wanted


def test_exact_search_with_few_references(spark):
    queries, refs, wanted = make(spark, queries=9, refs=3)
    found = knn_exact(queries, refs, cells=16)
    assert collected(found) == wanted
    assert all(len(v) == 3 for v in wanted.values())


def test_small_blocks_on_both_sides_give_the_same_neighbours(hot, hot_index):
    queries, _, wanted = hot
    table = CentroidTable.load(hot_index.centroids)
    probes = materialize(
        probe_rows(with_probes(queries, table, table.size), 1, table.size), "probes"
    )
    found = shuffled_scan(probes, hot_index.postings, reference_block=17, query_block=5)
    assert collected(topk_neighbors(found)) == wanted


def test_blocks_stay_within_their_size(hot, hot_index):
    """No block pair returns more than k rows per query, whatever the cluster holds."""
    queries, _, _ = hot
    table = CentroidTable.load(hot_index.centroids)
    probes = materialize(probe_rows(with_probes(queries, table, 1), 1, 1), "probes")
    found = shuffled_scan(probes, hot_index.postings, reference_block=1_000, query_block=1_000)
    most = found.groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert most <= 5


@pytest.fixture(scope="module")
def stored_index(spark, hot_index):
    """The same index in small blocks, a hot cluster in several, over three shelves."""
    path = fresh_path(spark, "index")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(index_store, "BLOCK_ROWS", 50)
        patch.setattr(index_store, "SHELF_ROWS", 140)
        index_store.write_index(hot_index, path)
    index = index_store.read_index(spark, path)
    assert index.stored.layout.agg(F.max("blocks")).first()[0] > 2
    assert index.stored.blocks.select("shelf").distinct().count() >= 2
    return index


def test_stored_and_shuffled_scans_agree(hot, hot_index, stored_index):
    queries, _, wanted = hot
    table = hot_index.table
    probes = materialize(probe_rows(with_probes(queries, table, 3), 1, 3), "probes")
    shuffled = collected(topk_neighbors(shuffled_scan(probes, hot_index.postings)))
    assert collected(topk_neighbors(stored_scan(probes, stored_index.stored))) == shuffled
    # Small query blocks; then clusters asked for by many of them, whose postings are copied.
    few = stored_scan(probes, stored_index.stored, query_block=4)
    assert collected(topk_neighbors(few)) == shuffled
    many = stored_scan(probes, stored_index.stored, query_block=4, held_blocks=2)
    assert collected(topk_neighbors(many)) == shuffled
    small = scan_probes(probes, stored_index.postings, small_queries=True, stored=stored_index.stored)
    assert collected(topk_neighbors(small)) == shuffled


def test_stored_postings_are_not_moved(hot, stored_index):
    """Postings are read from their buckets, from the probed shelves alone; probes move."""
    queries, _, _ = hot
    one = queries.filter("query_id = 0")
    probes = materialize(probe_rows(with_probes(one, stored_index.table, 1), 1, 1), "probes")
    found = stored_scan(probes, stored_index.stored)
    found.collect()
    plan = physical(found).split("Initial Plan")[0]
    read = next(part for part in plan.split("\n") if "FileScan" in part and "members" in part)
    assert "Bucketed: true" in read and "PartitionFilters: [isnotnull(shelf" in read
    left, right = plan.split("SortMergeJoin")[1].split("FileScan", 1)[0], plan[: plan.index(read)]
    assert "Exchange hashpartitioning(cluster_id" in left  # the probes
    assert "Exchange" not in right[right.rindex("Sort [cluster_id"):]  # up from the scan to the join


def test_hot_posts_return_k_rows_a_block(hot, stored_index):
    queries, _, _ = hot
    probes = materialize(probe_rows(with_probes(queries, stored_index.table, 1), 1, 1), "probes")
    most = stored_scan(probes, stored_index.stored).groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert most <= 5 * stored_index.stored.layout.agg(F.max("blocks")).first()[0]


def test_one_pass_gives_both_votes(hot, stored_index, monkeypatch):
    queries, _, _ = hot
    for params in (ProbeParams(2, 6), ProbeParams(1, 12), ProbeParams(4, 4)):
        wanted = {tuple(r) for r in ivf.adaptive_votes(queries, stored_index, params).collect()}
        found = ivf.one_pass_votes(queries, stored_index, params)
        assert {tuple(r) for r in found.collect()} == wanted
        # Cut after every batch, so that bounds drop candidates.
        monkeypatch.setattr(scan, "HELD_CANDIDATES", 0)
        again = ivf.adaptive_votes(queries, stored_index, params, small_queries=True)
        assert {tuple(r) for r in again.collect()} == wanted


def test_too_many_queries_for_memory_take_the_other_plan(hot, stored_index, monkeypatch):
    queries, _, _ = hot
    params = ProbeParams(2, 6)
    wanted = {tuple(r) for r in ivf.adaptive_votes(queries, stored_index, params).collect()}
    monkeypatch.setattr(scan, "MEMORY_BYTES", 59 * (8 + 2 * 14 + 4 * 6))
    assert ivf.one_pass_votes(queries, stored_index, params) is None
    found = ivf.adaptive_votes(queries, stored_index, params, small_queries=True)
    assert {tuple(r) for r in found.collect()} == wanted
    monkeypatch.setattr(scan, "MEMORY_BYTES", 60 * (8 + 2 * 14 + 4 * 6))
    assert ivf.one_pass_votes(queries, stored_index, params) is not None


def test_scan_of_nothing(hot, hot_index, stored_index):
    queries, _, _ = hot
    table = CentroidTable.load(hot_index.centroids)
    none = probe_rows(with_probes(queries, table, 2), 1, 2).filter("query_id < 0")
    assert scan_probes(none, hot_index.postings).count() == 0
    stored = stored_index.stored
    assert scan_probes(none, hot_index.postings, stored=stored).count() == 0
    assert scan_probes(none, hot_index.postings, small_queries=True, stored=stored).count() == 0
    assert ivf.one_pass_votes(queries.filter("query_id < 0"), stored_index).count() == 0


def test_all_clusters_probed_equals_exact(hot, hot_index):
    queries, _, wanted = hot
    found = ivf.fast_neighbors(queries, hot_index, ProbeParams(12, 12))
    assert collected(found) == wanted


def test_equal_probe_counts_never_expand(hot, hot_index):
    queries, _, _ = hot
    votes = ivf.adaptive_votes(queries, hot_index, ProbeParams(4, 4))
    assert votes.filter("expanded").count() == 0
    fast = {r["query_id"]: r["votes"] for r in ivf.fast_votes(
        queries, hot_index, params=ProbeParams(4, 4)).collect()}
    assert {r["query_id"]: r["votes"] for r in votes.collect()} == fast


@pytest.mark.parametrize("stored, small", [(False, False), (True, False), (True, True)])
def test_adaptive_search_step_by_step(hot, hot_index, stored_index, stored, small):
    queries, _, _ = hot
    params = ProbeParams(2, 6)
    table = CentroidTable.load(hot_index.centroids)
    probes = {
        r["query_id"]: r["probes"]
        for r in with_probes(queries, table, 6).select("query_id", "probes").collect()
    }
    lists = {}
    for row in hot_index.postings.collect():
        lists.setdefault(row["cluster_id"], []).append((row["ref_id"], row["codes"], row["fraud"]))

    def vote(query, n):
        members = [m for c in probes[query["query_id"]][:n] for m in lists.get(c, [])]
        near = neighbours([(query["query_id"], query["codes"])], members)[query["query_id"]]
        return sum(f for _, _, f in near)

    wanted = {}
    for query in queries.collect():
        fast = vote(query, 2)
        wanted[query["query_id"]] = (vote(query, 6) if fast in (2, 3) else fast, fast, fast in (2, 3))
    index = stored_index if stored else hot_index
    found = ivf.adaptive_votes(queries, index, params, small_queries=small).collect()
    assert {r["query_id"]: (r["votes"], r["fast_votes"], r["expanded"]) for r in found} == wanted


def test_merge_does_not_depend_on_order_or_split(spark):
    rng = np.random.default_rng(2)
    rows = [(q, int(r), int(rng.integers(0, 20)), 1) for q in range(5) for r in range(30)]
    df = spark.createDataFrame(rows, "query_id bigint, ref_id bigint, dist bigint, fraud int")
    whole = collected(topk_neighbors(df))
    odd, even = df.filter("ref_id % 2 = 1"), df.filter("ref_id % 2 = 0")
    assert collected(topk_merge(topk_neighbors(odd), even)) == whole
    assert collected(topk_merge(topk_neighbors(even), odd)) == whole


def test_vote_with_missing_neighbours(spark):
    queries = spark.range(3).withColumnRenamed("id", "query_id")
    found = spark.createDataFrame(
        [(0, 1), (0, 1), (0, 1), (1, 0), (1, 1)], "query_id bigint, fraud int"
    )
    rows = {r["query_id"]: r for r in decide(fraud_vote(queries, found)).collect()}
    assert (rows[0]["votes"], rows[0]["fraud_score"], rows[0]["approved"]) == (3, 0.6, False)
    assert (rows[1]["votes"], rows[1]["fraud_score"], rows[1]["approved"]) == (1, 0.2, True)
    assert (rows[2]["votes"], rows[2]["fraud_score"], rows[2]["approved"]) == (0, 0.0, True)


def test_borderline_is_two_or_three(spark):
    votes = spark.range(6).select(F.col("id").alias("query_id"), F.col("id").cast("int").alias("votes"))
    assert sorted(r["votes"] for r in borderline(votes).collect()) == [2, 3]


def test_collapsed_copies_do_not_change_votes(hot):
    queries, refs, _ = hot
    source = refs.select("ref_id", "vector", "fraud")
    params = BuildParams(clusters=10, train_rows=200)
    full = ivf.build_index(source, params)
    short = ivf.build_index(source, params, collapse_copies=True)
    assert full.postings.count() == 400 and short.postings.count() <= 400 - 140 + 6
    wanted = collected(ivf.fast_neighbors(queries, full, ProbeParams(3, 3)))
    assert collected(ivf.fast_neighbors(queries, short, ProbeParams(3, 3))) == wanted


def test_built_index_holds_every_reference_once(spark, hot):
    _, refs, _ = hot
    index = ivf.build_index(
        refs.select("ref_id", "vector", "fraud"), BuildParams(clusters=10, train_rows=200)
    )
    postings = index.postings
    assert postings.count() == 400
    assert postings.select("ref_id").distinct().count() == 400
    again = nearest_centroid(
        refs.select("ref_id", "vector"), CentroidTable.load(index.centroids)
    ).select("ref_id", "cluster_id")
    assert postings.select("ref_id", "cluster_id").exceptAll(again).count() == 0


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_limit_before_the_exchange_and_never_cross(hot, hot_index):
    queries, refs, _ = hot
    fast = physical(ivf.fast_neighbors(queries, hot_index, ProbeParams(3, 3)))
    adaptive = physical(ivf.adaptive_votes(queries, hot_index, ProbeParams(3, 6)))
    exact = physical(knn_exact(queries, refs, cells=8))
    for plan in (fast, adaptive, exact):
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
        assert ("MapInArrow" if plan is exact else "FlatMapCoGroupsInArrow") in plan
        assert plan.count("WindowGroupLimit") >= 2  # partial and final


def test_ranking_needs_no_exchange(hot, hot_index):
    queries, _, _ = hot
    plan = physical(with_probes(queries, hot_index.table, 4))
    assert "Exchange" not in plan and "ArrowEvalPython" in plan


def test_lists_equal_the_scan_of_all_probes(spark, hot, hot_index, monkeypatch):
    """Clusters of several blocks, and a nearest cluster without members."""
    queries, refs, _ = hot
    monkeypatch.setattr(index_store, "BLOCK_ROWS", 20)
    emptied = hot_index.postings.where("cluster_id % 3 > 0")
    path = fresh_path(spark, "index")
    index_store.write_index(ivf.IvfIndex(hot_index.centroids, emptied), path)
    index = index_store.read_index(spark, path)
    ranked = ivf._ranked(queries, index, 5)
    every = topk_neighbors(stored_scan(probe_rows(ranked, 1, 5), index.stored, skip_self=True))
    lists = listed_candidates(ivf.nearest_lists(ranked, index, 5, skip_self=True))
    assert collected(lists) == collected(every)
    empty = ranked.where("probes[0] % 3 = 0").count()
    assert empty and index.stored.layout.agg(F.max("blocks")).first()[0] > 1


def test_a_landed_fast_pass_is_searched_once(hot, stored_index, hot_index, monkeypatch):
    """Fast and adaptive votes of one pass are those of a pass each, also where ids repeat."""
    queries, _, _ = hot
    twice = materialize(queries.unionByName(queries.where("query_id % 4 = 0")), "twice")
    params = ProbeParams(2, 9)
    for index in (stored_index, hot_index):
        wanted = sorted(ivf.adaptive_votes(twice, index, params, skip_self=True).collect())
        fast = sorted(ivf.fast_votes(twice, index, params=params, skip_self=True).collect())
        passed = materialize(ivf.fast_pass(twice, index, params, skip_self=True), "passed")
        with monkeypatch.context() as patch:
            patch.setattr(ivf, "nearest_lists", None)
            patch.setattr(ivf, "_nearest", None)
            found = ivf.adaptive_votes(twice, index, params, skip_self=True, passed=passed)
            assert sorted(found.collect()) == wanted and len(fast) == 75
            assert sorted(ivf.fast_votes(twice, index, passed, params=params, skip_self=True).collect()) == fast
