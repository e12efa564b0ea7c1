"""Top-k per query, the vote and the decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quintavote.config import NEIGHBOURS
from quintavote.functions import scores

# Beyond any distance between sixteen-bit codes.
UNBOUNDED = 1 << 50

CANDIDATE_COLUMNS = ("query_id", "ref_id", "dist", "fraud")


def topk_neighbors(candidates: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """The ``k`` nearest candidates per query, ties broken by the lower ref id.

    Spark turns the rank filter into a limit before and after the exchange.
    """
    order = Window.partitionBy("query_id").orderBy("dist", "ref_id")
    ranked = candidates.select(
        *CANDIDATE_COLUMNS, F.row_number().over(order).alias("rank")
    )
    return ranked.filter(F.col("rank") <= k)


def nearest_copies(references: DataFrame, copies: int, *within: str) -> DataFrame:
    """Of references with equal codes (and ``within``), the ``copies`` of lowest id.

    Copies are equally far from every query and ties go to the lower id, so no
    other copy can be among that many neighbours.  A vector that fills a third
    of the table shrinks to a handful of rows in each task before the exchange.
    """
    order = Window.partitionBy(*within, "codes").orderBy("ref_id")
    ranked = references.withColumn("_copy", F.row_number().over(order))
    return ranked.filter(F.col("_copy") <= copies).drop("_copy")


def topk_merge(carried: DataFrame, extra: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """Continue a carried top-k with more candidates."""
    both = carried.select(*CANDIDATE_COLUMNS).unionByName(extra.select(*CANDIDATE_COLUMNS))
    return topk_neighbors(both, k)


def with_neighbours(
    queries: DataFrame, neighbours: DataFrame, k: int = NEIGHBOURS
) -> DataFrame:
    """Add each query's neighbours as one array, with its votes and its bound.

    ``near`` holds at most ``k`` (dist, ref_id, fraud).  A slot that found no
    neighbour counts as legitimate.  ``bound`` is the distance of the k-th
    neighbour; a query short of ``k`` is unbounded.
    """
    grouped = neighbours.groupBy("query_id").agg(
        F.collect_list(F.struct("dist", "ref_id", "fraud")).alias("near"),
        F.sum("fraud").alias("_votes"),
        F.when(F.count("*") >= k, F.max("dist")).alias("_bound"),
    )
    return queries.join(grouped, "query_id", "left").select(
        *queries.columns,
        "near",
        F.coalesce("_votes", F.lit(0)).cast("int").alias("votes"),
        F.coalesce("_bound", F.lit(UNBOUNDED)).alias("bound"),
    )


def merged_lists(lists: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """One list ``near`` of the ``k`` nearest a query, from several (dist, ref_id, fraud)."""
    every = F.sort_array(F.flatten(F.collect_list("near")))
    return lists.groupBy("query_id").agg(F.slice(every, 1, k).alias("near"))


def leading_lists(lists: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """Of the sorted lists ``near`` of a query, the ``k`` that begin nearest.

    Any other list begins beyond ``k`` candidates, so none of it is wanted.  However many lists a query
    has, no more are put together; the limit holds before and after the exchange.
    """
    head = F.col("near")[0]
    order = Window.partitionBy("query_id").orderBy(head["dist"], head["ref_id"])
    some = lists.where(F.size("near") > 0).withColumn("_list", F.row_number().over(order))
    return some.filter(F.col("_list") <= k).drop("_list")


def listed_candidates(lists: DataFrame) -> DataFrame:
    """Sorted lists ``near`` as ranked neighbours."""
    rows = lists.select("query_id", F.posexplode("near"))
    return rows.select(
        "query_id", "col.ref_id", "col.dist", "col.fraud", (F.col("pos") + 1).alias("rank")
    )


def with_lists(queries: DataFrame, lists: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """``with_neighbours`` of sorted lists, one a query."""
    votes = F.aggregate("near", F.lit(0), lambda n, x: n + F.coalesce(x["fraud"], F.lit(0)))
    return queries.join(lists, "query_id", "left").select(
        *queries.columns,
        "near",
        F.coalesce(votes, F.lit(0)).cast("int").alias("votes"),
        list_bound("near", k).alias("bound"),
    )


def list_bound(near: str, k: int = NEIGHBOURS) -> Column:
    """Distance of the last of ``k`` neighbours in a sorted list; a shorter list bounds nothing."""
    return F.coalesce(F.when(F.size(near) >= k, F.element_at(near, k)["dist"]), F.lit(UNBOUNDED))


def carried_candidates(queries: DataFrame) -> DataFrame:
    """The ``near`` arrays as candidate rows again."""
    return queries.select("query_id", F.inline("near")).select(*CANDIDATE_COLUMNS)


def fraud_vote(queries: DataFrame, neighbours: DataFrame) -> DataFrame:
    """``votes`` per query; a slot that found no neighbour counts as legitimate."""
    counts = neighbours.groupBy("query_id").agg(F.sum("fraud").alias("_votes"))
    votes = F.coalesce(F.col("_votes"), F.lit(0)).cast("int")
    return (
        queries.select("query_id")
        .join(counts, "query_id", "left")
        .select("query_id", votes.alias("votes"))
    )


def borderline(votes: DataFrame) -> DataFrame:
    return votes.filter(scores.is_borderline(F.col("votes")))


def decide(votes: DataFrame) -> DataFrame:
    count = F.col("votes")
    return votes.select(
        "query_id",
        "votes",
        scores.fraud_score(count).alias("fraud_score"),
        scores.approved(count).alias("approved"),
    )
