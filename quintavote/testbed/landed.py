"""Tables shared by the registered queries, landed once per application.

A pipeline lands its vectors and its index as tables and then runs many jobs
over them; so do the queries.  The key holds the source files' names, sizes and
times, so changed input is landed again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quintavote.config import ProbeParams
from quintavote.operators.clustering import lloyd_step, sampled_seeds
from quintavote.operators.knn import knn_exact
from quintavote.plans.ivf import IvfIndex, adaptive_votes, assign_postings, fast_pass, fast_votes
from quintavote.sources.index_store import read_index, write_index
from quintavote.staging import fresh_path, materialize
from quintavote.testbed import transactions as tx

# Settings of the registered index: seeds by hash order and one mean step, so
# that plain SQL can replay the build.
CLUSTERS = 128
SEED = 7
# Clusters of the registered training.
FITTED = 64
PROBES = ProbeParams(fast=8, full=28)

_tables: dict[tuple, DataFrame] = {}
_indexes: dict[str, IvfIndex] = {}


def _fingerprint(spark: SparkSession, sf_dir: str, table: str) -> tuple:
    """One entry per file of the source table."""
    files = (
        spark.read.parquet(f"{sf_dir}/{table}.parquet")
        .select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
        .distinct()
        .agg(F.count("*"), F.sum("file_size"), F.max("file_modification_time"))
    )
    return tuple(files.first())


def _landed(
    spark: SparkSession, sf_dir: str, name: str, source: str, build: Callable[[], DataFrame]
) -> DataFrame:
    key = _key(spark, sf_dir, name, source)
    if key not in _tables:
        _tables[key] = materialize(build(), name)
    return _tables[key]


def _key(spark: SparkSession, sf_dir: str, name: str, source: str) -> tuple:
    return (spark.sparkContext.applicationId, sf_dir, name, _fingerprint(spark, sf_dir, source))


def _is_landed(spark: SparkSession, sf_dir: str, name: str, source: str) -> bool:
    return _key(spark, sf_dir, name, source) in _tables


def forget() -> None:
    """Let the next query land everything anew."""
    _tables.clear()
    _indexes.clear()


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landed(
        spark, sf_dir, "transactions", "events", lambda: tx.transactions(spark, sf_dir)
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, fraud, vector, codes of every event."""
    return _landed(
        spark, sf_dir, "vectors", "events", lambda: tx.vectors(transactions(spark, sf_dir))
    )


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref_id, vector, codes, fraud of every event."""
    return _landed(
        spark, sf_dir, "references", "events", lambda: tx.references(queries(spark, sf_dir))
    )


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landed(
        spark,
        sf_dir,
        "seeds",
        "events",
        lambda: sampled_seeds(references(spark, sf_dir), "ref_id", CLUSTERS, SEED),
    )


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landed(
        spark,
        sf_dir,
        "centroids",
        "events",
        lambda: lloyd_step(references(spark, sf_dir), seeds(spark, sf_dir)),
    )


def index(spark: SparkSession, sf_dir: str) -> IvfIndex:
    center = centroids(spark, sf_dir)
    postings = _landed(
        spark,
        sf_dir,
        "postings",
        "events",
        lambda: assign_postings(references(spark, sf_dir), center),
    )
    # One stored and opened index per landed table, as it keeps the centroid matrix.
    location = min(postings.inputFiles())
    if location not in _indexes:
        path = fresh_path(spark, "index")
        write_index(IvfIndex(center, postings), path)
        _indexes[location] = read_index(spark, path)
    return _indexes[location]


def passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fast pass of every event among the other events, which adaptive votes go on from."""
    return _landed(
        spark,
        sf_dir,
        "passed",
        "events",
        lambda: fast_pass(
            queries(spark, sf_dir), index(spark, sf_dir), PROBES, skip_self=True
        ),
    )


def fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fast votes of every event among the other events, of a landed pass where there is one."""
    return _landed(
        spark,
        sf_dir,
        "fast",
        "events",
        lambda: fast_votes(
            queries(spark, sf_dir),
            index(spark, sf_dir),
            passed(spark, sf_dir) if _is_landed(spark, sf_dir, "passed", "events") else None,
            params=PROBES,
            skip_self=True,
        ),
    )


def adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive votes of every event among the other events."""
    return _landed(
        spark,
        sf_dir,
        "adaptive",
        "events",
        lambda: adaptive_votes(
            queries(spark, sf_dir),
            index(spark, sf_dir),
            PROBES,
            skip_self=True,
            passed=passed(spark, sf_dir),
        ),
    )


def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact five nearest other events of every event."""
    return _landed(
        spark,
        sf_dir,
        "exact",
        "events",
        lambda: knn_exact(queries(spark, sf_dir), references(spark, sf_dir), skip_self=True),
    )
