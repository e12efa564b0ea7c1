"""Persisting the index as a bucketed table of blocks with a header row."""

from __future__ import annotations

import uuid

import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quintavote.config import DIM, MAX_CLUSTERS, SCALE
from quintavote.operators.clustering import CENTROID_SCHEMA, cluster_profile
from quintavote.operators.scan import StoredBlocks, in_blocks
from quintavote.plans.ivf import IvfIndex
from quintavote.staging import delete_folder

FORMAT = "quintavote-ivf"
VERSION = 3

# Rows a shelf should hold on average, a block at most on average, and a bucket.
SHELF_ROWS = 64_000_000
BLOCK_ROWS = 131_072
BUCKET_ROWS = 1_000_000
MAX_BUCKETS = 4_096
# Buckets a core should have, if they keep this many rows: clusters are asked for unevenly, and a
# bucket is one task of a search.
BUCKETS_A_CORE = 4
LEAST_BUCKET_ROWS = 25_000

HEADER_SCHEMA = T.StructType(
    [
        T.StructField("format", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("dim", T.IntegerType()),
        T.StructField("k", T.IntegerType()),
        T.StructField("scale", T.IntegerType()),
        T.StructField("shelf_clusters", T.IntegerType()),
        T.StructField("buckets", T.IntegerType()),
        T.StructField("generation", T.LongType()),
        T.StructField("build", T.StringType()),
    ]
)
BLOCK_SCHEMA = (
    "cluster_id INT, block INT,"
    " members ARRAY<STRUCT<ref_id: BIGINT, codes: ARRAY<SMALLINT>, fraud: INT>>, shelf INT"
)
# An index without least and largest codes is searched without them.
LAYOUT_SCHEMA = "cluster_id INT, blocks INT, least ARRAY<SMALLINT>, largest ARRAY<SMALLINT>"


class IndexFormatError(ValueError):
    """The files are not an index this version can search."""


def clusters_per_shelf(rows: int, clusters: int) -> int:
    """Clusters per shelf, so that a shelf of average clusters has SHELF_ROWS."""
    return max(1, min(clusters, clusters * SHELF_ROWS // max(rows, 1)))


def write_index(index: IvfIndex, path: str) -> None:
    """Write centroids, blocks of postings and header under ``path``.

    A block holds the postings of one cluster, or a share of those of a large one, as one row.
    Blocks lie in buckets by (cluster_id, block), where a join finds them without moving them,
    and in folders ("shelves") of neighbouring cluster ids, of which a search of few clusters
    reads few.

    A build has its own folder, and a header row appended last names it with the next
    generation: one that was cut short leaves the index that was there as it is.  The build it
    replaces stays for those who have it open; the ones before that are deleted.
    """
    spark = index.postings.sparkSession
    earlier = _headers(spark, path)
    build = f"build-{uuid.uuid4().hex}"
    index.centroids.select(*CENTROID_SCHEMA.names).write.parquet(f"{path}/{build}/centroids")
    profile = cluster_profile(index.postings, index.centroids).select(
        "cluster_id", "members", F.ceil(F.col("members") / F.lit(BLOCK_ROWS)).cast("int").alias("blocks")
    )
    # One row a cluster, bounded by MAX_CLUSTERS.
    sizes = profile.toArrow()
    rows, clusters = pc.sum(sizes["members"]).as_py() or 0, sizes.num_rows
    per_shelf = clusters_per_shelf(rows, clusters)
    buckets = spread_buckets(rows, spark.sparkContext.defaultParallelism)
    layout = spark.createDataFrame(sizes.select(["cluster_id", "blocks"]), "cluster_id int, blocks int").where("blocks > 0")
    layout.join(_boxes(index), "cluster_id", "left").coalesce(1).write.parquet(f"{path}/{build}/layout")

    (
        in_blocks(index.postings, layout, buckets)
        .withColumn("shelf", F.expr(f"cluster_id div {per_shelf}").cast("int"))
        .write.partitionBy("shelf")
        .bucketBy(buckets, "cluster_id", "block")
        .option("path", f"{path}/{build}/blocks")
        .saveAsTable(_table_name(build))
    )
    generation = max((old["generation"] or 0 for old in earlier), default=0) + 1
    header = [
        (FORMAT, VERSION, rows, index.dim, clusters, index.scale, per_shelf, buckets, generation, build)
    ]
    spark.createDataFrame(header, HEADER_SCHEMA).coalesce(1).write.mode("append").json(f"{path}/header")
    for old in earlier[1:]:
        if old["format"] == FORMAT and old["build"]:
            spark.sql(f"DROP TABLE IF EXISTS {_table_name(old['build'])}")
            delete_folder(spark, f"{path}/{old['build']}")


def _boxes(index: IvfIndex) -> DataFrame:
    """Least and largest codes of each cluster's members."""
    ends = [f(F.col("codes")[d]).alias(f"{n}{d}") for d in range(index.dim) for n, f in (("lo", F.min), ("hi", F.max))]

    def box(name: str) -> Column:
        return F.array(*[F.col(f"{name}{d}") for d in range(index.dim)]).cast("array<smallint>")

    found = index.postings.groupBy("cluster_id").agg(*ends)
    return found.select("cluster_id", box("lo").alias("least"), box("hi").alias("largest"))


def buckets_for(rows: int, cores: int) -> int:
    """Buckets of BUCKET_ROWS, but one a core in a small index and no more than MAX_BUCKETS."""
    return min(MAX_BUCKETS, max(1, cores, -(-rows // BUCKET_ROWS)))


def spread_buckets(rows: int, cores: int) -> int:
    """``buckets_for``, with up to BUCKETS_A_CORE a core where the rows are enough for that."""
    return buckets_for(rows, max(cores, min(BUCKETS_A_CORE * cores, rows // LEAST_BUCKET_ROWS)))


def _table_name(build: str) -> str:
    return "quintavote_" + build.replace("-", "_")


def _headers(spark: SparkSession, path: str) -> list:
    """The header rows under ``path``, newest first; none where nothing was written."""
    try:
        rows = spark.read.schema(HEADER_SCHEMA).json(f"{path}/header")
        return rows.orderBy(F.desc_nulls_last("generation"), F.desc("build")).collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def read_header(spark: SparkSession, path: str):
    rows = _headers(spark, path)
    if not rows or rows[0]["format"] != FORMAT:
        raise IndexFormatError(f"no {FORMAT} header under {path}")
    return rows[0]


def _open_blocks(spark: SparkSession, path: str, header) -> DataFrame:
    """The blocks as a bucketed table, declared in this session's catalog if it is not there.

    The table is external: its name is that of its build, and dropping it deletes no data.
    """
    name, location = _table_name(header["build"]), f"{path}/{header['build']}/blocks"
    if not spark.catalog.tableExists(name):
        quoted = location.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({BLOCK_SCHEMA}) USING parquet PARTITIONED BY (shelf)"
            f" CLUSTERED BY (cluster_id, block) INTO {header['buckets']} BUCKETS LOCATION '{quoted}'"
        )
        spark.catalog.recoverPartitions(name)
    return spark.table(name)


def read_index(spark: SparkSession, path: str, dim: int = DIM) -> IvfIndex:
    """Open the newest build, refusing another format, version, width or scale.

    It stays readable while one more build is written.
    """
    header = read_header(spark, path)
    for name, wanted in (("version", VERSION), ("dim", dim), ("scale", SCALE)):
        if header[name] != wanted:
            raise IndexFormatError(f"{name} mismatch: got {header[name]}, want {wanted}")
    if not 1 <= header["k"] <= MAX_CLUSTERS:
        raise IndexFormatError(f"cluster count {header['k']} out of range")
    build = f"{path}/{header['build']}"
    blocks = _open_blocks(spark, path, header)
    return IvfIndex(
        spark.read.schema(CENTROID_SCHEMA).parquet(f"{build}/centroids"),
        blocks.select("cluster_id", "shelf", F.inline("members")),
        header["dim"],
        header["scale"],
        StoredBlocks(
            blocks,
            spark.read.schema(LAYOUT_SCHEMA).parquet(f"{build}/layout"),
            header["buckets"],
            header["shelf_clusters"],
        ),
    )
