import gzip
import json
import time

import pytest
from pyspark.sql import functions as F

from quintavote import staging
from quintavote.config import Normalization
from quintavote.operators.clustering import sampled_seeds
from quintavote.plans.ivf import IvfIndex, assign_postings
from quintavote.sources import decisions, evaluation_set, index_store, tables
from quintavote.staging import fresh_path, materialize, staging_scope

REFS = [
    {"vector": [0.1] * 14, "label": "fraud"},
    {"vector": [0.2] * 14, "label": "legit"},
    {"vector": [-1] * 14, "label": "FRAUD"},
    {"vector": [0.4] * 14},
]


def test_references_from_gzipped_array(spark, tmp_path):
    path = tmp_path / "refs.json.gz"
    path.write_bytes(gzip.compress(json.dumps(REFS, indent=1).encode()))
    rows = tables.read_references(spark, str(path)).orderBy("ref_id").collect()
    assert [r["fraud"] for r in rows] == [1, 0, 0, 0]
    assert [r["ref_id"] for r in rows] == [0, 1, 2, 3]
    assert rows[2]["vector"] == [-1.0] * 14


def test_references_from_lines(spark, tmp_path):
    path = tmp_path / "refs.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in REFS))
    rows = tables.read_references(spark, str(path), json_lines=True).collect()
    assert sorted(r["fraud"] for r in rows) == [0, 0, 0, 1]


def test_normalization(spark, tmp_path):
    path = tmp_path / "norm.json"
    values = dict(
        max_amount=10_000, max_installments=12, amount_vs_avg_ratio=10, max_minutes=1_440,
        max_km=1_000, max_tx_count_24h=20, max_merchant_avg_amount=10_000,
    )
    path.write_text(json.dumps(values, indent=2))
    assert tables.read_normalization(spark, str(path)) == Normalization()
    del values["max_km"]
    path.write_text(json.dumps(values))
    with pytest.raises(ValueError, match="max_km"):
        tables.read_normalization(spark, str(path))
    path.write_text(json.dumps({**values, "max_km": 0}))
    with pytest.raises(ValueError, match="max_km"):
        tables.read_normalization(spark, str(path))


def test_mcc_table(spark, tmp_path):
    path = tmp_path / "mcc.json"
    path.write_text(json.dumps({"5411": 0.15, "12": 0.9, "x": 0.1, "10000": 0.2, "-1": 0.3}, indent=1))
    found = {r["mcc"]: r["risk"] for r in tables.read_mcc_table(spark, str(path)).collect()}
    assert found == {"5411": 0.15, "0012": 0.9}


def test_default_mcc_table(spark):
    found = {r["mcc"]: r["risk"] for r in tables.default_mcc_table(spark).collect()}
    assert len(found) == 10 and found["7995"] == 0.85


def test_transactions_keep_their_text(spark, tmp_path):
    path = tmp_path / "tx.json"
    path.write_text('{"id": "a"}\nbroken\n')
    rows = tables.read_transactions(spark, str(path)).orderBy("query_id").collect()
    assert [r["payload"] for r in rows] == ['{"id": "a"}', "broken"]


def test_evaluation_document(spark, tmp_path):
    document = {
        "stats": {"total": 2, "fraud_count": 1, "fraud_rate": 50.0, "legit_count": 1,
                  "legit_rate": 50.0, "edge_case_rate": 0.0},
        "entries": [
            {"request": {"id": "a", "transaction": {"amount": 1.5}}, "expected_approved": True},
            {"request": {"id": "b"}, "expected_approved": False},
        ],
    }
    path = tmp_path / "eval.json"
    path.write_text(json.dumps(document, indent=1))
    rows = evaluation_set.read_evaluation_entries(spark, str(path)).orderBy("query_id").collect()
    assert [r["expected_approved"] for r in rows] == [True, False]
    assert json.loads(rows[0]["payload"]) == document["entries"][0]["request"]
    assert evaluation_set.read_evaluation_stats(spark, str(path)).first()["total"] == 2


def test_decisions_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, True, 0.0), (2, False, 0.6)], "query_id bigint, approved boolean, fraud_score double"
    )
    bodies = {r["query_id"]: r["value"] for r in decisions.decision_json(df).collect()}
    assert bodies == {
        1: '{"approved":true,"fraud_score":0.0}',
        2: '{"approved":false,"fraud_score":0.6}',
    }
    decisions.write_decisions(df, str(tmp_path / "out"))
    read = spark.read.schema(df.schema).json(str(tmp_path / "out"))
    assert read.exceptAll(df).count() == 0 and read.count() == 2


@pytest.fixture(scope="module")
def index(spark):
    rows = [(i, [round((i * 7 % 100) / 100, 2)] * 14, i % 2) for i in range(80)]
    refs = spark.createDataFrame(rows, "ref_id bigint, vector array<double>, fraud int")
    seeds = materialize(sampled_seeds(refs, "ref_id", 5, 1), "seeds")
    return IvfIndex(seeds, materialize(assign_postings(refs, seeds), "postings"))


def test_index_round_trip(spark, index):
    path = fresh_path(spark, "index")
    index_store.write_index(index, path)
    read = index_store.read_index(spark, path)
    columns = ["cluster_id", "ref_id", "codes", "fraud"]
    assert read.postings.select(columns).exceptAll(index.postings.select(columns)).count() == 0
    assert read.postings.count() == 80
    assert read.centroids.exceptAll(index.centroids).count() == 0
    header = index_store.read_header(spark, path)
    assert (header["n"], header["k"], header["dim"], header["scale"]) == (80, 5, 14, 10_000)


def test_blocks_and_buckets(spark, index, monkeypatch):
    """Blocks keep to their size, a cluster of several lies in several buckets."""
    monkeypatch.setattr(index_store, "BLOCK_ROWS", 4)
    path = fresh_path(spark, "index")
    index_store.write_index(index, path)
    read = index_store.read_index(spark, path)
    blocks = read.stored.blocks.selectExpr("cluster_id", "block", "size(members) AS n", "members.ref_id AS ids").collect()
    assert sum(b["n"] for b in blocks) == 80 and max(b["n"] for b in blocks) < 16
    assert all(b["ids"] == sorted(b["ids"]) for b in blocks)
    counted = {r["cluster_id"]: r["blocks"] for r in read.stored.layout.collect()}
    members = {r["cluster_id"]: r["count"] for r in index.postings.groupBy("cluster_id").count().collect()}
    assert counted == {c: -(-n // 4) for c, n in members.items()}
    assert {(b["cluster_id"], b["block"]) for b in blocks} <= {(c, i) for c, n in counted.items() for i in range(n)}


def test_index_opens_in_a_catalog_that_does_not_know_it(spark, index):
    path = fresh_path(spark, "it's an index")
    index_store.write_index(index, path)
    name = index_store._table_name(index_store.read_header(spark, path)["build"])
    spark.sql(f"DROP TABLE {name}")
    read = index_store.read_index(spark, path)
    assert read.postings.count() == 80 and read.stored.blocks.count() >= 5


def test_a_reader_outlives_one_rewrite(spark, index):
    path = fresh_path(spark, "index")
    index_store.write_index(index, path)
    opened = index_store.read_index(spark, path)
    moved = IvfIndex(index.centroids.withColumn("norm_sq", F.col("norm_sq") + 1), index.postings)
    index_store.write_index(moved, path)
    assert opened.postings.count() == 80
    assert opened.centroids.exceptAll(index.centroids).count() == 0
    newer = index_store.read_index(spark, path)
    assert newer.centroids.exceptAll(moved.centroids).count() == 0
    index_store.write_index(moved, path)
    builds = [h["build"] for h in index_store._headers(spark, path)]
    root = path.removeprefix("file://")
    from pathlib import Path

    assert [(Path(root) / b).exists() for b in builds] == [True, True, False]


@pytest.mark.parametrize("rows, cores, buckets", [(0, 8, 8), (5_000_000, 2, 5), (10**12, 8, 4_096)])
def test_bucket_numbers(rows, cores, buckets):
    assert index_store.buckets_for(rows, cores) == buckets


@pytest.mark.parametrize(
    "rows, clusters, shelf",
    [(100, 5, 5), (0, 5, 5), (192_000_000, 4_096, 1_365), (10**13, 65_535, 1)],
)
def test_shelf_sizes(rows, clusters, shelf):
    assert index_store.clusters_per_shelf(rows, clusters) == shelf


def test_index_mismatch_is_refused(spark, index):
    path = fresh_path(spark, "index")
    index_store.write_index(index, path)
    with pytest.raises(index_store.IndexFormatError, match="dim"):
        index_store.read_index(spark, path, dim=64)
    other = fresh_path(spark, "index")
    spark.createDataFrame([("other", 1, 1, 14, 1, 10_000, 1, 1, 1, "b")], index_store.HEADER_SCHEMA).write.json(
        f"{other}/header"
    )
    with pytest.raises(index_store.IndexFormatError, match="header"):
        index_store.read_index(spark, other)


def test_broken_build_leaves_the_index_that_was_there(spark, index):
    path = fresh_path(spark, "index")
    index_store.write_index(index, path)
    moved = index.centroids.withColumn("norm_sq", F.col("norm_sq") + 1)
    bad = index.postings.withColumn("fraud", F.expr("cast(raise_error('cut') as int)"))
    with pytest.raises(Exception, match="cut"):
        index_store.write_index(IvfIndex(moved, bad), path)
    read = index_store.read_index(spark, path)
    assert read.centroids.exceptAll(index.centroids).count() == 0
    assert read.postings.count() == 80
    index_store.write_index(IvfIndex(moved, read.postings), path)
    read = index_store.read_index(spark, path)
    assert read.centroids.exceptAll(moved).count() == 0 and read.postings.count() == 80


def test_scoped_tables_are_deleted(spark):
    from pathlib import Path

    with staging_scope(spark):
        held = materialize(spark.range(3), "scoped")
        folder = Path(held.inputFiles()[0].removeprefix("file://")).parent
        assert folder.exists()
    assert not folder.exists()


@pytest.mark.parametrize("text", ['{"5411":0.15,"5812":"abc"}', '{"5411":0.15', "[1]", "7"])
def test_malformed_risk_file_is_refused(spark, tmp_path, text):
    path = tmp_path / "risk.json"
    path.write_text(text)
    with pytest.raises(Exception):
        tables.read_mcc_table(spark, str(path)).collect()


@pytest.mark.parametrize("rows, cores, buckets", [(0, 8, 8), (100_000, 12, 12), (1_000_000, 8, 32), (6_000_000, 12, 48), (10**12, 8, 4_096)])
def test_buckets_are_several_a_core_where_rows_are_many(rows, cores, buckets):
    assert index_store.spread_buckets(rows, cores) == buckets


def test_written_table_leaves_no_shuffle_files(spark):
    """What a written table was shuffled by goes with the writing, not with the driver's memory."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        every = files.getAllFiles()
        return {every.apply(i).getName() for i in range(every.size()) if every.apply(i).getName().startswith("shuffle_")}

    names = staging._BOUNDED
    before, settings = shuffled(), [spark.conf.get(name) for name in names]
    table = materialize(spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    for _ in range(100):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before
    assert table.count() == 7 and [spark.conf.get(name) for name in names] == settings


def test_lists_of_many_groups_are_sorted(spark, monkeypatch):
    """A task that writes keeps the lists of few groups in memory, and all of them come out whole."""
    rows = spark.range(20_000).select((F.col("id") % 50).alias("k"), "id")
    lists = rows.repartition(1).groupBy("k").agg(F.collect_list("id").alias("held"))
    writer, seen = type(lists.write), []
    write = writer.parquet

    def watched(self, path, **options):
        seen.append(int(spark.conf.get("spark.sql.objectHashAggregate.sortBased.fallbackThreshold")))
        return write(self, path, **options)

    monkeypatch.setattr(writer, "parquet", watched)
    kept = materialize(lists, "lists").collect()
    assert len(seen) == 1 and seen[0] <= 8
    assert {r["k"]: sorted(r["held"]) for r in kept} == {k: [*range(k, 20_000, 50)] for k in range(50)}
