import json
from types import SimpleNamespace

from pyspark import StorageLevel
from pyspark.sql import functions as F

from quintavote.config import ProbeParams
from quintavote.operators.clustering import sampled_seeds
from quintavote.plans.ivf import IvfIndex, assign_postings
from quintavote.plans.scoring import score_transactions
from quintavote.sources.index_store import read_index, write_index
from quintavote.sources.tables import default_mcc_table
from quintavote.staging import fresh_path, materialize
from quintavote.streaming.score_stream import read_payload_stream, score_stream
from test_payload import changed


def test_stream_equals_batch_and_keeps_rejects(spark, tmp_path):
    refs = spark.range(300).select(
        F.col("id").alias("ref_id"),
        F.transform(F.sequence(F.lit(1), F.lit(14)), lambda i: (F.col("id") * i % 100) / 100).alias("vector"),
        (F.col("id") % 3 == 0).cast("int").alias("fraud"),
    )
    seeds = materialize(sampled_seeds(refs, "ref_id", 9, 1), "seeds")
    path = fresh_path(spark, "index")
    write_index(IvfIndex(seeds, assign_postings(refs, seeds)), path)
    index = read_index(spark, path)

    source = tmp_path / "in"
    source.mkdir()
    for part in range(3):
        lines = []
        for i in range(part * 20, part * 20 + 20):
            document = changed("transaction.amount", i * 450.0 if i % 7 else "broken")
            document["terminal"]["km_from_home"] = i * 15
            lines.append(json.dumps({"query_id": i, "payload": json.dumps(document)}))
        (source / f"{part}.json").write_text("\n".join(lines))

    stream = read_payload_stream(
        spark, str(source), "query_id bigint, payload string", max_files=1
    )
    params = ProbeParams(2, 5)
    query = (
        score_stream(
            stream, index, default_mcc_table(spark), str(tmp_path / "out"), str(tmp_path / "bad"),
            params=params,
        )
        .option("checkpointLocation", str(tmp_path / "progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()

    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert streamed.select("batch_id").distinct().count() == 3
    rejects = {r["query_id"]: r["reject_reason"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()}
    assert rejects == {i: "unreadable amount" for i in range(0, 60, 7)}

    batch = score_transactions(
        spark.read.schema("query_id bigint, payload string").json(str(source)),
        index,
        default_mcc_table(spark),
        params=params,
    )
    assert batch.count() == 60 - len(rejects)
    assert batch.exceptAll(streamed.select(batch.columns)).count() == 0


def test_large_batch_is_parsed_where_it_is_read_and_kept_on_disk(spark, tmp_path, monkeypatch):
    """A batch of many splits is not moved, and none is kept in memory."""
    refs = spark.range(50).select(
        F.col("id").alias("ref_id"),
        F.array_repeat(F.col("id") / 50, 14).alias("vector"),
        F.lit(0).alias("fraud"),
    )
    seeds = materialize(sampled_seeds(refs, "ref_id", 4, 1), "seeds")
    path = fresh_path(spark, "index")
    write_index(IvfIndex(seeds, assign_postings(refs, seeds)), path)
    stream = SimpleNamespace(writeStream=SimpleNamespace(foreachBatch=lambda score: score))
    score = score_stream(
        stream, read_index(spark, path), default_mcc_table(spark), str(tmp_path / "out"), str(tmp_path / "bad"),
        params=ProbeParams(2, 3),
    )
    cores = spark.sparkContext.defaultParallelism
    documents = [(i, json.dumps(changed("transaction.amount", i * 10.0))) for i in range(4 * cores)]
    batch = spark.createDataFrame(documents, "query_id bigint, payload string").repartition(2 * cores)
    kind, levels = type(batch), []
    persist = kind.persist
    monkeypatch.setattr(kind, "persist", lambda df, level: levels.append(level) or persist(df, level))
    monkeypatch.setattr(batch, "repartition", None, raising=False)
    score(batch, 3)
    assert levels == [StorageLevel.DISK_ONLY]
    assert spark.read.parquet(str(tmp_path / "out/batch_id=3")).count() == 4 * cores
