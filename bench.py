"""Headline timings as one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].
Each query runs to completion into a no-op sink.  The shared tables (vectors,
index) are landed first, under their own names, and every later query reads
them the way a pipeline would.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from quintavote.config import BuildParams, ProbeParams  # noqa: E402
from quintavote.operators import knn, topk  # noqa: E402
from quintavote.plans import ivf  # noqa: E402
from quintavote.plans.scoring import score_transactions  # noqa: E402
from quintavote.sources.index_store import read_index, write_index  # noqa: E402
from quintavote.sources.tables import default_mcc_table  # noqa: E402
from quintavote.staging import fresh_path, materialize  # noqa: E402
from quintavote.streaming.score_stream import read_payload_stream, score_stream  # noqa: E402
from quintavote.testbed import landed  # noqa: E402
from quintavote.testbed import transactions as tx  # noqa: E402
from quintavote.testbed.queries import REGISTRY  # noqa: E402

CLUSTERS = 512
PROBES = ProbeParams(8, 28)
MICRO_BATCHES = 10


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quintavote-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stream_seconds(spark: SparkSession, index: ivf.IvfIndex, payloads: DataFrame) -> list[float]:
    """Seconds of each micro-batch of a stream over all payloads."""
    source, root = fresh_path(spark, "arriving"), fresh_path(spark, "scored")
    payloads.repartition(MICRO_BATCHES).write.json(source)
    stream = read_payload_stream(spark, source, "query_id bigint, payload string", max_files=1)
    writer = score_stream(
        stream, index, default_mcc_table(spark), f"{root}/out", f"{root}/bad", params=PROBES
    )
    started = (
        writer.option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    )
    started.awaitTermination()
    return [p["durationMs"]["triggerExecution"] / 1_000 for p in started.recentProgress if p["numInputRows"]]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    timings: dict[str, float] = {}

    def timed(name: str, run):
        start = time.perf_counter()
        result = run()
        timings[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {timings[name]}", file=sys.stderr, flush=True)
        return result

    def drain(df: DataFrame) -> None:
        df.write.format("noop").mode("overwrite").save()

    spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).count().collect()

    flat = timed("land_transactions", lambda: landed.transactions(spark, sf_dir))
    payloads = timed("land_payloads", lambda: materialize(tx.payloads(flat), "payloads"))
    queries = timed("vectorize_json", lambda: landed.queries(spark, sf_dir))
    references = timed("land_references", lambda: landed.references(spark, sf_dir))
    built = timed(
        "ivf_build",
        lambda: ivf.build_index(
            references.select("ref_id", "vector", "fraud"), BuildParams(clusters=CLUSTERS)
        ),
    )
    path = fresh_path(spark, "index")
    timed("index_write", lambda: write_index(built, path))
    index = timed("index_read", lambda: read_index(spark, path))

    rows = queries.count()
    exact = timed(
        "knn_exact",
        lambda: materialize(knn.knn_exact(queries, references, skip_self=True), "exact"),
    )
    timed(
        "ivf_fast",
        lambda: drain(ivf.fast_votes(queries, index, params=PROBES, skip_self=True)),
    )
    adaptive = timed(
        "ivf_adaptive",
        lambda: materialize(ivf.adaptive_votes(queries, index, PROBES, skip_self=True), "votes"),
    )
    timed(
        "score_transactions",
        lambda: drain(
            score_transactions(
                payloads.drop("fraud"), index, default_mcc_table(spark), params=PROBES
            )
        ),
    )
    timed("land_sql_index_votes", lambda: landed.adaptive(spark, sf_dir))
    for name in ("knn_embeddings", "latency_p99", "confusion_matrix", "eval_report"):
        timed(name, lambda name=name: drain(REGISTRY[name](spark, sf_dir)))

    batches = timed(
        "stream_score", lambda: stream_seconds(spark, index, payloads.drop("fraud"))
    )

    truth = topk.fraud_vote(queries, exact).withColumnRenamed("votes", "exact_votes")
    agreement = (
        truth.join(adaptive, "query_id")
        .agg(
            F.avg(((F.col("exact_votes") < 3) == (F.col("votes") < 3)).cast("int")),
            F.avg(((F.col("exact_votes") < 3) == (F.col("fast_votes") < 3)).cast("int")),
            F.avg((F.col("exact_votes") == F.col("votes")).cast("int")),
            F.avg(F.col("expanded").cast("int")),
        )
        .first()
    )
    per_second = {
        name: round(rows / timings[name], 1)
        for name in ("knn_exact", "ivf_fast", "ivf_adaptive", "score_transactions")
    }
    batches.sort()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "transactions": rows,
                "clusters": CLUSTERS,
                "transactions_per_second": per_second,
                "decision_agreement_adaptive": round(agreement[0], 5),
                "decision_agreement_fast": round(agreement[1], 5),
                "vote_agreement_adaptive": round(agreement[2], 5),
                "share_expanded": round(agreement[3], 5),
                "micro_batch_seconds_p50": round(batches[len(batches) // 2], 3),
                "micro_batch_seconds_p99": round(batches[-1], 3),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
