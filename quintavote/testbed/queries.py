"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quintavote.config import DIM, BuildParams, Normalization, ProbeParams
from quintavote.functions import distance, features, parsing, scores
from quintavote.operators import clustering, evaluate, knn, payload, probing, scan, topk
from quintavote.operators import vectorize as vec
from quintavote.plans import ivf
from quintavote.plans.evaluation import evaluation_run as run_evaluation
from quintavote.plans.scoring import score_and_reject, score_transactions
from quintavote.sources import decisions as decision_io
from quintavote.sources import evaluation_set, index_store, tables
from quintavote.staging import fresh_path, materialize
from quintavote.streaming.score_stream import read_payload_stream, score_stream
from quintavote.testbed import landed
from quintavote.testbed import transactions as tx

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
NORM = Normalization()
EMBEDDING_DIM = 64


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def _codes(df: DataFrame, *kept: str) -> DataFrame:
    flat = df.select(*kept, F.transform("codes", lambda c: c.cast("int")).alias("codes"))
    return vec.spread(flat, "codes", "q")


def _payloads(spark: SparkSession, sf_dir: str, **overrides: Column) -> DataFrame:
    document = tx.payload_document(**overrides)
    return landed.transactions(spark, sf_dir).select(
        "query_id", document.alias("payload"), "fraud"
    )


def _parsed(spark: SparkSession, sf_dir: str, **overrides: Column) -> DataFrame:
    rows = _payloads(spark, sf_dir, **overrides).drop("fraud")
    return rows.transform(payload.json_extract).transform(payload.parse_fields)


def _by_id(*choices: Column | None) -> Column:
    """A variant of a field per row, cycling with the id; None drops the field."""
    chosen = F.lit(None)
    for number, choice in reversed(list(enumerate(choices))):
        value = F.lit(None) if choice is None else choice
        chosen = F.when(F.col("query_id") % len(choices) == number, value).otherwise(chosen)
    return chosen


# Sources and sinks


# Elements of one written document.
_DOCUMENT_ROWS = 2_000


def _write_documents(rows: DataFrame, path: str, head: str | Column, tail: str) -> None:
    """Rows (id, value) as files of one document each, in the order of ids.

    ``head`` may be an aggregate over the document's rows.
    """
    head = F.lit(head) if isinstance(head, str) else head
    number = F.lpad((F.col("id") / _DOCUMENT_ROWS).cast("long").cast("string"), 12, "0")
    placed = F.sort_array(F.collect_list(F.struct("id", "value")))
    documents = rows.groupBy(number.alias("document")).agg(placed.alias("held"), head.alias("head"))
    text = F.concat("head", F.array_join("held.value", ",\n "), F.lit(tail))
    documents.select(text.alias("value"), "document").write.partitionBy("document").text(path)


@query
def ref_scan(spark, sf_dir):
    """Arrays of references, read in splits; ids are positions."""
    path = fresh_path(spark, "references")
    label = F.when(F.col("fraud") == 1, "fraud").otherwise("legit")
    rows = landed.references(spark, sf_dir).select(
        F.col("ref_id").alias("id"), F.to_json(F.struct("vector", label.alias("label"))).alias("value")
    )
    _write_documents(rows, path, "[", "]")
    return _codes(vec.with_reference_codes(tables.read_references(spark, path)), "ref_id", "fraud")


@query
def norm_params(spark, sf_dir):
    """Divisors from a configuration file, applied to every transaction."""
    path = fresh_path(spark, "norm")
    divisors = {**asdict(NORM), "max_amount": 5_000, "max_km": 400, "max_installments": 6}
    spark.createDataFrame([(json.dumps(divisors),)], "value string").write.text(path)
    norm = tables.read_normalization(spark, path)
    return landed.transactions(spark, sf_dir).select(
        "query_id",
        features.ratio_dim(F.col("amount"), norm.max_amount).alias("d0"),
        features.ratio_dim(F.col("installments"), norm.max_installments).alias("d1"),
        features.ratio_dim(F.col("km_from_home"), norm.max_km).alias("d7"),
    )


@query
def mcc_table(spark, sf_dir):
    """Observed fraud share by code, written as the configuration map and read back."""
    path = fresh_path(spark, "mcc")
    shares = (
        landed.transactions(spark, sf_dir)
        .groupBy("mcc")
        .agg((F.sum("fraud") / F.count("*")).alias("share"))
    )
    # One entry per merchant category code: bounded by the code space.
    entries = F.map_from_entries(F.collect_list(F.struct("mcc", "share")))
    shares.agg(F.to_json(entries).alias("value")).write.text(path)
    return tables.read_mcc_table(spark, path)


@query
def txn_scan(spark, sf_dir):
    path = fresh_path(spark, "transactions")
    # Sorted, so that positions follow ids.
    _payloads(spark, sf_dir).orderBy("query_id").select("payload").write.text(path)
    read = tables.read_transactions(spark, path).transform(payload.json_extract)
    return read.select(
        "query_id",
        F.col("amount").cast("double").alias("amount"),
        "requested_at",
        "merchant_id",
        F.size("known_merchants").alias("known_count"),
        F.col("last_transaction.timestamp").alias("last_timestamp"),
    )


@query
def stream_score(spark, sf_dir):
    """Decisions and rejects of a stream in which two payloads of ten cannot be scored."""
    source, root = fresh_path(spark, "arriving"), fresh_path(spark, "scored")
    _spoilt(spark, sf_dir).repartition(4).write.json(source)
    stream = read_payload_stream(spark, source, "query_id bigint, payload string", max_files=2)
    writer = score_stream(
        stream,
        landed.index(spark, sf_dir),
        tables.default_mcc_table(spark),
        f"{root}/decisions",
        f"{root}/rejects",
        params=landed.PROBES,
    )
    started = (
        writer.option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    return _decided_and_rejected(
        spark.read.parquet(f"{root}/decisions"), spark.read.parquet(f"{root}/rejects")
    )


def _spoilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads, of which some lack their amount and some have one that is no number."""
    kind = F.col("query_id") % 10
    amount = F.when(kind == 4, F.lit(None)).when(kind == 7, F.lit("much")).otherwise(F.col("amount").cast("string"))
    return _payloads(spark, sf_dir, amount=amount).drop("fraud")


def _decided_and_rejected(decided: DataFrame, rejects: DataFrame) -> DataFrame:
    columns = ["query_id", "votes", "fraud_score", "approved", "reject_reason"]
    return decided.unionByName(rejects, allowMissingColumns=True).select(columns)


@query
def score_and_rejects(spark, sf_dir):
    """Decisions and rejects of a batch, parsed once."""
    return _decided_and_rejected(
        *score_and_reject(
            _spoilt(spark, sf_dir),
            landed.index(spark, sf_dir),
            tables.default_mcc_table(spark),
            params=landed.PROBES,
        )
    )


@query
def decision_sink(spark, sf_dir):
    path = fresh_path(spark, "decisions")
    decided = topk.decide(landed.fast(spark, sf_dir))
    decision_io.write_decisions(decided, path)
    read = spark.read.schema("query_id bigint, approved boolean, fraud_score double").json(path)
    return decision_io.decision_json(read)


@query
def index_write(spark, sf_dir):
    """Sizes of the written posting lists."""
    path = fresh_path(spark, "index")
    index_store.write_index(landed.index(spark, sf_dir), path)
    return index_store.read_index(spark, path).postings.groupBy("cluster_id").agg(
        F.count("*").alias("members"), F.sum("fraud").alias("frauds")
    )


@query
def index_read(spark, sf_dir):
    """Round trip of header, centroids and postings."""
    path = fresh_path(spark, "index")
    index_store.write_index(landed.index(spark, sf_dir), path)
    read = index_store.read_index(spark, path)
    postings = _codes(read.postings, "cluster_id", "ref_id", "fraud")
    norms = read.centroids.select("cluster_id", "norm_sq")
    return postings.join(F.broadcast(norms), "cluster_id")


def _entry() -> Column:
    """An evaluation entry; ``request`` is a document inside it, not a string of one."""
    return F.concat(
        F.lit('{"request":'),
        "payload",
        F.lit(',"expected_approved":'),
        (F.col("fraud") == 0).cast("string"),
        F.lit("}"),
    )


@query
def eval_scan(spark, sf_dir):
    """Entries of documents, which also hold statistics, read in splits."""
    path = fresh_path(spark, "entries")
    rows = _payloads(spark, sf_dir).select(F.col("query_id").alias("id"), _entry().alias("value"))
    _write_documents(rows, path, '{"stats": {"total": 2000}, "entries": [', "]}")
    entries = evaluation_set.read_evaluation_entries(spark, path)
    return entries.transform(payload.json_extract).select(
        "query_id", F.col("amount").cast("double").alias("amount"), "requested_at", "expected_approved"
    )


@query
def json_extract(spark, sf_dir):
    rows = _payloads(spark, sf_dir).drop("fraud").transform(payload.json_extract)
    numbers = [F.col(name).cast("double").alias(name) for name in payload.NUMERIC]
    return rows.select(
        "query_id",
        *numbers,
        "requested_at",
        "merchant_id",
        "mcc",
        "is_online",
        "card_present",
        F.array_join("known_merchants", ",").alias("known_merchants"),
        F.col("last_transaction.timestamp").alias("last_timestamp"),
        F.col("last_transaction.km_from_current").cast("double").alias("last_km"),
    )


@query
def required_filter(spark, sf_dir):
    """Each row lacks one of the required fields, or none."""
    lacking = {
        name: F.when(F.col("query_id") % 12 != number, F.col(name))
        for number, name in enumerate(payload.REQUIRED)
    }
    return _parsed(spark, sf_dir, **lacking).select("query_id", "reject_reason")


@query
def numeric_parse(spark, sf_dir):
    amount = F.col("amount").cast("string")
    tokens = _by_id(
        amount,
        F.concat(F.lit("-"), amount),
        F.concat(amount, F.lit("e1")),
        F.lit("abc"),
        F.concat(F.lit(" "), amount),
        F.concat(amount, F.lit("d")),
        F.lit("NaN"),
        F.lit("1e400"),
        F.lit(""),
    )
    rows = _parsed(spark, sf_dir, amount=tokens)
    return rows.select("query_id", "amount", "reject_reason")


@query
def decision(spark, sf_dir):
    return topk.decide(landed.fast(spark, sf_dir))


@query
def borderline_filter(spark, sf_dir):
    return topk.borderline(landed.fast(spark, sf_dir))


# Scalar functions


@query
def clamp01(spark, sf_dir):
    e = tx.events(spark, sf_dir)
    return e.select("event_id", features.clamp01((F.col("value") - 40) / 60).alias("clamped"))


@query
def ratio_dims(spark, sf_dir):
    t = landed.transactions(spark, sf_dir)
    return t.select(
        "query_id",
        features.ratio_dim(F.col("amount"), NORM.max_amount).alias("d0"),
        features.ratio_dim(F.col("installments"), NORM.max_installments).alias("d1"),
        features.ratio_dim(F.col("km_from_home"), NORM.max_km).alias("d7"),
        features.ratio_dim(F.col("tx_count_24h"), NORM.max_tx_count_24h).alias("d8"),
        features.ratio_dim(F.col("merchant_avg"), NORM.max_merchant_avg_amount).alias("d13"),
    )


@query
def amount_ratio(spark, sf_dir):
    """The customer average also takes zero and negative values."""
    average = _by_id(F.col("customer_avg"), F.lit(0.0), -F.col("customer_avg"))
    t = landed.transactions(spark, sf_dir).withColumn("avg", average)
    ratio = features.amount_ratio(F.col("amount"), F.col("avg"), NORM.amount_vs_avg_ratio)
    return t.select("query_id", ratio.alias("d2"))


@query
def iso8601z(spark, sf_dir):
    at = F.col("requested_at")
    text = _by_id(
        at,
        F.concat(F.substring(at, 1, 19), F.lit("+00:00")),
        F.concat(F.substring(at, 1, 19), F.lit(".5Z")),
        F.concat(F.substring(at, 1, 5), F.lit("13"), F.substring(at, 8, 13)),
        F.concat(F.substring(at, 1, 10), F.lit(" "), F.substring(at, 12, 9)),
        F.concat(at, F.lit("\n")),
    )
    return landed.transactions(spark, sf_dir).select(
        "query_id", parsing.iso8601z(text).alias("epoch_seconds")
    )


def _seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed.transactions(spark, sf_dir).select(
        "query_id",
        parsing.iso8601z(F.col("requested_at")).alias("now"),
        parsing.iso8601z(F.col("last_timestamp")).alias("last"),
    )


@query
def hour_dim(spark, sf_dir):
    rows = _seconds(spark, sf_dir)
    return rows.select("query_id", features.hour_dim(F.col("now")).alias("d3"))


@query
def dow_dim(spark, sf_dir):
    rows = _seconds(spark, sf_dir)
    return rows.select("query_id", features.dow_dim(F.col("now")).alias("d4"))


@query
def minutes_between(spark, sf_dir):
    minutes = features.minutes_between(F.col("last"), F.col("now"))
    return _seconds(spark, sf_dir).select("query_id", minutes.alias("minutes"))


@query
def last_txn_dims(spark, sf_dir):
    """Every shape of ``last_transaction``, by id."""
    at, km = F.col("requested_at"), F.col("last_km")

    def last(timestamp: Column, distance: Column) -> Column:
        return F.to_json(
            F.struct(timestamp.alias("timestamp"), distance.alias("km_from_current"))
        )

    none = F.lit(None).cast("string")
    raw = F.coalesce(
        _by_id(
            last(F.col("last_timestamp"), km),
            F.lit("null"),
            F.lit('"x"'),
            F.lit("[1]"),
            F.lit("{}"),
            last(F.col("last_timestamp"), none),
            last(none, km),
            last(F.lit("yesterday"), km),
            last(F.lit("2030-01-01T00:00:00Z"), km),
            last(at, F.lit("far")),
        ),
        F.lit("null"),
    )
    rows = landed.transactions(spark, sf_dir).select(
        "query_id",
        F.concat(
            F.substring_index(tx.payload_document(), ',"last_transaction":', 1), F.lit("")
        ).alias("head"),
        raw.alias("raw"),
    )
    closed = F.when(F.col("head").endswith("}}"), F.expr("left(head, length(head) - 1)"))
    head = F.coalesce(closed, F.col("head"))
    documents = rows.select(
        "query_id",
        F.concat(head, F.lit(',"last_transaction":'), "raw", F.lit("}")).alias("payload"),
    )
    vectors = vec.vectorize_payloads(documents, tables.default_mcc_table(spark))
    return vectors.selectExpr("query_id", "vector[5] AS d5", "vector[6] AS d6")


@query
def bool_flags(spark, sf_dir):
    """Booleans, their names as strings, other words and absence."""
    online = _by_id(
        F.col("is_online").cast("string"), F.lit("true"), F.lit("TRUE"), F.lit("1"), None
    )
    rows = _payloads(spark, sf_dir, is_online=online).transform(payload.json_extract)
    return rows.select(
        "query_id",
        parsing.is_true(F.col("is_online")).alias("d9"),
        parsing.is_true(F.col("card_present")).alias("d10"),
    )


@query
def unknown_merchant(spark, sf_dir):
    """Lists as they are, doubled, emptied, holding null, and absent."""
    known = F.col("known_merchants")
    empty = F.array().cast("array<string>")
    lists = _by_id(known, F.concat(known, known), empty, F.array(F.lit(None).cast("string")), None)
    rows = _payloads(spark, sf_dir, known_merchants=lists).transform(payload.json_extract)
    flag = features.unknown_merchant(F.col("known_merchants"), F.col("merchant_id"))
    return rows.select("query_id", flag.alias("d11"))


@query
def mcc_risk(spark, sf_dir):
    """Listed codes, unlisted ones and malformed ones."""
    code = F.col("mcc")
    codes = _by_id(code, code, code, F.concat(F.substring(code, 1, 3), F.lit("x")))
    rows = landed.transactions(spark, sf_dir).select("query_id", codes.alias("mcc"))
    risks = vec.with_mcc_risk(rows, tables.default_mcc_table(spark))
    return risks.select("query_id", F.col("mcc_risk").alias("d12"))


@query
def quantize_query(spark, sf_dir):
    return _codes(landed.queries(spark, sf_dir), "query_id")


@query
def quantize_ref(spark, sf_dir):
    coded = vec.with_reference_codes(tx.embeddings(spark, sf_dir))
    wide = coded.select("ref_id", F.transform("codes", lambda c: c.cast("int")).alias("codes"))
    return vec.spread(wide, "codes", "q", EMBEDDING_DIM)


@query
def dist_int(spark, sf_dir):
    """Distance of every vector to the one with the next id."""
    q = landed.queries(spark, sf_dir)
    left = q.select("query_id", F.col("codes").alias("a"))
    right = q.select((F.col("query_id") - 1).alias("query_id"), F.col("codes").alias("b"))
    return left.join(right, "query_id").select(
        "query_id", distance.dist_int("a", "b", DIM).alias("dist")
    )


def _with_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reference beside its cluster's centroid, by cluster id."""
    center = landed.centroids(spark, sf_dir)
    postings = landed.index(spark, sf_dir).postings.select("cluster_id", "ref_id")
    vectors = landed.references(spark, sf_dir).select("ref_id", "vector")
    return postings.join(vectors, "ref_id").join(F.broadcast(center), "cluster_id")


@query
def dist_f64(spark, sf_dir):
    squared = distance.dist_f64("vector", "centroid", DIM)
    return _with_centroid(spark, sf_dir).select("ref_id", "cluster_id", squared.alias("dist"))


@query
def centroid_score(spark, sf_dir):
    score = distance.centroid_score("vector", "centroid", "norm_sq", DIM)
    return _with_centroid(spark, sf_dir).select("ref_id", "cluster_id", score.alias("score"))


@query
def vectorize(spark, sf_dir):
    vectors = tx.vectors(landed.transactions(spark, sf_dir))
    return vec.spread(vectors.select("query_id", "vector"), "vector", "d")


# Joins


@query
def query_centroid_cross(spark, sf_dir):
    table = landed.index(spark, sf_dir).table
    return probing.centroid_coverage(landed.queries(spark, sf_dir), table)


def _probes(spark: SparkSession, sf_dir: str, first: int, last: int) -> DataFrame:
    table = landed.index(spark, sf_dir).table
    ranked = probing.with_probes(landed.queries(spark, sf_dir), table, last)
    return materialize(probing.probe_rows(ranked, first, last), "probes")


@query
def probe_posting_join(spark, sf_dir):
    """The nearest member of each probed cluster, for every query."""
    index = landed.index(spark, sf_dir)
    found = scan.scan_probes(
        _probes(spark, sf_dir, 1, 8), index.postings, k=1, skip_self=True, stored=index.stored
    )
    best = F.min(F.struct("dist", "ref_id")).alias("best")
    return (
        found.groupBy("query_id", "probe_rank", "cluster_id")
        .agg(best)
        .select("query_id", "probe_rank", "cluster_id", "best.dist", "best.ref_id")
    )


@query
def knn_exact(spark, sf_dir):
    return landed.exact(spark, sf_dir).select("query_id", "rank", "ref_id", "dist", "fraud")


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed.transactions(spark, sf_dir).select(
        "query_id", (F.col("fraud") == 0).alias("expected_approved")
    )


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of the adaptive search; large amounts went unanswered."""
    decided = topk.decide(landed.adaptive(spark, sf_dir))
    answered = landed.transactions(spark, sf_dir).filter(F.col("value") <= 200)
    return decided.join(answered.select("query_id"), "query_id", "left_semi")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.join_expected(_expected(spark, sf_dir), _predictions(spark, sf_dir))


@query
def prediction_expected_join(spark, sf_dir):
    return _outcomes(spark, sf_dir)


# Aggregations


@query
def fraud_vote(spark, sf_dir):
    return topk.fraud_vote(landed.queries(spark, sf_dir), landed.exact(spark, sf_dir))


@query
def centroid_update(spark, sf_dir):
    seeds = landed.seeds(spark, sf_dir)
    assigned = clustering.nearest_centroid(
        landed.references(spark, sf_dir), clustering.CentroidTable.load(seeds)
    )
    updated = clustering.centroid_update(assigned, seeds)
    return vec.spread(updated, "centroid", "c")


@query
def cluster_profile(spark, sf_dir):
    built = landed.index(spark, sf_dir)
    return clustering.cluster_profile(built.postings, built.centroids)


@query
def centroid_movement(spark, sf_dir):
    return clustering.centroid_movement(
        landed.seeds(spark, sf_dir), landed.centroids(spark, sf_dir)
    )


@query
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(_outcomes(spark, sf_dir))


@query
def weighted_error(spark, sf_dir):
    return evaluate.weighted_error(evaluate.confusion_matrix(_outcomes(spark, sf_dir)))


def _latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.events(spark, sf_dir).select(F.col("value").alias("latency_ms"))


@query
def latency_p99(spark, sf_dir):
    p99 = evaluate.latency_p99(_latencies(spark, sf_dir))
    return p99.select(F.round("p99", 6).alias("p99"))


@query
def latency_score(spark, sf_dir):
    """The score of each user's p99-like worst latency, and of scaled ones."""
    worst = (
        tx.events(spark, sf_dir)
        .groupBy("user_id")
        .agg((F.max("value") * (F.pmod("user_id", F.lit(20)) - 1)).alias("p99"))
    )
    return evaluate.latency_score(worst).select(
        "user_id", F.round("p99_score", 6).alias("p99_score"), "p99_cut"
    )


@query
def detection_score(spark, sf_dir):
    """Per event type, so that cut and uncut rows both occur."""
    kinds = landed.transactions(spark, sf_dir).select("query_id", "event_type")
    counts = evaluate.confusion_matrix(_outcomes(spark, sf_dir).join(kinds, "query_id"), "event_type")
    scored = evaluate.detection_score(evaluate.weighted_error(counts))
    rounded = ("error_rate", "failure_rate", "rate_component", "absolute_penalty", "detection_score")
    return scored.select(
        "event_type",
        "weighted_errors",
        "detection_cut",
        *[F.round(name, 6).alias(name) for name in rounded],
    )


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.evaluation_scores(
        _expected(spark, sf_dir), _predictions(spark, sf_dir), _latencies(spark, sf_dir)
    )


@query
def final_score(spark, sf_dir):
    names = ("p99_score", "detection_score", "final_score")
    return _scores(spark, sf_dir).select(*[F.round(n, 6).alias(n) for n in names])


@query
def dataset_profile(spark, sf_dir):
    profile = evaluate.dataset_profile(_expected(spark, sf_dir), landed.fast(spark, sf_dir))
    rates = [n for n in profile.columns if n.endswith("_rate")]
    return profile.withColumns({name: F.round(name, 6) for name in rates})


@query
def eval_report(spark, sf_dir):
    """The nested report, written and flattened again."""
    # Adaptive votes first: the fast ones are those of the pass that they go on from.
    scored = _scores(spark, sf_dir)
    profile = evaluate.dataset_profile(_expected(spark, sf_dir), landed.fast(spark, sf_dir))
    report = evaluate.evaluation_report(scored, profile)
    path = fresh_path(spark, "report")
    evaluation_set.write_report(report, path)
    return (
        spark.read.schema(report.schema)
        .json(path)
        .select(
            F.col("expected.total").alias("total"),
            F.col("expected.fraud_count").alias("fraud_count"),
            F.col("p99"),
            F.col("scoring.breakdown.true_positive_detections").alias("tp"),
            F.col("scoring.breakdown.true_negative_detections").alias("tn"),
            F.col("scoring.breakdown.false_positive_detections").alias("fp"),
            F.col("scoring.breakdown.false_negative_detections").alias("fn"),
            F.col("scoring.breakdown.http_errors").alias("errors"),
            F.col("scoring.weighted_errors_E").alias("weighted_errors"),
            F.col("scoring.error_rate_epsilon").alias("error_rate"),
            F.col("scoring.p99_score.value").alias("p99_score"),
            F.col("scoring.detection_score.value").alias("detection_score"),
            F.col("scoring.detection_score.cut_triggered").alias("detection_cut"),
            F.col("scoring.final_score").alias("final_score"),
        )
    )


@query
def evaluation_run(spark, sf_dir):
    """Documents of entries with their statistics, scored by the index, every report field."""
    path = fresh_path(spark, "evaluation")
    rows = _payloads(spark, sf_dir).join(landed.fast(spark, sf_dir).select("query_id", "votes"), "query_id")
    fraud, edge = F.col("fraud") == 1, scores.is_borderline(F.col("votes"))
    total = F.count("*")
    stats = F.to_json(
        F.struct(
            total.alias("total"),
            F.count_if(fraud).alias("fraud_count"),
            (F.count_if(fraud) * 100 / total).alias("fraud_rate"),
            F.count_if(~fraud).alias("legit_count"),
            (F.count_if(~fraud) * 100 / total).alias("legit_rate"),
            (F.count_if(edge) * 100 / total).alias("edge_case_rate"),
        )
    )
    entries = rows.select(F.col("query_id").alias("id"), _entry().alias("value"), "fraud", "votes")
    _write_documents(entries, path, F.concat(F.lit('{"stats": '), stats, F.lit(', "entries": [')), "]}")
    answered = landed.transactions(spark, sf_dir).filter(F.col("value") <= 200).select("query_id")

    def score(payloads: DataFrame) -> DataFrame:
        decided = score_transactions(
            payloads, landed.index(spark, sf_dir), tables.default_mcc_table(spark),
            params=landed.PROBES, skip_self=True,
        )
        return decided.join(answered, "query_id", "left_semi")

    report = run_evaluation(spark, path, score, _latencies(spark, sf_dir))
    return report.select(
        "expected.*",
        "p99",
        F.col("scoring.breakdown.true_positive_detections").alias("tp"),
        F.col("scoring.breakdown.true_negative_detections").alias("tn"),
        F.col("scoring.breakdown.false_positive_detections").alias("fp"),
        F.col("scoring.breakdown.false_negative_detections").alias("fn"),
        F.col("scoring.breakdown.http_errors").alias("errors"),
        "scoring.failure_rate",
        F.col("scoring.weighted_errors_E").alias("weighted_errors"),
        F.col("scoring.error_rate_epsilon").alias("error_rate"),
        F.col("scoring.p99_score.value").alias("p99_score"),
        F.col("scoring.p99_score.cut_triggered").alias("p99_cut"),
        F.col("scoring.detection_score.value").alias("detection_score"),
        F.col("scoring.detection_score.rate_component").alias("rate_component"),
        F.col("scoring.detection_score.absolute_penalty").alias("absolute_penalty"),
        F.col("scoring.detection_score.cut_triggered").alias("detection_cut"),
        "scoring.final_score",
    ).withColumns({f"{name}_rate": F.round(f"{name}_rate", 6) for name in ("fraud", "legit", "edge_case")})


@query
def output_checks(spark, sf_dir):
    """Response bodies of all decisions; a few kinds are spoilt by event type."""
    kinds = landed.transactions(spark, sf_dir).select("query_id", "event_type")
    bodies = decision_io.decision_json(topk.decide(landed.fast(spark, sf_dir)))
    value, kind = F.col("value"), F.col("event_type")
    spoilt = (
        F.when(kind == "error", F.expr("left(value, length(value) - 1)"))
        .when(kind == "signup", F.regexp_replace(value, "true|false", '"true"'))
        .when(kind == "click", F.regexp_replace(value, '"fraud_score":[0-9.]+', '"fraud_score":null'))
        .otherwise(value)
    )
    rows = bodies.join(kinds, "query_id").select("query_id", spoilt.alias("value"))
    return evaluate.output_checks(rows)


# Ranking


@query
def nearest_centroid(spark, sf_dir):
    assigned = clustering.nearest_centroid(
        landed.references(spark, sf_dir),
        landed.index(spark, sf_dir).table,
    )
    return assigned.select("ref_id", "cluster_id", "centroid_dist")


@query
def topk_neighbors(spark, sf_dir):
    neighbours = ivf.fast_neighbors(
        landed.queries(spark, sf_dir),
        landed.index(spark, sf_dir),
        params=landed.PROBES,
        skip_self=True,
    )
    return neighbours.select("query_id", "rank", "ref_id", "dist", "fraud")


@query
def probe_select(spark, sf_dir):
    table = landed.index(spark, sf_dir).table
    ranked = probing.with_probes(landed.queries(spark, sf_dir), table, landed.PROBES.full)
    return probing.probe_rows(ranked, 1, landed.PROBES.full).drop("codes")


@query
def probe_params(spark, sf_dir):
    """Out-of-range probe counts, brought into range and applied."""
    table = landed.index(spark, sf_dir).table
    params = ProbeParams(fast=0, full=3).clamped(table.size)
    rows = probing.probe_rows(
        probing.with_probes(landed.queries(spark, sf_dir), table, params.full), 1, params.full
    )
    return rows.select(
        "query_id", "probe_rank", "cluster_id", (F.col("probe_rank") <= params.fast).alias("is_fast")
    )


@query
def topk_merge(spark, sf_dir):
    """Probe ranks 1-4 carried, ranks 5-8 added where they may hold something as near."""
    index, queries = landed.index(spark, sf_dir), landed.queries(spark, sf_dir)
    ranked = probing.with_probes(queries, index.table, 8).select("query_id", "codes", "probes")
    ranked = materialize(ranked, "ranked")
    near = materialize(ivf.nearest_lists(ranked, index, 4, skip_self=True), "near")
    carried = topk.topk_neighbors(topk.listed_candidates(near))
    probes = ivf.in_reach(topk.with_lists(ranked, near), index, 5, 8)
    extra = scan.scan_probes(probes, index.postings, skip_self=True, stored=index.stored)
    merged = topk.topk_merge(carried, extra)
    return merged.select("query_id", "rank", "ref_id", "dist", "fraud")


# Index and search


@query
def train_sample(spark, sf_dir):
    sample = clustering.train_sample(
        landed.references(spark, sf_dir), "ref_id", 500, landed.SEED
    )
    return sample.select("ref_id", "fraud")


def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = clustering.train_sample(
        landed.references(spark, sf_dir), "ref_id", BuildParams().train_rows, landed.SEED
    )
    return materialize(sample, "train")


@query
def kmeans_seed(spark, sf_dir):
    """Seeds drawn from the training sample, all rounds of it."""
    seeds = clustering.kmeans_seed(_train(spark, sf_dir), landed.FITTED, landed.SEED)
    return vec.spread(seeds, "centroid", "c")


@query
def kmeans_fit(spark, sf_dir):
    """Seeding and rounds to the stop rule."""
    build = BuildParams()
    fitted = clustering.kmeans_fit(
        _train(spark, sf_dir), landed.FITTED, build.max_iter, landed.SEED, build.early_stop
    )
    return vec.spread(fitted, "centroid", "c")


@query
def ivf_build(spark, sf_dir):
    """The build from hash-ordered seeds and one round, which the index of the queries holds."""
    references = landed.references(spark, sf_dir)
    params = BuildParams(
        clusters=landed.CLUSTERS, train_rows=1 << 40, max_iter=1, early_stop=0.0, seed=landed.SEED
    )
    built = ivf.build_index(
        references.select("ref_id", "vector", "fraud"), params, seeds=landed.seeds(spark, sf_dir)
    )
    return _codes(built.postings, "cluster_id", "ref_id", "fraud")


@query
def ivf_fast(spark, sf_dir):
    return ivf.fast_votes(
        landed.queries(spark, sf_dir),
        landed.index(spark, sf_dir),
        params=landed.PROBES,
        skip_self=True,
    )


@query
def ivf_adaptive(spark, sf_dir):
    return ivf.adaptive_votes(
        landed.queries(spark, sf_dir), landed.index(spark, sf_dir), landed.PROBES, skip_self=True
    )


@query
def score_all(spark, sf_dir):
    return score_transactions(
        _payloads(spark, sf_dir).drop("fraud"),
        landed.index(spark, sf_dir),
        tables.default_mcc_table(spark),
        params=landed.PROBES,
    )


REGISTRY["score_transactions"] = REGISTRY.pop("score_all")


@query
def knn_embeddings(spark, sf_dir):
    coded = materialize(
        vec.with_reference_codes(tx.embeddings(spark, sf_dir)), "embeddings"
    )
    queries = coded.withColumnRenamed("ref_id", "query_id")
    found = knn.knn_exact(queries, coded, dim=EMBEDDING_DIM, skip_self=True)
    return found.select("query_id", "rank", "ref_id", "dist", "fraud")


# Queries without a plain SQL twin: none.
NO_SQL: set[str] = set()
