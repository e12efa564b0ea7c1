"""Payload fields derived from the ``events`` table.

Every event is a transaction to score and a labelled one to compare with.  The
engine is handed these fields ready-made; deriving them belongs to the
testbed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quintavote.config import MCC_RISK, SCALE
from quintavote.operators.vectorize import vectorize_payloads, with_query_codes
from quintavote.sources.tables import default_mcc_table

_DAY = 86_400
# What stands at a second: the begin of a later one's 24 hours, events of the day before, of the day.
_BEGIN, _CONTEXT, _OWN = 0, 1, 2
MERCHANTS = 60
# By merchant number modulo 12: the listed codes, then two that have no risk.
MCC_CYCLE = [*MCC_RISK, "9999", "12"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _epoch_second(ts: Column) -> Column:
    """From the wall-clock fields, so that the session zone does not matter."""
    return (
        F.unix_date(F.to_date(ts)).cast("bigint") * _DAY
        + F.hour(ts) * 3_600
        + F.minute(ts) * 60
        + F.second(ts)
    )


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = events(spark, sf_dir), F.col("event_id")
    return e.select(
        k.alias("k"),
        F.col("user_id").alias("u"),
        _epoch_second(F.col("ts")).alias("sec"),
        "event_type",
        "value",
        F.round(F.col("value") * 20 * 100).cast("bigint").alias("cents"),
        F.pmod(k * 7, F.lit(MERCHANTS)).cast("int").alias("m"),
    )


def merchant_id(number: Column) -> Column:
    return F.concat(F.lit("MERC-"), F.lpad(number.cast("string"), 3, "0"))


def _with_history(keyed: DataFrame) -> DataFrame:
    """Add the 24-hour count and the previous transaction's second.

    Seconds stand for their events, of which there may be many.  A user may own a third of
    all events, so windows run per user and day; each day also sees the day before it as
    context.  A second's 24 hours are the events up to it less those up to where they begin:
    two running sums, as a frame that slides would be added up anew for every row.  What lies
    further back is the last event of an earlier day, taken from one row per user and day.
    """
    seconds = keyed.groupBy("u", "sec").agg(F.count("*").alias("n")).withColumn("day", F.floor(F.col("sec") / _DAY))
    day, sec, n = F.col("day"), F.col("sec"), F.col("n")

    def mark(chunk: Column, at: Column, kind: int, events: Column) -> Column:
        return F.struct(
            chunk.alias("chunk"), at.alias("at"), F.lit(kind).alias("kind"), events.alias("events")
        )

    nothing = F.lit(0).cast("bigint")
    marks = F.inline(
        F.array(mark(day, sec - _DAY, _BEGIN, nothing), mark(day + 1, sec, _CONTEXT, n), mark(day, sec, _OWN, n))
    )
    kind = F.col("kind")
    in_order = Window.partitionBy("u", "chunk").orderBy("at", "kind")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    recent = (
        seconds.select("u", "sec", marks)
        .withColumn("running", F.sum("events").over(so_far))
        .withColumn("near", F.max(F.when(kind != _BEGIN, F.col("at"))).over(before))
        .filter(kind != _CONTEXT)
        .groupBy("u", "chunk", "sec")
        .agg(
            (F.max(F.when(kind == _OWN, F.col("running"))) - F.max(F.when(kind == _BEGIN, F.col("running")))).alias(
                "tx_count_24h"
            ),
            F.max(F.when(kind == _OWN, F.col("near"))).alias("near"),
        )
        .withColumnRenamed("chunk", "day")
    )
    daily = seconds.groupBy("u", "day").agg(F.max("sec").alias("last_sec"))
    by_user = Window.partitionBy("u").orderBy("day")
    earlier = daily.select("u", "day", F.lag("last_sec").over(by_user).alias("far"))
    history = recent.join(earlier, ["u", "day"]).select("u", "sec", "tx_count_24h", F.coalesce("near", "far").alias("_last"))
    turn = F.row_number().over(Window.partitionBy("u", "sec").orderBy("k"))
    # Every second has its history; the left join keeps events in their order.
    return (
        keyed.where("u IS NOT NULL AND sec IS NOT NULL")
        .withColumn("_turn", turn)
        .join(history, ["u", "sec"], "left")
        .withColumn("last_sec", F.when(F.col("_turn") > 1, sec).otherwise(F.col("_last")))
        .drop("_turn", "_last")
    )


def _instant(seconds: Column) -> Column:
    """Epoch seconds as ``YYYY-MM-DDTHH:MM:SSZ``."""

    def two(value: Column) -> Column:
        return F.lpad(value.cast("string"), 2, "0")

    date = F.date_from_unix_date(F.floor(seconds / _DAY).cast("int")).cast("string")
    rest = F.pmod(seconds, F.lit(_DAY)).cast("int")
    hour, minute, second = F.floor(rest / 3_600), F.floor(rest % 3_600 / 60), rest % 60
    return F.concat(
        date, F.lit("T"), two(hour), F.lit(":"), two(minute), F.lit(":"), two(second), F.lit("Z")
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event with all payload fields as flat columns."""
    keyed = _keyed(spark, sf_dir)
    users = keyed.groupBy("u").agg(
        (F.sum("cents") / (F.count("*") * 100)).alias("customer_avg"),
        F.array_sort(F.collect_set(F.when(F.col("k") % 3 == 0, F.col("m")))).alias("known"),
    )
    shops = keyed.groupBy("m").agg(
        (F.sum("cents") / (F.count("*") * 100)).alias("merchant_avg")
    )
    k = F.col("k")
    cycle = F.array(*[F.lit(code) for code in MCC_CYCLE])
    return (
        _with_history(keyed)
        .join(users, "u")
        .join(F.broadcast(shops), "m")  # one row per merchant number
        .select(
            k.alias("query_id"),
            (F.col("cents") / 100).alias("amount"),
            (k % 12 + 1).alias("installments"),
            _instant(F.col("sec")).alias("requested_at"),
            "customer_avg",
            "tx_count_24h",
            F.transform("known", merchant_id).alias("known_merchants"),
            merchant_id(F.col("m")).alias("merchant_id"),
            F.element_at(cycle, F.col("m") % len(MCC_CYCLE) + 1).alias("mcc"),
            "merchant_avg",
            F.col("event_type").isin("click", "view").alias("is_online"),
            (F.col("event_type") == "purchase").alias("card_present"),
            (k * 37 % 1200 + 0.5).alias("km_from_home"),
            _instant(F.col("last_sec")).alias("last_timestamp"),
            F.when(F.col("last_sec").isNotNull(), k * 53 % 1100).alias("last_km"),
            "event_type",
            "value",
            ((F.col("value") > 60) | (F.col("event_type") == "error")).cast("int").alias("fraud"),
        )
    )


def payload_document(**overrides: Column) -> Column:
    """The nested JSON document over the flat columns; overrides replace fields."""

    def field(name: str, alias: str) -> Column:
        return overrides.get(name, F.col(name)).alias(alias)

    last = F.when(
        F.col("last_timestamp").isNotNull(),
        F.struct(
            field("last_timestamp", "timestamp"), field("last_km", "km_from_current")
        ),
    )
    return F.to_json(
        F.struct(
            F.concat(F.lit("tx-"), F.col("query_id")).alias("id"),
            F.struct(
                field("amount", "amount"),
                field("installments", "installments"),
                field("requested_at", "requested_at"),
            ).alias("transaction"),
            F.struct(
                field("customer_avg", "avg_amount"),
                field("tx_count_24h", "tx_count_24h"),
                field("known_merchants", "known_merchants"),
            ).alias("customer"),
            F.struct(
                field("merchant_id", "id"),
                field("mcc", "mcc"),
                field("merchant_avg", "avg_amount"),
            ).alias("merchant"),
            F.struct(
                field("is_online", "is_online"),
                field("card_present", "card_present"),
                field("km_from_home", "km_from_home"),
            ).alias("terminal"),
            overrides.get("last_transaction", last).alias("last_transaction"),
        )
    )


def payloads(flat: DataFrame) -> DataFrame:
    """query_id, payload and the label, from the flat columns."""
    return flat.select("query_id", payload_document().alias("payload"), "fraud")


def vectors(flat: DataFrame) -> DataFrame:
    """query_id, fraud, vector and codes, by way of the JSON documents."""
    scored = vectorize_payloads(
        payloads(flat), default_mcc_table(flat.sparkSession), keep=("query_id", "fraud")
    )
    return with_query_codes(scored)


def references(vectors_df: DataFrame) -> DataFrame:
    """The same rows in the role of labelled references, to four decimals."""
    rounded = F.transform("codes", lambda code: code.cast("double") / float(SCALE))
    return vectors_df.select(
        F.col("query_id").alias("ref_id"), rounded.alias("vector"), "codes", "fraud"
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64-wide embeddings in double precision; labels 0-4 count as fraud."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(
        F.col("vec_id").alias("ref_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
        (F.col("label") < 5).cast("int").alias("fraud"),
    )
