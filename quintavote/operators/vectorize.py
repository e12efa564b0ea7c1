"""Typed transaction columns to the 14-dimensional vector."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quintavote.config import DIM, Normalization
from quintavote.functions import features as f
from quintavote.functions.parsing import is_true, iso8601z, parse_number
from quintavote.functions.quantize import query_codes, reference_codes
from quintavote.operators.payload import accepted, json_extract, parse_fields


# Codes up to this number are broadcast: as many as four digits allow.
MAX_BROADCAST_CODES = 10_000


@dataclass(frozen=True)
class RiskLookup:
    """Risk by code, known to hold one row a code, and whether it is small."""

    table: DataFrame
    small: bool

    @classmethod
    def of(cls, table: DataFrame | RiskLookup) -> RiskLookup:
        """Check a table (mcc, risk) in one job; a code that stands in it twice is refused.

        It would else double every transaction that carries it.
        """
        if isinstance(table, RiskLookup):
            return table
        rows, codes = table.agg(F.count("mcc"), F.count_distinct("mcc")).first()
        if codes < rows:
            raise ValueError("the risk table holds a code more than once")
        return cls(table, rows <= MAX_BROADCAST_CODES)


def with_mcc_risk(df: DataFrame, mcc_table: DataFrame | RiskLookup) -> DataFrame:
    """Add ``mcc_risk``: the table's value for a listed code, else the default.

    The table is broadcast if it is as small as four-digit codes are, else joined by code.
    """
    lookup = RiskLookup.of(mcc_table)
    risks = lookup.table.select("mcc", F.col("risk").alias("_risk")).where("mcc IS NOT NULL")
    joined = df.join(F.broadcast(risks) if lookup.small else risks.hint("merge"), "mcc", "left")
    return joined.withColumn("mcc_risk", f.mcc_dim(F.col("_risk"))).drop("_risk")


def with_last(parsed: DataFrame) -> DataFrame:
    """Add the parsed fields of the last transaction, which several features read."""
    return parsed.withColumns(
        {
            "_last_at": iso8601z(F.col("last_transaction.timestamp")),
            "_last_km": parse_number(F.col("last_transaction.km_from_current")),
        }
    )


def dimensions(norm: Normalization) -> list[Column]:
    """The feature expressions, in vector order, over parsed columns and those of ``with_last``."""
    amount, now = F.col("amount"), F.col("requested_at")
    last, last_km = F.col("_last_at"), F.col("_last_km")
    return [
        f.ratio_dim(amount, norm.max_amount),
        f.ratio_dim(F.col("installments"), norm.max_installments),
        f.amount_ratio(amount, F.col("customer_avg"), norm.amount_vs_avg_ratio),
        f.hour_dim(now),
        f.dow_dim(now),
        f.elapsed_dim(last, last_km, now, norm.max_minutes),
        f.travel_dim(last, last_km, norm.max_km),
        f.ratio_dim(F.col("km_from_home"), norm.max_km),
        f.ratio_dim(F.col("tx_count_24h"), norm.max_tx_count_24h),
        is_true(F.col("is_online")),
        is_true(F.col("card_present")),
        f.unknown_merchant(F.col("known_merchants"), F.col("merchant_id")),
        F.col("mcc_risk"),
        f.ratio_dim(F.col("merchant_avg"), norm.max_merchant_avg_amount),
    ]


def vectorize(
    parsed: DataFrame,
    mcc_table: DataFrame | RiskLookup,
    norm: Normalization = Normalization(),
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``keep`` columns plus ``vector`` for every accepted row of ``parsed``."""
    rows = with_mcc_risk(with_last(accepted(parsed)), mcc_table)
    return rows.select(*keep, F.array(*dimensions(norm)).alias("vector"))


def vectorize_payloads(
    transactions: DataFrame,
    mcc_table: DataFrame | RiskLookup,
    norm: Normalization = Normalization(),
    keep: tuple[str, ...] = ("query_id",),
    payload: str = "payload",
) -> DataFrame:
    """JSON payload rows to vectors; rows that cannot be scored drop out."""
    parsed = transactions.transform(json_extract, payload).transform(parse_fields)
    return vectorize(parsed, mcc_table, norm, keep)


def with_query_codes(df: DataFrame) -> DataFrame:
    return df.withColumn("codes", query_codes("vector"))


def with_reference_codes(df: DataFrame) -> DataFrame:
    """Add ``codes``; a component beyond the sixteen-bit range is an error."""
    complaint = F.lit("reference component does not fit sixteen bits")
    coded = df.withColumn("codes", reference_codes("vector"))
    fits = ~F.exists("codes", lambda code: code.isNull())
    return coded.withColumn(
        "codes", F.when(fits, F.col("codes")).otherwise(F.raise_error(complaint))
    )


def spread(df: DataFrame, array: str, prefix: str, dim: int = DIM) -> DataFrame:
    """One column per component, for flat outputs."""
    kept = [c for c in df.columns if c != array]
    return df.selectExpr(*kept, *[f"{array}[{i}] AS {prefix}{i}" for i in range(dim)])
