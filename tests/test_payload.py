import copy
import json

import pytest
from pyspark.sql import functions as F

from quintavote.operators.payload import (
    REQUIRED,
    PATHS,
    accepted,
    json_extract,
    parse_fields,
    rejected,
)
from quintavote.operators import vectorize
from quintavote.operators.vectorize import vectorize_payloads, with_mcc_risk
from quintavote.sources.tables import default_mcc_table

GOOD = {
    "id": "pay-88",
    "transaction": {"amount": 1250.4, "installments": 6, "requested_at": "2026-03-18T09:45:10Z"},
    "customer": {
        "avg_amount": 416.8,
        "tx_count_24h": 7,
        "known_merchants": ["SHOP-31", "SHOP-07"],
    },
    "merchant": {"id": "SHOP-07", "mcc": "5944", "avg_amount": 820.5},
    "terminal": {"is_online": True, "card_present": True, "km_from_home": 250.25},
    "last_transaction": {"timestamp": "2026-03-18T06:15:10Z", "km_from_current": 42.5},
}
# A Wednesday, three times the usual amount, 210 minutes after the last payment.
EXPECTED = [
    0.12504, 0.5, 0.3, 9 / 23, 2 / 6, 210 / 1440, 0.0425, 0.25025,
    0.35, 1.0, 1.0, 0.0, 0.45, 0.08205,
]
DROP = object()


def changed(path, value):
    document = copy.deepcopy(GOOD)
    *parents, leaf = path.split(".")
    target = document
    for name in parents:
        target = target[name]
    if value is DROP:
        del target[leaf]
    else:
        target[leaf] = value
    return document


# name -> (document or raw text, {dimension: value})
VECTOR_CASES = {
    "as is": (GOOD, dict(enumerate(EXPECTED))),
    "numeric string": (changed("transaction.amount", "12.5"), {0: 0.00125}),
    "exponent": (changed("transaction.amount", 1.5e3), {0: 0.15}),
    "negative amount": (changed("transaction.amount", -5), {0: 0.0, 2: 0.0}),
    "amount above limit": (changed("transaction.amount", 20_000), {0: 1.0, 2: 1.0}),
    "fractional installments": (changed("transaction.installments", 3.6), {1: 0.3}),
    "zero average": (changed("customer.avg_amount", 0), {2: 0.0}),
    "negative average": (changed("customer.avg_amount", -1), {2: 0.0}),
    "midnight monday": (changed("transaction.requested_at", "2026-03-09T00:00:00Z"), {3: 0, 4: 0}),
    "late sunday": (changed("transaction.requested_at", "2026-03-15T23:59:59Z"), {3: 1, 4: 1}),
    "leap day": (changed("transaction.requested_at", "2024-02-29T12:00:00Z"), {4: 3 / 6}),
    "last missing": (changed("last_transaction", DROP), {5: -1.0, 6: -1.0}),
    "last null": (changed("last_transaction", None), {5: -1.0, 6: -1.0}),
    "last text": (changed("last_transaction", "x"), {5: -1.0, 6: -1.0, 0: EXPECTED[0]}),
    "last list": (changed("last_transaction", [1]), {5: -1.0, 6: -1.0, 13: EXPECTED[13]}),
    "last number": (changed("last_transaction", 7), {5: -1.0, 6: -1.0}),
    "last empty": (changed("last_transaction", {}), {5: -1.0, 6: -1.0}),
    "last unusable": (
        changed("last_transaction", {"timestamp": "x", "km_from_current": "y"}),
        {5: -1.0, 6: -1.0},
    ),
    "only timestamp": (
        changed("last_transaction", {"timestamp": "2026-03-18T06:15:10Z"}),
        {5: 210 / 1440, 6: 0.0},
    ),
    "only km": (changed("last_transaction", {"km_from_current": 100}), {5: 0.0, 6: 0.1}),
    "bad timestamp": (
        changed("last_transaction", {"timestamp": "2026-13-18T06:15:10Z", "km_from_current": 100}),
        {5: 0.0, 6: 0.1},
    ),
    "last is later": (
        changed("last_transaction.timestamp", "2026-03-19T00:00:00Z"),
        {5: 0.0, 6: EXPECTED[6]},
    ),
    "last long ago": (changed("last_transaction.timestamp", "2020-01-01T00:00:00Z"), {5: 1.0}),
    "no known list": (changed("customer.known_merchants", DROP), {11: 1.0}),
    "null known list": (changed("customer.known_merchants", None), {11: 1.0}),
    "empty known list": (changed("customer.known_merchants", []), {11: 1.0}),
    "known list is text": (changed("customer.known_merchants", "SHOP-07"), {11: 1.0, 8: 0.35}),
    "known list of null": (changed("customer.known_merchants", [None]), {11: 1.0}),
    "null beside match": (changed("customer.known_merchants", [None, "SHOP-07"]), {11: 0.0}),
    "other case": (changed("customer.known_merchants", ["shop-07"]), {11: 1.0}),
    "short mcc": (changed("merchant.mcc", "12"), {12: 0.5}),
    "mixed mcc": (changed("merchant.mcc", "54a1"), {12: 0.5}),
    "unlisted mcc": (changed("merchant.mcc", "9999"), {12: 0.5}),
    "online missing": (changed("terminal.is_online", DROP), {9: 0.0}),
    "card missing": (changed("terminal.card_present", DROP), {10: 0.0}),
    "online as text": (changed("terminal.is_online", "true"), {9: 1.0}),
    "online in capitals": (changed("terminal.is_online", "TRUE"), {9: 0.0}),
    "id missing": (changed("id", DROP), {0: EXPECTED[0]}),
}

REJECT_CASES = {
    **{
        f"no {name}": (changed(PATHS[name], DROP), f"missing {name}") for name in REQUIRED
    },
    **{
        f"null {name}": (changed(PATHS[name], None), f"missing {name}") for name in REQUIRED
    },
    "word amount": (changed("transaction.amount", "abc"), "unreadable amount"),
    "spaced amount": (changed("transaction.amount", " 1 "), "unreadable amount"),
    "suffixed amount": (changed("transaction.amount", "1d"), "unreadable amount"),
    "nan amount": (changed("transaction.amount", "NaN"), "unreadable amount"),
    "huge amount": (changed("transaction.amount", "1e400"), "unreadable amount"),
    "offset": (
        changed("transaction.requested_at", "2026-03-18T09:45:10+00:00"),
        "unreadable requested_at",
    ),
    "fraction": (
        changed("transaction.requested_at", "2026-03-18T09:45:10.1Z"),
        "unreadable requested_at",
    ),
    "month 13": (
        changed("transaction.requested_at", "2026-13-18T09:45:10Z"),
        "unreadable requested_at",
    ),
    "30 February": (
        changed("transaction.requested_at", "2026-02-30T09:45:10Z"),
        "unreadable requested_at",
    ),
    "truncated": (json.dumps(GOOD)[:-40], None),
    "not json": ("hello", "missing amount"),
    "empty": ("", "missing amount"),
}


def frame(spark, cases):
    rows = [
        (name, body if isinstance(body, str) else json.dumps(body))
        for name, (body, _) in cases.items()
    ]
    return spark.createDataFrame(rows, "query_id string, payload string")


@pytest.fixture(scope="module")
def vectors(spark):
    df = vectorize_payloads(frame(spark, VECTOR_CASES), default_mcc_table(spark))
    return {row["query_id"]: row["vector"] for row in df.collect()}


@pytest.mark.parametrize("name", VECTOR_CASES)
def test_vector(vectors, name):
    for dimension, value in VECTOR_CASES[name][1].items():
        assert vectors[name][dimension] == pytest.approx(value, abs=1e-12), dimension


def test_rejects_carry_their_reason(spark):
    parsed = frame(spark, REJECT_CASES).transform(json_extract).transform(parse_fields)
    reasons = {r["query_id"]: r["reject_reason"] for r in rejected(parsed, "query_id").collect()}
    assert set(reasons) == set(REJECT_CASES)
    for name, (_, wanted) in REJECT_CASES.items():
        if wanted:
            assert reasons[name] == wanted, name


def test_every_row_is_accepted_or_rejected(spark):
    rows = frame(spark, {**VECTOR_CASES, **REJECT_CASES})
    parsed = rows.transform(json_extract).transform(parse_fields)
    good = {r["query_id"] for r in accepted(parsed).select("query_id").collect()}
    bad = {r["query_id"] for r in rejected(parsed, "query_id").collect()}
    assert good == set(VECTOR_CASES) and bad == set(REJECT_CASES)


def test_document_is_parsed_once(spark):
    """A filter on parsed fields must not repeat the parse per field."""
    df = vectorize_payloads(frame(spark, VECTOR_CASES), default_mcc_table(spark))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_each_token_is_parsed_once(spark):
    """Neither the filter on rejects nor several features of one field parse it again."""
    found = vectorize_payloads(frame(spark, VECTOR_CASES), default_mcc_table(spark))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # A condition and a value for each; a number's size is looked at as well.
    numbers, instants = 7, 2
    assert plan.count("RLIKE(") == numbers + instants
    assert plan.count("as timestamp)") == instants and plan.count("as double)") <= 2 * numbers + 6


def test_null_payload_is_rejected(spark):
    df = spark.range(1).select(F.col("id").alias("query_id"), F.lit(None).cast("string").alias("payload"))
    parsed = df.transform(json_extract).transform(parse_fields)
    assert rejected(parsed, "query_id").count() == 1


def test_a_repeated_code_is_refused(spark):
    table = spark.createDataFrame([("5411", 0.1), ("5411", 0.2)], "mcc string, risk double")
    with pytest.raises(ValueError, match="more than once"):
        with_mcc_risk(spark.createDataFrame([("5411",)], "mcc string"), table)


def test_a_large_risk_table_is_not_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([("5411",), ("9",), (None,)], "mcc string")
    table = spark.createDataFrame([("5411", 0.1), (None, 0.9), (None, 0.8)], "mcc string, risk double")
    wanted = [(None, 0.5), ("5411", 0.1), ("9", 0.5)]

    def found(df):
        return sorted(((r["mcc"], r["mcc_risk"]) for r in df.collect()), key=str), df._jdf.queryExecution().executedPlan().toString()

    near, plan = found(with_mcc_risk(rows, table))
    assert near == sorted(wanted, key=str) and "BroadcastHashJoin" in plan
    monkeypatch.setattr(vectorize, "MAX_BROADCAST_CODES", 0)
    near, plan = found(with_mcc_risk(rows, table))
    assert near == sorted(wanted, key=str) and "Broadcast" not in plan and "SortMergeJoin" in plan
