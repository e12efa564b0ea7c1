"""The registered queries as plain SQL over the given tables.

Nothing here comes from the engine but its parameters: features, codes, seeds,
index and search are written out again, and neighbours are found by comparing
all pairs.
"""

from __future__ import annotations

from quintavote.config import DIM, MCC_RISK, BuildParams
from quintavote.testbed.landed import CLUSTERS, FITTED, PROBES, SEED
from quintavote.testbed.transactions import MCC_CYCLE, MERCHANTS

DIMS = range(DIM)
EMBEDDING_DIMS = range(64)


def _list(template: str, dims: range = DIMS, sep: str = ", ") -> str:
    return sep.join(template.format(i=i) for i in dims)


def _clamp(value: str) -> str:
    return f"least(1e0, greatest(0e0, {value}))"


_CYCLE = " ".join(f"WHEN {i} THEN '{code}'" for i, code in enumerate(MCC_CYCLE))
_RISK = " ".join(f"WHEN '{code}' THEN {risk}e0" for code, risk in MCC_RISK.items())
_STAMP = "strftime(make_timestamp({0} * 1000000), '%Y-%m-%dT%H:%M:%SZ')"

# Named queries, each listing what it reads from.
_PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "e": (
        (),
        f"""SELECT event_id AS k, user_id AS u, CAST(floor(epoch(ts)) AS BIGINT) AS sec,
        event_type, value, CAST(round(value * 20 * 100) AS BIGINT) AS cents,
        CAST((event_id * 7) % {MERCHANTS} AS INTEGER) AS m FROM events""",
    ),
    "users": (
        ("e",),
        """SELECT u, CAST(sum(cents) AS DOUBLE) / CAST(count(*) * 100 AS DOUBLE) AS customer_avg,
        list_sort(list(DISTINCT 'MERC-' || lpad(CAST(m AS VARCHAR), 3, '0'))
                  FILTER (WHERE k % 3 = 0)) AS known
        FROM e GROUP BY u""",
    ),
    "shops": (
        ("e",),
        """SELECT m, CAST(sum(cents) AS DOUBLE) / CAST(count(*) * 100 AS DOUBLE) AS merchant_avg
        FROM e GROUP BY m""",
    ),
    "t": (
        ("e", "users", "shops"),
        f"""SELECT k, sec, event_type, value, cents / 100e0 AS amount,
        CAST(k % 12 + 1 AS DOUBLE) AS installments, {_STAMP.format("sec")} AS requested_at,
        customer_avg, coalesce(known, []) AS known,
        count(*) OVER (PARTITION BY u ORDER BY sec
                       RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS tx_count,
        lag(sec) OVER (PARTITION BY u ORDER BY sec, k) AS last_sec,
        'MERC-' || lpad(CAST(m AS VARCHAR), 3, '0') AS merchant_id,
        CASE m % {len(MCC_CYCLE)} {_CYCLE} END AS mcc, merchant_avg,
        event_type IN ('click', 'view') AS is_online, event_type = 'purchase' AS card_present,
        (k * 37) % 1200 + 0.5e0 AS km_from_home, CAST((k * 53) % 1100 AS DOUBLE) AS km,
        CASE WHEN value > 60 OR event_type = 'error' THEN 1 ELSE 0 END AS fraud
        FROM e JOIN users USING (u) JOIN shops USING (m)""",
    ),
    "v": (
        ("t",),
        f"""SELECT k, fraud,
        {_clamp("amount / 10000e0")} AS d0, {_clamp("installments / 12e0")} AS d1,
        CASE WHEN customer_avg > 0
             THEN {_clamp("(amount / customer_avg) / 10e0")} ELSE 0e0 END AS d2,
        floor((sec % 86400) / 3600e0) / 23e0 AS d3,
        (isodow(make_timestamp(sec * 1000000)) - 1) / 6e0 AS d4,
        CASE WHEN last_sec IS NULL THEN -1e0
             ELSE {_clamp("((sec - last_sec) / 60e0) / 1440e0")} END AS d5,
        CASE WHEN last_sec IS NULL THEN -1e0 ELSE {_clamp("km / 1000e0")} END AS d6,
        {_clamp("km_from_home / 1000e0")} AS d7, {_clamp("tx_count / 20e0")} AS d8,
        CASE WHEN is_online THEN 1e0 ELSE 0e0 END AS d9,
        CASE WHEN card_present THEN 1e0 ELSE 0e0 END AS d10,
        CASE WHEN list_contains(known, merchant_id) THEN 0e0 ELSE 1e0 END AS d11,
        CASE mcc {_RISK} ELSE 0.5e0 END AS d12,
        {_clamp("merchant_avg / 10000e0")} AS d13
        FROM t""",
    ),
    "q": (
        ("v",),
        "SELECT k, fraud, "
        + _list("d{i}")
        + ", "
        + _list(
            "CASE WHEN d{i} <= -0.999e0 THEN -10000 ELSE CAST(round("
            + _clamp("d{i}")
            + " * 10000e0) AS BIGINT) END AS q{i}"
        )
        + " FROM v",
    ),
    "r": (
        ("q",),
        "SELECT k, fraud, " + _list("q{i}") + ", " + _list("q{i} / 10000e0 AS r{i}") + " FROM q",
    ),
    "seeds": (
        ("r",),
        f"""SELECT CAST(row_number() OVER (ORDER BY h, k) - 1 AS INTEGER) AS cluster_id,
        {_list("r{i} AS s{i}")}
        FROM (SELECT *, md5('{SEED}-' || k) AS h FROM r ORDER BY h, k LIMIT {CLUSTERS})""",
    ),
    "seeded": (
        ("r", "seeds"),
        "SELECT r.k, arg_min(cluster_id, ("
        + _list("(r{i} - s{i}) * (r{i} - s{i})", sep=" + ")
        + ", cluster_id)) AS cluster_id FROM r, seeds GROUP BY r.k",
    ),
    "means": (
        ("seeds", "seeded", "r"),
        "SELECT seeds.cluster_id, "
        + _list(
            "coalesce(CAST(sum(CAST(round(r{i} * 1e8) AS BIGINT)) AS DOUBLE)"
            " / (count(r.k) * 1e8), 0e0) AS c{i}"
        )
        + """ FROM seeds LEFT JOIN seeded ON seeded.cluster_id = seeds.cluster_id
        LEFT JOIN r ON r.k = seeded.k GROUP BY seeds.cluster_id""",
    ),
    "centroids": (
        ("means",),
        "SELECT *, " + _list("c{i} * c{i}", sep=" + ") + " AS norm_sq FROM means",
    ),
    "nearest": (
        ("r", "centroids"),
        "SELECT r.k, arg_min((cluster_id, d), (d, cluster_id)) AS best FROM"
        " (SELECT r.k, cluster_id, "
        + _list("(r{i} - c{i}) * (r{i} - c{i})", sep=" + ")
        + " AS d FROM r, centroids) AS r GROUP BY r.k",
    ),
    "postings": (
        ("r", "nearest"),
        "SELECT best[1] AS cluster_id, r.k, fraud, "
        + _list("q{i}")
        + ", best[2] AS centroid_dist FROM r JOIN nearest USING (k)",
    ),
    "scores": (
        ("q", "centroids"),
        "SELECT k, cluster_id, norm_sq - 2e0 * ("
        + _list("c{i} * d{i}", sep=" + ")
        + ") AS score FROM q, centroids",
    ),
    "probes": (
        ("scores",),
        f"""SELECT k, cluster_id, probe_rank FROM (SELECT k, cluster_id,
        row_number() OVER (PARTITION BY k ORDER BY score, cluster_id) AS probe_rank FROM scores)
        WHERE probe_rank <= {PROBES.full}""",
    ),
    "visits": (
        ("q", "probes", "postings"),
        "SELECT q.k, probe_rank, probes.cluster_id, p.k AS ref_id, p.fraud, "
        + _list("(q.q{i} - p.q{i}) * (q.q{i} - p.q{i})", sep=" + ")
        + """ AS dist FROM q JOIN probes ON probes.k = q.k
        JOIN postings p ON p.cluster_id = probes.cluster_id AND p.k <> q.k""",
    ),
    "fast5": (
        ("visits",),
        f"""SELECT k, unnest(arg_min((dist, ref_id, fraud), (dist, ref_id), 5)) AS n
        FROM visits WHERE probe_rank <= {PROBES.fast} GROUP BY k""",
    ),
    "wide5": (
        ("visits",),
        """SELECT k, unnest(arg_min((dist, ref_id, fraud), (dist, ref_id), 5)) AS n
        FROM visits GROUP BY k""",
    ),
    "fast": (
        ("q", "fast5"),
        """SELECT q.k, CAST(coalesce(sum(n[3]), 0) AS INTEGER) AS votes
        FROM q LEFT JOIN fast5 ON fast5.k = q.k GROUP BY q.k""",
    ),
    "wide": (
        ("q", "wide5"),
        """SELECT q.k, CAST(coalesce(sum(n[3]), 0) AS INTEGER) AS votes
        FROM q LEFT JOIN wide5 ON wide5.k = q.k GROUP BY q.k""",
    ),
    "adaptive": (
        ("fast", "wide"),
        """SELECT k, CASE WHEN fast.votes IN (2, 3) THEN wide.votes ELSE fast.votes END AS votes,
        fast.votes AS fast_votes, fast.votes IN (2, 3) AS expanded
        FROM fast JOIN wide USING (k)""",
    ),
    "exact5": (
        ("q",),
        "SELECT k, unnest(arg_min((dist, ref_id, fraud), (dist, ref_id), 5)) AS n FROM"
        " (SELECT a.k, b.k AS ref_id, b.fraud, "
        + _list("(a.q{i} - b.q{i}) * (a.q{i} - b.q{i})", sep=" + ")
        + " AS dist FROM q a JOIN q b ON a.k <> b.k) GROUP BY k",
    ),
    "decided": (
        ("fast",),
        "SELECT k, votes, votes / 5e0 AS fraud_score, votes < 3 AS approved FROM fast",
    ),
    "outcomes": (
        ("t", "adaptive"),
        """SELECT t.k, t.event_type, t.fraud = 0 AS expected_approved,
        CASE WHEN t.value <= 200 THEN a.votes < 3 END AS approved
        FROM t JOIN adaptive a ON a.k = t.k""",
    ),
    "matrix": (
        ("outcomes",),
        """SELECT count(*) FILTER (WHERE approved = expected_approved AND NOT approved) AS tp,
        count(*) FILTER (WHERE approved = expected_approved AND approved) AS tn,
        count(*) FILTER (WHERE approved <> expected_approved AND NOT approved) AS fp,
        count(*) FILTER (WHERE approved <> expected_approved AND approved) AS fn,
        count(*) FILTER (WHERE approved IS NULL) AS errors FROM outcomes""",
    ),
    "weighted": (
        ("matrix",),
        """SELECT *, tp + tn + fp + fn + errors AS n,
        fp + 3 * fn + 5 * errors AS weighted_errors,
        (fp + 3 * fn + 5 * errors) / CAST(tp + tn + fp + fn + errors AS DOUBLE) AS error_rate,
        (fp + fn + errors) / CAST(tp + tn + fp + fn + errors AS DOUBLE) AS failure_rate
        FROM matrix""",
    ),
    "p99": ((), "SELECT quantile_cont(value, 0.99) AS p99 FROM events"),
    "figures": (
        ("weighted", "p99"),
        """SELECT *, failure_rate > 0.15e0 AS detection_cut,
        CASE WHEN p99 <= 0 THEN 0e0 WHEN p99 > 2000 THEN -3000e0
             ELSE 1000e0 * log10(1000e0 / greatest(p99, 1e0)) END AS p99_score,
        CASE WHEN failure_rate > 0.15e0 THEN -3000e0
             ELSE 1000e0 * log10(1e0 / greatest(error_rate, 0.001e0))
                  - 300e0 * log10(1e0 + weighted_errors) END AS detection_score
        FROM weighted, p99""",
    ),
    "emb": (
        (),
        "SELECT vec_id AS k, CASE WHEN label < 5 THEN 1 ELSE 0 END AS fraud, "
        + ", ".join(
            f"CAST(round(CAST(embedding[{i + 1}] AS DOUBLE) * 10000e0) AS BIGINT) AS q{i}"
            for i in EMBEDDING_DIMS
        )
        + " FROM embeddings",
    ),
    "emb5": (
        ("emb",),
        "SELECT k, unnest(arg_min((dist, ref_id, fraud), (dist, ref_id), 5)) AS n FROM"
        " (SELECT a.k, b.k AS ref_id, b.fraud, "
        + _list("(a.q{i} - b.q{i}) * (a.q{i} - b.q{i})", EMBEDDING_DIMS, " + ")
        + " AS dist FROM emb a JOIN emb b ON a.k <> b.k) GROUP BY k",
    ),
}



def _training() -> tuple[str, str]:
    """Seeding and Lloyd rounds as parts; returns the names of the last seeds and centroids."""
    build = BuildParams()
    _PARTS["sample"] = (
        ("r",),
        f"SELECT * FROM r ORDER BY md5('{SEED}-' || k), k LIMIT {build.train_rows}",
    )
    center = _list("r{i} AS c{i}")
    vector = _list("r{i}")
    _PARTS["s0"] = (
        ("sample",),
        f"SELECT 0 AS cluster_id, {center} FROM sample ORDER BY md5('{SEED}-' || k), k LIMIT 1",
    )
    gap = _list("(r{i} - c{i}) * (r{i} - c{i})", sep=" + ")
    turn, held = 0, 1
    while held < FITTED:
        turn += 1
        add = min(held, FITTED - held)
        even = f"(CAST('0x' || substr(md5('{SEED}-{turn}-' || k), 1, 12) AS BIGINT) + 1) / CAST({1 << 48} AS DOUBLE)"
        _PARTS[f"s{turn}"] = (
            ("sample", f"s{turn - 1}"),
            f"""SELECT cluster_id, {_list("c{i}")} FROM s{turn - 1} UNION ALL
            SELECT CAST({held} + row_number() OVER (ORDER BY f) - 1 AS INTEGER), {vector} FROM (
              SELECT {vector}, min({{'race': -ln({even}) / d, 'k': k}}) AS f FROM (
                SELECT sample.k, min({gap}) AS d FROM sample, s{turn - 1} GROUP BY sample.k
              ) JOIN sample USING (k) WHERE d > 0 GROUP BY {vector} ORDER BY f LIMIT {add})""",
        )
        held += add
        _SHARED.add(f"s{turn}")
    _SHARED.update(("sample", "s0"))
    seeds = f"s{turn}"
    _PARTS["l0"] = ((seeds,), f"SELECT *, false AS stopped FROM {seeds}")
    _SHARED.add("l0")
    moved = _list("(n{i} - c{i}) * (n{i} - c{i})", sep=" + ")
    for t in range(build.max_iter):
        mean = _list(
            "coalesce(CAST(sum(CAST(round(r{i} * 1e8) AS BIGINT)) AS DOUBLE) / (count(k) * 1e8), 0e0) AS n{i}"
        )
        _PARTS[f"n{t}"] = (
            ("sample", f"l{t}"),
            f"""SELECT l.*, {_list("n{i}")} FROM l{t} l JOIN (
              SELECT cluster_id, {mean} FROM (SELECT cluster_id FROM l{t}) LEFT JOIN (
                SELECT k, arg_min(cluster_id, ({gap}, cluster_id)) AS cluster_id, {_list("any_value(r{i}) AS r{i}")}
                FROM sample, l{t} GROUP BY k) USING (cluster_id) GROUP BY cluster_id) USING (cluster_id)""",
        )
        _PARTS[f"l{t + 1}"] = (
            (f"n{t}",),
            f"""SELECT cluster_id, {_list("CASE WHEN stopped THEN c{i} ELSE n{i} END AS c{i}")},
            stopped OR avg(CASE WHEN {moved} > 1e-10 THEN 1e0 ELSE 0e0 END) OVER () < {build.early_stop} AS stopped
            FROM n{t}""",
        )
        _SHARED.update((f"n{t}", f"l{t + 1}"))
    return seeds, f"l{build.max_iter}"


# Parts that several later parts read: computed once per statement.
_SHARED = {"t", "q", "r", "centroids", "postings", "probes", "visits", "adaptive", "outcomes"}


def _with(final: str, *needed: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for parent in _PARTS[name][0]:
            add(parent)
        if name not in order:
            order.append(name)

    for name in needed:
        add(name)
    parts = []
    for name in order:
        hint = "MATERIALIZED " if name in _SHARED else ""
        parts.append(f'"{name}" AS {hint}({_PARTS[name][1]})')
    return "WITH " + ",\n".join(parts) + "\n" + final


def _ranked(part: str, *kept: str) -> str:
    """Neighbour lists as rows with their rank."""
    return f"""SELECT k AS query_id,
    CAST(row_number() OVER (PARTITION BY k ORDER BY n[1], n[2]) AS INTEGER) AS rank,
    n[2] AS ref_id, CAST(n[1] AS BIGINT) AS dist, n[3] AS fraud FROM {part}"""


def _variant(*cases: str) -> str:
    arms = " ".join(f"WHEN {i} THEN {case}" for i, case in enumerate(cases))
    return f"CASE k % {len(cases)} {arms} END"


_REQUIRED_NAMES = (
    "amount",
    "installments",
    "requested_at",
    "customer_avg",
    "tx_count_24h",
    "merchant_id",
    "mcc",
    "merchant_avg",
    "km_from_home",
)
_SCORED = "SELECT k AS query_id, votes, votes / 5e0 AS fraud_score, votes < 3 AS approved FROM "
_SPOILT = (
    "SELECT query_id, votes, fraud_score, approved, NULL AS reject_reason FROM ("
    + _SCORED
    + """scored) WHERE query_id % 10 NOT IN (4, 7) UNION ALL
    SELECT k, NULL, NULL, NULL, CASE k % 10 WHEN 4 THEN 'missing amount' ELSE 'unreadable amount' END
    FROM t WHERE k % 10 IN (4, 7)"""
)
_LAST_STAMP = _STAMP.format("last_sec")
_D5 = _clamp("((sec - last_sec) / 60e0) / 1440e0")
_D6 = _clamp("km / 1000e0")
_NO_LAST = "last_sec IS NULL"

# Unlike the votes elsewhere, scoring does not set the transaction itself aside.
_PARTS["self_visits"] = (
    ("q", "probes", "postings"),
    _PARTS["visits"][1].replace(" AND p.k <> q.k", ""),
)
for _name, _limit in (("self_fast", PROBES.fast), ("self_full", PROBES.full)):
    _PARTS[_name] = (
        ("self_visits",),
        f"""SELECT k, CAST(sum(n[2]) AS INTEGER) AS votes FROM (SELECT k,
        unnest(arg_min((dist, fraud), (dist, ref_id), 5)) AS n
        FROM self_visits WHERE probe_rank <= {_limit} GROUP BY k) GROUP BY k""",
    )
_PARTS["scored"] = (
    ("self_fast", "self_full"),
    """SELECT k, CASE WHEN a.votes IN (2, 3) THEN b.votes ELSE a.votes END AS votes
    FROM self_fast a JOIN self_full b USING (k)""",
)
_SHARED.add("self_visits")


def statements() -> dict[str, str]:
    drawn, fitted = _training()
    norm = _list("c{i} * c{i}", sep=" + ")
    codes = _list("CAST(q{i} AS INTEGER) AS q{i}")
    sql = {
        "ref_scan": _with(
            f"SELECT row_number() OVER (ORDER BY k) - 1 AS ref_id, fraud, {codes} FROM r", "r"
        ),
        "norm_params": _with(
            f"""SELECT k AS query_id, {_clamp("amount / 5000e0")} AS d0,
            {_clamp("installments / 6e0")} AS d1, {_clamp("km_from_home / 400e0")} AS d7 FROM t""",
            "t",
        ),
        "mcc_table": _with(
            """SELECT lpad(mcc, 4, '0') AS mcc, CAST(sum(fraud) AS DOUBLE) / count(*) AS risk
            FROM t GROUP BY 1""",
            "t",
        ),
        "txn_scan": _with(
            f"""SELECT row_number() OVER (ORDER BY k) - 1 AS query_id, amount, requested_at,
            merchant_id, CAST(len(known) AS INTEGER) AS known_count,
            {_LAST_STAMP} AS last_timestamp FROM t""",
            "t",
        ),
        "stream_score": _with(_SPOILT, "scored", "t"),
        "score_and_rejects": _with(_SPOILT, "scored", "t"),
        "decision_sink": _with(
            """SELECT k AS query_id, '{"approved":' || CAST(approved AS VARCHAR)
            || ',"fraud_score":' || CAST(fraud_score AS VARCHAR) || '}' AS value FROM decided""",
            "decided",
        ),
        "index_write": _with(
            """SELECT cluster_id, count(*) AS members, CAST(sum(fraud) AS BIGINT) AS frauds
            FROM postings GROUP BY cluster_id""",
            "postings",
        ),
        "index_read": _with(
            f"SELECT cluster_id, k AS ref_id, fraud, {codes}, norm_sq"
            " FROM postings JOIN centroids USING (cluster_id)",
            "postings",
            "centroids",
        ),
        "eval_scan": _with(
            """SELECT row_number() OVER (ORDER BY k) - 1 AS query_id, amount, requested_at,
            fraud = 0 AS expected_approved FROM t""",
            "t",
        ),
        "json_extract": _with(
            f"""SELECT k AS query_id, amount, installments, customer_avg,
            CAST(tx_count AS DOUBLE) AS tx_count_24h, merchant_avg, km_from_home, requested_at,
            merchant_id, mcc, CAST(is_online AS VARCHAR) AS is_online,
            CAST(card_present AS VARCHAR) AS card_present,
            array_to_string(known, ',') AS known_merchants, {_LAST_STAMP} AS last_timestamp,
            CASE WHEN last_sec IS NOT NULL THEN km END AS last_km FROM t""",
            "t",
        ),
        "required_filter": "SELECT event_id AS query_id, CASE event_id % 12 "
        + " ".join(f"WHEN {i} THEN 'missing {name}'" for i, name in enumerate(_REQUIRED_NAMES))
        + " END AS reject_reason FROM events",
        "numeric_parse": _with(
            """SELECT k AS query_id,
            CASE k % 9 WHEN 0 THEN amount WHEN 1 THEN -amount WHEN 2 THEN
                 CAST(CAST(amount AS VARCHAR) || 'e1' AS DOUBLE) END AS amount,
            CASE WHEN k % 9 > 2 THEN 'unreadable amount' END AS reject_reason FROM t""",
            "t",
        ),
        "decision": _with("SELECT k AS query_id, votes, fraud_score, approved FROM decided", "decided"),
        "borderline_filter": _with(
            "SELECT k AS query_id, votes FROM fast WHERE votes BETWEEN 2 AND 3", "fast"
        ),
        "clamp01": f"SELECT event_id, {_clamp('(value - 40) / 60e0')} AS clamped FROM events",
        "ratio_dims": _with("SELECT k AS query_id, d0, d1, d7, d8, d13 FROM v", "v"),
        "amount_ratio": _with(
            "SELECT k AS query_id, CASE WHEN k % 3 = 0 THEN d2 ELSE 0e0 END AS d2 FROM v", "v"
        ),
        "iso8601z": _with(
            "SELECT k AS query_id, CASE WHEN k % 6 = 0 THEN sec END AS epoch_seconds FROM e", "e"
        ),
        "hour_dim": "SELECT event_id AS query_id, hour(ts) / 23e0 AS d3 FROM events",
        "dow_dim": "SELECT event_id AS query_id, (isodow(ts) - 1) / 6e0 AS d4 FROM events",
        "minutes_between": _with(
            "SELECT k AS query_id, (sec - last_sec) / 60e0 AS minutes FROM t", "t"
        ),
        "last_txn_dims": _with(
            f"""SELECT k AS query_id,
            CASE WHEN k % 10 IN (1, 2, 3, 4) THEN -1e0
                 WHEN k % 10 IN (0, 5) THEN CASE WHEN {_NO_LAST} THEN -1e0 ELSE {_D5} END
                 WHEN k % 10 IN (6, 7) THEN CASE WHEN {_NO_LAST} THEN -1e0 ELSE 0e0 END
                 ELSE 0e0 END AS d5,
            CASE WHEN k % 10 IN (1, 2, 3, 4) THEN -1e0
                 WHEN k % 10 IN (0, 6, 7) THEN CASE WHEN {_NO_LAST} THEN -1e0 ELSE {_D6} END
                 WHEN k % 10 = 5 THEN CASE WHEN {_NO_LAST} THEN -1e0 ELSE 0e0 END
                 WHEN k % 10 = 8 THEN CASE WHEN {_NO_LAST} THEN 0e0 ELSE {_D6} END
                 ELSE 0e0 END AS d6 FROM t""",
            "t",
        ),
        "bool_flags": _with(
            """SELECT k AS query_id, CASE k % 5 WHEN 0 THEN d9 WHEN 1 THEN 1e0 ELSE 0e0 END AS d9,
            d10 FROM v""",
            "v",
        ),
        "unknown_merchant": _with(
            "SELECT k AS query_id, CASE WHEN k % 5 < 2 THEN d11 ELSE 1e0 END AS d11 FROM v", "v"
        ),
        "mcc_risk": _with(
            "SELECT k AS query_id, CASE WHEN k % 4 < 3 THEN d12 ELSE 0.5e0 END AS d12 FROM v", "v"
        ),
        "quantize_query": _with(f"SELECT k AS query_id, {codes} FROM q", "q"),
        "quantize_ref": _with(
            "SELECT k AS ref_id, "
            + _list("CAST(q{i} AS INTEGER) AS q{i}", EMBEDDING_DIMS)
            + " FROM emb",
            "emb",
        ),
        "dist_int": _with(
            "SELECT k AS query_id, "
            + _list("(q{i} - n{i}) * (q{i} - n{i})", sep=" + ")
            + " AS dist FROM (SELECT *, lead(k) OVER w AS next_k, "
            + _list("lead(q{i}) OVER w AS n{i}")
            + " FROM q WINDOW w AS (ORDER BY k)) WHERE next_k = k + 1",
            "q",
        ),
        "dist_f64": _with(
            "SELECT k AS ref_id, cluster_id, centroid_dist AS dist FROM postings", "postings"
        ),
        "centroid_score": _with(
            "SELECT r.k AS ref_id, cluster_id, norm_sq - 2e0 * ("
            + _list("c{i} * r{i}", sep=" + ")
            + """) AS score FROM r JOIN postings p ON p.k = r.k
            JOIN centroids USING (cluster_id)""",
            "r",
            "postings",
            "centroids",
        ),
        "vectorize": _with("SELECT k AS query_id, " + _list("d{i}") + " FROM v", "v"),
        "query_centroid_cross": _with(
            """SELECT k AS query_id, CAST(count(*) AS INTEGER) AS centroids_scored,
            min(score) AS best_score, max(score) AS worst_score FROM scores GROUP BY k""",
            "scores",
        ),
        "probe_posting_join": _with(
            f"""SELECT k AS query_id, CAST(probe_rank AS INTEGER) AS probe_rank, cluster_id,
            min(dist) AS dist, arg_min(ref_id, (dist, ref_id)) AS ref_id
            FROM visits WHERE probe_rank <= {PROBES.fast} GROUP BY ALL""",
            "visits",
        ).replace("GROUP BY ALL", "GROUP BY k, probe_rank, cluster_id"),
        "knn_exact": _with(_ranked("exact5"), "exact5"),
        "prediction_expected_join": _with(
            "SELECT k AS query_id, expected_approved, approved FROM outcomes", "outcomes"
        ),
        "fraud_vote": _with(
            "SELECT k AS query_id, CAST(sum(n[3]) AS INTEGER) AS votes FROM exact5 GROUP BY k",
            "exact5",
        ),
        "centroid_update": _with("SELECT * FROM centroids", "centroids"),
        "cluster_profile": _with(
            """SELECT c.cluster_id, count(p.k) AS members,
            CAST(sum(count(p.k)) OVER (ORDER BY c.cluster_id) - count(p.k) AS BIGINT)
            AS start_offset FROM centroids c
            LEFT JOIN postings p ON p.cluster_id = c.cluster_id GROUP BY c.cluster_id""",
            "centroids",
            "postings",
        ),
        "centroid_movement": _with(
            "SELECT count(*) AS clusters, count(*) FILTER (WHERE moved) AS moved,"
            " count(*) FILTER (WHERE moved) / CAST(count(*) AS DOUBLE) AS moved_share"
            " FROM (SELECT "
            + _list("(s{i} - c{i}) * (s{i} - c{i})", sep=" + ")
            + " > 1e-10 AS moved FROM seeds JOIN centroids USING (cluster_id))",
            "seeds",
            "centroids",
        ),
        "confusion_matrix": _with("SELECT * FROM matrix", "matrix"),
        "weighted_error": _with("SELECT * FROM weighted", "weighted"),
        "latency_p99": _with("SELECT round(p99, 6) AS p99 FROM p99", "p99"),
        "latency_score": """SELECT user_id, round(CASE WHEN p99 <= 0 THEN 0e0
            WHEN p99 > 2000 THEN -3000e0
            ELSE 1000e0 * log10(1000e0 / greatest(p99, 1e0)) END, 6) AS p99_score,
            p99 > 2000 AS p99_cut
            FROM (SELECT user_id, max(value) * (user_id % 20 - 1) AS p99
                  FROM events GROUP BY user_id)""",
        "detection_score": _with(
            """SELECT event_type, weighted_errors, detection_cut,
            round(error_rate, 6) AS error_rate, round(failure_rate, 6) AS failure_rate,
            round(CASE WHEN NOT detection_cut THEN rate END, 6) AS rate_component,
            round(CASE WHEN NOT detection_cut THEN penalty END, 6) AS absolute_penalty,
            round(CASE WHEN detection_cut THEN -3000e0 ELSE rate + penalty END, 6)
            AS detection_score
            FROM (SELECT *, failure_rate > 0.15e0 AS detection_cut,
                  1000e0 * log10(1e0 / greatest(error_rate, 0.001e0)) AS rate,
                  -300e0 * log10(1e0 + weighted_errors) AS penalty
            FROM (SELECT event_type, fp + 3 * fn + 5 * errors AS weighted_errors,
                  (fp + 3 * fn + 5 * errors) / CAST(n AS DOUBLE) AS error_rate,
                  (fp + fn + errors) / CAST(n AS DOUBLE) AS failure_rate
            FROM (SELECT event_type, count(*) AS n,
                  count(*) FILTER (WHERE approved <> expected_approved AND NOT approved) AS fp,
                  count(*) FILTER (WHERE approved <> expected_approved AND approved) AS fn,
                  count(*) FILTER (WHERE approved IS NULL) AS errors
                  FROM outcomes GROUP BY event_type)))""",
            "outcomes",
        ),
        "final_score": _with(
            """SELECT round(p99_score, 6) AS p99_score,
            round(detection_score, 6) AS detection_score,
            round(p99_score + detection_score, 6) AS final_score FROM figures""",
            "figures",
        ),
        "dataset_profile": _with(
            """SELECT count(*) AS total, count(*) FILTER (WHERE fraud = 1) AS fraud_count,
            round(count(*) FILTER (WHERE fraud = 1) * 100e0 / count(*), 6) AS fraud_rate,
            count(*) FILTER (WHERE fraud = 0) AS legit_count,
            round(count(*) FILTER (WHERE fraud = 0) * 100e0 / count(*), 6) AS legit_rate,
            round(count(*) FILTER (WHERE votes IN (2, 3)) * 100e0 / count(*), 6)
            AS edge_case_rate FROM t JOIN fast USING (k)""",
            "t",
            "fast",
        ),
        "eval_report": _with(
            """SELECT n AS total, (SELECT count(*) FROM t WHERE fraud = 1) AS fraud_count,
            printf('%.2f', p99) || 'ms' AS p99, tp, tn, fp, fn, errors, weighted_errors,
            round(error_rate, 6) AS error_rate, round(p99_score, 2) AS p99_score,
            round(detection_score, 2) AS detection_score, detection_cut,
            round(p99_score + detection_score, 2) AS final_score FROM figures""",
            "t",
            "figures",
        ),
        "evaluation_run": _with(
            """SELECT figures.n AS total, e.* EXCLUDE (n), printf('%.2f', p99) || 'ms' AS p99, tp, tn, fp, fn, errors,
            regexp_replace(CAST(round(failure_rate * 100, 2) AS VARCHAR), '\\.0$', '') || '%' AS failure_rate,
            weighted_errors, round(error_rate, 6) AS error_rate, round(p99_score, 2) AS p99_score,
            p99 > 2000 AS p99_cut, round(detection_score, 2) AS detection_score,
            CASE WHEN NOT detection_cut THEN round(1000e0 * log10(1e0 / greatest(error_rate, 0.001e0)), 2) END
            AS rate_component,
            CASE WHEN NOT detection_cut THEN round(-300e0 * log10(1e0 + weighted_errors), 2) END
            AS absolute_penalty, detection_cut, round(p99_score + detection_score, 2) AS final_score
            FROM figures, (
              SELECT count(*) AS n, count(*) FILTER (WHERE fraud = 1) AS fraud_count,
              round(count(*) FILTER (WHERE fraud = 1) * 100e0 / count(*), 6) AS fraud_rate,
              count(*) FILTER (WHERE fraud = 0) AS legit_count,
              round(count(*) FILTER (WHERE fraud = 0) * 100e0 / count(*), 6) AS legit_rate,
              round(count(*) FILTER (WHERE votes IN (2, 3)) * 100e0 / count(*), 6) AS edge_case_rate
              FROM t JOIN fast USING (k)) e""",
            "t",
            "fast",
            "figures",
        ),
        "output_checks": """SELECT count(*) AS responses, 1e0 AS answered,
            count(*) FILTER (WHERE event_type <> 'error') / CAST(count(*) AS DOUBLE)
            AS body_is_json,
            count(*) FILTER (WHERE event_type NOT IN ('error', 'signup'))
            / CAST(count(*) AS DOUBLE) AS approved_is_boolean,
            count(*) FILTER (WHERE event_type NOT IN ('error', 'click'))
            / CAST(count(*) AS DOUBLE) AS fraud_score_is_number FROM events""",
        "nearest_centroid": _with(
            "SELECT k AS ref_id, cluster_id, centroid_dist FROM postings", "postings"
        ),
        "topk_neighbors": _with(_ranked("fast5"), "fast5"),
        "probe_select": _with(
            """SELECT k AS query_id, CAST(probe_rank AS INTEGER) AS probe_rank, cluster_id
            FROM probes""",
            "probes",
        ),
        "probe_params": _with(
            """SELECT k AS query_id, CAST(probe_rank AS INTEGER) AS probe_rank, cluster_id,
            probe_rank = 1 AS is_fast FROM probes WHERE probe_rank <= 3""",
            "probes",
        ),
        "topk_merge": _with(_ranked("fast5"), "fast5"),
        "train_sample": _with(
            f"""SELECT event_id AS ref_id,
            CASE WHEN value > 60 OR event_type = 'error' THEN 1 ELSE 0 END AS fraud
            FROM events ORDER BY md5('{SEED}-' || event_id), event_id LIMIT 500""",
        ).removeprefix("WITH \n"),
        "kmeans_seed": _with(
            f"SELECT cluster_id, {_list('c{i}')}, {norm} AS norm_sq FROM {drawn}", drawn
        ),
        "kmeans_fit": _with(
            f"SELECT cluster_id, {_list('c{i}')}, {norm} AS norm_sq FROM {fitted}", fitted
        ),
        "ivf_build": _with(
            f"SELECT cluster_id, k AS ref_id, fraud, {codes} FROM postings", "postings"
        ),
        "ivf_fast": _with("SELECT k AS query_id, votes FROM fast", "fast"),
        "ivf_adaptive": _with(
            "SELECT k AS query_id, votes, fast_votes, expanded FROM adaptive", "adaptive"
        ),
        "score_transactions": _with(_SCORED + "scored", "scored"),
        "knn_embeddings": _with(_ranked("emb5"), "emb5"),
    }
    return sql
