import contextlib
import io

from quintavote.testbed import transactions as tx

DAY = 86_400


def test_history_counts_by_running_sums(spark):
    """Many events of one second, repeated keys, gaps of days and a day's exact length."""
    seconds = [5, 5, 5, 60, DAY + 5, DAY + 6, DAY + 61, 4 * DAY, 4 * DAY, 5 * DAY]
    rows = [(k, u, at) for u in (1, 2) for k, at in enumerate(seconds * (3 if u == 1 else 1))] + [(0, 2, 5)]
    keyed = spark.createDataFrame(rows + [(99, None, 7)], "k bigint, u bigint, sec bigint")
    found = tx._with_history(keyed)
    wanted = []
    for u in (1, 2):
        mine = sorted((at, k) for k, v, at in rows if v == u)
        for place, (at, k) in enumerate(mine):
            count = sum(at - DAY <= other <= at for other, _ in mine)
            wanted.append((k, u, at, count, mine[place - 1][0] if place else None))
    got = [tuple(r) for r in found.select("k", "u", "sec", "tx_count_24h", "last_sec").collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        found.explain(True)
    # No frame that slides, which is added up anew for every row of a dense day.
    assert "RangeFrame, -" not in shown.getvalue() and "rangeframe, -" not in shown.getvalue().lower()
