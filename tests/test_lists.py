"""Merging the lists that scans leave."""

from quintavote.operators import topk


def test_merged_lists_are_sorted_without_a_comparator(spark):
    """Lists meet by distance, then id; the sort runs on whole structs, not on a comparing lambda."""
    rows = [(1, [(5, 2, 1), (9, 1, None)]), (1, [(5, 1, 0), (5, 3, None)]), (1, []), (2, None)]
    lists = spark.createDataFrame(rows, "query_id long, near array<struct<dist: long, ref_id: long, fraud: int>>")
    merged = topk.merged_lists(lists, 3)
    found = {r["query_id"]: [tuple(x) for x in r["near"]] for r in merged.collect()}
    assert found == {1: [(5, 1, 0), (5, 2, 1), (5, 3, None)], 2: []}
    assert "lambda" not in merged._jdf.queryExecution().optimizedPlan().toString()
