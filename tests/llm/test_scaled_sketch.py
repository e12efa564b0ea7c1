"""Scaled sketches against brute force, and their corner cases."""

import hashlib
import re
from collections import Counter

import pytest

from quintavote.llm import scaled_sketch
from tests.llm.test_corpus_ops import SMALL, documents, texts_of

LEAST, HIGHEST = scaled_sketch.LEAST, scaled_sketch.HIGHEST


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def rule(hashes):
    some = sorted(set(hashes))
    low = [h for h in some if h <= HIGHEST]
    return low if len(low) >= LEAST else some[:LEAST]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def sketch_of(text):
    return rule(md5(s)[:16] for s in shingles(text))


def common(a, b):
    top = min("g" if len(s) < LEAST else max(HIGHEST, s[-1]) for s in (a, b))
    return {h for h in a if h <= top}, {h for h in b if h <= top}


def alike(a, b):
    x, y = common(a, b)
    return 1.0 if a == b else len(x & y) / max(len(x | y), 1)


def compared_by_force(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    first = {i: min((t or "" for j, t in rows if j == i), key=md5) for i in ids}
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    out = Counter()
    for i, text in rows:
        text = text or ""
        behind = "" if i is None else first[after[i]]
        q = len(text) // 4
        edited = text[: len(text) - q] + behind[:q]
        own, changed, other = sketch_of(text), sketch_of(edited), sketch_of(behind)
        near = alike(own, changed), alike(own, other)
        out[i, len(text), edited, tuple(own), tuple(changed), *near] += 1
    return out


def compared(frame):
    rows = scaled_sketch.compare_with_edited(frame).collect()
    return Counter(
        (r.doc_id, r.n_chars, r.edited, tuple(r.sketch), tuple(r.edited_sketch), r.near_edited, r.near_next)
        for r in rows
    )


def test_comparison_equals_brute_force(spark):
    small = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    assert compared(small) == compared_by_force(texts_of(small))


def test_corner_cases(spark):
    long = " ".join(f"w{i * i % 9_973}" for i in range(3 * scaled_sketch.RUN + 17))
    rows = [
        (5, long), (5, "another text of this id"), (5, "another text of this id"), (-3, None), (2, ""),
        (2, " \t\n"), (9, "one"), (12, "a b c d"), (13, "é漢字🙂 " * 40), (None, long[:900]), (None, None),
        (40, long), (1 << 40, "a b c d"), (1 << 41, long[: len(long) // 2]),
    ]
    assert compared(documents(spark, rows)) == compared_by_force(rows)
    assert compared(documents(spark, [(7, "only one document here, its own successor")])) == compared_by_force(
        [(7, "only one document here, its own successor")]
    )
    assert not compared(documents(spark, []))
    assert not scaled_sketch.fingerprints(documents(spark, [])).count()


def test_a_third_of_all_rows_under_one_id(spark):
    rows = [(4, f"copy {i % 3} of a text that is found again and again") for i in range(40)]
    rows += [(i, f"text number {i} of those with an id of their own, {i * i}") for i in range(100, 180)]
    assert compared(documents(spark, rows)) == compared_by_force(rows)


def test_sketches_merge_and_contain(spark):
    words = [f"w{i}" for i in range(6_000)]
    texts = [" ".join(words[a:b]) for a, b in [(0, 6_000), (1_000, 1_400), (0, 12), (3, 30), (5_900, 6_000), (0, 0)]]
    for a in texts:
        for b in texts:
            row = (
                spark.createDataFrame([(a, b)], "s string, t string")
                .select(scaled_sketch.sketch("s").alias("x"), scaled_sketch.sketch("t").alias("y"))
                .select(
                    "x", "y",
                    scaled_sketch.merged("x", "y").alias("both"),
                    scaled_sketch.containment("y", "x").alias("inside"),
                    scaled_sketch.likeness("x", "y").alias("near"),
                )
                .first()
            )
            assert row.both == rule(md5(s)[:16] for s in shingles(a) | shingles(b))
            x, y = common(sketch_of(b), sketch_of(a))
            assert row.inside == (len(x & y) / len(x) if x else None)
            assert row.near == alike(sketch_of(a), sketch_of(b))
    # Part of a text fifteen times as long: contained, though not alike.
    whole, part = sketch_of(texts[0]), sketch_of(texts[1])
    x, y = common(part, whole)
    assert len(x & y) / len(x) == 1 and alike(whole, part) < 0.2


def test_groups_of_documents_merge_into_rows(spark):
    small = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source")
    drawn = scaled_sketch.fingerprints(small).join(small.select("doc_id", "source"), "doc_id")
    groups = scaled_sketch.merge_groups(drawn, "source")
    rows = small.collect()
    union = {}
    for r in rows:
        union.setdefault(r.source, set()).update(h for h in sketch_of(r.text or "") if h <= HIGHEST)
    assert {(r.source, r.hash) for r in groups.collect()} == {(s, h) for s, hs in union.items() for h in hs}
    want = {}
    for r in rows:
        own = {h for h in sketch_of(r.text or "") if h <= HIGHEST}
        want |= {(r.doc_id, s): len(own & hs) / len(own) for s, hs in union.items() if own & hs}
    found = scaled_sketch.contained_in_groups(drawn, groups, "source").collect()
    assert {(r.doc_id, r.source): r.containment for r in found} == pytest.approx(want)


def test_texts_cross_one_exchange_once(spark):
    """Both joins read the same exchange of texts and sketches."""
    frame = scaled_sketch.compare_with_edited(spark.read.parquet(f"{SMALL}/documents.parquet"))
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 1 and plan.count("IsNotNull(doc_id)") == 1
    assert "Python" not in plan and "CartesianProduct" not in plan
