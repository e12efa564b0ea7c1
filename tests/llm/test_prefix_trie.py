"""The prefix trie against brute force, and its corner cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quintavote.llm import prefix_trie
from tests.llm.test_corpus_ops import SMALL

ROW = "conv_id long, turn long, role string, text string, k1 string, pos int, label int"


def trie_by_force(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for conv in turns:
        turns[conv].sort(key=lambda t: (t[:2], hashlib.md5(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest()))
        turns[conv] = [t[2:] for t in turns[conv]]
    built = {}
    for conv, own in turns.items():
        h = zlib.crc32(str(conv).encode()) % 4
        base = conv - int(np.fmod(conv, 20))
        built[conv] = tuple(turns.get(base, [])[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for conv in sorted(built):
        for d in range(len(built[conv]) + 1):
            members[built[conv][:d]].append(conv)
        ends[built[conv]].append(conv)
    children = Counter(node[:-1] for node in members if node)
    leaves, saved = Counter(), Counter()
    for node, held in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(held) - 1) * words
    return Counter(
        (
            held[0], len(node), members[node[:-1]][0] if node else None, len(held), children[node],
            leaves[node], saved[node], hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest(),
        )
        for node, held in members.items()
    )


def trie(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 5, 6) for r in rows], ROW).repartition(5)
    return Counter(tuple(r) for r in prefix_trie.prefix_trie(frame).collect())


@pytest.fixture
def tiny(monkeypatch):
    """Blocks and chunks so small that everything crosses their borders."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 7)
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 3)


def test_equals_brute_force(spark, tiny):
    frame = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in frame.collect()]
    assert trie(spark, rows) == trie_by_force(rows)


def test_corner_cases(spark, tiny):
    rows = [
        (None, 0, "user", "nobody's"), (0, None, None, None), (0, 1, "user", "a b"), (0, 1, "user", "a b"),
        (0, 1, "assistant", None), (1, 5, "user", ""), (2, None, "user", "x"), (2, None, "user", "y"),
        (-1, 0, "user", "below zero"), (-20, 0, "user", "low"), (-19, 0, "user", "low"), (-19, 1, "a", "b"),
        (41, 0, "user", "no base"), (42, 0, "user", "no base"), (43, 7, "us", "er no base"), (61, 0, "", "alone"),
        (1 << 60, 3, "user", "far"), (25, 0, "user", "one"), (38, 1, "user", "é 漢 字"),
    ]
    assert trie(spark, rows) == trie_by_force(rows)
    assert trie(spark, rows[1:2]) == trie_by_force(rows[1:2])
    assert trie(spark, []) == trie(spark, rows[:1]) == Counter()


def test_long_chains_and_a_common_beginning(spark, tiny):
    """One conversation with a third of all turns, another third of conversations alike."""
    rng = np.random.default_rng(8)
    rows = [(20, i, "user", f"turn {i}") for i in range(260)]
    rows += [(37, i, "user", f"turn {i}" if i < 200 else f"other {i}") for i in range(230)]
    rows += [(100 + c, t, "user", "the same" if t < 2 else "and again") for c in range(60) for t in range(4)]
    rows += [(200 + c, t, "ua"[t % 2], f"{rng.integers(3)}") for c in range(60) for t in range(int(rng.integers(1, 7)))]
    assert trie(spark, rows) == trie_by_force(rows)


def test_contraction_rounds_do_not_follow_depth(spark, monkeypatch):
    """A chain of 400 nodes falls in a few dozen rounds."""
    chain = spark.createDataFrame(
        [(i, i, i - 1 if i else None, i - 1 if i else None, int(i < 399), 1) for i in range(400)],
        "k1 long, k2 long, p1 long, p2 long, n_children long, m long",
    )
    rounds = []
    kept = prefix_trie.materialize
    monkeypatch.setattr(
        prefix_trie, "materialize", lambda df, name: (rounds.append(name), kept(df, name))[1]
    )
    totals = {r.k1: r.m for r in prefix_trie.subtree_totals(chain, "m").collect()}
    assert totals == {i: 400 - i for i in range(400)}
    assert rounds.count("contracted") < 30
