r"""The trie of conversation prefixes, totalled by parallel tree contraction.

Turns of a conversation are ordered by turn (null first); equal turn numbers go by the md5 of
role and text.  Null roles and texts count as empty.  Every conversation c is rebuilt: the
first h original turns of conversation c - c % 20 (all if fewer, none if absent), then c's own
turns after its first h, where h is crc32 of c in decimals, modulo 4.  A node is a distinct
sequence of the first d rebuilt turns; its members are the rebuilt conversations that start
with it.  The root (d = 0) holds all of them, also those without a turn.

Texts stay where they are read: from then on a turn is its 128-bit digest and its word count.
A prefix is named by the exclusive or of two 64-bit hashes of (position, digest), which needs no
order to add up, so neither long conversations nor common prefixes pass through one task:
conversations are numbered in parts dealt by range, and prefixes run in blocks of ``BLOCK``
turns.  Two prefixes share a name by chance with odds of 2**-128 a pair.

Totals over subtrees come from contraction rounds, each a join of the nodes left with what
their children report.  *Rake* takes every leaf out and adds its total to its parent.
*Compress* takes nodes with one child out of unary chains, no two neighbours at once (those with a
larger hash than both go), and hangs the child to the parent with what it passes on in between.  Rounds grow
with the logarithm of the number of nodes, not with the depth.  Then rounds are undone last
first: the total of a compressed node is its own and that of the child it had.

Rows without conv_id belong to no conversation.  Repeated rows are turns of their own.  Extra
columns are ignored; without conversations there is no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quintavote.staging import materialize, ship_package

GROUP = 20
HEADS = 4
BLOCK = 4_096
# Conversation ids hashed as one piece of text.
CHUNK_IDS = 1_024
WORD = r"[^\\x20\\x09-\\x0D]+"

_KEY = ["k1", "k2"]
_PARENT = ["p1", "p2"]


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest and words of every original turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    both = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    lean = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(both)).alias("digest"),
        F.expr(f"CAST(regexp_count(coalesce(CAST(text AS string), ''), '{WORD}') AS long)").alias("words"),
        F.monotonically_increasing_id().alias("tie"),
    )
    # Written, so that texts are read once though dealing by range looks at its input twice.
    lean = materialize(lean, "lean")
    order = ["conv_id", "turn", "digest", "tie"]
    # Dealt by range and sorted, row numbers ascend by conversation and turn.
    dealt = lean.repartitionByRange(*order).sortWithinPartitions(*order)
    lined = materialize(
        dealt.select(
            "conv_id", "digest", "words",
            F.monotonically_increasing_id().alias("line"), F.spark_partition_id().alias("part"),
        ),
        "lined",
    )
    # One row a conversation and part: as many as parts at most, however long it is.
    pieces = lined.groupBy("conv_id", "part").agg(F.min("line").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    pieces = pieces.select("conv_id", "part", (F.col("first") - before).alias("start"))
    return lined.join(pieces, ["conv_id", "part"]).select(
        "conv_id", (F.col("line") - F.col("start") + 1).alias("pos"), "digest", "words"
    )


def _lengths(turns: DataFrame) -> DataFrame:
    """conv_id, n, base, h (turns taken from base) and skip (own turns left out) of each conversation."""
    n = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = n.withColumn("base", F.expr(f"conv_id - conv_id % {GROUP}")).withColumn(
        "skip", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    )
    bases = n.where(f"conv_id % {GROUP} = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    return convs.join(bases, "base", "left").select(
        "conv_id",
        "base",
        "skip",
        F.least("skip", F.coalesce("base_n", F.lit(0))).alias("h"),
        F.expr("greatest(n - skip, 0)").alias("own"),
    )


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, pos, digest, words) and conversations (conv_id, length)."""
    turns = materialize(_turns(conversations), "turns")
    convs = materialize(_lengths(turns), "lengths")
    own = turns.join(convs, "conv_id").where("pos > skip").select(
        "conv_id", (F.col("pos") - F.col("skip") + F.col("h")).alias("pos"), "digest", "words"
    )
    # Twenty conversations a base (39 around zero), so no base is hot.
    heads = turns.where(f"pos < {HEADS} AND conv_id % {GROUP} = 0").withColumnRenamed("conv_id", "base")
    taken = convs.where("h > 0").join(heads, "base").where("pos <= h")
    rebuilt = own.unionByName(taken.select("conv_id", "pos", "digest", "words"))
    return rebuilt, convs.select("conv_id", (F.col("h") + F.col("own")).alias("length"))


def _prefixes(rebuilt: DataFrame) -> DataFrame:
    """Each turn with the name of the prefix that ends in it and of the one before."""
    hashed = rebuilt.select(
        "conv_id", "pos", "words",
        F.xxhash64(F.lit(1), "pos", "digest").alias("x1"),
        F.xxhash64(F.lit(2), "digest", "pos").alias("x2"),
        F.expr(f"(pos - 1) DIV {BLOCK}").alias("block"),
    )
    within = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = hashed.select("*", F.bit_xor("x1").over(within).alias("r1"), F.bit_xor("x2").over(within).alias("r2"))
    # What earlier blocks add up to; most conversations have one block and no row here.
    blocks = hashed.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(
        "conv_id", "block", F.bit_xor("b1").over(earlier).alias("c1"), F.bit_xor("b2").over(earlier).alias("c2")
    ).where("block > 0")
    whole = run.join(carried, ["conv_id", "block"], "left").select(
        "conv_id", "pos", "words", "x1", "x2",
        F.expr("r1 ^ coalesce(c1, 0)").alias("k1"), F.expr("r2 ^ coalesce(c2, 0)").alias("k2"),
    )
    return whole.select(
        "conv_id", "pos", "words", *_KEY, F.expr("k1 ^ x1").alias("p1"), F.expr("k2 ^ x2").alias("p2")
    )


def _ends(members: DataFrame) -> DataFrame:
    """k1, k2, ends: the digest of the ascending ids (conv_id) under each name.

    SHA-256 takes its text in order.  Ids are dealt by range, so that those of one node are
    spread, and joined in chunks; only chunks of finished text meet again, one at a time.
    """
    ship_package(members.sparkSession)
    order = [*_KEY, "conv_id"]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def piece():
            text = ",".join(map(str, ids)).encode()
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([ids[0]], pa.int64()),
                 pa.array([text], pa.binary())],
                names=["k1", "k2", "first", "joined"],
            )

        for batch in batches:
            out = []
            for k1, k2, conv in zip(*(batch[c].to_pylist() for c in order), strict=True):
                if ids and (key != (k1, k2) or len(ids) == CHUNK_IDS):
                    out.append(piece())
                    ids = []
                key = (k1, k2)
                ids.append(conv)
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if ids:
            yield piece()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def rows(done):
            k1, k2, text = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(text)], names=["k1", "k2", "ends"]
            )

        for batch in batches:
            done = []
            for k1, k2, joined in zip(batch["k1"].to_pylist(), batch["k2"].to_pylist(), batch["joined"], strict=True):
                if key == (k1, k2):
                    state.update(b",")
                else:
                    if key:
                        done.append((*key, state.hexdigest()))
                    key, state = (k1, k2), hashlib.sha256()
                state.update(joined.as_buffer())
            if done:
                yield rows(done)
        if key:
            yield rows([(*key, state.hexdigest())])

    dealt = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    joined = dealt.mapInArrow(chunks, "k1 long, k2 long, first long, joined binary")
    return (
        joined.repartition(*_KEY)
        .sortWithinPartitions(*_KEY, "first")
        .mapInArrow(digests, "k1 long, k2 long, ends string")
    )


def subtree_totals(nodes: DataFrame, *measures: str) -> DataFrame:
    """The sums of ``measures`` over the subtree of every node, by tree contraction.

    ``nodes`` holds k1, k2, p1, p2 (null in roots), and n_children; a stored table, read twice.
    Returns k1, k2 and the sums under the same names.
    """
    edge = [f"e_{m}" for m in measures]
    # Of an only child: its name, its children, and what its link adds.
    child = [("k1", "c1"), ("k2", "c2"), ("n_children", "c_n"), *((f"e_{m}", f"c_{m}") for m in measures)]
    left = nodes.select(*_KEY, *_PARENT, "n_children", *measures, *(F.lit(0).cast("long").alias(e) for e in edge))
    rounds: list[DataFrame] = []
    while True:
        turn = len(rounds)
        leaf = F.col("n_children") == 0
        # What the children of a node report: leaves their totals, an only child its state
        # (the largest of one value).
        reports = (
            left.where("p1 IS NOT NULL")
            .groupBy(*_PARENT)
            .agg(
                F.count_if(leaf).alias("raked"),
                *(
                    F.coalesce(F.sum(F.when(leaf, F.col(m) + F.col(f"e_{m}"))), F.lit(0)).alias(f"r_{m}")
                    for m in measures
                ),
                *(F.max(a).alias(b) for a, b in child),
            )
            .withColumnsRenamed({"p1": "k1", "p2": "k2"})
        )
        # No two ends of a chain's link go in one round, and a leaf goes by rake.
        compressed = F.expr(
            "p1 IS NOT NULL AND n_children = 1 AND c_n > 0"
            f" AND (c_n > 1 OR xxhash64(k1, k2, {turn}) > xxhash64(c1, c2, {turn}))"
            f" AND xxhash64(k1, k2, {turn}) > xxhash64(p1, p2, {turn})"
        )
        state = F.when(leaf, "raked").when(compressed, "compressed").otherwise("left")
        joined = left.join(reports, _KEY, "left")
        held = materialize(
            joined.select(
                *_KEY, *_PARENT,
                state.alias("state"),
                (F.col("n_children") - F.coalesce("raked", F.lit(0))).alias("n_children"),
                *((F.col(m) + F.coalesce(f"r_{m}", F.lit(0))).alias(m) for m in measures),
                *edge,
                # The child of a compressed node, and what its link adds.
                "c1", "c2", *(f"c_{m}" for m in measures),
            ),
            "contracted",
        )
        rounds.append(held)
        still = held.where("state = 'left'")
        if still.isEmpty():
            break
        # Children of compressed nodes hang to their grandparents.
        gone = held.where("state = 'compressed'").select(
            F.col("c1").alias("k1"), F.col("c2").alias("k2"), F.col("p1").alias("g1"), F.col("p2").alias("g2"),
            *((F.col(m) + F.col(f"e_{m}")).alias(f"g_{m}") for m in measures),
        )
        moved = F.col("g1").isNotNull()
        left = materialize(
            still.join(gone, _KEY, "left").select(
                *_KEY,
                F.when(moved, F.col("g1")).otherwise(F.col("p1")).alias("p1"),
                F.when(moved, F.col("g2")).otherwise(F.col("p2")).alias("p2"),
                "n_children", *measures,
                *((F.col(f"e_{m}") + F.coalesce(f"g_{m}", F.lit(0))).alias(f"e_{m}") for m in measures),
            ),
            "left",
        )

    totals: list[DataFrame] = []
    for held in reversed(rounds):
        totals.append(held.where("state = 'raked'").select(*_KEY, *measures))
        if len(totals) == 1:
            continue
        known = reduce(DataFrame.unionByName, totals[:-1])
        known = known.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), *(F.col(m).alias(f"t_{m}") for m in measures))
        undone = held.where("state = 'compressed'").join(known, ["c1", "c2"])
        undone = undone.select(
            *_KEY, *((F.col(m) + F.col(f"c_{m}") + F.col(f"t_{m}")).alias(m) for m in measures)
        )
        totals.append(materialize(undone, "undone"))
    return reduce(DataFrame.unionByName, totals)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conv_id is the smallest member; saved_tokens sums, over the subtree, each node's members but
    one times the words of its last text; ends_sha256 digests the members that end in the node.
    """
    rebuilt, convs = rebuilt_turns(conversations)
    prefixes = materialize(_prefixes(rebuilt), "prefixes")
    grown = prefixes.groupBy(*_KEY).agg(
        *(F.min(c).alias(c) for c in (*_PARENT, "pos", "words", "conv_id")), F.count("*").alias("n_convs")
    )
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = root.select(
        zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("pos"),
        zero.alias("words"), "conv_id", "n_convs",
    )
    nodes = materialize(grown.unionByName(root), "nodes")
    children = nodes.where("p1 IS NOT NULL").groupBy(*_PARENT).agg(F.count("*").alias("n_children"))
    children = children.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children")
    tree = materialize(
        nodes.join(children, _KEY, "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        .withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"))
        .withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words"))
        .drop("words"),
        "tree",
    )
    totals = subtree_totals(tree, "n_leaves", "saved_tokens")

    last = convs.where("length > 0").select("conv_id", F.col("length").alias("pos"))
    ending = prefixes.select("conv_id", "pos", *_KEY).join(last, ["conv_id", "pos"])
    silent = convs.where("length = 0").select("conv_id", zero.alias("k1"), zero.alias("k2"))
    ends = _ends(ending.select("conv_id", *_KEY).unionByName(silent))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    return (
        tree.drop("n_leaves", "saved_tokens")
        .join(totals, _KEY)
        .join(ends, _KEY, "left")
        .join(parents, _PARENT, "left")
        .select(
            "conv_id",
            F.col("pos").alias("depth"),
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )
