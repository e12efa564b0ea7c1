"""Jaccard self-join of documents on word shingles by parity sketches.

The shingles of a document are dealt to blocks by their hash and XORed into one word
per block.  A shingle that two sets do not share changes one block, so the number of
differing blocks never exceeds the symmetric difference.  Sets with a Jaccard
similarity of 3/4 differ in at most a seventh of their summed sizes; of a document's
non-empty blocks one more than that many are its keys, and by the pigeonhole principle
two similar documents share a key.  Sizes form bands (64 times powers of 4) that fix the
number of blocks; a document whose partners may lie in the next band has keys there too.
Below 64 shingles every shingle is a block of its own, which makes the argument exact;
above, the keys suffice unless fewer blocks are occupied than may differ, against which
the odds are below 10^-13 a document.

All documents order their blocks alike: blocks of shingles that are frequent in a bounded
sample come last, fuller blocks first, then by hash.  The sample steers only which
blocks become keys, never which pairs are found.

Within a key, documents first meet a leader, the one that shares most keys, and those
that it does not take meet two more.  What this connects is one class from then on.
Documents of one key that are in different classes still are compared block by block:
a task holds the sketches of two bounded blocks and returns only the pairs that pass.
Documents with the same set are one of them throughout, and the others are tied to it.
Candidates are dismissed by a second sketch of at least two parity bits a shingle, whose
Hamming distance bounds the symmetric difference from below, and the rest are verified
on whole texts.

Null and empty texts and texts without words have no shingles and no links.  Fewer
words than a shingle form one shingle.  Repeated rows of a doc_id are one document for
linking and one row each in the result; rows with a null doc_id are linked with nothing.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quintavote.llm.common import keyed_text
from quintavote.staging import materialize, ship_package

WORDS = 5
SMALL = 64
SKETCH_BITS = 2  # a shingle, at least
# Leaders a key has in each round, and documents that a task compares with as many.
ROUNDS = (1, 2)
BLOCK = 512
BUNDLE = 2_048
# Sketch words that one numpy step compares.
CELLS = 1 << 18
# Documents sampled for frequent shingles, and how many of those are kept: both bounds.
HOT_SAMPLE = 10_000
HOT_SHINGLES = 1 << 16
# Ids and pairs of ids are broadcast up to this number, joined by shuffle beyond it.
BROADCAST_IDS = 1_000_000
_VOCABULARY = 200_000
# Texts that are read before their results are handed on.
ROWS = 256


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """64-bit hashes of words; starts anew when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= _VOCABULARY:
            self.clear()
        self[word] = value = xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, hashes: dict, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of one text."""
    # bytes.lower() changes A-Z alone; bytes.split() splits on space, TAB, LF, VT, FF and CR.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(w))
    made = np.full(len(w) - width + 1, width, np.uint64)
    for i in range(width):
        made *= np.uint64(0x9E3779B97F4A7C15)
        made += w[i : len(w) - width + 1 + i]
    return np.unique(_mix(made))


def _band(n: int) -> int:
    band, top = 0, SMALL
    while n >= top:
        band, top = band + 1, top * 4
    return band


def _most(n: int, partner: int) -> int:
    """Largest symmetric difference of similar sets of these sizes."""
    return (n + partner) // 7


def block_keys(u: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Keys of one set under the bands of its possible partners."""
    n = len(u)
    if not n:
        return np.empty(0, np.int64)
    largest = 4 * n // 3
    own = _band(n)
    place = np.searchsorted(hot, u)
    frequent = np.zeros(n, bool)
    if len(hot):
        frequent = hot[np.minimum(place, len(hot) - 1)] == u
    out = []
    for band in range(own, _band(largest) + 1):
        top = SMALL * 4**band - 1
        need = _most(n, min(largest, top)) + 1
        if band == 0:
            values, load, common = u, np.ones(n, np.int64), frequent
        else:
            block = u >> np.uint64(64 - (6 + 2 * band))
            start = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            values = np.bitwise_xor.reduceat(_mix(u), start) ^ block[start]
            load = np.diff(np.append(start, n))
            common = np.logical_and.reduceat(frequent, start)
        keys = _mix(values + np.uint64(0xD1B54A32D192ED03 * (band + 1) % 2**64))
        if len(keys) > need:
            # One number orders them: common last, then fuller first, then by hash.
            order = (common.astype(np.uint64) << np.uint64(63)) | (keys >> np.uint64(9))
            order |= (np.uint64(255) - np.minimum(load, 255).astype(np.uint64)) << np.uint64(55)
            keys = keys[np.argpartition(order, need - 1)[:need]]
        # Seven bytes tell keys apart and are what a shuffle of keys mostly moves.
        out.append((keys >> np.uint64(8)).view(np.int64))
    return np.concatenate(out)


def parity_bits(u: np.ndarray) -> np.ndarray:
    """Whether each place has an odd number of shingles, as 64-bit words; a power of two of them."""
    size = 64 << max(0, int(np.ceil(np.log2(max(1, SKETCH_BITS * len(u) / 64)))))
    odd = np.bincount((_mix(u) % np.uint64(size)).astype(np.int64), minlength=size)
    return np.packbits((odd & 1).astype(np.uint8)).view(">i8").astype(np.int64)


def _hamming(a: str, b: str) -> str:
    """SQL of the distance of two sketches; 0 where their sizes are too far apart to fold."""
    half = lambda x: (
        f"zip_with(slice({x}, 1, size({x}) DIV 2), slice({x}, size({x}) DIV 2 + 1, size({x}) DIV 2), (x, y) -> x ^ y)"
    )
    count = lambda x, y: (
        f"aggregate(zip_with({x}, {y}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    )
    return (
        f"CASE WHEN size({a}) = size({b}) THEN {count(a, b)}"
        f" WHEN size({a}) = 2 * size({b}) THEN {count(half(a), b)}"
        f" WHEN size({b}) = 2 * size({a}) THEN {count(a, half(b))} ELSE 0 END"
    )


def _hot_shingles(docs: DataFrame) -> np.ndarray:
    n = docs.count()
    share = min(1.0, HOT_SAMPLE / max(1, n))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                found = [shingles(text, hashes) for text in batch["text"].slice(start, ROWS).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["s"])

    rows = (
        docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
        .mapInArrow(some, "s long")
        .groupBy("s")
        .count()
        .where("count >= 4")
        .orderBy(F.desc("count"), "s")
        .limit(HOT_SHINGLES)
        .select("s")
        .collect()
    )
    return np.sort(np.array([r["s"] for r in rows], np.int64).view(np.uint64))


def sketches(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """doc_id, n_shingles, a fingerprint of the set, parity bits and block keys."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            # A few texts at a time: what is held besides the input stays small.
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                sets = [shingles(t, hashes) for t in part["text"].to_pylist()]
                fingers = [np.array([u.sum(), _mix(u).sum()], np.uint64).tobytes() for u in sets]
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"],
                        pa.array([len(u) for u in sets], pa.int64()),
                        pa.array(fingers, pa.binary()),
                        pa.array([parity_bits(u) for u in sets], longs),
                        pa.array([block_keys(u, hot) for u in sets], longs),
                    ],
                    names=["doc_id", "n_shingles", "finger", "bits", "keys"],
                )

    schema = "doc_id long, n_shingles long, finger binary, bits array<long>, keys array<long>"
    return docs.select("doc_id", "text").mapInArrow(sketch, schema)


def _verify(pairs: DataFrame, info: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b, linked for each pair of ids."""
    side = lambda s: info.select(*(F.col(c).alias(f"{c}_{s}") for c in info.columns))
    differ = F.expr(_hamming("bits_a", "bits_b"))
    both = F.col("n_shingles_a") + F.col("n_shingles_b")
    if pairs.count() <= BROADCAST_IDS:
        pairs = F.broadcast(pairs)
    known = (
        side("a").join(pairs, F.col("a") == F.col("doc_id_a"))
        .join(side("b"), F.col("b") == F.col("doc_id_b"))
        .select(
            "a", "b", both.alias("both"),
            F.greatest(differ, F.abs(F.col("n_shingles_a") - F.col("n_shingles_b"))).alias("delta"),
            (F.col("finger_a") == F.col("finger_b")).alias("equal"),
        )
    )
    known = materialize(known, "known")
    settled = F.col("equal") | (7 * F.col("delta") > F.col("both"))
    open_pairs = known.where(~settled)
    ids = materialize(
        open_pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "verify-ids"
    )
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = materialize(docs.join(ids, "doc_id", "left_semi"), "verify-texts")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        last, made = None, None
        for batch in batches:
            linked = []
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                for a, both, x, y in zip(*(part[c].to_pylist() for c in ("a", "both", "x", "y")), strict=True):
                    if (a, x) != last:
                        last, made = (a, x), shingles(x, hashes)
                    n = len(np.intersect1d(made, shingles(y, hashes), assume_unique=True))
                    linked.append(100 * n >= 75 * (both - n))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    exact = (
        open_pairs.select("a", "b", "both")
        .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b")
        .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a")
        .select("a", "b", "both", "x", "y")
        .mapInArrow(judge, "a long, b long, linked boolean")
    )
    done = known.where(settled).select("a", "b", F.col("equal").alias("linked"))
    # A doc_id that has several rows is linked if any of them is.
    return done.unionByName(exact).groupBy("a", "b").agg(F.max("linked").alias("linked"))


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _copies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of one document per set, and a, b that tie its other documents to it."""
    first = materialize(
        rows.groupBy("finger")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where("first < last")
        .select("finger", "first"),
        "copied-sets",
    )
    if first.count() <= BROADCAST_IDS:
        first = F.broadcast(first)
    marked = rows.join(first, "finger", "left")
    twins = marked.where("first < doc_id").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    return marked.where("first IS NULL OR first = doc_id").drop("first"), twins.distinct()


def links(docs: DataFrame, info: DataFrame) -> DataFrame:
    """a, b of similar documents, enough of them to connect every class of similar documents."""
    info = info.where("doc_id IS NOT NULL AND n_shingles > 0")
    info, twins = _copies(info)
    within = Window.partitionBy("key")
    # Keys with the same documents count once: they are named by the XOR of their
    # documents' hashes (a chance agreement only makes one group of two).
    members = materialize(
        info.select(F.explode("keys").alias("key"), "doc_id")
        .select(
            "doc_id",
            F.min("doc_id").over(within).alias("lo"),
            F.max("doc_id").over(within).alias("hi"),
            F.expr("bit_xor(xxhash64(doc_id))").over(within).alias("key"),
        )
        .where("lo < hi")
        .select("key", "doc_id")
        .distinct(),
        "members",
    )
    # Only documents that share a key are looked at again; those that share many lead.
    shared = materialize(members.groupBy("doc_id").agg(F.count("*").alias("shared")), "shared")
    if shared.count() <= BROADCAST_IDS:
        shared = F.broadcast(shared)
    small = materialize(
        info.select("doc_id", "n_shingles", "finger", "bits").join(shared, "doc_id", "left_semi"),
        "members-info",
    )
    groups = members = materialize(members.join(shared, "doc_id"), "members-ranked")
    verified: DataFrame | None = None
    for n_leaders in ROUNDS:
        if members.isEmpty():
            break
        first = Window.partitionBy("key").orderBy(F.desc("shared"), "doc_id")
        ranked = members.withColumn("place", F.row_number().over(first))
        leaders = ranked.where(F.col("place") <= n_leaders).select(
            "key", F.col("doc_id").alias("leader"), F.col("place").alias("at")
        )
        compared = materialize(
            ranked.join(leaders, "key")
            .where(F.col("place") > F.col("at"))
            .select("key", "place", "shared", "doc_id", *_ordered("leader", "doc_id")),
            "compared",
        )
        verified = _settle(compared.select("a", "b").distinct(), verified, small, docs)
        # Documents that no leader of their key took meet new leaders.
        taken = (
            compared.join(verified.select("a", "b", "linked"), ["a", "b"])
            .groupBy("key", "doc_id", "shared")
            .agg(F.max("linked").alias("taken"), F.max("place").alias("place"))
        )
        left = taken.where(~F.col("taken") & (F.col("place") > n_leaders))
        members = materialize(
            left.withColumn("n", F.count("*").over(Window.partitionBy("key")))
            .where("n > 1")
            .select("key", "doc_id", "shared"),
            "members",
        )
    if verified is None:
        return twins
    pairs = _across(groups, components(verified.where("linked").select("a", "b")), small)
    verified = _settle(pairs, verified, small, docs)
    return verified.where("linked").select("a", "b").unionByName(twins)


def _bundled_pairs(bundle: pd.DataFrame) -> pd.DataFrame:
    """a, b of the block pairs of one bundle that are in different classes and may be similar."""
    bundle = bundle.sort_values(["key", "i", "j"])
    place = bundle[["key", "i", "j"]].to_numpy()
    new = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
    whole = [bundle[c].to_numpy() for c in ("doc_id", "label", "at", "n_shingles", "bits")]
    found = [np.empty((0, 2), np.int64)]
    for lo, hi in zip(np.r_[0, new], np.r_[new, len(bundle)], strict=True):
        found += _pairs_within_bound(*(x[lo:hi] for x in whole), crossing=place[lo, 1] != place[lo, 2])
    return pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["a", "b"])


def _pairs_within_bound(
    ids: np.ndarray, labels: np.ndarray, at: np.ndarray, n: np.ndarray, bits: np.ndarray, crossing: bool
) -> Iterator[np.ndarray]:
    """Pairs of ids that differ in label (``crossing``: in block, too) and that no bound dismisses."""
    wide = np.fromiter(map(len, bits), np.int64, len(bits))
    stacked = {
        w: np.stack(bits[wide == w]).view(np.uint64) for w in set(wide.tolist())
    }
    for width, words in stacked.items():
        # Half as wide sketches are compared after folding; the sizes dismiss others.
        for narrow in {width, width // 2} & stacked.keys():
            mine = words if narrow == width else words[:, :narrow] ^ words[:, narrow:]
            x, y = np.flatnonzero(wide == width), np.flatnonzero(wide == narrow)
            step = max(1, CELLS // (len(y) * narrow))
            for lo in range(0, len(x), step):
                p, q = x[lo : lo + step, None], y[None]
                apart = np.bitwise_count(mine[lo : lo + step, None] ^ stacked[narrow][None])
                apart = np.maximum(apart.sum(-1, dtype=np.int64), np.abs(n[p] - n[q]))
                fit = (7 * apart <= n[p] + n[q]) & (labels[p] != labels[q])
                if narrow == width:
                    fit &= p < q
                if crossing:
                    fit &= at[p] != at[q]
                left, right = np.nonzero(fit)
                yield np.sort(np.stack([ids[x[lo + left]], ids[y[right]]], axis=1), axis=1)


def _across(groups: DataFrame, labels: DataFrame, info: DataFrame) -> DataFrame:
    """Distinct a, b that share a key, are not connected yet and whose sketches are near.

    Groups are cut into blocks of BLOCK documents in the order of their labels; a task
    compares two blocks and returns only what the bounds leave.
    """
    within = Window.partitionBy("key")
    rows = (
        groups.join(labels.withColumnRenamed("component_id", "label"), "doc_id", "left")
        .withColumn("label", F.coalesce("label", "doc_id"))
        .withColumn("low", F.min("label").over(within))
        .withColumn("high", F.max("label").over(within))
        .withColumn("n", F.count("*").over(within))
        # The leader of two has met the other already.
        .where("low < high AND n > 2")
        .withColumn("at", F.expr(f"(row_number() OVER (PARTITION BY key ORDER BY label, doc_id) - 1) DIV {BLOCK}"))
        .select("key", "doc_id", "label", "at")
    )
    rows = materialize(rows, "across")
    blocks = materialize(
        rows.groupBy("key", "at").agg(
            F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")
        ),
        "blocks",
    )
    # A task of Python holds several block pairs, BUNDLE rows on average.
    met = blocks.groupBy("key").agg((F.sum("n") * F.count("*")).alias("n")).agg(F.sum("n")).first()[0]
    bundle = F.pmod(F.xxhash64("key", "i", "j"), F.lit(1 + (met or 0) // BUNDLE))
    left = blocks.select("key", F.col("at").alias("i"), F.col("low").alias("low_i"), F.col("high").alias("high_i"))
    right = blocks.select("key", F.col("at").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"))
    # Blocks of one and the same label have nothing left to settle.
    meet = (
        left.join(right, "key")
        .where("i <= j AND NOT (low_i = high_j)")
        .select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("at"))
    )
    return (
        rows.join(meet, ["key", "at"])
        .join(info.select("doc_id", "n_shingles", "bits"), "doc_id")
        .groupBy(bundle.alias("bundle"))
        .applyInPandas(_bundled_pairs, "a long, b long")
        .distinct()
    )


def _settle(
    pairs: DataFrame, verified: DataFrame | None, info: DataFrame, docs: DataFrame
) -> DataFrame:
    """``verified`` and what is new in ``pairs``."""
    new = pairs if verified is None else pairs.join(verified, ["a", "b"], "left_anti")
    new = materialize(new, "pairs")
    if verified is not None and new.isEmpty():
        return verified
    new = materialize(_verify(new, info, docs), "verified")
    return new if verified is None else verified.unionByName(new)


def components(edges: DataFrame) -> DataFrame:
    """doc_id, component_id (smallest id reachable) of the ends of ``edges``.

    Edges are contracted to the labels of their ends until none is left; labels
    point to smaller labels and are shortened by jumping.
    """
    edges = materialize(edges.select(*_ordered("a", "b")).where("a < b").distinct(), "edges")
    ends = edges.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    labels = ends.select("doc_id", F.col("doc_id").alias("label"))
    while not edges.isEmpty():
        hooks = edges.groupBy("b").agg(F.min("a").alias("a"))
        # Chains of hooks are followed to their ends before labels change.
        while True:
            up = hooks.select(F.col("b").alias("a"), F.col("a").alias("next"))
            jumped = materialize(
                hooks.join(up, "a", "left").select("b", F.coalesce("next", "a").alias("a"), F.col("next").isNotNull().alias("moved")),
                "hooks",
            )
            hooks = jumped.select("b", "a")
            if jumped.where("moved").isEmpty():
                break
        to = hooks.select(F.col("b").alias("label"), F.col("a").alias("root"))
        labels = materialize(
            labels.join(to, "label", "left").select("doc_id", F.coalesce("root", "label").alias("label")),
            "labels",
        )
        left = hooks.select(F.col("b").alias("a"), F.col("a").alias("ra"))
        right = hooks.select("b", F.col("a").alias("rb"))
        edges = materialize(
            edges.join(left, "a", "left")
            .join(right, "b", "left")
            .select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
            .select(*_ordered("x", "y"))
            .where("a < b")
            .distinct(),
            "edges",
        )
    return labels.select("doc_id", F.col("label").alias("component_id"))


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    ship_package(docs.sparkSession)
    rows = keyed_text(docs, key, text)
    info = materialize(sketches(rows, _hot_shingles(rows)), "sketches")
    found = components(links(rows.where("doc_id IS NOT NULL"), info))
    return info.join(found, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


__all__ = ["components", "links", "similar_components", "sketches"]
