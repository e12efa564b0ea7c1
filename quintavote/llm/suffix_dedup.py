"""Removal of repeated byte strings across documents by suffix arrays.

A byte goes if it lies in a string of ``SIZE`` bytes that also starts in a document
with a smaller id.  Strings are judged on the input, and the smallest document keeps
its copy.

Documents are written once as shards of some megabytes.  Every window of ``SIZE``
bytes is known by the least hash of the 25-byte strings in it, so equal windows have
equal anchors wherever they stand, and a run of windows with one anchor makes a
segment.  Each pass reads the shards where they lie; only small messages move:

1. shards send their distinct anchors to ranges of anchors, which answer which are
   shared by several documents;
2. shards send the distinct segments of shared anchors, each with its smallest document.
   A range settles equal segments by hashing.  Over those whose anchor has other texts as
   well it builds suffix arrays (Larsson-Sadakane) with common prefixes (Kasai) in chunks of
   bounded size, merges the chunks' sorted strings by binary search, and answers which
   windows start in a smaller document elsewhere;
3. shards mark those windows and cut the text.

However often a string occurs, a shard sends it once, so a string in a third of all
documents does not fill one task.  Anchors shared by chance cost a comparison and
nothing else.

Null text is empty.  Rows with a null doc_id are returned whole and are matched with
nothing; rows of one doc_id do not remove each other's text.  Texts shorter than
``SIZE`` bytes stay whole.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quintavote.llm.common import keyed_text, text_bytes
from quintavote.llm.suffix_arrays import NONE, least_owner, merge_least
from quintavote.staging import fresh_path, ship_package

SIZE = 50
SHARD_BYTES = 2 << 20
RANGE_BYTES = 6 << 20
CHUNK_BYTES = 1 << 19
_GRAM = 25
# Windows whose hashes are worked out at once, few enough for the processor's cache.
_TILE = 1 << 14


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the 25-byte string at each place."""
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

    def pair(x: np.ndarray, y: np.ndarray, gap: int) -> np.ndarray:
        n = min(len(x), len(y) - gap)
        out = x[:n] * a
        out += y[gap : gap + n]
        out ^= out >> np.uint64(31)
        out *= b
        return out

    one = (np.arange(1, 257, dtype=np.uint64) * b)[data]
    two = pair(one, one, 1)
    four = pair(two, two, 2)
    eight = pair(four, four, 4)
    sixteen = pair(eight, eight, 8)
    out = pair(pair(sixteen, eight, 16), one, 24)
    out ^= out >> np.uint64(29)
    return out


def _least_of(x: np.ndarray, width: int) -> np.ndarray:
    """Least of the ``width`` values from each place on."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def runs(data: np.ndarray, lengths: np.ndarray, size: int = SIZE):
    """(anchor, first window, last window, document's place) of each run, in text order."""
    ends = np.cumsum(lengths)
    inside = np.ones(len(data), bool)
    for end, length in zip(ends.tolist(), lengths.tolist(), strict=True):
        inside[end - min(length, size - 1) : end] = False
    found = []
    for start in range(0, len(data) - size + 1, _TILE):
        least = _least_of(_grams(data[start : start + _TILE + size - 1]), size - _GRAM + 1)
        here = inside[start : start + len(least)]
        # Where a run begins, or a place without a window stands.
        new = np.ones(len(least) + 1, bool)
        np.not_equal(least[1:], least[:-1], out=new[1:-1])
        new[:-1] |= ~here
        new[1:-1] |= ~here[:-1]
        at = np.flatnonzero(new)
        begins = here[at[:-1]]
        first, last = at[:-1][begins], at[1:][begins] - 1
        # Least values are small ones; mixed again, they spread evenly over the ranges.
        anchor = least[first] * np.uint64(0x9E3779B97F4A7C15)
        anchor = (anchor ^ (anchor >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        found.append((anchor, first + start, last + start))
    if not found:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))
    anchor, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    return anchor, first, last, np.searchsorted(ends, first, side="right")


def _stretches(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all stretches, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class _Shard:
    """What all passes work out alike from one shard."""

    def __init__(self, row, bits: int, size: int):
        self.size = size
        self.data = np.frombuffer(row["data"], np.uint8)
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.known = np.frombuffer(row["known"], bool)
        anchor, self.first, self.last, self.doc = runs(self.data, self.lengths, size)
        keep = self.known[self.doc]
        self.first, self.last, self.doc = self.first[keep], self.last[keep], self.doc[keep]
        self.anchor, self.which = np.unique(
            anchor[keep] >> np.uint64(32 - bits), return_inverse=True
        )

    def by_range(self) -> tuple[np.ndarray, np.ndarray]:
        """Ranges and where each one's anchors begin."""
        ranges = (self.anchor >> np.uint64(32)).astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1])))[: len(ranges)]
        return ranges[start], np.append(start, len(ranges))

    def in_several(self) -> np.ndarray:
        """Anchors of more than one document of this shard."""
        ids = self.ids[self.doc]
        low = np.full(len(self.anchor), NONE)
        high = np.full(len(self.anchor), np.iinfo(np.int64).min)
        np.minimum.at(low, self.which, ids)
        np.maximum.at(high, self.which, ids)
        return low != high

    def segments(self, shared: np.ndarray):
        """Shared runs by anchor, the number of each one's segment, and of the segments: a run, the least document.

        Only runs of one anchor can have equal segments, so most need no look at their text.
        """
        at = np.flatnonzero(shared[self.which])
        at = at[np.argsort(self.which[at], kind="stable")]
        anchor = self.which[at]
        same = np.concatenate(([False], anchor[1:] == anchor[:-1], [False]))
        first_of = np.arange(len(at))
        text, size = self.data, self.size
        number: dict[bytes, int] = {}
        several = np.flatnonzero(same[1:] | same[:-1])
        spots = zip(
            several.tolist(), self.first[at[several]].tolist(), self.last[at[several]].tolist(), strict=True
        )
        for k, a, b in spots:
            first_of[k] = number.setdefault(text[a : b + size].tobytes(), k)
        distinct = first_of == np.arange(len(at))
        of_run = (np.cumsum(distinct) - 1)[first_of]
        owners = self.ids[self.doc[at]]
        least = owners[distinct]
        np.minimum.at(least, of_run[~distinct], owners[~distinct])
        return at, of_run, at[distinct], least

    def ranges(self, run: np.ndarray) -> np.ndarray:
        return (self.anchor[self.which[run]] >> np.uint64(32)).astype(np.int64)


def _answers(parts, key: str) -> dict[int, np.ndarray]:
    return {
        int(p["range"]): np.unpackbits(np.frombuffer(p[key], np.uint8)).astype(bool)
        for p in (parts if parts is not None else ())
    }


def _shared(shard: _Shard, answers: dict[int, np.ndarray]) -> np.ndarray:
    out = np.zeros(len(shard.anchor), bool)
    ranges, start = shard.by_range()
    for r, a, b in zip(ranges.tolist(), start[:-1], start[1:], strict=True):
        if r in answers:
            out[a:b] = answers[r][: b - a]
    return out


def _by_range(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """All rows of one range after the other, from a partition sorted by range."""
    held: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        for r, rows in batch.groupby("range", sort=True):
            if held and r != last:
                yield last, pd.concat(held, ignore_index=True)
                held = []
            last = r
            held.append(rows)
    if held:
        yield last, pd.concat(held, ignore_index=True)


def _range_answers(rows: pd.DataFrame) -> list[bytes]:
    """Of each shard's anchors, which are shared."""
    lists = [np.frombuffer(x, np.uint32) for x in rows["anchors"]]
    several = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(a)] for x, a in zip(rows["several"], lists, strict=True)]
    every = np.concatenate(lists)
    order = np.argsort(every, kind="stable")
    sorted_ = every[order]
    same = sorted_[1:] == sorted_[:-1]
    shared = np.concatenate(several).astype(bool)
    hit = np.zeros(len(every), bool)
    hit[order[1:]] |= same
    hit[order[:-1]] |= same
    shared |= hit
    return [np.packbits(x).tobytes() for x in np.split(shared, np.cumsum([len(a) for a in lists])[:-1])]


def segment_answers(
    shards: list[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]], size: int, chunk_bytes: int
) -> list[bytes]:
    """Per shard, whether each window of its segments starts in a smaller document elsewhere.

    A shard is (texts of its segments, their lengths, their smallest documents, their anchors).
    Equal windows have equal anchors, so an anchor with one text needs no comparing of windows.
    """
    texts = np.frombuffer(b"".join(s[0] for s in shards), np.uint8)
    lengths = np.concatenate([s[1] for s in shards]).astype(np.int64)
    owners = np.concatenate([s[2] for s in shards])
    anchors = np.concatenate([s[3] for s in shards])
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(anchors, kind="stable")
    same = np.concatenate(([False], anchors[order][1:] == anchors[order][:-1], [False]))
    # Equal segments have the place in ``order`` of the first of them.
    first_of = np.arange(len(order))
    number: dict[bytes, int] = {}
    several = np.flatnonzero(same[1:] | same[:-1])
    spots = zip(
        several.tolist(), starts[order[several]].tolist(), lengths[order[several]].tolist(), strict=True
    )
    for k, a, n in spots:
        first_of[k] = number.setdefault(texts[a : a + n].tobytes(), k)
    distinct = np.flatnonzero(first_of == np.arange(len(order)))
    least = owners[order]
    np.minimum.at(least, first_of, owners[order])
    # Segments whose anchor has another text as well.
    anchor = anchors[order[distinct]]
    other = np.concatenate(([False], anchor[1:] == anchor[:-1], [False]))
    compared = distinct[other[1:] | other[:-1]]
    windows = lengths[order] - size + 1
    places = np.cumsum(windows) - windows
    smallest = np.repeat(least, windows)
    if len(compared):
        found = _least_of_windows(
            texts, starts[order[compared]], lengths[order[compared]], least[compared], size, chunk_bytes
        )
        smallest[_stretches(places[compared], windows[compared])] = found
    gone = np.empty(len(smallest), bool)
    # From the order of anchors to that in which the segments were sent.
    sent_windows = lengths - size + 1
    sent = np.cumsum(sent_windows) - sent_windows
    from_ = _stretches(places[first_of], windows)
    to = _stretches(sent[order], windows)
    gone[to] = smallest[from_] < np.repeat(owners[order], windows)
    counts = [int((s[1].astype(np.int64) - size + 1).sum()) for s in shards]
    return [np.packbits(x).tobytes() for x in np.split(gone, np.cumsum(counts)[:-1])]


def _least_of_windows(
    texts: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: np.ndarray, size: int, chunk_bytes: int
) -> np.ndarray:
    """The smallest document of every window of distinct segments, by suffix arrays of bounded chunks."""
    chunk = (np.cumsum(lengths) - lengths) // chunk_bytes
    parts, classes, ends = [], [], []
    for members in np.split(np.arange(len(lengths)), np.flatnonzero(np.diff(chunk)) + 1):
        data = texts[_stretches(starts[members], lengths[members])]
        owner = np.repeat(least[members], lengths[members])
        end = np.repeat(np.cumsum(lengths[members]), lengths[members])
        inside = np.arange(len(data)) + size <= end
        owner[~inside] = NONE
        _, places, smallest, number = least_owner(data, owner, size)
        strings = np.lib.stride_tricks.sliding_window_view(data, size)[places]
        parts.append((np.ascontiguousarray(strings).view(f"S{size}").ravel(), smallest))
        classes.append(number)
        ends.append(inside)
    merged = merge_least(parts)
    return np.concatenate(
        [smallest[number[inside]] for smallest, number, inside in zip(merged, classes, ends, strict=True)]
    )


def _frame(rows: list[dict], names: str) -> pd.DataFrame:
    names = [x.split()[0] for x in names.split(", ")]
    return pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype=object) for n in names})


_SHARD = "shard long, ids binary, known binary, lengths binary, data binary"


def _write_shards(docs: DataFrame, shard_bytes: int, buckets: int) -> DataFrame:
    """Documents as a table of shards, bucketed by shard so that messages come to them."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        ids: list = []
        texts: list[bytes] = []
        number = TaskContext.get().partitionId() << 32

        def row() -> pd.DataFrame:
            known = np.array([i is not None for i in ids], bool)
            return _frame(
                [{
                    "shard": number,
                    "ids": np.array([0 if i is None else i for i in ids], np.int64).tobytes(),
                    "known": known.tobytes(),
                    "lengths": np.array([len(t) for t in texts], np.int64).tobytes(),
                    "data": b"".join(texts),
                }],
                _SHARD,
            )

        held = 0
        for batch in batches:
            for i, text in zip(batch["doc_id"], batch["data"], strict=True):
                ids.append(None if pd.isna(i) else int(i))
                texts.append(bytes(text))
                held += len(text) + 16
                if held >= shard_bytes:
                    yield row()
                    ids, texts, held, number = [], [], 0, number + 1
        if ids:
            yield row()

    spark = docs.sparkSession
    name = f"shards_{uuid.uuid4().hex}"
    binary = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    (
        binary.mapInPandas(pack, _SHARD)
        .write.bucketBy(buckets, "shard")
        .option("path", fresh_path(spark, name))
        .option("compression", "zstd")
        .saveAsTable(name)
    )
    return spark.table(name)


def dedup_substrings(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = SIZE,
    shard_bytes: int = SHARD_BYTES,
    range_bytes: int = RANGE_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start, end in bytes, end excluded), kept bytes of every row."""
    if size < 2 * _GRAM:
        raise ValueError(f"size must be at least {2 * _GRAM}")
    spark = docs.sparkSession
    ship_package(spark)
    rows = keyed_text(docs, key, text)
    total = text_bytes(rows)
    bits = max(0, math.ceil(math.log2(max(1, total / range_bytes))))
    tasks = max(1, min(50_000, math.ceil(total / shard_bytes)))
    shards = _write_shards(rows, shard_bytes, tasks)

    def to_ranges(messages: DataFrame) -> DataFrame:
        return messages.repartition(1 << bits, "range").sortWithinPartitions("range", "shard")

    def send_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                shard = _Shard(row, bits, size)
                several = shard.in_several()
                ranges, start = shard.by_range()
                low = (shard.anchor & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                yield _frame(
                    [
                        {
                            "range": r,
                            "shard": row["shard"],
                            "anchors": low[a:b].tobytes(),
                            "several": np.packbits(several[a:b]).tobytes(),
                        }
                        for r, a, b in zip(ranges.tolist(), start[:-1], start[1:], strict=True)
                    ],
                    "range, shard, anchors, several",
                )

    def judge_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r, rows in _by_range(batches):
            shared = _range_answers(rows)
            yield pd.DataFrame(
                {"range": r, "shard": rows["shard"], "shared": pd.Series(shared, dtype=object)}
            )

    anchors = shards.mapInPandas(
        send_anchors, "range long, shard long, anchors binary, several binary"
    )
    judged = to_ranges(anchors).mapInPandas(
        judge_anchors, "range long, shard long, shared binary"
    )
    shared_path = fresh_path(spark, "shared-anchors")
    judged.write.parquet(shared_path)
    shared = (
        spark.read.parquet(shared_path)
        .groupBy("shard")
        .agg(F.collect_list(F.struct("range", "shared")).alias("shared"))
    )

    def send_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                shard = _Shard(row, bits, size)
                _, _, run, least = shard.segments(
                    _shared(shard, _answers(row["shared"], "shared"))
                )
                lengths = shard.last[run] - shard.first[run] + size
                texts = shard.data[_stretches(shard.first[run], lengths)]
                ends = np.cumsum(lengths)
                anchors = (shard.anchor[shard.which[run]] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                # Runs are in the order of anchors and so of ranges.
                ranges = shard.ranges(run)
                start = np.flatnonzero(np.diff(ranges, prepend=-1))
                yield _frame(
                    [
                        {
                            "range": int(ranges[a]),
                            "shard": row["shard"],
                            "texts": texts[ends[a] - lengths[a] : ends[b - 1]].tobytes(),
                            "lengths": lengths[a:b].astype(np.int32).tobytes(),
                            "least": least[a:b].tobytes(),
                            "anchors": anchors[a:b].tobytes(),
                        }
                        for a, b in zip(start, np.append(start, len(run))[1:], strict=True)
                    ],
                    "range, shard, texts, lengths, least, anchors",
                )

    def judge_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r, rows in _by_range(batches):
            sent = [
                (bytes(t), np.frombuffer(n, np.int32), np.frombuffer(o, np.int64), np.frombuffer(a, np.uint32))
                for t, n, o, a in zip(rows["texts"], rows["lengths"], rows["least"], rows["anchors"], strict=True)
            ]
            smaller = segment_answers(sent, size, chunk_bytes)
            yield pd.DataFrame(
                {"range": r, "shard": rows["shard"], "smaller": pd.Series(smaller, dtype=object)}
            )

    segments = shards.join(shared.hint("shuffle_hash"), "shard", "left").mapInPandas(
        send_segments,
        "range long, shard long, texts binary, lengths binary, least binary, anchors binary",
    )
    answers_path = fresh_path(spark, "segment-answers")
    to_ranges(segments).mapInPandas(
        judge_segments, "range long, shard long, smaller binary"
    ).write.parquet(answers_path)
    both = (
        spark.read.parquet(shared_path)
        .join(spark.read.parquet(answers_path), ["range", "shard"], "left")
        .groupBy("shard")
        .agg(F.collect_list(F.struct("range", "shared", "smaller")).alias("parts"))
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                yield from _cut_shard(row, bits, size)

    schema = (
        "doc_id long, n_bytes long, n_removed long, "
        "spans array<struct<start: long, end: long>>, kept binary"
    )
    return shards.join(both.hint("shuffle_hash"), "shard", "left").mapInPandas(cut, schema)


def _cut_shard(row, bits: int, size: int, per_frame: int = 512) -> Iterator[pd.DataFrame]:
    shard = _Shard(row, bits, size)
    parts = row["parts"] if row["parts"] is not None else []
    shared = _shared(shard, _answers(parts, "shared"))
    at, of_run, run, least = shard.segments(shared)
    smaller = _answers([p for p in parts if p["smaller"] is not None], "smaller")
    # Windows of a segment within the answers of its range, in the order they were sent.
    windows = shard.last[run] - shard.first[run] + 1
    ranges = shard.ranges(run)
    start = np.flatnonzero(np.diff(ranges, prepend=-1))
    answers = [
        smaller[int(ranges[a])][: windows[a:b].sum()]
        for a, b in zip(start, np.append(start, len(run))[1:], strict=True)
    ]
    answer = np.concatenate([np.empty(0, bool), *answers])
    offset = np.cumsum(windows) - windows
    before = np.concatenate(([0], np.cumsum(answer)))
    partly = before[offset + windows] > before[offset]
    gone = np.zeros(len(shard.data) + 1, bool)
    later = shard.ids[shard.doc[at]] > least[of_run]
    whole = at[later]
    gone[_stretches(shard.first[whole], shard.last[whole] - shard.first[whole] + 1)] = True
    some = np.flatnonzero(~later & partly[of_run])
    length = windows[of_run[some]]
    gone[_stretches(shard.first[at[some]], length)] = answer[_stretches(offset[of_run[some]], length)]
    count = np.cumsum(gone)
    covered = count[:-1].copy()
    covered[size:] -= count[:-1][:-size]
    covered = covered > 0
    ends = np.cumsum(shard.lengths)
    starts = ends - shard.lengths
    edge = np.diff(np.concatenate(([0], covered.astype(np.int8), [0])))
    # Spans end with their document even where the next one begins with a span.
    inner = starts[(starts > 0) & (shard.lengths > 0) & (starts < len(covered))]
    split = inner[covered[inner - 1] & covered[inner]]
    opens = np.sort(np.concatenate((np.flatnonzero(edge == 1), split)))
    closes = np.sort(np.concatenate((np.flatnonzero(edge == -1), split)))
    first = np.searchsorted(opens, starts)
    past = np.searchsorted(opens, ends)
    left = ~covered
    for lo in range(0, len(ends), per_frame):
        out = []
        for d in range(lo, min(lo + per_frame, len(ends))):
            a, b = starts[d], ends[d]
            kept = shard.data[a:b][left[a:b]].tobytes()
            spans = [
                {"start": int(x - a), "end": int(y - a)}
                for x, y in zip(opens[first[d] : past[d]], closes[first[d] : past[d]], strict=True)
            ]
            out.append({
                "doc_id": int(shard.ids[d]) if shard.known[d] else None, "n_bytes": int(b - a),
                "n_removed": int(b - a) - len(kept), "spans": spans, "kept": kept,
            })
        yield _frame(out, "doc_id, n_bytes, n_removed, spans, kept")
