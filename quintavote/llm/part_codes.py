r"""Vector codes: integer product quantisation, trained with adaptive distance bounds.

Every component x becomes floor(scale * x); vectors are cut into equal consecutive parts, and
each part position has a codebook.  A round assigns every part to its nearest entry (squared
Euclidean distance, ties to the lower index) and replaces every entry by the componentwise
floor of the mean of its parts; an unused entry stays.

Rounds do not measure every part against every entry.  Each part keeps, from round to round,
an upper bound of the distance to its entry, the b entries that came next with lower bounds in
ascending order, and one outer bound below the distance of all others (Drake and Hamerly).  An
entry's bounds give way by as far as it moved, the outer bound by the largest move.  A part
whose upper bound lies under all its lower bounds keeps its entry unmeasured; otherwise it is
measured against the entries whose bounds fail, and against all where the outer bound fails.
b adapts: it starts at a quarter of the entries and shrinks to the most that any part needed,
not below an eighth.  Bounds are floats rounded outward; distances that decide are integers,
so the codes are those of a plain search.

A round is one job: it reads the vectors with their bounds, writes them with new ones, and
leaves sums and counts by part and entry, a row a task.  The table of the round before goes.

Rows whose vector is null, or holds null or non-finite components, are dropped.  The width is
that of the kept row of least id with a whole number of components in every part, and rows of
another width are dropped too.  Components from 2**27 on after scaling are refused.  A codebook
starts with the parts of the ``entries`` smallest distinct ids (of rows with one id, the
smallest vector; fewer entries where there are fewer ids).  Rows without an id are coded but
start no codebook; without any id nothing is coded.  Repeated rows are coded alike; extra
columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quintavote.staging import delete_folder, fresh_path, ship_package

SCALE = 4_096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
LARGEST = 1 << 27
# Integers of the differences held at once, which bounds a task's memory at any width.
CELLS = 1 << 21
# Labels up to this number are broadcast with their sums.
FEW_LABELS = 100_000

STATE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("label", T.StringType()),
        T.StructField("vector", T.ArrayType(T.IntegerType())),
        T.StructField("codes", T.BinaryType()),
        T.StructField("near", T.BinaryType()),
        T.StructField("bounds", T.BinaryType()),
        T.StructField("error", T.LongType()),
        # Of the row a task leaves: counts and sums by part and entry, and what b served.
        T.StructField("sums", T.ArrayType(T.LongType())),
        T.StructField("used", T.IntegerType()),
        T.StructField("measured", T.LongType()),
    ]
)
CARRIED = ["id", "label", "vector", "codes", "near", "bounds"]
_ARROW = pa.schema(
    [
        ("id", pa.int64()),
        ("label", pa.string()),
        ("vector", pa.list_(pa.int32())),
        ("codes", pa.binary()),
        ("near", pa.binary()),
        ("bounds", pa.binary()),
        ("error", pa.int64()),
        ("sums", pa.list_(pa.int64())),
        ("used", pa.int32()),
        ("measured", pa.int64()),
    ]
)


@dataclass(frozen=True)
class Step:
    """What a round needs to know: codebooks (part, entry, component) and the moves to them."""

    books: np.ndarray
    moves: np.ndarray | None  # (part, entry), rounded up; none in the first round
    had: int  # b of the stored bounds
    keep: int  # b to store


def _up(values: np.ndarray) -> np.ndarray:
    return np.nextafter(values.astype(np.float32), np.float32(np.inf))


def _down(values: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(values.astype(np.float32), np.float32(-np.inf)), np.float32(0))


def _squares(parts: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Integer squared distances of parts (row, component) to entries (entry, component)."""
    gaps = parts[:, None, :] - books[None, :, :]
    return np.einsum("nec,nec->ne", gaps, gaps)


def measure_all(parts: np.ndarray, book: np.ndarray, keep: int):
    """Code, upper bound, next entries, lower bounds and outer bound from all distances."""
    squares = _squares(parts, book)
    order = np.argsort(squares, axis=1, kind="stable")
    sorted_ = np.take_along_axis(squares, order, axis=1)
    roots = np.sqrt(sorted_.astype(np.float64))
    lower = np.full((len(parts), keep + 1), np.inf, dtype=np.float32)
    got = min(keep + 1, len(book) - 1)
    lower[:, :got] = _down(roots[:, 1 : got + 1])
    near = np.zeros((len(parts), keep), dtype=np.uint8)
    listed = min(keep, len(book) - 1)
    near[:, :listed] = order[:, 1 : listed + 1]
    return order[:, 0].astype(np.uint8), _up(roots[:, 0]), near, lower


def advance(parts, book, moves, code, upper, near, lower, keep):
    """One part position of one batch, one round on.

    ``lower`` holds the bounds of the ``near`` entries and, last, of all others.  Returns the
    same arrays for the new codebook, cut to ``keep`` entries, the most listed entries that a
    part needed, and the number of distances measured.
    """
    rows, had = near.shape
    book_size = len(book)
    upper = _up(upper + moves[code])
    lower = lower.copy()
    lower[:, :had] = _down(lower[:, :had] - moves[near])
    lower[:, had] = _down(lower[:, had] - moves.max(initial=0))
    # Bounds ascend: a listed entry's is at most that of the ones behind it.
    ordered = np.minimum.accumulate(lower[:, ::-1], axis=1)[:, ::-1]
    # How many of the listed entries may be nearer or as near: all before the first safe bound.
    unsafe = (upper[:, None] >= ordered).sum(axis=1)
    code = code.copy()
    near = near.copy()
    measured = 0

    all_ = np.flatnonzero(unsafe > had)
    if len(all_):
        code[all_], upper[all_], near_, lower_ = measure_all(parts[all_], book, had)
        near[all_], ordered[all_] = near_, lower_
        measured += len(all_) * book_size

    most = 0
    for z in range(1, had + 1):
        some = np.flatnonzero(unsafe == z)
        if not len(some):
            continue
        most = z
        # The own entry and the first z listed, by (distance, index).
        ids = np.concatenate([code[some, None], near[some, :z]], axis=1)
        gaps = parts[some, None, :] - book[ids]
        squares = np.einsum("nec,nec->ne", gaps, gaps)
        measured += squares.size
        order = np.lexsort((ids, squares), axis=1)
        ids = np.take_along_axis(ids, order, axis=1)
        roots = np.sqrt(np.take_along_axis(squares, order, axis=1).astype(np.float64))
        code[some], upper[some] = ids[:, 0], _up(roots[:, 0])
        near[some[:, None], np.arange(z)] = ids[:, 1:]
        ordered[some[:, None], np.arange(z)] = _down(roots[:, 1:])
    if len(all_):
        most = had
    # A bound must not exceed those behind it, as later rounds stop at the first safe one.
    ordered = np.minimum.accumulate(ordered[:, ::-1], axis=1)[:, ::-1]
    if keep < had:
        # The first bound left out is below all that is no longer listed.
        near, ordered = near[:, :keep], ordered[:, : keep + 1]
    return code, upper, near, np.ascontiguousarray(ordered), most, measured


def _packed(array: np.ndarray) -> pa.Array:
    """One binary value a row."""
    rows = len(array)
    flat = np.ascontiguousarray(array).view(np.uint8).reshape(-1)
    each = flat.size // max(rows, 1)
    offsets = np.arange(0, flat.size + 1, max(each, 1), dtype=np.int32)[: rows + 1]
    return pa.Array.from_buffers(
        pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())]
    )


def _unpacked(column: pa.Array, dtype, *shape: int) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, dtype=dtype).reshape(len(column), *shape)


def _lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    offsets = np.arange(0, rows * width + 1, width, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1)))


def _assign_batch(batch: pa.RecordBatch, step: Step) -> tuple[pa.RecordBatch, np.ndarray, int, int]:
    parts_n, book_size, width = step.books.shape
    rows = batch.num_rows
    flat = batch["vector"].flatten().to_numpy(zero_copy_only=False)
    values = flat.reshape(rows, parts_n, width).astype(np.int64)
    keep = step.keep
    codes = np.empty((rows, parts_n), dtype=np.uint8)
    near = np.empty((rows, parts_n, keep), dtype=np.uint8)
    bounds = np.empty((rows, parts_n, keep + 2), dtype=np.float32)
    if step.moves is not None:
        old_codes = _unpacked(batch["codes"], np.uint8, parts_n)
        old_near = _unpacked(batch["near"], np.uint8, parts_n, step.had)
        old_bounds = _unpacked(batch["bounds"], np.float32, parts_n, step.had + 2)
    error = np.zeros(rows, dtype=np.int64)
    sums = np.zeros((parts_n, book_size, width + 1), dtype=np.int64)
    most = measured = 0
    for p in range(parts_n):
        part, book = values[:, p], step.books[p]
        if step.moves is None:
            code, upper, close, lower = measure_all(part, book, keep)
            measured += part.shape[0] * book_size
        else:
            code, upper, close, lower, needed, count = advance(
                part, book, step.moves[p], old_codes[:, p], old_bounds[:, p, 0],
                old_near[:, p], old_bounds[:, p, 1:], keep,
            )
            most, measured = max(most, needed), measured + count
        codes[:, p], near[:, p], bounds[:, p, 0], bounds[:, p, 1:] = code, close, upper, lower
        gaps = part - book[code]
        error += np.einsum("nc,nc->n", gaps, gaps)
        sums[p, :, 0] += np.bincount(code, minlength=book_size)
        np.add.at(sums[p, :, 1:], code, part)
    nothing = [pa.nulls(rows, _ARROW.field(name).type) for name in ("sums", "used", "measured")]
    out = pa.RecordBatch.from_arrays(
        [batch["id"], batch["label"], batch["vector"], _packed(codes), _packed(near), _packed(bounds)]
        + [pa.array(error), *nothing],
        schema=_ARROW,
    )
    return out, sums, most, measured


def _round(state: DataFrame, step: Step, path: str) -> DataFrame:
    """Assign every row under ``step`` and write the state, with a row of sums from each task."""
    ship_package(state.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(step.books.shape[:2] + (step.books.shape[2] + 1,), dtype=np.int64)
        most = measured = 0
        rows = max(1, CELLS // step.books[0].size)
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                out, sums, needed, count = _assign_batch(batch.slice(start, rows), step)
                total += sums
                most, measured = max(most, needed), measured + count
                yield out
        if measured or total.any():
            last = {"sums": [total.reshape(-1).tolist()], "used": [most], "measured": [measured]}
            yield pa.RecordBatch.from_pydict(
                {f.name: last.get(f.name, [None]) for f in _ARROW}, schema=_ARROW
            )

    state.mapInArrow(run, STATE).withColumn(
        "kind", F.when(F.col("sums").isNull(), "rows").otherwise("sums")
    ).write.partitionBy("kind").parquet(path)
    schema = T.StructType([*STATE.fields, T.StructField("kind", T.StringType())])
    return state.sparkSession.read.schema(schema).parquet(path)


def _totals(written: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, int, int]:
    """Sums of all tasks (one row of a fixed size), the most entries needed, distances measured."""
    of_tasks = written.where("kind = 'sums'")
    added = of_tasks.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n"))
    total = np.zeros(int(np.prod(shape)), dtype=np.int64)
    for row in added.collect():
        total[row["pos"]] = row["n"]
    used, measured = of_tasks.agg(F.max("used"), F.sum("measured")).first()
    return total.reshape(shape), used or 0, measured or 0


def _moved(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    gaps = new - old
    return _up(np.sqrt(np.einsum("pec,pec->pe", gaps, gaps).astype(np.float64)))


@dataclass(frozen=True)
class Coded:
    """Rows (id, label, codes, error), the codebooks, and the distances each pass measured."""

    rows: DataFrame
    books: np.ndarray
    measured: list[int]


def quantised(
    table: DataFrame, id_: str, vector: str, label: str | None, scale: int, parts: int
) -> DataFrame:
    """id, label (as text), vector of integers; rows that cannot be coded are left out."""
    values = F.col(vector).cast("array<double>")
    whole = F.expr(
        "v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    )
    named = F.col(label).cast("string") if label else F.lit(None).cast("string")
    kept = table.select(F.col(id_).cast("long").alias("id"), named.alias("label"), values.alias("v")).where(whole)
    fits = kept.where((F.size("v") % parts == 0) & F.col("id").isNotNull())
    first = fits.groupBy("id").agg(F.min(F.size("v")).alias("width")).orderBy("id").first()
    width = first["width"] if first else 0
    limit = F.lit(float(LARGEST))
    scaled = F.transform(
        "v",
        lambda x: F.when(F.abs(x * scale) < limit, F.floor(x * scale).cast("int")).otherwise(
            F.raise_error(F.lit("a component is too large to be coded")).cast("int")
        ),
    )
    return kept.where(F.size("v") == width).select("id", "label", scaled.alias("vector"))


def train(
    table: DataFrame,
    id_: str = "vec_id",
    vector: str = "embedding",
    label: str | None = "label",
    scale: int = SCALE,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> Coded | None:
    """Codebooks after ``rounds``, and the codes under them.  None where nothing can be coded."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must fit one byte")
    spark = table.sparkSession
    rows = quantised(table, id_, vector, label, scale, parts)
    ids = rows.where("id IS NOT NULL").select("id").distinct().orderBy("id").limit(entries)
    first = [r["id"] for r in ids.collect()]
    if not first:
        return None
    seeds = rows.where(F.col("id").isin(first)).groupBy("id").agg(F.min("vector").alias("v"))
    start = np.array([r["v"] for r in seeds.orderBy("id").collect()], dtype=np.int64)
    books = np.ascontiguousarray(start.reshape(len(first), parts, -1).transpose(1, 0, 2))
    shape = books.shape[:2] + (books.shape[2] + 1,)

    others = len(first) - 1
    keep = max(1, -(-len(first) // 4))
    least = max(1, -(-len(first) // 8))
    state = rows
    step = Step(books, None, keep, min(keep, max(others, 1)))
    before, measured = None, []
    for turn in range(rounds + 1):
        path = fresh_path(spark, "codes")
        written = _round(state, step, path)
        totals, used, count = _totals(written, shape)
        measured.append(count)
        if before:
            delete_folder(spark, before)
        before, state = path, written.where("kind = 'rows'").select(*CARRIED, "error")
        if turn == rounds:
            break
        counts, sums = totals[:, :, :1], totals[:, :, 1:]
        # Floor division of integers, as the mean is rounded down.
        books = np.where(counts > 0, sums // np.maximum(counts, 1), step.books)
        had = step.keep
        narrower = min(had, max(least, used)) if turn else had
        step = Step(books, _moved(step.books, books), had, narrower)
        state = state.select(*CARRIED)
    return Coded(state.select("id", "label", "codes", "error"), step.books, measured)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components as decimals, by part, entry and place."""
    text = ",".join(str(x) for x in books.reshape(-1).tolist())
    return hashlib.sha256(text.encode()).hexdigest()


def decode(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """Add ``approximate``, the vector that a row's codes stand for."""
    table = F.lit(books.reshape(-1).tolist())
    parts, entries, width = books.shape
    one = f"(CAST(conv(hex(substring(codes, p, 1)), 16, 10) AS int) + {entries} * (p - 1)) * {width}"
    pieces = F.expr(
        f"flatten(transform(sequence(1, {parts}), p -> transform(slice(book, {one} + 1, {width}),"
        f" x -> x / {float(scale)}D)))"
    )
    return codes.withColumn("book", table).withColumn("approximate", pieces).drop("book")


def with_label_errors(rows: DataFrame) -> DataFrame:
    """Add ``label_error``: error summed over equal labels, rows without a label together."""
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    few = sums.limit(FEW_LABELS + 1).count() <= FEW_LABELS
    by = sums.select(F.col("label").alias("_label"), "label_error")
    return rows.join(F.broadcast(by) if few else by, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
