"""Repair of turn order in conversations, at least cost.

A legal conversation is an optional system turn followed by user and assistant
turns in alternation, the user first and the assistant last.  Dynamic programming
over the automaton of legal turns reads the turns in order and chooses for each one
to keep it, to merge it into the turn before, or to give it another role, and where
needed to insert empty turns.

The choices compose by (min, +) products of small matrices, so a conversation of any
length is worked in chunks: each chunk is summed up as one matrix, the matrices of a
conversation are chained, and each chunk is then traced back on its own.

Turns are ordered by turn number, then role, then text; equal rows are all kept.  A
null turn number comes first.  Role names are trimmed and lower-cased; an unknown or
null role may become any role at the cost of a relabel.  Null text is empty.  Rows
with a null conv_id form one conversation.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quintavote.staging import ship_package

ROLES = ("system", "user", "assistant")
# Role names that mean one of ROLES.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant"}
MERGE, RELABEL, INSERT = 1.0, 2.0, 3.0
# Turn numbers of one chunk.
CHUNK = 512

# States: nothing yet, or the role of the turn before.
START, S, U, A = range(4)
_STATES = 4
_ROLE_OF = {S: "system", U: "user", A: "assistant"}
# Roles that may follow a state without anything inserted.
_NEXT = {START: (S, U), S: (U,), U: (A,), A: (U,)}
_FINAL = (START, A)


def _inserts(state: int, role: int) -> tuple[int, ...] | None:
    """Empty turns that lead from ``state`` to a turn of ``role``; None if there is no way."""
    if role in _NEXT[state]:
        return ()
    for between in _NEXT[state]:
        if role in _NEXT[between]:
            return (between,)
    if role == A and state == START:
        return (U,)
    return None


def _step(own: int | None) -> tuple[np.ndarray, dict]:
    """Costs from state to state on reading one turn whose role is ``own``, and the choices."""
    cost = np.full((_STATES, _STATES), np.inf)
    choice: dict[tuple[int, int], tuple] = {}
    for state in range(_STATES):
        for role in (S, U, A):
            change = 0.0 if role == own else RELABEL
            ways = [(change + MERGE, "merge", ())] if role == state else []
            extra = _inserts(state, role)
            if extra is not None:
                kind = "keep" if role == own else "relabel"
                ways.append((change + INSERT * len(extra), kind, extra))
            for price, kind, extra in ways:
                if price < cost[state, role]:
                    cost[state, role] = price
                    choice[state, role] = (kind, extra)
    return cost, choice


_CODE = {"system": S, "user": U, "assistant": A}
_STEPS = {own: _step(own) for own in (None, S, U, A)}


def _own(role: str | None) -> int | None:
    name = (role or "").strip().lower()
    return _CODE.get(ALIASES.get(name, name))


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(min, +) product."""
    return (a[:, :, None] + b[None, :, :]).min(axis=1)


def summary(roles: list[str | None]) -> np.ndarray:
    """Least cost from each state before the turns to each state after them."""
    total = np.where(np.eye(_STATES, dtype=bool), 0.0, np.inf)
    for role in roles:
        total = chain(total, _STEPS[_own(role)][0])
    return total


def trace(roles: list[str | None], enter: int, leave: int) -> list[tuple[str, int, tuple]]:
    """(action, role, empty turns inserted before) per turn on a cheapest way; ties to the lower state."""
    best = np.full((len(roles) + 1, _STATES), np.inf)
    best[0, enter] = 0.0
    back = np.zeros((len(roles) + 1, _STATES), int)
    for i, role in enumerate(roles):
        through = best[i][:, None] + _STEPS[_own(role)][0]
        back[i + 1] = through.argmin(axis=0)
        best[i + 1] = through.min(axis=0)
    out, state = [], leave
    for i in range(len(roles), 0, -1):
        before = int(back[i, state])
        kind, extra = _STEPS[_own(roles[i - 1])][1][before, state]
        out.append((kind, state, extra))
        state = before
    return out[::-1]


def final_cost() -> np.ndarray:
    """Cost of ending in each state: an open user or system turn needs an empty answer."""
    return np.array([0.0, 2 * INSERT, INSERT, 0.0])


def closing(state: int) -> tuple[int, ...]:
    """Empty turns that end a conversation."""
    return {START: (), S: (U, A), U: (A,), A: ()}[state]


def _header(role: int) -> str:
    return f"<|im_start|>{_ROLE_OF[role]}\n"


_FOOT = "<|im_end|>\n"
_ORDER = ["conv_id", "chunk", "turn", "role", "text"]


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole (conv_id, chunk) groups of a partition that is sorted by them."""
    held: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        keys = batch["conv_id"].astype("string").fillna("null") + ":" + batch["chunk"].astype(str)
        starts = [0, *(np.flatnonzero(keys.values[1:] != keys.values[:-1]) + 1), len(batch)]
        for a, b in zip(starts, starts[1:], strict=False):
            if held and keys.iloc[a] != last:
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held = []
            last = keys.iloc[a]
            held.append(batch.iloc[a:b])
    if held:
        yield pd.concat(held, ignore_index=True)


def repair(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per turn: what became of it and its part of the rendered conversation.

    conv_id, chunk, seq (place in the chunk), turn, role, new_role, action (keep,
    merge or relabel), inserted (empty turns before), closed (empty turns after the
    last turn), rendered.  The parts of a conversation in the order of (chunk, seq)
    make up its rendering.
    """
    spark = turns.sparkSession
    ship_package(spark)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn(
        "chunk", F.coalesce(F.floor(F.col("turn") / chunk).cast("long"), F.lit(-(1 << 62)))
    )
    dealt = rows.repartition("conv_id", "chunk").sortWithinPartitions(*_ORDER)

    def sum_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for g in _groups(batches):
            total = summary(g["role"].where(g["role"].notna(), None).tolist())
            out.append((g["conv_id"].iloc[0], g["chunk"].iloc[0], total.ravel().tolist()))
            if len(out) == 4096:
                yield _frame(out, ("conv_id", "chunk", "costs"))
                out = []
        yield _frame(out, ("conv_id", "chunk", "costs"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for chunks in _conversations(batches):
            costs = [np.asarray(c, float).reshape(_STATES, _STATES) for c in chunks["costs"]]
            at = [np.where(np.arange(_STATES) == START, 0.0, np.inf)]
            for c in costs:
                at.append((at[-1][:, None] + c).min(axis=0))
            state = int((at[-1] + final_cost()).argmin())
            for i in range(len(costs) - 1, -1, -1):
                enter = int((at[i] + costs[i][:, state]).argmin())
                last = i == len(costs) - 1
                out.append((chunks["conv_id"].iloc[0], chunks["chunk"].iloc[i], enter, state, last))
                state = enter
            if len(out) >= 4096:
                yield _frame(out, ("conv_id", "chunk", "enter", "leave", "last"))
                out = []
        yield _frame(out, ("conv_id", "chunk", "enter", "leave", "last"))

    sums = dealt.mapInPandas(sum_up, "conv_id long, chunk long, costs array<double>")
    # A number of its own: summaries are small, and a plan that goes by size alone would have
    # one task walk all conversations.
    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    states = (
        sums.repartition(tasks, "conv_id")
        .sortWithinPartitions("conv_id", "chunk")
        .mapInPandas(walk, "conv_id long, chunk long, enter int, leave int, last boolean")
    )
    # Null-safe on conv_id without losing the equi-join: null is one conversation of its own.
    joined = rows.alias("r").join(
        states.alias("s"),
        F.col("r.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("r.chunk") == F.col("s.chunk")),
    ).select("r.*", "enter", "leave", "last")
    schema = (
        "conv_id long, chunk long, seq long, turn long, role string, new_role string, "
        "action string, inserted int, closed int, rendered string"
    )
    names = [x.split()[0] for x in schema.split(", ")]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for g in _groups(batches):
            roles = g["role"].where(g["role"].notna(), None).tolist()
            texts, numbers = g["text"].tolist(), g["turn"].tolist()
            enter, leave = int(g["enter"].iloc[0]), int(g["leave"].iloc[0])
            way = trace(roles, enter, leave)
            open_role = enter
            for i, (action, role, extra) in enumerate(way):
                text = ("\n" if action == "merge" else _header(role)) + texts[i]
                before = "" if open_role == START or action == "merge" else _FOOT
                text = before + "".join(_header(e) + _FOOT for e in extra) + text
                closed = ()
                if bool(g["last"].iloc[0]) and i == len(way) - 1:
                    closed = closing(role)
                    text += _FOOT + "".join(_header(e) + _FOOT for e in closed)
                out.append((
                    g["conv_id"].iloc[0], g["chunk"].iloc[0], i, numbers[i], roles[i],
                    _ROLE_OF[role], action, len(extra), len(closed), text,
                ))
                open_role = role
            if len(out) >= 2048:
                yield _frame(out, names)
                out = []
        yield _frame(out, names)

    return joined.repartition("conv_id", "chunk").sortWithinPartitions(*_ORDER).mapInPandas(
        write, schema
    )


def _conversations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunk summaries of one conversation after the other."""

    def alike() -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(own=batch["chunk"], chunk=0)

    for g in _groups(alike()):
        yield g.assign(chunk=g["own"])


_LONGS = {"conv_id", "chunk", "seq", "turn", "enter", "leave", "inserted", "closed"}


def _frame(rows: list[tuple], names) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=list(names), dtype=object)
    for name in _LONGS & set(names):
        column = frame[name]
        frame[name] = column.where(column.notna(), pd.NA).astype("Int64")
    return frame
