"""Chat formatting by minimum-cost role repair.

A conversation is legal if it is an optional system turn, then user and assistant turns in alternation
that begin with the user and end with the assistant.  For any sequence of turns a dynamic
program over the automaton of legal turns finds the cheapest repair: keep a turn, merge it into the turn before,
give it another role, or insert an empty turn.  Of equally cheap repairs the one whose first differing
step stands earlier in the order keep, merge, relabel, insert is taken.  The repaired turns are then rendered.

The program is a product of small (min, +) matrices, one per turn, which is associative.  So a conversation of any length
can be split over tasks: turns are sorted over the cluster, and a stretch that holds only part of a
conversation first gives its matrix; costs from each stretch's end on, and the state at its start, follow from one
pass over the stretches, of which there are no more than partitions.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import stage

SYSTEM, USER, ASSISTANT = "system", "user", "assistant"
ROLES = (SYSTEM, USER, ASSISTANT)
# States: nothing yet, or the role of the last turn.
STATES = ("start", *ROLES)
FOLLOWERS = {"start": (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FINAL = ("start", ASSISTANT)
MERGE, RELABEL, INSERT = 2, 3, 4
FAR = 1 << 40


def _paths(state: str, role: str) -> tuple[str, ...] | None:
    """The empty turns to insert after ``state`` so that ``role`` may follow; None if none do."""
    for n in range(len(ROLES) + 1):
        for between in itertools.product(ROLES, repeat=n):
            chain = (state, *between, role)
            if all(b in FOLLOWERS[a] for a, b in zip(chain, chain[1:])):
                return between
    return None


def steps(role: str | None) -> list[tuple[int, int, int, str, tuple[str, ...]]]:
    """All ways to take a turn: (state, next state, cost, action, inserted roles), in order of preference."""
    out = []
    for i, state in enumerate(STATES):
        for target in ROLES:
            label = 0 if target == role else RELABEL
            name = "keep" if target == role else "relabel"
            if state == target:
                out.append((i, i, MERGE + label, "merge" if not label else "relabel+merge", ()))
            between = _paths(state, target)
            if between is not None:
                action = name if not between else f"insert+{name}" if label else "insert"
                out.append((i, STATES.index(target), label + INSERT * len(between), action, between))
    order = ("keep", "merge", "relabel", "relabel+merge", "insert", "insert+relabel")
    return sorted(out, key=lambda s: (order.index(s[3]), s[2], s[1]))


STEPS = {role: steps(role) for role in (*ROLES, None)}


def ending(state: str) -> tuple[str, ...]:
    """The empty turns that close a conversation."""
    for n in range(len(ROLES) + 1):
        for between in itertools.product(ROLES, repeat=n):
            chain = (state, *between)
            if chain[-1] in FINAL and all(b in FOLLOWERS[a] for a, b in zip(chain, chain[1:])):
                return between
    raise AssertionError(state)


CLOSING = np.array([INSERT * len(ending(s)) for s in STATES])
MATRICES = {}
for _role, _steps in STEPS.items():
    m = np.full((len(STATES), len(STATES)), FAR)
    for a, b, cost, _, _ in _steps:
        m[a, b] = min(m[a, b], cost)
    MATRICES[_role] = m


def _known(role: str | None) -> str | None:
    role = (role or "").strip().lower()
    return role if role in ROLES else None


def costs_to_go(roles: list, after: np.ndarray) -> list[np.ndarray]:
    """Least cost from every state before each turn, given the costs after the last one."""
    out = [after]
    for role in reversed(roles):
        out.append((MATRICES[role] + out[-1][None, :]).min(1))
    return out[::-1]


def repair(roles: list, state: int, after: np.ndarray) -> tuple[list[tuple], int]:
    """The preferred cheapest steps from ``state``, and the state they end in."""
    go, chosen = costs_to_go(roles, after), []
    for i, role in enumerate(roles):
        step = next(s for s in STEPS[role] if s[0] == state and s[2] + go[i + 1][s[1]] == go[i][state])
        chosen.append(step)
        state = step[1]
    return chosen, state


def product(roles: list) -> np.ndarray:
    """Least cost from every state to every state over a stretch of turns."""
    m = np.where(np.eye(len(STATES), dtype=bool), 0, FAR)
    for role in roles:
        m = np.minimum((m[:, :, None] + MATRICES[role][None, :, :]).min(1), FAR)
    return m


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with the same leading ``keys`` columns, across batches."""
    rows = itertools.chain.from_iterable(zip(*(b.column(c).to_pylist() for c in columns)) for b in batches)
    for key, group in itertools.groupby(rows, key=lambda r: r[:keys]):
        yield key, list(group)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The cheapest legal form of every conversation, one row per turn of the input and per inserted turn.

    ``turns``: conv_id, turn, role, text; other columns are ignored.  Returns conv_id, stretch, place (the order
    within a conversation is by stretch, place), turn (null for a closing insertion), role, action (keep, merge, relabel,
    relabel+merge, insert), cost, rendered.  The rendered pieces of a conversation in that order, put together,
    are its text: every turn is a role line, its text and a blank line; merged turns follow on a new line.

    Roles are compared without case and outer blanks; any other or null role must be relabelled.  Null text is
    empty.  Rows with a null conv_id form one conversation.  Turns are ordered by number (null first), then by
    a hash of role and text, so equal turn numbers have a fixed order; repeated rows are turns of their own.
    An empty table gives an empty result.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("tie", F.xxhash64("role", "text"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "tie", "serial"]
    # the last key only separates rows that are alike in all that matters, so that a task can end among them
    placed = rows.withColumn("serial", F.monotonically_increasing_id()).repartitionByRange(parts, *order).withColumn("stretch", F.spark_partition_id())
    placed = stage(placed, "turns")
    ends = placed.groupBy("conv_id", "stretch").agg(F.count("*").alias("n"))
    many = ends.groupBy("conv_id").agg(F.count("*").alias("stretches"), F.max("stretch").alias("last")).filter("stretches > 1").select("conv_id", "last")
    # at most two conversations per stretch run on into another one
    split = placed.select("conv_id", "stretch", "turn", "tie", "serial", "role").join(
        many.select(F.col("conv_id").alias("c")), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi"
    )

    def by_stretch(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "stretch").sortWithinPartitions("stretch", *order)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (stretch, conv), group in _runs(batches, ["stretch", "conv_id", "role"], 2):
            m = product([_known(r[2]) for r in group])
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([stretch], pa.int32()), pa.array([m.ravel().tolist()], pa.list_(pa.int64()))],
                ["conv_id", "stretch", "matrix"],
            )

    matrices = stage(by_stretch(split).select("stretch", "conv_id", "role").mapInArrow(multiply, "conv_id long, stretch int, matrix array<long>"), "matrices")

    def backward(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("stretch").reset_index(drop=True)
        after, out = CLOSING, []
        for m in reversed(pdf["matrix"].tolist()):
            out.append(after.tolist())
            after = (np.array(m).reshape(len(STATES), -1) + after[None, :]).min(1)
        return pd.DataFrame({"conv_id": pdf["conv_id"], "stretch": pdf["stretch"], "after": out[::-1]})

    costs = stage(matrices.groupBy("conv_id").applyInPandas(backward, "conv_id long, stretch int, after array<long>"), "costs")

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (stretch, conv), group in _runs(batches, ["stretch", "conv_id", "role", "after"], 2):
            roles, after = [_known(r[2]) for r in group], np.array(group[0][3])
            ends_in = [repair(roles, s, after)[1] for s in range(len(STATES))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([stretch], pa.int32()), pa.array([ends_in], pa.list_(pa.int32()))],
                ["conv_id", "stretch", "ends_in"],
            )

    def with_costs(df: DataFrame, found: DataFrame, how: str) -> DataFrame:
        other = found.withColumnsRenamed({"conv_id": "c", "stretch": "s"})
        return df.join(other, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("stretch") == F.col("s")), how).drop("c", "s")

    maps = by_stretch(with_costs(split, costs, "inner")).select("stretch", "conv_id", "role", "after").mapInArrow(
        advance, "conv_id long, stretch int, ends_in array<int>"
    )

    def forward(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("stretch").reset_index(drop=True)
        state, out = 0, []
        for m in pdf["ends_in"]:
            out.append(state)
            state = int(m[state])
        return pd.DataFrame({"conv_id": pdf["conv_id"], "stretch": pdf["stretch"], "state": out})

    states = maps.groupBy("conv_id").applyInPandas(forward, "conv_id long, stretch int, state int")
    last = many.withColumnsRenamed({"conv_id": "c", "last": "s"}).withColumn("final", F.lit(True))
    known = with_costs(costs, states, "left")
    known = stage(
        known.join(last, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("stretch") == F.col("s")), "left")
        .select("conv_id", "stretch", "after", F.coalesce("state", F.lit(0)).alias("state"), F.coalesce("final", F.lit(False)).alias("final")),
        "states",
    )

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["stretch", "conv_id", "turn", "role", "text", "after", "state", "final"]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*held), kinds)], ["conv_id", "stretch", "place", "turn", "role", "action", "cost", "rendered"]
            )
            held.clear()
            return made

        for (stretch, conv), group in _runs(batches, names, 2):
            whole = group[0][5] is None
            after = CLOSING if whole else np.array(group[0][5])
            state = 0 if whole else group[0][6]
            chosen, final_state = repair([_known(r[3]) for r in group], state, after)
            opened = state != 0
            for i, (row, (_, to, cost, action, between)) in enumerate(zip(group, chosen)):
                for role in between:
                    held.append((conv, stretch, 2 * i, row[2], role, "insert", INSERT, f"{'' if not opened else chr(10)}{role}:\n\n"))
                    opened = True
                own = cost - INSERT * len(between)
                merged = action in ("merge", "relabel+merge")
                lead = "" if merged else f"{chr(10) if opened else ''}{STATES[to]}:\n"
                name = action.removeprefix("insert+") if action != "insert" else "keep"
                held.append((conv, stretch, 2 * i + 1, row[2], STATES[to], name, own, f"{lead}{row[4]}\n"))
                opened = True
            if whole or group[0][7]:
                for j, role in enumerate(ending(STATES[final_state])):
                    held.append((conv, stretch, 2 * len(group) + j, None, role, "insert", INSERT, f"\n{role}:\n\n"))
            if len(held) >= 1000:
                yield batch()
        if held:
            yield batch()

    return by_stretch(with_costs(placed, known, "left")).select(
        "stretch", "conv_id", "turn", "role", "text", "after", "state", "final"
    ).mapInArrow(render, "conv_id long, stretch int, place int, turn long, role string, action string, cost long, rendered string")
