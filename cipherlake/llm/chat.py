"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn followed by user and assistant
turns in alternation, the assistant last.  Each row either keeps its role,
takes another one, is merged into the turn before it, or has an empty turn put
in front of it; the cheapest way over the whole conversation is found by
dynamic programming over the automaton of last roles.

A conversation may be of any length.  Rows are sorted over the cluster, so a
long one lies in several partitions.  The cost of a stretch of rows is a small
matrix over (role before, role after); the matrices of the stretches at
partition borders are joined to fix the roles at the borders, and then each
partition repairs its own rows.

Cases: rows of a conversation go by ``turn`` (nulls first), then role, then a
hash of the text; a null or unknown role has to be relabelled; a null text is an empty
one; rows without ``conv_id`` form one conversation; an empty table gives an
empty result; further columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherlake.llm.text import slices
from cipherlake.plans.scratch import scratch_root

ROLES = ("system", "user", "assistant")
#: States: no turn yet, or the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, INSERT = 1.0, 2.0, 3.0
#: What it costs to end in a state, and the empty turns that are put behind it.
ENDING = {START: (2 * INSERT, (USER, ASSISTANT)), SYSTEM: (2 * INSERT, (USER, ASSISTANT)), USER: (INSERT, (ASSISTANT,)), ASSISTANT: (0.0, ())}
#: Rows and bytes of text of a partition, about; and bytes of text that are rendered at once.
ROWS, BYTES, SLICE = 50_000, 1 << 25, 1 << 20


def moves() -> tuple[np.ndarray, dict]:
    """``cost[role, before, after]`` (role 3: unknown) and of each move (merged?, role of an empty turn before it)."""
    cost, how = np.full((4, 4, 4), np.inf), {}
    for role in range(4):
        for before in range(4):
            for after in (SYSTEM, USER, ASSISTANT):
                change = RELABEL * (role != after - 1)
                ways = []
                if before == after:
                    ways.append((change + MERGE, True, None))
                if after in FOLLOWS[before]:
                    ways.append((change, False, None))
                ways += [(change + INSERT, False, gap) for gap in FOLLOWS[before] if after in FOLLOWS[gap] and gap != SYSTEM]
                if ways:
                    best = min(ways, key=lambda w: w[0])
                    cost[role, before, after], how[role, before, after] = best[0], best[1:]
    return cost, how


def role_code(role: str | None) -> int:
    return ROLES.index(role) if role in ROLES else 3


def stretch(roles: list[int], cost: np.ndarray) -> np.ndarray:
    """Least cost of a stretch of rows between each pair of states."""
    total = np.where(np.eye(4, dtype=bool), 0.0, np.inf)
    for role in roles:
        total = (total[:, :, None] + cost[role][None]).min(axis=1)
    return total


def path(roles: list[int], start: int, end: int, cost: np.ndarray) -> list[int]:
    """States after each row of the cheapest way from ``start`` to ``end``; ties go to the lower state."""
    least, back = np.where(np.arange(4) == start, 0.0, np.inf), []
    for role in roles:
        ways = least[:, None] + cost[role]
        back.append(ways.argmin(axis=0))
        least = ways.min(axis=0)
    states = [end]
    for step in reversed(back[1:]):
        states.append(int(step[states[-1]]))
    return states[::-1]


def runs(values: list) -> list[tuple[int, int]]:
    """Ranges of equal neighbours."""
    edges = [i for i in range(len(values)) if not i or values[i] != values[i - 1]]
    return list(zip(edges, [*edges[1:], len(values)], strict=True))


def repaired(turns: DataFrame) -> DataFrame:
    """One row per row of ``turns (conv_id, turn, role, text)``: what becomes of it and its piece of the rendered conversation.

    ``new_role`` is the role of the turn it belongs to, ``merged`` whether that
    is the turn of the row before, ``inserted`` an empty turn's role in front of
    it; the pieces ``rendered`` of a conversation, in order of ``position``, are
    its rendering.
    """
    spark = turns.sparkSession
    scratch_root(spark)
    names = turns.select("conv_id", "turn", "role", F.col("text").cast("string").alias("text"))
    total = names.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string")).cast("long")), F.lit(0)).alias("bytes")).first()
    number = max(spark.sparkContext.defaultParallelism, 1 + total["rows"] // ROWS, 1 + total["bytes"] // BYTES)
    kind = names.schema["conv_id"].dataType.simpleString()
    # The last key tells equal rows apart, so that any number of them can be split.
    order = ["conv_id", "turn", "role", F.xxhash64("text"), "__row"]
    keyed = names.withColumns({"turn": F.col("turn").cast("long"), "__row": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange(number, *order).sortWithinPartitions(*order).drop("__row").checkpoint()
    cost, how = moves()

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held) if (held := list(batches)) else None
        if rows is not None and rows.num_rows:
            found = runs(rows.column(0).to_pylist())
            codes = [role_code(r) for r in rows.column(1).to_pylist()]
            edge = sorted({0, len(found) - 1})
            yield pa.RecordBatch.from_arrays([rows.column(0).combine_chunks().take(pa.array([found[k][0] for k in edge])), pa.array([TaskContext.get().partitionId()] * len(edge), pa.int32()), pa.array([k == 0 for k in edge]), pa.array([k == len(found) - 1 for k in edge]), pa.array([found[k][1] - found[k][0] for k in edge], pa.int64()), pa.array([stretch(codes[slice(*found[k])], cost).ravel().tolist() for k in edge], pa.list_(pa.float64()))], ["conv_id", "part", "first", "last", "n", "costs"])

    borders = ordered.select("conv_id", "role").mapInArrow(ends, f"conv_id {kind}, part int, first boolean, last boolean, n long, costs array<double>")
    # Two rows of each partition, whatever its size.
    borders = sorted(borders.collect(), key=lambda r: (r["part"], not r["first"]))
    plan: dict[tuple[int, bool], tuple[int, int, int, bool]] = {}  # of a partition's first and last stretch: state before, state after (-1: free), rows before, whether the conversation ends
    i = 0
    while i < len(borders):
        j = i + 1
        while j < len(borders) and borders[j]["first"] and borders[j - 1]["last"] and borders[j]["conv_id"] == borders[i]["conv_id"]:
            j += 1
        group = borders[i:j]
        least, back = np.array([0.0, np.inf, np.inf, np.inf]), []
        for row in group:
            ways = least[:, None] + np.array(row["costs"]).reshape(4, 4)
            back.append(ways.argmin(axis=0))
            least = ways.min(axis=0)
        state = int((least + np.array([ENDING[s][0] for s in range(4)])).argmin())
        states = [state]
        for step in reversed(back):
            states.append(int(step[states[-1]]))
        states, before = states[::-1], 0
        for k, row in enumerate(group):
            for which in {True: row["first"], False: row["last"]}.items():
                if which[1]:
                    plan[row["part"], which[0]] = (states[k], states[k + 1], before, k == len(group) - 1)
            before += row["n"]
        i = j

    kinds = (pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.float64(), pa.string())
    columns = ["conv_id", "turn", "role", "position", "new_role", "merged", "inserted", "cost", "rendered"]

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The roles of a partition are looked at together; its texts stay in Arrow's form but for a slice.
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        part = TaskContext.get().partitionId()
        codes = [role_code(r) for batch in held for r in batch.column(2).to_pylist()]
        found = runs([c for batch in held for c in batch.column(0).to_pylist()])
        # Of each row: its place, role, whether it is merged, the empty turn before it, cost, and the conversation's end.
        decided: list[tuple] = []
        for k, (a, b) in enumerate(found):
            mine = codes[a:b]
            if k == 0 or k == len(found) - 1:
                state, end, before, closes = plan[part, k == 0]
            else:
                state, before, closes = START, 0, True
                end = int((stretch(mine, cost)[START] + np.array([ENDING[s][0] for s in range(4)])).argmin())
            for n, (code, after) in enumerate(zip(mine, path(mine, state, end, cost), strict=True)):
                merged, gap = how[code, state, after]
                decided.append((before + n, state, after, merged, gap, float(cost[code, state, after]), closes and n == b - a - 1))
                state = after
        done = 0
        for batch in held:
            for rows in slices(iter([batch.select([0, 3, 1, 2])]), SLICE):
                out: list[tuple] = []
                for text, (place, state, after, merged, gap, price, last) in zip(rows.column(1).to_pylist(), decided[done : done + rows.num_rows], strict=True):
                    text = (text or "").replace("<|", "< |")
                    piece = "\n" + text if merged else ("<|end|>\n" if state != START else "") + (f"<|{ROLES[gap - 1]}|>\n<|end|>\n" if gap else "") + f"<|{ROLES[after - 1]}|>\n{text}"
                    if last:
                        piece += "<|end|>\n" + "".join(f"<|{ROLES[s - 1]}|>\n<|end|>\n" for s in ENDING[after][1])
                    out.append((place, ROLES[after - 1], merged, ROLES[gap - 1] if gap else None, price, piece))
                done += rows.num_rows
                kept = [rows.column(0), rows.column(2), rows.column(3)]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], columns)

    return ordered.mapInArrow(repair, f"conv_id {kind}, turn long, role string, position long, new_role string, merged boolean, inserted string, cost double, rendered string")
