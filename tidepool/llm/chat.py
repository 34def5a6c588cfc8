"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system message, then user and assistant in
turn, ending with the assistant. Its automaton has four states, named by the last
message: none, system, user, assistant. A turn can open a message in its own
role (free), open one in another role (relabel, 2; 1 if its own role is
unknown) or join the message before it (merge, 1, and 2 more if the roles
differ); before it and at the end, empty messages can be inserted (3 each).

The cheapest repair is a shortest path. As costs depend on roles alone, a
segment of turns is a 4 x 4 min-plus matrix, so a very long conversation is
repaired in parallel: the turns are range-partitioned in their order and numbered
there, so a segment is at most ``segment`` rows in a row, whatever their turn
numbers. Segments are multiplied up on their own, the matrices of a conversation,
one for each of its segments, are chained in one task to fix the state at each
segment's ends, and each segment then traces its own path.

Result: a row a turn, with the rendered fragment; fragments in order of turn and
``place`` are the rendered conversation.

Defined results: turns go by number, ties by role, then text; a null number
comes first. An unknown or null role is relabelled. A null text is empty. Rows
that repeat are turns of their own. A null conv_id is a conversation of its own.
Extra columns are ignored. Equal costs prefer open, then merge, then relabel,
then fewer insertions, then the state named first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import cut

ROLES = ("system", "user", "assistant")
RELABEL, UNKNOWN, MERGE, INSERT = 2, 1, 1, 3
FAR = 1 << 40
#: state -> states it can go to by opening a message; state i + 1 is the last message's role i
OPENS = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
#: Empty messages that lead from one state to another.
INSERTIONS = {(0, 2): ("user",), (0, 3): ("user", "assistant"), (1, 2): ("user",), (1, 3): ("user", "assistant"), (2, 3): ("assistant",), (3, 2): ("user",)}


def _steps(role: int) -> list[tuple[int, int, int, str, tuple[str, ...]]]:
    """(from, to, cost, action, inserted) of a turn, in order of preference; role 3 is unknown."""
    out = []
    for s in range(4):
        for mid, inserted in [(s, ()), *[(b, i) for (a, b), i in INSERTIONS.items() if a == s]]:
            base = INSERT * len(inserted)
            for to in OPENS[mid]:
                change = 0 if to - 1 == role else UNKNOWN if role == 3 else RELABEL
                out.append((s, to, base + change, "open" if not change else "relabel", inserted))
            if mid:
                change = 0 if mid - 1 == role else UNKNOWN if role == 3 else RELABEL
                out.append((s, mid, base + MERGE + change, "merge", inserted))
    rank = {"open": 0, "merge": 1, "relabel": 2}
    return sorted(out, key=lambda x: (x[2], rank[x[3]], len(x[4]), x[0], x[1]))


STEPS = [_steps(r) for r in range(4)]
MATRIX = np.full((4, 4, 4), FAR, np.int64)
BEST: list[dict[tuple[int, int], tuple[int, str, tuple[str, ...]]]] = [{} for _ in range(4)]
for _r in range(4):
    for _s, _t, _c, _a, _i in STEPS[_r]:
        if (_s, _t) not in BEST[_r]:
            BEST[_r][_s, _t] = (_c, _a, _i)
            MATRIX[_r, _s, _t] = _c
#: What it takes to end legally in each state.
END = {0: (FAR, ()), 1: (2 * INSERT, ("user", "assistant")), 2: (INSERT, ("assistant",)), 3: (0, ())}


def role_number(role: str | None) -> int:
    return ROLES.index(role) if role in ROLES else 3


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), FAR)


def path(roles: list[int], enter: int, leave: int) -> list[tuple[int, str, tuple[str, ...], int]]:
    """(cost, action, inserted, state after) of each turn on the cheapest way from one state to the other."""
    cost = np.full((len(roles) + 1, 4), FAR, np.int64)
    cost[0, enter] = 0
    for k, r in enumerate(roles):
        cost[k + 1] = np.minimum((cost[k][:, None] + MATRIX[r]).min(0), FAR)
    out, at = [], leave
    for k in reversed(range(len(roles))):
        ways = [(cost[k, s] + MATRIX[roles[k], s, at], ("open", "merge", "relabel").index(BEST[roles[k]][s, at][1]), s) for s in range(4) if (s, at) in BEST[roles[k]]]
        s = min(ways)[2]
        out.append((*BEST[roles[k]][s, at], at))
        at = s
    return out[::-1]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of runs of equal keys; the rows are sorted by key."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key is not None and row[:keys] != key:
                yield key, rows
                rows = []
            key = row[:keys]
            rows.append(row[keys:])
    if key is not None:
        yield key, rows


def _batch(rows: list[tuple], types: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(cols, types, strict=True)], names=[n for n, _ in types])


def _in_batches(rows: Iterator[tuple], types: list[tuple[str, pa.DataType]], size: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield _batch(held, types)
            held = []
    yield _batch(held, types)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for (conv, seg), turns in _groups(batches, 2):
            m = MATRIX[role_number(turns[0][0])]
            for t in turns[1:]:
                m = times(m, MATRIX[role_number(t[0])])
            first, last = turns[0][1], turns[-1][1]
            yield conv, seg, m.ravel().tolist(), first, last, len(turns), sum(1 for t in turns if t[1] == last)

    yield from _in_batches(rows(), [("conv_id", pa.int64()), ("seg", pa.int64()), ("m", pa.list_(pa.int64())), ("first", pa.int64()), ("last", pa.int64()), ("n", pa.int64()), ("n_last", pa.int64())])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for (conv,), segs in _groups(batches, 1):
            cost = [np.array([0, FAR, FAR, FAR])]
            ms = [np.array(s[1]).reshape(4, 4) for s in segs]
            before, held, held_turn = [], 0, object()  # rows of a segment's first turn that stand in segments before it
            for _, _, first, last, n, n_last in segs:
                before.append(held if first == held_turn else 0)
                held, held_turn = (before[-1] + n if first == last else n_last), last
            for m in ms:
                cost.append(np.minimum((cost[-1][:, None] + m).min(0), FAR))
            at = min(range(1, 4), key=lambda s: (cost[-1][s] + END[s][0], -s))
            total = int(cost[-1][at] + END[at][0])
            out = []
            for k in reversed(range(len(segs))):
                s = min(range(4), key=lambda s: (cost[k][s] + ms[k][s, at], s))  # noqa: B023
                out.append((conv, segs[k][0], s, at, k == len(segs) - 1, total, before[k]))
                at = s
            yield from reversed(out)

    yield from _in_batches(rows(), [("conv_id", pa.int64()), ("seg", pa.int64()), ("enter", pa.int32()), ("leave", pa.int32()), ("last", pa.bool_()), ("total", pa.int64()), ("before", pa.int64())])


def _render(inserted: tuple[str, ...], opened: str | None, text: str, mid: int) -> str:
    """A message is <|role|>, a newline, its text and <|end|>; a merged turn goes on after a newline."""
    out = ""
    for r in inserted:
        out += ("<|end|>\n" if mid else "") + f"<|{r}|>\n"
        mid = 1
    if opened:
        return f"{out}{'<|end|>' + chr(10) if mid else ''}<|{opened}|>\n{text}"
    return f"{out}{text}" if inserted else f"\n{text}"


ROW = [("conv_id", pa.int64()), ("turn", pa.int64()), ("place", pa.int32()), ("role_in", pa.string()), ("role", pa.string()), ("action", pa.string()), ("inserted", pa.string()), ("cost", pa.int64()), ("total_cost", pa.int64()), ("fragment", pa.string())]


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for (conv, _), turns in _groups(batches, 2):
            enter, leave, last, total, before = turns[0][3:]
            mid, seen = enter, {turns[0][1]: before - 1}
            for k, ((role, turn, text, *_), (cost, action, inserted, after)) in enumerate(zip(turns, path([role_number(t[0]) for t in turns], enter, leave), strict=True)):
                fragment = _render(inserted, None if action == "merge" else ROLES[after - 1], text or "", mid)
                end = ()
                if last and k == len(turns) - 1:
                    end = END[after][1]
                    fragment += "".join(f"<|end|>\n<|{r}|>\n" for r in end) + "<|end|>\n"
                place = seen[turn] = seen.get(turn, -1) + 1
                yield conv, turn, place, role, ROLES[after - 1], action, ",".join(inserted + (("",) + end if end else ())), cost + INSERT * len(end), total, fragment
                mid = after

    yield from _in_batches(rows(), ROW, 2048)


def repair_chats(conversations: DataFrame, segment: int = 256) -> DataFrame:
    """One row a turn: conv_id, turn, place, role_in, role, action, inserted (before, then after a last comma), cost, total_cost, fragment."""
    turns = conversations.select(*[F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")], *[F.col(c).cast("string").alias(c) for c in ("role", "text")])
    order = ["conv_id", "turn", "role", "text"]
    sorted_turns = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    # the numbers of a partition's rows follow each other, and partitions follow each other in order
    turns = cut(sorted_turns.withColumn("row", F.monotonically_increasing_id()).withColumn("seg", F.floor(F.col("row") / segment)))
    matrices = turns.select("conv_id", "seg", "role", "turn").mapInArrow(_matrices, "conv_id long, seg long, m array<long>, first long, last long, n long, n_last long")
    ends = matrices.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(_chain, "conv_id long, seg long, enter int, leave int, last boolean, total long, before long")
    e = ends.withColumnsRenamed({"conv_id": "c", "seg": "s"})
    joined = turns.join(e, turns["conv_id"].eqNullSafe(e["c"]) & turns["seg"].eqNullSafe(e["s"])).drop("c", "s")
    placed = joined.repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "row")
    return placed.select("conv_id", "seg", "role", "turn", "text", "enter", "leave", "last", "total", "before").mapInArrow(_repair, "conv_id long, turn long, place int, role_in string, role string, action string, inserted string, cost long, total_cost long, fragment string")
