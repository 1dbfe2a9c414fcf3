"""Chat formatting by minimum-cost role repair.

A legal conversation is a system turn or none, then user and assistant turns in alternation, from
user to assistant. Dynamic programming over that automaton picks, for every turn, the role it gets, whether it
is merged into the turn before, and which empty turns go in before it, so that the costs below add up to the least.

Conversations are sorted over range partitions. Whatever lies within one partition is repaired
there. What may reach beyond becomes segments, each with its table of least costs
from any state to any state; those small tables are chained, so a conversation may be spread over any number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, INSERT = 1, 2, 3
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"
NEVER = 1 << 40

DONE = "conv_id long, turn long, ordinal long, role_in string, role string, action string, inserted array<string>, cost int, rendered string"


def _way(state: int, role: int) -> tuple[int, tuple[int, ...], bool]:
    """(cost, empty turns to insert, merged) of a turn with ``role`` after a turn in ``state``."""
    if role in NEXT[state]:
        return 0, (), False
    if state == role:
        return MERGE, (), True
    for between in NEXT[state]:
        if role in NEXT[between]:
            return INSERT, (between,), False
    return NEVER, (), False


WAYS = [[_way(s, o) for o in range(4)] for s in range(4)]
#: Empty turns that complete a conversation that ends in a state.
ENDINGS = ((), (USER, ASSISTANT), (ASSISTANT,), ())


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    return NAMES.index(name) if name in NAMES[1:] else START


def _forward(roles: tuple[int, ...], start: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """Least cost to each state after all turns, and every turn's best state before."""
    cost = [NEVER] * 4
    cost[start] = 0
    back = []
    for role in roles:
        after, came = [NEVER] * 4, [0] * 4
        for o in (SYSTEM, USER, ASSISTANT):
            for s in range(4):
                total = cost[s] + WAYS[s][o][0] + (RELABEL if o != role else 0)
                if total < after[o]:  # ties: the first state
                    after[o], came[o] = total, s
        back.append(tuple(came))
        cost = after
    return cost, back


@lru_cache(maxsize=4096)
def repair(roles: tuple[int, ...], start: int = START, end: int | None = None) -> tuple[tuple[int, int], ...]:
    """(state before, role given) of each turn along a cheapest path; without ``end`` the ending counts too."""
    cost, back = _forward(roles, start)
    if end is None:
        end = min(range(4), key=lambda s: cost[s] + INSERT * len(ENDINGS[s]))
    path = []
    for came in reversed(back):
        path.append((came[end], end))
        end = came[end]
    return tuple(reversed(path))


def transfer(roles: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """For each start and end state, row by row: the least cost, and the place of this start among the
    four when equally cheap paths to that end are compared state by state from the end."""
    ways = [_forward(roles, s) for s in range(4)]
    places = [0] * 16
    for end in range(4):
        paths = []
        for start, (_, back) in enumerate(ways):
            at, path = end, []
            for came in reversed(back):
                at = came[at]
                path.append(at)
            paths.append((path[:-1], start))
        for place, (_, start) in enumerate(sorted(paths)):
            places[4 * start + end] = place
    return [c for cost, _ in ways for c in cost], places


def _render(rows: list[tuple], path, offset: int, last: bool) -> list[tuple]:
    """``rows``: (conv_id, turn, role, text) in order; see ``DONE`` for what comes back."""
    out = []
    for k, ((conv, turn, role, text), (before, given)) in enumerate(zip(rows, path)):
        cost, inserted, merged = WAYS[before][given]
        relabelled = given != role_number(role)
        piece = "" if before == START or merged else CLOSE
        piece += "".join(OPEN.format(NAMES[i]) + CLOSE for i in inserted)
        piece += ("\n" if merged else OPEN.format(NAMES[given])) + (text or "")
        extra = ENDINGS[given] if last and k == len(rows) - 1 else ()
        if last and k == len(rows) - 1:
            piece += CLOSE + "".join(OPEN.format(NAMES[i]) + CLOSE for i in extra)
        action = "+".join(a for a, on in (("relabel", relabelled), ("merge", merged), ("insert", inserted or extra)) if on) or "keep"
        cost += RELABEL * relabelled + INSERT * len(extra)
        out.append((conv, turn, offset + k, role, NAMES[given], action, [NAMES[i] for i in (*inserted, *extra)], cost, piece))
    return out


_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.string()]
_NAMES = [c.split()[0] for c in DONE.split(", ")]


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * len(_NAMES)
    return pa.table([pa.array(c, t) for c, t in zip(columns, _KINDS)], names=_NAMES)


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repairs conversations that begin and end in the partition; the others' rows come back with ``part`` set."""
    part = TaskContext.get().partitionId()
    first, own, started = True, [], False

    def flush(edge: bool) -> pa.Table:
        n = len(own)
        if not edge:
            done = _render(own, repair(tuple(role_number(r[2]) for r in own)), 0, True)
            return _table(done).append_column("part", pa.nulls(n, pa.int32())).append_column("k", pa.nulls(n, pa.int64())).append_column("text", pa.nulls(n, pa.string()))
        blank = pa.table([pa.array([r[i] for r in own], t) for i, t in ((0, pa.int64()), (1, pa.int64()))], names=["conv_id", "turn"])
        for name, kind in zip(_NAMES[2:], _KINDS[2:]):
            blank = blank.append_column(name, pa.array([r[2] for r in own], kind) if name == "role_in" else pa.nulls(n, kind))
        for name, column in (("part", pa.array([part] * n, pa.int32())), ("k", pa.array(range(n), pa.int64())), ("text", pa.array([r[3] for r in own], pa.string()))):
            blank = blank.append_column(name, column)
        return blank

    ready: list[pa.Table] = []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if started and row[0] != own[0][0]:
                ready.append(flush(first))
                first, own = False, []
            own.append(row)
            started = True
            if len(ready) >= 256:
                yield from pa.concat_tables(ready).combine_chunks().to_batches()
                ready = []
    if own:
        ready.append(flush(True))
    if ready:
        yield from pa.concat_tables(ready).combine_chunks().to_batches()


def _segment_costs(group: pa.Table) -> pa.Table:
    group = group.sort_by("k")
    roles = tuple(map(role_number, group.column("role_in").to_pylist()))
    kind = pa.list_(pa.int64())
    costs, places = (pa.array([x], kind) for x in transfer(roles))
    return pa.table({"conv_id": group.column("conv_id")[:1], "part": group.column("part")[:1], "n": pa.array([len(roles)], pa.int64()), "costs": costs, "places": places})


def _chain(group: pa.Table) -> pa.Table:
    """The states in which a cheapest path enters and leaves each segment."""
    group = group.sort_by("part")
    tables = list(zip(group.column("costs").to_pylist(), group.column("places").to_pylist()))
    cost, back = [0, NEVER, NEVER, NEVER], []
    for t, place in tables:
        came = [min(range(4), key=lambda s: (cost[s] + t[4 * s + e], place[4 * s + e])) for e in range(4)]
        back.append(came)
        cost = [cost[s] + t[4 * s + e] for e, s in enumerate(came)]
    end = min(range(4), key=lambda s: cost[s] + INSERT * len(ENDINGS[s]))
    ends, starts = [], []
    for came in reversed(back):
        ends.append(end)
        end = came[end]
        starts.append(end)
    sizes = group.column("n").to_pylist()
    offsets = [0, *accumulate(sizes[:-1])]
    return pa.table(
        {
            "conv": group.column("conv_id"),
            "segment": group.column("part"),
            "enter": pa.array(starts[::-1], pa.int32()),
            "leave": pa.array(ends[::-1], pa.int32()),
            "offset": pa.array(offsets, pa.int64()),
            "last": pa.array([i == len(tables) - 1 for i in range(len(tables))]),
        }
    )


def _across(group: pa.Table) -> pa.Table:
    group = group.sort_by("k")
    rows = list(zip(*(group.column(c).to_pylist() for c in ("conv_id", "turn", "role_in", "text"))))
    enter, leave, offset, last = (group.column(c)[0].as_py() for c in ("enter", "leave", "offset", "last"))
    return _table(_render(rows, repair(tuple(role_number(r[2]) for r in rows), enter, leave), offset, last))


def format_conversations(turns: DataFrame) -> DataFrame:
    """Repair and render conversations: a row for each row of ``turns`` (conv_id, turn, role, text; others are ignored).

    Returns conv_id, turn, ordinal (place in the conversation, from 0), role_in, role, action (keep, or relabel, merge, insert
    joined by +), inserted (roles of the empty turns added before it, for a last turn also after it), cost, and rendered, the
    turn's part of the text: a conversation's parts by ordinal make up its whole text.

    Turns are ordered by turn (null first), role, text; repeated rows are turns of their own. An unknown or null role is
    relabelled, a null text counts as empty. A null conv_id is a conversation of its own. Of equally cheap repairs the one
    that comes first by the states system, user, assistant, from the end backwards, is taken. An empty table gives an empty result. A very long text is part of its turn's row, a conversation of very many turns is chained over tasks.
    """
    narrow = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    order = ["conv_id", "turn", "role", "text"]
    parts = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    first = materialise(parts.mapInArrow(_within, DONE + ", part int, k long, text string"))
    done = first.where("part is null").select(*_NAMES)
    edges = first.where("part is not null")
    costs = edges.groupBy("conv_id", "part").applyInArrow(_segment_costs, "conv_id long, part int, n long, costs array<long>, places array<long>")
    states = costs.groupBy("conv_id").applyInArrow(_chain, "conv long, segment int, enter int, leave int, offset long, last boolean")
    joined = edges.join(states, edges["conv_id"].eqNullSafe(states["conv"]) & (edges["part"] == states["segment"]))
    across = joined.select("conv_id", "part", "k", "turn", "role_in", "text", "enter", "leave", "offset", "last").groupBy("conv_id", "part").applyInArrow(_across, DONE)
    return done.unionByName(across)


def render_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, cost and the whole rendered text of each conversation, for conversations that fit a row (longer ones: ``format_conversations``). An empty table gives an empty result."""
    parts = format_conversations(turns).groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.array_sort(F.collect_list(F.struct("ordinal", "rendered"))).alias("parts"))
    return parts.select("conv_id", "cost", F.array_join("parts.rendered", "").alias("text"))
