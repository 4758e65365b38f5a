"""Chat formatting with minimum-cost repair of roles.

Legal conversations are the words of an automaton: an optional system turn, then
user and assistant turns in alternation, ending with an assistant turn. For each
turn, dynamic programming over the automaton's states chooses the cheapest of:
keeping its role, relabelling it, merging it into the turn before, and inserting
an empty turn first. The repaired sequence is then rendered with a template.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
#: Which role may follow which state, and where a conversation may end.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FINAL = (ASSISTANT,)
#: The empty turns that lead from a state to the end.
CLOSING = {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
#: Other names of roles (fixed values).
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}


@dataclass(frozen=True)
class Costs:
    """What each repair costs; a turn whose role is null or unknown is relabelled for ``unknown``."""

    merge: int = 2
    relabel: int = 3
    unknown: int = 1
    insert: int = 4


def role_state(role: str | None) -> int | None:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return next((k for k, v in ROLES.items() if v == name), None)


def repair(roles: list[str | None], costs: Costs = Costs()) -> tuple[int, list[tuple[int, list[int]]]]:
    """(cost, turns): the cheapest legal sequence, each turn a state and the positions of the turns merged in it.

    An inserted turn has no positions. Merging needs a turn before with a
    position, takes that turn's role and costs ``merge``, and ``relabel`` (or
    ``unknown``) too where the roles differ. Ties: keeping before relabelling
    before merging before inserting, then the state of the smaller number.
    No turns: cost 0 and no turns.
    """
    if not roles:
        return 0, []
    inf = float("inf")
    given = [role_state(r) for r in roles]
    cost: list[float] = [0, inf, inf, inf]
    back: list[list[tuple | None]] = []
    for i, own in enumerate(given):
        new: list[tuple] = [(inf, 9, None, None)] * 4
        for state in range(4):
            if cost[state] == inf:
                continue

            def change(to: int) -> int:
                return 0 if own == to else costs.unknown if own is None else costs.relabel

            for to in NEXT[state]:
                new[to] = min(new[to], (cost[state] + change(to), 0 if own == to else 1, state, None), key=_rank)
            if i and state != START:
                new[state] = min(new[state], (cost[state] + costs.merge + change(state), 2, state, "merge"), key=_rank)
            for gap in NEXT[state]:  # one empty turn leads to every role that two steps reach
                for to in NEXT[gap]:
                    new[to] = min(new[to], (cost[state] + costs.insert + change(to), 3, state, gap), key=_rank)
        cost = [x[0] for x in new]
        back.append(new)
    total, state = min((cost[s] + costs.insert * len(CLOSING[s]), s) for s in CLOSING)
    turns: list[tuple[int, list[int]]] = [(s, []) for s in reversed(CLOSING[state])]
    pending: list[int] = []
    for i in range(len(roles) - 1, -1, -1):
        _, _, before, how = back[i][state]
        pending.append(i)
        if how != "merge":
            turns.append((state, pending[::-1]))
            pending = []
            if how is not None:
                turns.append((how, []))
        state = before
    return int(total), turns[::-1]


def _rank(option: tuple) -> tuple:
    return option[0], option[1], option[2] if option[2] is not None else 9


def render(turns: list[tuple[int, list[int]]], texts: list[str | None]) -> str:
    """The turns between ``<|im_start|>role`` and ``<|im_end|>`` lines; merged texts are joined by an empty line."""
    body = ("\n\n".join(x for x in (texts[i] or "" for i in at) if x) for _, at in turns)
    return "".join(f"<|im_start|>{ROLES[s]}\n{_escaped(t)}<|im_end|>\n" for (s, _), t in zip(turns, body, strict=True))


def _escaped(text: str) -> str:
    """Template marks inside a text can't open or close a turn."""
    return text.replace("<|im_", "<| im_")


FIELDS = "n_turns bigint, n_rendered bigint, n_merged bigint, n_relabelled bigint, n_inserted bigint, cost bigint, roles string, rendered string"


def format_chats(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", costs: Costs = Costs()) -> DataFrame:
    """One row per conversation: the key and :data:`FIELDS`.

    Turns are ordered by ``turn`` (nulls first), ties by role and text, so
    repeated rows are repeated turns. A row with a null key belongs to no other:
    it is a conversation of its own, with a null key, and isn't dealt, however
    many there are. Null and empty texts are empty turns and stay turns. A
    conversation is one rendered text, so it must fit into a task's memory;
    texts are gathered once, by key. Other columns are ignored and an empty
    table gives no rows.
    """
    fields = F.struct(F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    gathered = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.sort_array(F.collect_list(fields)).alias("turns"))
    gathered = gathered.unionByName(rows.where(F.col(key).isNull()).select(F.col(key).alias("key"), F.array(fields).alias("turns")))
    slim = gathered.select("key", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: t["text"]).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, tuple] = {}
        for batch in batches:
            out = []
            for roles, texts in zip(batch.column("roles"), batch.column("texts"), strict=True):
                roles, texts = roles.as_py(), texts.as_py()
                found = seen.get(tuple(roles))
                if found is None:
                    if len(seen) > 20_000:
                        seen.clear()
                    found = seen[tuple(roles)] = repair(roles, costs)
                total, turns = found
                merged = sum(len(at) - 1 for _, at in turns if at)
                changed = sum(role_state(roles[i]) != s for s, at in turns for i in at)
                out.append((len(roles), len(turns), merged, changed, sum(not at for _, at in turns), total, ">".join(ROLES[s] for s, _ in turns), render(turns, texts)))
            types = [pa.int64()] * 6 + [pa.string()] * 2
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], names=[key, *(f.split()[0] for f in FIELDS.split(", "))])

    return slim.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {FIELDS}")
