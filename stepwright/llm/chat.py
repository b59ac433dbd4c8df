"""Chat formatting with minimum-cost repair of roles.

Legal conversations are the paths of a small automaton: an optional system turn, then user and
assistant in turn, ending with the assistant. For the given turns a dynamic program over the
automaton's states chooses, turn by turn, to keep a turn, to relabel it, to merge it into the one
before, or to insert an empty turn of the missing role, at the least total cost. Ties take the
first choice in that order. The repaired turns are then rendered between markers.

A conversation is one training example and ends as one row, so its turns are gathered in one row
as well, after exact repetitions are dropped; no row holds more than its own conversation.

Defined cases: turns are ordered by turn number (null last), then role and text; exact repeated
rows count once; an unknown or null role can be relabelled for less than a known one; a null text
is empty; a row of a null conv_id belongs to no other and is a conversation of its own; a
conversation without text keeps its turns; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwright.llm.common import ddl, map_texts_in_batches

ROLES = ("system", "user", "assistant")
#: States name the role that came last; START has none. Legal next roles per state.
NEXT = {"START": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
FINAL = "assistant"


@dataclass(frozen=True)
class Costs:
    """What each repair costs; keeping a turn costs nothing."""

    relabel: float = 3.0
    relabel_unknown: float = 1.0
    merge: float = 1.0
    insert: float = 2.0


def role_of(role: str | None) -> str | None:
    """The role in lower case without white space around it, if it is known."""
    found = (role or "").strip().lower()
    return found if found in ROLES else None


def insertions(state: str, role: str, costs: Costs) -> tuple[float, tuple[str, ...]]:
    """Cheapest empty turns to be put between state and a turn of role."""
    if role in NEXT[state]:
        return 0.0, ()
    best = None
    border = [(state, ())]
    while best is None and border:
        border = [(r, (*path, r)) for s, path in border if len(path) < len(ROLES) for r in NEXT[s]]
        best = next((path for s, path in border if role in NEXT[s]), None)
    return (float("inf"), ()) if best is None else (costs.insert * len(best), best)


def repair(roles: list[str | None], costs: Costs = Costs()) -> tuple[float, list[tuple[str, str, int]]]:
    """Least cost, and the repaired turns as (action, role, number of the turn or -1).

    Actions are keep, relabel, merge (into the turn before) and insert.
    """
    states = ("START", *ROLES)
    table: list[dict[str, tuple[float, str, list[tuple[str, str, int]]]]] = [{"START": (0.0, "", [])}]
    for at, given in enumerate(roles):
        known = role_of(given)
        row: dict[str, tuple[float, str, list[tuple[str, str, int]]]] = {}

        def offer(state: str, cost: float, origin: str, steps: list[tuple[str, str, int]], row=row) -> None:
            if state not in row or cost < row[state][0]:
                row[state] = (cost, origin, steps)

        for state in states:
            if state not in table[-1]:
                continue
            base = table[-1][state][0]
            for role in ((known,) if known else ()) + tuple(r for r in ROLES if r != known):
                before, empty = insertions(state, role, costs)
                if before == float("inf"):
                    continue
                change = 0.0 if role == known else costs.relabel if known else costs.relabel_unknown
                steps = [("insert", r, -1) for r in empty] + [("keep" if role == known else "relabel", role, at)]
                offer(role, base + before + change, state, steps)
            if state != "START":
                change = 0.0 if known in (None, state) else costs.relabel
                offer(state, base + costs.merge + change, state, [("merge", state, at)])
        table.append(row)
    ends = []
    for state, (cost, _, _) in table[-1].items():
        path, extra, here = [], 0.0, state
        while here != FINAL:  # close the conversation with empty turns
            here = NEXT[here][-1]
            path.append(("insert", here, -1))
            extra += costs.insert
        ends.append((cost + extra, states.index(state), state, path))
    if not roles:
        return 0.0, []
    cost, _, state, closing = min(ends)
    turns: list[tuple[str, str, int]] = closing[::-1]
    for row in reversed(table[1:]):
        _, origin, steps = row[state]
        turns += steps[::-1]
        state = origin
    return cost, turns[::-1]


def render(turns: list[tuple[str, str, int]], texts: list[str | None], begin: str, end: str, joint: str) -> str:
    """The turns between markers; merged texts follow each other with joint between them."""
    merged: list[tuple[str, list[str]]] = []
    for action, role, at in turns:
        text = (texts[at] or "") if at >= 0 else ""
        if action == "merge":
            merged[-1][1].append(text)
        else:
            merged.append((role, [text]))
    return "".join(f"{begin}{role}\n{joint.join(parts)}{end}\n" for role, parts in merged)


def format_chats(
    turns: DataFrame,
    costs: Costs = Costs(),
    begin: str = "<|im_start|>",
    end: str = "<|im_end|>",
    joint: str = "\n\n",
) -> DataFrame:
    """Per conversation: conv_id, n_turns, cost, n_merged, n_relabelled, n_inserted, roles (of the
    repaired turns, joined by commas) and rendered."""
    rows = turns.select("conv_id", "turn", "role", "text").distinct()
    order = F.struct(F.col("turn").isNull().alias("last"), "turn", "role", "text")
    own = F.when(F.col("conv_id").isNull(), F.struct("turn", "role", "text")).alias("own")
    gathered = rows.groupBy("conv_id", own).agg(F.array_sort(F.collect_list(order)).alias("turns"))
    gathered = gathered.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            out: dict[str, list] = {n: [] for n in ("n_turns", "cost", "n_merged", "n_relabelled", "n_inserted", "roles", "rendered")}
            for roles, texts in zip(batch.column("roles").to_pylist(), batch.column("texts").to_pylist()):
                cost, steps = repair(roles, costs)
                actions = [a for a, _, _ in steps]
                out["n_turns"].append(len(roles))
                out["cost"].append(cost)
                for name, action in (("n_merged", "merge"), ("n_relabelled", "relabel"), ("n_inserted", "insert")):
                    out[name].append(actions.count(action))
                out["roles"].append(",".join(r for a, r, _ in steps if a != "merge"))
                out["rendered"].append(render(steps, texts, begin, end, joint))
            kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(v, k) for v, k in zip(out.values(), kinds))], ["conv_id", *out])

    schema = f"{ddl(turns, 'conv_id')}, n_turns long, cost double, n_merged long, n_relabelled long, n_inserted long, roles string, rendered string"
    return map_texts_in_batches(gathered, batches, schema)
