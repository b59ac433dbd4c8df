"""The role repair against all repairs of short conversations, and whole tables of odd rows."""

from itertools import product

import pytest

from stepwright.llm.chat import NEXT, ROLES, Costs, format_chats, render, repair, role_of


def least_cost(roles, costs):
    """Cost of the cheapest repair, by trying every sequence of choices."""
    best = float("inf")
    todo = [(0, "START", 0.0, 0)]
    while todo:
        at, state, cost, run = todo.pop()
        if cost >= best or run > 4:
            continue
        if at == len(roles) and state == "assistant":
            best = cost
            continue
        for role in NEXT[state]:
            todo.append((at, role, cost + costs.insert, run + 1))
        if at < len(roles):
            known = role_of(roles[at])
            change = {r: 0.0 if r == known else costs.relabel if known else costs.relabel_unknown for r in ROLES}
            todo += [(at + 1, r, cost + change[r], 0) for r in NEXT[state]]
            if state != "START":
                todo.append((at + 1, state, cost + costs.merge + (0.0 if known in (None, state) else costs.relabel), 0))
    return best


@pytest.mark.parametrize("costs", [Costs(), Costs(relabel=1, relabel_unknown=2, merge=3, insert=1)])
def test_cost_is_least(costs):
    for n in range(1, 5):
        for roles in product(["system", "user", "assistant", "bot"], repeat=n):
            cost, turns = repair(list(roles), costs)
            assert cost == least_cost(roles, costs), roles
            state = "START"
            for action, role, _ in turns:
                if action != "merge":
                    assert role in NEXT[state]
                    state = role
                assert role == state
            assert state == "assistant"
            assert [at for _, _, at in turns if at >= 0] == list(range(n))


def test_render_merges():
    _, turns = repair(["user", "user", "assistant"])
    assert render(turns, ["a", "b", None], "<", ">", "|") == "<user\na|b>\n<assistant\n>\n"


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, "Assistant ", None),
        (2, None, None, "x"), (2, 3, "assistant", "first"), (None, 0, "user", ""), (None, 1, "user", "other"), (None, 1, "user", "other"), (3, 0, "user", "long " * 50_000),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as rendered", "2 as roles")
    rows = format_chats(turns).collect()
    assert sorted(r["rendered"].split("\n")[1] for r in rows if r["conv_id"] is None) == ["<|im_end|>", "other<|im_end|>"]
    got = {r["conv_id"]: r for r in rows}
    assert set(got) == {1, 2, 3, None}
    assert got[1]["n_turns"] == 2 and got[1]["cost"] == 0.0
    assert got[2]["roles"] in ("user,assistant", "assistant") or got[2]["roles"].endswith("assistant")
    assert got[3]["n_inserted"] == 1 and len(got[3]["rendered"]) > 250_000
    assert format_chats(turns.limit(0)).count() == 0
