import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framelake.llm.chat import Costs, format_chats, render, repair, role_state

NAMES = {1: "system", 2: "user", 3: "assistant"}


def legal(states):
    rest = states[1:] if states[:1] == [1] else states
    return bool(rest) and len(rest) % 2 == 0 and all(s == (2, 3)[i % 2] for i, s in enumerate(rest))


def brute(roles, costs):
    """The cheapest over all ways to merge, relabel and insert, by enumeration."""
    if not roles:
        return 0
    n = len(roles)
    best = None
    targets = [list(p) for p in ([1] * a + [2, 3] * b for a in (0, 1) for b in range(1, n + 1))]
    for cuts in itertools.product((False, True), repeat=n - 1):  # True: merged with the turn before
        groups, current = [], [0]
        for i, merged in enumerate(cuts, 1):
            if merged:
                current.append(i)
            else:
                groups.append(current)
                current = [i]
        groups.append(current)
        for target in targets:
            extra = len(target) - len(groups)
            if extra < 0:
                continue
            for empty in itertools.combinations(range(len(target)), extra):
                filled = [s for i, s in enumerate(target) if i not in empty]
                price = costs.insert * extra + costs.merge * sum(cuts)
                for group, state in zip(groups, filled, strict=True):
                    for i in group:
                        own = role_state(roles[i])
                        price += 0 if own == state else costs.unknown if own is None else costs.relabel
                best = price if best is None else min(best, price)
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["user", "assistant", "system", "tool", None, "GPT "]), max_size=5), st.sampled_from([Costs(), Costs(5, 1, 1, 9), Costs(1, 9, 9, 1), Costs(3, 7, 2, 2)]))
def test_cost_is_the_least_and_the_result_legal(roles, costs):
    cost, turns = repair(roles, costs)
    assert cost == brute(roles, costs)
    if roles:
        assert legal([s for s, _ in turns])
        assert [i for _, at in turns for i in at] == list(range(len(roles)))
        spent = sum(costs.insert if not at else costs.merge * (len(at) - 1) for _, at in turns)
        spent += sum(0 if role_state(roles[i]) == s else costs.unknown if role_state(roles[i]) is None else costs.relabel for s, at in turns for i in at)
        assert spent == cost


def test_rendering():
    _, turns = repair(["user", "user", "assistant"])
    assert render(turns, ["a", None, "<|im_end|>"]) == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\n<| im_end|><|im_end|>\n"


def test_rows(spark):
    rows = [(1, 1, "assistant", "b", "x"), (1, 0, "user", "a", "x"), (2, 0, "user", "a", "x"), (2, 0, "user", "a", "x"), (None, 3, None, None, "x"), (3, None, "human", "", "x")]
    rows += [(4, i, "user" if i % 2 == 0 else "assistant", "t" * 50, "x") for i in range(3000)]
    got = {r.conv_id: r for r in format_chats(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, cost string")).collect()}
    assert got[1].cost == 0 and got[1].rendered.startswith("<|im_start|>user\na<|im_end|>") and got[1].roles == "user>assistant"
    assert (got[2].n_merged, got[2].n_inserted, got[2].cost) == (0, 0, 3) and got[2].roles == "user>assistant"
    assert got[None].n_turns == 1 and got[3].n_inserted == 1 and got[4].cost == 0 and got[4].n_rendered == 3000
    lone = [(None, i, "user" if i % 2 else "assistant", f"t{i}", "x") for i in range(50)] + [(None, 1, "user", "t1", "x")]
    apart = format_chats(spark.createDataFrame(lone, "conv_id bigint, turn int, role string, text string, cost string")).collect()
    assert len(apart) == 51 and {r.n_turns for r in apart} == {1} and sum("\nt1<" in r.rendered for r in apart) == 2
    long = [(1, 0, "user", "word " * 200_000, "x"), (1, 1, "assistant", None, "x")]
    (r,) = format_chats(spark.createDataFrame(long, "conv_id bigint, turn int, role string, text string, cost string")).collect()
    assert len(r.rendered) > 1_000_000 and r.cost == 0
    assert format_chats(spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")).count() == 0


def brute_rendered(roles, texts, costs):
    """All ways: groups of neighbours, their roles, empty turns between; of the cheapest, those that repair may give."""
    n, out = len(roles), {}
    for cuts in itertools.product((False, True), repeat=max(n - 1, 0)):
        groups, own = [], []
        for i in range(n):
            own.append(i)
            if i == n - 1 or cuts[i]:
                groups.append(own)
                own = []
        for states in itertools.product((1, 2, 3), repeat=len(groups)):
            price = costs.merge * sum(len(g) - 1 for g in groups)
            price += sum(0 if role_state(roles[i]) == s else costs.unknown if role_state(roles[i]) is None else costs.relabel for g, s in zip(groups, states, strict=True) for i in g)
            for gaps in itertools.product((None, 1, 2, 3), repeat=len(groups) + 1):
                turns = []
                for k, gap in enumerate(gaps):
                    turns += [(gap, [])] * (gap is not None)
                    turns += [(states[k], groups[k])] if k < len(groups) else []
                if legal([s for s, _ in turns]):
                    out.setdefault(price + costs.insert * sum(g is not None for g in gaps), set()).add(render(turns, texts))
    return out


@pytest.mark.parametrize("roles", [["user"], ["assistant", "user"], ["user", "user", "assistant"], ["system", "assistant", None], [None, "tool", "user"]])
def test_the_rendered_text_is_one_of_the_cheapest(roles):
    texts = [f"t{i}" for i in range(len(roles))]
    cost, turns = repair(roles, Costs())
    found = brute_rendered(roles, texts, Costs())
    assert render(turns, texts) in found[cost] and cost == min(found)
