"""Several messages of one turn and role, and calls with several prerequisites."""

import numpy as np
from gramwright.llm import tool_calls


def test_all_texts_of_a_turn_stay(spark):
    rows = [(1, 1, "user", "ask"), (1, 2, "assistant", "one"), (1, 2, "assistant", "two"), (1, 2, "assistant", "two"), (1, 2, "assistant", None), (None, 1, "user", "x"), (None, 1, "user", "y"), (1, 3, "user", "more")]
    got = tool_calls.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r["conv_id"] or 0, r["turn"], r["kind"], r["linked"]) for r in got) == [
        (0, 1, "message", False), (0, 1, "message", False), (1, 1, "call", True), (1, 2, "message", False), (1, 2, "message", False), (1, 2, "result", True), (1, 3, "call", False),
    ]
    assert {w for r in got for w in ("one", "two", '"x"', '"y"') if w in r["json"]} == {"one", "two", '"x"', '"y"'}


def test_longest_way_through_a_graph(spark):
    r = np.random.default_rng(1)
    want, rows = {}, []
    for conv in range(6):
        order = [f"k{j}" for j in r.permutation(40)]
        for j, call in enumerate(order):
            after = sorted({order[k] for k in r.integers(0, j, min(j, int(r.integers(0, 4))))}) if j else []
            want[conv, call] = 1 + max((want[conv, a] for a in after), default=-1)
            rows.append((conv, call, [*after, "nobody", None] if j % 2 else after or None))
    # a cycle, what waits for it, and a call that waits for itself
    rows += [(9, "a", ["c"]), (9, "b", ["a"]), (9, "c", ["b", "r"]), (9, "d", ["c", "r"]), (9, "r", None), (9, "s", ["s"]), (9, "t", ["r"])]
    want |= {(9, k): None for k in "abcds"} | {(9, "r"): 0, (9, "t"): 1}
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, after array<string>")
    got = tool_calls.depths(calls).collect()
    assert {(x["conv_id"], x["call_id"]): x["depth"] for x in got} == want and len(got) == len(want)
    chain = spark.createDataFrame([(1, f"k{j}", f"k{j - 1}") for j in range(200)], "conv_id long, call_id string, after string")
    assert {x["call_id"]: x["depth"] for x in tool_calls.depths(chain).collect()} == {f"k{j}": j for j in range(200)}
    assert tool_calls.depths(chain.limit(0)).count() == 0
