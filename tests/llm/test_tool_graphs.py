"""Tool-call linking over random and planted graphs of needs, against a topological order by brute force."""

import json
import random

import pytest

from lodestone.llm import tool_calls

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, step int, cyclic int"
RESULTS = "conv_id long, call_id string, turn long, content string"


def brute(calls, results):
    """(step, depth, cyclic, blocked) of each call."""
    given = {}
    for conv, call, turn, _ in results:
        given[conv, call] = min(turn, given.get((conv, call), turn))
    turn = {(c, i): t for c, i, t, *_ in calls}
    needs = {(c, i): {(c, n) for n in json.loads(a)["needs"]} & turn.keys() for c, i, _, _, a, *_ in calls}
    reach = {k: set(v) for k, v in needs.items()}
    changed = True
    while changed:
        changed = False
        for v in reach.values():
            more = set().union(*(reach[x] for x in v)) - v if v else set()
            changed |= bool(more)
            v |= more
    cyclic = {k for k in turn if k in reach[k]}
    open_ = {k: {n for n in needs[k] if n != k and not (n in reach[k] and k in reach[n])} for k in turn}
    done = {}

    def place(k):
        if k not in done:
            at = (turn[k], 0)
            for n in open_[k]:
                step, depth = place(n)
                result = given.get(n, step)
                at = max(at, (result, 0) if result > step else (step, depth + 1))
            done[k] = at
        return done[k]

    return {k: (*place(k), k in cyclic, k not in cyclic and bool(reach[k] & cyclic)) for k in turn}


def check(spark, calls, results):
    found = tool_calls.link(spark.createDataFrame([(*c, 0, 0) for c in calls], CALLS), spark.createDataFrame(results, RESULTS), tool_calls.CHAT_SCHEMA).collect()
    got = {(r["conv_id"], r["call_id"]): (r["step"], r["depth"], r["cyclic"], r["blocked"]) for r in found if r["status"] != "orphan"}
    assert got == brute(calls, results)


def ask(conv, call, turn, *needs):
    return conv, call, turn, "reply", json.dumps({"turn": turn, "question": "q", "needs": needs})


@pytest.fixture(params=["rows", "rounds"])
def way(request, monkeypatch):
    """Short conversations as rows, or all in rounds."""
    if request.param == "rounds":
        monkeypatch.setattr(tool_calls, "SHORT", 0)


def test_cycles_of_three_and_what_hangs_on_them(spark, way):
    calls = [ask(1, "a", 5, "c"), ask(1, "b", 0, "a"), ask(1, "c", 0, "b"), ask(1, "d", 0, "b"), ask(1, "e", 9, "d"), ask(1, "f", 1)]
    # two cycles with a way from one to the other, and a call on that way
    calls += [ask(2, "a", 0, "b"), ask(2, "b", 0, "a"), ask(2, "m", 0, "a"), ask(2, "x", 0, "y", "m"), ask(2, "y", 1, "z"), ask(2, "z", 2, "x"), ask(2, "s", 3, "s")]
    check(spark, calls, [(1, "b", 7, "r"), (2, "a", 4, "r"), (2, "q", 1, "r")])


def test_random_graphs(spark, way):
    draw = random.Random(7)
    calls, results = [], []
    for conv in range(60):
        n = draw.randrange(1, 12)
        for i in range(n):
            calls.append(ask(conv, f"c{i}", draw.randrange(4) if conv % 2 else i, *{f"c{draw.randrange(n + 1)}" for _ in range(draw.randrange(3))}))
            if draw.random() < 0.6:
                results.append((conv, f"c{i}", draw.randrange(6), "r"))
    check(spark, calls, results)


def test_one_conversation_holds_nearly_all_calls(spark, monkeypatch):
    # a hub that half of them need; nothing is small enough to be broadcast
    monkeypatch.setattr(tool_calls, "BROADCAST_ROWS", 0)
    calls = [ask(1, "hub", 3)] + [ask(1, f"c{i}", i % 5, "hub", *([f"c{i - 100}"] if i >= 300 else [])) for i in range(400)] + [ask(2, "x", 0, "y"), ask(2, "y", 0, "x")]
    check(spark, calls, [(1, "hub", 3, "r")])


def test_empty_calls_and_results(spark, way):
    none, nothing = spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS)
    assert tool_calls.link(none, nothing, tool_calls.CHAT_SCHEMA).count() == 0
    rows = tool_calls.link(none, spark.createDataFrame([(1, "a", 2, "r")], RESULTS), tool_calls.CHAT_SCHEMA).collect()
    assert [(r["status"], r["step"], r["valid"], r["blocked"]) for r in rows] == [("orphan", 2, None, False)]
    assert [r["status"] for r in tool_calls.link(spark.createDataFrame([(*ask(1, "a", 2), 0, 0)], CALLS), nothing, tool_calls.CHAT_SCHEMA).collect()] == ["unanswered"]


def test_long_conversations_take_few_jobs(spark):
    # a chain of 300 calls backward, one forward through cycles of two, and one at random
    draw = random.Random(3)
    calls = [ask(1, f"c{i}", i, f"c{i + 1}") for i in range(300)]
    calls += [ask(2, f"c{i}", i, f"c{i - 1}", *([f"c{i + 1}"] if i % 5 == 1 else [])) for i in range(300)]
    calls += [ask(3, f"c{i}", draw.randrange(50), *{f"c{draw.randrange(120)}" for _ in range(draw.randrange(3))}) for i in range(120)]
    spark.sparkContext.setJobGroup("long", "long conversations")
    check(spark, calls, [(c, f"c{i}", draw.randrange(300), "r") for c in (1, 2, 3) for i in range(0, 120, 3)])
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("long"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs < 100
