import json
import random
import time

import pytest

from lumenweave.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, call_id string"


def call(id_, name="search", args=None, after=None):
    body = {"name": name, "id": id_, "arguments": {"query": "x"} if args is None else args}
    return f"<tool_call>{json.dumps(body | ({'after': after} if after else {}))}</tool_call>"


def answer(id_, content="fine"):
    return json.dumps({"tool_call_id": id_, "content": content})


@pytest.fixture(scope="module")
def lines(spark):
    rows = [
        (1, 0, "user", "Ask, please: é \"q\" \\ \n"),
        (1, 1, "assistant", "Two." + call("b", after=["a"]) + call("a", "lookup", {"scale": 2.5, "key": "k", "options": {"z": 1, "a": [1, {"y": 0, "b": None}]}, "tags": [], "exact": True})),
        (1, 2, "tool", answer("b", {"n": 1, "a": 2})),
        (1, 3, "tool", answer("a")),
        (1, 4, "tool", answer("a", "again")),
        (1, 5, "tool", answer("nobody")),
        (1, 6, "tool", "not json"),
        (1, 7, "assistant", call("a") + "<tool_call>{broken</tool_call>" + call("late", after=["a", "unknown"])),
        (2, 0, "assistant", call("a", after=["b"]) + call("b", after=["a"]) + call("c", after=["b"])),
        (3, 0, "assistant", call("1", "none") + call("2", args={}) + call("3", args={"query": 3}) + call("4", args={"query": "x", "other": 1}) + call("5", args=[1]) + call("6", args={"query": "x", "limit": 3}) + call("7", args={"query": "x", "limit": 3.5})),
        (4, 0, None, None),
        (None, None, "assistant", call("a")),
        (5, 0, "user", "twice"),
        (5, 0, "user", "twice"),
    ]
    # a chain in which the first written call comes last
    rows.append((6, 0, "assistant", call("x3", after=["x2"]) + call("x2", after=["x1"])))
    rows.append((6, 4, "assistant", call("x1")))
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return chat.chat_lines(df, chat.tools_table(spark)).collect()


def of(lines, conv, kind):
    return {(r.turn, r.part): r for r in lines if r.conv_id == conv and r.kind == kind}


def test_status(lines):
    a = of(lines, 1, "call")
    assert [a[k].status for k in sorted(a)] == ["ok", "ok", "duplicate", "broken", "unanswered"]
    r = of(lines, 1, "result")
    assert [r[k].status for k in sorted(r)] == ["ok", "ok", "duplicate", "unmatched", "broken"]
    assert [x.status for _, x in sorted(of(lines, 2, "call").items())] == ["cycle"] * 3
    assert [x.status for _, x in sorted(of(lines, 3, "call").items())] == ["invalid"] * 5 + ["unanswered", "invalid"]
    assert [r.status for r in lines if r.conv_id is None and r.kind == "call"] == ["broken"]
    assert len([r for r in lines if r.conv_id == 5]) == 2


def test_order(lines):
    for conv in {r.conv_id for r in lines if r.conv_id}:
        own = sorted((r for r in lines if r.conv_id == conv), key=lambda r: (r.at_turn, r.level, r.turn, r.part))
        place = {r.call_id: i for i, r in enumerate(own) if r.kind == "call" and r.status != "duplicate"}
        for i, r in enumerate(own):
            if r.kind == "result" and r.status == "ok":
                assert place[r.call_id] < i
    x = {r.call_id: (r.at_turn, r.level) for r in lines if r.conv_id == 6 and r.kind == "call"}
    assert x == {"x1": (4, 0), "x2": (4, 1), "x3": (4, 2)}
    one = {r.call_id: (r.at_turn, r.level) for r in lines if r.conv_id == 1 and r.kind == "call" and r.turn == 1}
    assert one == {"a": (1, 0), "b": (1, 1)}


def test_canonical_json(lines):
    for r in lines:
        x = json.loads(r.json)
        assert r.json == json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    first = of(lines, 1, "message")[0, 0]
    assert json.loads(first.json) == {"role": "user", "content": "Ask, please: é \"q\" \\ \n"}
    assert json.loads(of(lines, 1, "call")[1, 2].json)["arguments"]["options"] == {"z": 1, "a": [1, {"y": 0, "b": None}]}
    assert json.loads(of(lines, 1, "result")[2, 1].json)["content"] == {"n": 1, "a": 2}
    assert json.loads(of(lines, 1, "message")[1, 0].json) == {"role": "assistant", "content": "Two."}


def test_empty(spark):
    assert chat.chat_lines(spark.createDataFrame([], SCHEMA), chat.tools_table(spark)).count() == 0


def test_numbers_are_written_by_value(spark):
    raw = {"1": "1", "1.0": "1", "1e2": "100", "-0": "0", "-0.0": "0", "1.50": "1.5", "-2.250": "-2.25", "1E-7": "1.0E-7", "0.10": "0.1", "12345678901234567890": "12345678901234567890", "1e3": "1000"}
    rows = [(i, 0, "assistant", '<tool_call>{"name":"lookup","id":"a","arguments":{"scale":' + n + ',"key":"1.0 \\" 1e2 1.50"}}</tool_call>') for i, n in enumerate(raw)]
    df = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    got = {r.conv_id: r for r in chat.chat_lines(df, chat.tools_table(spark)).collect() if r.kind == "call"}
    for i, want in enumerate(raw.values()):
        assert got[i].json == '{"arguments":{"key":"1.0 \\" 1e2 1.50","scale":' + want + '},"id":"a","name":"lookup","type":"call"}'
    rows = [(i, 0, "assistant", call("a", args=None).replace('"x"', '"x","limit":' + n)) for i, n in enumerate(["1.0", "1e2", "1.5", "2"])]
    df = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    got = {r.conv_id: r.status for r in chat.chat_lines(df, chat.tools_table(spark)).collect() if r.kind == "call"}
    assert got == {0: "unanswered", 1: "unanswered", 2: "invalid", 3: "unanswered"}


@pytest.mark.parametrize("most", [0, 256])
def test_order_against_plain_version(spark, monkeypatch, most):
    monkeypatch.setattr(chat, "AT_ONCE", most)
    r = random.Random(most)
    rows = []
    for conv in range(8):
        n = r.randint(1, 12)
        rows += [(conv, f"c{i}", r.randint(0, 9), [f"c{r.randrange(n + 1)}" for _ in range(r.randint(0, 2))] if r.random() < 0.7 else None) for i in range(n)]
    rows += [(100, f"c{i}", i, [f"c{i - 1}"]) for i in range(40)]
    rows += [(101, f"c{i}", i, [f"c{i + 1}"] + [f"c{i + 5}"] * (i % 7 == 0)) for i in range(30)]  # each comes after later ones
    rows += [(102, f"c{i}", i, [f"c{(i + 1) % 9}"] if i < 9 else [f"c{i - 1}"]) for i in range(14)]  # a circle, and calls after it
    rows += [(103, "a", 1, ["a"]), (103, "b", 2, ["a"]), (103, "c", 3, None)]
    rows += rows[:3]
    got = sorted(tuple(x) for x in chat.call_order(spark.createDataFrame(rows, "conv_id long, call_id string, turn long, after array<string>")).collect())
    own = {(c, i): (t, [a for a in after or [] if any(x[0] == c and x[1] == a for x in rows)]) for c, i, t, after in rows}

    def level(key, path=()):
        if key in path:
            return None
        each = [level((key[0], a), (*path, key)) for a in own[key][1]]
        return None if None in each else (max([own[key][0], *(t for t, _ in each)]), 1 + max(l for _, l in each) if each else 0)

    want = sorted((*k, *(level(k) or (t, 0)), level(k) is None) for k, (t, _) in own.items())
    assert got == want


@pytest.mark.parametrize("n,most", [(250, 256), (1000, 256), (3000, 256)])
@pytest.mark.parametrize("turned", [False, True])
def test_long_chains_take_less_than_a_minute(spark, monkeypatch, n, most, turned):
    monkeypatch.setattr(chat, "AT_ONCE", most)
    rows = [(1, f"c{i}", n - i if turned else i, [f"c{i - 1}"]) for i in range(n)]
    began = time.time()
    got = {r.call_id: (r.at_turn, r.level, r.cyclic) for r in chat.call_order(spark.createDataFrame(rows, "conv_id long, call_id string, turn long, after array<string>")).collect()}
    assert time.time() - began < 60
    assert got == {f"c{i}": (n if turned else i, i, False) for i in range(n)}
