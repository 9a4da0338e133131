"""Masks by permutation, many literals at once, and logs that keep no id."""

import random

import pytest
from pyspark.sql import functions as F

from palaver.functions import permute
from palaver.operators import literals, pii

ODD = ["7", "turn-0", "turn-7Q", "call_ab-cd", "call_", "019e8f7d-51e3-7ba2-9c52-4bd9e19a14fc", "019E8F7D-51E3-7BA2-9C52-4BD9E19A14FC", "a" * 40, "---", "é*1", "é\\1", "é\\!1", "日本", "x"]


@pytest.mark.parametrize("value", ODD)
def test_a_step_keeps_the_shape(value):
    new = permute.step(value, "s")
    assert permute.shape(new) == permute.shape(value) and new == permute.step(value, "s")
    assert (new != value) == (permute.size(permute.shape(value)) > 1)
    assert all(a == b or a.isascii() and a.isalnum() for a, b in zip(value, new, strict=True))


@pytest.mark.parametrize("value", ["7", "42", "a1", "A1-", "b-c", "123"])
def test_a_shape_is_one_cycle(value):
    seen, at = [], value
    while not seen or at != value:
        seen.append(at := permute.step(at, "k"))
    assert len(seen) == len(set(seen)) == permute.size(permute.shape(value))


def test_the_network_is_a_permutation():
    for base, n in ((10, 5), (3, 9), (7, 6)):
        there = [permute.permuted(x, base, n, b"key") for x in range(base**n)]
        assert sorted(there) == list(range(base**n)) and there != sorted(there)
        assert all(permute.permuted(y, base, n, b"key", back=True) == x for x, y in enumerate(there[:500]))


def masked(spark, ids, salt="x"):
    got = pii.masks(spark.createDataFrame([(i,) for i in ids], "id string").repartition(3), salt).collect()
    assert len(got) == len(got and {r["id"] for r in got})
    return {r["id"]: r["mask"] for r in got}


def test_masks_of_sequential_ids(spark):
    ids = [f"turn-{k}" for k in range(3000)]
    table = masked(spark, [*ids, ids[0], None])
    assert set(table) == set(ids) and len(set(table.values())) == len(ids) and not set(table.values()) & set(ids)
    random.Random(1).shuffle(ids)
    assert masked(spark, ids) == table != masked(spark, ids, "y")


def test_crowded_shapes_end(spark, monkeypatch):
    """All ten digits; half and more of a small shape; a large shape walked over several rounds, and one too crowded."""
    for n in (10, 5, 6):
        ids = [str(k) for k in range(n)]
        table = masked(spark, ids)
        assert len(set(table.values())) == n and all(k != m for k, m in table.items())
        assert n > 5 or not set(table.values()) & set(ids)
    monkeypatch.setattr(pii, "SMALL_SHAPE", 10)
    for n, free in ((120, True), (400, False)):
        ids = [f"{k:03d}" for k in range(n)]
        table = masked(spark, ids)
        assert len(set(table.values())) == n and all(k != m for k, m in table.items())
        assert not free or not set(table.values()) & set(ids)


def brute(text, pairs):
    out, at = [], 0
    while at < len(text):
        hit = max((a for a in pairs if a and text.startswith(a, at)), key=len, default=None)
        out.append(pairs[hit] if hit else text[at])
        at += len(hit) if hit else 1
    return "".join(out)


@pytest.mark.parametrize("most", [literals.MOST_CHARS, 20])
def test_replacing_is_leftmost_and_longest(spark, most):
    rnd = random.Random(3)
    words = {"".join(rnd.choice("abé😀") for _ in range(rnd.randint(1, 4))) for _ in range(30)}
    pairs = {w: f"<{k}>" for k, w in enumerate(sorted(words))} | {"": "never", "ab": ""}
    texts = ["".join(rnd.choice("abcé😀 ") for _ in range(rnd.randint(0, 30))) for _ in range(200)] + [None, "", "no", "ab" * 3000]
    rows = spark.createDataFrame([(k, t, "own") for k, t in enumerate(texts)], "n int, t string, __number string").repartition(3)
    table = spark.createDataFrame([*pairs.items(), (None, "x")], "a string, b string")
    got = literals.replaced(rows, "t", table, most=most)
    assert got.columns == rows.columns
    assert {r["n"]: r["t"] for r in got.collect()} == {k: None if t is None else brute(t, pairs) for k, t in enumerate(texts)}
    assert {r["t"] for r in literals.replaced(rows, "t", table.limit(0), most=most).collect()} == set(texts)


@pytest.mark.parametrize("most", [literals.MOST_CHARS, 5])
def test_denylist_tables_ignore_case(spark, most):
    rows = spark.createDataFrame([(1, "the SECRET plan"), (2, "İstanbul ÉTÉ"), (3, None), (4, "secret secret"), (None, "plan")], "line int, text string")
    needles = spark.createDataFrame([("Secret",), ("secret",), ("été",), ("",), (None,), ("PLAN",), ("absent",)], "needle string")
    got = sorted(((r["literal"], r["line"]) for r in literals.holding(rows, "text", needles, "line", most=most).collect()), key=str)
    assert got == sorted([("Secret", 1), ("secret", 1), ("PLAN", 1), ("été", 2), ("Secret", 4), ("secret", 4), ("PLAN", None)], key=str)
    a = literals.replaced(rows, "text", spark.createDataFrame([("stanBUL", "X"), ("été", "Y")], "a string, b string"), fold=True, most=most)
    assert {r["text"] for r in a.collect()} >= {"İX Y"}


@pytest.mark.parametrize("most", [literals.MOST_CHARS, 40])
def test_logs_keep_no_gathered_id(spark, monkeypatch, most):
    """The four cases: a null key, ids of other records and shapes, numeric ids, a hundred sequential ones."""
    monkeypatch.setattr(literals.replaced, "__defaults__", (False, most))
    ids = [f"turn-{k}" for k in range(100)] + ["turn-7Q", "call_ab-cd", "call_zzz9"]
    lines = [(None if k % 3 else k, f'{{"type":"event_msg","payload":{{"turn_id":"{i}","see":"{ids[k - 1]}, {ids[k - 5]}x"}}}}') for k, i in enumerate(ids)]
    lines += [(None, '{"type":"event_msg","payload":{"turn_id":7,"at":"2024-07-17T07:00:00Z"}}'), (None, "call_zzz9 in plain text of /home/joe"), (None, None)]
    got = [r["text"] for r in pii.redact_logs(spark.createDataFrame(lines, "key int, text string"), home="/home/joe", salt="s").collect()]
    assert len(got) == len(lines) and got.count(None) == 1
    assert not any(i in t for i in ids[10:] for t in got if t)
    assert '{"type":"event_msg","payload":{"turn_id":7,"at":"2024-07-17T07:00:00Z"}}' in got
    assert any(t and t.endswith("in plain text of /home/user") and not t.startswith("call_zzz9") for t in got)


RECORDS = [
    ({"type": "session_meta", "payload": {"id": "i", "cwd": "/w", "git": {"branch": "b"}, "base_instructions": {"text": "x" * 30}}}, "session_meta / None", "id=i cwd=/w cli=None provider=None\ngit: branch=b commit=None url=None\nbase_instructions: " + "x" * 20 + "  …[+10 chars]"),
    ({"type": "turn_context", "payload": {"cwd": "/w", "model": "m", "timezone": None}}, "turn_context / None", "cwd=/w tz=None date=None model=m approval=None"),
    ({"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "t", "text": "one"}, {"input_text": "two"}, "three", {"k": 1}]}}, "response_item / message", '[user] one two three {"k":1'[:27] + "  …[+1 chars]"),
    ({"type": "event_msg", "payload": {"type": "agent_message", "message": "", "text": "said", "memory_citation": "m"}}, "event_msg / agent_message", "said\n  memory_citation: m"),
    ({"type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": '{"command": ["ls", "-l"], "workdir": "/w"}'}}, "response_item / function_call", '[shell] cwd=/w\n  $ ["ls","-l"]'),
    ({"type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": "plain text"}}, "response_item / function_call", "[shell] cwd=None\n  $ plain text"),
    ({"type": "response_item", "payload": {"type": "function_call_output", "output": "ok"}}, "response_item / function_call_output", "ok"),
    ({"type": "response_item", "payload": {"type": "custom_tool_call", "name": "p", "status": "done", "input": "in"}}, "response_item / custom_tool_call", "[p] status=done\nin"),
    ({"type": "response_item", "payload": {"type": "reasoning", "summary": []}}, "response_item / reasoning", "(no summary; encrypted_content=<encrypted>)"),
    ({"type": "response_item", "payload": {"type": "reasoning", "summary": [{"text": "why"}]}}, "response_item / reasoning", "why"),
    ({"type": "event_msg", "payload": {"type": "patch_apply_end", "status": "s", "success": True, "changes": {"a.py": {"unified_diff": "+" * 12}, "b.py": {}}}}, "event_msg / patch_apply_end", "status=s success=True files=2\n  a.py: ++++++++++  …[+2 chars]\n  b.py: "),
    ({"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"total_tokens": 7}}, "rate_limits": {"plan_type": None}}}, "event_msg / token_count", "total_tokens=7 plan=None"),
    ({"type": "other", "payload": {"type": "odd", "a": 1}}, "other / odd", '{"a":1,"type":"odd"}'),
    ({"type": "bare"}, "bare / None", "None"),
]


def test_digest_by_record_type(spark):
    import json

    rows = [(k, json.dumps(r)) for k, (r, _, _) in enumerate(RECORDS)] + [(90, "not json"), (91, None), (92, "[1]")]
    got = {r["line"]: r["digest"] for r in pii.legible(spark.createDataFrame(rows, "line int, text string"), 20).collect()}
    for k, (_, head, body) in enumerate(RECORDS):
        assert got[k] == f"--- line {k}: {head} ---\n{body}", k
    assert got[90] is got[91] is got[92] is None


def test_large_tables_meet_each_text_once(spark, monkeypatch):
    """Literals of many lengths in windows, beside chance matches: as the automaton finds them; texts aren't copied for each part of the table."""
    monkeypatch.setattr(literals, "CHARS", 16)
    words = [f"id{k}" for k in range(0, 300, 3)] + ["a", "aa", "aaa", "x" * 37, "İ", "𝒳y", "Doc 12", "doc 123"]
    texts = [" ".join(f"ID{j}" for j in range(k, k + 9)) + " DOC 1234 aaaa " + "x" * (30 + k) + "İ𝒳Y" for k in range(20)] + ["", None, "a"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "line int, text string")
    needles = spark.createDataFrame([(w,) for w in words], "w string")
    wide, narrow = ({(r["literal"], r["line"]) for r in literals.holding(rows, "text", needles, "line", most=m).collect()} for m in (literals.MOST_CHARS, 10))
    assert narrow == wide != set()
    table = needles.select("w", F.concat(F.lit("<"), "w", F.lit(">")))
    put = [{(r["line"], r["text"]) for r in literals.replaced(rows, "text", table, fold=True, most=m).collect()} for m in (literals.MOST_CHARS, 10)]
    assert put[0] == put[1]
    for bits in (64, 1 << 20):  # nearly all bits set: more chance matches, the same result
        monkeypatch.setattr(literals, "FEWEST_BITS", bits)
        monkeypatch.setattr(literals, "MOST_BITS", bits)
        assert {(r["literal"], r["line"]) for r in literals.holding(rows, "text", needles, "line", most=10).collect()} == wide
    plan = literals.holding(rows, "text", needles, "line", most=10)._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan  # no stream of copies
