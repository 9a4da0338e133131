"""The log source in batch and as a stream, the sweep, and documents written at their paths."""

import json
import os

import pytest
from pyspark.sql import functions as F

from palaver.sources import documents_sink, logs, sessions, storage
from palaver.streaming import mirror


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "logs"
    (root / "p/sub").mkdir(parents=True)
    (root / "p/a.jsonl").write_bytes('{"a": 1}\n\nnot json\n{"b": "é \x85"}\n{"torn": '.encode())
    (root / "p/sub/b.jsonl").write_bytes(b'{"c": 1}\n')
    (root / "p/bad.jsonl").write_bytes(b'{"c": 1}\n{"d": "\xff"}\n{"e": 1}\n')
    (root / "p/half.jsonl").write_bytes(b'{"c": 1}\n{"torn": "\xc3')
    (root / "p/empty.jsonl").write_bytes(b"")
    (root / "p/none.jsonl").write_bytes(b"no end")
    (root / "p/notes.txt").write_bytes(b"{}\n")
    (root / "p/rollout-1.jsonl").write_bytes(b'{"r": 1}\n')
    outside = tmp_path / "outside"
    outside.mkdir()
    (outside / "secret.jsonl").write_bytes(b'{"s": 1}\n')
    os.symlink(outside, root / "p/linked")
    os.symlink(outside / "secret.jsonl", root / "p/secret.jsonl")
    return root


@pytest.mark.parametrize("size", [logs.RANGE, 1, 7, 10])
def test_lines_whatever_the_ranges(spark, tree, size, monkeypatch):
    lines, bad = logs.read_lines(spark, [("h1", str(tree)), ("h2", str(tree / "p/sub"))], "claude-code", size)
    got = {(r["host"], r["rel_path"], r["line_no"], r["line"], r["source"], r["email"]) for r in lines.collect()}
    old = {(r["host"], r["rel_path"], r["line_no"], r["line"], r["source"], r["email"]) for r in sessions.complete_lines(sessions.session_files(spark, [("h1", str(tree)), ("h2", str(tree / "p/sub"))])).collect()}
    assert {g for g in old if "linked" not in g[1] and "secret" not in g[1]} == got  # links are not followed here
    assert ("h1", "p/a.jsonl", 3, '{"b": "é \x85"}', "claude-code", "p") in got and len(got) == 7
    assert {os.path.basename(r["path"]) for r in bad.collect()} == {"bad.jsonl", "half.jsonl"}
    good, malformed = sessions.parsed_lines(lines)
    assert good.count() == 5 and [r["line_no"] for r in malformed.collect()] == [2]


def test_rollouts_and_empty_trees(spark, tree, tmp_path):
    lines, bad = logs.read_lines(spark, [("h", str(tree))], "codex")
    assert [(r["rel_path"], r["line"], r["source"]) for r in lines.collect()] == [("p/rollout-1.jsonl", '{"r": 1}', "codex")] and not bad.count()
    lines, bad = logs.read_lines(spark, [("h", str(tmp_path / "nothing"))], "codex")
    assert lines.count() == bad.count() == 0
    with pytest.raises(Exception, match="kind must be"):
        logs.read_lines(spark, [("h", str(tree))], "other")[0].count()


def test_long_lines_and_blocks(spark, tmp_path, monkeypatch):
    (tmp_path / "p").mkdir()
    want = ["x" * n for n in (0, 5, 70_000, 3, 200_000, 1)]
    (tmp_path / "p/a.jsonl").write_text("\n".join(want) + "\n")
    for size in (1000, 65536, 100_000):
        lines, _ = logs.read_lines(spark, [("h", str(tmp_path))], "claude-code", size)
        assert [r["line"] for r in lines.orderBy("line_no").collect()] == want


def archived(spark, at):
    return sorted((os.path.basename(r["rel_path"]), r["at"], r["line"]) for r in spark.read.parquet(at).collect())


def test_sweep_over_three_batches(spark, tree, tmp_path):
    at, state = str(tmp_path / "archive"), str(tmp_path / "state")
    go = lambda: mirror.sweep(spark, str(tree), at, state, "claude-code", "h").awaitTermination()
    go()
    first = [("a.jsonl", 0, '{"a": 1}'), ("a.jsonl", 19, '{"b": "é \x85"}'), ("b.jsonl", 0, '{"c": 1}'), ("bad.jsonl", 0, '{"c": 1}'), ("bad.jsonl", 20, '{"e": 1}'), ("half.jsonl", 0, '{"c": 1}'), ("rollout-1.jsonl", 0, '{"r": 1}')]
    assert archived(spark, at) == first
    with (tree / "p/a.jsonl").open("ab") as f:
        f.write(b'2}\n{"more": 1}\n{"torn again"')
    (tree / "p/sub/b.jsonl").write_bytes(b"{}\n")
    go()
    second = sorted([*first, ("a.jsonl", 36, '{"torn": 2}'), ("a.jsonl", 48, '{"more": 1}')])
    assert archived(spark, at) == second
    told = [(os.path.basename(r["path"]), r["kind"], r["detail"]) for r in mirror.reported(spark, state).collect()]
    assert told == [("b.jsonl", "truncated", "archive has 9 bytes, source 3")]
    with (tree / "p/sub/b.jsonl").open("ab") as f:  # grows again: nothing below the mark, then what is beyond it
        f.write(b'{"below": 1}\n')
    go()
    assert archived(spark, at) == second and mirror.reported(spark, state).count() == 1
    with (tree / "p/sub/b.jsonl").open("ab") as f:
        f.write(b'{"beyond": 1}\n')
    go()
    assert archived(spark, at) == sorted([*second, ("b.jsonl", 16, '{"beyond": 1}')])
    go()
    assert len(archived(spark, at)) == len(second) + 1


def test_a_batch_that_is_tried_again_appends_nothing(spark, tmp_path):
    at, state = str(tmp_path / "archive"), str(tmp_path / "state")
    rows = lambda *r: spark.createDataFrame(list(r), "path string, line_no long, line string")
    present = F.when(F.min("line_no") == 0, F.max("line_no") + 1)
    put = lambda df, n: mirror.append_new(df, n, at, state, "r", "line_no", F.col("line_no") + 1, present)
    got = lambda: sorted((r["path"], r["line_no"]) for r in spark.read.parquet(at).collect())
    put(rows(("a", 0, "{}"), ("a", 1, "{}"), ("a", 1, "{}"), ("b", 0, "bad")), 0)
    for _ in range(3):
        put(rows(("a", 1, "{}"), ("a", 2, "{}"), ("b", 1, "{}")), 1)
        assert got() == [("a", 0), ("a", 1), ("a", 2), ("b", 1)]
    for n in range(2, 70):
        if n in (2, 31, 32, 33, 64, 69):
            put(rows(("a", n + 1, "{}"), (f"c{n}", 0, "{}"), ("a", 0, "{}")), n)
    assert [x for x in got() if x[0] == "a"] == [("a", k) for k in (0, 1, 2, 3, 32, 33, 34, 65, 70)]
    put(rows(("b", 0, "{}")), 70)
    assert [tuple(r) for r in mirror.reported(spark, state).collect()] == [("truncated", "b", "archive has 2 lines, source 1")]


def test_marks_of_an_archive_that_is_there(spark, tmp_path):
    land, out, state = (str(tmp_path / n) for n in ("land", "out", "state"))
    rows = spark.createDataFrame([("a", k, "{}") for k in range(4)], "path string, line_no long, line string")
    mirror.mirror_batch(rows.where("line_no < 2"), out)
    rows.write.parquet(land)
    mirror.mirror_stream(spark.readStream.schema(rows.schema).parquet(land), out, state).awaitTermination()
    kept = spark.read.option("recursiveFileLookup", True).parquet(out)
    assert sorted(r["line_no"] for r in kept.collect()) == [0, 1, 2, 3]


DOCS = [("a/b.md", "hé\nx"), ("a/c.md", None), ("../x.md", "y"), ("/abs.md", "y"), (None, "y"), ("", "y"), ("a//b.md", "y"), ("a/./b.md", "y"), (".status/x", "y"), ("d/" + "n" * 300, "z"), ("e.md", "")]


def test_documents_stand_at_their_paths(spark, tmp_path):
    root = tmp_path / "out"
    docs = spark.createDataFrame([(k, *d) for k, d in enumerate(DOCS)], "k int, rel_path string, body string").repartition(3)
    for _ in range(2):  # a rerun changes nothing
        told = documents_sink.write(docs, str(root)).collect()
        assert sorted(((r["rel_path"], r["status"]) for r in told), key=str) == sorted(((p, "written" if p in ("a/b.md", "e.md") else "failed") for p, _ in DOCS), key=str)
        assert all((r["problem"] is None) == (r["status"] == "written") for r in told)
        files = {rel: (root / rel).read_bytes() for rel, _, _ in storage.listed(str(root)) if not rel.startswith(".status")}
        assert files == {"a/b.md": "hé\nx".encode(), "e.md": b""}
    assert not list(root.glob(".staging*"))


def test_a_task_that_fails_once(spark, tmp_path, monkeypatch):
    """The writer's task ends in the middle; its next attempt writes all, and no part of the first one is seen."""
    root = tmp_path / "out"
    writer = documents_sink._Writer(str(root), "job")
    rows = [{"rel_path": f"d/{k}.md", "body": f"body {k}"} for k in range(5)]

    class Task:
        def __init__(self, attempt):
            self.attempt = attempt

        def partitionId(self):
            return 0

        def taskAttemptId(self):
            return self.attempt

    def failing():
        yield from rows[:3]
        raise RuntimeError("executor lost")

    monkeypatch.setattr(documents_sink.TaskContext, "get", lambda: Task(1))
    with pytest.raises(RuntimeError):
        writer.write(failing())
    assert not (root / "d").exists()
    monkeypatch.setattr(documents_sink.TaskContext, "get", lambda: Task(2))
    assert writer.write(iter(rows)).written == 5
    writer.commit([])
    assert {p.name: p.read_text() for p in (root / "d").iterdir()} == {f"{k}.md": f"body {k}" for k in range(5)}
    assert not list(root.glob(".staging*")) and len((root / ".status/job/part-000000.json").read_text().splitlines()) == 5
    writer.abort([])


def test_landed_conversations_end_to_end(spark, tmp_path):
    """Sessions written as files, read as logs: the lines are the rows."""
    c = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    line = F.to_json(F.struct("turn", "role", "text"))
    files = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: F.concat(x["l"], F.lit("\n"))), "").alias("body"))
    docs = files.select(F.format_string("p%d/%d.jsonl", F.col("conv_id") % 3, "conv_id").alias("rel_path"), "body")
    assert {r["status"] for r in documents_sink.write(docs, str(tmp_path / "t")).collect()} == {"written"}
    lines, bad = logs.read_lines(spark, [("h", str(tmp_path / "t"))], "claude-code", 100)
    got = sorted((r["rel_path"], r["line_no"], json.loads(r["line"])["text"]) for r in lines.collect())
    want = sorted((f"p{r['conv_id'] % 3}/{r['conv_id']}.jsonl", r["turn"], r["text"]) for r in c.collect())
    assert got == want and not bad.count()


def test_adapters(spark, tmp_path):
    """Both kinds of logs to one table of items; both kinds of exports to problems, items and accounts."""
    from palaver.sources import adapters

    from .test_archive import ROLLOUT, SESSION, TALK, TREE

    (tmp_path / "s/proj").mkdir(parents=True)
    (tmp_path / "s/proj/s1.jsonl").write_text("\n".join(SESSION) + "\n")
    (tmp_path / "c/2024").mkdir(parents=True)
    (tmp_path / "c/2024/rollout-1.jsonl").write_text("\n".join(ROLLOUT) + "\n")
    (tmp_path / "c/2024/rollout-2.jsonl").write_bytes(b"\xff\n")
    items, bad = adapters.all_items(spark, {"claude-code": [("h", str(tmp_path / "s"))], "codex": [("h", str(tmp_path / "c"))]})
    rows = {r["source"]: r for r in items.collect()}
    assert rows["claude-code"]["texts"] == ["/loop 5m", "one", "two", "real prompt\nmore"] and rows["claude-code"]["uuid"] == "s1" and rows["claude-code"]["model"] == "m-a"
    assert rows["codex"]["texts"] == ["PING", "PONG"] and rows["codex"]["uuid"] == "r1" and rows["codex"]["host"] == "h"
    assert sorted((os.path.basename(r["path"]), r["line_no"], r["reason"]) for r in bad.collect()) == [("rollout-2.jsonl", None, "invalid UTF-8"), ("s1.jsonl", 8, "not a JSON object")]

    (tmp_path / "claude").mkdir()
    (tmp_path / "claude/users.json").write_text(json.dumps([{"uuid": "u1", "email_address": "a@b.com"}, {"uuid": "u2"}]))
    (tmp_path / "claude/conversations.json").write_text(json.dumps([TALK, {"uuid": "c2"}]))
    a = adapters.EXPORTS["claude"]
    batch = a.load(spark, str(tmp_path / "claude"))
    assert sorted((r["table"], r["pos"], r["error"]) for r in a.problems(batch).collect()) == [("conversations", 1, f"missing: {f}") for f in ("account", "chat_messages", "created_at", "name")] + [("users", 1, "missing: email_address")]
    assert [r["texts"] for r in a.items(batch["conversations"]).where("uuid = 'c1'").collect()] == [["Trip", "hello paris", "hello paris", "bonjour"]]
    assert {r["account"] for r in a.accounts(batch).collect()} == {"u1", "u2"}
    (tmp_path / "chatgpt").mkdir()
    (tmp_path / "chatgpt/user.json").write_text(json.dumps({"id": "o1", "email": "a@b.com"}))
    (tmp_path / "chatgpt/conversations.json").write_text(json.dumps([TREE, {"title": "x"}]))
    a = adapters.EXPORTS["chatgpt"]
    batch = a.load(spark, str(tmp_path / "chatgpt"))
    assert sorted(r["error"] for r in a.problems(batch).collect()) == ["missing: create_time", "missing: id"]
    assert [r["uuid"] for r in a.items(batch["conversations"]).collect()] == ["t1"] and [r["account"] for r in a.accounts(batch).collect()] == ["o1"]
