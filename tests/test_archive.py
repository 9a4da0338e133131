"""Sources and normalisation on small files written here."""

import json

import pytest
from pyspark.sql import functions as F

from palaver.operators import export, grams, normalize, quality, search, turns
from palaver.sources import exports, providers, sessions, sinks

TALK = {
    "uuid": "c1", "name": "Trip", "summary": "", "created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-02T00:00:00Z", "account": {"uuid": "u1"},
    "chat_messages": [
        {"uuid": "m1", "text": "hello paris", "content": [{"type": "text", "text": "hello paris"}], "sender": "human", "created_at": "2024-01-01T00:00:00Z", "attachments": [{"file_name": "b.txt"}], "files": [{"file_name": "a.txt"}, {"file_name": "b.txt"}]},
        {"uuid": "m2", "text": "", "content": [{"type": "text", "text": "bonjour"}], "sender": "assistant", "created_at": "2024-01-03T00:00:00+00:00", "attachments": [], "files": []},
    ],
}
TREE = {
    "id": "t1", "title": None, "create_time": None, "update_time": 1700000000.5,
    "mapping": {
        "z": {"id": "z", "message": None},
        "b": {"id": "b", "message": {"author": {"role": "user"}, "content": {"content_type": "text", "parts": ["first", {"image": 1}, "second"]}, "metadata": {"model_slug": "gpt-4o"}}},
        "a": {"id": "a", "message": {"author": {"role": "assistant"}, "content": {"content_type": "code", "parts": ["hidden"]}, "metadata": {"model_slug": "o1"}}},
    },
}
BOOK = {"uuid": "p1", "name": "Book", "description": "about", "prompt_template": "", "created_at": "2024-01-01T00:00:00Z", "creator": {"uuid": "u1"}, "docs": [{"filename": "n.md", "content": "body"}]}


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("archive")
    for at, value in {"claude/a@b.com/conversations/c1.json": TALK, "chatgpt/a@b.com/conversations/t1.json": TREE, "claude/a@b.com/projects/p1.json": BOOK}.items():
        (root / at).parent.mkdir(parents=True, exist_ok=True)
        (root / at).write_text(json.dumps(value))
    (root / "claude/a@b.com/conversations/bad.json").write_text("{not json")
    return exports.archive(spark, str(root))


def test_archive_items(archive):
    rows = {r["uuid"]: r for r in normalize.archive_items(archive.where("parsed IS NOT NULL")).collect()}
    assert rows["c1"]["texts"] == ["Trip", "hello paris", "hello paris", "bonjour"]
    assert rows["c1"]["updated_at"] == "2024-01-03T00:00:00+00:00"
    assert rows["t1"]["texts"] == ["first", "second"] and rows["t1"]["name"] == "(untitled)" and rows["t1"]["name_raw"] == ""
    assert rows["t1"]["created_at"] == "2023-11-14T22:13:20.500000Z" and rows["t1"]["model"] == "gpt-4o"
    assert rows["p1"]["texts"] == ["Book", "about", "n.md", "body"] and rows["p1"]["item_type"] == "project"
    assert [r["reason"] for r in exports.quarantine(archive).collect()] == ["not valid JSON"]


def test_documents_of_many_lines(spark, tmp_path):
    """A pretty-printed document is one value."""
    (tmp_path / "claude/a@b.com/conversations").mkdir(parents=True)
    (tmp_path / "claude/a@b.com/conversations/c1.json").write_text(json.dumps(TALK, indent=2))
    found = exports.archive(spark, str(tmp_path))
    assert found.count() == 1 and exports.quarantine(found).count() == 0
    assert [r["uuid"] for r in normalize.archive_items(found).collect()] == ["c1"]


def test_markdown(archive):
    talk = archive.where("item_type = 'conversation' AND provider = 'claude' AND parsed IS NOT NULL").select(F.from_json("value", exports.CONVERSATION).alias("item"))
    body = talk.select(export.conversation_markdown(F.col("item")).alias("b")).first()["b"]
    assert body.startswith("# Trip\n") and "*📎 2 files: a.txt, b.txt*" in body and body.count("hello paris") == 1 and "bonjour" in body
    book = archive.where("item_type = 'project'").select(F.from_json("value", exports.PROJECT).alias("item"))
    assert "## 📄 n.md" in book.select(export.project_markdown(F.col("item")).alias("b")).first()["b"]


def test_export_batches(spark, tmp_path):
    (tmp_path / "users.json").write_text(json.dumps([{"uuid": "u1", "email_address": "a@b.com"}]))
    (tmp_path / "conversations.json").write_text(json.dumps([TALK, {"uuid": "c2", "chat_messages": [{"uuid": None, "sender": "robot"}]}]))
    (tmp_path / "projects").mkdir()
    (tmp_path / "projects/p1.json").write_text(json.dumps(BOOK))
    got = exports.batch(spark, str(tmp_path))
    assert [got[k].count() for k in ("users", "conversations", "projects")] == [1, 2, 1]
    errors = {r["error"] for r in quality.conversation_structure(got["conversations"]).collect()}
    assert errors == {"missing: name", "missing: created_at", "missing: account", "missing: uuid", "bad sender"}
    assert quality.missing_fields(got["users"], quality.USERS).count() == 0
    assert quality.project_structure(got["projects"]).count() == 0


def test_threads_need_id_and_time(spark, tmp_path):
    (tmp_path / "conversations.json").write_text(json.dumps([TREE, {"title": "x", "create_time": 1.0}, {"id": "y"}]))
    items, errors = normalize.normalized_threads(exports.thread_batch(spark, str(tmp_path))["conversations"])
    assert [(r["uuid"], r["name"]) for r in items.collect()] == [("t1", "")]
    assert {r["reason"] for r in errors.collect()} == {"missing id", "missing create_time and update_time"}


def line(**kw):
    return json.dumps(kw)


SESSION = [
    line(type="permission-mode", sessionId="s1"),
    line(type="user", timestamp="T1", sessionId="s1", cwd="/w", gitBranch="main", message={"role": "user", "content": "<local-command-caveat>x"}),
    line(type="user", timestamp="T2", cwd="/w", message={"role": "user", "content": "<command-args>5m</command-args><command-name>/loop</command-name>"}),
    line(type="assistant", timestamp="T3", message={"model": "m-a", "content": [{"type": "thinking", "thinking": "hm"}]}),
    line(type="assistant", timestamp="T4", message={"model": "m-a", "content": [{"type": "text", "text": "one"}, {"type": "tool_use", "name": "Bash"}, {"type": "tool_use", "name": "Bash"}]}),
    line(type="user", timestamp="T5", message={"content": [{"type": "tool_result"}]}),
    line(type="assistant", timestamp="T6", message={"model": "m-b", "content": [{"type": "text", "text": "two"}]}),
    "",
    "not json",
    line(type="user", timestamp="T7", message={"content": "real prompt\nmore"}),
    line(type="assistant", timestamp="T8", message={"model": "<synthetic>", "content": []}),
]
ROLLOUT = [
    line(timestamp="R0", type="session_meta", payload={"id": "r1", "cwd": "/r", "timestamp": "RC"}),
    line(timestamp="R1", type="event_msg", payload={"type": "user_message", "message": "PING"}),
    line(timestamp="R2", type="response_item", payload={"type": "function_call", "name": "shell", "call_id": "1"}),
    line(timestamp="R3", type="event_msg", payload={"type": "agent_message", "message": "PONG"}),
]


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    (root / "proj/sub/deep").mkdir(parents=True)
    (root / "proj/s1.jsonl").write_text("\n".join(SESSION) + "\n" + '{"torn": ')
    (root / "proj/sub/deep/agent.jsonl").write_text(SESSION[4] + "\n")
    (root / "proj/bad.jsonl").write_bytes(b'{"a": "\xff"}\n')
    (root / "r").mkdir()
    (root / "r/rollout-2024-r1.jsonl").write_text("\n".join(ROLLOUT) + "\n")
    return str(root)


def test_session_log(spark, logs):
    files = sessions.session_files(spark, [("box", logs + "/proj/.."[:0] or logs)]).where("path NOT LIKE '%rollout%'")
    assert {r["rel_path"]: r["source"] for r in files.collect()} == {"proj/s1.jsonl": "claude-code", "proj/bad.jsonl": "claude-code", "proj/sub/deep/agent.jsonl": providers.TOOLS_ONLY}
    assert sessions.invalid_files(files).count() == 1
    good, bad = sessions.parsed_lines(sessions.complete_lines(files))
    assert [(r["line_no"], r["reason"]) for r in bad.collect()] == [(8, "not a JSON object")]
    events = normalize.session_events(good)
    mine = turns.assemble(events.where("path LIKE '%s1.jsonl'")).orderBy("turn_no").collect()
    assert [(t["role"], t["ts"], t["content"], t["tool_uses"]) for t in mine] == [
        ("user", "T2", "/loop 5m", []), ("assistant", "T3", "one\n\ntwo", ["Bash"]), ("user", "T7", "real prompt\nmore", []),
    ]
    counts = {r["path"].rsplit("/", 1)[1]: r["n"] for r in turns.tool_counts(events).collect()}
    assert counts == {"s1.jsonl": 2, "agent.jsonl": 2}
    meta = normalize.session_metadata(good.where("path LIKE '%s1.jsonl'"))
    m = meta.first()
    assert (m["session_id"], m["cwd"], m["git_branch"], m["created_at"], m["updated_at"], m["name"]) == ("s1", "/w", "main", "T1", "T8", "real prompt")
    items = normalize.session_items(meta, events, files, normalize.session_models(good), "claude-code").collect()
    assert [(i["model"], i["host"], i["email"], i["texts"]) for i in items] == [("m-a", "box", "proj", ["/loop 5m", "one", "two", "real prompt\nmore"])]
    doc = export.transcript_markdown(meta, turns.assemble(events), providers.resume(F.lit("claude-code"), F.col("session_id"))).first()["body"]
    assert "**Resume:** `cd /w && claude -r s1`" in doc and "*Tools used: Bash*" in doc


def test_rollout(spark, logs):
    files = sessions.rollout_files(spark, [("box", logs)])
    good, _ = sessions.parsed_lines(sessions.complete_lines(files))
    made = turns.assemble(normalize.rollout_events(good)).orderBy("turn_no").collect()
    assert [(t["role"], t["content"], t["tool_uses"], t["ts"]) for t in made] == [("user", "PING", [], "R1"), ("assistant", "PONG", ["shell"], "R2")]
    m = normalize.rollout_metadata(good).first()
    assert (m["session_id"], m["cwd"], m["created_at"], m["updated_at"], m["name"]) == ("r1", "/r", "RC", "R3", "PING")


def test_sources():
    assert sessions.parse_sources("a=/x, b=/y") == [("a", "/x"), ("b", "/y")]
    with pytest.raises(ValueError):
        sessions.parse_sources("/x")


def test_choose(spark):
    rows = spark.createDataFrame([("llm",), ("codex",), (providers.TOOLS_ONLY,)], "source string")
    assert providers.choose(rows, "all").count() == 2 and providers.choose(rows, "codex").count() == 1
    with pytest.raises(ValueError):
        providers.choose(rows, "codex", {"llm"})


def test_words_in_two_texts_are_no_match(spark):
    texts = spark.createDataFrame([("a", "alpha"), ("a", "beta"), ("b", "alpha beta"), ("c", "xy")], "path string, text string")
    index = grams.build(texts, ["path"])
    assert {r["path"] for r in grams.candidates(index, "alpha beta", ["path"]).collect()} == {"a", "b"}
    assert [r["path"] for r in search.score_texts(texts, "alpha beta", ["path"]).collect()] == ["b"]
    assert grams.candidates(index, "xy", ["path"]) is None and grams.narrowed(texts, index, "xy", ["path"]).count() == 4


def test_gram_index_on_disk(spark, tmp_path):
    texts = spark.createDataFrame([(f"p{k}", f"word{k} common") for k in range(50)], "path string, text string")
    grams.write(grams.build(texts, ["path"]), str(tmp_path / "grams"))
    index = spark.read.parquet(str(tmp_path / "grams"))
    assert {r["path"] for r in grams.candidates(index, "word7", ["path"]).collect()} == {"p7"}


def test_scope_and_omit(spark):
    rows = spark.createDataFrame([("/proj", "x"), ("/proj/a", "y"), ("/projector", "z"), ("", "w"), (None, "v")], "cwd string, name string")
    assert {r["name"] for r in search.scope(rows, "/proj", F.lit(True)).collect()} == {"x", "y"}
    assert search.scope_exists(rows, "/projector") and not search.scope_exists(rows, "/none")
    assert {r["name"] for r in search.omit(rows, ["Y", "PROJECTOR"], ["name", "cwd"]).collect()} == {"x", "w", "v"}
    assert search.redact(rows, {"proj": "demo"}, ["cwd"]).first()["cwd"] == "/demo"


def test_redaction_reaches_matches_and_extra(spark):
    rows = spark.createDataFrame([("joe", [("by Joe", 1.0), (None, 2.0)], ("/home/joe", None), 3), (None, None, None, None)], "name string, matches array<struct<text: string, score: double>>, extra struct<cwd: string, host: string>, n int")
    first, second = search.redact(rows, {"joe": "ann"}, ["name", "matches", "extra", "n"]).collect()
    assert (first["name"], [tuple(m) for m in first["matches"]], tuple(first["extra"]), first["n"]) == ("ann", [("by ann", 1.0), (None, 2.0)], ("/home/ann", None), 3)
    assert tuple(second) == (None, None, None, None)


def test_name_clash_is_planned_row_by_row(spark):
    rows = [("u1", "2024-01-01", "a"), ("u2", "2024-01-01", "a"), ("u3", "2024-01-01", "a-2"), ("u4", "2024-01-02", "b")]
    items = spark.createDataFrame([(*r, "claude", "conversation", "", "e") for r in rows], "uuid string, created_at string, name string, provider string, item_type string, host string, email string")
    got = {r["uuid"]: r["rel_path"].rsplit("/", 1)[1] for r in export.plan(items).collect()}
    assert got == {"u1": "2024-01-01_a.md", "u2": "2024-01-01_a-2.md", "u3": "2024-01-01_a-2-2.md", "u4": "2024-01-02_b.md"}


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("a/x.md", "1"), ("a/y.md", None), ("b/z.md", "3")], "rel_path string, body string")
    assert {r["status"]: r["n"] for r in sinks.write_documents(docs, str(tmp_path / "out")).collect()} == {"written": 2, "failed": 1}
    assert spark.read.parquet(str(tmp_path / "out")).where("dir = 'a'").count() == 1
    row = spark.createDataFrame([("claude", "u", None)], "provider string, uuid string, extra struct<host: string>")
    assert json.loads(sinks.result_json(row).first()["value"]) == {"provider": "claude", "uuid": "u"}


def test_file_names_and_paths(spark):
    names = ["data-2024-01-01.zip", "f" * 64 + "-2024-01-01-abc.zip", "other.zip", "data-x.json"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r["k"] for r in df.select(exports.export_file(F.col("n")).alias("k")).collect()] == ["claude", "chatgpt", None, None]
    paths = spark.createDataFrame([("/a/b/c", "h"), ("/a/bc", "h"), ("/a/b/../c", "h")], "path string, host string")
    assert [r["x"] for r in paths.select(search.confined(F.col("path"), "/a/b/").alias("x")).collect()] == [True, False, False]
    hosts = search.prefix_hosts(paths, [("first", "/a/b"), ("second", "/a")])
    assert [r["host"] for r in hosts.collect()] == ["first", "second", "h"]


def test_anomaly_log_grows(spark, tmp_path):
    found = spark.createDataFrame([("truncated", "p", "d")], "kind string, path string, detail string")
    for _ in range(2):
        sinks.append_anomalies(found, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_provider_strings(one):
    url = lambda p, t="conversation", h="": one(providers.url(F.col("p"), F.col("t"), F.lit("u 1"), F.lit("/w"), F.col("h")), p=p, t=t, h=h)
    assert url("claude") == "https://claude.ai/chat/u 1" and url("claude", "project") == "https://claude.ai/project/u 1"
    assert url("codex", h="box") == "[box] pushd /w && codex resume 'u 1'" and url("none") == "Unknown provider: none"
    assert one(providers.label(F.col("p")), p="none") == "none" and one(providers.label(F.col("p")), p="claude") == "claude.ai"
