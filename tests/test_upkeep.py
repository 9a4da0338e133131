"""Mirrors, refreshes, personal data and reports on small tables."""

import random

from pyspark.sql import functions as F

from palaver.operators import analytics, export, pii, turns, upkeep
from palaver.streaming import mirror

LINES = "path string, line_no long, line string"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_mirror_twice_is_once(spark, tmp_path):
    at = str(tmp_path / "archive")
    first = spark.createDataFrame([("a", 0, "{}"), ("a", 1, '{"x": 1}')], LINES)
    more = first.unionByName(spark.createDataFrame([("a", 2, "{}"), ("b", 0, "{}")], LINES))
    assert mirror.mirror_batch(first, at).count() == 2
    assert rows(mirror.mirror_batch(more, at)) == [("a", 2, "{}"), ("b", 0, "{}")]
    assert mirror.mirror_batch(more, at).count() == 0


def test_truncated_source_is_only_reported(spark):
    archive = spark.createDataFrame([("a", k, "{}") for k in range(5)], LINES)
    source = spark.createDataFrame([("a", k, '{"new": 1}') for k in range(3)], LINES)
    cut = mirror.truncated(source, archive)
    assert [r["detail"] for r in mirror.anomalies(cut).collect()] == ["archive has 5 lines, source 3"]
    assert mirror.new_lines(source, archive).count() == 0
    assert mirror.truncated(source.limit(0), archive).count() == 0


def test_stream_is_batch(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 0, "{}"), ("a", 1, ""), ("a", 2, "bad"), ("a", 3, "[1]")], LINES)
    land, out, state = (str(tmp_path / n) for n in ("land", "out", "state"))
    chunks.write.parquet(land)
    for _ in range(2):
        mirror.mirror_stream(spark.readStream.schema(LINES).parquet(land), out, state).awaitTermination()
    chunks.unionByName(spark.createDataFrame([("a", 4, "{}")], LINES)).write.mode("append").parquet(land)
    mirror.mirror_stream(spark.readStream.schema(LINES).parquet(land), out, state).awaitTermination()
    assert [(r["path"], r["line_no"]) for r in spark.read.parquet(out).orderBy("line_no").collect()] == [("a", 0), ("a", 3), ("a", 4)]


def machine(events):
    """Turn assembly as a state machine."""
    out, open_ = [], None
    for kind, value, ts in [*events, ("user", None, None)]:
        if kind == "user":
            if open_ and (open_[2] or open_[3]):
                out.append(("assistant", open_[1], "\n\n".join(open_[2]), open_[3]))
            open_ = None
            if value is not None:
                out.append(("user", ts, value, []))
            continue
        open_ = open_ or (0, ts, [], [])
        if kind == "text":
            open_[2].append(value)
        elif kind == "tool" and value not in open_[3]:
            open_[3].append(value)
    return out


def test_turns_are_the_state_machine(spark):
    rnd, data, want = random.Random(3), [], {}
    for s in range(40):
        events = [(rnd.choice(["user", "open", "text", "tool"]), rnd.choice("abc"), str(k)) for k in range(rnd.randint(0, 14))]
        want[s] = machine(events)
        data += [(s, k, 0, kind, None if kind == "open" else v, ts) for k, (kind, v, ts) in enumerate(events)]
    df = spark.createDataFrame(data, "path long, line_no long, ev_no int, kind string, value string, ts string")
    got = {s: [] for s in want}
    for t in turns.assemble(df).orderBy("path", "turn_no").collect():
        got[t["path"]].append((t["role"], t["ts"], t["content"], t["tool_uses"]))
    assert got == want


def test_split_upsert_is_one_upsert(spark):
    old = spark.createDataFrame([(k, "a", 0) for k in range(10)], "uuid long, account string, v long")
    new = spark.createDataFrame([(k, "a" if k % 2 else "b", 1) for k in range(5, 15)], old.schema)
    once = upkeep.upsert(old, new, ["uuid", "account"])
    twice = upkeep.upsert(upkeep.upsert(old, new.where("uuid < 9"), ["uuid", "account"]), new.where("uuid >= 9"), ["uuid", "account"])
    assert rows(once) == rows(twice)
    assert {r["uuid"] for r in upkeep.conflicts(old, new).collect()} == {6, 8}


def test_catalog_rereads_torn_files(spark):
    kind = "path string, size long, indexed_bytes long"
    catalog = spark.createDataFrame([("a", 10, 10), ("b", 10, 8), ("c", 1, 1)], kind)
    disk = spark.createDataFrame([("a", 10), ("b", 10), ("d", 1)], "path string, size long")
    assert dict(rows(upkeep.catalog_diff(catalog, disk))) == {"a": "same", "b": "rewritten", "c": "removed", "d": "new"}
    assert upkeep.needs_rebuild(None, 1) and not upkeep.needs_rebuild(1, 1)


SECRETS = {
    "email": ("joe@corp.io", "x@example.com"), "ipv4": ("8.8.8.8", "10.1.2.3"), "ipv6": ("2001:db8:1:2:3:4:5:6", None), "mac": ("aa:bb:cc:dd:ee:ff", None),
    "home_path": ("/home/joe", "/home/user"), "users_path": ("/Users/joe", "/Users/me"), "windows_path": ("C:\\Users\\joe", None), "url": ("https://corp.io/x", "https://github.com/x"),
    "secret_assign": ("password=hunter2hunter2", None), "aws_key": ("AKIA" + "A1B2" * 4, None), "openai_key": ("sk-" + "a1" * 12, None),
    "jwt": ("eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK", None), "timezone": ("Europe/Paris", "America/New_York"),
}


def test_each_label_found_and_vetted(spark):
    data = [(k, f"a {bad} b {good or ''} c") for k, (bad, good) in enumerate(SECRETS.values())]
    found = pii.findings(spark.createDataFrame(data, "line long, text string"))
    new = {(r["label"], r["value"]) for r in pii.novel(found).collect()}
    both = {(r["label"], r["value"]) for r in found.collect()}
    for label, (bad, good) in SECRETS.items():
        assert (label, bad) in new
        assert good is None or ((label, good) in both and (label, good) not in new)
    assert {r["label"] for r in pii.guard(found).collect()} == set(pii.HARD)


def test_masks_are_never_shared(spark):
    """Ids of three digits collide at once; each still gets a mask of its own, none of which is an id."""
    ids = [f"{k:03x}" for k in range(0, 1200, 2)] + ["call_Ab9", "call_Ab8"]
    table = {r["id"]: r["mask"] for r in pii.masks(spark.createDataFrame([(i,) for i in [*ids, ids[0], None]], "id string"), "x").collect()}
    assert set(table) == set(ids) and len(set(table.values())) == len(ids) and not set(table.values()) & set(ids)
    assert all(len(i) == len(m) for i, m in table.items()) and table["call_Ab9"].startswith("call_")


def test_logs_keep_no_id(spark):
    sid, commit = "0f1e2d3c-aaaa-bbbb-cccc-0123456789ab", "a" * 39 + "1"
    lines = [
        f'{{"type":"session_meta","payload":{{"id":"{sid}","git":{{"commit_hash":"{commit}"}}}}}}', '{"type":"event_msg","payload":{"turn_id":"7","call_id":"call_Zz9","plan_type" : "pro"}}',
        f'{{"type":"response_item","payload":{{"x":"call_Zz9 of {sid} and {commit}"}}}}', "not json", None,
    ]
    got = {r["n"]: r["text"] for r in pii.redact_logs(spark.createDataFrame(list(enumerate(lines)), "n long, text string")).collect()}
    assert all(i not in (t or "") for t in got.values() for i in (sid, commit, "call_Zz9", '"7"', "pro")) and got[3] == "not json" and got[4] is None
    masked = got[0].split('"id":"')[1][:36]
    assert masked in got[2] and got[1].count("null") == 1


def test_numbers_inside_of_hot_groups(spark):
    """A group that many ranges share is numbered without gaps, in order; null groups are groups too."""
    from palaver.operators.numbering import numbered

    rnd = random.Random(2)
    rows = [("hot" if k % 3 else None if k % 2 else f"g{k % 11}", rnd.randrange(500), k) for k in range(3000)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    df = spark.createDataFrame(rows, "g string, o int, k_ int").withColumns({"__n": F.lit(1), "__key_g": F.lit("mine")}).repartition(5)
    got = [numbered(df, ["g"], ["o", "k_"], hot=h).collect() for h in (100, 1_000_000)]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {}
    for g in {g for g, _, _ in rows}:
        for n, (_, _, k) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]), 1):
            want[k] = n
    for rows_ in got:
        assert len(rows_) == len(rows) and {r["k_"]: r["k"] for r in rows_} == want and all((r["__n"], r["__key_g"]) == (1, "mine") for r in rows_)


def test_plans_keep_the_items_own_columns(spark):
    """Columns named as internal ones pass, in names of groups as well as in paths."""
    own = ["k", "dir", "stem", "named", "family", "row_id", "again", "shared", "part_"]
    items = spark.createDataFrame([(f"u{k}", "codex", "2024-01-01T00:00:00Z", n, "conversation", "h", "") for k, n in enumerate(["a", "a", "a-2", "b"])], "uuid string, provider string, created_at string, name string, item_type string, host string, email string")
    items = items.withColumns({c: F.lit(f"own {c}") for c in own})
    for got in (export.plan(items), upkeep.unique_names(items)):
        rows = got.collect()
        assert len(rows) == 4 and all(r[c] == f"own {c}" for r in rows for c in own)


def test_names_that_clash_one_after_another(spark):
    """Random stems that are each other's numbered names, against one pass over all items."""
    rnd = random.Random(6)
    names = ["a", "a-2", "a-3", "a-2-2", "b", "b-2", "a-02"]
    rows = [(f"{k:03d}" if k % 9 else None, "codex", f"2024-01-01T00:00:{k // 3 % 60:02d}Z", rnd.choice(names), "conversation", rnd.choice(["h", "i"]), "") for k in range(120)]
    got = export.plan(spark.createDataFrame(rows, "uuid string, provider string, created_at string, name string, item_type string, host string, email string").repartition(3)).collect()
    assert len(got) == len(rows) and len({r["rel_path"] for r in got}) == len(rows)
    taken, want = {}, []
    for uuid, _, at, name, _, host, _ in sorted(rows, key=lambda r: (r[2], r[0] or "")):
        mine, stem = taken.setdefault(host, set()), f"2024-01-01_{name}"
        new, k = stem, 2
        while new in mine:
            new, k = f"{stem}-{k}", k + 1
        mine.add(new)
        want.append((uuid, host, new))
    assert sorted(((r["uuid"], r["host"], r["rel_path"].rsplit("/", 1)[1][:-3]) for r in got), key=str) == sorted(want, key=str)


def test_written_grams_are_pruned(spark, tmp_path):
    from palaver.operators import grams

    texts = spark.createDataFrame([(k, f"text number {k} of some") for k in range(50)], "path long, text string")
    grams.write(grams.build(texts, ["path"]), f"{tmp_path}/grams")
    index = spark.read.parquet(f"{tmp_path}/grams")
    found = grams.candidates(index, "number 17", ["path"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r["path"] for r in found.collect()} >= {17}


def test_entropy_and_redaction(spark):
    token, uid = "aB3xQ9zL0pWm7Tt5RkYv2NcD", "019e8f7d-51e3-7ba2-9c52-4bd9e19a14fc"
    df = spark.createDataFrame([(1, f"{token} {uid} {'a' * 30}"), (2, token)], "line long, text string")
    assert [(r["token"], r["first_line"]) for r in pii.entropy_tokens(df).collect()] == [(token, 1)]
    logs = spark.createDataFrame([(f'/home/joe/x {uid} Europe/Paris "used_percent": 12.5', uid)], "a string, b string")
    a, b = pii.redact(logs, ["a", "b"], home="/home/joe", zone="Europe/Paris").first()
    assert uid not in a + b and b in a and a.startswith("/home/user/x ") and "America/New_York" in a and '"used_percent": 0' in a


def test_empty_report(spark):
    items = spark.createDataFrame([], "provider string, host string, cwd string, created_ts timestamp")
    got = analytics.report(items)
    assert {r["section"] for r in got.collect()} == {"hour", "weekday"} and got.agg(F.sum("n")).first()[0] == 0


def test_hosts_by_many_directories(spark):
    """A table of 100,000 directories against a look through all of them, in order and by depth."""
    from palaver.operators import search

    rnd = random.Random(5)
    own = [("first", "/a/b", 0), ("root", "/", 9), ("deep", "/a/b/c/d", 5), ("twin", "/a/x/", 3), ("also", "/a/x", 3), ("late", "/a", 7)]
    sources = own + [(f"h{k}", f"/far/{k}/{k % 7}", k) for k in range(100_000)]
    paths = ["/a/b/c/d/e.jsonl", "/a/b.jsonl", "/a/bc/x", "/a/x/y", "/far/5/5/z", "/far/55/5", "/z", "z", "rel/a", "", None, "/a/../b/x"] + [f"/far/{(k := rnd.randrange(100_000))}/{rnd.randrange(7)}/f" for _ in range(50)]
    rows = spark.createDataFrame([(n, p, "stored", "own") for n, p in enumerate(paths)], "n int, path string, host string, rank string")
    table = spark.createDataFrame(sources, "host string, directory string, rank int")
    by = {}
    for h, d, r in sources:
        by.setdefault(d.rstrip("/"), []).append((r, h))

    def brute(path, longest):
        if not path or "/" not in path or "/../" in path:
            return "stored"
        steps = path.split("/")[:-1]
        held = [(-k if longest else 0, r, h) for k in range(len(steps), 0, -1) for r, h in by.get("/".join(steps[:k]), []) if k > 1 or steps[0] == ""]
        return min(held)[2] if held else "stored"

    for longest in (False, True):
        got = search.directory_hosts(rows, table, longest=longest)
        assert got.columns == rows.columns
        assert {r["n"]: r["host"] for r in got.collect()} == {n: brute(p, longest) for n, p in enumerate(paths)}


def test_rescue_reads_the_missing_files_only(spark):
    items = spark.createDataFrame([(k,) for k in "abcd"], "path string")
    stored = spark.createDataFrame([("a", ["x"]), ("b", []), ("c", None)], "path string, texts array<string>")
    everything = spark.createDataFrame([("a", ["wrong"]), ("b", ["wrong"]), ("c", ["from file"])], "path string, texts array<string>")
    for most in (10, 0):
        asked = []
        got = upkeep.rescued_from_files(items, stored, lambda p: (asked.append(p), everything)[1], most=most).collect()  # noqa: B023
        assert {r["path"]: r["texts"] for r in got} == {"a": ["x"], "b": [], "c": ["from file"], "d": None} and len(got) == 4
        assert asked == [["c", "d"]] or asked == [["d", "c"]] or (most == 0 and asked == [None])
    assert upkeep.rescued_from_files(items.where("path = 'a'"), stored, None).count() == 1
