"""Queries over sources, sinks and normalisers that read or write files made of the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import export, grams, normalize, quality, search, store, turns, upkeep
from ..operators.numbering import kept
from ..operators.store import new_folder
from ..sources import adapters, documents_sink, exports, providers, sessions, sinks
from .common import EVENT_ITEMS_SQL, event_items, read
from .registry import query
from .search_queries import _search_sql


def _s(c):
    return c.cast("string")


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _written(docs, root: str) -> str:
    """(rel_path, body) rows as files below ``root``."""
    documents_sink.write(docs, root).where("status <> 'written'").count()
    return root


def _messages(c):
    """conv_id and the conversation's messages as export records."""
    message = F.struct("turn", F.lit("m").alias("uuid"), "text", F.when(F.col("role") == "user", "human").otherwise("assistant").alias("sender"), F.lit("2024-01-02T00:00:00Z").alias("created_at"))
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("chat_messages"))


def _talk_json(conv, messages="chat_messages"):
    return F.to_json(F.struct(_text("c", _s(conv)).alias("uuid"), F.when(conv % 3 != 0, _text("Talk ", _s(conv))).otherwise("").alias("name"), F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.struct(F.lit("u").alias("uuid")).alias("account"), F.col(messages).alias("chat_messages")))


@query("""
SELECT 'c' || conv_id AS uuid, 'claude' AS provider, 'a' || (conv_id % 4) || '@b.com' AS email, 'conversation' AS item_type, CASE WHEN conv_id % 3 = 0 THEN '(untitled)' ELSE 'Talk ' || conv_id END AS name, CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'Talk ' || conv_id END AS name_raw,
  '2024-01-02T00:00:00Z' AS updated_at, CAST(CASE WHEN conv_id % 3 = 0 THEN 0 ELSE 1 END + count(*) FILTER (WHERE text <> '') AS INT) AS n_texts FROM conversations GROUP BY conv_id
UNION ALL SELECT 'p' || conv_id, 'claude', 'a' || (conv_id % 4) || '@b.com', 'project', 'P' || conv_id, 'P' || conv_id, '2024-01-01T00:00:00Z', 1 + CAST(count(*) FILTER (WHERE text <> '') AS INT) + CAST(count(*) AS INT) FROM conversations WHERE conv_id % 5 = 0 GROUP BY conv_id
""")
def archive_scan(spark, sf_dir):
    """An archive tree of conversations and projects, scanned; provider, account and type come from the paths."""
    c = read(spark, sf_dir, "conversations")
    conv = F.col("conv_id")
    talks = _messages(c).select(F.format_string("claude/a%d@b.com/conversations/%d.json", conv % 4, conv).alias("rel_path"), _talk_json(conv).alias("body"))
    doc = F.struct("turn", _text("d", _s(F.col("turn"))).alias("filename"), F.col("text").alias("content"))
    books = c.where("conv_id % 5 = 0").groupBy("conv_id").agg(F.array_sort(F.collect_list(doc)).alias("docs"))
    book = F.to_json(F.struct(_text("p", _s(conv)).alias("uuid"), _text("P", _s(conv)).alias("name"), F.lit("2024-01-01T00:00:00Z").alias("created_at"), "docs"))
    books = books.select(F.format_string("claude/a%d@b.com/projects/%d.json", conv % 4, conv).alias("rel_path"), book.alias("body"))
    root = _written(talks.unionByName(books), new_folder(spark, "archive"))
    items = normalize.archive_items(exports.archive(spark, root).where("parsed IS NOT NULL"))
    return items.select("uuid", "provider", "email", "item_type", "name", "name_raw", "updated_at", F.size("texts").alias("n_texts"))


@query("SELECT 'c' || conv_id AS uuid, 'conversation' AS kind FROM conversations GROUP BY conv_id UNION ALL SELECT DISTINCT 'p' || conv_id, 'project' FROM conversations WHERE conv_id % 5 = 0 UNION ALL SELECT DISTINCT 'u' || (conv_id % 10), 'user' FROM conversations")
def export_batch(spark, sf_dir):
    """Batches of conversation lists, user lists, and projects both as lists and as one file each."""
    c = read(spark, sf_dir, "conversations")
    conv, batch = F.col("conv_id"), F.expr("conv_id div 10")
    listed = lambda rows, body: rows.groupBy(batch.alias("b")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(body), ","), F.lit("]")).alias("body"))  # noqa: E731  ten conversations each
    book = F.to_json(F.struct(_text("p", _s(conv)).alias("uuid"), F.lit("P").alias("name")))
    one = c.select("conv_id").distinct().withColumn("chat_messages", F.array().cast("array<string>"))
    books = one.where("conv_id % 5 = 0")
    files = [
        listed(one, _talk_json(conv)).select(F.format_string("b%d/conversations.json", "b").alias("rel_path"), "body"),
        listed(one, F.to_json(F.struct(_text("u", _s(conv % 10)).alias("uuid"), F.lit("x@y.z").alias("email_address")))).select(F.format_string("b%d/users.json", "b").alias("rel_path"), "body"),
        listed(books.where("conv_id % 2 = 0"), book).select(F.format_string("b%d/projects.json", "b").alias("rel_path"), "body"),
        books.where("conv_id % 2 <> 0").select(F.format_string("b%d/projects/%d.json", batch, conv).alias("rel_path"), book.alias("body")),
    ]
    got = exports.batch(spark, _written(reduce(lambda a, b: a.unionByName(b), files), new_folder(spark, "batch")))
    kinds = {"conversations": "conversation", "projects": "project", "users": "user"}
    return reduce(lambda a, b: a.unionByName(b), [got[t].select("item.uuid", F.lit(k).alias("kind")) if t != "users" else got[t].select("item.uuid", F.lit(k).alias("kind")).distinct() for t, k in kinds.items()])


@query("""
WITH r AS (SELECT DISTINCT conv_id FROM conversations)
SELECT 'a' || (conv_id % 2) AS provider, count(*) FILTER (WHERE conv_id % 4 = 0) AS no_uuid, count(*) FILTER (WHERE conv_id % 5 = 0) AS no_name, count(*) FILTER (WHERE conv_id % 7 = 0) AS no_creator, count(*) FILTER (WHERE conv_id % 3 = 0) AS no_filename FROM r GROUP BY 1
""")
def project_contract(spark, sf_dir):
    """Projects' required fields and documents, every record checked."""
    conv = F.col("conv_id")
    rows = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    doc = F.struct(F.when(conv % 3 != 0, "f").alias("filename"), F.lit("c").alias("content"))
    raw = F.to_json(F.struct(F.when(conv % 4 != 0, "x").alias("uuid"), F.when(conv % 5 != 0, "n").alias("name"), F.lit("t").alias("created_at"), F.when(conv % 7 != 0, F.struct(F.lit("u").alias("uuid"))).alias("creator"), F.array(doc).alias("docs")))
    records = rows.select(_s(conv).alias("path"), F.lit(0).alias("pos"), raw.alias("raw"), F.from_json(raw, exports.PROJECT).alias("item"))
    found = quality.project_structure(records).withColumn("provider", _text("a", _s(F.col("path").cast("long") % 2)))
    n = lambda error, name: F.count(F.when(F.col("error") == error, 1)).alias(name)
    errors = found.groupBy("provider").agg(n("missing: uuid", "no_uuid"), n("missing: name", "no_name"), n("missing: creator", "no_creator"), n("missing: filename", "no_filename"))
    none = rows.select(_text("a", _s(conv % 2)).alias("provider")).distinct()
    return none.join(errors, "provider", "left").fillna(0)


@query("""
SELECT 'p' || conv_id AS uuid, lower('P' || conv_id || chr(10) || 'about' || coalesce(chr(10) || string_agg('d' || turn || CASE WHEN text <> '' THEN chr(10) || text ELSE '' END, chr(10) ORDER BY turn), '')) AS texts,
  '# P' || conv_id || chr(10) || chr(10) || '**UUID:** `p' || conv_id || '`  ' || chr(10) || '**Created:** 2024-01-01 00:00:00  ' || chr(10) || '**Updated:**   ' || chr(10) || '**Description:** about  ' || chr(10) || chr(10) || '---' || chr(10)
  || string_agg(chr(10) || chr(10) || '## 📄 d' || turn || chr(10) || CASE WHEN text <> '' THEN chr(10) || chr(10) || text || chr(10) ELSE '' END || chr(10) || chr(10) || '---' || chr(10), '' ORDER BY turn) AS body
FROM conversations GROUP BY conv_id
""")
def project_documents(spark, sf_dir):
    """Projects' texts and Markdown documents."""
    c, conv = read(spark, sf_dir, "conversations"), F.col("conv_id")
    doc = F.struct("turn", _text("d", _s(F.col("turn"))).alias("filename"), F.col("text").alias("content"))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(doc)).alias("docs"))
    raw = F.to_json(F.struct(_text("p", _s(conv)).alias("uuid"), _text("P", _s(conv)).alias("name"), F.lit("about").alias("description"), F.lit("2024-01-01T00:00:00Z").alias("created_at"), "docs"))
    item = rows.select(F.from_json(raw, exports.PROJECT).alias("item"))
    return item.select("item.uuid", normalize.searchable_body(normalize.project_texts(F.col("item"))).alias("texts"), export.project_markdown(F.col("item")).alias("body"))


@query("""
WITH r AS (SELECT DISTINCT conv_id FROM conversations)
SELECT CASE WHEN conv_id % 4 = 0 THEN NULL ELSE 't' || conv_id END AS uuid, CASE WHEN conv_id % 4 = 0 THEN 'missing id' WHEN conv_id % 15 = 0 THEN 'missing create_time and update_time' END AS reason,
  CASE WHEN conv_id % 4 = 0 OR conv_id % 15 = 0 THEN NULL ELSE strftime(TIMESTAMP '1970-01-01' + to_seconds(CASE WHEN conv_id % 5 = 0 THEN 5000 ELSE 1000 END + conv_id), '%Y-%m-%dT%H:%M:%SZ') END AS created_at,
  CASE WHEN conv_id % 4 = 0 OR conv_id % 15 = 0 THEN NULL WHEN conv_id % 7 = 0 THEN '' ELSE 'T' || conv_id END AS name
FROM (SELECT conv_id FROM r)
""")
def thread_items(spark, sf_dir):
    """Threads normalised: ids, names and times; what can't be used is given with its reason."""
    conv = F.col("conv_id")
    rows = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    at = lambda c: c.cast("double")
    raw = F.to_json(F.struct(F.when(conv % 4 != 0, _text("t", _s(conv))).alias("id"), F.when(conv % 7 != 0, _text("T", _s(conv))).alias("title"), F.when(conv % 5 != 0, at(conv + 1000)).alias("create_time"), F.when(conv % 3 != 0, at(conv + 5000)).alias("update_time")))
    threads = rows.select(_s(conv).alias("path"), F.lit(0).alias("pos"), raw.alias("raw"), F.from_json(raw, exports.THREAD).alias("item"))
    items, errors = normalize.normalized_threads(threads)
    uuid = F.when(F.col("path").cast("long") % 4 != 0, _text("t", F.col("path")))
    none = F.lit(None).cast("string")
    return items.select("uuid", none.alias("reason"), "created_at", "name").unionByName(errors.select(uuid.alias("uuid"), "reason", none.alias("created_at"), none.alias("name")))


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '/cmd' || turn || ' ' || t WHEN 1 THEN '/cmd' || turn END AS command FROM (SELECT conv_id, turn, trim(replace(text, chr(10), ' ')) AS t FROM conversations) WHERE turn % 3 <> 0 OR t <> ''")
def typed_commands(spark, sf_dir):
    """Slash commands rebuilt from tags in any order, with and without arguments, and lines without the name."""
    c = read(spark, sf_dir, "conversations").withColumn("t", F.trim(F.translate("text", "\n", " "))).where("turn % 3 <> 0 OR t <> ''")
    name = _text("<command-name>/cmd", _s(F.col("turn")), "</command-name>")
    args = _text("<command-args> ", F.col("t"), " </command-args>")
    line = F.when(F.col("turn") % 3 == 0, F.when(F.col("conv_id") % 2 == 0, _text(args, "\n", name)).otherwise(_text(name, " ", args))).when(F.col("turn") % 3 == 1, name).otherwise(args)
    return c.select("conv_id", "turn", normalize.command_of(line).alias("command"))


@query("""
SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN NULL WHEN turn % 4 = 1 THEN '1 file: ' || role || '.txt' WHEN turn % 4 = 2 THEN '2 files: a.txt, ' || role || '.txt' ELSE '3 files' END AS summary FROM conversations
""")
def attachment_lines(spark, sf_dir):
    c, kind = read(spark, sf_dir, "conversations"), F.col("turn") % 4
    file = lambda name: F.struct(name.alias("file_name"))
    own, none = file(_text(F.col("role"), ".txt")), file(F.lit(None).cast("string"))
    files = F.when(kind == 1, F.array(own)).when(kind == 2, F.array(own, file(F.lit("a.txt")))).when(kind == 3, F.array(none, none, file(F.lit(""))))
    attachments = F.when(kind == 1, F.array(own)).when(kind == 2, F.array(file(F.lit("a.txt"))))
    return c.select("conv_id", "turn", export.attachment_summary(attachments, files).alias("summary"))


def _rollouts(spark, sf_dir):
    """rel_path and body of a rollout for each conversation."""
    c, conv, turn = read(spark, sf_dir, "conversations"), F.col("conv_id"), F.col("turn")
    at = _text("2024-01-01T00:00:0", _s(turn), "Z").alias("timestamp")
    meta = F.to_json(F.struct(at, F.lit("session_meta").alias("type"), F.struct(_text("r", _s(conv)).alias("id"), F.lit("/w").alias("cwd")).alias("payload")))
    said = F.to_json(F.struct(at, F.lit("event_msg").alias("type"), F.struct(F.when(F.col("role") == "user", "user_message").otherwise("agent_message").alias("type"), F.col("text").alias("message")).alias("payload")))
    tool = F.to_json(F.struct(at, F.lit("response_item").alias("type"), F.struct(F.lit("function_call").alias("type"), _text("tool", _s(turn % 2)).alias("name")).alias("payload")))
    lines = F.when(turn == 0, _text(meta, "\n")).otherwise("")
    line = F.concat(lines, F.when(F.col("role") == "system", tool).otherwise(said), F.lit("\n"))
    rows = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "").alias("body"))
    return rows.select(F.format_string("h%d/2024/rollout-%d.jsonl", conv % 2, conv).alias("rel_path"), "body")


@query("""
SELECT 'r' || conv_id AS uuid, 'host' || (conv_id % 2) AS host, 'codex' AS source, '/w' AS cwd, '2024-01-01T00:00:0' || min(turn) || 'Z' AS created_at, '2024-01-01T00:00:0' || max(turn) || 'Z' AS updated_at,
  CAST(count(*) FILTER (WHERE role <> 'system' AND trim(text) <> '') AS INT) AS n_texts FROM conversations GROUP BY conv_id HAVING min(turn) = 0
""")
def rollout_items(spark, sf_dir):
    """Rollouts of two hosts, named in one list, read, taken apart and put together as items."""
    root = _written(_rollouts(spark, sf_dir), new_folder(spark, "rollouts"))
    adapter = adapters.LOGS["codex"]
    good, _ = adapter.read(spark, sessions.parse_sources(f" host0={root}/h0 , host1={root}/h1"))
    return adapter.items(good).where("uuid IS NOT NULL").select("uuid", "host", "source", "cwd", "created_at", "updated_at", F.size("texts").alias("n_texts"))


@query("""
SELECT CASE WHEN conv_id % 2 = 0 THEN 'claude-code' ELSE 'claude-code-tools-only' END AS source, role AS tool, count(*) AS n, CASE WHEN conv_id % 2 = 0 THEN count(DISTINCT conv_id) ELSE 0 END AS searchable FROM conversations GROUP BY conv_id % 2, role
""")
def tools_only(spark, sf_dir):
    """Logs deeper than a project's folder count for tools and are never items."""
    c, conv = read(spark, sf_dir, "conversations"), F.col("conv_id")
    block = F.struct(F.lit("tool_use").alias("type"), F.col("role").alias("name"))
    line = F.to_json(F.struct(F.lit("assistant").alias("type"), _text("s", _s(conv)).alias("sessionId"), F.struct(F.array(block).alias("content")).alias("message")))
    rows = c.groupBy("conv_id").agg(F.array_join(F.collect_list(_text(line, "\n")), "").alias("body"))
    rel_path = F.when(conv % 2 == 0, F.format_string("p/%d.jsonl", conv)).otherwise(F.format_string("p/sub/%d.jsonl", conv))
    root = _written(rows.select(rel_path.alias("rel_path"), "body"), new_folder(spark, "sessions"))
    adapter = adapters.LOGS["claude-code"]
    good, _ = adapter.read(spark, [("here", root)])
    good = kept(good.select("path", "source", "host", "email", "line_no", "v"))
    files = good.select("path", "source").distinct()
    counts = turns.tool_counts(adapter.events(good)).join(files, "path")
    items = adapter.items(good).select("path").distinct().withColumn("item", F.col("path"))
    joined = counts.join(items, "path", "left")
    return joined.groupBy("source", "tool").agg(F.sum("n").alias("n"), F.count_distinct("item").alias("searchable"))


@query("""
SELECT DISTINCT source, CASE WHEN source = 'src1' THEN 'claude' WHEN source = 'src2' THEN 'chatgpt' END AS provider, name FROM (
  SELECT source, CASE source WHEN 'src1' THEN 'data-2024-' || (doc_id % 50) || '.zip' WHEN 'src2' THEN sha256(CAST(doc_id % 50 AS VARCHAR)) || '-2024-01-02-x.zip' WHEN 'src3' THEN 'data-x.tar' ELSE upper(sha256(CAST(doc_id % 50 AS VARCHAR))) || '-2024-01-02-x.zip' END AS name FROM documents WHERE source IS NOT NULL)
""")
def export_files(spark, sf_dir):
    """Which export a file name belongs to."""
    d, digest = read(spark, sf_dir, "documents").where("source IS NOT NULL"), F.sha2(_s(F.col("doc_id") % 50).cast("binary"), 256)
    name = F.when(F.col("source") == "src1", _text("data-2024-", _s(F.col("doc_id") % 50), ".zip")).when(F.col("source") == "src2", _text(digest, "-2024-01-02-x.zip")).when(F.col("source") == "src3", "data-x.tar").otherwise(_text(F.upper(digest), "-2024-01-02-x.zip"))
    return d.select("source", name.alias("name")).distinct().withColumn("provider", exports.export_file(F.col("name")))


@query(f"""WITH i AS ({EVENT_ITEMS_SQL}) SELECT '{{"provider":"' || provider || '","uuid":"' || event_id || '","total_score":' || (event_id % 7) || '.5,"n_matches":' || (event_id % 3) || CASE WHEN provider IN ('claude-code', 'codex') THEN ',"extra":{{"cwd":"' || cwd || '","host":"' || host || '"}}' ELSE '' END || '}}' AS value FROM i""")
def result_lines(spark, sf_dir):
    """Results as JSON objects; ``extra`` only for local sessions."""
    e = event_items(spark, sf_dir)
    extra = F.when(providers.is_local_cli(F.col("provider")), F.struct("cwd", "host"))
    rows = e.select("provider", _s(F.col("event_id")).alias("uuid"), (F.col("event_id") % 7 + F.lit(0.5)).cast("double").alias("total_score"), (F.col("event_id") % 3).alias("n_matches"), extra.alias("extra"))
    return sinks.result_json(rows)


@query("SELECT 'truncated' AS kind, 's' || conv_id AS path, 'archive has ' || (count(*) + 2) || ' lines, source ' || count(*) AS detail, 2 AS n FROM conversations WHERE conv_id % 3 = 0 GROUP BY conv_id")
def anomaly_log(spark, sf_dir):
    """Reports appended twice to a log: nothing is overwritten."""
    from ..streaming import mirror

    c = read(spark, sf_dir, "conversations").where("conv_id % 3 = 0").groupBy("conv_id").agg(F.count("*").alias("present"))
    cut = c.select(_text("s", _s(F.col("conv_id"))).alias("path"), (F.col("present") + 2).alias("archived"), "present")
    root = new_folder(spark, "anomalies")
    for _ in range(2):
        sinks.append_anomalies(mirror.anomalies(cut), root)
    return spark.read.parquet(root).groupBy("kind", "path", "detail").agg(F.count("ts").cast("int").alias("n"))


@query("SELECT d.lang, d.lang || '/x' AS place, bool_or(starts_with(p.path, d.lang || '/x/')) AS known FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) AS d, (SELECT lang || '/' || CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE 'xy' END || '/' || doc_id AS path FROM documents WHERE lang <> 'fr' OR doc_id % 2 <> 0) AS p GROUP BY d.lang")
def scope_known(spark, sf_dir):
    """Does any known directory lie under a path? Asked for each language's folder."""
    d = read(spark, sf_dir, "documents")
    cwd = F.concat_ws("/", "lang", F.when(F.col("doc_id") % 2 == 0, "x").otherwise("xy"), _s(F.col("doc_id")))
    known = d.where("lang <> 'fr' OR doc_id % 2 <> 0").select(cwd.alias("cwd"))
    langs = [r["lang"] for r in d.where("lang IS NOT NULL").select("lang").distinct().collect()]  # a handful
    return spark.createDataFrame([(x, f"{x}/x", search.scope_exists(known, f"{x}/x")) for x in langs], "lang string, place string, known boolean")


@query(_search_sql("documents", "doc_id", "of"))
def search_short(spark, sf_dir):
    """A word too short for a trigram: all texts are candidates."""
    texts = read(spark, sf_dir, "documents").select("doc_id", "text")
    near = grams.narrowed(texts, grams.build(texts.limit(0), ["doc_id"]), "of", ["doc_id"])
    return search.score_texts(near, "of", ["doc_id"]).select("doc_id", F.col("text_score").alias("total_score"), "n_matches")


@query("""
SELECT conv_id, updated_at, CAST(row_number() OVER (ORDER BY updated_at DESC, conv_id) AS INT) AS rank FROM (
  SELECT conv_id, '2024-01-0' || (1 + max(turn) % 9) || 'T00:00:00Z' AS updated_at FROM conversations GROUP BY conv_id) QUALIFY rank <= 60
""")
def browse_by_update(spark, sf_dir):
    """Browsing goes by the raw time of the last update, then by path: the first 60."""
    from pyspark.sql import Window

    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(_text("2024-01-0", _s(1 + F.max("turn") % 9), "T00:00:00Z").alias("updated_at")).withColumn("has_preview", F.lit(True))
    keys = search.ranked(c, "updated", path="conv_id")
    first = search.top(search.browse(c), keys, 60)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*keys))).select("conv_id", "updated_at", "rank")  # 60 rows


@query("SELECT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE text IS NOT NULL")
def index_rebuilt(spark, sf_dir):
    """Unchanged files, another version of the extractor: all are read again, and the index finds what it adds."""
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL").select(_s(F.col("doc_id")).alias("path"), "text")
    d = d.withColumns({"size": F.octet_length("text").cast("long"), "content_hash": F.xxhash64("text")})

    def extract(tail):
        def of(files):
            at, c = F.lit("2024-01-01T00:00:00Z"), F.col
            return files.select(*normalize.item_row(c("path"), F.lit("llm"), c("path"), F.lit("conversation"), F.lit("claude"), c("path"), at, at, F.lit(""), F.array(F.concat("text", F.lit(tail)))))

        return of

    root = new_folder(spark, "index")
    store.refresh(spark, root, d, extract(""), version=1, buckets=8)
    store.refresh(spark, root, d, extract(" qzxj"), version=2)
    return store.search_index(spark, root, "qzxj").select("path")


@query("SELECT conv_id, turn, replace(replace(text, 'th', 'TH!'), 'Th', 'TH!') AS shown, 'x' || (conv_id % 5) AS host FROM (SELECT conv_id, turn, text FROM conversations WHERE text NOT LIKE '%TH%' AND text NOT LIKE '%tH%')")
def redacted_results(spark, sf_dir):
    """Stand-ins inside of matches and of ``extra``."""
    c = read(spark, sf_dir, "conversations").where("text NOT LIKE '%TH%' AND text NOT LIKE '%tH%'")
    rows = c.select("conv_id", "turn", F.array(F.struct("text", F.lit(1.0).alias("score"))).alias("matches"), F.struct(_text("real", _s(F.col("conv_id") % 5)).alias("host")).alias("extra"))
    pairs = {"th": "TH!", **{f"real{k}": f"x{k}" for k in range(5)}}
    out = search.redact(rows, pairs, ["matches", "extra"])
    return out.select("conv_id", "turn", F.get("matches", F.lit(0))["text"].alias("shown"), "extra.host")


@query("SELECT source AS uuid, lang AS path, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE source IS NOT NULL")
def dup_rows(spark, sf_dir):
    """Rows of ids that repeat, one row for each, however many an id has."""
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("uuid"), F.col("lang").alias("path"))
    return upkeep.duplicate_rows(d, "uuid").select("uuid", "path", "n")
