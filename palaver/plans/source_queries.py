"""Exports and session logs made of the conversations table, then read by the source operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import export, normalize, quality, turns
from ..sources import exports, sessions
from .common import read
from .registry import query


def _time(turn):
    return F.concat(F.lit("2024-01-01T00:"), F.lpad((turn % 60).cast("string"), 2, "0"), F.lit(":00Z"))


_TIME = "'2024-01-01T00:' || lpad(CAST(turn % 60 AS VARCHAR), 2, '0') || ':00Z'"


def _talks(spark, sf_dir):
    """conv_id, raw, item: each conversation as an export record."""
    c = read(spark, sf_dir, "conversations")
    message = F.struct(
        "turn", F.concat(F.lit("m"), "turn").alias("uuid"), "text", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content"),
        F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "assistant").otherwise("robot").alias("sender"), _time(F.col("turn")).alias("created_at"),
    )
    talks = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("chat_messages"))
    raw = F.to_json(F.struct(
        F.when(F.col("conv_id") % 4 != 0, F.concat(F.lit("c"), "conv_id")).alias("uuid"), F.concat(F.lit("Talk "), "conv_id").alias("name"), F.lit("").alias("summary"), F.lit("2024-01-01T00:00:00Z").alias("created_at"),
        F.struct(F.when(F.col("conv_id") % 3 != 0, "u").alias("uuid")).alias("account"), "chat_messages",
    ))
    rows = talks.select("conv_id", F.col("conv_id").cast("string").alias("path"), F.lit(0).alias("pos"), raw.alias("raw"))
    return rows.withColumn("item", F.from_json("raw", exports.CONVERSATION))


@query(f"""
SELECT conv_id, CAST(1 + 2 * count(*) FILTER (WHERE text <> '') AS INT) AS n_texts, lower('Talk ' || conv_id || chr(10) || string_agg(text || chr(10) || text, chr(10) ORDER BY turn) FILTER (WHERE text <> '')) AS body, arg_max({_TIME}, turn) AS updated_at
FROM conversations GROUP BY conv_id
""")
def export_texts(spark, sf_dir):
    texts = normalize.conversation_texts(F.col("item"))
    return _talks(spark, sf_dir).select("conv_id", F.size(texts).alias("n_texts"), normalize.searchable_body(texts).alias("body"), normalize.updated_at(F.col("item")).alias("updated_at"))


@query("""
SELECT error, count(*) AS n FROM (
  SELECT 'missing: uuid' AS error FROM conversations WHERE conv_id % 4 = 0 GROUP BY conv_id
  UNION ALL SELECT 'missing: account.uuid' FROM conversations WHERE conv_id % 3 = 0 GROUP BY conv_id
  UNION ALL SELECT 'bad sender' FROM conversations WHERE role = 'system') GROUP BY error
""")
def export_structure(spark, sf_dir):
    return quality.summary(quality.conversation_structure(_talks(spark, sf_dir)))


@query(f"""
SELECT conv_id, '# Talk ' || conv_id || chr(10) || chr(10) || '**UUID:** `' || CASE WHEN conv_id % 4 = 0 THEN 'unknown' ELSE 'c' || conv_id END || '`  ' || chr(10)
  || '**Created:** 2024-01-01 00:00:00  ' || chr(10) || '**Updated:**   ' || chr(10) || chr(10) || '---' || chr(10)
  || string_agg(chr(10) || chr(10) || '## ' || CASE role WHEN 'user' THEN '**User**' ELSE '**Assistant**' END || chr(10) || chr(10) || '*' || replace(replace({_TIME}, 'T', ' '), 'Z', '') || '*' || chr(10)
  || CASE WHEN text <> '' THEN chr(10) || chr(10) || text || chr(10) ELSE '' END || chr(10) || chr(10) || '---' || chr(10), '' ORDER BY turn) AS body
FROM conversations GROUP BY conv_id
""")
def export_markdown(spark, sf_dir):
    return _talks(spark, sf_dir).select("conv_id", export.conversation_markdown(F.col("item")).alias("body"))


@query("""
WITH m AS (SELECT conv_id, turn, text, role, 'gpt-' || (turn % 3) AS slug FROM conversations),
s AS (SELECT conv_id, slug, row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, min(turn)) AS k FROM m GROUP BY conv_id, slug)
SELECT conv_id, array_to_string(list_concat([CAST('T' || conv_id AS VARCHAR)], coalesce(list(text ORDER BY turn) FILTER (WHERE role <> 'system' AND text <> ''), [])), chr(10)) AS body,
  any_value(CASE WHEN k = 1 THEN replace(s.slug, 'gpt-', 'GPT-') END) AS model FROM m JOIN s USING (conv_id) WHERE k = 1 GROUP BY conv_id
""")
def thread_texts(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    content = F.struct(F.when(F.col("role") == "system", "code").otherwise("text").alias("content_type"), F.array("text").alias("parts"))
    node = F.struct("turn", F.concat(F.lit("n"), "turn").alias("id"), F.struct(content.alias("content"), F.struct(F.concat(F.lit("gpt-"), F.col("turn") % 3).alias("model_slug")).alias("metadata")).alias("message"))
    nodes = F.array_sort(F.collect_list(node))
    rows = c.groupBy("conv_id").agg(nodes.alias("nodes"))
    mapping = F.map_from_arrays(F.transform("nodes", lambda n: n["id"]), F.transform("nodes", lambda n: n))
    raw = F.to_json(F.struct(F.concat(F.lit("t"), "conv_id").alias("id"), F.concat(F.lit("T"), "conv_id").alias("title"), F.lit(1.5).alias("create_time"), mapping.alias("mapping")))
    item = rows.select("conv_id", F.from_json(raw, exports.THREAD).alias("item"))
    return item.select("conv_id", F.array_join(normalize.thread_texts(F.col("item")), "\n").alias("body"), T.prettify_model(normalize.thread_model(F.col("item"))).alias("model"))


@query("""
SELECT conv_id, array_to_string(list_concat([CAST('T' || conv_id AS VARCHAR)], coalesce(list(text ORDER BY turn) FILTER (WHERE text <> ''), [])), chr(10)) AS body
FROM conversations GROUP BY conv_id
""")
def thread_batch_order(spark, sf_dir):
    """A batch file for each conversation, whose mapping's keys stand against their order as strings."""
    c = read(spark, sf_dir, "conversations")
    content = F.struct(F.lit("text").alias("content_type"), F.array("text").alias("parts"))
    node = F.to_json(F.struct(F.struct(content.alias("content")).alias("message")))
    entry = F.concat(F.lit('"'), F.lpad((F.lit(99_999) - F.col("turn")).cast("string"), 5, "0"), F.lit('": '), node)
    nodes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", entry.alias("e")))), lambda n: n["e"]), ", ")
    files = c.groupBy("conv_id").agg(nodes.alias("nodes"))
    value = F.concat(F.lit(' [{"title": "T'), F.col("conv_id").cast("string"), F.lit('", "id": "t", "create_time": 1.0, "mapping": {'), "nodes", F.lit("}}]"))
    files = files.select(F.col("conv_id").alias("path"), value.alias("value")).withColumn("parsed", F.try_parse_json("value"))
    found = exports.records(files, exports.THREAD)
    return found.select(F.col("path").alias("conv_id"), F.array_join(normalize.thread_texts(F.col("item")), "\n").alias("body"))


def _lines(spark, sf_dir):
    """Session log lines: path, line_no, line."""
    c = read(spark, sf_dir, "conversations")
    at, sid, cwd = _time(F.col("turn")).alias("timestamp"), F.concat(F.lit("s"), "conv_id").alias("sessionId"), F.lit("/w").alias("cwd")
    user = F.to_json(F.struct(F.lit("user").alias("type"), at, sid, cwd, F.struct(F.lit("user").alias("role"), F.col("text").alias("content")).alias("message")))
    blocks = F.concat(F.lit('[{"type":"thinking","thinking":"hm"},'), F.to_json(F.struct(F.lit("text").alias("type"), "text")), F.lit(","), F.to_json(F.struct(F.lit("tool_use").alias("type"), F.substring_index("text", " ", 1).alias("name"))), F.lit("]"))
    answer = F.concat(F.lit('{"type":"assistant","timestamp":"'), _time(F.col("turn")), F.lit('","message":{"model":"m'), (F.col("turn") % 3).cast("string"), F.lit('","content":'), blocks, F.lit("}}"))
    system = F.to_json(F.struct(F.lit("system").alias("type"), at, F.col("text").alias("content")))
    line = F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", answer).otherwise(system)
    return c.select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("line_no"), line.alias("line"))


_LOG_TURNS = """
WITH e AS (SELECT conv_id, turn, role, text, split_part(text, ' ', 1) AS tool FROM conversations WHERE role <> 'system'),
w AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM e),
g AS (SELECT conv_id, island, role = 'user' AS u, min(turn) AS turn, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS content, CAST(CASE WHEN role = 'user' THEN 0 ELSE count(DISTINCT tool) END AS INT) AS n_tools FROM w GROUP BY conv_id, island, role)
"""


@query(f"{_LOG_TURNS} SELECT CAST(conv_id AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY island, u DESC) AS INT) AS turn_no, CASE WHEN u THEN 'user' ELSE 'assistant' END AS role, {_TIME} AS ts, content, n_tools FROM g")
def session_turns(spark, sf_dir):
    good, _ = sessions.parsed_lines(_lines(spark, sf_dir))
    return turns.assemble(normalize.session_events(good)).withColumn("n_tools", F.size("tool_uses")).drop("tool_uses")


@query(f"""
WITH u AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS first, arg_min({_TIME}, turn) FILTER (WHERE role = 'user') AS created_at, arg_max({_TIME}, turn) AS updated_at, count(*) FILTER (WHERE role = 'user') AS n FROM conversations GROUP BY conv_id),
n AS (SELECT *, trim(regexp_replace(split_part(trim(first, E' \\n\\t'), chr(10), 1), '\\s+', ' ', 'g')) AS line FROM u)
SELECT CAST(conv_id AS VARCHAR) AS path, CASE WHEN n > 0 THEN 's' || conv_id END AS session_id, CASE WHEN n > 0 THEN '/w' END AS cwd, created_at, updated_at,
  CASE WHEN n = 0 THEN '(untitled)' WHEN length(line) > 80 THEN substr(line, 1, 80) || '…' ELSE line END AS name FROM n
""")
def session_metadata(spark, sf_dir):
    good, _ = sessions.parsed_lines(_lines(spark, sf_dir))
    return normalize.session_metadata(good).drop("git_branch")


_BRANCH = f"""
WITH l AS (SELECT *, {_TIME} AS said_at, CASE WHEN turn >= conv_id % 3 THEN 'b' || turn END AS branch, CASE WHEN turn >= 1 AND conv_id % 5 <> 0 THEN '/w' || turn END AS cwd,
  CASE WHEN turn % 4 = 0 THEN ' ' ELSE text END AS said FROM conversations),
g AS (SELECT conv_id, min(turn) AS sid_line, min(turn) FILTER (WHERE cwd IS NOT NULL) AS cwd_line, min(turn) FILTER (WHERE branch IS NOT NULL) AS branch_line,
  arg_min(cwd, turn) FILTER (WHERE cwd IS NOT NULL) AS cwd, arg_min(branch, turn) FILTER (WHERE branch IS NOT NULL) AS branch,
  arg_min(said_at, turn) FILTER (WHERE role = 'user' AND trim(said, E' \\n\\t') <> '') AS created_at FROM l GROUP BY conv_id)
"""


@query(f"""{_BRANCH}
SELECT CAST(conv_id AS VARCHAR) AS path, 's' || conv_id AS session_id, cwd, CASE WHEN cwd_line IS NULL OR branch_line <= greatest(sid_line, cwd_line) THEN branch END AS git_branch,
  created_at FROM g""")
def session_branches(spark, sf_dir):
    """Branch, directory and creation where they stand in different lines, some prompts being blank."""
    c = read(spark, sf_dir, "conversations")
    turn, conv = F.col("turn"), F.col("conv_id")
    said = F.when(turn % 4 == 0, " ").otherwise(F.col("text"))
    fields = [F.col("role").alias("type"), _time(turn).alias("timestamp"), F.concat(F.lit("s"), conv).alias("sessionId"), F.when((turn >= 1) & (conv % 5 != 0), F.concat(F.lit("/w"), turn)).alias("cwd"), F.when(turn >= conv % 3, F.concat(F.lit("b"), turn)).alias("gitBranch")]
    line = F.to_json(F.struct(*fields, F.struct(said.alias("content")).alias("message")))
    good, _ = sessions.parsed_lines(c.select(conv.cast("string").alias("path"), turn.alias("line_no"), line.alias("line")))
    return normalize.session_metadata(good).select("path", "session_id", "cwd", "git_branch", "created_at")


@query("""
WITH c AS (SELECT conv_id, 'm' || (turn % 3) AS model, count(*) AS n, min(turn) AS f FROM conversations WHERE role = 'user' GROUP BY ALL)
SELECT CAST(conv_id AS VARCHAR) AS path, model FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, f) = 1
""")
def rollout_models(spark, sf_dir):
    """Only records that open a turn (here: the user's) count, though all name a model."""
    kind = F.when(F.col("role") == "user", "turn_context").otherwise("event_msg")
    line = F.to_json(F.struct(kind.alias("type"), F.struct(F.concat(F.lit("m"), F.col("turn") % 3).alias("model")).alias("payload")))
    good, _ = sessions.parsed_lines(read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("line_no"), line.alias("line")))
    return normalize.rollout_models(good)


@query("""
WITH c AS (SELECT conv_id, 'm' || (turn % 3) AS model, count(*) AS n, min(turn) AS f FROM conversations WHERE role = 'assistant' GROUP BY ALL)
SELECT CAST(conv_id AS VARCHAR) AS path, model FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, f) = 1
""")
def session_models(spark, sf_dir):
    good, _ = sessions.parsed_lines(_lines(spark, sf_dir))
    return normalize.session_models(good)


@query("""
SELECT CAST(conv_id AS VARCHAR) AS path, count(*) AS n_lines, CAST(sum(strlen(text) + 1) AS BIGINT) AS indexed_bytes FROM (
  SELECT conv_id, replace(text, chr(10), ' ') AS text, turn, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations)
WHERE conv_id % 3 <> 0 OR turn < m GROUP BY conv_id
""")
def complete_lines(spark, sf_dir):
    """Whole files with a torn last line in each third one."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.translate("text", "\n", " ").alias("t"))
    files = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), "\n").alias("body"))
    content = F.encode(F.concat("body", F.when(F.col("conv_id") % 3 != 0, "\n").otherwise("")), "UTF-8")
    lines = sessions.complete_lines(files.select(F.col("conv_id").cast("string").alias("path"), content.alias("content")))
    return lines.groupBy("path").agg(F.count("*").alias("n_lines"), F.max("indexed_bytes").cast("long").alias("indexed_bytes"))


@query("SELECT CAST(conv_id AS VARCHAR) AS path, turn AS line_no FROM conversations WHERE (conv_id + turn) % 5 = 0")
def bad_lines(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    broken = F.when((F.col("path").cast("long") + F.col("line_no")) % 5 == 0, F.substring("line", 1, 20)).otherwise(F.col("line"))
    _, bad = sessions.parsed_lines(rows.withColumn("line", broken))
    return bad.select("path", "line_no")


@query("""
SELECT event_id, len(s) > 0 AS some, coalesce(array_to_string(s, ','), '') AS strings FROM (
  SELECT event_id, [x[2:-2] FOR x IN regexp_extract_all(regexp_replace(props, '"[^"]*"\\s*:', '', 'g'), '"[^"]*"')] AS s FROM events)
""")
def json_leaves(spark, sf_dir):
    s = T.json_strings(F.col("props"))
    return read(spark, sf_dir, "events").select("event_id", (F.size(s) > 0).alias("some"), F.array_join(s, ",").alias("strings"))
