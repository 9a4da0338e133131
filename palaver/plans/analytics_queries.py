"""Analytics queries over events as items, and turns over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics, export, normalize, search, turns
from ..sources import providers
from .common import EVENT_ITEMS_SQL, LABEL_SQL, event_items, read
from .registry import query

_I = f"WITH i AS ({EVENT_ITEMS_SQL})"
_LOCAL = "provider IN ('claude-code', 'codex')"


@query(f"{_I} SELECT {LABEL_SQL} AS key, count(*) AS n FROM i GROUP BY 1")
def count_by_provider(spark, sf_dir):
    return analytics.by_provider(event_items(spark, sf_dir))


@query(f"{_I} SELECT event_id, {LABEL_SQL} AS label FROM i")
def provider_labels(spark, sf_dir):
    return providers.with_label(event_items(spark, sf_dir)).select("event_id", "label")


@query(f"{_I} SELECT host AS key, count(*) AS n FROM i WHERE {_LOCAL} GROUP BY 1")
def by_host(spark, sf_dir):
    return analytics.by_host(event_items(spark, sf_dir))


@query("""
WITH c AS (SELECT strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m') AS key, count(*) AS n FROM orders GROUP BY 1),
s AS (SELECT strftime(unnest(generate_series((SELECT min(strptime(key, '%Y-%m')) FROM c), (SELECT max(strptime(key, '%Y-%m')) FROM c), INTERVAL 1 MONTH)), '%Y-%m') AS key)
SELECT key, CAST(coalesce(n, 0) AS BIGINT) AS n FROM s LEFT JOIN c USING (key)
""")
def monthly_filled(spark, sf_dir):
    return analytics.monthly(read(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp").alias("created_ts")))


@query(f"{_I} SELECT CAST(h.range AS BIGINT) AS key, CAST(count(event_id) AS BIGINT) AS n FROM range(24) h LEFT JOIN i ON hour(created_ts) = h.range GROUP BY 1")
def hour_hist(spark, sf_dir):
    return analytics.hours(event_items(spark, sf_dir))


@query(f"{_I} SELECT CAST(h.range AS BIGINT) AS key, CAST(count(event_id) AS BIGINT) AS n FROM range(7) h LEFT JOIN i ON isodow(created_ts) - 1 = h.range GROUP BY 1")
def weekday_hist(spark, sf_dir):
    return analytics.weekdays(event_items(spark, sf_dir))


@query("""
WITH h AS (SELECT h.range AS key, count(event_id) AS n FROM range(24) h LEFT JOIN events ON hour(ts) = h.range GROUP BY 1)
SELECT string_agg(CASE WHEN n = 0 THEN ' ' ELSE substr(' ▁▂▃▄▅▆▇█', CAST(greatest(1, least(8, round_even(8 * n / (SELECT max(n) FROM h), 0))) AS INT) + 1, 1) END, '' ORDER BY key) AS line FROM h
""")
def hour_sparkline(spark, sf_dir):
    return analytics.spark_line(analytics.hours(event_items(spark, sf_dir)))


@query(f"{_I} SELECT CAST(created_ts AS DATE) AS day, count(*) AS n FROM i GROUP BY 1 ORDER BY n DESC, day LIMIT 1")
def busiest_day(spark, sf_dir):
    return analytics.busiest_day(event_items(spark, sf_dir))


@query(f"{_I} SELECT min(CAST(created_ts AS DATE)) AS first_day, max(CAST(created_ts AS DATE)) AS last_day, CAST(date_diff('day', min(CAST(created_ts AS DATE)), max(CAST(created_ts AS DATE))) + 1 AS BIGINT) AS days FROM i")
def date_span(spark, sf_dir):
    return analytics.date_span(event_items(spark, sf_dir))


@query(f"{_I} SELECT '~' || substr(cwd, 11) AS key, count(*) AS n FROM i WHERE {_LOCAL} GROUP BY 1 ORDER BY n DESC, key LIMIT 8")
def top_dirs(spark, sf_dir):
    return analytics.top_directories(event_items(spark, sf_dir), home="/home/user")


@query(f"{_I} SELECT DISTINCT cwd FROM i WHERE {_LOCAL}")
def local_cwds(spark, sf_dir):
    return analytics.local_cwds(event_items(spark, sf_dir))


@query("SELECT event_type AS tool, count(*) AS n FROM events WHERE user_id % 2 = 0 GROUP BY 1 ORDER BY n DESC, tool LIMIT 3")
def leaderboard(spark, sf_dir):
    counts = read(spark, sf_dir, "events").groupBy((F.col("user_id") % 2).cast("string").alias("source"), F.col("user_id"), F.col("event_type").alias("tool")).agg(F.count("*").alias("n"))
    return analytics.leaderboard(analytics.tool_totals(counts, ["0"]), 3)


@query("""
WITH c AS (SELECT event_type AS key, count(*) AS n FROM events GROUP BY 1)
SELECT key, n, round(n * 100.0 / sum(n) OVER (), 6) AS pct, repeat('█', CAST(greatest(1, round_even(24 * n / max(n) OVER (), 0)) AS INT)) AS bar FROM c
""")
def share(spark, sf_dir):
    counts = analytics.count_by(read(spark, sf_dir, "events"), F.col("event_type"))
    return analytics.shares(counts).select("key", "n", F.round("pct", 6).alias("pct"), "bar")


@query(f"""
{_I}, s AS (
  SELECT 'provider' AS section, {LABEL_SQL} AS key, count(*) AS n FROM i GROUP BY 2
  UNION ALL SELECT 'host', host, count(*) FROM i WHERE {_LOCAL} GROUP BY 2
  UNION ALL SELECT 'month', strftime(created_ts, '%Y-%m'), count(*) FROM i GROUP BY 2
  UNION ALL SELECT 'hour', CAST(h.range AS VARCHAR), count(event_id) FROM range(24) h LEFT JOIN i ON hour(created_ts) = h.range GROUP BY 2
  UNION ALL SELECT 'weekday', CAST(h.range AS VARCHAR), count(event_id) FROM range(7) h LEFT JOIN i ON isodow(created_ts) - 1 = h.range GROUP BY 2
  UNION ALL (SELECT 'directory', cwd, count(*) FROM i WHERE {_LOCAL} GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 8)
  UNION ALL (SELECT 'busiest_day', CAST(CAST(created_ts AS DATE) AS VARCHAR), count(*) FROM i GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1)
)
SELECT section, key, CAST(n AS BIGINT) AS n, round(CASE WHEN sum(n) OVER (PARTITION BY section) > 0 THEN n * 100.0 / sum(n) OVER (PARTITION BY section) ELSE 0 END, 6) AS pct FROM s
""")
def report(spark, sf_dir):
    return analytics.report(event_items(spark, sf_dir)).withColumn("pct", F.round("pct", 6))


# Turns --------------------------------------------------------------------------------------------


def _events(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "user").when(F.col("role") == "assistant", "text").otherwise("tool")
    value = F.when(kind == "tool", F.substring_index(F.col("text"), " ", 1)).otherwise(F.col("text"))
    return c.select(F.col("conv_id").alias("path"), F.col("turn").alias("line_no"), F.lit(0).alias("ev_no"), kind.alias("kind"), value.alias("value"), F.col("turn").cast("string").alias("ts"))


_TURNS = """
WITH e AS (
  SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'text' ELSE 'tool' END AS kind,
    CASE WHEN role IN ('user', 'assistant') THEN text ELSE split_part(text, ' ', 1) END AS value FROM conversations
), w AS (
  SELECT *, sum(CASE WHEN kind = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM e
), g AS (
  SELECT conv_id, island, kind = 'user' AS u, CAST(min(turn) AS VARCHAR) AS ts,
    coalesce(string_agg(value, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE kind <> 'tool'), '') AS content,
    CAST(count(DISTINCT value) FILTER (WHERE kind = 'tool') AS INT) AS n_tools FROM w GROUP BY ALL
), k AS (
  SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY island, u DESC) AS INT) AS turn_no,
    CASE WHEN u THEN 'user' ELSE 'assistant' END AS role, ts, content, n_tools FROM g WHERE u OR content <> '' OR n_tools > 0
)
"""


@query(f"{_TURNS} SELECT * FROM k")
def turns_assembled(spark, sf_dir):
    out = turns.assemble(_events(spark, sf_dir))
    return out.select(F.col("path").alias("conv_id"), "turn_no", "role", "ts", "content", F.size("tool_uses").alias("n_tools"))


@query(f"{_TURNS} SELECT role, count(*) AS n FROM k GROUP BY role")
def turn_counts(spark, sf_dir):
    return turns.assemble(_events(spark, sf_dir)).groupBy("role").agg(F.count("*").alias("n"))


@query("SELECT conv_id, split_part(text, ' ', 1) AS tool, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY ALL")
def tool_counts(spark, sf_dir):
    e = read(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", F.lit("tool").alias("kind"), F.substring_index("text", " ", 1).alias("value"))
    return turns.tool_counts(e, "conv_id")


@query("""
WITH c AS (SELECT conv_id, role, count(*) AS n, min(turn) AS f FROM conversations GROUP BY ALL)
SELECT conv_id, role FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, f) = 1
""")
def dominant_role(spark, sf_dir):
    return normalize.dominant(read(spark, sf_dir, "conversations"), "conv_id", "role", "turn")


@query("""
WITH m AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations WHERE role <> 'assistant')
SELECT conv_id, turn, role FROM m WHERE b = role
""")
def forks(spark, sf_dir):
    m = read(spark, sf_dir, "conversations").where("role <> 'assistant'").select("conv_id", "turn", "role")
    return turns.forks(m, "conv_id", "turn", "role")


@query("""
SELECT conv_id, arg_min(text, turn) FILTER (WHERE text <> '') AS first_text, arg_max(role, turn) FILTER (WHERE role <> '') AS last_role FROM conversations GROUP BY conv_id
""")
def session_edges(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(turns.first_filled("text", "turn").alias("first_text"), turns.last_filled("role", "turn").alias("last_role"))


@query("""
SELECT conv_id, string_agg(chr(10) || chr(10) || '## ' || upper(substr(role, 1, 1)) || substr(role, 2) || chr(10) || chr(10) || '*' || turn || '*' || chr(10)
  || CASE WHEN text <> '' THEN chr(10) || chr(10) || text || chr(10) ELSE '' END || chr(10) || chr(10) || '---' || chr(10), '' ORDER BY turn) AS body FROM conversations GROUP BY conv_id
""")
def markdown_docs(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    t = c.select("conv_id", F.col("turn").alias("turn_no"), F.initcap("role").alias("role"), F.col("turn").cast("string").alias("ts"), F.col("text").alias("content"), F.array().cast("array<string>").alias("tool_uses"))
    meta = c.groupBy("conv_id").agg(F.lit("x").alias("session_id"), F.lit("").alias("cwd"), F.lit("").alias("git_branch"), F.lit("").alias("created_at"), F.lit("").alias("updated_at"), F.lit("x").alias("name"))
    # `ts` is a bare number here, which is no time, so it is shown as it is.
    docs = export.transcript_markdown(meta, t.withColumn("ts", F.concat("ts", F.lit(""))), F.lit("resume"), "conv_id")
    return docs.select("conv_id", F.concat(F.lit("\n\n## "), F.get(F.split("body", "\n\n## ", 2), F.lit(1))).alias("body"))


@query(f"{_I} SELECT event_id, CASE WHEN {_LOCAL} THEN host END AS host, CASE WHEN {_LOCAL} THEN cwd END AS cwd FROM i")
def result_extra(spark, sf_dir):
    out = normalize.results(event_items(spark, sf_dir).withColumn("git_branch", F.lit("")))
    return out.select("event_id", F.col("extra.host").alias("host"), F.col("extra.cwd").alias("cwd"))


@query(f"{_I} SELECT event_id FROM i WHERE {_LOCAL} AND (cwd = '/home/user/p2' OR starts_with(cwd, '/home/user/p2/'))")
def scope_here(spark, sf_dir):
    items = event_items(spark, sf_dir)
    return search.scope(items, "/home/user/p2", providers.is_local_cli(F.col("provider"))).select("event_id")


@query(f"""{_I} SELECT event_id, CASE provider WHEN 'claude' THEN 'https://claude.ai/chat/' || event_id WHEN 'chatgpt' THEN 'https://chatgpt.com/c/' || event_id
  WHEN 'claude-code' THEN '[' || host || '] pushd ' || cwd || ' && claude -r ' || event_id WHEN 'codex' THEN '[' || host || '] pushd ' || cwd || ' && codex resume ' || event_id
  ELSE 'Unknown provider: ' || provider END AS url FROM i""")
def provider_urls(spark, sf_dir):
    url = providers.url(F.col("provider"), F.lit("conversation"), F.col("event_id").cast("string"), F.col("cwd"), F.col("host"))
    return event_items(spark, sf_dir).select("event_id", url.alias("url"))
