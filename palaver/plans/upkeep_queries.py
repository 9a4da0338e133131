"""Upserts, catalog diffs, mirrors, export planning, data quality and personal data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import times
from ..operators import analytics, export, pii, quality, upkeep
from ..operators.numbering import kept
from ..sources import adapters
from ..streaming import mirror
from .common import read
from .registry import query


def _old_new(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("uuid"), F.concat(F.lit("acc"), F.col("doc_id") % 4).alias("account"), "n_chars", "source")
    old = d.where("uuid % 3 <> 0").drop("source")
    new = d.where("uuid % 2 = 0").select("uuid", F.when(F.col("uuid") % 10 == 0, "other").otherwise(F.col("account")).alias("account"), (F.col("n_chars") + 1).alias("n_chars"))
    return old, new


_OLD_NEW = """
WITH d AS (SELECT doc_id AS uuid, 'acc' || (doc_id % 4) AS account, n_chars FROM documents),
o AS (SELECT * FROM d WHERE uuid % 3 <> 0),
n AS (SELECT uuid, CASE WHEN uuid % 10 = 0 THEN 'other' ELSE account END AS account, n_chars + 1 AS n_chars FROM d WHERE uuid % 2 = 0)
"""


@query(f"{_OLD_NEW} SELECT * FROM o ANTI JOIN n USING (uuid, account) UNION ALL SELECT * FROM n")
def upsert_merge(spark, sf_dir):
    return upkeep.upsert(*_old_new(spark, sf_dir), ["uuid", "account"])


@query(f"{_OLD_NEW} SELECT o.uuid, o.account AS old_account, n.account AS new_account FROM o JOIN n USING (uuid) WHERE o.account <> n.account")
def upsert_conflicts(spark, sf_dir):
    return upkeep.conflicts(*_old_new(spark, sf_dir))


@query("SELECT conv_id AS uuid, arg_max(turn, turn) AS pos, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def last_wins(spark, sf_dir):
    return upkeep.last_wins(read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("uuid"), F.col("turn").alias("pos"), "text"))


def _catalogs(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    old = d.where("doc_id % 7 <> 0").select(F.concat(F.lit("f"), "doc_id").alias("path"), F.col("n_chars").alias("size"), F.col("n_chars").alias("indexed_bytes"), F.xxhash64("text").alias("content_hash"))
    new = d.where("doc_id % 5 <> 0").select(F.concat(F.lit("f"), "doc_id").alias("path"), (F.col("n_chars") + F.when(F.col("doc_id") % 11 == 0, 3).otherwise(0)).alias("size"), F.xxhash64("text").alias("content_hash"))
    return old, new


@query("""
SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'new' WHEN doc_id % 5 = 0 THEN 'removed' WHEN doc_id % 11 = 0 THEN 'rewritten' ELSE 'same' END AS change
FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 5 <> 0
""")
def catalog_diff(spark, sf_dir):
    return upkeep.catalog_diff(*_catalogs(spark, sf_dir))


@query("SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 2 ELSE 1 END AS version FROM documents WHERE doc_id % 5 <> 0")
def refresh_tables(spark, sf_dir):
    old, new = _catalogs(spark, sf_dir)
    diff = upkeep.catalog_diff(old, new)
    rebuilt = new.join(diff.where("change IN ('new', 'rewritten')"), "path", "left_semi").select("path", F.lit(2).alias("version"))
    return upkeep.refresh(old.select("path", F.lit(1).alias("version")), diff, rebuilt)


@query("SELECT doc_id AS path, CASE WHEN doc_id % 4 = 0 THEN 'anew' ELSE source END AS text FROM documents")
def rescued_texts(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.array("source").alias("texts"))
    stored = d.withColumn("texts", F.when(F.col("path") % 4 != 0, F.col("texts")))
    return upkeep.rescued(d, stored, d.select("path", F.array(F.lit("anew")).alias("texts"))).select("path", F.get("texts", F.lit(0)).alias("text"))


def _mirror(spark, sf_dir):
    source = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("line_no"), F.to_json(F.struct("text")).alias("line"))
    last = source.groupBy("path").agg(F.max("line_no").alias("m"))
    archive = source.join(last, "path").where("line_no <= m / 2").drop("m")
    long = source.join(last, "path").where("path % 5 = 0 AND line_no = m").select("path", (F.col("line_no") + 7).alias("line_no"), "line")
    return source, archive.unionByName(long)


_M = "WITH s AS (SELECT conv_id AS path, turn AS line_no, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations)"


@query(f"{_M} SELECT path, line_no FROM s WHERE line_no > m / 2 AND path % 5 <> 0")
def mirror_append(spark, sf_dir):
    return mirror.new_lines(mirror.good_lines(_mirror(spark, sf_dir)[0]), _mirror(spark, sf_dir)[1]).select("path", "line_no")


@query(f"{_M} SELECT DISTINCT path, m + 8 AS archived, m + 1 AS present FROM s WHERE path % 5 = 0")
def mirror_truncation(spark, sf_dir):
    return mirror.truncated(*_mirror(spark, sf_dir))


@query(f"{_M} SELECT count(*) AS new_lines, count(DISTINCT path) AS changed_files FROM s WHERE line_no > m / 2 AND path % 5 <> 0")
def refresh_totals(spark, sf_dir):
    source, archive = _mirror(spark, sf_dir)
    return upkeep.refresh_totals(mirror.new_lines(source, archive))


def _export_items(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.format_string("%08d", "doc_id").alias("uuid"), F.when(F.col("doc_id") % 2 == 0, "claude").otherwise("codex").alias("provider"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 5 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z")).alias("created_at"),
        F.concat(F.lit("My  "), "lang", F.lit(" note!")).alias("name"), F.lit("conversation").alias("item_type"), F.col("source").alias("host"), F.lit("").alias("email"),
    )


_EX = """
WITH d AS (SELECT printf('%08d', doc_id) AS uuid, CASE WHEN doc_id % 2 = 0 THEN 'claude' ELSE 'codex' END AS provider, '2024-01-0' || (doc_id % 5 + 1) AS day,
  '2024-01-0' || (doc_id % 5 + 1) || '_My-' || lang || '-note' AS stem, 'My  ' || lang || ' note!' AS name, CASE WHEN doc_id % 2 = 0 THEN 'unknown' ELSE source END AS grp FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY provider, grp, stem ORDER BY day, uuid) AS k, count(*) OVER (PARTITION BY stem) AS n, row_number() OVER (PARTITION BY stem ORDER BY day, uuid) AS j FROM d),
p AS (SELECT *, provider || '/' || grp || '/conversations/' || stem || CASE WHEN k = 1 THEN '' ELSE '-' || k END || '.md' AS rel_path FROM k)
"""


@query(f"{_EX} SELECT uuid, CASE WHEN n = 1 THEN stem ELSE stem || '-' || j END AS file_name FROM p")
def unique_names(spark, sf_dir):
    return upkeep.unique_names(_export_items(spark, sf_dir)).select("uuid", "file_name")


@query(f"{_EX} SELECT uuid, grp, rel_path FROM p")
def export_plan(spark, sf_dir):
    return export.plan(_export_items(spark, sf_dir)).select("uuid", "grp", "rel_path")


@query("""
WITH d AS (SELECT CASE WHEN doc_id % 7 <> 0 THEN 'u' || (doc_id % 50) END AS uuid, source AS grp, '2024-01-01_' || lang AS stem FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY grp, stem ORDER BY uuid NULLS FIRST) AS k FROM d)
SELECT uuid, grp, 'codex/' || grp || '/conversations/' || stem || CASE WHEN k = 1 THEN '' ELSE '-' || k END || '.md' AS rel_path FROM k
""")
def export_plan_repeats(spark, sf_dir):
    """Items without an id and with repeated ids: each is planned once."""
    d = read(spark, sf_dir, "documents")
    items = d.select(
        F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("u"), F.col("doc_id") % 50)).alias("uuid"), F.lit("codex").alias("provider"), F.lit("2024-01-01T00:00:00Z").alias("created_at"),
        F.col("lang").alias("name"), F.lit("conversation").alias("item_type"), F.col("source").alias("host"), F.lit("").alias("email"),
    )
    return export.plan(items).select("uuid", "grp", "rel_path")


@query(f"{_EX} SELECT CASE provider WHEN 'claude' THEN 'claude.ai' ELSE provider END AS provider, count(*) AS n FROM p GROUP BY 1")
def export_counts(spark, sf_dir):
    return export.planned_counts(export.plan(_export_items(spark, sf_dir)))


@query(f"""{_EX} SELECT provider, grp, '## ' || CASE provider WHEN 'claude' THEN 'claude.ai' ELSE provider END || ' / ' || grp || chr(10) || chr(10)
  || string_agg('- ' || day || ' — [' || name || '](' || rel_path || ')', chr(10) ORDER BY day DESC, rel_path DESC) || chr(10) AS section FROM p GROUP BY provider, grp""")
def export_manifest(spark, sf_dir):
    return export.manifest(export.plan(_export_items(spark, sf_dir)))


@query(f"""{_EX} SELECT provider, grp, row_number() OVER (PARTITION BY provider, grp ORDER BY day DESC, rel_path DESC) AS line_no, '- ' || day || ' — [' || name || '](' || rel_path || ')' AS line FROM p
  UNION ALL SELECT DISTINCT provider, grp, 0, '## ' || CASE provider WHEN 'claude' THEN 'claude.ai' ELSE provider END || ' / ' || grp || chr(10) FROM p""")
def export_manifest_lines(spark, sf_dir):
    return export.manifest_lines(export.plan(_export_items(spark, sf_dir)))


# Personal data ------------------------------------------------------------------------------------


def _lines(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("line"), "text")


_FOUND = (
    "WITH f AS (SELECT line, label, unnest(v) AS value FROM ("
    + " UNION ALL ".join(f"SELECT doc_id AS line, '{name}' AS label, regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}') AS v FROM documents" for name, p in pii.PATTERNS.items())
    + ")), g AS (SELECT label, value, count(*) AS n, min(line) AS first_line FROM f GROUP BY label, value)"
)
_VETTED = """CASE label
  WHEN 'email' THEN lower(value) = 'git@github.com' OR regexp_extract(lower(value), '@([^@]*)$', 1) IN ('example.com', 'example.org', 'example.net', 'example.edu', 'b.com')
  WHEN 'home_path' THEN split_part(substr(value, 7), '/', 1) IN ('user', 'testuser', 'u') WHEN 'users_path' THEN split_part(substr(value, 8), '/', 1) IN ('me')
  WHEN 'url' THEN lower(split_part(split_part(regexp_replace(value, '^https?://', ''), '/', 1), ':', 1)) IN ('github.com', 'claude.ai', 'chatgpt.com', 'openai.com', 'anthropic.com')
  WHEN 'timezone' THEN value = 'America/New_York'
  WHEN 'ipv4' THEN value IN ('127.0.0.1', '0.0.0.0', '255.255.255.255') OR starts_with(value, '10.') OR starts_with(value, '192.168.') OR starts_with(value, '172.16.')
  ELSE false END"""


@query(f"{_FOUND} SELECT * FROM g")
def pii_findings(spark, sf_dir):
    return pii.findings(_lines(spark, sf_dir))


@query(f"{_FOUND} SELECT * FROM g WHERE NOT {_VETTED}")
def pii_novel(spark, sf_dir):
    return pii.novel(pii.findings(_lines(spark, sf_dir)))


@query(f"{_FOUND} SELECT * FROM g WHERE NOT {_VETTED} AND label IN ('email', 'home_path', 'users_path', 'windows_path', 'timezone', 'aws_key', 'openai_key', 'jwt')")
def pii_guard(spark, sf_dir):
    return pii.guard(pii.findings(_lines(spark, sf_dir)))


@query("SELECT needle, doc_id AS line FROM documents, (VALUES ('THING'), ('@'), ('copyright')) n(needle) WHERE contains(lower(text), lower(needle))")
def pii_denylist(spark, sf_dir):
    return pii.denylist(_lines(spark, sf_dir), ["THING", "@", "copyright", ""])


@query("""
WITH t AS (SELECT token, min(line) AS first_line FROM (SELECT doc_id AS line, unnest(regexp_extract_all(text, '[A-Za-z0-9+/=_\\-]{24,}')) AS token FROM documents) GROUP BY token),
e AS (SELECT token, first_line, (SELECT -sum(n / length(token) * log2(n / length(token))) FROM (SELECT count(*) AS n FROM unnest(string_split(token, '')) u(c) GROUP BY c)) AS entropy FROM t
  WHERE NOT regexp_matches(token, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') AND NOT regexp_matches(token, '^[0-9a-fA-F]{40}$'))
SELECT token, first_line, round(entropy, 6) AS entropy FROM e WHERE entropy >= 3.6
""")
def entropy_tokens(spark, sf_dir):
    return pii.entropy_tokens(_lines(spark, sf_dir)).withColumn("entropy", F.round("entropy", 6))


@query("SELECT doc_id AS line, '[' || lang || '] ' || CASE WHEN length(f) > 80 THEN substr(f, 1, 80) || '…' ELSE f END AS digest FROM (SELECT doc_id, lang, regexp_replace(text, '\\s+', ' ', 'g') AS f FROM documents)")
def record_digest(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumnRenamed("doc_id", "line")
    return pii.digest(docs, F.col("lang"), 80)


@query("""
SELECT conv_id * 100 + turn AS line, '--- line ' || (conv_id * 100 + turn) || ': ' || CASE role WHEN 'user' THEN 'event_msg / user_message' WHEN 'assistant' THEN 'response_item / message' ELSE 'response_item / function_call' END || ' ---' || chr(10)
  || CASE role WHEN 'user' THEN c WHEN 'assistant' THEN '[assistant] ' || c ELSE '[sh] cwd=/w' || conv_id || chr(10) || '  $ ' || c END AS digest
FROM (SELECT *, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '  …[+' || (length(text) - 60) || ' chars]' ELSE text END AS c FROM conversations)
""")
def legible_records(spark, sf_dir):
    """Rollout records of three types, digested by type."""
    c = read(spark, sf_dir, "conversations")
    json, lit = F.to_json, F.lit
    user = json(F.struct(lit("event_msg").alias("type"), F.struct(lit("user_message").alias("type"), F.col("text").alias("message")).alias("payload")))
    answer = json(F.struct(lit("response_item").alias("type"), F.struct(lit("message").alias("type"), "role", F.array(F.struct(lit("output_text").alias("type"), "text")).alias("content")).alias("payload")))
    arguments = json(F.struct(F.col("text").alias("cmd"), F.concat(lit("/w"), F.col("conv_id").cast("string")).alias("workdir")))
    call = json(F.struct(lit("response_item").alias("type"), F.struct(lit("function_call").alias("type"), lit("sh").alias("name"), arguments.alias("arguments")).alias("payload")))
    rows = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("line"), F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", answer).otherwise(call).alias("text"))
    return pii.legible(rows, 60)


@query(r"""
WITH t AS (SELECT doc_id, unnest(['tok_' || substr(sha256('t' || doc_id), 1, 20) || 'ZQ', md5(doc_id::VARCHAR), repeat('ab', 15)]) AS token FROM documents),
d AS (SELECT token, min(doc_id) AS first_line FROM t GROUP BY token),
e AS (SELECT token, first_line, list_sum(list_transform(list_distinct(string_split(token, '')), lambda c: -(len(list_filter(string_split(token, ''), lambda x: x = c)) / length(token)) * log2(len(list_filter(string_split(token, ''), lambda x: x = c)) / length(token)))) AS entropy FROM d)
SELECT token, first_line, round(entropy, 6) AS entropy FROM e WHERE entropy >= 3.6
""")
def entropy_ids(spark, sf_dir):
    """Tokens of documents that do pass, some that don't, and repeated ones."""
    doc = F.col("doc_id").cast("string")
    token = F.concat(F.lit("tok_"), F.substring(F.sha2(F.concat(F.lit("t"), doc), 256), 1, 20), F.lit("ZQ"))
    text = F.concat_ws(" ", token, F.md5(doc), F.lit("ab" * 15), token)
    found = pii.entropy_tokens(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("line"), text.alias("text")))
    return found.withColumn("entropy", F.round("entropy", 6))


@query("""
SELECT 'conversations' AS kind, 'missing: ' || f AS error, count(*) AS n FROM (SELECT conv_id, unnest(['id', 'title', 'create_time']) AS f FROM (SELECT DISTINCT conv_id FROM conversations))
WHERE f = 'id' AND conv_id % 4 = 0 OR f = 'title' AND conv_id % 5 = 0 OR f = 'create_time' AND conv_id % 7 = 0 GROUP BY ALL
UNION ALL SELECT 'conversations', 'not valid JSON', count(DISTINCT conv_id) FROM conversations WHERE conv_id % 11 = 0 AND conv_id % 4 <> 0 HAVING count(*) > 0
""")
def thread_contract(spark, sf_dir):
    """The thread export's contract over one record for each conversation, and files that are no JSON."""
    conv = F.col("conv_id")
    rows = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    raw = F.to_json(F.struct(F.when(conv % 4 != 0, conv.cast("string")).alias("id"), F.when(conv % 5 != 0, "t").alias("title"), F.when(conv % 7 != 0, 1.5).alias("create_time"), F.lit("x").alias("other")))
    path = conv.cast("string").alias("path")
    records = rows.select(path, F.lit(0).alias("pos"), raw.alias("raw"))
    broken = rows.where("conv_id % 11 = 0 AND conv_id % 4 <> 0").select(path, F.lit("{not json").alias("value"))
    found = adapters.EXPORTS["chatgpt"].problems({"conversations": records})
    wrong = quality.invalid_json(broken.unionByName(records.select("path", F.col("raw").alias("value")))).select(F.lit("conversations").alias("kind"), F.lit("not valid JSON").alias("error"))
    return found.select(F.col("table").alias("kind"), "error").unionByName(wrong).groupBy("kind", "error").agg(F.count("*").alias("n"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)ention', 'XX', 'g'), '(?i)the', 'YY', 'g') AS text FROM documents")
def substituted(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.substitute(F.col("text"), {"the": "YY", "ention": "XX"}).alias("text"))


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS n_masks FROM documents")
def masked_ids(spark, sf_dir):
    """As many masks as ids, each the same whenever it is made."""
    ids = read(spark, sf_dir, "documents").select(F.regexp_replace(F.md5(F.col("doc_id").cast("string")), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-").alias("id"))
    return ids.select(T.mask_id(F.col("id"), "s").alias("m")).agg(F.count("*").alias("n"), F.count_distinct("m").alias("n_masks"))


_UUID = "regexp_replace(md5({0}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})', '\\1-\\2-\\3-\\4-')"
_DIGITS = "sha256('s' || {0}) || sha256(sha256('s' || {0}))"


@query(f"""
WITH i AS (SELECT conv_id, turn, role, {_UUID.format("'s' || conv_id")} AS sid, sha1('k' || conv_id) AS commit, {_UUID.format("'t' || conv_id || '-' || turn")} AS tid, 'call_' || substr(md5('c' || conv_id || '-' || turn), 1, 12) || 'xyZ' AS cid FROM conversations),
d AS (SELECT *, {_DIGITS.format("sid")} AS sd, {_DIGITS.format("commit")} AS kd, {_DIGITS.format("tid")} AS td, {_DIGITS.format("cid")} AS cd FROM i),
m AS (SELECT conv_id, turn, role, substr(sd, 1, 8) || '-' || substr(sd, 10, 4) || '-' || substr(sd, 15, 4) || '-' || substr(sd, 20, 4) || '-' || substr(sd, 25, 12) AS sid, substr(kd, 1, 40) AS commit,
  substr(td, 1, 8) || '-' || substr(td, 10, 4) || '-' || substr(td, 15, 4) || '-' || substr(td, 20, 4) || '-' || substr(td, 25, 12) AS tid, 'call_' || substr(cd, 6, 15) AS cid FROM d)
SELECT conv_id, turn, CASE WHEN turn = 0 THEN '{{"type":"session_meta","payload":{{"id":"' || sid || '","cwd":"/home/user/x","git":{{"commit_hash":"' || commit || '"}}}}}}'
  WHEN role = 'assistant' THEN '{{"type":"response_item","payload":{{"call_id":"' || cid || '","arguments":"resume ' || sid || ' at ' || commit || ' for ' || cid || '"}}}}'
  ELSE '{{"type":"event_msg","payload":{{"turn_id":"' || tid || '","rate":{{"used_percent": 0}},"plan_type": null,"tz":"America/New_York"}}}}' END AS text FROM m
""")
def redacted_logs(spark, sf_dir):
    """Sessions, turns, calls and commits named in one record and repeated in others."""
    c, id_of = read(spark, sf_dir, "conversations"), lambda *p: F.regexp_replace(F.md5(F.concat(*p)), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")
    turn = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    sid, commit, tid = id_of(F.lit("s"), F.col("conv_id").cast("string")), F.sha1(F.concat(F.lit("k"), F.col("conv_id").cast("string"))), id_of(F.lit("t"), turn)
    cid = F.concat(F.lit("call_"), F.substring(F.md5(F.concat(F.lit("c"), turn)), 1, 12), F.lit("xyZ"))
    meta = F.concat(F.lit('{"type":"session_meta","payload":{"id":"'), sid, F.lit('","cwd":"/root/x","git":{"commit_hash":"'), commit, F.lit('"}}}'))
    call = F.concat(F.lit('{"type":"response_item","payload":{"call_id":"'), cid, F.lit('","arguments":"resume '), sid, F.lit(" at "), commit, F.lit(" for "), cid, F.lit('"}}'))
    event = F.concat(F.lit('{"type":"event_msg","payload":{"turn_id":"'), tid, F.lit('","rate":{"used_percent": 12.5},"plan_type": "free","tz":"Europe/Rome"}}'))
    lines = c.select("conv_id", "turn", F.when(F.col("turn") == 0, meta).when(F.col("role") == "assistant", call).otherwise(event).alias("text"))
    ids = lines.select(F.explode(pii.own_ids(F.col("text"))).alias("id")).distinct()
    return pii.redact_logs(lines, home="/root", zone="Europe/Rome", table=ids.withColumn("mask", T.mask_token(F.col("id"), "s")))


_GATHERED = "EXISTS (SELECT 1 FROM conversations AS o WHERE o.conv_id = {0} AND {1})"
_TURN, _CALL = "'turn-' || {0} || 'Q'", "'call_' || {0} || '-' || {1}"


def _mask_if(condition: str, value: str) -> str:
    return f"CASE WHEN {_GATHERED.format(*condition)} THEN 'm' || md5({value}) ELSE {value} END"


@query(f"""
WITH m AS (SELECT c.conv_id, c.turn, c.role, {_mask_if(("c.conv_id", "o.role = 'user'"), _TURN.format("c.conv_id"))} AS mine, {_mask_if(("c.conv_id + 1", "o.role = 'user'"), _TURN.format("(c.conv_id + 1)"))} AS other,
  {_mask_if(("c.conv_id", "o.role = 'assistant' AND o.turn = c.turn"), _CALL.format("c.conv_id", "c.turn"))} AS call, {_mask_if(("c.conv_id + 1", "o.role = 'assistant' AND o.turn = c.turn + 1"), _CALL.format("(c.conv_id + 1)", "(c.turn + 1)"))} AS foreign_call FROM conversations AS c)
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN conv_id END AS session, CASE role WHEN 'user' THEN '{{"type":"event_msg","payload":{{"turn_id":"' || mine || '","note":"see ' || foreign_call || ' and ' || other || '"}}}}'
  WHEN 'assistant' THEN '{{"type":"response_item","payload":{{"call_id":"' || call || '","arguments":"' || mine || mine || ', not ' || other || '"}}}}'
  ELSE '{{"type":"event_msg","payload":{{"turn_id":7,"at":"2024-07-17T07:00:00Z","see":"' || other || '"}}}}' END AS text FROM m
""")
def quoted_logs(spark, sf_dir):
    """Records, some under a null session, quote each other's ids: sequential ones, calls with hyphens; a numeric id masks nothing."""
    c, text = read(spark, sf_dir, "conversations"), lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    conv, turn = F.col("conv_id"), F.col("turn")
    mine, other = text("turn-", conv, "Q"), text("turn-", conv + 1, "Q")
    user = text('{"type":"event_msg","payload":{"turn_id":"', mine, '","note":"see call_', conv + 1, "-", turn + 1, " and ", other, '"}}')
    call = text('{"type":"response_item","payload":{"call_id":"call_', conv, "-", turn, '","arguments":"', mine, mine, ", not ", other, '"}}')
    rest = text('{"type":"event_msg","payload":{"turn_id":7,"at":"2024-07-17T07:00:00Z","see":"', other, '"}}')
    lines = c.select("conv_id", "turn", F.when(turn % 2 == 0, conv).alias("session"), F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", call).otherwise(rest).alias("text"))
    ids = lines.select(F.explode(pii.own_ids(F.col("text"))).alias("id")).distinct()
    return pii.redact_logs(lines, table=ids.select("id", F.concat(F.lit("m"), F.md5("id")).alias("mask")))


@query("""
WITH i AS (SELECT 'turn-' || doc_id AS id FROM documents UNION SELECT md5(doc_id::VARCHAR) FROM documents UNION SELECT 'call_' || chr(CAST(65 + doc_id % 26 AS INT)) || (doc_id % 7) FROM documents)
SELECT id, length(id) AS length, regexp_replace(CASE WHEN id LIKE 'call#_%' ESCAPE '#' THEN substr(id, 6) ELSE id END, '[0-9A-Za-z]', '*', 'g') AS layout, 1 AS owners, false AS same, false AS real FROM i
""")
def permuted_masks(spark, sf_dir):
    """Every id with what holds of its mask: layout, how many ids share it, whether it is the id or another one."""
    d, doc = read(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    ids = reduce(lambda a, b: a.union(b), [d.select(x.alias("id")) for x in (F.concat(F.lit("turn-"), doc), F.md5(doc), F.concat(F.lit("call_"), F.char(F.col("doc_id") % 26 + 65), (F.col("doc_id") % 7).cast("string")))]).distinct()
    table = kept(pii.masks(ids, "s"))
    owners = table.groupBy("mask").agg(F.count("*").cast("int").alias("owners"))
    real = ids.select(F.col("id").alias("mask"), F.lit(True).alias("real"))
    both = table.join(owners, "mask").join(real, "mask", "left")
    tail = F.when(F.startswith("mask", F.lit("call_")), F.substring("mask", 6, 100)).otherwise(F.col("mask"))
    return both.select("id", F.length("mask").cast("long").alias("length"), F.regexp_replace(tail, "[0-9A-Za-z]", "*").alias("layout"), "owners", (F.col("id") == F.col("mask")).alias("same"), F.coalesce("real", F.lit(False)).alias("real"))


@query("SELECT 'Doc ' || b.doc_id AS needle, a.doc_id AS line FROM documents AS a JOIN documents AS b ON b.doc_id % 3 = 0 AND contains(lower(a.text || ' see DOC ' || (a.doc_id + 3)), lower('Doc ' || b.doc_id))")
def denylist_many(spark, sf_dir):
    """As many needles as a third of the documents, which refer to each other."""
    d = read(spark, sf_dir, "documents")
    lines = d.select(F.col("doc_id").alias("line"), F.concat("text", F.lit(" see DOC "), (F.col("doc_id") + 3).cast("string")).alias("text"))
    return pii.denylist_table(lines, d.where("doc_id % 3 = 0").select(F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))))


# Data quality and scalars -------------------------------------------------------------------------


@query("SELECT event_type AS kind, json_exists(props, '$.a') AS has_a, count(*) AS n, CAST(sum(strlen(props)) AS BIGINT) AS bytes, round(sum(strlen(props)) / (SELECT sum(strlen(props)) FROM events), 9) AS share FROM events GROUP BY ALL")
def structure_profile(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.get_json_object("props", "$.a").isNotNull().alias("has_a"), "props")
    return analytics.structural_profile(e, "props", "kind", "has_a").withColumn("share", F.round("share", 9))


@query("SELECT conv_id AS uuid, count(*) AS n, CAST(count(DISTINCT role) AS INT) AS n_paths FROM conversations GROUP BY 1 HAVING count(*) > 1")
def dup_ids(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("uuid"), "role")
    return upkeep.duplicates(c, "uuid", "role").select("uuid", "n", F.size("paths").alias("n_paths"))


@query("""
SELECT error, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN coalesce(text, '') = '' THEN 'empty text' END, CASE WHEN lang IS NULL OR lang NOT IN ('en', 'de') THEN 'other language' END,
  CASE WHEN n_chars <> length(text) THEN 'wrong n_chars' END], lambda x: x IS NOT NULL)) AS error FROM documents) GROUP BY error
""")
def dq_report(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    checks = {"empty text": F.coalesce("text", F.lit("")) == "", "other language": ~F.coalesce(F.col("lang").isin("en", "de"), F.lit(False)), "wrong n_chars": F.col("n_chars") != F.length("text")}
    return quality.summary(quality.findings(d, ["doc_id"], checks))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'unknown-date' ELSE strftime(TIMESTAMP '1970-01-01' + to_seconds(doc_id * 100000), '%Y-%m-%d') END || '_' || coalesce(nullif(trim(regexp_replace(regexp_replace(replace(substr(text, 1, 30), ' ', '-'), '[^a-zA-Z0-9-]', '', 'g'), '-+', '-', 'g'), '-'), ''), 'untitled') AS stem FROM documents")
def file_stems(spark, sf_dir):
    at = F.when(F.col("doc_id") % 3 == 0, "not a time").otherwise(times.to_utc_iso(F.col("doc_id") * 100000))
    return read(spark, sf_dir, "documents").select("doc_id", times.file_stem(at, F.substring("text", 1, 30)).alias("stem"))


@query("SELECT page_id, regexp_replace(lower(trim(h)), '\\.example\\.org$', '') AS host, nullif(regexp_extract(url, '/en/(.*)$', 1), '') AS tail FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h FROM pages)")
def host_and_tail(spark, sf_dir):
    host = T.normalize_hostname(F.regexp_replace(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), r"\.example\.org$", ".local"))
    return read(spark, sf_dir, "pages").select("page_id", host.alias("host"), T.archive_path(F.col("url"), "en").alias("tail"))
