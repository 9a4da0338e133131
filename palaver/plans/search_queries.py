"""Search queries over conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import times
from ..operators import grams, normalize, search, store, upkeep
from .common import read
from .registry import query


def _score_sql(phrase: str, column: str) -> str:
    low = f"lower({column})"
    words = phrase.split()
    out = [f"CASE WHEN contains({low}, '{phrase}') THEN 10.0 ELSE 0.0 END"]
    out += [f"CASE WHEN regexp_matches({low}, '(^|[^\\pL\\pN_]){w}($|[^\\pL\\pN_])') THEN 2.0 WHEN contains({low}, '{w}') THEN 1.0 ELSE 0.0 END" for w in words]
    if len(words) > 1:
        out.append("CASE WHEN " + " AND ".join(f"contains({low}, '{w}')" for w in words) + " THEN 5.0 ELSE 0.0 END")
    return "(" + " + ".join(out) + ")"


def _search_sql(table: str, key: str, phrase: str, exact: bool = False) -> str:
    parts = [phrase] if exact else phrase.split()
    match = " AND ".join(f"contains(lower(text), '{p}')" for p in dict.fromkeys(parts))
    n = " + ".join(f"len(regexp_extract_all(text, '(?i){p}'))" for p in parts)
    return f"SELECT {key}, CAST(sum({_score_sql(phrase, 'text')} * ({n})) AS DOUBLE) AS total_score, CAST(sum({n}) AS BIGINT) AS n_matches FROM {table} WHERE text <> '' AND {match} GROUP BY {key}"


def _search(df, phrase, key, exact=False):
    return search.score_texts(df.select(key, "text"), phrase, [key], exact=exact).select(key, F.col("text_score").alias("total_score"), "n_matches")


@query(_search_sql("conversations", "conv_id", "the of and"))
def search_all_words(spark, sf_dir):
    return _search(read(spark, sf_dir, "conversations"), "the of and", "conv_id")


@query(_search_sql("documents", "doc_id", "of the", exact=True))
def search_exact(spark, sf_dir):
    return _search(read(spark, sf_dir, "documents"), "of the", "doc_id", exact=True)


@query(_search_sql("documents", "doc_id", "éou"))
def search_unicode_word(spark, sf_dir):
    return _search(read(spark, sf_dir, "documents"), "éou", "doc_id")


@query(_search_sql("conversations", "conv_id", "die"))
def search_single_word(spark, sf_dir):
    return _search(read(spark, sf_dir, "conversations"), "die", "conv_id")


AS_OF = "2024-06-01T00:00:00Z"
_TS_SQL = "(TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 3000 AS INT)))"


def _doc_time():
    return F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("doc_id"), F.lit(3000)) * 3600)


@query(f"""
SELECT doc_id, round(total_score + greatest(0.0, 5.0 * (1.0 - (epoch_us(TIMESTAMP '2024-06-01') - epoch_us({_TS_SQL})) / 86400000000.0 / 365.0)), 6) AS total_score, n_matches
FROM ({_search_sql("documents", "doc_id", "the and")})
""")
def search_recency(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    items = docs.select("doc_id", _doc_time().alias("updated"))
    found = search.search(items, docs.select("doc_id", "text"), "the and", ["doc_id"], updated="updated", as_of=times.parse_iso(F.lit(AS_OF)))
    return found.select("doc_id", F.round("total_score", 6).alias("total_score"), "n_matches")


@query(f"""
SELECT doc_id, updated, CAST(row_number() OVER (ORDER BY updated DESC, total_score DESC, doc_id) AS INT) AS rank FROM (
  SELECT doc_id, {_TS_SQL} AS updated, total_score FROM ({_search_sql("documents", "doc_id", "the and")}))
QUALIFY rank <= 50
""")
def search_time_sort(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    items = docs.select("doc_id", _doc_time().alias("updated"))
    found = search.search(items, docs.select("doc_id", "text"), "the and", ["doc_id"])
    first = search.top(found, search.ranked(found, "time", path="doc_id", updated="updated"), 50)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy(F.desc("updated"), F.desc("total_score"), "doc_id"))  # 50 rows
    return first.withColumn("rank", rank).select("doc_id", "updated", "rank")


@query(f"""
WITH t AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS first FROM conversations GROUP BY conv_id),
n AS (SELECT conv_id, regexp_replace(trim(regexp_replace(split_part(trim(coalesce(first, ''), E' \\n\\t'), chr(10), 1), '\\s+', ' ', 'g')), '\\s+$', '') AS line FROM t),
m AS (SELECT conv_id, CASE WHEN length(line) > 80 THEN substr(line, 1, 80) || '…' ELSE line END AS name FROM n)
SELECT s.conv_id, m.name, s.total_score + CASE WHEN m.name <> '' AND (contains(lower(m.name), 'the of') OR (contains(lower(m.name), 'the') AND contains(lower(m.name), 'of'))) THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS total_score, s.n_matches
FROM ({_search_sql("conversations", "conv_id", "the of")}) s JOIN m USING (conv_id)
""")
def search_title_bonus(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    items = c.groupBy("conv_id").agg(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("first"))
    items = items.select("conv_id", F.coalesce(T.truncate_name(F.col("first")), F.lit("")).alias("name"))
    return search.search(items, c.select("conv_id", "text"), "the of", ["conv_id"], name_raw="name").select("conv_id", "name", "total_score", "n_matches")


@query("""
WITH p AS (SELECT doc_id, text, regexp_split_to_array(text, '(?i)thing') AS parts FROM documents WHERE contains(lower(text), 'thing')),
k AS (SELECT doc_id, text, parts, unnest(range(1, len(parts))) AS i FROM p),
o AS (SELECT doc_id, text, i, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + 5 * (i - 1) AS BIGINT) AS s FROM k),
b AS (SELECT doc_id, i, text, greatest(0, s - 100) AS lo, least(length(text), s + 5 + 100) AS hi FROM o)
SELECT doc_id, CAST(i - 1 AS INT) AS pos, CASE WHEN lo > 0 THEN '...' ELSE '' END || trim(replace(substr(text, lo + 1, hi - lo), chr(10), ' ')) || CASE WHEN hi < length(text) THEN '...' ELSE '' END AS snippet FROM b
""")
def search_snippets(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where(T.matches_query(F.col("text"), "thing"))
    return docs.select("doc_id", F.posexplode(T.snippets(F.col("text"), "thing")).alias("pos", "snippet"))


@query("SELECT doc_id, regexp_replace(text, '(?i)(tion|the)', '<<\\1>>', 'g') AS marked FROM documents WHERE contains(lower(text), 'tion') AND contains(lower(text), 'the')")
def search_highlight(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where(T.matches_query(F.col("text"), "the tion"))
    return docs.select("doc_id", T.highlight(F.col("text"), ["the", "tion"]).alias("marked"))


@query("SELECT doc_id, regexp_replace(text, '(?i)(th|the|on|tion)', '<<\\1>>', 'g') AS marked FROM documents")
def search_highlight_order(spark, sf_dir):
    """Words of which one begins another: the one that comes first in the query is marked."""
    return read(spark, sf_dir, "documents").select("doc_id", T.highlight_query(F.col("text"), "th the on tion").alias("marked"))


@query("""
SELECT doc_id, s AS shown, CAST(greatest(n - 2, 0) AS INT) AS more FROM (
  SELECT doc_id, regexp_extract_all(text, '(?i)tion') AS m, len(regexp_extract_all(text, '(?i)tion')) AS n, CAST(least(2, len(regexp_extract_all(text, '(?i)tion'))) AS INT) AS s
  FROM documents WHERE contains(lower(text), 'tion'))
""")
def first_snippets(spark, sf_dir):
    found = search.matching_texts(read(spark, sf_dir, "documents").select("doc_id", "text"), "tion")
    cut = search.first_snippets(F.col("matches"))
    return found.select("doc_id", F.size(cut["shown"]).alias("shown"), cut["more"].alias("more"))


@query(_search_sql("documents", "doc_id", "thing with"))
def search_grams(spark, sf_dir):
    texts = read(spark, sf_dir, "documents").select("doc_id", "text")
    return _search(grams.narrowed(texts, grams.build(texts, ["doc_id"]), "thing with", ["doc_id"]), "thing with", "doc_id")


def _stored(spark, sf_dir):
    """Tables of the documents as files: built, then refreshed after removals, additions and rewrites."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", "text", "lang", "source")
    facts = {"size": F.octet_length("text").cast("long"), "content_hash": F.xxhash64("text")}
    old = d.where("doc_id % 7 <> 0").withColumns(facts)
    new = d.where("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit(" with a thing"))).otherwise(F.col("text"))).withColumns(facts)

    def extract(files):
        at = F.lit("2024-01-01T00:00:00Z")
        c = F.col
        return files.select(*normalize.item_row(c("path"), F.lit("llm"), c("path"), F.lit("conversation"), F.lit("claude"), c("lang"), at, at, F.lit(""), F.array("text"), host=c("source")))

    root = store.new_folder(spark, "index")
    store.refresh(spark, root, old, extract)
    return root, store.refresh(spark, root, new, extract)


_STORED = "(SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN text || ' with a thing' ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0)"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS path, total_score, n_matches FROM ({_search_sql(_STORED, 'doc_id', 'thing with')})")
def index_refreshed(spark, sf_dir):
    """A search over tables that were refreshed file by file is one over the files as they are now."""
    root, _ = _stored(spark, sf_dir)
    return store.search_index(spark, root, "thing with").select("path", "total_score", "n_matches")


@query("""SELECT change, count(*) AS n FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN 'new' WHEN doc_id % 5 = 0 THEN 'removed' WHEN doc_id % 11 = 0 THEN 'rewritten' ELSE 'same' END AS change
  FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 5 <> 0) GROUP BY change""")
def index_changes(spark, sf_dir):
    return _stored(spark, sf_dir)[1].groupBy("change").agg(F.count("*").alias("n"))


@query("SELECT gram, count(*) AS items FROM (SELECT DISTINCT conv_id, substr(lower(text), CAST(i AS BIGINT) + 1, 3) AS gram FROM (SELECT conv_id, text, unnest(range(length(lower(text)) - 2)) AS i FROM conversations WHERE length(lower(text)) >= 3)) GROUP BY gram")
def gram_frequencies(spark, sf_dir):
    return grams.frequencies(grams.build(read(spark, sf_dir, "conversations"), ["conv_id"]))


@query("SELECT CAST(NULL AS BIGINT) AS doc_id, '' AS side, 0 AS n_fields WHERE false")
def verify_plans(spark, sf_dir):
    """Rows in which the narrowed and the full search differ: none."""
    texts = read(spark, sf_dir, "documents").select("doc_id", "text")
    full = _search(texts, "ation the", "doc_id")
    fast = _search(grams.narrowed(texts, grams.build(texts, ["doc_id"]), "ation the", ["doc_id"]), "ation the", "doc_id")
    return search.compare_results(full, fast, ["doc_id"]).select("doc_id", "side", F.size("fields").alias("n_fields"))


@query("""
WITH i AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE text <> '') AS first, max(turn) AS updated FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, updated, trim(replace(first, chr(10), ' ')) AS f FROM i WHERE first IS NOT NULL)
SELECT conv_id, CASE WHEN length(f) > 200 THEN substr(f, 1, 200) || '...' ELSE f END AS preview, updated AS updated_at, 0.0::DOUBLE AS total_score FROM p
""")
def browse_preview(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    first = F.min_by("text", F.when(F.col("text") != "", F.col("turn")))
    items = c.groupBy("conv_id").agg(first.alias("first"), F.max("turn").alias("updated_at"))
    items = items.withColumn("preview", T.preview(F.array("first"))).withColumn("has_preview", F.col("first").isNotNull())
    return search.browse(items).select("conv_id", "preview", "updated_at", "total_score")


@query("SELECT doc_id, source, lang FROM documents WHERE source || '-' || lang IN ('src1-en', 'src2-fr')")
def uuid_lookup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("uuid", F.concat_ws("-", "source", "lang"))
    return search.by_uuid(docs, " SRC1-en , https://claude.ai/chat/src2-FR,").select("doc_id", "source", "lang")


@query("SELECT doc_id FROM documents WHERE NOT contains(lower(concat_ws(chr(10), source, text)), 'tion') AND NOT contains(lower(concat_ws(chr(10), source, text)), 'src1')")
def omit_filter(spark, sf_dir):
    return search.omit(read(spark, sf_dir, "documents"), ["TION", "src1"], ["source", "text"]).select("doc_id")


@query("""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS cwd FROM pages)
SELECT page_id, cwd FROM p WHERE regexp_matches(cwd, '^[^/]*\\.example\\.org/en(/|$)')
""")
def scope_under(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1).alias("cwd"))
    pages = pages.withColumn("place", F.regexp_replace("cwd", r"^[^/]*\.example\.org/", "/org/"))
    return search.scope(pages, "/org/en/", F.lit(True), "place").select("page_id", "cwd")


@query("""
SELECT doc_id, source, lang, CAST(row_number() OVER (ORDER BY (source <> 'src3'), n_chars DESC, doc_id) AS INT) AS rank
FROM documents WHERE contains(lower(text), 'thing') QUALIFY rank <= 40
""")
def host_float(spark, sf_dir):
    from pyspark.sql import Window

    docs = read(spark, sf_dir, "documents").where(T.matches_query(F.col("text"), "thing")).withColumnsRenamed({"source": "host", "n_chars": "total_score"})
    keys = search.ranked(docs, "score", path="doc_id", current_host="src3")
    first = search.top(docs.select("doc_id", "host", "lang", "total_score"), keys, 40)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*keys))).select("doc_id", F.col("host").alias("source"), "lang", "rank")  # 40 rows


@query("""
SELECT page_id, CASE WHEN starts_with(p, 'http/a/') THEN 'first' WHEN contains(p, '.example.org/') AND starts_with(p, split_part(p, '/', 1) || '/') THEN 'stored' ELSE 'stored' END AS host
FROM (SELECT page_id, regexp_replace(url, '^([a-z]+)://', '\\1/') AS p FROM pages) WHERE NOT starts_with(p, 'https/')
UNION ALL SELECT page_id, 'secure' AS host FROM pages WHERE starts_with(url, 'https://')
""")
def host_resolve(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^([a-z]+)://", "$1/").alias("path"), F.lit("stored").alias("host"))
    return search.prefix_hosts(pages, [("first", "http/a"), ("secure", "https"), ("late", "https")]).select("page_id", "host")


@query("""
SELECT doc_id, CASE WHEN n % 3 = 0 THEN 'current' WHEN n % 3 = 1 AND f <> '' AND substr(f, 1, greatest(1, length(f) // 2)) = f THEN 'current' WHEN n % 3 = 1 THEN 'stale' ELSE 'diverged' END AS freshness
FROM (SELECT doc_id, doc_id AS n, text AS f FROM documents WHERE text IS NOT NULL AND length(text) > 1)
""")
def view_freshness(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("text IS NOT NULL AND length(text) > 1")
    k = F.col("doc_id") % 3
    full = F.concat(F.lit("# t\n---\n"), "text")
    half = F.concat(F.lit("# t\n---\n"), F.substring(F.col("text"), F.lit(1), F.greatest(F.lit(1), F.floor(F.length("text") / 2).cast("int"))))
    cached = docs.select("doc_id", T.body_after_rule(F.when(k == 0, full).when(k == 1, half).otherwise(F.concat(full, F.lit("!")))).alias("body"))
    fresh = docs.select("doc_id", T.body_after_rule(full).alias("body"))
    return upkeep.view_freshness(cached, fresh, "doc_id")


@query("""
WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '/') AS path FROM pages),
d AS (SELECT DISTINCT 'h' || (page_id % 17) AS host, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, page_id % 23 AS rank FROM p WHERE page_id % 3 = 0)
SELECT page_id, coalesce((SELECT arg_min(d.host, lpad(d.rank::VARCHAR, 4, '0') || d.host) FROM d WHERE starts_with(p.path, rtrim(d.directory, '/') || '/') OR d.directory = '' AND starts_with(p.path, '/')), 'stored') AS host FROM p
""")
def host_directories(spark, sf_dir):
    """As many directories as a third of the pages; of those that hold a page the first in order names the host."""
    p = read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "/").alias("path"), F.lit("stored").alias("host"))
    sources = p.where("page_id % 3 = 0").select(F.concat(F.lit("h"), (F.col("page_id") % 17).cast("string")).alias("host"), F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("directory"), (F.col("page_id") % 23).alias("rank")).distinct()
    return search.directory_hosts(p, sources).select("page_id", "host")


@query("SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN lang = 'fr' THEN 'no reader for fr' ELSE 'nothing extracted' END AS reason, CASE WHEN doc_id % 7 <> 0 THEN 2 ELSE 1 END AS tries FROM documents WHERE doc_id % 5 <> 0 AND (lang = 'fr' OR coalesce(text, '') = '')")
def index_aside(spark, sf_dir):
    """Files that give nothing are set aside by two refreshes, and tried in both."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")
    d = d.withColumns({"size": F.octet_length("text").cast("long"), "content_hash": F.xxhash64("text")})

    def extract(files):
        c, at = F.col, F.lit("2024-01-01T00:00:00Z")
        rows = files.where("text <> '' OR lang = 'fr'")
        row = normalize.item_row(c("path"), F.lit("llm"), c("path"), F.lit("conversation"), F.lit("claude"), c("lang"), at, at, F.lit(""), F.array("text"), host=c("source"))
        return rows.select(*row, F.when(c("lang") == "fr", "no reader for fr").alias("problem"))

    root = store.new_folder(spark, "index")
    for part in ("doc_id % 7 <> 0", "doc_id % 5 <> 0"):
        store.refresh(spark, root, d.where(part), extract, buckets=16)
    return store.live(spark, root, "aside").select("path", "reason", "tries")
