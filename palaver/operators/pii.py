"""Personal data: findings by pattern, what is vetted, a denylist sweep, secrets by entropy, redaction."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import permute
from ..functions import text as T
from . import literals
from .numbering import kept

# The patterns, by label.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "ipv6": r"\b(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}\b",
    "mac": r"\b(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b",
    "home_path": r"/home/[A-Za-z0-9_.\-]+",
    "users_path": r"/Users/[A-Za-z0-9_.\-]+",
    "windows_path": r"[Cc]:\\Users\\[A-Za-z0-9_.\-]+",
    "url": r"https?://[^\s\"'<>)\]}]+",
    "secret_assign": r"(?i)(?:bearer|token|api[_\-]?key|secret|password|passwd|access[_\-]?key)\s*[=:]\s*[^\s\"',]{8,}",
    "aws_key": r"\bAKIA[0-9A-Z]{16}\b",
    "openai_key": r"\bsk-[A-Za-z0-9]{20,}\b",
    "jwt": r"\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}",
    "timezone": r"\b(?:Africa|America|Antarctica|Asia|Atlantic|Australia|Europe|Indian|Pacific)/[A-Za-z_]+(?:/[A-Za-z_]+)?",
}
# What is vetted.
HOME_USERS = ("user", "testuser", "u")
MAC_USERS = ("me",)
EMAIL_DOMAINS = ("example.com", "example.org", "example.net", "example.edu", "b.com")
EMAILS = ("git@github.com",)
URL_HOSTS = ("github.com", "claude.ai", "chatgpt.com", "openai.com", "anthropic.com")
TIMEZONE = "America/New_York"
IPS = ("127.0.0.1", "0.0.0.0", "255.255.255.255")
PRIVATE = ("10.", "192.168.", "172.16.")
HARD = ("email", "home_path", "users_path", "windows_path", "timezone", "aws_key", "openai_key", "jwt")
TOKEN = r"[A-Za-z0-9+/=_\-]{24,}"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
HEX40 = r"^[0-9a-fA-F]{40}$"


def may_hold(text: Column) -> dict[str, Column]:
    """By label, what a text must hold to match its pattern: much cheaper to look for than the pattern."""
    pair = text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]")
    has = lambda part: F.contains(text, F.lit(part))
    return {
        "email": has("@"), "ipv4": text.rlike(r"\d\.\d"), "ipv6": pair, "mac": pair, "home_path": has("/home/"), "users_path": has("/Users/"), "windows_path": has(":\\Users\\"), "url": has("://"),
        "secret_assign": text.rlike("(?i)(?:bearer|token|key|secret|passw)[a-z]*\\s*[=:]"), "aws_key": has("AKIA"), "openai_key": has("sk-"), "jwt": has("eyJ"), "timezone": text.rlike("[ac]/[A-Z_a-z]|(?:Europe|Indian)/"),
    }


def findings(records: DataFrame, line: str = "line", text: str = "text") -> DataFrame:
    """label, value, n, first_line of every match of every pattern. A pattern is only run over texts that
    hold what it can't do without."""
    none, may = F.array().cast("array<struct<label: string, value: string>>"), may_hold(F.col(text))

    def of(label: str, pattern: str) -> Column:
        found = F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(label).alias("label"), v.alias("value")))
        return F.when(may[label], found).otherwise(none)

    rows = records.select(F.col(line).alias("line"), F.explode(F.concat(*[of(name, p) for name, p in PATTERNS.items()])).alias("f"))
    return rows.groupBy("f.label", "f.value").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


def vetted(label: Column, value: Column) -> Column:
    """Is a finding a known placeholder? Secrets, MAC and IPv6 addresses and Windows paths never are."""
    low = F.lower(value)
    user = lambda prefix: F.substring_index(F.substring(value, len(prefix) + 1, 1 << 30), "/", 1)
    host = F.lower(F.substring_index(F.substring_index(F.regexp_replace(value, "^https?://", ""), "/", 1), ":", 1))
    ip = value.isin(*IPS) | reduce(lambda a, b: a | b, [F.startswith(value, F.lit(p)) for p in PRIVATE])
    return (
        F.when(label == "email", low.isin(*EMAILS) | F.substring_index(low, "@", -1).isin(*EMAIL_DOMAINS))
        .when(label == "home_path", user("/home/").isin(*HOME_USERS))
        .when(label == "users_path", user("/Users/").isin(*MAC_USERS))
        .when(label == "url", host.isin(*URL_HOSTS))
        .when(label == "timezone", value == TIMEZONE)
        .when(label == "ipv4", ip)
        .otherwise(F.lit(False))
    )


def novel(found: DataFrame) -> DataFrame:
    return found.where(~vetted(F.col("label"), F.col("value")))


def guard(found: DataFrame) -> DataFrame:
    """Hard failures; an empty result is clean."""
    return novel(found).where(F.col("label").isin(*HARD))


def denylist(records: DataFrame, needles: list[str], line: str = "line", text: str = "text") -> DataFrame:
    """needle, line of every record that holds it, without case. A configured list becomes expressions; for
    a table of needles see ``denylist_table``."""
    hits = F.array_compact(F.array(*[F.when(T.has_literal(F.col(text), n), F.lit(n)) for n in dict.fromkeys(filter(None, needles))]))
    return records.select(F.explode(hits).alias("needle"), F.col(line).alias("line"))


def denylist_table(records: DataFrame, needles: DataFrame, line: str = "line", text: str = "text") -> DataFrame:
    """The same for a table of needles (its first column) of any size."""
    return literals.holding(records, text, needles, line).toDF("needle", "line")


def entropy_tokens(records: DataFrame, least: float = 3.6, line: str = "line", text: str = "text") -> DataFrame:
    """token, first_line, entropy of long tokens that look random. Tokens are merged before they are measured."""
    tokens = records.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))).alias("token"), F.col(line).alias("line"))
    distinct = tokens.groupBy("token").agg(F.min("line").alias("first_line"))
    return distinct.where(~F.col("token").rlike(UUID) & ~F.col("token").rlike(HEX40)).withColumn("entropy", T.entropy(F.col("token"))).where(F.col("entropy") >= least)


#: Strings of a shape up to which its ids are masked in one task, and one in so many of them that an id may be
#: in larger shapes for masks that avoid all ids.
SMALL_SHAPE, SPARSE = 1 << 16, 8


def own_ids(text: Column) -> Column:
    """The ids that a log record gives: of the session and its commit, of a turn, of a call. Strings only."""
    record = F.try_parse_json(text)

    def field(at: str) -> Column:
        value = F.try_variant_get(record, at, "variant")
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(record, at, "string"))

    meta = field("$.type") == "session_meta"
    found = F.array_compact(F.array(F.when(meta, field("$.payload.id")), F.when(meta, field("$.payload.git.commit_hash")), field("$.payload.turn_id"), field("$.payload.call_id")))
    return F.filter(found, lambda i: i != "")


def masks(ids: DataFrame, salt: str = "") -> DataFrame:
    """id, mask: a mask of its shape for each different id, no two alike, whatever the ids' order.

    A mask is the next string in its shape's permuted cycle; where that is an id itself, the cycle is
    followed as one follows brackets, ids opening and other strings closing them, so that no two ids end at
    one string. Masks then are no ids, if ids are few among the strings of their shape: at most half of
    small shapes, one in ``SPARSE`` of larger ones. In a shape more crowded than that, masks are the next
    strings as they are, one to one still. An id without a letter or digit of its own stays."""
    ids = kept(ids.select("id").where("id IS NOT NULL").distinct())

    @F.pandas_udf("string")
    def next_(values: pd.Series) -> pd.Series:
        return values.map(lambda v: permute.step(v, salt))

    @F.pandas_udf("shape string, size double")
    def shaped(values: pd.Series) -> pd.DataFrame:
        shapes = values.map(permute.shape)
        return pd.DataFrame({"shape": shapes, "size": shapes.map(lambda s: float(permute.size(s)))})

    def small(group: pd.DataFrame) -> pd.DataFrame:
        """All ids of a small shape."""
        real, out = set(group["id"]), []
        avoid = 2 * len(real) <= permute.size(permute.shape(group["id"].iloc[0]))
        for value in group["id"]:
            mask, open_ = permute.step(value, salt), 1
            while avoid and (open_ := open_ + (1 if mask in real else -1)):
                mask = permute.step(mask, salt)
            out.append(mask)
        return pd.DataFrame({"id": group["id"], "mask": out})

    # Ids are few bytes and much work, so they are dealt to as many tasks as a shuffle has, not by their size.
    tasks = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = kept(ids.repartition(tasks, "id").withColumn("s", shaped("id")).select("id", "s.*"))
    done = rows.where(F.col("size") <= SMALL_SHAPE).groupBy("shape").applyInPandas(small, "id string, mask string")  # SMALL_SHAPE rows at most
    large = rows.where(F.col("size") > SMALL_SHAPE)
    crowded = large.groupBy("shape", "size").agg(F.count("*").alias("n")).where(F.col("n") * SPARSE > F.col("size")).select("shape")
    marked = large.join(crowded.withColumn("crowded", F.lit(True)), "shape", "left")
    open_ = kept(marked.repartition(tasks, "id").select("id", next_("id").alias("mask"), F.lit(1).alias("open"), F.col("crowded").isNotNull().alias("crowded")))
    done = kept(done.unionByName(open_.where("crowded").select("id", "mask")))
    open_ = open_.where("NOT crowded").drop("crowded")
    real = ids.select(F.col("id").alias("mask"), F.lit(1).alias("real"))
    while open_.limit(1).count():
        at = kept(open_.join(real, "mask", "left").select("id", "mask", (F.col("open") + F.when(F.col("real").isNotNull(), 1).otherwise(-1)).alias("open")))
        done = done.unionByName(at.where("open = 0").select("id", "mask"))
        open_ = kept(at.where("open > 0").withColumn("mask", next_("mask")))
    return done


def redact_logs(records: DataFrame, text: str = "text", home: str = "", zone: str = "", salt: str = "", table: DataFrame | None = None) -> DataFrame:
    """Logs with every id that any record gives masked in all of them, wherever it stands, alike everywhere and
    different from all others; the rest as in ``redact``. ``table`` (id, mask) replaces the masks."""
    if table is None:
        table = masks(records.select(F.explode(own_ids(F.col(text))).alias("id")), salt)
    masked = literals.replaced(records.withColumn(text, _at_home(F.col(text), home)), text, table.select("id", "mask"))
    return masked.withColumn(text, _neutral(F.col(text), "", zone))


def _at_home(c: Column, home: str) -> Column:
    return F.regexp_replace(c, T.quoted(home), "/home/user") if home else c


def _neutral(c: Column, home: str, zone: str) -> Column:
    c = _at_home(c, home)
    if zone:
        c = F.regexp_replace(c, T.quoted(zone), TIMEZONE)
    c = F.regexp_replace(c, r'("(?:used_percent|window_minutes|resets_at|resets_in_seconds)"\s*:\s*)[0-9.]+', "$10")
    return F.regexp_replace(c, r'("plan_type"\s*:\s*)"[^"]*"', "$1null")


def redact(records: DataFrame, columns: list[str], home: str = "", zone: str = "", salt: str = "") -> DataFrame:
    """UUIDs masked alike everywhere, other time zones made neutral, the home directory a placeholder, the
    plan null and rate-limit numbers zero. For ids of other shapes see ``redact_logs``."""

    def clean(c: Column) -> Column:
        c = _neutral(c, home, zone)
        ids = F.array_distinct(F.regexp_extract_all(c, F.lit(UUID.strip("^$")), F.lit(0)))
        return F.aggregate(ids, c, lambda acc, i: F.replace(acc, i, T.mask_id(i, salt)))

    return records.withColumns({c: clean(F.col(c)) for c in columns})


def digest(records: DataFrame, kind: Column, most: int = 200, text: str = "text", line: str = "line") -> DataFrame:
    """Each record as one short line with its kind."""
    flat = F.regexp_replace(F.col(text), r"\s+", " ")
    shown = F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most)), F.lit("…"))).otherwise(flat)
    return records.select(F.col(line).alias("line"), F.concat(F.lit("["), kind, F.lit("] "), shown).alias("digest"))


def clipped(text: Column, most: int) -> Column:
    """The first characters, and how many more there are; 0: all of them."""
    if most <= 0:
        return text
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("  …[+"), (F.length(text) - most).cast("string"), F.lit(" chars]"))).otherwise(text)


def _shown(value: Column) -> Column:
    """A variant as text: strings as they are, objects and lists as compact JSON; null if there is none."""
    kind = F.schema_of_variant(value)
    plain = F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(kind == "BOOLEAN", F.initcap(F.try_variant_get(value, "$", "string")))
    return F.when(value.isNotNull() & (kind != "VOID"), F.coalesce(plain, F.to_json(value)))


def _content_text(content: Column) -> Column:
    """The texts of a list of blocks, joined by spaces; anything else as text."""
    def one(block: Column) -> Column:
        first = F.coalesce(*[T.blank_to_null(_shown(F.try_variant_get(block, f"$.{k}", "variant"))) for k in ("text", "input_text")])
        return F.coalesce(first, _shown(block), F.lit("None"))

    blocks = F.try_variant_get(content, "$", "array<variant>")
    return F.coalesce(F.array_join(F.transform(blocks, one), " "), _shown(content), F.lit("None"))


def legible(records: DataFrame, most: int = 400, text: str = "text", line: str = "line") -> DataFrame:
    """line, digest: each rollout record as a heading and what a reader needs of its type: ids and places of a
    session, the settings of a turn, messages, commands with their folder, outputs, summaries, patches, token
    totals; of other types the payload. Long parts are clipped. Records that are no JSON objects give null."""
    record = F.try_parse_json(text)
    at = lambda path: F.try_variant_get(F.col("v_"), path, "variant")
    said = lambda path: F.coalesce(_shown(at(path)), F.lit("None"))
    filled = lambda path: T.blank_to_null(_shown(at(path)))
    clip = lambda c: clipped(c, most)
    joined = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    kind, payload = F.col("kind_"), F.col("payload_")

    arguments = F.try_parse_json(filled("$.payload.arguments"))
    of_call = lambda k: T.blank_to_null(_shown(F.try_variant_get(arguments, f"$.{k}", "variant")))
    is_object = F.startswith(F.schema_of_variant(arguments), F.lit("OBJECT"))
    command = F.coalesce(F.when(is_object, F.coalesce(of_call("cmd"), of_call("command"))).otherwise(filled("$.payload.arguments")), F.lit("None"))
    changes = F.map_entries(F.try_variant_get(at("$.payload.changes"), "$", "map<string, variant>"))
    patches = F.transform(changes, lambda e: joined("  ", e["key"], ": ", clipped(F.coalesce(_shown(F.try_variant_get(e["value"], "$.unified_diff", "variant")), F.lit("")), most // 2)))
    summary = _content_text(at("$.payload.summary"))
    cited = F.when(filled("$.payload.memory_citation").isNotNull(), joined("\n  memory_citation: ", clip(filled("$.payload.memory_citation")))).otherwise("")
    body = (
        F.when(kind == "session_meta", joined(
            "id=", said("$.payload.id"), " cwd=", said("$.payload.cwd"), " cli=", said("$.payload.cli_version"), " provider=", said("$.payload.model_provider"),
            "\ngit: branch=", said("$.payload.git.branch"), " commit=", said("$.payload.git.commit_hash"), " url=", said("$.payload.git.repository_url"),
            "\nbase_instructions: ", clip(F.coalesce(_shown(at("$.payload.base_instructions.text")), F.lit("")))))
        .when(kind == "turn_context", joined("cwd=", said("$.payload.cwd"), " tz=", said("$.payload.timezone"), " date=", said("$.payload.current_date"), " model=", said("$.payload.model"), " approval=", said("$.payload.approval_policy")))
        .when(payload == "message", joined("[", said("$.payload.role"), "] ", clip(_content_text(at("$.payload.content")))))
        .when(payload.isin("user_message", "agent_message"), joined(clip(F.coalesce(filled("$.payload.message"), filled("$.payload.text"), F.lit(""))), cited))
        .when(payload == "function_call", joined("[", said("$.payload.name"), "] cwd=", F.coalesce(F.when(is_object, of_call("workdir")), F.lit("None")), "\n  $ ", clip(command)))
        .when(payload.isin("function_call_output", "custom_tool_call_output"), clip(said("$.payload.output")))
        .when(payload == "custom_tool_call", joined("[", said("$.payload.name"), "] status=", said("$.payload.status"), "\n", clip(said("$.payload.input"))))
        .when(payload == "reasoning", F.when(filled("$.payload.summary").isNotNull() & (F.trim(summary) != ""), clip(summary)).otherwise("(no summary; encrypted_content=<encrypted>)"))
        .when(payload == "patch_apply_end", joined("status=", said("$.payload.status"), " success=", said("$.payload.success"), " files=", F.coalesce(F.size(changes), F.lit(0)).cast("string"), "\n", F.coalesce(F.array_join(patches, "\n"), F.lit(""))))
        .when(payload == "token_count", joined("total_tokens=", said("$.payload.info.total_token_usage.total_tokens"), " plan=", said("$.payload.rate_limits.plan_type")))
        .otherwise(clip(said("$.payload")))
    )
    head = joined("--- line ", F.col(line).cast("string"), ": ", F.coalesce(kind, F.lit("None")), " / ", F.coalesce(payload, F.lit("None")), " ---\n")
    parsed = records.select(F.col(line).alias(line), record.alias("v_")).withColumns({"kind_": _shown(F.try_variant_get("v_", "$.type", "variant")), "payload_": _shown(F.try_variant_get("v_", "$.payload.type", "variant"))})
    return parsed.select(F.col(line).alias("line"), F.when(F.startswith(F.schema_of_variant("v_"), F.lit("OBJECT")), F.concat(head, body)).alias("digest"))
