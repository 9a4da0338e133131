"""Exports and logs to items, texts and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import times
from ..sources import exports
from ..sources.providers import is_local_cli

# Beginnings of user lines that a program wrote.
MACHINE_PREFIXES = ("<local-command-caveat>", "<local-command-stdout>", "<local-command-stderr>", "<task-notification>")
#: Bumped when an extractor changes: derived tables of another version are rebuilt.
EXTRACTOR_VERSION = 1


def _filled(texts: Column) -> Column:
    return F.filter(texts, lambda t: t.isNotNull() & (t != ""))


def conversation_texts(item: Column) -> Column:
    """Name, summary, then each message's text and its blocks' texts, in order."""
    messages = F.transform(F.coalesce(item["chat_messages"], F.array().cast(f"array<{exports.MESSAGE}>")), lambda m: F.concat(F.array(m["text"]), F.coalesce(m["content"]["text"], F.array().cast("array<string>"))))
    return _filled(F.concat(F.array(item["name"], item["summary"]), F.flatten(messages)))


def thread_texts(item: Column) -> Column:
    """Title, another name, summary, then the string parts of text nodes in mapping order."""
    empty = F.array().cast("array<string>")

    def parts(node: Column) -> Column:
        content = node["message"]["content"]
        each = F.coalesce(F.try_variant_get(content["parts"], "$", "array<variant>"), F.array().cast("array<variant>"))
        strings = F.transform(F.filter(each, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))
        return F.when(content["content_type"].isin("text", "multimodal_text"), strings).otherwise(empty)

    nodes = F.flatten(F.transform(F.coalesce(F.map_values(item["mapping"]), F.array().cast(f"array<{exports.NODE}>")), parts))
    other = F.when(~item["name"].eqNullSafe(item["title"]), item["name"])
    return _filled(F.concat(F.array(item["title"], other, item["summary"]), nodes))


def project_texts(item: Column) -> Column:
    docs = F.transform(F.coalesce(item["docs"], F.array().cast(f"array<{exports.DOC}>")), lambda d: F.array(d["filename"], d["content"]))
    return _filled(F.concat(F.array(item["name"], item["description"], item["prompt_template"]), F.flatten(docs)))


def normalized_threads(threads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, errors): id and a time are required; a null title becomes an empty name. There is no
    time of update, unless asked for by ``updated_at``'s rule."""
    when = F.coalesce("item.create_time", "item.update_time")
    problem = F.when(F.coalesce(F.col("item.id"), F.lit("")) == "", "missing id").when(when.isNull(), "missing create_time and update_time")
    rows = threads.withColumn("problem", problem)
    items = rows.where(F.col("problem").isNull()).select(F.col("item.id").alias("uuid"), F.coalesce("item.title", F.lit("")).alias("name"), times.to_utc_iso(when).alias("created_at"), times.to_utc_iso(F.col("item.update_time")).alias("export_updated_at"), "item", "raw")
    return items, rows.where(F.col("problem").isNotNull()).select("path", F.col("pos").cast("long").alias("line_no"), F.col("problem").alias("reason"))


def updated_at(item: Column) -> Column:
    """The last message's time if it has one, else the item's update, else its creation."""
    last = F.try_element_at(item["chat_messages"], F.lit(-1))["created_at"]
    return F.coalesce(T.blank_to_null(last), item["updated_at"], item["created_at"])


def item_row(path: Column, source: Column, uuid: Column, item_type: Column, provider: Column, name: Column, created: Column, updated: Column, email: Column, texts: Column, model: Column | None = None, host: Column | None = None, cwd: Column | None = None, branch: Column | None = None) -> list[Column]:
    """The columns of the items table, and ``texts``."""
    none = F.lit("")
    raw = F.coalesce(name, none)
    shown = T.preview(texts)
    return [
        path.alias("path"), source.alias("source"), uuid.alias("uuid"), item_type.alias("item_type"), provider.alias("provider"),
        F.when(raw == "", T.UNTITLED).otherwise(raw).alias("name"), raw.alias("name_raw"), created.alias("created_at"), updated.alias("updated_at"),
        F.coalesce(email, none).alias("email"), (none if model is None else F.coalesce(model, none)).alias("model"),
        (none if host is None else F.coalesce(host, none)).alias("host"), (none if cwd is None else F.coalesce(cwd, none)).alias("cwd"),
        (none if branch is None else F.coalesce(branch, none)).alias("git_branch"), F.coalesce(shown, none).alias("preview"), shown.isNotNull().alias("has_preview"), texts.alias("texts"),
    ]


def archive_items(archive: DataFrame) -> DataFrame:
    """Items with texts of an archive scan; the shape follows from type and provider."""
    llm = F.lit("llm")
    talk = archive.where("item_type = 'conversation' AND provider <> 'chatgpt'").withColumn("item", F.from_json("value", exports.CONVERSATION))
    tree = archive.where("item_type = 'conversation' AND provider = 'chatgpt'").withColumn("item", F.from_json("value", exports.THREAD))
    book = archive.where("item_type = 'project'").withColumn("item", F.from_json("value", exports.PROJECT))
    i, c = F.col("item"), F.col
    created = times.to_utc_iso(F.coalesce(i["create_time"], i["update_time"]))
    return (
        talk.select(*item_row(c("path"), llm, i["uuid"], c("item_type"), c("provider"), i["name"], i["created_at"], updated_at(i), c("email"), conversation_texts(i)))
        .unionByName(tree.select(*item_row(c("path"), llm, i["id"], c("item_type"), c("provider"), i["title"], created, created, c("email"), thread_texts(i), model=thread_model(i))))
        .unionByName(book.select(*item_row(c("path"), llm, i["uuid"], c("item_type"), c("provider"), i["name"], i["created_at"], F.coalesce(i["updated_at"], i["created_at"]), c("email"), project_texts(i))))
    )


def thread_model(item: Column) -> Column:
    """The model most messages name; of equals, the first."""
    models = _filled(F.transform(F.coalesce(F.map_values(item["mapping"]), F.array().cast(f"array<{exports.NODE}>")), lambda n: n["message"]["metadata"]["model_slug"]))
    counted = F.transform(F.array_distinct(models), lambda m, k: F.struct(F.size(F.filter(models, lambda x: x == m)).alias("n"), (-k).alias("k"), m.alias("m")))
    return F.array_max(counted)["m"]


def searchable_body(texts: Column) -> Column:
    return F.lower(F.array_join(F.filter(texts, lambda t: t != ""), "\n"))


def exploded_texts(items: DataFrame) -> DataFrame:
    return items.select("path", F.posexplode("texts").alias("pos", "text"))


# Session logs -------------------------------------------------------------------------------------


def command_of(content: Column) -> Column:
    """The slash command that tags in a line stand for; null without the name tag."""
    name = F.regexp_extract(content, "(?s)<command-name>(.*?)</command-name>", 1)
    args = F.regexp_extract(content, "(?s)<command-args>(.*?)</command-args>", 1)
    has = content.rlike("(?s)<command-name>.*?</command-name>")
    return F.when(has, T.ws_trim(F.concat_ws(" ", T.ws_trim(name), T.ws_trim(args))))


def _string(v: Column, at: str) -> Column:
    """A string field of a variant; null if it is of another type."""
    field = F.try_variant_get(v, at, "variant")
    return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(v, at, "string"))


def user_text(v: Column) -> Column:
    """What a person typed in a user line, else null."""
    content = _string(v, "$.message.content")
    typed = (F.try_variant_get(v, "$.type", "string") == "user") & ~F.coalesce(F.try_variant_get(v, "$.isMeta", "boolean"), F.lit(False)) & (T.ws_trim(content) != "")
    head = F.regexp_replace(content, r"(?U)^\s+", "")
    for p in MACHINE_PREFIXES:
        typed = typed & ~F.startswith(head, F.lit(p))
    return F.when(typed, F.coalesce(command_of(content), content))


def session_events(lines: DataFrame) -> DataFrame:
    """One row for each event of a session log line ``v``: path, line_no, ev_no, kind (user, open,
    text, tool), value, ts."""
    v = F.col("v")
    base = lines.select("path", "line_no", v.alias("v"), F.coalesce(F.try_variant_get(v, "$.timestamp", "string"), F.lit("")).alias("ts"), F.try_variant_get(v, "$.type", "string").alias("type"))
    event = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    blocks = F.coalesce(F.try_variant_get("v", "$.message.content", "array<variant>"), F.array().cast("array<variant>"))

    def block(b: Column) -> Column:
        kind, text, name = F.try_variant_get(b, "$.type", "string"), F.try_variant_get(b, "$.text", "string"), F.try_variant_get(b, "$.name", "string")
        return F.when((kind == "text") & (text != ""), event("text", text)).when((kind == "tool_use") & (name != ""), event("tool", name))

    of_assistant = F.concat(F.array(event("open", F.lit(None).cast("string"))), F.filter(F.transform(blocks, block), lambda e: e.isNotNull()))
    typed = user_text(F.col("v"))
    events = F.when((F.col("type") == "user") & (typed != ""), F.array(event("user", typed))).when(F.col("type") == "assistant", of_assistant)
    return base.select("path", "line_no", "ts", F.posexplode(events).alias("ev_no", "e")).select("path", "line_no", "ev_no", "e.kind", "e.value", "ts")


def rollout_events(lines: DataFrame) -> DataFrame:
    """The same for rollout lines: typed and answered messages, and tool calls."""
    v = F.col("v")
    kind, payload = F.try_variant_get(v, "$.type", "string"), F.try_variant_get(v, "$.payload.type", "string")
    message, name = _string(v, "$.payload.message"), F.try_variant_get(v, "$.payload.name", "string")
    said = (kind == "event_msg") & (T.ws_trim(message) != "")
    what = F.when(said & (payload == "user_message"), "user").when(said & (payload == "agent_message"), "text").when((kind == "response_item") & payload.isin("function_call", "custom_tool_call") & (name != ""), "tool")
    return lines.select("path", "line_no", F.lit(0).alias("ev_no"), what.alias("kind"), F.when(what == "tool", name).otherwise(message).alias("value"), F.coalesce(F.try_variant_get(v, "$.timestamp", "string"), F.lit("")).alias("ts")).where(F.col("kind").isNotNull())


def event_texts(events: DataFrame) -> DataFrame:
    """Searchable texts of sessions: what was typed and answered, not tools or thoughts."""
    return events.where(F.col("kind").isin("user", "text")).select("path", (F.shiftleft(F.col("line_no").cast("long"), 32) + F.col("ev_no")).alias("pos"), F.col("value").alias("text"))


def session_metadata(lines: DataFrame) -> DataFrame:
    """path, session_id, cwd, git_branch, created_at, updated_at and name of each session log. The branch is
    the first one named until id and directory are both known; the creation is the time of the first
    user line with text, whatever it is; without any time after it, that is the update too."""
    v = F.col("v")
    s = lambda at: T.blank_to_null(F.try_variant_get(v, at, "string"))
    content = _string(v, "$.message.content")
    typed, kind = user_text(v), s("$.type")
    command = command_of(F.when(kind == "user", content).when(kind == "system", _string(v, "$.content")))
    prose = F.when(command_of(content).isNull(), typed)
    rows = lines.select("path", "line_no", s("$.sessionId").alias("sid"), s("$.cwd").alias("cwd"), s("$.gitBranch").alias("branch"), s("$.timestamp").alias("ts"), ((kind == "user") & (T.ws_trim(content) != "")).alias("asked"), prose.alias("prose"), T.blank_to_null(command).alias("command"))
    at = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    line = lambda c: F.min(F.when(F.col(c).isNotNull(), F.col("line_no")))
    first = F.min_by("ts", F.when(F.col("asked"), F.col("line_no")))
    last = F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("line_no")))
    known = F.when(line("sid").isNotNull() & line("cwd").isNotNull(), F.greatest(line("sid"), line("cwd")))
    branch = F.when(known.isNull() | (line("branch") <= known), at("branch"))
    found = rows.groupBy("path").agg(at("sid").alias("session_id"), at("cwd").alias("cwd"), branch.alias("git_branch"), first.alias("created_at"), F.coalesce(last, first).alias("updated_at"), at("prose").alias("prose"), at("command").alias("command"))
    name = F.coalesce(T.truncate_name(F.col("prose")), T.truncate_name(F.col("command")), F.lit(T.UNTITLED))
    return found.withColumn("name", name).drop("prose", "command")


def rollout_metadata(lines: DataFrame) -> DataFrame:
    """The same for rollouts, all from the first session_meta record; they have no branch."""
    v = F.col("v")
    s = lambda at: T.blank_to_null(F.try_variant_get(v, at, "string"))
    meta, typed = s("$.type") == "session_meta", (s("$.type") == "event_msg") & (s("$.payload.type") == "user_message")
    message = _string(v, "$.payload.message")
    rows = lines.select("path", "line_no", s("$.timestamp").alias("ts"), F.when(meta, F.struct(s("$.payload.id").alias("id"), s("$.payload.cwd").alias("cwd"), s("$.payload.timestamp").alias("created"))).alias("meta"), F.when(typed & (T.ws_trim(message) != ""), message).alias("typed"))
    at = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    created, last = F.coalesce(at("meta")["created"], at("ts")), F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("line_no")))
    found = rows.groupBy("path").agg(at("meta")["id"].alias("session_id"), at("meta")["cwd"].alias("cwd"), F.lit("").alias("git_branch"), created.alias("created_at"), F.coalesce(last, created).alias("updated_at"), at("typed").alias("typed"))
    return found.withColumn("name", F.coalesce(T.truncate_name(F.col("typed")), F.lit(T.UNTITLED))).drop("typed")


def session_models(lines: DataFrame, at: str = "$.message.model", kind: str = "assistant") -> DataFrame:
    """path, model: the one most lines of a kind name (of equals the earliest); synthetic and empty ones aside."""
    of_kind = lines.where(F.try_variant_get("v", "$.type", "string") == kind)
    named = of_kind.select("path", "line_no", F.try_variant_get("v", at, "string").alias("model")).where("model <> '' AND model <> '<synthetic>'")
    return dominant(named, "path", "model", "line_no")


def rollout_models(lines: DataFrame) -> DataFrame:
    """The same for rollouts, where only the records that open a turn name the model."""
    return session_models(lines, "$.payload.model", "turn_context")


def dominant(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Most frequent value of each group; of equals, the one that comes first."""
    counted = rows.groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counted.groupBy(group).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))


def session_items(metadata: DataFrame, events: DataFrame, files: DataFrame, models: DataFrame, provider: str) -> DataFrame:
    """Items with texts of session logs; those that only count for tools are left out."""
    texts = event_texts(events).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda t: t["text"]).alias("texts"))
    rows = files.where(F.col("source") == provider).select("path", "source", "host", "email").join(metadata, "path").join(models, "path", "left").join(texts, "path", "left")
    c = F.col
    texts = F.coalesce("texts", F.array().cast("array<string>"))
    return rows.select(*item_row(c("path"), c("source"), c("session_id"), F.lit("conversation"), F.lit(provider), F.when(c("name") != T.UNTITLED, c("name")), c("created_at"), c("updated_at"), c("email"), texts, c("model"), c("host"), c("cwd"), c("git_branch")))


def results(items: DataFrame) -> DataFrame:
    """Items as results: cwd, branch and host only for local sessions."""
    extra = F.when(is_local_cli(F.col("provider")), F.struct("cwd", "git_branch", "host"))
    return items.withColumn("extra", extra).drop("cwd", "git_branch", "host")
