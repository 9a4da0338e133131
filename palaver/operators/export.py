"""Bulk export: where each item goes, the documents, and the manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..functions.text import UNTITLED, blank_to_null
from ..sources import exports
from ..sources.providers import is_local_cli, label, shell_quote
from .numbering import fresh, kept, numbered


def export_group(provider: Column, host: Column, email: Column) -> Column:
    """Host of a local session, account of a web item."""
    return F.when(is_local_cli(provider), F.coalesce(blank_to_null(host), F.lit("unknown-host"))).otherwise(F.coalesce(blank_to_null(email), F.lit("unknown")))


def plan(items: DataFrame, extension: str = "md") -> DataFrame:
    """Adds grp and rel_path to every item, also to those without an id or with one that repeats. In a
    directory, items with one stem are told apart by -2, -3, ... in order of time and id. Where a name
    made so is also the natural name of another item, the items of that directory whose stems differ
    only in such endings are named one after another, since which names are taken then depends on the
    order: they stream through one task, which keeps a counter for each stem. All other columns pass."""
    rows = items.withColumn("grp", export_group(F.col("provider"), F.col("host"), F.col("email")))
    top, stem, k, named, family, again = fresh(rows, "dir", "stem", "k", "named", "family", "again")
    rows = rows.withColumns({top: F.concat_ws("/", "provider", "grp", F.concat("item_type", F.lit("s"))), stem: times.file_stem(F.col("created_at"), F.col("name"))})
    rows = numbered(rows, [top, stem], ["created_at", "uuid"], k)
    rows = rows.withColumns({named: F.when(F.col(k) == 1, F.col(stem)).otherwise(F.concat(stem, F.lit("-"), F.col(k).cast("string"))), family: F.regexp_replace(stem, r"(-\d+)+$", "")})
    made = rows.where(F.col(k) > 1).select(top, F.col(named).alias(stem)).distinct()
    clash = kept(rows.where(F.col(k) == 1).join(made, [top, stem], "left_semi").select(top, family).distinct())
    if clash.limit(1).count():
        hard = rows.join(clash, [top, family], "left_semi").select(F.col(top).alias("dir"), F.col(family).alias("family"), "created_at", "uuid", F.col(k).alias("k"), F.col(stem).alias("stem"))
        dealt = hard.repartition("dir", "family").sortWithinPartitions("dir", "family", "created_at", "uuid", "stem", "k").select("dir", "family", "stem", "k")
        names = dealt.mapInPandas(_one_by_one, "dir string, stem string, k long, again string").toDF(top, stem, k, again)
        rows = rows.join(names, [top, stem, k], "left").withColumn(named, F.coalesce(again, named)).drop(again)
    return rows.withColumn("rel_path", F.concat(top, F.lit("/"), named, F.lit("." + extension))).drop(top, stem, k, named, family)


def _one_by_one(batches):
    """Names in the order of rows, which come by directory and family. All names from a stem's first one up
    to its counter are taken, by its own items or by others."""
    family, counter, natural = None, {}, set()

    def taken(name: str) -> bool:
        base, dash, k = name.rpartition("-")
        given = dash and k.isdigit() and not k.startswith("0") and 2 <= int(k) < counter.get(base, 2)
        return bool(given) or name in natural

    for part in batches:
        names = []
        for key, stem in zip(zip(part["dir"], part["family"], strict=True), part["stem"], strict=True):
            if key != family:
                family, counter, natural = key, {}, set()
            if taken(stem):
                k = counter.get(stem, 2)
                while f"{stem}-{k}" in natural or counter.get(f"{stem}-{k}", 2) > 2:
                    k += 1
                name, counter[stem] = f"{stem}-{k}", k + 1
            else:
                natural.add(name := stem)
            names.append(name)
        yield part[["dir", "stem", "k"]].assign(again=names)


def planned_counts(planned: DataFrame) -> DataFrame:
    """A dry run: how many documents each provider would get."""
    return planned.groupBy(label(F.col("provider")).alias("provider")).agg(F.count("*").alias("n"))


def _entries(written: DataFrame) -> DataFrame:
    day = F.coalesce(blank_to_null(F.substring("created_at", 1, 10)), F.lit("????-??-??"))
    name = F.coalesce(blank_to_null(F.col("name")), F.lit(UNTITLED))
    line = F.concat(F.lit("- "), day, F.lit(" — ["), name, F.lit("]("), "rel_path", F.lit(")"), F.when(F.col("item_type") == "project", " *(project)*").otherwise(""))
    return written.select("provider", "grp", F.coalesce("created_at", F.lit("")).alias("t"), F.col("rel_path").alias("p"), line.alias("line"))


def _heading() -> Column:
    return F.concat(F.lit("## "), label(F.col("provider")), F.lit(" / "), "grp", F.lit("\n"))


def manifest(written: DataFrame) -> DataFrame:
    """provider, grp, section: the lines of the index for each group, newest first. A section is one
    value, built by one task; for groups of any size take ``manifest_lines``."""
    entry = F.struct("t", "p", "line")
    newest = F.transform(F.sort_array(F.collect_list(entry), asc=False), lambda e: e["line"])
    return _entries(written).groupBy("provider", "grp").agg(newest.alias("lines")).select("provider", "grp", F.concat(_heading(), F.lit("\n"), F.array_join("lines", "\n"), F.lit("\n")).alias("section"))


def manifest_lines(written: DataFrame) -> DataFrame:
    """provider, grp, line_no, line: the same as rows, so that no group has to fit into a task. Line 0 is
    the heading with the empty line after it; entries count from 1, newest first."""
    entries, group = _entries(written), ["provider", "grp"]
    lines = numbered(entries.where("line IS NOT NULL"), group, [F.desc("t"), F.desc("p"), "line"], "line_no")
    heads = entries.select(*group).distinct().select(*group, F.lit(0).cast("long").alias("line_no"), _heading().alias("line"))
    return lines.select(*group, "line_no", "line").unionByName(heads)


# Documents ----------------------------------------------------------------------------------------


def attachment_summary(attachments: Column, files: Column) -> Column:
    """``2 files: a, b``; null without any. Both lists hold the same uploads, so the longer one counts."""
    none = F.array().cast(f"array<{exports.FILE}>")
    a, b = F.coalesce(attachments, none), F.coalesce(files, none)
    n = F.greatest(F.size(a), F.size(b))
    names = F.array_sort(F.array_distinct(F.filter(F.transform(F.concat(a, b), lambda x: x["file_name"]), lambda x: x.isNotNull() & (x != ""))))
    text = F.concat(n.cast("string"), F.when(n == 1, " file").otherwise(" files"), F.when(F.size(names) > 0, F.concat(F.lit(": "), F.array_join(names, ", "))).otherwise(""))
    return F.when(n > 0, text)


def _line(text: Column | str) -> Column:
    return F.concat(F.lit(text) if isinstance(text, str) else text, F.lit("\n"))


def _head(name: Column, fields: list[tuple[str, Column]]) -> Column:
    """Title and facts; a fact that is null is left out."""
    facts = [F.coalesce(_line(F.concat(F.lit(f"**{k}:** "), v, F.lit("  "))), F.lit("")) for k, v in fields]
    return F.concat(_line(F.concat(F.lit("# "), F.coalesce(blank_to_null(name), F.lit(UNTITLED)), F.lit("\n"))), *facts, F.lit("\n---\n"))


def _code(c: Column) -> Column:
    return F.concat(F.lit("`"), c, F.lit("`"))


def _paragraph(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit("\n\n"), c, F.lit("\n"))).otherwise("")


def conversation_markdown(item: Column, zone: str = "UTC") -> Column:
    """A conversation as a document: a heading, text and differing blocks for each message."""

    def message(m: Column) -> Column:
        texts = F.filter(F.coalesce(m["content"], F.array().cast(f"array<{exports.BLOCK}>")), lambda b: (b["type"] == "text") & (F.coalesce(b["text"], F.lit("")) != "") & ~b["text"].eqNullSafe(m["text"]))
        more = F.array_join(F.transform(texts, lambda b: _paragraph(b["text"])), "")
        uploads = F.coalesce(F.concat(F.lit("\n\n*📎 "), attachment_summary(m["attachments"], m["files"]), F.lit("*\n")), F.lit(""))
        who = F.when(m["sender"] == "human", "**User**").otherwise("**Assistant**")
        return F.concat(F.lit("\n\n## "), who, F.lit("\n\n*"), times.display(m["created_at"], zone), F.lit("*\n"), _paragraph(m["text"]), more, uploads, F.lit("\n\n---\n"))

    head = _head(item["name"], [("UUID", _code(F.coalesce(item["uuid"], F.lit("unknown")))), ("Created", times.display(item["created_at"], zone)), ("Updated", times.display(item["updated_at"], zone)), ("Summary", blank_to_null(item["summary"]))])
    return F.concat(head, F.array_join(F.transform(F.coalesce(item["chat_messages"], F.array().cast(f"array<{exports.MESSAGE}>")), message), ""))


def project_markdown(item: Column, zone: str = "UTC") -> Column:
    def doc(d: Column) -> Column:
        at = F.when(blank_to_null(d["created_at"]).isNotNull(), F.concat(F.lit("\n*"), times.display(d["created_at"], zone), F.lit("*\n"))).otherwise("")
        return F.concat(F.lit("\n\n## 📄 "), F.coalesce(d["filename"], F.lit("(unnamed doc)")), F.lit("\n"), at, _paragraph(d["content"]), F.lit("\n\n---\n"))

    head = _head(item["name"], [("UUID", _code(F.coalesce(item["uuid"], F.lit("unknown")))), ("Created", times.display(item["created_at"], zone)), ("Updated", times.display(item["updated_at"], zone)), ("Description", blank_to_null(item["description"]))])
    prompt = F.when(F.coalesce(item["prompt_template"], F.lit("")) != "", F.concat(F.lit("\n\n## Prompt template\n"), _paragraph(item["prompt_template"]), F.lit("\n\n---\n"))).otherwise("")
    return F.concat(head, prompt, F.array_join(F.transform(F.coalesce(item["docs"], F.array().cast(f"array<{exports.DOC}>")), doc), ""))


def transcript_markdown(metadata: DataFrame, turns: DataFrame, resume: Column, key: str = "path", zone: str = "UTC") -> DataFrame:
    """key, body: a session's facts and its turns, in order."""
    tools = F.when(F.size("tool_uses") > 0, F.concat(F.lit("\n\n*Tools used: "), F.array_join("tool_uses", ", "), F.lit("*\n"))).otherwise("")
    body = F.concat(F.lit("\n\n## "), F.initcap("role"), F.lit("\n\n*"), times.display(F.col("ts"), zone), F.lit("*\n"), _paragraph(F.col("content")), tools, F.lit("\n\n---\n"))
    joined = turns.select(key, F.struct("turn_no", body.alias("b")).alias("t")).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["b"]), "").alias("turns"))
    cwd = F.coalesce("cwd", F.lit("~"))
    command = F.concat(F.lit("cd "), shell_quote(cwd), F.lit(" && "), resume)
    head = _head(F.col("name"), [("Session", _code(F.col("session_id"))), ("Directory", _code(cwd)), ("Branch", _code(blank_to_null(F.col("git_branch")))), ("Created", times.display(F.col("created_at"), zone)), ("Updated", times.display(F.col("updated_at"), zone)), ("Resume", _code(command))])
    return metadata.join(joined, key, "left").select(key, F.concat(head, F.coalesce("turns", F.lit(""))).alias("body"))
