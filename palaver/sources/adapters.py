"""One adapter for each kind of source, so that a new kind is a row of a table.

A log adapter turns parsed lines into events, metadata and models of sessions; an export adapter turns a
landed batch into records, the errors of its contract, items with texts, and accounts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import normalize, quality
from . import exports, logs, sessions

Frames = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class SourceAdapter:
    """Session logs. ``lines`` reads (lines, bad files) of all hosts; the others take parsed lines with path, line_no, v."""

    token: str
    lines: Callable[[SparkSession, list[tuple[str, str]]], tuple[DataFrame, DataFrame]]
    events: Frames
    metadata: Frames
    models: Frames

    def read(self, spark: SparkSession, sources: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
        """(parsed lines, what was set aside with its reason)."""
        lines, bad_files = self.lines(spark, sources)
        good, bad = sessions.parsed_lines(lines)
        return good, bad_files.unionByName(bad)

    def items(self, parsed: DataFrame) -> DataFrame:
        files = parsed.select("path", "source", "host", "email").distinct()
        return normalize.session_items(self.metadata(parsed), self.events(parsed), files, self.models(parsed), self.token)


@dataclass(frozen=True)
class ExportAdapter:
    """Web exports. ``load`` gives a batch's record tables by name; ``required`` the fields that each record of a table
    must have; ``items`` takes the conversations and gives uuid, name, times and texts."""

    provider: str
    load: Callable[[SparkSession, str], dict[str, DataFrame]]
    required: dict[str, tuple[str, ...]]
    items: Frames
    account: str

    def problems(self, batch: dict[str, DataFrame]) -> DataFrame:
        """table, path, pos, error: what each record of the batch lacks; every record is looked at."""
        found = [quality.missing_fields(batch[t], fields).withColumn("table", F.lit(t)) for t, fields in self.required.items()]
        return reduce(DataFrame.unionByName, found).select("table", "path", "pos", "error")

    def accounts(self, batch: dict[str, DataFrame]) -> DataFrame:
        """The accounts that the batch is of, which upserts compare."""
        return batch["users"].select(F.col(f"item.{self.account}").alias("account"), F.lit(self.provider).alias("provider")).where("account <> ''").distinct()


def _talk_items(talks: DataFrame) -> DataFrame:
    item = F.col("item")
    return talks.select(item["uuid"].alias("uuid"), F.coalesce(item["name"], F.lit("")).alias("name"), item["created_at"].alias("created_at"), normalize.updated_at(item).alias("updated_at"), normalize.conversation_texts(item).alias("texts"))


def _thread_items(threads: DataFrame) -> DataFrame:
    good, _ = normalize.normalized_threads(threads)
    return good.select("uuid", "name", "created_at", F.col("created_at").alias("updated_at"), normalize.thread_texts(F.col("item")).alias("texts"))


LOGS = {
    "claude-code": SourceAdapter("claude-code", lambda s, p: logs.read_lines(s, p, "claude-code"), normalize.session_events, normalize.session_metadata, normalize.session_models),
    "codex": SourceAdapter("codex", lambda s, p: logs.read_lines(s, p, "codex"), normalize.rollout_events, normalize.rollout_metadata, normalize.rollout_models),
}


EXPORTS = {
    "claude": ExportAdapter("claude", exports.batch, {"users": quality.USERS, "conversations": quality.CONVERSATIONS, "projects": quality.PROJECTS}, _talk_items, "uuid"),
    "chatgpt": ExportAdapter("chatgpt", exports.thread_batch, {"conversations": quality.THREADS}, _thread_items, "id"),
}


def all_items(spark: SparkSession, sources: dict[str, list[tuple[str, str]]]) -> tuple[DataFrame, DataFrame]:
    """(items, set aside) of all log sources, by token, in one table."""
    items = bad = None
    for token, places in sources.items():
        good, aside = LOGS[token].read(spark, places)
        more = LOGS[token].items(good)
        items, bad = (more, aside) if items is None else (items.unionByName(more), bad.unionByName(aside))
    return items, bad
