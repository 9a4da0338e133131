"""Turns: ordered events to user and assistant turns, and what is counted in sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assemble(events: DataFrame, session: str = "path", order: tuple[str, ...] = ("line_no", "ev_no")) -> DataFrame:
    """session, turn_no, role, ts, content, tool_uses. A user event ends the open assistant turn and is
    a turn; other events in a row are one assistant turn: texts joined by a blank line, tools once each
    in order, the time of the first event. An assistant turn without text and tools is dropped. The
    window is over one session at a time."""
    at = Window.partitionBy(session).orderBy(*order)
    user = F.col("kind") == "user"
    island = F.sum(F.when(user, 1).otherwise(0)).over(at.rowsBetween(Window.unboundedPreceding, 0))
    rows = events.withColumns({"island": island, "user": user}).select(session, "island", "user", F.struct(*order, "kind", "value", "ts").alias("e"))
    grouped = rows.groupBy(session, "island", "user").agg(F.array_sort(F.collect_list("e")).alias("es"))
    texts = F.transform(F.filter("es", lambda e: e["kind"].isin("user", "text")), lambda e: e["value"])
    tools = F.array_distinct(F.transform(F.filter("es", lambda e: e["kind"] == "tool"), lambda e: e["value"]))
    turns = grouped.select(session, "island", "user", F.when(F.col("user"), "user").otherwise("assistant").alias("role"), F.get("es", F.lit(0))["ts"].alias("ts"), F.array_join(texts, "\n\n").alias("content"), tools.alias("tool_uses"))
    kept = turns.where(F.col("user") | (F.col("content") != "") | (F.size("tool_uses") > 0))
    number = F.row_number().over(Window.partitionBy(session).orderBy("island", F.desc("user")))
    return kept.withColumn("turn_no", number).select(session, "turn_no", "role", "ts", "content", "tool_uses")


def tool_counts(events: DataFrame, session: str = "path") -> DataFrame:
    """Every call counts: session, tool, n."""
    return events.where(F.col("kind") == "tool").groupBy(session, F.col("value").alias("tool")).agg(F.count("*").alias("n"))


def forks(messages: DataFrame, group: str, order: str, sender: str) -> DataFrame:
    """Messages whose sender is that of the message before: a likely fork of the conversation."""
    before = F.lag(sender).over(Window.partitionBy(group).orderBy(order))
    return messages.withColumn("before", before).where(F.col("before") == F.col(sender)).drop("before")


def first_filled(c: str, order: str) -> Column:
    return F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(order)))


def last_filled(c: str, order: str) -> Column:
    return F.max_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(order)))
