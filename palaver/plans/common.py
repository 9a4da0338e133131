"""Views of the driver's tables as the operators' inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_sql(word: str) -> str:
    """DuckDB pattern for a whole word with Unicode borders."""
    return f"(^|[^\\pL\\pN_]){word}($|[^\\pL\\pN_])"


#: events as items: the type stands for the provider, the user for the host, value for the directory.
EVENT_PROVIDERS = ["claude", "chatgpt", "claude-code", "codex", "gemini"]


def event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    k = F.pmod(F.col("event_id"), F.lit(5)) + 1
    return e.select(
        "event_id",
        F.element_at(F.array(*map(F.lit, EVENT_PROVIDERS)), k.cast("int")).alias("provider"),
        F.concat(F.lit("host"), F.pmod(F.col("user_id"), F.lit(7)).cast("string")).alias("host"),
        F.concat(F.lit("/home/user/p"), F.pmod(F.col("user_id"), F.lit(23)).cast("string")).alias("cwd"),
        F.col("ts").alias("created_ts"),
    )


EVENT_ITEMS_SQL = """
  SELECT event_id, ['claude','chatgpt','claude-code','codex','gemini'][CAST(event_id % 5 AS INT) + 1] AS provider,
    'host' || (user_id % 7) AS host, '/home/user/p' || (user_id % 23) AS cwd, ts AS created_ts FROM events
"""

LABEL_SQL = "CASE provider WHEN 'claude' THEN 'claude.ai' ELSE provider END"
