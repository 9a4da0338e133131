"""The provider table: a few fixed rows that joins and labels use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Id, badge, label in reports, label in documents, kind, html, browser, account, ingest, resume command.
PROVIDERS = [
    ("claude", "CLAUDE.AI", "claude.ai", "claude.ai", "web", True, True, "email", True, ""),
    ("chatgpt", "CHATGPT", "chatgpt", "chatgpt.com", "web", True, True, "email", True, ""),
    ("claude-code", "CLAUDE CODE", "claude-code", "Claude Code", "local-cli", True, False, "project-slug", False, "claude -r"),
    ("codex", "CODEX", "codex", "OpenAI Codex", "local-cli", True, False, "project-slug", False, "codex resume"),
    ("gemini", "GEMINI", "gemini", "gemini", "web", False, False, "email", False, ""),
]
COLUMNS = "provider string, badge string, label string, source_label string, kind string, html boolean, browser boolean, account_slot string, ingest boolean, resume string"
#: Source names a caller may choose.
SOURCES = ("llm", "claude-code", "codex")
TOOLS_ONLY = "claude-code-tools-only"


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROVIDERS, COLUMNS)


def _case(provider: Column, field: int, otherwise: Column) -> Column:
    out = None
    for row in PROVIDERS:
        out = F.when(provider == row[0], F.lit(row[field])) if out is None else out.when(provider == row[0], F.lit(row[field]))
    return out.otherwise(otherwise)


def with_label(items: DataFrame, provider: str = "provider", label: str = "label") -> DataFrame:
    """Adds the report label by a broadcast join (the table has five rows); unknown ids pass through."""
    dim = F.broadcast(table(items.sparkSession).select(F.col("provider").alias(provider), F.col("label").alias("__label")))
    return items.join(dim, provider, "left").withColumn(label, F.coalesce("__label", provider)).drop("__label")


def label(provider: Column) -> Column:
    return _case(provider, 2, provider)


def is_local_cli(provider: Column) -> Column:
    return F.coalesce(provider.isin([p[0] for p in PROVIDERS if p[4] == "local-cli"]), F.lit(False))


def shell_quote(c: Column) -> Column:
    """As a POSIX shell word."""
    plain = c.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$")
    return F.when(plain, c).otherwise(F.concat(F.lit("'"), F.regexp_replace(c, "'", "'\"'\"'"), F.lit("'")))


def resume(provider: Column, session: Column) -> Column:
    """The command that goes on with a session; empty for providers without one."""
    command = _case(provider, 9, F.lit(""))
    return F.when(command != "", F.concat(command, F.lit(" "), shell_quote(session))).otherwise("")


def url(provider: Column, item_type: Column, uuid: Column, cwd: Column, host: Column) -> Column:
    """Browser address of a web item, resume command of a session."""
    local = F.concat(
        F.when(F.coalesce(host, F.lit("")) != "", F.concat(F.lit("["), host, F.lit("] "))).otherwise(""),
        F.lit("pushd "), shell_quote(F.coalesce(cwd, F.lit("~"))), F.lit(" && "), resume(provider, uuid),
    )
    return (
        F.when((provider == "claude") & (item_type == "conversation"), F.concat(F.lit("https://claude.ai/chat/"), uuid))
        .when(provider == "claude", F.concat(F.lit("https://claude.ai/project/"), uuid))
        .when(provider == "chatgpt", F.concat(F.lit("https://chatgpt.com/c/"), uuid))
        .when(is_local_cli(provider), local)
        .otherwise(F.concat(F.lit("Unknown provider: "), provider))
    )


def choose(rows: DataFrame, source: str, configured: set[str] = frozenset(SOURCES), column: str = "source") -> DataFrame:
    """Rows of one source, or of all configured ones; a source that isn't configured is an error."""
    if source != "all" and source not in configured:
        raise ValueError(f"source {source!r} is not configured")
    return rows.where(F.col(column).isin(sorted(configured)) if source == "all" else F.col(column) == source)
