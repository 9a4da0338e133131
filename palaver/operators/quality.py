"""Data quality: contracts of exports, structure of items, and findings as rows.

Every record is checked. A check is a named boolean column that says what is wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Required fields.
USERS = ("email_address", "uuid")
CONVERSATIONS = ("uuid", "name", "created_at", "account", "chat_messages")
PROJECTS = ("uuid", "name", "created_at", "creator")
THREADS = ("id", "title", "create_time")


def missing_fields(records: DataFrame, fields: tuple[str, ...], raw: str = "raw", kind: str = "") -> DataFrame:
    """path, pos, error for each required field that a JSON record does not have."""
    names = F.json_object_keys(F.col(raw))
    errors = F.array_compact(F.array(*[F.when(~F.coalesce(F.array_contains(names, f), F.lit(False)), F.lit(f"{kind}missing: {f}")) for f in fields]))
    return records.select("path", "pos", F.explode(errors).alias("error"))


def findings(rows: DataFrame, key: list[str], checks: dict[str, Column]) -> DataFrame:
    """key and error for every check that a row fails."""
    errors = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks.items()]))
    return rows.select(*key, F.explode(errors).alias("error"))


def conversation_structure(records: DataFrame) -> DataFrame:
    """path, idx (of the message; null: the conversation itself), error."""
    own = missing_fields(records, CONVERSATIONS).select("path", F.lit(None).cast("int").alias("idx"), "error")
    account = records.where(F.col("item.account").isNotNull() & F.col("item.account.uuid").isNull()).select("path", F.lit(None).cast("int").alias("idx"), F.lit("missing: account.uuid").alias("error"))
    messages = records.select("path", F.posexplode("item.chat_messages").alias("idx", "m"))
    sender = F.col("m.sender")
    bad = findings(messages, ["path", "idx"], {
        "not an object": F.col("m").isNull(),
        "missing: uuid": F.col("m").isNotNull() & F.col("m.uuid").isNull(),
        "bad sender": F.col("m").isNotNull() & ~F.coalesce(sender.isin("human", "assistant"), F.lit(False)),
    })
    return own.unionByName(account).unionByName(bad)


def project_structure(records: DataFrame) -> DataFrame:
    own = missing_fields(records, PROJECTS).select("path", F.lit(None).cast("int").alias("idx"), "error")
    docs = records.select("path", F.posexplode("item.docs").alias("idx", "d"))
    return own.unionByName(findings(docs, ["path", "idx"], {"missing: filename": F.col("d.filename").isNull(), "missing: content": F.col("d.content").isNull()}))


def invalid_json(files: DataFrame, text: str = "value") -> DataFrame:
    return files.where(F.try_parse_json(text).isNull()).select("path")


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("error").agg(F.count("*").alias("n"))
