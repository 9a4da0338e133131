"""Web exports: batches of conversations and projects, and the archive made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The export formats.
BLOCK = "struct<type: string, text: string>"
FILE = "struct<file_name: string>"
MESSAGE = f"struct<uuid: string, text: string, content: array<{BLOCK}>, sender: string, created_at: string, updated_at: string, attachments: array<{FILE}>, files: array<{FILE}>>"
CONVERSATION = f"struct<uuid: string, name: string, summary: string, created_at: string, updated_at: string, account: struct<uuid: string>, chat_messages: array<{MESSAGE}>>"
DOC = "struct<uuid: string, filename: string, content: string, created_at: string>"
PROJECT = f"struct<uuid: string, name: string, description: string, prompt_template: string, created_at: string, updated_at: string, creator: struct<uuid: string>, docs: array<{DOC}>>"
USER = "struct<uuid: string, email_address: string, full_name: string>"
NODE = "struct<id: string, parent: string, message: struct<author: struct<role: string>, create_time: double, content: struct<content_type: string, parts: variant>, metadata: struct<model_slug: string>>>"
THREAD = f"struct<id: string, title: string, name: string, summary: string, create_time: double, update_time: double, mapping: map<string, {NODE}>>"
OWNER = "struct<id: string, email: string>"


def documents(spark: SparkSession, paths: str | list[str], pattern: str = "*.json") -> DataFrame:
    """Whole files: path and value. Files that are not JSON have a null ``parsed``."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(paths, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), "value", F.try_parse_json("value").alias("parsed"))


def records(files: DataFrame, kind: str) -> DataFrame:
    """The objects of files that hold a list of them or one: path, pos, raw (the object's own text, so that
    fields and mappings keep their order), item."""
    is_list = F.ltrim("value").startswith("[")
    each = F.when(is_list, F.from_json("value", "array<string>")).otherwise(F.array("value"))
    out = files.where(F.col("parsed").isNotNull()).select("path", F.posexplode_outer(each).alias("pos", "raw"))
    return out.withColumn("item", F.from_json("raw", kind))


def archive(spark: SparkSession, root: str) -> DataFrame:
    """``root/provider/account/{conversations,projects}/*.json``: provider, account and type from the
    path; the document stays JSON text, as each type has its own shape."""
    files = documents(spark, root)
    part = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)/(conversations|projects)/[^/]+\.json$", k)
    found = files.withColumns({"provider": part(1), "email": part(2), "item_type": F.regexp_replace(part(3), "s$", "")})
    return found.where(F.col("item_type") != "")


def quarantine(files: DataFrame) -> DataFrame:
    """Files that can't be read, to be tried again at each run."""
    return files.where(F.col("parsed").isNull()).select("path", F.lit(None).cast("long").alias("line_no"), F.lit("not valid JSON").alias("reason"))


def batch(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Users, conversations and projects of an export; projects come as a list or one file each."""
    read = lambda p, kind: records(documents(spark, folder, p), kind)
    single = documents(spark, folder).where(F.col("path").rlike(r"/projects/[^/]+\.json$"))
    return {
        "users": read("users.json", USER),
        "conversations": read("conversations.json", CONVERSATION),
        "projects": read("projects.json", PROJECT).unionByName(records(single, PROJECT)),
    }


def thread_batch(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Conversations and owner of the other export format, whose messages form a tree."""
    read = lambda p, kind: records(documents(spark, folder, p), kind)
    return {"users": read("user.json", OWNER), "conversations": read("conversations.json", THREAD)}


def export_file(name: Column) -> Column:
    """Which export a file name belongs to, or null."""
    # File name patterns.
    return F.when(name.rlike(r"^data-.*\.zip$"), "claude").when(name.rlike(r"^[0-9a-f]{64}-\d{4}-\d{2}-\d{2}-.*\.zip$"), "chatgpt")
