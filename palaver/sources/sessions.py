"""Session logs: append-only JSON lines of coding assistants, from one or several hosts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .providers import TOOLS_ONLY


def parse_sources(text: str) -> list[tuple[str, str]]:
    """``host=path,host=path`` in order; anything else is an error."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        host, eq, path = part.partition("=")
        if not eq or not host.strip() or not path.strip():
            raise ValueError(f"not host=path: {part!r}")
        out.append((host.strip(), path.strip()))
    return out


def files(spark: SparkSession, sources: list[tuple[str, str]], pattern: str = "*.jsonl") -> DataFrame:
    """Files of all hosts with host, path, rel_path, size, modified, content_hash and content."""

    def one(host: str, path: str) -> DataFrame:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
        plain = path.split("://")[-1].rstrip("/")
        rel = F.regexp_replace(F.col("path"), r"^\w+:/*" + "\\Q" + plain.lstrip("/") + "\\E/", "")
        return found.select(F.lit(host).alias("host"), "path", rel.alias("rel_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.xxhash64("content").alias("content_hash"), "content")

    return reduce(DataFrame.unionByName, [one(h, p) for h, p in sources])


def session_files(spark: SparkSession, sources: list[tuple[str, str]]) -> DataFrame:
    """Logs at depth two (project/session) are searchable; at any other depth they only count for tools."""
    found = files(spark, sources)
    depth = F.size(F.split("rel_path", "/"))
    return found.withColumns({"source": F.when(depth == 2, "claude-code").otherwise(TOOLS_ONLY), "email": F.when(depth == 2, F.get(F.split("rel_path", "/"), F.lit(0))).otherwise("")})


def rollout_files(spark: SparkSession, sources: list[tuple[str, str]]) -> DataFrame:
    return files(spark, sources, "rollout-*.jsonl").withColumns({"source": F.lit("codex"), "email": F.lit("")})


def complete_lines(found: DataFrame) -> DataFrame:
    """Lines up to the last line end (a torn last line waits for its end); a file with any invalid
    UTF-8 byte gives none. Lines end at ``\\n`` only. Adds indexed_bytes, line_no (from 0) and line."""
    valid = found.where(F.is_valid_utf8(F.col("content").cast("string")))
    text = F.col("content").cast("string")
    whole = F.regexp_extract(text, r"(?s)^(.*)\n", 1)
    ended = F.contains(text, F.lit("\n"))
    cut = valid.where(ended).withColumn("indexed_bytes", F.octet_length(whole) + 1).withColumn("lines", F.split(whole, "\n", -1))
    return cut.drop("content").select("*", F.posexplode("lines").alias("line_no", "line")).drop("lines")


def invalid_files(found: DataFrame) -> DataFrame:
    return found.where(~F.is_valid_utf8(F.col("content").cast("string"))).select("path", F.lit(None).cast("long").alias("line_no"), F.lit("invalid UTF-8").alias("reason"))


def parsed_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): blank lines are skipped, malformed or non-object ones set aside with their number."""
    rows = lines.where(F.trim("line") != "").withColumn("v", F.try_parse_json("line"))
    ok = F.col("v").isNotNull() & F.ltrim("line").startswith("{")
    bad = rows.where(~ok).select("path", F.col("line_no").cast("long").alias("line_no"), F.lit("not a JSON object").alias("reason"))
    return rows.where(ok), bad
