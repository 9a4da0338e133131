"""Sinks: JSON results, documents by path, anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The fields of a result, in order.
RESULT = ["provider", "item_type", "uuid", "name", "created_at", "updated_at", "email", "model", "path", "url", "total_score", "n_matches", "matches"]


def result_json(results: DataFrame) -> DataFrame:
    """One JSON object for each result; ``extra`` only where it is not null."""
    fields = [c for c in [*RESULT, "extra"] if c in results.columns]
    return results.select(F.to_json(F.struct(*fields)).alias("value"))


def write_documents(docs: DataFrame, path: str) -> DataFrame:
    """Write (rel_path, body) rows, a folder for each directory; returns the counts by status. A null
    body is a failure of that row alone. Rows are dealt out as ranges of paths, so that a directory is
    written by few tasks, and a large one by several."""
    rows = docs.withColumns({"dir": F.regexp_replace("rel_path", "/[^/]*$", ""), "status": F.when(F.col("body").isNull(), "failed").otherwise("written")})
    rows.where("status = 'written'").repartitionByRange("dir", "rel_path").write.mode("overwrite").partitionBy("dir").parquet(path)
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def write_manifest(lines: DataFrame, path: str) -> None:
    """Write ``export.manifest_lines`` as text, a folder for each provider and group; the files of a folder,
    in the order of their names, are its index."""
    order = ["provider", "grp", "line_no"]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.select("provider", "grp", "line").write.mode("overwrite").partitionBy("provider", "grp").text(path)


def append_anomalies(found: DataFrame, path: str) -> None:
    """ts, kind, path, detail of what upkeep noticed."""
    found.select(F.current_timestamp().alias("ts"), "kind", "path", "detail").write.mode("append").parquet(path)
