"""Mirroring of append-only logs: batch and stream forms of one rule.

A line is known by (path, line_no) in its source. Blank and corrupt lines are skipped, a torn last line
waits, and a source that has become shorter than its archive is reported and never reconciled.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.numbering import kept
from ..sources import logs

KEY = ["path", "line_no"]


def good_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    return lines.where((F.trim(line) != "") & F.try_parse_json(line).isNotNull())


def new_lines(source: DataFrame, archive: DataFrame) -> DataFrame:
    """Source lines that the archive does not have; a shortened source gives none."""
    cut = truncated(source, archive).select("path")
    return source.join(archive.select(*KEY), KEY, "left_anti").join(cut, "path", "left_anti")


def truncated(source: DataFrame, archive: DataFrame) -> DataFrame:
    """path, archived, present: the archive reaches farther than a source that still has lines."""
    a = archive.groupBy("path").agg((F.max("line_no") + 1).alias("archived"))
    s = source.groupBy("path").agg((F.max("line_no") + 1).alias("present"))
    return a.join(s, "path").where("archived > present")


def anomalies(cut: DataFrame, unit: str = "lines") -> DataFrame:
    detail = F.format_string(f"archive has %d {unit}, source %d", "archived", "present")
    return cut.select(F.lit("truncated").alias("kind"), "path", detail.alias("detail"))


def _archive(spark, path: str, schema) -> DataFrame:
    """The archive so far; empty if nothing was written yet."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def mirror_batch(source: DataFrame, archive_path: str) -> DataFrame:
    """Write what is new as one more folder of the archive; returns the rows written."""
    spark = source.sparkSession
    added = f"{archive_path}/{uuid.uuid4().hex}"
    new_lines(source, _archive(spark, archive_path, source.schema)).write.parquet(added)
    return spark.read.schema(source.schema).parquet(added)


#: Every so many batches the marks of all paths are written, not only the changed ones.
FULL = 32


def _read_or_empty(spark, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def marks(spark, folder: str, number: int) -> DataFrame:
    """path, mark: what comes next of each path, after the batches before ``number``. Later batches don't count, so
    that a batch which is tried again sees what it saw the first time."""
    since = max(-1, (number - 1) // FULL * FULL) if number else -1
    rows = _read_or_empty(spark, folder, "path string, mark long, batch int").where((F.col("batch") < number) & (F.col("batch") >= since))
    return rows.groupBy("path").agg(F.max("mark").alias("mark"))


def append_new(batch: DataFrame, number: int, archive: str, state: str, run: str, at: str, ends: Column, shorter: Column, unit: str = "lines") -> None:
    """One micro-batch: the good lines from their path's mark on become one folder of the archive, marks move on, and
    paths that have become shorter are reported. ``at`` is a line's place, ``ends`` that of the next one; ``shorter``:
    what is left of a path, if that is less than its mark (of all rows of the path). Reads no archive; all
    three tables are written under the batch's number, so a second try replaces the first."""
    spark = batch.sparkSession
    batch = batch.persist()
    try:
        old = kept(marks(spark, f"{state}/marks", number))
        known = batch.join(old, "path", "left")
        new = good_lines(known.where(F.col(at) >= F.coalesce("mark", F.lit(0)))).select(*batch.columns)
        new.dropDuplicates(["path", at]).drop("reason").write.mode("overwrite").parquet(f"{archive}/batch={run}-{number}")
        reached = batch.groupBy("path").agg(F.max(ends).alias("reached"), shorter.alias("left_"))
        now = reached.join(old, "path", "full" if number % FULL == 0 else "left")
        moved = now.select("path", F.greatest("mark", "reached").alias("mark")).where("mark IS NOT NULL")
        moved.write.mode("overwrite").parquet(f"{state}/marks/batch={number}")
        cut = now.where("left_ < mark").select("path", F.col("mark").alias("archived"), F.col("left_").alias("present"))
        anomalies(cut, unit).write.mode("overwrite").parquet(f"{state}/anomalies/batch={number}")
    finally:
        batch.unpersist()


def _started(rows: DataFrame, archive: str, state: str, at: str, ends: Column, shorter: Column):
    """Run over all that is there. A new state begins with the marks of an archive that is there already."""
    spark = rows.sparkSession
    if not marks(spark, f"{state}/marks", 1 << 30).limit(1).count():
        past = _archive(spark, archive, StructType([f for f in rows.schema if f.name != "reason"]))
        past.withColumn("reason", F.lit(None).cast("string")).groupBy("path").agg(F.max(ends).alias("mark")).write.mode("overwrite").parquet(f"{state}/marks/batch=-1")

    def append(batch: DataFrame, number: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "once"
        append_new(batch, number, archive, state, run, at, ends, shorter, "bytes" if at == "at" else "lines")

    return rows.writeStream.foreachBatch(append).option("checkpointLocation", state).trigger(availableNow=True).start()


def mirror_stream(chunks: DataFrame, archive_path: str, checkpoint: str):
    """Structured Streaming form over landed chunks (path, line_no, line), those of a path in order: each micro-batch
    appends the lines from the path's high-water mark on. A path that is landed again from its first line on and
    has fewer lines than were archived is reported. Marks and reports stand in the checkpoint's folder."""
    present = F.when(F.min("line_no") == 0, F.max("line_no") + 1)
    return _started(chunks, archive_path, checkpoint, "line_no", F.col("line_no") + 1, present)


def sweep(spark, root: str, archive_path: str, checkpoint: str, kind: str, host: str = "", range_bytes: int = logs.RANGE):
    """Mirror a tree of logs as it is now: only what files have grown by is read, only new complete lines are
    appended, and a file that has become shorter is reported once and never reconciled. Lines with an
    invalid byte are skipped like malformed ones. Run it again for what has come since."""
    rows = logs.stream_lines(spark, root, kind, host, range_bytes).drop("range_no", "nth", "modified")
    shorter = F.min(F.when(F.col("reason") == logs.SHORTER, F.col("ends")))
    return _started(rows, archive_path, checkpoint, "at", F.when(F.col("reason").isNull() | (F.col("reason") == logs.INVALID), F.col("ends")), shorter)


def reported(spark, checkpoint: str) -> DataFrame:
    """kind, path, detail of all paths that were seen shorter than their archive."""
    return _read_or_empty(spark, f"{checkpoint}/anomalies", "kind string, path string, detail string, batch int").drop("batch")
