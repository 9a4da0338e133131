"""The conversations table landed as log files, one for each conversation, and read back, swept and exported."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import upkeep
from ..operators.numbering import kept
from ..operators.store import new_folder
from ..sources import documents_sink, logs, sessions
from ..streaming import mirror
from .common import read
from .registry import query


def _log_line(c):
    return F.to_json(F.struct("turn", "role", "text"))


def _landed(spark, sf_dir, root: str, before=None) -> None:
    """Writes ``root``/p<k>/<conv_id>.jsonl; without the last line end in each third one; ``before``: only turns that meet it."""
    c = read(spark, sf_dir, "conversations")
    c = c if before is None else c.where(before)
    lines = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", _log_line(c).alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    rel_path = F.concat(F.lit("p"), (F.col("conv_id") % 5).cast("string"), F.lit("/"), F.col("conv_id").cast("string"), F.lit(".jsonl"))
    torn = F.when(F.col("conv_id") % 3 == 0, "").otherwise("\n")
    documents_sink.write(lines.select(rel_path.alias("rel_path"), F.concat("body", torn).alias("body")), root).where("status <> 'written'").count()


def _conversation(df):
    return df.withColumn("conv_id", F.regexp_extract("rel_path", r"/(\d+)\.jsonl$", 1).cast("long"))


_LINES = "SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS line_no, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations"


@query(f"SELECT conv_id, line_no, role, text, 'p' || (conv_id % 5) AS project FROM ({_LINES}) WHERE conv_id % 3 <> 0 OR line_no < n - 1")
def landed_logs(spark, sf_dir):
    """Documents written at their paths, read as logs in ranges of 4 KB: torn last lines wait."""
    _landed(spark, sf_dir, root := new_folder(spark, "landed"))
    lines, _ = logs.read_lines(spark, [("here", root)], "claude-code", 4096)
    good, _ = sessions.parsed_lines(lines)
    at = lambda k: F.try_variant_get("v", k, "string")
    return _conversation(good).select("conv_id", "line_no", at("$.role").alias("role"), at("$.text").alias("text"), F.col("email").alias("project"))


@query(f"SELECT conv_id, role, text FROM ({_LINES}) WHERE conv_id % 3 <> 0 OR line_no < n - 1")
def swept_logs(spark, sf_dir):
    """Landed up to turn 2, swept, landed whole, swept twice: each complete line is archived once."""
    root, archive, state = (new_folder(spark, n) for n in ("landed", "archive", "state"))
    for before in (F.col("turn") <= 2, None, None):
        _landed(spark, sf_dir, root, before)
        mirror.sweep(spark, root, archive, state, "claude-code").awaitTermination()
    at = lambda k: F.get_json_object("line", k)
    return _conversation(spark.read.parquet(archive)).select("conv_id", at("$.role").alias("role"), at("$.text").alias("text"))


@query("""
SELECT conv_id, CASE WHEN conv_id % 10 IN (3, 7) THEN body ELSE 'stored ' || conv_id END AS body, (SELECT count(DISTINCT conv_id) FROM conversations WHERE conv_id % 10 IN (3, 7)) AS n_read
FROM (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id)
""")
def rescued_files(spark, sf_dir):
    """A fifth of the conversations' files have no stored texts: only those are read again."""
    c, root = read(spark, sf_dir, "conversations"), new_folder(spark, "files")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    docs = c.groupBy("conv_id").agg(body.alias("body"))
    documents_sink.write(docs.select(F.format_string("p%d/%d.txt", F.col("conv_id") % 5, "conv_id").alias("rel_path"), "body"), root).where("status <> 'written'").count()
    number = F.regexp_extract("path", r"/(\d+)\.txt$", 1).cast("long")
    files = lambda at: spark.read.text(at, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.array("value").alias("texts"))
    items = kept(files(f"{root}/p*").select("path").withColumn("conv_id", number))
    stored = items.where("conv_id % 10 NOT IN (3, 7)").select("path", F.array(F.concat(F.lit("stored "), F.col("conv_id").cast("string"))).alias("texts"))
    asked: list[int] = []

    def again(paths):
        asked.append(len(paths))
        return files(paths)

    found = upkeep.rescued_from_files(items, stored, again)
    return found.select(number.alias("conv_id"), F.get("texts", F.lit(0)).alias("body"), F.lit(sum(asked)).cast("long").alias("n_read"))
