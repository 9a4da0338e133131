"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of the rows, those whose remainder is 0 are held out from every fit.
FOLDS = 5


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet, made from ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        new = f"__{name}"
        while new.lower() in taken:
            new = "_" + new
        taken.add(new.lower())
        out.append(new)
    return out


#: Up to so many narrow rows are sent to all tasks; more of them are joined.
MOST_SENT = 500_000
#: Bytes of the rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Python workers get at most BATCH_BYTES at once, so that their memory, and the buffers beside
    the JVM's heap, don't depend on how long texts are. A lower setting of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key, "67108864b")).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the folder that all machines share.

    The folder is the one set in ``spark.checkpoint.dir``; a session without the setting (tests on
    one machine) gets a temporary one.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def compacted(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """Checkpointed, and read in as many partitions as its rows need: a small table that went through a
    shuffle of many partitions then no longer costs many tasks and files in each step after it."""
    df = checkpointed(df)
    return df.coalesce(max(1, -(-df.count() // rows)))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for tables below the shared checkpoint folder."""
    import uuid

    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-tables-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def sampled(by: list[Column], share: Column | float) -> Column:
    """Whether a row is in a sample of about that share, by a 62-bit hash of ``by``: no share of a count
    that fits a long is ever 0."""
    share = share if isinstance(share, Column) else F.lit(float(share))
    return F.shiftrightunsigned(F.xxhash64(*by), 2) < (share * float(1 << 62)).cast("long")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0. A null id is not held out and never learned from."""
    crc = F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))
    return F.coalesce((crc % FOLDS) == 0, F.lit(False))
