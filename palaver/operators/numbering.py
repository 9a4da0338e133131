"""Row numbers inside of groups of any size, and two helpers that such jobs share."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group from which on it is numbered by ranges instead of in one window.
HOT_ROWS = 1_000_000


def kept(df: DataFrame) -> DataFrame:
    """Written to the checkpoint folder that all machines share, so that every reader sees the same rows."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet, made from ``names``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        new = f"__{name}"
        while new.lower() in taken:
            new = "_" + new
        taken.add(new.lower())
        out.append(new)
    return out


def numbered(rows: DataFrame, group: list[str], order: list[str | Column], number: str = "k", hot: int = HOT_ROWS) -> DataFrame:
    """``rows`` with ``number``, from 1 in each group (nulls are a group, too).

    Groups of up to ``hot`` rows are numbered in a window, one exchange of the rows. Only larger ones are
    dealt out and sorted as ranges of (group, order); a row's number is then its place in its range, moved
    on by what the ranges before hold of the group. The larger groups, and their parts in ranges, are
    fewer than rows / hot and ranges, so both tables go to all tasks."""
    n, flag, part, place, first, before = fresh(rows, "n", "flag", "part", "place", "first", "before")
    keys = fresh(rows, *[f"key_{g}" for g in group])
    renamed = [F.col(g).alias(k) for g, k in zip(group, keys, strict=True)]
    large = kept(rows.groupBy(*group).agg(F.count("*").alias(n)).where(F.col(n) > hot).select(*renamed, F.lit(True).alias(flag)))
    window = F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")
    if not large.limit(1).count():
        return rows.withColumn(number, window)
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(k)) for g, k in zip(group, keys, strict=True)])
    marked = rows.join(F.broadcast(large), same, "left").drop(*keys)
    small = marked.where(F.col(flag).isNull()).drop(flag).withColumn(number, window)
    ranges = marked.where(F.col(flag)).drop(flag).repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    ranges = kept(ranges.withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id()}))
    parts = ranges.groupBy(part, *group).agg(F.min(place).alias(first), F.count("*").alias(n))
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    (part_,) = fresh(ranges, "of")
    starts = parts.select(F.col(part).alias(part_), *renamed, first, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    placed = ranges.join(F.broadcast(starts), same & (F.col(part) == F.col(part_)))
    moved = F.col(place) - F.col(first) + F.col(before) + 1
    return small.unionByName(placed.withColumn(number, moved).select(*small.columns))
