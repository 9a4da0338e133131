"""Activity reports: counts by provider, host, month, hour, weekday, directory and tool.

``items`` has provider, host, cwd and created_ts (a timestamp, null if unknown). Each section is a
small aggregate; spines of months, hours and weekdays are made from their bounds, not from the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import abbreviate_home, blank_to_null
from ..sources.providers import is_local_cli, label
from .numbering import kept

#: Blank for zero, then eight heights.
BLOCKS = " ▁▂▃▄▅▆▇█"


def count_by(items: DataFrame, key: Column) -> DataFrame:
    """key, n; null and empty keys are skipped."""
    return items.select(blank_to_null(key.cast("string")).alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"))


def by_provider(items: DataFrame) -> DataFrame:
    return count_by(items, label(F.col("provider")))


def by_host(items: DataFrame) -> DataFrame:
    return count_by(items.where(is_local_cli(F.col("provider"))), F.col("host"))


def monthly(items: DataFrame, ts: str = "created_ts") -> DataFrame:
    """key (yyyy-MM), n for every month from the first to the last, empty ones too."""
    return _every_month(items.where(F.col(ts).isNotNull()).groupBy(F.date_format(ts, "yyyy-MM").alias("key")).agg(F.count("*").alias("n")))


def _every_month(counts: DataFrame) -> DataFrame:
    month = F.to_date(F.concat("key", F.lit("-01")))
    spine = counts.agg(F.min(month).alias("a"), F.max(month).alias("b")).where("a IS NOT NULL").select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("m")).select(F.date_format("m", "yyyy-MM").alias("key"))
    return spine.join(counts, "key", "left").select("key", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _histogram(items: DataFrame, bucket: Column, size: int) -> DataFrame:
    return _every_bucket(items.groupBy(bucket.cast("long").alias("key")).agg(F.count("*").alias("n")).where("key IS NOT NULL"), size)


def _every_bucket(counts: DataFrame, size: int) -> DataFrame:
    spine = counts.sparkSession.range(size).withColumnRenamed("id", "key")
    return spine.join(F.broadcast(counts), "key", "left").select("key", F.coalesce("n", F.lit(0)).cast("long").alias("n"))  # `size` rows at most


def hours(items: DataFrame, ts: str = "created_ts", zone: str = "UTC") -> DataFrame:
    return _histogram(items, F.hour(F.from_utc_timestamp(ts, zone)), 24)


def weekdays(items: DataFrame, ts: str = "created_ts", zone: str = "UTC") -> DataFrame:
    """Monday is 0."""
    return _histogram(items, F.weekday(F.from_utc_timestamp(ts, zone)), 7)


def top_directories(items: DataFrame, n: int = 8, home: str = "") -> DataFrame:
    counts = count_by(items.where(is_local_cli(F.col("provider"))), F.col("cwd"))
    if home:
        counts = counts.withColumn("key", abbreviate_home(F.col("key"), home)).groupBy("key").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "key").limit(n)


def date_span(items: DataFrame, ts: str = "created_ts") -> DataFrame:
    """first_day, last_day and how many days that is, both included."""
    day = F.to_date(ts)
    return items.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day")).withColumn("days", (F.date_diff("last_day", "first_day") + 1).cast("long"))


def busiest_day(items: DataFrame, ts: str = "created_ts") -> DataFrame:
    """The day with most items; of equals, the first."""
    counts = items.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "day").limit(1)


def tool_totals(counts: DataFrame, sources: list[str] | None = None) -> DataFrame:
    rows = counts if sources is None else counts.where(F.col("source").isin(sources))
    return rows.groupBy("tool").agg(F.sum("n").cast("long").alias("n"))


def leaderboard(totals: DataFrame, n: int = 12, key: str = "tool") -> DataFrame:
    return totals.orderBy(F.desc("n"), key).limit(n)


def local_cwds(items: DataFrame) -> DataFrame:
    return items.where(is_local_cli(F.col("provider")) & (F.col("cwd") != "")).select("cwd").distinct()


def shares(counts: DataFrame, width: int = 24) -> DataFrame:
    """Adds pct of the total and a bar as long as n is to the largest n; both are scalar subqueries, so
    that many rows are never sorted into one window."""
    total, peak = counts.agg(F.sum("n")).scalar(), counts.agg(F.max("n")).scalar()
    filled = F.greatest(F.lit(1), F.bround(F.lit(width) * F.col("n") / peak, 0).cast("int"))
    return counts.withColumns({"pct": F.col("n") * 100.0 / total, "bar": F.when((F.col("n") > 0) & (peak > 0), F.repeat(F.lit("█"), filled)).otherwise("")})


def spark_line(histogram: DataFrame) -> DataFrame:
    """One row: the histogram as block heights, blank only for zero."""
    peak = F.max("n").over(Window.partitionBy())  # 24 or 7 rows
    level = F.greatest(F.lit(1), F.least(F.lit(8), F.bround(F.lit(8) * F.col("n") / peak, 0).cast("int")))
    char = F.when(F.col("n") > 0, F.substring(F.lit(BLOCKS), level + 1, F.lit(1))).otherwise(" ")
    return histogram.select("key", char.alias("c")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "c"))), lambda x: x["c"]), "").alias("line"))


def report(items: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """All sections as one table: section, key, n, pct (of the section). One pass over the items counts the
    keys of all sections, pre-aggregated before the shuffle; the sections are made of those counts."""
    local, ts = is_local_cli(F.col("provider")), F.col("created_ts")
    keys = {
        "provider": label(F.col("provider")), "host": F.when(local, F.col("host")), "month": F.date_format(ts, "yyyy-MM"), "hour": F.hour(ts).cast("string"),
        "weekday": F.weekday(ts).cast("string"), "directory": F.when(local, F.col("cwd")), "busiest_day": F.to_date(ts).cast("string"),
    }
    entries = F.array(*[F.struct(F.lit(s).alias("section"), k.alias("key")) for s, k in keys.items()])
    counted = items.select(F.explode(entries).alias("e")).select("e.*").where("key <> ''").groupBy("section", "key").agg(F.count("*").alias("n"))
    counted = kept(counted)
    of = lambda section: counted.where(F.col("section") == section).drop("section")
    part = lambda name, df: df.select(F.lit(name).alias("section"), F.col(df.columns[0]).cast("string").alias("key"), F.col("n").cast("long").alias("n"))
    bucket = lambda section, size: _every_bucket(of(section).withColumn("key", F.col("key").cast("long")), size)
    sections = [
        counted.where("section IN ('provider', 'host')"), part("month", _every_month(of("month"))), part("hour", bucket("hour", 24)), part("weekday", bucket("weekday", 7)),
        part("directory", leaderboard(of("directory"), 8, "key")), part("busiest_day", leaderboard(of("busiest_day"), 1, "key")),
    ]
    if tools is not None:
        sections.append(part("tool", leaderboard(tools)))
    rows = kept(reduce(DataFrame.unionByName, sections))
    total = rows.groupBy("section").agg(F.sum("n").alias("total"))
    return rows.join(F.broadcast(total), "section").select("section", "key", "n", F.when(F.col("total") > 0, F.col("n") * 100.0 / F.col("total")).otherwise(0.0).alias("pct"))  # a row a section


def structural_profile(records: DataFrame, line: str, *kinds: str) -> DataFrame:
    """Counts by kind, bytes, and the share of all bytes."""
    counts = records.groupBy(*kinds).agg(F.count("*").alias("n"), F.sum(F.octet_length(line)).cast("long").alias("bytes"))
    return counts.withColumn("share", F.col("bytes") / counts.agg(F.sum("bytes")).scalar())
