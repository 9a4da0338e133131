"""Derived tables on disk: items, their texts, a trigram index, the files they come from and those set aside.

All tables are Parquet, partitioned by a bucket of the path. A refresh finds the buckets that have new,
rewritten or removed files and writes those buckets anew, a file for each ``PART_BYTES`` of them, over the
old ones; the other buckets are not touched, so tables have as many files after any number of refreshes as
after one build. The catalog is written last: what a refresh that breaks off has left is done again by the
next one. Tables of another ``LAYOUT`` are built anew.

Within a bucket items have numbers. The index goes by chunks of a bucket's texts, and has one row for each
chunk and trigram with the sorted numbers of the items that have it: lookups read the pages of a few trigrams
in each bucket and intersect the arrays of a chunk. No text lies in two chunks, so no match is lost. A bucket
may have any size: its rows are dealt to as many tasks as they need.

A file that gives no item, or one with a ``problem``, is set aside with the reason and the number of
tries, and tried again by every refresh until it gives one.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grams, search, upkeep
from .normalize import EXTRACTOR_VERSION
from .numbering import kept

KEY = "path"
FACTS = ("size", "content_hash")
BUCKETS = 64
#: The index reads at most so many of a query's trigrams, its rarest ones.
RAREST = 8
NOTHING = "nothing extracted"
#: Bytes of files that one task writes of a bucket, about.
PART_BYTES = 32 << 20
#: Of the tables: 2 has chunks in the index.
LAYOUT = 2


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder below the one that all machines share."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-tables-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settings(spark: SparkSession, root: str) -> tuple[int, int] | None:
    """(buckets, extractor version) of the tables; None: there are none of this layout."""
    try:
        found = spark.read.schema("buckets int, version int, layout int").json(f"{root}/settings").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return (found["buckets"], found["version"]) if found and found["layout"] == LAYOUT else None


def live(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows of ``items``, ``texts``, ``catalog`` or ``aside``. (Each bucket that was ever written has a row
    without a path, which keeps it in place when its last file goes.)"""
    return spark.read.parquet(f"{root}/{table}").where(F.col(KEY).isNotNull())


def postings(spark: SparkSession, root: str) -> DataFrame:
    """bucket, chunk, gram, n, numbers."""
    return spark.read.parquet(f"{root}/postings").where(F.col("gram").isNotNull())


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(KEY), F.lit(buckets)).cast("int")


def _blank(rows: DataFrame, touched: DataFrame) -> DataFrame:
    """A row of nulls for each touched bucket."""
    return touched.select(*[F.col("bucket") if f.name == "bucket" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])


def _put(rows: DataFrame, root: str, table: str, whole: bool = False) -> None:
    """Write whole buckets of a table over what they held, or the ``whole`` table. What is read of them meanwhile is there
    until all is written."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static" if whole else "dynamic").partitionBy("bucket").parquet(f"{root}/{table}")


def _parts(files: DataFrame, told: list[int], buckets: int) -> int:
    """Tasks that a touched bucket is dealt to, from the bytes of its files."""
    size = files.where(_bucket(buckets).isin(told)).agg(F.sum("size")).first()[0] or 0
    return max(1, -(-size // (len(told) * PART_BYTES)))


def _dealt(rows: DataFrame, touched: DataFrame, parts: int, *order: str) -> DataFrame:
    """Rows of a bucket in ``parts`` tasks by their path, and its row of nulls."""
    part = F.pmod(F.xxhash64(F.lit("part"), KEY), F.lit(parts))
    return rows.unionByName(_blank(rows, touched)).repartition("bucket", part).sortWithinPartitions("bucket", KEY, *order)


def refresh(spark: SparkSession, root: str, files: DataFrame, extract: Callable[[DataFrame], DataFrame], version: int = EXTRACTOR_VERSION, buckets: int = BUCKETS) -> DataFrame:
    """Bring the tables up to ``files`` (path, size, content_hash and what ``extract`` needs to make items
    with ``texts`` of them; a ``problem`` that is not null sets its file aside). Only new and rewritten files and
    those set aside are read; all of them if the tables are of another extractor version. Returns path, change."""
    have = settings(spark, root)
    buckets = have[0] if have else buckets
    if have:
        diff = upkeep.catalog_diff(live(spark, root, "catalog"), files.select(KEY, *FACTS), KEY, FACTS)
        if upkeep.needs_rebuild(have[1], version):
            diff = diff.withColumn("change", F.when(F.col("change") == "same", "rewritten").otherwise(F.col("change")))
        aside = live(spark, root, "aside").select(KEY, "tries")
        diff = diff.join(aside, KEY, "left").withColumn("again", (F.col("change") == "same") & F.col("tries").isNotNull())
    else:
        diff = files.select(KEY, F.lit("new").alias("change"), F.lit(None).cast("int").alias("tries"), F.lit(False).alias("again"))
    diff = kept(diff.withColumn("bucket", _bucket(buckets)))
    work = diff.where("change <> 'same' OR again")
    touched = kept(work.select("bucket").distinct())
    told = [r["bucket"] for r in touched.collect()]  # at most `buckets`
    if not told:
        return diff.select(KEY, "change")
    parts = _parts(files, told, buckets)
    to_read = work.where("change <> 'removed'").select(KEY)
    every = not have or diff.where("change = 'same' AND NOT again").isEmpty()  # then nothing has to be looked up
    reading = files.where(F.col(KEY).isNotNull()) if every else files.join(to_read, KEY, "left_semi")
    made = extract(reading)
    made = made if "problem" in made.columns else made.withColumn("problem", F.lit(None).cast("string"))
    given = kept(made.select(KEY, "problem"))
    new = made.where("problem IS NULL").drop("problem").withColumn("bucket", _bucket(buckets))

    def with_rest(rows: DataFrame, table: str, drop: str = "") -> DataFrame:
        """Those rows and the table's rows in the touched buckets of files that have no work."""
        if every:
            return rows
        stay = live(spark, root, table).where(F.col("bucket").isin(told)).join(work.select(KEY), KEY, "left_anti")
        return rows.unionByName(stay.drop(drop), allowMissingColumns=True)

    def now(table: str) -> DataFrame:
        return spark.read.parquet(f"{root}/{table}").where(F.col("bucket").isin(told))

    # Texts are dealt out once, for the items; the other tables follow the items' files.
    rows = _dealt(with_rest(new, "items", "number"), touched, parts)
    _put(rows.withColumn("number", F.monotonically_increasing_id()), root, "items", not have)
    texts = now("items").select("bucket", "number", KEY, F.posexplode_outer("texts").alias("pos", "text")).where(f"{KEY} IS NULL OR pos IS NOT NULL")
    _put(texts.sortWithinPartitions("bucket", "number", "pos"), root, "texts", not have)
    _put(grams.posted(now("texts"), KEY).sortWithinPartitions("bucket", "gram"), root, "postings", not have)
    wrong = to_read.join(given.where("problem IS NULL").select(KEY), KEY, "left_anti").join(given.where("problem IS NOT NULL").groupBy(KEY).agg(F.min("problem").alias("problem")), KEY, "left")
    wrong = wrong.join(work.select(KEY, "tries", "bucket"), KEY).select(KEY, F.coalesce("problem", F.lit(NOTHING)).alias("reason"), (F.coalesce("tries", F.lit(0)) + 1).alias("tries"), "bucket")
    _put(_dealt(kept(with_rest(wrong, "aside")), touched, parts), root, "aside", not have)
    facts = reading.select(KEY, *FACTS, _bucket(buckets).alias("bucket"))
    _put(_dealt(kept(with_rest(facts, "catalog")), touched, parts), root, "catalog", not have)
    if have != (buckets, version):
        spark.createDataFrame([(buckets, version, LAYOUT)], "buckets int, version int, layout int").coalesce(1).write.mode("overwrite").json(f"{root}/settings")
    return diff.select(KEY, "change")


def candidates(index: DataFrame, query: str, exact: bool = False, most: int = RAREST) -> DataFrame | None:
    """bucket, number of the items that have the query's rarest trigrams; None: no usable one, all are candidates."""
    wanted = grams.query_grams(query, exact)
    if not wanted:
        return None
    rows = index.where(F.col("gram").isin(wanted))
    if len(wanted) > most:  # the query's own trigrams: a handful of rows
        counts = {r["gram"]: r["n"] for r in rows.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        wanted = sorted(wanted, key=lambda g: (counts.get(g, 0), g))[:most]
        rows = rows.where(F.col("gram").isin(wanted))
    rows = rows.groupBy("bucket", "chunk", "gram").agg(F.flatten(F.collect_list("numbers")).alias("numbers"))  # one row, as a rule
    lists = rows.groupBy("bucket", "chunk").agg(F.array_sort(F.collect_list(F.struct(F.size("numbers").alias("n"), "numbers"))).alias("lists")).where(F.size("lists") == len(wanted))
    both = F.aggregate("lists", F.get("lists", F.lit(0))["numbers"], lambda acc, x: F.array_intersect(acc, x["numbers"]))
    return lists.select("bucket", F.explode(both).alias("number")).distinct()


def search_index(spark: SparkSession, root: str, query: str, n: int | None = None, exact: bool = False, by: str = "score", current_host: str | None = None, as_of: Column | None = None, stand_ins: dict[str, str] | None = None) -> DataFrame:
    """The best ``n`` (None: all) items of a search over the stored tables: candidates by the query's rarest
    trigrams, or all items where it has none; scores with title bonus and, with ``as_of``, recency; real
    names replaced by stand-ins. A blank query browses."""
    items = live(spark, root, "items").drop("texts", "bucket", "number")
    if not query.strip():
        found = search.browse(items)
    else:
        texts, near = live(spark, root, "texts"), candidates(postings(spark, root), query, exact)
        texts = (texts if near is None else texts.join(near, ["bucket", "number"], "left_semi")).select(KEY, "text")
        options = {} if as_of is None else {"updated": "updated_ts", "as_of": as_of}
        found = search.search(items.withColumn("updated_ts", F.col("updated_at").try_cast("timestamp")), texts, query, [KEY], exact, name_raw="name_raw", **options).drop("updated_ts")
    if stand_ins:
        found = search.redact(found, stand_ins, [c for c in found.columns if c not in (KEY, "uuid")])
    return found if n is None else search.top(found, search.ranked(found, by, KEY, "updated_at", current_host), n)
