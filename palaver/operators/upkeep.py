"""Keeping tables current: upserts by uuid, catalog diffs, whole-file replacement, conflicts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import file_stem
from .numbering import fresh, kept, numbered


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys (id and account); others stay."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def conflicts(old: DataFrame, new: DataFrame, uuid: str = "uuid", account: str = "account") -> DataFrame:
    """The same id under another account: reported, and both stay."""
    a = old.select(F.col(uuid), F.col(account).alias("old_account")).distinct()
    b = new.select(F.col(uuid), F.col(account).alias("new_account")).distinct()
    return a.join(b, uuid).where(F.col("old_account") != F.col("new_account"))


def last_wins(batch: DataFrame, uuid: str = "uuid", order: str = "pos") -> DataFrame:
    """Of rows with one id in a batch, the last; rows without an id all stay. Pre-aggregated: no window
    over a hot id."""
    last = batch.where(F.col(uuid).isNotNull()).groupBy(uuid).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
    return last.unionByName(batch.where(F.col(uuid).isNull()))


def unique_names(items: DataFrame, created_at: str = "created_at", name: str = "name", uuid: str = "uuid") -> DataFrame:
    """file_name: the stem alone if it is unique, else with -1, -2, ... by time and id."""
    stem, k, shared = fresh(items, "stem", "k", "shared")
    rows = numbered(items.withColumn(stem, file_stem(F.col(created_at), F.col(name))), [stem], [created_at, uuid], k)
    several = rows.where(F.col(k) == 2).select(stem, F.lit(True).alias(shared))
    file_name = F.when(F.col(shared), F.concat(stem, F.lit("-"), F.col(k).cast("string"))).otherwise(F.col(stem))
    return rows.join(several, stem, "left").withColumn("file_name", file_name).drop(stem, k, shared)


def catalog_diff(catalog: DataFrame, disk: DataFrame, key: str = "path", facts: tuple[str, ...] = ("size", "modified", "content_hash")) -> DataFrame:
    """path, change: new, rewritten, removed or same. A file is also read again while it is longer than
    what was indexed of it."""
    have = [f for f in facts if f in catalog.columns and f in disk.columns]
    a, b = catalog.alias("a"), disk.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")) for f in have])
    if "indexed_bytes" in catalog.columns:
        same = same & (F.col("a.indexed_bytes") >= F.col("b.size"))
    change = F.when(F.col(f"a.{key}").isNull(), "new").when(F.col(f"b.{key}").isNull(), "removed").when(same, "same").otherwise("rewritten")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), change.alias("change"))


def refresh(derived: DataFrame, diff: DataFrame, rebuilt: DataFrame, key: str = "path") -> DataFrame:
    """Derived rows after a diff: those of changed and removed files go, rebuilt ones come."""
    return derived.join(diff.where("change <> 'same'").select(key), key, "left_anti").unionByName(rebuilt)


def needs_rebuild(stored_version: int | None, version: int) -> bool:
    """Derived tables of another extractor version are rebuilt from the sources."""
    return stored_version != version


def rescued(items: DataFrame, stored: DataFrame, extracted: DataFrame, key: str = "path") -> DataFrame:
    """key, texts: stored texts, or those extracted anew where none are stored (none is not empty)."""
    a = items.select(key).join(stored.select(key, F.col("texts").alias("s")), key, "left")
    return a.join(extracted.select(key, F.col("texts").alias("e")), key, "left").select(key, F.coalesce("s", "e").alias("texts"))


#: Files up to which a read is given their names; beyond it all files are read and the others dropped.
MOST_NAMED = 100_000


def rescued_from_files(items: DataFrame, stored: DataFrame, read: Callable[[list[str] | None], DataFrame], key: str = "path", most: int = MOST_NAMED) -> DataFrame:
    """key, texts: as ``rescued``, but only the files of items without stored texts are read. ``read`` gives (key, texts)
    of the files of a list, or of all files for None."""
    kept_texts = items.select(key).join(stored.where("texts IS NOT NULL").select(key, "texts"), key)
    missing = kept(items.select(key).join(stored.where("texts IS NOT NULL").select(key), key, "left_anti").distinct())
    if not (n := missing.count()):
        return kept_texts
    again = read([r[key] for r in missing.collect()] if n <= most else None).join(missing, key, "left_semi")
    lost = missing.join(again.select(key), key, "left_anti").select(key, F.lit(None).cast("array<string>").alias("texts"))
    return kept_texts.unionByName(again.select(key, "texts")).unionByName(lost)


def view_freshness(cached: DataFrame, fresh: DataFrame, key: str = "uuid", body: str = "body") -> DataFrame:
    """current if the cached document is the fresh one, stale if the fresh one goes on from it, else diverged."""
    old, new = F.col("c"), F.col("f")
    state = F.when(old == new, "current").when((old != "") & F.startswith(new, old), "stale").otherwise("diverged")
    return cached.select(key, F.col(body).alias("c")).join(fresh.select(key, F.col(body).alias("f")), key).select(key, state.alias("freshness"))


def duplicates(rows: DataFrame, uuid: str, path: str) -> DataFrame:
    """Ids that stand in more than one row, with the files. Rows without an id are no copies of each other."""
    return rows.where(F.col(uuid).isNotNull()).groupBy(uuid).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(path)).alias("paths")).where("n > 1")


def duplicate_rows(rows: DataFrame, uuid: str, number: str = "n") -> DataFrame:
    """The rows whose id stands in several, each with how many there are: an id with any number of rows is never
    put together. Rows without an id are no copies of each other."""
    counts = rows.where(F.col(uuid).isNotNull()).groupBy(uuid).agg(F.count("*").alias(number)).where(F.col(number) > 1)
    return rows.drop(number).join(counts, uuid)


def refresh_totals(appended: DataFrame, path: str = "path") -> DataFrame:
    return appended.agg(F.count("*").alias("new_lines"), F.count_distinct(path).alias("changed_files"))
