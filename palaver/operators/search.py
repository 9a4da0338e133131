"""Search: match, score and rank items by their texts.

``items``: one row for each item with a key column; ``texts``: (key, text). An item matches if one
of its texts does. Its score is the sum, over snippets, of the score of the snippet's text; as a
text's score is the same for all of its snippets, ranking needs no snippet: score times count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from ..functions import text as T
from ..functions import times
from .numbering import fresh


def score_texts(texts: DataFrame, query: str, key: list[str], text: str = "text", exact: bool = False) -> DataFrame:
    """(key, text_score, n_matches) of items with a matching text: one narrow pass, one aggregation."""
    hit = texts.where((F.col(text) != "") & T.matches_query(F.col(text), query, exact))
    n = T.snippet_count(F.col(text), query, exact)
    scored = hit.select(*key, n.alias("n"), (T.score_match(F.col(text), query) * n).alias("s"))
    return scored.groupBy(*key).agg(F.sum("s").alias("text_score"), F.sum("n").alias("n_matches"))


def search(items: DataFrame, texts: DataFrame, query: str, key: list[str], exact: bool = False, name_raw: str | None = None, updated: str | None = None, as_of: Column | None = None) -> DataFrame:
    """Matching items with n_matches and total_score (texts, title bonus, recency)."""
    out = items.join(score_texts(texts, query, key, exact=exact), key)
    total = F.col("text_score")
    if name_raw:
        total = total + T.name_bonus(F.col(name_raw), query, exact)
    if updated:
        total = total + times.recency_boost(F.col(updated), as_of if as_of is not None else F.current_timestamp())
    return out.withColumn("total_score", total).drop("text_score")


def matching_texts(texts: DataFrame, query: str, text: str = "text", exact: bool = False) -> DataFrame:
    """Texts that match, with their snippets as array<struct<text, score>>."""
    parts = [query.strip()] if exact else query.split()
    found = F.flatten(F.array(*[T.snippets(F.col(text), p) for p in parts]))
    both = F.struct(found.alias("found"), T.score_match(F.col(text), query).alias("score"))  # a text is scored once, not for each snippet
    matches = T.bound(both, lambda b: F.transform(b["found"], lambda s: F.struct(s.alias("text"), b["score"].alias("score"))))
    return texts.where(T.matches_query(F.col(text), query, exact)).withColumn("matches", matches)


def first_snippets(matches: Column, most: int = 2) -> Column:
    """struct<shown, more>: the first snippets and how many are left."""
    return F.struct(F.slice(matches, 1, most).alias("shown"), F.greatest(F.size(matches) - most, F.lit(0)).alias("more"))


def browse(items: DataFrame, has_preview: str = "has_preview") -> DataFrame:
    """A blank query: all items with a non-empty text, with score 0."""
    return items.where(F.col(has_preview)).withColumns({"total_score": F.lit(0.0), "n_matches": F.lit(0).cast("long")})


def ranked(results: DataFrame, by: str = "score", path: str = "path", updated: str = "updated_at", current_host: str | None = None) -> list[Column]:
    """Sort keys: ``score``, ``updated`` or ``time`` (updated, then score); own host first if given; the
    path always decides ties."""
    keys = {"score": [F.desc("total_score")], "updated": [F.desc(updated)], "time": [F.desc(updated), F.desc("total_score")]}[by]
    if current_host is not None:
        keys = [F.asc(~F.col("host").eqNullSafe(F.lit(current_host))), *keys]
    return [*keys, F.asc(path)]


def top(results: DataFrame, keys: list[Column], n: int) -> DataFrame:
    return results.orderBy(*keys).limit(n)


def by_uuid(items: DataFrame, wanted: str, uuid: str = "uuid") -> DataFrame:
    """Items of a comma list of ids or chat urls."""
    ids = sorted({x.strip().removeprefix(T.CHAT_URL_PREFIX).strip().lower() for x in wanted.split(",") if x.strip()})
    return items.where(T.normalize_uuid(F.col(uuid)).isin(ids))


def under(cwd: Column, directory: str) -> Column:
    """Is ``cwd`` the directory or below it? Empty paths never are."""
    d = directory.rstrip("/") or "/"
    below = F.startswith(cwd, F.lit(d if d == "/" else d + "/"))
    return F.coalesce((cwd != "") & ((cwd == d) | below), F.lit(False))


def scope(items: DataFrame, directory: str, is_local: Column, cwd: str = "cwd") -> DataFrame:
    return items.where(is_local & under(F.col(cwd), directory))


def scope_exists(items: DataFrame, directory: str, cwd: str = "cwd") -> bool:
    """Does any known directory lie under the path? Tells a path from a query word."""
    return items.select(cwd).where(under(F.col(cwd), directory)).limit(1).count() > 0


def omit(results: DataFrame, terms: list[str], columns: list[str], arrays: list[str] = ()) -> DataFrame:
    """Drop results whose columns (or strings in array columns) hold any term, without case."""
    if not terms:
        return results
    body = F.lower(F.concat_ws("\n", *columns, *[F.array_join(a, "\n") for a in arrays]))
    return results.where(~reduce(lambda a, b: a | b, [F.contains(body, F.lit(t.lower())) for t in terms]))


def redact(results: DataFrame, pairs: dict[str, str], columns: list[str]) -> DataFrame:
    """Replace real names by stand-ins in the given columns, also inside of arrays and structs."""

    def within(c: Column, kind) -> Column:
        if isinstance(kind, types.ArrayType):
            return F.transform(c, lambda x: within(x, kind.elementType))
        if isinstance(kind, types.StructType):
            return F.when(c.isNotNull(), F.struct(*[within(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return T.substitute(c, pairs) if isinstance(kind, types.StringType) else c

    return results.withColumns({c: within(F.col(c), results.schema[c].dataType) for c in columns})


def confined(path: Column, root: str) -> Column:
    """Does a file lie physically below the root?"""
    return F.startswith(path, F.lit(root.rstrip("/") + "/")) & ~path.rlike(r"/\.\.(/|$)")


def compare_results(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Rows that differ between two result sets of one schema: key, side and the fields that differ."""
    fields = [c for c in left.columns if c not in key]
    a, b = left.select(*key, F.struct(*fields).alias("l")), right.select(*key, F.struct(*fields).alias("r"))
    differs = F.array_compact(F.array(*[F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in fields]))
    both = a.join(b, key, "full_outer")
    side = F.when(F.col("r").isNull(), "left").when(F.col("l").isNull(), "right").otherwise("both")
    return both.select(*key, side.alias("side"), differs.alias("fields")).where((F.col("side") != "both") | (F.size("fields") > 0))


def prefix_hosts(items: DataFrame, sources: list[tuple[str, str]], path: str = "path", host: str = "host") -> DataFrame:
    """The host of the first configured directory that holds an item's path, else the stored host.
    ``sources``, (host, directory) in order, is a short configured list and becomes one expression."""
    chosen = F.col(host)
    for name, directory in reversed(sources):
        chosen = F.when(confined(F.col(path), directory), name).otherwise(chosen)
    return items.withColumn(host, chosen)


def directory_hosts(items: DataFrame, sources: DataFrame, path: str = "path", host: str = "host", longest: bool = False) -> DataFrame:
    """``prefix_hosts`` for a table of directories of any size: ``sources`` has host, directory, rank. Of the directories
    that hold an item's path the one of the lowest rank counts (the smallest host of equals), with ``longest`` the
    deepest one. Each different parent directory is looked up once, by equality with its own ancestors, so nothing
    is compared with all directories."""
    parent, found, up, deep = fresh(items, "parent", "found", "up", "deep")
    plain = F.when(~F.col(path).rlike(r"/\.\.(/|$)"), F.regexp_replace(path, "/[^/]*$", ""))
    rows = items.withColumn(parent, F.when(F.contains(F.col(path), F.lit("/")), plain))
    steps = F.split(parent, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.struct(F.array_join(F.slice(steps, 1, k), "/").alias(up), k.alias(deep)))
    each = rows.where(F.col(parent).isNotNull()).select(parent).distinct().select(parent, F.inline(above)).toDF(parent, up, deep)
    named = sources.select(F.regexp_replace("directory", "/+$", "").alias(up), F.col("host").alias("host_"), "rank")
    first = F.struct(F.when(F.lit(longest), -F.col(deep)).otherwise(F.lit(0)), "rank", "host_")
    chosen = each.join(named, up).groupBy(parent).agg(F.min_by("host_", first).alias(found))
    return rows.join(chosen, parent, "left").withColumn(host, F.coalesce(found, host)).drop(parent, found)
