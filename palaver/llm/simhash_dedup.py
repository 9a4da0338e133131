"""Operator 7: SimHash near-duplicates by pivot distance tables.

Each document gets a 64-bit SimHash of its word shingles. Distinct fingerprints (copies are merged
first, with counts pre-aggregated) that differ in at most ``radius`` bits are linked, and documents
form the connected components of those links.

Links are found exactly. Two fingerprints within the radius agree in at least one of radius + 1
blocks of bits (of more blocks in several, for large inputs: ``block_keys``), so pairs are only
sought among the fingerprints that share a block key. There the pivot distance table works: each
fingerprint carries its Hamming distances to ``PIVOTS`` reference fingerprints; those of a block key
are sorted by the first distance, a pair is discarded if any of its distances differs by more than
the radius (triangle inequality), and only survivors are compared bit by bit. Of a block key's links
only a spanning forest is given on, so a large group of near copies never becomes all its pairs. A
block key with more than ``TILE`` fingerprints is dealt out as pairs of tiles to many tasks.

Pivots alone can't generate candidates: distances of 64-bit hashes to any reference crowd around 32,
and the window of the radius would keep over half of all pairs.

A text with fewer words than a shingle has one shingle, all of it; null and empty texts have the
fingerprint zero, which is linked like any other. Null ids are never a component's smallest unless
all ids are null. Repeated rows are given each.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_SENT, checkpointed, compacted, fresh, read, small_batches
from .components import connected_components

SEED = 42
PIVOTS = 16
#: Reference fingerprints: multiples of an odd constant, hence spread over all bits.
PIVOT_WORDS = (np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
TILE = 2048
#: Words of a text whose hashes are summed at once.
CHUNK = 1 << 14


def digests(text: str | None, words: int = 4):
    """The 8-byte hashes of a text's word shingles, CHUNK of them at a time."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return
    line = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    begin = (end - size)[: max(1, len(parts) - words + 1)].tolist()
    end = end[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    for at in range(0, len(begin), CHUNK):
        yield b"".join([digest(line[a:b], SEED) for a, b in zip(begin[at : at + CHUNK], end[at : at + CHUNK], strict=True)])


def simhash(text: str | None, words: int = 4) -> int:
    """The fingerprint of a whole text."""
    return majority(digests(text, words))


def majority(chunks) -> int:
    """The bits set in over half of all hashes."""
    votes, n = np.zeros(64, np.int64), 0
    for raw in chunks:
        votes += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(raw) // 8
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprint(text: Column, words: int = 4) -> Column:
    """SimHash of each text as a long (two's complement)."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, words) for t in texts], np.uint64).view(np.int64))

    return of(text)


def block_keys(radius: int, distinct: int) -> list[list[tuple[int, int]]]:
    """Sets of bit ranges (start, width); two fingerprints within the radius agree in all ranges of
    one set. The more fingerprints there are, the longer the keys, so that few share one by chance."""
    for extra in range(1, 8):
        blocks = radius + extra
        edges = [round(64 * k / blocks) for k in range(blocks + 1)]
        ranges = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
        keys = [list(c) for c in combinations(ranges, extra)]
        if distinct <= 300 << min(sum(w for _, w in k) for k in keys):
            break
    return keys


def links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """``prints``: distinct longs in column ``fp``. Returns (a, b) with the components of all pairs
    within the radius."""
    distinct = prints.count()
    if distinct < 2:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    sets = block_keys(radius, distinct)

    def key(ranges: list[tuple[int, int]]) -> Column:
        out = F.lit(0).cast("long")
        for start, width in ranges:
            out = F.shiftleft(out, width) + F.shiftrightunsigned("fp", start).bitwiseAND((1 << width) - 1)
        return out

    keyed = prints.select("fp", F.posexplode(F.array(*[key(s) for s in sets])).alias("band", "key"))
    crowded = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n") > TILE)
    crowded = compacted(crowded)
    if crowded.limit(1).count():
        tiles = F.coalesce(F.ceil(F.col("n") / TILE).cast("int"), F.lit(1))
        own = F.pmod(F.xxhash64("fp"), F.col("tiles").cast("long")).cast("int")
        keyed = keyed.join(crowded, ["band", "key"], "left").select("fp", "band", "key", tiles.alias("tiles")).withColumn("tile", own)
        others = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
        keyed = keyed.select("fp", "band", "key", "tile", others).select("fp", "band", "key", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "tile")
    else:
        zero = F.lit(0)
        keyed = keyed.select("fp", "band", "key", zero.alias("t1"), zero.alias("t2"), zero.alias("tile"))
    group = F.xxhash64("band", "key", "t1", "t2")
    rows = keyed.select(group.alias("g"), "fp", "band", "key", F.struct("t1", "t2").alias("pair"), (F.col("tile") == F.col("t2")).alias("second"), (F.col("t1") != F.col("t2")).alias("cross"))
    dealt = rows.repartition("g").sortWithinPartitions("g")

    def find(batches):
        for part in whole_groups(batches):
            a, b = forest(part["g"].to_numpy(), part["fp"].to_numpy(), part["second"].to_numpy(), part["cross"].to_numpy(), radius)
            yield pd.DataFrame({"a": a, "b": b})

    return dealt.select("g", "fp", "second", "cross").mapInPandas(find, "a long, b long").distinct()


def whole_groups(batches):
    """Join batches so that no group (rows are sorted by g) is cut. A group has 2 * TILE rows at most,
    but for chance meetings of group hashes, which only add comparisons."""
    rest = None
    for part in batches:
        if rest is not None:
            part = pd.concat([rest, part], ignore_index=True)
        g = part["g"].to_numpy()
        last = np.searchsorted(g, g[-1], "left") if len(g) else 0
        rest, part = part.iloc[last:], part.iloc[:last]
        if len(part):
            yield part
    if rest is not None and len(rest):
        yield rest


def forest(group: np.ndarray, fp: np.ndarray, second: np.ndarray, cross: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links inside of each group. ``group`` is sorted."""
    words = fp.view(np.uint64)
    distance = np.bitwise_count(words[:, None] ^ PIVOT_WORDS[None, :]).astype(np.int8)
    order = np.lexsort((distance[:, 0], group))
    group, words, second, cross, distance = group[order], words[order], second[order], cross[order], distance[order]
    parent = np.arange(len(words))
    a_all, b_all = [], []
    left = np.arange(len(words))
    offset = 0
    while True:
        offset += 1
        left = left[left + offset < len(words)]
        right = left + offset
        near = (group[left] == group[right]) & (distance[right, 0] - distance[left, 0] <= radius)
        left = left[near]  # sorted by the first distance: once out of the window, always out
        if not len(left):
            break
        right = left + offset
        keep = ~cross[left] | (second[left] != second[right])
        l, r = left[keep], right[keep]
        for p in range(1, PIVOTS):
            close = np.abs(distance[l, p] - distance[r, p]) <= radius
            l, r = l[close], r[close]
            if not len(l):
                break
        sure = np.bitwise_count(words[l] ^ words[r]) <= radius
        l, r = l[sure], r[sure]
        if len(l):
            l, r = _unite(parent, l, r)
            a_all.append(words[l].view(np.int64))
            b_all.append(words[r].view(np.int64))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a_all]), np.concatenate([none, *b_all])


def _unite(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union by pairs; returns those that joined two trees."""
    kept = joins(parent, left, right)
    return left[kept], right[kept]


def joins(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Union by pairs, in order; the numbers of those that joined two trees."""
    while (parent != parent[parent]).any():
        parent[:] = parent[parent]
    apart = np.flatnonzero(parent[left] != parent[right])
    kept = []
    for k, x, y in zip(apart.tolist(), left[apart].tolist(), right[apart].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(k)
    return np.array(kept, np.int64)


def _labelled(docs: DataFrame, text: str, words: int, radius: int, **more: Column) -> DataFrame:
    """One row for each of ``docs``: fp, its component's label (the smallest fingerprint) and ``more``."""
    small_batches(docs.sparkSession)
    rows = checkpointed(docs.select(fingerprint(F.col(text), words).alias("fp"), *[c.alias(n) for n, c in more.items()]))
    prints = compacted(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = connected_components(links(prints.select("fp"), radius))
    labelled = compacted(prints.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("label")))
    lowest = compacted(labelled.groupBy("label").agg(F.min("least").alias("component_id")))  # so that both sides of the join can be split
    return rows.join(labelled.join(lowest, "label").select("fp", "label", "component_id"), "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """One row for each of ``docs``: doc_id, fp (long), label (the component's smallest fingerprint) and
    component_id, the smallest id reachable. Components without ids share the component_id null, and
    rows of one id can lie in several; only the label tells components apart."""
    return _labelled(docs, text, words, radius, doc_id=F.col(doc_id)).select("doc_id", "fp", "label", "component_id")


def first_of_each(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` with one row for each label of ``found`` (doc_id, mark, label; mark is the hash of the
    text): the one with the smallest id, a null id last, and of several texts with it the smallest mark.
    The rows that go are sent to all tasks as (id, mark), so that no text is shuffled, or joined if they
    are too many."""
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark", "n")
    i, h, m = fresh(docs, "keep", "hash", "mark")
    rows = compacted(found.groupBy("label", "doc_id", "mark").agg(F.count("*").alias("n")))
    least = compacted(rows.groupBy("label").agg(F.min(row).alias("r")))
    judged = rows.join(least, "label").select("doc_id", "mark", "n", (F.col("doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("mark") == F.col("r.mark"))).alias("stays"))
    judged = compacted(judged.select(F.col("doc_id").alias(i), F.col("mark").alias(h), "n", "stays"))
    marked = docs.withColumn(m, F.xxhash64(text))

    def beside(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = right.select(i, h)
        right = F.broadcast(right) if right.count() <= MOST_SENT else right
        return left.join(right, left[doc_id].eqNullSafe(right[i]) & (left[m] == right[h]), how)

    kept = beside(marked, judged.where("NOT stays"), "left_anti")
    repeated = judged.where("stays AND n > 1")
    if repeated.limit(1).count():  # rows of one id and text
        kept = beside(kept, repeated, "left_anti").unionByName(beside(kept, repeated, "left_semi").dropDuplicates([doc_id, m]))
    return kept.select(*docs.columns)


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each component, whether or not its ids are null or repeated."""
    found = _labelled(docs, text, words, radius, doc_id=F.col(doc_id), mark=F.xxhash64(text))
    return first_of_each(docs, found, doc_id, text)


def op7_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
