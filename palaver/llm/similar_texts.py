"""Near-duplicates of the pipeline: all pairs of texts whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more, and the connected components of those pairs.

At 0.8 two SimHashes differ in about 10 of 64 bits, and in up to 19 for almost all pairs; block keys for
that radius are too short to part anything. So SimHash and its pivots (``simhash_dedup.links``) only
name the first, cheap candidates, and a prefix filter finds the rest: of two sets of that similarity,
the first n - ceil(0.8 n) + 1 shingles of each, in one order for all, have one in common. That makes the
result exact, but for chance collisions of 64-bit hashes. In the order, shingles of many texts come
last; which ones is only a matter of speed, so they are counted in a sample of the texts.

A shingle that several prefixes hold stands for the smallest set that has it, its lead; from then on only
(lead, set) matters, a few rows for each set. Round one compares each set with the lead it shares most
shingles with, and SimHash's links. The rounds after it take, under each lead, the sets of different
components: in tiles of bounded size, counts of shingles in parts of the hashes (``BUCKETS``, or more for a long text, so
that a part holds ``FILL`` shingles at most, on average) bound each
pair's similarity from above, and only pairs that can reach it leave the task: in round two those that
likely join the most components, in round three all that are left. Every pair is verified by its two sets of
shingles, the pairs of one set together. So a large group of near copies never becomes all its pairs,
and the lead of a shingle that very many sets share is found by a minimum in each task.

Null texts and texts without words are copies of each other; a text of fewer words has one shingle. Null
and repeated ids change nothing here; very long texts cost in proportion; an empty table gives no rows.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_SENT, checkpointed, compacted, small_batches
from .components import connected_components
from .simhash_dedup import digests, first_of_each, joins, links, majority, whole_groups

WORDS = 5
SIMILARITY = 0.8
#: Radius of SimHash's candidates. It has no influence on the result.
RADIUS = 4
#: Of the texts, one in SAMPLE is counted; a shingle in the prefixes of more than COMMON of them comes last.
SAMPLE, COMMON, MOST_COMMON = 8, 8, 200_000
#: The rows of a shingle of more than so many sampled prefixes are not shuffled by it.
HOT = 2000
#: Parts of the hashes that are counted for the bound on a pair's similarity, at least, and shingles of a part, at most.
BUCKETS, FILL = 256, 8
#: The pairs of one set are verified in up to so many tasks.
SPREAD = 16
#: Sets of a lead that are compared in one task at once, and pairs of them bounded in one step.
TILE, STEP = 1024, 1 << 16
#: Texts that a task remembers in order to give the keys of a copy once only.
SEEN = 1 << 18


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The different shingles of a text as sorted hashes."""
    return _different(b"".join(digests(text, words)))


def _different(raw: bytes) -> np.ndarray:
    return np.unique(np.frombuffer(raw, ">u8").astype(np.uint64))


def set_id(found: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64))


def prefix(found: np.ndarray, similarity: float, common: np.ndarray | None = None) -> np.ndarray:
    """The keys of a set; ``common`` (sorted) come last in the order."""
    n, least = len(found), Fraction(str(similarity))
    keys = n and n - -(-n * least.numerator // least.denominator) + 1
    if common is not None and len(common):
        last = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
        found = np.concatenate([found[~last], found[last]])
    return found[:keys].view(np.int64)


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    least = Fraction(str(similarity))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * least.denominator >= (len(x) + len(y) - both) * least.numerator


def sketch(found: np.ndarray) -> bytes:
    """How many shingles fall into each part, 255 standing for any more; the parts are a power of two."""
    parts = BUCKETS
    while parts * FILL < len(found):
        parts *= 2
    counts = np.bincount((found % np.uint64(parts)).astype(np.int64), minlength=parts)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def folded(rows: np.ndarray, parts: int) -> np.ndarray:
    """Sketches (rows) in fewer parts. A full part stays full."""
    while rows.shape[1] > parts:
        a, b = (rows[:, k : k + rows.shape[1] // 2].astype(np.uint16) for k in (0, rows.shape[1] // 2))
        rows = np.where((a == 255) | (b == 255), 255, np.minimum(a + b, 255)).astype(np.uint8)
    return rows


def possible(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets with these sketches (rows of x and y) can be similar enough: no part holds more
    common shingles than the lesser of its counts. Full parts say nothing."""
    full = ((x == 255) | (y == 255)).any(axis=1)
    both = np.minimum(x, y).sum(axis=1, dtype=np.int64)
    least = Fraction(str(similarity))
    either = x.sum(axis=1, dtype=np.int64) + y.sum(axis=1, dtype=np.int64) - both
    return full | (both * least.denominator >= either * least.numerator)


class Sketches:
    """Sketches of several widths, and pairs of them at the lesser one's width."""

    def __init__(self, raw: list[bytes]):
        self.raw, self.width = raw, np.array([len(r) for r in raw], np.int64)

    def rows(self, at: np.ndarray, parts: int) -> np.ndarray:
        """Those at these places (of one width), folded to so many parts."""
        one, back = np.unique(at, return_inverse=True)
        matrix = np.frombuffer(b"".join(self.raw[k] for k in one.tolist()), np.uint8).reshape(len(one), -1)
        return folded(matrix, parts)[back]

    def pairs(self, x: np.ndarray, y: np.ndarray):
        """(places in x and y, rows of x, rows of y) for pairs whose sketches have the same widths, some MB at a time."""
        wide = (self.width[x] << 32) | self.width[y]
        for kind in np.unique(wide).tolist():
            which = np.flatnonzero(wide == kind)
            parts = min(kind >> 32, kind & 0xFFFFFFFF)
            step = max(1, STEP * BUCKETS // max(kind >> 32, kind & 0xFFFFFFFF))
            for k in range(0, len(which), step):
                p = which[k : k + step]
                yield p, self.rows(x[p], parts), self.rows(y[p], parts)

    def possible(self, x: np.ndarray, y: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """By pair: can it be similar enough, and how many shingles can be common."""
        ok, both = np.zeros(len(x), bool), np.zeros(len(x), np.int64)
        for p, a, b in self.pairs(x, y):
            ok[p], both[p] = possible(a, b, similarity), np.minimum(a, b).sum(axis=1, dtype=np.int64)
        return ok, both


def common_shingles(docs: DataFrame, text: str, words: int, similarity: float) -> list[tuple[int, int]]:
    """(shingle, count) of those in many sampled prefixes, MOST_COMMON at most. Copies count once a task."""

    def keys(batches):
        seen = set()
        for part in batches:
            for t in part["text"]:
                found = shingles(t, words)
                if (sid := set_id(found)) not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(sid)
                    yield pd.DataFrame({"key": prefix(found, similarity)})

    sampled = docs.select(F.col(text).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counted = sampled.mapInPandas(keys, "key long").groupBy("key").count().where(F.col("count") > COMMON)
    return [tuple(r) for r in counted.orderBy(F.desc("count"), "key").limit(MOST_COMMON).collect()]


def _prints(text: Column, words: int, similarity: float, sent) -> Column:
    """fp (SimHash), sid, n (shingles), sketch, keys; the keys of a copy only once in a task."""
    seen: set[int] = set()

    @F.pandas_udf("fp long, sid long, n int, sketch binary, keys array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            raw = b"".join(digests(t, words))
            sid, keys = set_id(found := _different(raw)), None
            if sid not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(sid)
                keys = prefix(found, similarity, sent.value)
            out.append((int(np.uint64(majority([raw])).view(np.int64)), sid, len(found), sketch(found), keys))
        return pd.DataFrame(out, columns=["fp", "sid", "n", "sketch", "keys"])

    return of(text)


def _leads(keyed: DataFrame) -> DataFrame:
    """``keyed``: key, sid. Returns sid and lead, the smallest sid of the key, of keys with several sids."""

    def several(batches):
        """Rows come sorted by key and sid; a key's first sid is held back until a second one comes."""
        last, first, held = (None, None), None, None
        for part in batches:
            key, sid = part["key"].to_numpy(), part["sid"].to_numpy()
            if not len(key):
                continue
            new_key = np.append(last[0] is None or key[0] != last[0], key[1:] != key[:-1])
            new = new_key | np.append(last[0] is None or sid[0] != last[1], sid[1:] != sid[:-1])
            last = (key[-1], sid[-1])
            key, sid, new_key = key[new], sid[new], new_key[new]
            if not len(key):
                continue
            if not new_key[0] and held is not None:  # goes on with the key of the batch before
                yield pd.DataFrame({"sid": [held], "lead": [held]})
            begin = np.flatnonzero(new_key)
            start = np.maximum.accumulate(np.where(new_key, np.arange(len(key)), -1))
            lead = np.where(start >= 0, sid[start], 0 if first is None else first)
            alone = np.zeros(len(key), bool)
            alone[begin] = np.append(new_key[1:], True)[begin]
            held, first = sid[-1] if alone[-1] else None, lead[-1]
            yield pd.DataFrame({"sid": sid, "lead": lead})[~alone]

    return keyed.repartition("key").sortWithinPartitions("key", "sid").mapInPandas(several, "sid long, lead long")


def lead_rows(rows: DataFrame, common: list[tuple[int, int]]) -> DataFrame:
    """lead, sid, shared (how many keys name that lead), each lead itself among its sids. The lead of a hot
    key is a minimum that each task forms before the shuffle; its rows stay where they are."""
    keyed = rows.where("keys IS NOT NULL").select(F.explode("keys").alias("key"), "sid")
    hot = [(k,) for k, n in common if n > HOT]
    if not hot:
        found = _leads(keyed)
    else:
        hot = F.broadcast(rows.sparkSession.createDataFrame(hot, "key long"))  # MOST_COMMON bounds it
        many = keyed.join(hot, "key", "left_semi")
        top = F.broadcast(many.groupBy("key").agg(F.min("sid").alias("lead")))
        found = _leads(keyed.join(hot, "key", "left_anti")).unionByName(many.join(top, "key").select("sid", "lead"))
    return compacted(found.groupBy("lead", "sid").agg(F.count("*").alias("shared")))


def candidates(group: np.ndarray, sid: np.ndarray, n: np.ndarray, part: np.ndarray, second: np.ndarray, cross: np.ndarray, sketches: list[bytes], similarity: float, forest: bool):
    """Pairs (a, b) of a group, in different parts, that can be similar enough; with ``forest`` only those
    that join parts not yet joined, likely ones first. ``group`` is sorted."""
    least = Fraction(str(similarity))
    order = np.lexsort((n, group))
    group, sid, n, part, second, cross = (x[order] for x in (group, sid, n, part, second, cross))
    sketches = Sketches([sketches[k] for k in order.tolist()])
    # Beginning and end of the sets at least as large as each, and not too large for it.
    edges = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
    ends = np.empty(len(group), np.int64)
    for a, b in zip(edges, edges[1:], strict=False):
        most = n[a:b].astype(np.int64) * least.denominator // least.numerator
        ends[a:b] = a + np.searchsorted(n[a:b], most, "right")
    many = ends - np.arange(len(group)) - 1
    parts = np.unique(part, return_inverse=True)[1]
    parent, at = np.arange(parts.max(initial=0) + 1), 0
    while at < len(group):  # so many rows that about STEP pairs begin with them
        to = max(at + 1, int(np.searchsorted(np.cumsum(many[at:]), STEP, "right")) + at)
        left = np.repeat(np.arange(at, to), many[at:to])
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(many[at:to]) - many[at:to], many[at:to])
        ok = (part[left] != part[right]) & (~cross[left] | (second[left] != second[right]))
        left, right = left[ok], right[ok]
        for k in range(0, len(left), STEP):
            x, y = left[k : k + STEP], right[k : k + STEP]
            ok, both = sketches.possible(x, y, similarity)
            if forest:
                likely = np.flatnonzero(ok)
                likely = likely[np.argsort(-(both / np.maximum(n[x], n[y]))[likely], kind="stable")]
                ok = likely[joins(parent, parts[x[likely]], parts[y[likely]])]
            x, y = x[ok], y[ok]
            yield pd.DataFrame({"a": np.minimum(sid[x], sid[y]), "b": np.maximum(sid[x], sid[y])})
        at = to


def _second_round(under: DataFrame, sets: DataFrame, parts: DataFrame, similarity: float, forest: bool) -> DataFrame:
    """(a, b) of different components under one lead that can be similar enough.

    The sets of a lead's largest component needn't be compared with each other, so they meet only the
    others: tiles of the one with tiles of the other. The others meet each other, too."""
    member = under.select("lead", "sid").join(parts.withColumnRenamed("node", "sid"), "sid", "left").select("lead", "sid", F.coalesce("component", "sid").alias("part"))
    member = compacted(member)
    counts = member.groupBy("lead", "part").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("lead").agg(F.max(F.struct("n", "part")).alias("big"), F.sum("n").alias("n")).where("n > big.n")
    tiles = lambda n: F.ceil(n / TILE).cast("int")
    mixed = compacted(mixed.select("lead", F.col("big.part").alias("most"), tiles(F.col("big.n")).alias("big"), tiles(F.col("n") - F.col("big.n")).alias("small")))
    dealt = member.join(mixed, "lead")
    is_big = F.col("part") == F.col("most")
    own = F.pmod(F.xxhash64("sid"), F.when(is_big, F.col("big")).otherwise(F.col("small")).cast("long")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda kind, t, u, second, cross: F.struct(F.xxhash64("lead", F.lit(kind), t, u).alias("g"), second.alias("second"), cross.alias("cross"))
    yes = F.lit(True)
    of_big = F.transform(every("small"), lambda j: place("big", F.col("own"), j, yes, yes))
    of_small = F.concat(
        F.transform(every("big"), lambda i: place("big", i, F.col("own"), ~yes, yes)),
        F.transform(every("small"), lambda o: place("small", F.least("own", o), F.greatest("own", o), F.col("own") >= o, F.col("own") != o)),
    )
    dealt = dealt.withColumns({"own": own, "is_big": is_big}).select("sid", "part", F.explode(F.when(F.col("is_big"), of_big).otherwise(of_small)).alias("p")).select("sid", "part", "p.*")
    full = dealt.join(sets.select("sid", "n", "sketch"), "sid").repartition("g").sortWithinPartitions("g")

    def find(batches):
        for p in whole_groups(batches):
            yield from candidates(*(p[c].to_numpy() for c in ("g", "sid", "n", "part", "second", "cross")), list(p["sketch"]), similarity, forest)

    return full.mapInPandas(find, "a long, b long").distinct()


def _verified(docs: DataFrame, text: str, pairs: DataFrame, sets: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) that are similar enough. The shingles of each set are made once; a task gets those of
    ``a`` once and those of each ``b`` after them, and holds two sets at a time."""
    needed = sets.join(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "sid", "left_semi").select("mark", "sid")
    needed = compacted(needed)
    sent = F.broadcast(needed) if needed.count() <= MOST_SENT else needed
    texts = docs.select(F.xxhash64(text).alias("mark"), F.col(text).alias("text")).join(sent, "mark")

    @F.pandas_udf("binary")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, words).tobytes() for t in texts], dtype=object)

    one = texts.groupBy("sid").agg(F.any_value("text").alias("text"))
    known = checkpointed(one.select("sid", hashed("text").alias("shingles")))
    dealt = pairs.withColumn("share", F.pmod(F.xxhash64("b"), F.lit(SPREAD)).cast("int"))
    heads = dealt.select("a", "share").distinct().join(known.withColumnRenamed("sid", "a"), "a").select("a", "share", F.lit(True).alias("head"), F.col("a").alias("b"), "shingles")
    tails = dealt.join(known.withColumnRenamed("sid", "b"), "b").select("a", "share", F.lit(False).alias("head"), "b", "shingles")
    rows = heads.unionByName(tails).repartition("a", "share").sortWithinPartitions("a", "share", F.desc("head"), "b")

    def verified(batches):
        mine = None
        for part in batches:
            out = []
            for a, head, b, raw in zip(part["a"], part["head"], part["b"], part["shingles"], strict=True):
                found = np.frombuffer(raw, np.uint64)
                if head:
                    mine = found
                elif alike(mine, found, similarity):
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return compacted(rows.select("a", "head", "b", "shingles").mapInPandas(verified, "a long, b long"))


def similar_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each of ``docs``: doc_id, mark (hash of the text) and label, the same in a component."""
    spark = docs.sparkSession
    small_batches(spark)
    common = common_shingles(docs, text, words, similarity)
    sent = spark.sparkContext.broadcast(np.sort(np.array([k for k, _ in common], np.int64).view(np.uint64)))
    said = _prints(F.col(text), words, similarity, sent)
    rows = checkpointed(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("mark"), said.alias("p")).select("doc_id", "mark", "p.*"))
    under = lead_rows(rows, common)
    sets = compacted(rows.groupBy("sid").agg(F.min("mark").alias("mark"), F.min("fp").alias("fp"), F.max("n").alias("n"), F.max("sketch").alias("sketch")), 50_000)

    reps = compacted(sets.groupBy("fp").agg(F.min("sid").alias("rep")))
    linked = links(reps.select("fp"), RADIUS)
    for c in ("a", "b"):
        linked = linked.join(reps.select(F.col("fp").alias(c), F.col("rep").alias(f"{c}_")), c).drop(c).withColumnRenamed(f"{c}_", c)
    same = sets.join(reps, "fp").where("sid <> rep").select(F.col("rep").alias("a"), F.col("sid").alias("b"))
    best = under.where("sid <> lead").groupBy("sid").agg(F.max(F.struct("shared", "lead")).alias("x")).select(F.col("x.lead").alias("a"), F.col("sid").alias("b"))
    first = linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(same).unionByName(best).distinct()

    @F.pandas_udf("boolean")
    def may(a: pd.Series, b: pd.Series) -> pd.Series:
        at = np.arange(len(a))
        return pd.Series(Sketches([*a, *b]).possible(at, at + len(a), similarity)[0], dtype=bool)

    for c in ("a", "b"):
        first = first.join(sets.select(F.col("sid").alias(c), F.col("sketch").alias(f"sketch_{c}")), c)
    first = compacted(first.where(may("sketch_a", "sketch_b")).select("a", "b"))
    edges = _verified(docs, text, first, sets, words, similarity)
    parts, tried = connected_components(edges), first
    for forest in (True, False):  # what likely joins components, then all that may still do so
        more = compacted(_second_round(under, sets, parts, similarity, forest).join(tried, ["a", "b"], "left_anti"))
        edges, tried = edges.unionByName(_verified(docs, text, more, sets, words, similarity)), tried.unionByName(more)
        parts = connected_components(edges)
    labels = compacted(sets.select("sid").join(parts.withColumnRenamed("node", "sid"), "sid", "left").select("sid", F.coalesce("component", "sid").alias("label")))
    return rows.select("doc_id", "mark", "sid").join(labels, "sid").select("doc_id", "mark", "label")


def drop_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id."""
    return first_of_each(docs, similar_texts(docs, doc_id, text, words, similarity), doc_id, text)
