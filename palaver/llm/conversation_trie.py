"""Operator 12: the prefix trie of all conversations, by van Emde Boas recursion over depths.

A sequence of turns is cut at half its (padded) depth, its halves again, down to single turns. Each half
gets a name, the digest of its two halves' names, all conversations of a level in one grouping. What lies
before a cut names the root of the forest below it, so the name of the first d turns is the fold of the
halves that the binary form of d cuts off: every prefix of every conversation gets its name from a
logarithmic number of halves, the upper trie and the lower forests of all levels side by side. Equal
names are one node. Totals (leaves, saved tokens) are then grafted upward, smallest pieces first: in a
round, each node that is the root of a lower piece of 2^k depths adds its total to its 2^k ancestors in the
upper piece, along the path of its smallest member. No conversation, node or subtree is ever held in one
row or task: turns stay rows, groups are only counted, summed and minimised with partial aggregation.

Names are 128 bits of SHA-256, of (length of the role, role, text) for a turn, so equal names are equal
sequences but for collisions that are not to be expected. Texts don't leave the scan.

Rows without a conv_id are left out; null roles and texts are empty; turns go by turn (null first), ties by
role, then by the digest of the turn, so repeated rows are repeated turns; conversations of any length and
nodes with any number of members are dealt with alike; other columns are ignored, also those named as
internal ones; an empty table gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.operators.numbering import numbered

from .common import checkpointed, compacted, read

#: Words of a text, as the contract has them.
WORD = r"[^\x20\x09-\x0D]+"
#: Conversations of an end list that are joined to one string; a digest is fed with such strings.
LISTED = 8192
ROOT = hashlib.sha256(b"root").digest()[:16]
#: Members of a donor's group, and the most turns that are taken from it.
FAMILY, MOST_TAKEN = 20, 3


def _digest(*parts: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def ordered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 0), name, words of each turn."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    named = F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_)
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), role_.alias("role"), _digest(F.encode(named, "UTF-8")).alias("name"), F.regexp_count(text_, F.lit(WORD)).cast("long").alias("words")
    )
    placed = numbered(rows, ["conv_id"], [F.asc_nulls_first("turn"), "role", "name"], "k")
    return placed.select("conv_id", (F.col("k") - 1).cast("long").alias("pos"), "name", "words")


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences as they are: (turns with len, conv_id and len of each conversation)."""
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("len"))
    return turns.join(lengths, "conv_id"), lengths


def regrown(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations begin with the first h turns of their family's first one, h = crc32 of the id modulo 4;
    their own turns after the first h follow. Returns as ``whole``; a conversation may end up without turns."""
    n = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    family = n.select(F.col("conv_id").alias("donor"), F.col("own").alias("given"))
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % 4).cast("long")
    plan = n.withColumns({"h": h, "donor": F.col("conv_id") - F.col("conv_id") % FAMILY}).join(family, "donor", "left")
    taken = F.least("h", F.coalesce("given", F.lit(0)))
    plan = checkpointed(plan.select("conv_id", "donor", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len")))
    heads = turns.where(F.col("pos") < MOST_TAKEN).select(F.col("conv_id").alias("donor"), "pos", "name", "words")
    first = plan.where("taken > 0").join(heads, "donor").where("pos < taken").select("conv_id", "pos", "name", "words", "len")
    rest = turns.join(plan, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "name", "words", "len")
    return first.unionByName(rest), plan.select("conv_id", "len")


def prefixes(sequences: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv_id, depth, name, words (of the last turn), len: every prefix of every conversation."""
    turns = checkpointed(sequences.select("conv_id", "pos", "name", "words", "len"))
    depth = turns.agg(F.max("len")).first()[0] or 0
    halves, level = turns.select("conv_id", F.col("pos").alias("j"), "name", "len"), 0
    uses = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("binary").alias("name"), "words", "len")
    while depth >> level:
        # A half on the left names the cut for all depths in the half beside it.
        begin = F.shiftleft(F.col("j") + 1, level)
        last = F.least(F.shiftleft(F.col("j") + 2, level) - 1, F.col("len"))
        left = halves.where((F.col("j") % 2 == 0) & (begin <= F.col("len")))
        uses = uses.unionByName(left.select("conv_id", F.explode(F.sequence(begin, last)).alias("depth"), F.lit(-level).alias("k"), "name", F.lit(None).cast("long").alias("words"), "len"))
        pair = halves.groupBy("conv_id", F.shiftright("j", 1).alias("i")).agg(F.max(F.when(F.col("j") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("j") % 2 == 1, F.col("name"))).alias("b"), F.max("len").alias("len"))
        halves = pair.where("a IS NOT NULL AND b IS NOT NULL").select("conv_id", F.col("i").alias("j"), _digest(F.lit(b"+"), "a", "b").alias("name"), "len")
        level += 1
        if level % 6 == 0:
            halves = checkpointed(halves)
    cuts = F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "name"))))  # the largest half first
    each = uses.groupBy("conv_id", "depth").agg(cuts.alias("cuts"), F.max("words").alias("words"), F.max("len").alias("len"))
    folded = F.aggregate("cuts", F.lit(ROOT), lambda name, cut: _digest(F.lit(b"-"), name, cut["name"]))
    below = each.select("conv_id", "depth", folded.alias("name"), "words", "len")
    root = lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("name"), F.lit(0).cast("long").alias("words"), "len")
    return below.unionByName(root)


def end_digests(ends: DataFrame) -> DataFrame:
    """name, ends_sha256 for (name, conv_id) rows: ids in ascending order, joined by commas. Ids are sorted in
    ranges, joined to strings there, and only these go to the task that feeds a name's digest."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, out = None, [], []
        for batch in batches:
            for n, i in zip(batch["name"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
                if ids and (n != name or len(ids) == LISTED):
                    out.append((name, ids[0], ",".join(map(str, ids))))
                    ids = []
                name = n
                ids.append(i)
            if len(out) > 1000:
                yield _batch(out, "first", pa.int64(), "ids")
                out = []
        if ids:
            out.append((name, ids[0], ",".join(map(str, ids))))
        yield _batch(out, "first", pa.int64(), "ids")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sha, out = None, None, []
        for batch in batches:
            for n, ids in zip(batch["name"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if n == name:
                    sha.update(b"," + ids.encode())
                else:
                    if sha:
                        out.append((name, sha.hexdigest()))
                    name, sha = n, hashlib.sha256(ids.encode())
            if len(out) > 1000:
                yield _batch(out, "ends_sha256", pa.string())
                out = []
        if sha:
            out.append((name, sha.hexdigest()))
        yield _batch(out, "ends_sha256", pa.string())

    ranges = ends.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
    lists = ranges.mapInArrow(listed, "name binary, first long, ids string")
    return lists.repartition("name").sortWithinPartitions("name", "first").mapInArrow(digested, "name binary, ends_sha256 string")


def _batch(rows: list[tuple], second: str, kind: pa.DataType, third: str | None = None) -> pa.RecordBatch:
    columns = {"name": pa.array([r[0] for r in rows], pa.binary()), second: pa.array([r[1] for r in rows], kind)}
    if third:
        columns[third] = pa.array([r[2] for r in rows], pa.string())
    return pa.RecordBatch.from_pydict(columns)


def trie(sequences: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    at = checkpointed(prefixes(sequences, lengths))
    path = at.select(F.col("conv_id").alias("on"), F.col("depth").alias("up"), F.col("name").alias("above"))
    nodes = at.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    nodes = nodes.join(path, (F.col("on") == F.col("conv_id")) & (F.col("up") == F.col("depth") - 1), "left").select(*nodes.columns, F.col("above").alias("parent"))
    nodes = checkpointed(nodes)
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = compacted(nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("words")
    totals = nodes.select("name", "conv_id", "depth", leaf.alias("n_leaves"), saved.alias("saved_tokens"))
    deepest, piece = nodes.agg(F.max("depth")).first()[0] or 0, 1
    while piece <= deepest:
        roots = totals.where((F.col("depth") % (2 * piece) == piece) & ((F.col("n_leaves") > 0) | (F.col("saved_tokens") > 0)))
        reach = roots.select("conv_id", F.explode(F.sequence(F.col("depth") - piece, F.col("depth") - 1)).alias("up_"), "n_leaves", "saved_tokens")
        grafts = reach.join(path, (F.col("on") == F.col("conv_id")) & (F.col("up") == F.col("up_")))
        grafts = grafts.select(F.col("above").alias("name"), F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("depth"), "n_leaves", "saved_tokens")
        totals = totals.unionByName(grafts).groupBy("name").agg(F.max("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        totals = checkpointed(totals)
        piece *= 2
    above = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ends = end_digests(at.where("depth = len").select("name", "conv_id"))
    joined = nodes.join(above, "parent", "left").join(totals.select("name", "n_leaves", "saved_tokens"), "name").join(ends, "name", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    return trie(*regrown(checkpointed(ordered(read(spark, sf_dir, "conversations")))))


OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), b AS (
  SELECT conv_id, conv_id - conv_id % 20 AS donor, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: unicode(c)::UBIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, zero: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), s AS (
  SELECT b.conv_id, coalesce(list({'role': t.role, 'text': t.text} ORDER BY t.conv_id <> b.donor OR t.pos >= b.h, t.pos) FILTER (t.pos IS NOT NULL), []) AS seq
  FROM b LEFT JOIN t ON (t.conv_id = b.donor AND t.pos < b.h) OR (t.conv_id = b.conv_id AND t.pos >= b.h)
  GROUP BY b.conv_id
), m AS (
  SELECT conv_id, d, seq[1:d] AS p, len(seq) = d AS ends FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM s)
), n AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ended,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(p[d].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM m GROUP BY p, d
), k AS (
  SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM n AS c WHERE c.d = n.d + 1 AND c.p[1:n.d] = n.p) AS n_children
  FROM n LEFT JOIN n AS u ON u.d = n.d - 1 AND n.p[1:u.d] = u.p
)
SELECT k.conv_id, k.d AS depth, any_value(k.parent_conv_id) AS parent_conv_id, any_value(k.n_convs) AS n_convs, any_value(k.n_children) AS n_children,
  CAST(sum((x.n_children = 0)::BIGINT) AS BIGINT) AS n_leaves, CAST(sum(x.saved) AS BIGINT) AS saved_tokens, sha256(any_value(k.ended)) AS ends_sha256
FROM k JOIN k AS x ON x.d >= k.d AND x.p[1:k.d] = k.p
GROUP BY k.conv_id, k.d
"""
