"""Operator 13: hard negatives by inner product, with angular triangle filtering.

Every row keeps its angles to a few reference directions. By the triangle inequality on the sphere, the
angle between two rows lies between the largest difference and the smallest sum of such angles (a sum
over pi counts from the other side), so the cosine lies in an interval; times the norms, and widened
by more than all rounding, it bounds the integer score. Only rows whose bounds overlap what an anchor still
looks for are scored, exactly.

Rows are packed into blocks of one label and of neighbouring angles, anchors into smaller ones. A block keeps
the hull of its angles and norms, so pairs of blocks are bounded before any vector is moved: first each anchor
block meets its most promising blocks, which gives what an answer must reach at least; then all
other blocks whose bounds reach that. A task holds one anchor block and one row block at a time, and keeps
the best few per anchor and window. Positives come first (rows of the anchor's label, one window
without ends); each gives a window for negatives. The filter only saves work: whatever the
references, all rows are searched.

Left out: rows with a null id, label or vector, or with a null or non-finite component. Vectors of
different lengths are filled with zeros, empty ones score 0. Codes are exact integers; scores beyond a
long are cut to its ends. Repeated rows are rows; an anchor's others are those of another id. Ties go to the
smaller id. Fewer rows give fewer answers, an empty table none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, read, small_batches

#: Reference directions: rows with the smallest hashes of their ids.
REFERENCES = 16
BLOCK_ROWS, BLOCK_ANCHORS = 2048, 512
#: Blocks that an anchor block meets in the first round, and that one task goes through in the second.
FIRST, TASK_BLOCKS = 2, 64
#: More than the rounding of angles (stored in 32 bits) and cosines, in radians and parts of the norms.
ANGLE_SLACK, SCORE_SLACK = 4e-6, 8e-6
SCALE = 256
FAR = (1 << 63) - 1
_BLOCK = "block long, label {label}, n int, ids binary, codes binary, kind string, dim int, angles binary, lo array<float>, hi array<float>, norm_lo double, norm_hi double"
_FOUND = "ablock long, place int, anchor_id long, w int, id long, score long"


def usable(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """id, label, v of the rows that take part."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & ~bad)
    return rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Codes of a list array, as floats without a fraction."""
    size = np.asarray(lists.value_lengths()).astype(np.int64)
    dim = int(size.max(initial=0))
    out = np.zeros((len(size), dim))
    out[np.arange(dim) < size[:, None]] = np.asarray(lists.flatten(), np.float64)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(out * SCALE), -1.7e308, 1.7e308)


def _norms(codes: np.ndarray) -> np.ndarray:
    top = np.abs(codes).max(axis=1, initial=1.0)
    return np.sqrt(np.square(codes / top[:, None]).sum(axis=1)) * top


def _angles(codes: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles to unit directions; a zero vector, whose scores are 0 anyway, gets a right angle."""
    dim, norms = min(codes.shape[1], references.shape[1]), _norms(codes)
    unit = codes[:, :dim] / np.where(norms > 0, norms, 1)[:, None]
    return np.arccos(np.clip(unit @ references[:, :dim].T, -1, 1)).astype(np.float32)


def _references(rows: DataFrame) -> np.ndarray:
    """Unit vectors, at most REFERENCES of them."""
    some = rows.select(F.xxhash64("id").alias("h"), "id", "v").orderBy("h", "id").limit(REFERENCES).collect()
    codes = _matrix(pa.array([r["v"] for r in some], pa.list_(pa.float64())))
    norms = _norms(codes)
    return (codes / np.where(norms > 0, norms, 1)[:, None])[norms > 0] if (norms > 0).any() else np.eye(1)


def _packed(rows: DataFrame, references: np.ndarray, most: int) -> DataFrame:
    """Blocks of up to ``most`` rows of one label, which lie at neighbouring angles of one reference."""
    kind, dims = rows.schema["label"].dataType.simpleString(), references.shape[1]
    names = ["id", "label", "v", "near", "angle"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            angles = _angles(_matrix(b["v"]), references) if dims and len(b["v"]) else np.zeros((len(b["v"]), 1), np.float32)
            near = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*[b[c] for c in names[:3]], pa.array(near, pa.int32()), pa.array(angles[np.arange(len(near)), near], pa.float32())], names)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        number = TaskContext.get().partitionId() << 32

        def close(part: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal number
            number += 1
            t = pa.Table.from_batches(part).combine_chunks()
            codes = _matrix(t["v"].combine_chunks() if t["v"].num_chunks != 1 else t["v"].chunk(0))
            top = np.abs(codes).max(initial=0)
            narrow = "int16" if top < 1 << 15 else "int32" if top < 1 << 31 else "float64"
            angles, norms = _angles(codes, references), _norms(codes)
            values = [number, t["label"][0].as_py(), len(codes), np.asarray(t["id"], np.int64).tobytes(), codes.astype(narrow).tobytes(), narrow, codes.shape[1], angles.tobytes(), angles.min(axis=0).tolist(), angles.max(axis=0).tolist(), float(norms.min()), float(norms.max())]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, _schema(t.schema.field("label").type), strict=True)], schema=_schema(t.schema.field("label").type))

        for b in batches:
            labels = b["label"].to_pylist()
            start = 0
            for k in range(len(labels)):
                new = labels[k] != (labels[k - 1] if k else held[-1]["label"][-1].as_py() if held else labels[k])
                if new or many + k - start == most:
                    part = [*held, b.slice(start, k - start)] if k > start else held
                    if part:
                        yield close(part)
                    held, many, start = [], 0, k
            if len(labels) > start:
                held.append(b.slice(start))
                many += len(labels) - start
        if held:
            yield close(held)

    shown = rows.mapInArrow(placed, f"id long, label {kind}, v array<double>, near int, angle float")
    order = ["label", "near", "angle", "id"]
    return shown.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(blocks, _BLOCK.format(label=kind))


def _schema(label: pa.DataType) -> pa.Schema:
    b, i, f, d = pa.binary(), pa.int32(), pa.list_(pa.float32()), pa.float64()
    kinds = [pa.int64(), label, i, b, b, pa.string(), i, b, f, f, d, d]
    return pa.schema(list(zip(["block", "label", "n", "ids", "codes", "kind", "dim", "angles", "lo", "hi", "norm_lo", "norm_hi"], kinds, strict=True)))


def _reach(a: str, b: str) -> tuple[Column, Column]:
    """(lowest, highest) score between two blocks, by the hulls of their angles and norms."""
    apart = F.zip_with(F.zip_with(f"{a}.lo", f"{b}.hi", lambda x, y: x - y), F.zip_with(f"{b}.lo", f"{a}.hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y))
    least = F.greatest(F.array_max(apart).cast("double") - ANGLE_SLACK, F.lit(0.0))
    sums = F.zip_with(F.zip_with(f"{a}.hi", f"{b}.hi", lambda x, y: x + y), F.zip_with(f"{a}.lo", f"{b}.lo", lambda x, y: F.lit(2 * np.pi) - x - y), lambda x, y: F.least(x, y))
    most = F.least(F.array_min(sums).cast("double") + ANGLE_SLACK, F.lit(float(np.pi)))
    small, large = F.col(f"{a}.norm_lo") * F.col(f"{b}.norm_lo"), F.col(f"{a}.norm_hi") * F.col(f"{b}.norm_hi")
    times = lambda c, up: c * F.when((c >= 0) == F.lit(up), large).otherwise(small)
    slack = large * SCORE_SLACK + 1
    return times(F.cos(most), False) - slack, times(F.cos(least), True) + slack


def _unpacked(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer(r["codes"], r["kind"]).reshape(r["n"], r["dim"]).astype(np.float64)
    return np.frombuffer(r["ids"], np.int64), codes, np.frombuffer(r["angles"], np.float32).reshape(r["n"], -1), _norms(codes)


def _scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row, exactly."""
    dim = min(a.shape[1], x.shape[1])
    a, x = a[:, :dim], x[:, :dim]
    if np.abs(a).max(initial=0) * np.abs(x).max(initial=0) * max(dim, 1) < 1 << 53:
        return np.einsum("ij,ij->i", a, x).astype(np.int64)
    exact = (sum(int(p) * int(q) for p, q in zip(s, t, strict=True)) for s, t in zip(a.tolist(), x.tolist(), strict=True))
    return np.array([max(-FAR, min(FAR, e)) for e in exact], np.int64)


class _Anchors:
    """An anchor block with the best of what its windows have met. Bounds of windows are longs, both included."""

    def __init__(self, r: dict, k: int, others: bool):
        self.ids, self.codes, self.angles, self.norms = _unpacked(r)
        self.k, self.others, n = k, others, len(self.ids)
        bounds = np.frombuffer(r["windows"], np.int64).reshape(n, -1, 2)
        self.low, self.high, self.wide = bounds[..., 0].copy(), bounds[..., 1], bounds.shape[1]
        # What is kept: windows by number (place * wide + window), scores and ids, best first.
        self.window, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def meet(self, r: dict) -> None:
        ids, codes, angles, norms = _unpacked(r)
        lo, hi = np.array(r["lo"], np.float32), np.array(r["hi"], np.float32)
        apart = np.maximum(self.angles - hi, lo - self.angles).max(axis=1)
        sums = np.minimum(self.angles + hi, 2 * np.pi - self.angles - lo).min(axis=1)
        low, high = self._bounds(apart, sums, (self.norms * r["norm_lo"], self.norms * r["norm_hi"]))
        live = np.flatnonzero(self._wanted(low[:, None], high[:, None]).any(axis=1))
        for a in range(0, len(live), 64):
            at = live[a : a + 64]
            mine = self.angles[at]
            apart = np.zeros((len(at), len(ids)), np.float32)
            sums = np.full(apart.shape, np.pi, np.float32)
            for k in range(mine.shape[1]):
                one, all_ = mine[:, k, None], angles[None, :, k]
                np.maximum(apart, np.abs(one - all_), out=apart)
                total = one + all_
                np.minimum(sums, np.minimum(total, 2 * np.pi - total), out=sums)
            product = self.norms[at][:, None] * norms
            low, high = self._bounds(apart, sums, (product, product))
            wanted = np.zeros(apart.shape, bool)
            for w in range(self.wide):
                wanted |= (high >= self.low[at, w, None]) & (low <= self.high[at, w, None]) & (self.low[at, w, None] <= self.high[at, w, None])
            row, col = np.nonzero(wanted)
            if len(row):
                self._take(at[row], ids[col], _scores(self.codes[at[row]], codes[col]))

    @staticmethod
    def _bounds(apart: np.ndarray, sums: np.ndarray, products: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        small, large = products
        high = np.cos(np.maximum(apart.astype(np.float64) - ANGLE_SLACK, 0))
        low = np.cos(np.minimum(sums.astype(np.float64) + ANGLE_SLACK, np.pi))
        slack = large * SCORE_SLACK + 1
        return low * np.where(low >= 0, small, large) - slack, high * np.where(high >= 0, large, small) + slack

    def _wanted(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (high >= self.low) & (low <= self.high) & (self.low <= self.high)

    def _take(self, place: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if self.others:
            other = ids != self.ids[place]
            place, ids, scores = place[other], ids[other], scores[other]
        for w in range(self.wide):
            inside = (scores >= self.low[place, w]) & (scores <= self.high[place, w])
            self.window = np.concatenate([self.window, place[inside] * self.wide + w])
            self.score, self.id = np.concatenate([self.score, scores[inside]]), np.concatenate([self.id, ids[inside]])
        order = np.lexsort((self.id, -self.score, self.window))
        window = self.window[order]
        first = np.concatenate([[True], window[1:] != window[:-1]]) if len(window) else np.zeros(0, bool)
        nth = np.arange(len(window)) - np.maximum.accumulate(np.where(first, np.arange(len(window)), 0))
        order, nth = order[nth < self.k], nth[nth < self.k]
        self.window, self.score, self.id = self.window[order], self.score[order], self.id[order]
        full = nth == self.k - 1  # what comes later must reach the last one kept
        self.low[self.window[full] // self.wide, self.window[full] % self.wide] = self.score[full]

    def found(self, block: int) -> pa.RecordBatch:
        place = self.window // self.wide
        columns = {"ablock": np.full(len(place), block, np.int64), "place": place.astype(np.int32), "anchor_id": self.ids[place], "w": (self.window % self.wide).astype(np.int32), "id": self.id, "score": self.score}
        return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})


def _searched(pairs: DataFrame, anchors: DataFrame, blocks: DataFrame, k: int, others: bool) -> DataFrame:
    """The ``k`` best of each anchor's windows among the blocks that ``pairs`` (ablock, part, turn, block) names.
    ``anchors`` has windows: n x w x 2 longs for each block, ``open`` of which aren't empty."""
    data = ["n", "ids", "codes", "kind", "dim", "angles", "lo", "hi", "norm_lo", "norm_hi"]
    first = pairs.select("ablock", "part").distinct().join(anchors.withColumnRenamed("block", "ablock"), "ablock").select("ablock", "part", F.lit(-1).alias("turn"), *data, "windows")
    rest = pairs.join(blocks, "block").select("ablock", "part", "turn", *data, F.lit(None).cast("binary").alias("windows"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, anchors_ = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if r["windows"] is not None:
                    if anchors_ is not None:
                        yield anchors_.found(block)
                    block, anchors_ = r["ablock"], _Anchors(r, k, others)
                else:
                    anchors_.meet(r)
        if anchors_ is not None:
            yield anchors_.found(block)

    dealt = first.unionByName(rest).repartition("ablock", "part").sortWithinPartitions("ablock", "part", "turn")
    found = checkpointed(dealt.mapInArrow(stream, _FOUND))
    best = Window.partitionBy("ablock", "place", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _best(bounded: DataFrame, anchors: DataFrame, blocks: DataFrame, k: int, others: bool) -> DataFrame:
    """``bounded``: ablock, block, low, high of all pairs of blocks that may be searched, and the hull of the anchor
    block's windows. First the pairs with the highest bounds, then all that may still hold a better row."""
    order = Window.partitionBy("ablock").orderBy(F.desc("high"), "block")
    pairs = checkpointed(bounded.where("high >= from_ AND low <= to_").select("ablock", "block", "high", F.row_number().over(order).alias("turn")))
    start = checkpointed(_searched(pairs.where(F.col("turn") <= FIRST).select("ablock", F.lit(0).alias("part"), "turn", "block"), anchors, blocks, k, others))
    # What each window of a block must reach: its kth so far; a block where some window has fewer is held to nothing.
    full = start.where(F.col("rank") == k).groupBy("ablock").agg(F.count("*").alias("full"), F.min("score").alias("least"))
    need = anchors.select(F.col("block").alias("ablock"), "open").join(full, "ablock", "left")
    need = need.select("ablock", F.when(F.col("full") == F.col("open"), F.col("least")).alias("least"))
    left = pairs.where(F.col("turn") > FIRST).join(need, "ablock").where(F.col("least").isNull() | (F.col("high") >= F.col("least")))
    left = left.select("ablock", F.floor((F.col("turn") - 1) / TASK_BLOCKS).cast("int").alias("part"), "turn", "block")
    later = _searched(left, anchors, blocks, k, others)
    best = Window.partitionBy("ablock", "place", "w").orderBy(F.desc("score"), "id")
    both = start.drop("rank").unionByName(later.drop("rank")).withColumn("rank", F.row_number().over(best))
    return checkpointed(both.where(F.col("rank") <= k))


def mine(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 50, positives: int = 5, negatives: int = 3, share: tuple[int, int] = (50, 95)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Anchors are the rows whose id is
    divisible by ``every``; a negative's score lies between these percentages of the positive's."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = usable(vectors, vec_id, vector, label)
    references = _references(rows)
    blocks = checkpointed(_packed(rows, references, BLOCK_ROWS))
    packed = checkpointed(_packed(rows.where(F.col("id") % every == 0), references, BLOCK_ANCHORS))
    hulls = lambda df: df.select("block", "label", F.struct("lo", "hi", "norm_lo", "norm_hi").alias("hull"))
    a, b = hulls(packed).toDF("ablock", "alabel", "a"), hulls(blocks).toDF("block", "blabel", "b")
    low, high = _reach("a", "b")

    endless = F.udf(lambda n: np.tile(np.array([-FAR, FAR]), n).tobytes(), "binary", useArrow=False)
    everywhere = packed.withColumns({"windows": endless("n"), "open": F.col("n")})
    pairs = a.join(b, F.col("alabel") == F.col("blabel")).select("ablock", "block", low.alias("low"), high.alias("high"), F.lit(float("-inf")).alias("from_"), F.lit(float("inf")).alias("to_"))
    met = _best(pairs, everywhere, blocks, positives, True).select("ablock", "place", "anchor_id", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))

    # An anchor block's windows: one for each place and positive; without a positive an empty one.
    def windows(n: int, found: list) -> tuple:
        out = np.tile(np.array([FAR, -FAR]), (n, positives, 1))
        for place, w, score in found or []:
            out[place, w - 1] = -(-share[0] * score // 100), share[1] * score // 100
        some = out[out[..., 0] <= out[..., 1]]
        return out.tobytes(), len(some), float(some[:, 0].min()) if len(some) else float("inf"), float(some[:, 1].max()) if len(some) else float("-inf")

    windows_of = F.udf(windows, "struct<windows: binary, open: int, from_: double, to_: double>", useArrow=False)
    listed = met.groupBy(F.col("ablock").alias("block")).agg(F.collect_list(F.struct("place", "w", "positive_score")).alias("found"))
    narrowed = packed.join(listed, "block", "left").withColumn("x", windows_of("n", "found")).drop("found")
    narrowed = checkpointed(narrowed.select(*packed.columns, "x.windows", "x.open", "x.from_", "x.to_").where("open > 0"))
    # Hulls against hulls: the stated queries in blocks, without a vector in it. Each anchor block has a number, and
    # each block of rows meets all numbers.
    numbers = max(1, narrowed.count())
    number = F.pmod(F.xxhash64("block"), F.lit(numbers)).cast("int")
    few = narrowed.select("block", "label", F.struct("lo", "hi", "norm_lo", "norm_hi").alias("a"), "from_", "to_", number.alias("number")).toDF("ablock", "alabel", "a", "from_", "to_", "number")
    asked = b.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(numbers - 1))))
    pairs = asked.join(few, "number").where("alabel <> blabel").select("ablock", "block", low.alias("low"), high.alias("high"), "from_", "to_")
    got = _best(pairs, narrowed, blocks, negatives, False)
    got = got.select("ablock", "place", (F.col("w") + 1).alias("w"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return met.join(got, ["ablock", "place", "w"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", "embedding", label.alias("label")))


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_inner_product(a.c, v.c) AS BIGINT) AS score
  FROM v AS a, v WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND anchor_id <> vec_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
