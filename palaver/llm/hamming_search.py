"""Operator 5: exact top-k Hamming search by incremental multi-index hashing.

Vectors become binary codes (the sign of each component). Rows with one code form a class; a class
is searched once and keeps its smallest ids: k, and as many as one asking id has codes (one, where ids are
unique), which is all that a top-k answer can use of it.
Codes are cut into segments, each indexed by its value. A round of radius r looks up, for each query
that is still open, all segment values exactly r bits away, and verifies the full distance of what it
meets. After it, every code closer than segments * (r + 1) has been met in some segment, so a query
is closed once its kth nearest row lies below that bound. Its answer is then exact; ties go to the
smaller id. What lies farther than the kth nearest row met so far is dropped as soon as it is verified.

Queries are the rows whose id is divisible by ``every``; a row is not its own neighbour. Null ids and
null or empty vectors are left out; null components count as 0. Vectors of another length are cut or
filled to ``bits``. With fewer than k other rows all of them are returned. Rows that agree in
id and code count once. An id with several codes is found by each of them, never by itself, and where it
asks, it gets the k nearest to any of them (a neighbour once for each of its codes).
"""

from __future__ import annotations

from itertools import combinations
from math import comb, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, read

#: Lookups a query may make in a round. Beyond it the codes are cut into one segment more and the
#: rounds begin anew for the queries that are still open; what was met stays met.
MOST_MASKS = 50_000


def binary_code(vector: Column, bits: int = 64) -> Column:
    """The signs of the first ``bits`` components as a long, the first component lowest."""
    code = F.lit(0).cast("long")
    for k in range(bits):
        code = code.bitwiseOR(F.when(F.get(vector, F.lit(k)) > 0, F.lit(-(1 << 63) if k == 63 else 1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return code


def segment_count(codes: int, bits: int) -> int:
    """Segments a little shorter than log2(codes): a lookup meets some codes, and far fewer lookups are
    made than with one code each, as their number grows fastest with the width."""
    return min(16, max(2, round(bits / max(4.0, log2(max(codes, 2)) - 3))))


def cut(bits: int, many: int) -> list[tuple[int, int]]:
    """(start, width) of so many segments."""
    edges = [round(bits * k / many) for k in range(many + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def top_k(vectors: DataFrame, k: int = 10, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding", bits: int = 64) -> DataFrame:
    """(query_id, rank from 1, neighbour_id, distance)."""
    usable = vectors.where(F.col(vec_id).isNotNull() & (F.size(vector) > 0))
    coded = usable.select(F.col(vec_id).alias("id"), binary_code(F.col(vector), bits).alias("code"))
    rows = checkpointed(coded.distinct())
    queries = rows.where(F.col("id") % every == 0)
    # What a query id's own rows may take of a list, besides the k that count.
    most = k + (queries.groupBy("id").count().agg(F.max("count")).first()[0] or 1)
    lowest = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    members = rows.withColumn("n", lowest).where(F.col("n") <= most)
    classes = checkpointed(members.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    segments, spark = cut(bits, segment_count(classes.count(), bits)), vectors.sparkSession

    def exploded(df: DataFrame, code: str) -> DataFrame:
        values = [F.shiftrightunsigned(code, a).bitwiseAND((1 << w) - 1) for a, w in segments]
        return df.select("*", F.posexplode(F.array(*values)).alias("segment", "value"))

    def indexed() -> DataFrame:
        return checkpointed(exploded(classes, "code").select("segment", "value", "code", F.least(F.size("ids"), F.lit(most)).alias("many"), F.get("ids", F.lit(0)).alias("least")))

    index = indexed()
    # `reach`: no code farther than this can be among the answers; null: not known yet.
    open_ = queries.select(F.col("code").alias("q")).distinct().withColumn("reach", F.lit(None).cast("int"))
    met = done = None
    order = Window.partitionBy("q").orderBy("distance", "least")
    radius = bound = 0
    while bound <= bits:
        if sum(comb(w, radius) for _, w in segments) > MOST_MASKS:
            segments, radius = cut(bits, len(segments) + 1), 0
            index = indexed()
            continue
        masks = spark.createDataFrame([(s, m) for s, (_, w) in enumerate(segments) for m in _masks(w, radius)], "segment int, mask long")
        probes = exploded(open_, "q").join(F.broadcast(masks), "segment")  # MOST_MASKS bounds it
        probes = probes.select("q", "reach", "segment", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
        distance = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
        found = probes.join(index, ["segment", "value"]).where(F.col("reach").isNull() | (distance <= F.col("reach")))
        found = found.select("q", "code", "many", "least", distance.alias("distance")).distinct()
        if met is not None:
            found = found.unionByName(met.join(open_, "q", "left_semi")).distinct()
        # So many codes are enough: each has a row, and at one distance those with the smallest ids count.
        met = checkpointed(found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n"))
        bound, radius = max(bound, len(segments) * (radius + 1)), radius + 1
        rows_below = met.where(F.col("distance") < bound).groupBy("q").agg(F.sum("many").alias("rows"))
        closed = rows_below.where(F.col("rows") >= most).select("q") if bound <= bits else open_
        closed = checkpointed(closed)
        part = met.join(closed, "q", "left_semi")
        done = part if done is None else done.unionByName(part)
        # That many nearest codes hold at least as many rows, so the farthest of them bounds the answers.
        far = met.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        far = far.select("q", F.when(F.col("n") >= most, F.col("far")).alias("reach"))
        open_ = checkpointed(open_.select("q").join(closed, "q", "left_anti").join(far, "q", "left"))
        if not open_.limit(1).count():
            break
    # Rows of the nearest classes for each query code, then without the rows of the query's own id.
    near = done.join(classes, "code").select("q", "distance", F.explode("ids").alias("id"))
    nearest = near.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))).where(F.col("n") <= most)
    asked = queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(checkpointed(nearest), "q").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return asked.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("neighbour_id"), "distance")


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for c in combinations(range(width), radius)]


def op5_hamming_search(spark, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _sql_code() -> str:
    return " + ".join(f"CASE WHEN embedding[{k + 1}] > 0 THEN {1 << k}::UBIGINT ELSE 0 END" for k in range(64))


OP5_SQL = f"""
WITH c AS (SELECT DISTINCT vec_id, CAST({_sql_code()} AS UBIGINT) AS code FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, CAST(bit_count(xor(q.code, c.code)::BIT) AS INTEGER) AS distance
  FROM c AS q JOIN c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank FROM d
)
SELECT query_id, rank, neighbour_id, distance FROM r WHERE rank <= 10
"""
