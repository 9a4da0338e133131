import zlib

from pyspark.sql import functions as F

from palaver.llm import sharding


def test_shards(odd_docs):
    df = odd_docs.withColumns({"k1": F.lit("x"), "__k1": F.lit("y")})
    got = sharding.shard_documents(df, shards=4, tolerance=0.01)
    assert set(got.columns) == {*df.columns, "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    rows = got.collect()
    assert len(rows) == df.count()
    for r in rows:
        data = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_bytes_are_near_equal_though_one_text_is_a_third(spark):
    rows = [(k, f"text {k} " + "y" * (k % 97)) for k in range(4000)] + [(10_000 + k, "same text " * 4) for k in range(2000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=16)
    size = [r["b"] for r in got.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(size) == 16 and max(size) - min(size) < 0.02 * sum(size) / 16
    # Only groups that a splitter falls into are divided.
    split = got.groupBy("text").agg(F.count_distinct("shard").alias("n")).where("n > 1")
    assert {r["text"] for r in split.collect()} <= {"same text " * 4}


def test_splitters_are_where_sorted_bytes_say(spark):
    data = sorted((k * 7919 % 1000, k % 13) for k in range(3000))
    df = spark.createDataFrame([(a, b, 1 + (a + b) % 50) for a, b in data], "a long, b long, size long")
    cuts = sharding.splitters(df, "size", ("a", "b"), 8, 0.0)
    total, below = sum(1 + (a + b) % 50 for a, b in data), 0
    for s, cut in enumerate(cuts, 1):
        below = sum(1 + (a + b) % 50 for a, b in data if (a, b) < cut)
        one = max(sum(1 + (x + y) % 50 for x, y in data if (x, y) == key) for key in set(data))
        assert abs(below - total * s / 8) <= one


def test_few_rows(spark, no_docs):
    assert sharding.shard_documents(no_docs).count() == 0
    same = spark.createDataFrame([(1, "a")] * 5 + [(None, None)] * 2, "doc_id long, text string")
    assert sharding.shard_documents(same).count() == 7
    assert sharding.shard_documents(same).select("shard", "slot").distinct().count() == 7


def test_finer_cells_number_alike(spark, monkeypatch):
    """The cells that many rows would have: the same shards, and slots without gaps."""
    rows = [(k, f"text {k % 700}") for k in range(1500)] + [(None, "same")] * 3 + [(2000 + k, "same") for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = sorted((str(r["doc_id"]), r["text"], r["shard"]) for r in sharding.shard_documents(df, shards=4).collect())
    monkeypatch.setattr(sharding, "CELL_BITS", (2, 1))
    monkeypatch.setattr(sharding, "CELL_ROWS", 1)
    got = sharding.shard_documents(df, shards=4).collect()
    assert sorted((str(r["doc_id"]), r["text"], r["shard"]) for r in got) == before
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
