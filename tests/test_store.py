"""Derived tables on disk: every refresh equals a rebuild."""

import numpy as np
from pyspark.sql import functions as F

from palaver.operators import grams, normalize, store


def extract(files):
    at, c = F.lit("2024-01-01T00:00:00Z"), F.col
    return files.select(*normalize.item_row(c("path"), F.lit("llm"), c("path"), F.lit("conversation"), F.lit("claude"), c("path"), at, at, F.lit(""), F.array("text"), host=F.lit("h")))


def files(spark, rows):
    return spark.createDataFrame(list(rows.items()), "path string, text string").withColumns({"size": F.octet_length("text").cast("long"), "content_hash": F.xxhash64("text")})


def found(spark, root, query, **options):
    return {r["path"]: r["n_matches"] for r in store.search_index(spark, root, query, **options).collect()}


def test_refreshes(spark, tmp_path):
    root = str(tmp_path)
    first = {"a": "one two three", "b": "two two", "c": "four", "d": ""}
    store.refresh(spark, root, files(spark, first), extract)
    assert found(spark, root, "two") == {"a": 1, "b": 2} and found(spark, root, "") == {"a": 0, "b": 0, "c": 0}
    second = {"a": "one three", "b": "two two", "e": "two"}
    changes = {r["path"]: r["change"] for r in store.refresh(spark, root, files(spark, second), extract).collect()}
    assert changes == {"a": "rewritten", "b": "same", "c": "removed", "d": "removed", "e": "new"}
    assert found(spark, root, "two") == {"b": 2, "e": 1} and found(spark, root, "four") == {} and found(spark, root, "on") == {"a": 1}
    assert [r["path"] for r in store.search_index(spark, root, "two", n=1).collect()] == ["b"]
    back = {r["path"]: r["change"] for r in store.refresh(spark, root, files(spark, first), extract).collect()}
    assert back == {"a": "rewritten", "b": "same", "c": "new", "d": "new", "e": "removed"}
    assert found(spark, root, "two") == {"a": 1, "b": 2}


def test_another_version_reads_all_again(spark, tmp_path):
    root, rows = str(tmp_path), {"a": "one", "b": "two"}
    store.refresh(spark, root, files(spark, rows), extract)
    shout = lambda df: extract(df.withColumn("text", F.concat("text", F.lit(" more"))))
    assert {r["change"] for r in store.refresh(spark, root, files(spark, rows), shout).collect()} == {"same"}
    assert found(spark, root, "more") == {}
    assert {r["change"] for r in store.refresh(spark, root, files(spark, rows), shout, version=2).collect()} == {"rewritten"}
    assert found(spark, root, "more") == {"a": 1, "b": 1}


def test_broken_refresh_is_never_read(spark, tmp_path):
    root = str(tmp_path)
    store.refresh(spark, root, files(spark, {"a": "one"}), extract)

    def breaks(df):
        raise RuntimeError

    try:
        store.refresh(spark, root, files(spark, {"a": "one", "b": "one"}), breaks)
    except RuntimeError:
        pass
    assert found(spark, root, "one") == {"a": 1}
    store.refresh(spark, root, files(spark, {"a": "one", "b": "one"}), extract)
    assert found(spark, root, "one") == {"a": 1, "b": 1}


def data_files(root):
    return {t: len(list((root / t).rglob("part-*.parquet"))) for t in ("items", "texts", "postings", "aside", "catalog")}


def test_files_don_t_grow_with_refreshes(spark, tmp_path):
    """Ten refreshes leave as many files as one build of the same rows; a change of one file writes one bucket."""
    rows = {f"p{k}": f"text {k} of some words" for k in range(40)}
    for k in range(10):
        rows[f"p{k}"] += " changed"
        rows[f"new{k}"] = f"another {k}"
        if k:
            del rows[f"p{k + 10}"]
        store.refresh(spark, str(tmp_path / "a"), files(spark, rows), extract, buckets=8)
    store.refresh(spark, str(tmp_path / "b"), files(spark, rows), extract, buckets=8)
    assert data_files(tmp_path / "a") == data_files(tmp_path / "b") == {t: 8 for t in ("items", "texts", "postings", "aside", "catalog")}
    assert found(spark, str(tmp_path / "a"), "changed") == found(spark, str(tmp_path / "b"), "changed") != {}
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "a/items").rglob("part-*.parquet")}
    rows["p0"] += " again"
    store.refresh(spark, str(tmp_path / "a"), files(spark, rows), extract)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "a/items").rglob("part-*.parquet")}
    assert len(set(before.items()) - set(after.items())) == 1 == len(set(after.items()) - set(before.items()))
    assert {r["change"] for r in store.refresh(spark, str(tmp_path / "a"), files(spark, rows), extract).collect()} == {"same"}
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "a/items").rglob("part-*.parquet")} == after
    store.refresh(spark, str(tmp_path / "a"), files(spark, rows).limit(0), extract)  # all files go
    assert found(spark, str(tmp_path / "a"), "") == {} == found(spark, str(tmp_path / "a"), "changed")


def test_index_is_the_full_search(spark, tmp_path):
    rows = {f"p{k}": " ".join(w for j, w in enumerate(["alpha", "alphabet", "beta", "the gamma ray", "İstanbul", "été"]) if (k >> j) & 1) for k in range(64)}
    store.refresh(spark, str(tmp_path), files(spark, rows), extract, buckets=4)
    for query, exact in (("alpha", False), ("beta alphabet", False), ("gamma ray", True), ("été", False), ("al", False), ("nothing here", False), ("the gamma ray alphabet beta", False)):
        want = {p for p, t in rows.items() if all(w in t.lower() for w in ([query] if exact else query.split()))}
        assert set(found(spark, str(tmp_path), query, exact=exact)) == want


def test_what_fails_is_tried_again(spark, tmp_path):
    """A broken extractor sets files aside with a reason; mended, it gives their rows without a change of the files."""
    root, rows = str(tmp_path), {"a": "one", "b": "two", "c": "three"}
    problem = lambda df, p: extract(df).withColumn("problem", F.when(F.col("path") == p, "too odd"))
    aside = lambda: {(r["path"], r["reason"], r["tries"]) for r in store.live(spark, root, "aside").collect()}
    store.refresh(spark, root, files(spark, rows), lambda df: problem(df.where("path <> 'b'"), "c"))
    assert aside() == {("b", store.NOTHING, 1), ("c", "too odd", 1)} and found(spark, root, "") == {"a": 0}
    changes = store.refresh(spark, root, files(spark, rows), lambda df: problem(df, "c"))
    assert {r["change"] for r in changes.collect()} == {"same"}
    assert aside() == {("c", "too odd", 2)} and found(spark, root, "") == {"a": 0, "b": 0}
    rows["c"] = "three and more"
    store.refresh(spark, root, files(spark, rows), lambda df: problem(df, "c"))
    assert aside() == {("c", "too odd", 3)}
    store.refresh(spark, root, files(spark, rows), extract)
    assert aside() == set() and found(spark, root, "more") == {"c": 1}
    store.refresh(spark, root, files(spark, {"a": "one", "x": "y"}), lambda df: extract(df.limit(0)))
    assert aside() == {("x", store.NOTHING, 1)}
    store.refresh(spark, root, files(spark, {"a": "one"}), extract)
    assert aside() == set()


def test_large_buckets_are_dealt_to_several_tasks(spark, tmp_path, monkeypatch):
    """One bucket in parts and chunks: several files, and the same search, also after removals and rewrites."""
    monkeypatch.setattr(store, "PART_BYTES", 1000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts stay apart
    root, rows = str(tmp_path), {f"p{k}": f"some words of {k} " * 10 + ("zebra" if k % 3 == 0 else "") for k in range(60)}
    store.refresh(spark, root, files(spark, rows), extract, buckets=1)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert data_files(tmp_path)["items"] > 1 and data_files(tmp_path)["catalog"] > 1
    assert set(found(spark, root, "zebra")) == {p for p, t in rows.items() if "zebra" in t}
    del rows["p0"]
    rows |= {"p3": "another", "p4": "zebra words", "new": "ZEBRA"}
    store.refresh(spark, root, files(spark, rows), extract)
    assert set(found(spark, root, "zebra")) == {p for p, t in rows.items() if "zebra" in t.lower()}
    numbers = [r["number"] for r in store.live(spark, root, "items").collect()]
    assert len(numbers) == len(set(numbers)) == len(rows)


def test_index_holds_the_trigrams_of_each_text(spark):
    """Chunks of any size hold each item's trigrams once; texts of all kinds, several of one item, null and empty ones."""
    texts = ["abcabc", "İé𝒳y", "a\0b\0", "", "ab", None, "x\ny", "éou 𝒳𝒳𝒳𝒳 end", "abcabc tail"]
    rows = [(k % 2, k // 2, "p", t) for k, t in enumerate(texts + texts)] + [(0, None, None, None)]
    df = spark.createDataFrame(sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1])), "bucket int, number long, path string, text string").coalesce(1)
    low = df.select("bucket", "number", F.lower("text").alias("text")).where("text IS NOT NULL").collect()
    want = {(r["bucket"], r["text"][k : k + 3], r["number"]) for r in low for k in range(len(r["text"]) - 2)}
    got = grams.posted(df, "path")
    lists = got.where("gram IS NOT NULL").collect()
    assert all(r["n"] == len(r["numbers"]) and r["numbers"] == sorted(set(r["numbers"])) for r in lists)
    assert sorted((r["bucket"], r["gram"], n) for r in lists for n in r["numbers"]) == sorted(want)
    assert [tuple(r) for r in got.where("gram IS NULL").collect()] == [(0, None, None, None, None)]


def test_pairs_of_long_texts_and_many_characters(monkeypatch):
    """Cut windows and halves give the pairs of plain Python."""
    def plain(texts):
        return sorted({(t[k : k + 3], n) for n, t in enumerate(texts) for k in range(len(t) - 2)})

    def names(gram):
        return ["".join(chr(int(g) >> s & 0x1FFFFF) for s in (42, 21, 0)) for g in gram]

    many = ["".join(map(chr, range(k * 3000 + 60_000, k * 3000 + 63_000))) for k in range(300)]
    texts = [t.replace("\ud800", "") for t in many if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    gram, number = grams._pairs(texts, np.arange(len(texts)))
    assert sorted(zip(names(gram), number.tolist(), strict=True)) == plain(texts)
    monkeypatch.setattr(grams, "CHARS", 7)
    text = "the quick brown fox jumps over the lazy dog"
    gram, number = grams._pairs([text], np.array([0]))
    assert sorted(zip(names(gram), number.tolist(), strict=True)) == plain([text])


def test_tables_of_another_layout_are_built_anew(spark, tmp_path):
    root = str(tmp_path)
    store.refresh(spark, root, files(spark, {"a": "one", "b": "two"}), extract)
    spark.createDataFrame([(64, 1)], "buckets int, version int").coalesce(1).write.mode("overwrite").json(f"{root}/settings")
    assert store.settings(spark, root) is None
    store.refresh(spark, root, files(spark, {"a": "one more"}), extract)
    assert found(spark, root, "one") == {"a": 1} and found(spark, root, "two") == {}
