import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.llm import language_id, quality_classifier
from palaver.llm.common import held_out, sampled

from .conftest import word


def ppm_bits(counts, data):
    """Prediction by partial matching written out: ``counts`` maps contexts to follower counts."""
    total = 0.0
    for at in range(3, len(data)):
        s = data[at]
        for order in (3, 2, 1, 0):
            seen = counts.get(data[at - order : at])
            if seen is None:
                continue
            n, kinds = sum(seen.values()), len(seen)
            if s in seen:
                total -= math.log2(seen[s] / (n + kinds))
                break
            total -= math.log2(kinds / (n + kinds))
        else:
            total += 8
    return total


def test_code_lengths_are_those_of_the_trees():
    train, counts, arrays = {"x": ["abra cadabra", "bar"], "y": ["ééé zzz", "a"]}, {}, {}
    for name, texts in train.items():
        counts[name] = {}
        grams = []
        for t in texts:
            data = language_id.PAD + t.encode()
            grams.append(language_id.grams(np.frombuffer(data, np.uint8)))
            for at in range(3, len(data)):
                for order in range(4):
                    c = counts[name].setdefault(data[at - order : at], {})
                    c[data[at]] = c.get(data[at], 0) + 1
        arrays[name] = np.unique(np.concatenate(grams), return_counts=True)
    model = language_id.Model(arrays)
    texts = ["abra", "zéz", "q", "", "cadabra bar éa" * 5]
    got = model.lengths(texts)
    want = [[ppm_bits(counts[n], language_id.PAD + t.encode()) for n in ("x", "y")] for t in texts]
    assert np.allclose(got, want, rtol=1e-4)
    old, language_id.SLICE = language_id.SLICE, 7
    assert np.allclose(model.lengths(texts), got, rtol=1e-5)
    language_id.SLICE = old


def trees_of(texts):
    counts = {}
    for t in texts:
        data = language_id.PAD + t.encode()
        for at in range(3, len(data)):
            for order in range(4):
                c = counts.setdefault(data[at - order : at], {})
                c[data[at]] = c.get(data[at], 0) + 1
    return counts


def made_up(languages, texts, seed):
    """Texts of languages with syllables of their own and some in common."""
    rnd = random.Random(seed)
    out = {}
    for k in range(languages):
        own = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzéüßøłş") for _ in range(rnd.randint(1, 3))) for _ in range(60)]
        out[f"l{k:03d}"] = [" ".join("".join(rnd.choice(own) for _ in range(rnd.randint(1, 3))) for _ in range(30)) for _ in range(texts)]
    return out


def test_sparse_tables_are_the_dense_ones():
    texts = made_up(5, 8, 1)
    arrays = {name: language_id.count_grams(t) for name, t in texts.items()}
    sparse = language_id.SparseModel.of(arrays)
    asked = [*texts["l001"], "zzz", "", "\x00 qxj 日本", *texts["l004"]]
    got = sparse.lengths(asked)
    assert np.allclose(got, language_id.Model(arrays).lengths(asked), rtol=1e-5)
    trees = {name: trees_of(t) for name, t in texts.items()}
    assert np.allclose(got[:12], [[ppm_bits(trees[n], language_id.PAD + t.encode()) for n in sorted(texts)] for t in asked[:12]], rtol=1e-4)


def test_two_hundred_languages_stay_small():
    """The stated size: 0.5 MB a language and 40 bytes an entry of the three tables."""
    texts = made_up(200, 3, 2)
    arrays = {name: language_id.count_grams(t) for name, t in texts.items()}
    old, language_id.DENSE_BYTES = language_id.DENSE_BYTES, 1 << 20
    model = language_id.model_of(arrays)
    language_id.DENSE_BYTES = old
    assert isinstance(model, language_id.SparseModel)
    entries = sum(len(e.bits) for e in (model.four, model.three, model.escapes))
    assert model.nbytes() <= 200 * (1 << 19) + 40 * entries + (1 << 16)
    asked = [texts[n][0] for n in ("l000", "l077", "l199")]
    trees = {name: trees_of(t) for name, t in texts.items()}
    want = [[ppm_bits(trees[n], language_id.PAD + t.encode()) for n in sorted(texts)] for t in asked]
    assert np.allclose(model.lengths(asked), want, rtol=1e-4)


@pytest.mark.parametrize("most", [10**9, 1500, 300])
def test_a_cut_leaves_shorter_orders_alone(spark, monkeypatch, most):
    """With all entries the trees; with a cut, followers that were cut cost as unseen ones, by trees written out."""
    monkeypatch.setattr(language_id, "DENSE_BYTES", 0)
    texts = made_up(3, 12, 3)
    rows = [(5 * k + 1 + j, t, name) for j, (name, part) in enumerate(texts.items()) for k, t in enumerate(part)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, most_grams=most)
    learned = {name: [t for i, t, n in rows if n == name and zlib.crc32(str(i).encode()) % 5] for name in texts}
    trees = {name: trees_of(t) for name, t in learned.items()}
    sizes = {order: [sum(len(f) for c, f in trees[n].items() if len(c) == order) for n in texts] for order in (2, 3)}
    contexts = [sum(len(c) == 3 for c in trees[n]) for n in texts]

    def bits(name, data):
        """As ppm_bits, but for what was cut."""
        tree, total = trees[name], 0.0
        top = lambda rows, sizes: {k for k, _ in sorted(rows.items(), key=lambda x: (-x[1], x[0]))[: language_id.quota(sizes, most) if sum(sizes) > most else None]}
        kept = {o: top({c + bytes([f]): n for c, fs in tree.items() if len(c) == o for f, n in fs.items()}, sizes[o]) for o in (2, 3)}
        escapes = top({c: sum(f.values()) for c, f in tree.items() if len(c) == 3}, contexts)
        for at in range(3, len(data)):
            s = data[at]
            for order in (3, 2, 1, 0):
                c = data[at - order : at]
                seen = tree.get(c)
                if seen is None:
                    continue
                n, kinds = sum(seen.values()), len(seen)
                if s in seen and (order < 2 or c + bytes([s]) in kept[order]):
                    total -= math.log2(seen[s] / (n + kinds))
                    break
                if order < 3 or c in escapes:
                    total -= math.log2(kinds / (n + kinds))
            else:
                total += 8
        return total

    asked = [texts["l000"][0], texts["l002"][5], "zzz é"]
    want = [[bits(n, language_id.PAD + t.encode()) for n in sorted(texts)] for t in asked]
    assert np.allclose(model.lengths(asked), want, rtol=1e-4)


def test_quota():
    assert language_id.quota([5, 5, 5], 100) == 5 and language_id.quota([1, 10, 100], 31) == 20 and language_id.quota([10, 10], 7) == 3 and language_id.quota([], 5) == 0


def test_language(spark, odd_docs, no_docs):
    rnd = random.Random(1)
    train = [(k, " ".join(word(rnd, lang) for _ in range(40)), lang) for k, lang in enumerate(["en", "fr", "de"] * 60)]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert model.languages == ["de", "en", "fr"]
    rows = language_id.identify(df, model).withColumn("h", held_out(F.col("doc_id"))).collect()
    assert all(r["lang_pred"] == r["lang"] for r in rows if r["h"]) and any(r["h"] for r in rows)
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    odd = language_id.identify(odd_docs.withColumn("__said", F.lit(1)), model).collect()
    for r in odd:
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not lettered) and 0 <= r["score"] <= 1 and (r["score"] == 0) == (not lettered)
    none = language_id.fit(no_docs)
    assert {r["lang_pred"] for r in language_id.identify(odd_docs, none).collect()} == {"und"}
    assert language_id.identify(no_docs, model).count() == 0


def walked(trees, x):
    """Trees walked row by row."""
    out = []
    for row in x:
        total = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            for _ in range(quality_classifier.DEPTH):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += leaf[node - (1 << quality_classifier.DEPTH) + 1]
        out.append(1 / (1 + math.exp(-total)))
    return out


def test_trees():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(800, len(quality_classifier.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = quality_classifier.grow(x[:600], y[:600])
    got = trees.score(x)
    assert np.allclose(got, walked(trees, x)) and ((got[600:] > 0.5) == y[600:]).mean() > 0.95
    assert np.allclose(quality_classifier.grow(x, np.ones(800)).score(x[:3]), 1, atol=1e-5)
    assert quality_classifier.grow(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_quality(spark, odd_docs, no_docs):
    rnd = random.Random(2)
    rows = [(k, " ".join(word(rnd, "en").upper() + "!!" if k % 3 == 0 else word(rnd, "en") for _ in range(30))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(300)] + [(5, None, 0), (None, 1, 0), (7, 9, 0)], "doc_id long, quality int, toxic int")
    trees = quality_classifier.fit(docs, labels)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("h"), quality_classifier.quality(F.col("text"), trees, spark).alias("s")).collect()
    assert all((r["s"] >= 0.5) == (r["doc_id"] % 3 != 0) for r in scored if r["h"])
    odd = odd_docs.select(quality_classifier.quality(F.col("text"), trees, spark).alias("s")).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["s"] <= 1 for r in odd)
    empty = quality_classifier.fit(no_docs, labels.limit(0))
    assert {r["s"] for r in odd_docs.select(quality_classifier.quality(F.col("text"), empty, spark).alias("s")).collect()} == {0.5}


def test_no_language_is_lost():
    """Shares of a sample stay above 0 however many rows there are, and shrink with the languages."""
    huge = language_id.shares({"en": 10**10, "fr": 3, "de": 2 * 10**12})
    assert huge == {"en": 1500 / 10**10, "fr": 1.0, "de": 1500 / (2 * 10**12)}
    many = language_id.shares({str(k): 10**9 for k in range(200)})
    assert all(0 < s * 10**9 <= 500 for s in many.values())
    with pytest.raises(ValueError):
        language_id.shares({str(k): 1 for k in range(300)})


def test_sample_of_a_tiny_share(spark):
    """A share of 1 in 10**10 still has a threshold above 0, and a share of 1 takes all rows."""
    df = spark.range(2000)
    assert df.where(sampled([F.col("id")], 1.0)).count() == 2000
    assert 300 < df.where(sampled([F.col("id")], F.lit(0.25))).count() < 700
    threshold = spark.range(1).select((F.lit(1e-10) * float(1 << 62)).cast("long").alias("x")).first()["x"]
    assert threshold > 10**8


def test_long_texts_and_few_contexts_are_learned(spark):
    """A language that has only long texts is learned; a small bound on contexts leaves the frequent ones."""
    rows = [(k, ("sch ein keit ver " if k % 2 else "eau tre ou ") * 30_000, "de" if k % 2 else "fr") for k in range(12)]
    docs = spark.createDataFrame([*rows, rows[0], (None, "x y z", "xx"), (50, None, "de"), (51, "", "fr")], "doc_id long, text string, lang string")
    for most in (language_id.MOST_GRAMS, 40):
        model = language_id.fit(docs, most_grams=most)
        assert model.languages == ["de", "fr"] and len(model.cost4) <= most
        got = language_id.identify(spark.createDataFrame([("ein schein",), ("ou treeau",)], "text string"), model).collect()
        assert [r["lang_pred"] for r in got] == ["de", "fr"]


def test_labels_of_repeated_ids(spark):
    """Many texts under one id count as one; scores don't depend on how rows are dealt out."""
    rnd = random.Random(3)
    docs = [(k, " ".join(rnd.choice(["word", "other", "thing"]) for _ in range(30)) if k % 2 else "buy!!! | " * 20) for k in range(200)] + [(1, f"text {k}") for k in range(400)]
    labels = [(k, k % 2) for k in range(200)]
    fitted = [quality_classifier.fit(spark.createDataFrame(docs, "doc_id long, text string").repartition(n), spark.createDataFrame(labels, "doc_id long, quality int"), rows=rows) for n, rows in ((1, 20_000), (5, 20_000))]
    x = np.array([quality_classifier.statistics(t) for _, t in docs[:50]])
    assert (fitted[0].score(x) == fitted[1].score(x)).all() and ((fitted[0].score(x) > 0.5) == [k % 2 == 1 for k in range(50)]).all()
