"""The pipeline's near-duplicates against brute-force Jaccard over all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from palaver.llm import similar_texts
from palaver.llm.common import read

from .test_hashes import brute_components
from .test_queries import DATA


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def near(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


@pytest.fixture(scope="module")
def edited():
    """Groups of texts with more and more edited words, chains, a common passage, copies, odd ids."""
    rnd, texts = random.Random(11), []
    passage = [f"p{k}" for k in range(40)]
    for g in range(12):
        base = [f"g{g}w{rnd.randint(0, 500)}" for _ in range(rnd.choice([4, 30, 120, 300]))]
        base = base + passage if g % 2 else base
        for _ in range(rnd.choice([2, 12, 40])):
            new = list(base)
            for _ in range(rnd.randint(0, len(new) // 20)):
                new[rnd.randrange(len(new))] = f"e{rnd.randint(0, 10**9)}"
            texts.append(" ".join(new))
            base = new if g % 3 == 0 else base
    return [*texts, texts[0], texts[0].upper(), None, "", " \t", "one", "One", "one two"]


@pytest.mark.parametrize("common", [0, 8])
def test_stage_is_brute_force_jaccard(spark, monkeypatch, edited, common):
    monkeypatch.setattr(similar_texts, "COMMON", common)
    monkeypatch.setattr(similar_texts, "SAMPLE", 8 if common else 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000" if common else "7")
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(edited)]
    sets = [shingle_set(t) for t in edited]
    parts = brute_components(list(range(len(sets))), lambda a, b: near(sets[a], sets[b]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    kept = sorted(r["doc_id"] for r in got.collect())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.schema == docs.schema and kept == sorted(set(parts.values()))


def test_hot_shingles_and_small_tiles(spark, monkeypatch, edited):
    """Every shared shingle a hot one, leads compared in many tiles: the same components."""
    for name, value in {"SAMPLE": 1, "COMMON": 0, "HOT": 1, "TILE": 5, "STEP": 7}.items():
        monkeypatch.setattr(similar_texts, name, value)
    sets = [shingle_set(t) for t in edited]
    parts = brute_components(list(range(len(sets))), lambda a, b: near(sets[a], sets[b]))
    docs = spark.createDataFrame(list(enumerate(edited)), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in similar_texts.drop_similar(docs).collect()) == sorted(set(parts.values()))


def test_no_text(spark, no_docs):
    assert similar_texts.drop_similar(no_docs).count() == 0


def test_ids_that_repeat(spark):
    rnd = random.Random(12)
    texts = [" ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(60)) for _ in range(8)]
    rows = [(None, t) for t in texts[:4]] + [(7, t) for t in texts[4:]] + [(7, texts[0] + " x"), (7, texts[5]), (3, texts[6] + " y")]
    want = [(None, t) for t in texts[1:4]] + [(7, texts[0] + " x"), (7, texts[4]), (7, texts[5]), (7, texts[7]), (3, texts[6] + " y")]
    got = similar_texts.drop_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_stage_over_the_small_table(spark):
    docs = read(spark, DATA, "documents")
    ids = {r["doc_id"]: shingle_set(r["text"]) for r in docs.collect()}
    parts = brute_components(sorted(ids), lambda a, b: near(ids[a], ids[b]))
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, DATA).collect()} == set(parts.values())


def long_texts(n, words, seed):
    rnd = random.Random(seed)
    passage = " ".join(f"p{k}" for k in range(60))
    return [" ".join(f"w{rnd.randint(0, 10**7)}" for _ in range(words // 2)) + f" {passage} " + " ".join(f"w{rnd.randint(0, 10**7)}" for _ in range(words - words // 2)) for _ in range(n)]


@pytest.mark.parametrize(("n", "words", "most"), [(60, 8000, 60), (300, 3000, 300)])
def test_long_texts_with_one_passage_are_not_all_verified(spark, monkeypatch, n, words, most):
    """Unlike texts under one lead: only a few pairs go on to verification, and the alike ones are found all the same."""
    texts = long_texts(n, words, 1)
    texts += [texts[5] + " tail", texts[7].replace("w1", "x1", 40)]
    seen, verified = [], similar_texts._verified

    def counted(docs, text, pairs, *rest):
        seen.append(pairs.count())
        return verified(docs, text, pairs, *rest)

    monkeypatch.setattr(similar_texts, "_verified", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = [shingle_set(t) for t in texts]
    want = [k for k in range(len(texts)) if not any(near(sets[k], sets[j]) for j in (5, 7) if j < k)]
    assert sorted(r["doc_id"] for r in similar_texts.drop_similar(docs).collect()) == want
    assert sum(seen) <= most


def test_sketches_of_different_widths():
    """The bound holds between any two widths, and full parts stay full."""
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 2**63, n).astype(np.uint64)) for n in (5, 300, 2000, 2100, 2600, 4000, 4200, 9000)]
    sets += [np.unique(np.append(s[: int(len(s) * 0.9)], rnd.integers(0, 2**63, len(s) // 20).astype(np.uint64))) for s in sets]
    sets.append((np.arange(60_000, dtype=np.uint64) * np.uint64(1 << 20)))  # all in one part
    sketches = similar_texts.Sketches([similar_texts.sketch(s) for s in sets])
    assert len(set(sketches.width.tolist())) > 3
    x, y = (a.ravel() for a in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    ok, both = sketches.possible(x, y, 0.8)
    for a, b, may, common in zip(x.tolist(), y.tolist(), ok.tolist(), both.tolist(), strict=True):
        assert may or not similar_texts.alike(sets[a], sets[b], 0.8)
        assert len(sets) - 1 in (a, b) or common >= len(np.intersect1d(sets[a], sets[b]))
    assert (~ok).sum() > len(sets)
