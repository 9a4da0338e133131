"""The registered queries over the small tables: against SQL, brute force or the library."""

import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from palaver.llm import language_id, quality_classifier
from palaver.llm.common import read
from palaver.llm.queries import ORACLE_SQL, QUERIES

from .test_archive_urls_leaks import brute_leak, brute_words
from .test_classifiers import walked
from .test_hashes import brute_components, brute_fingerprint

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in read(spark, DATA, "documents").collect()}


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    result = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    df = QUERIES[name](spark, DATA)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, result.fetchall()))


def test_tokens(spark, docs, library):
    for r in QUERIES["op1_token_counts"](spark, DATA).collect():
        text = docs[r["doc_id"]]["text"]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), len(library.encode(text)), len(library.encode(text)) > 4096)
    for r in QUERIES["op6_sentencepiece_codec"](spark, DATA).collect():
        assert r["token_ids"] == library.encode(docs[r["doc_id"]]["text"]) and r["n_tokens"] == len(r["token_ids"]) and r["round_trip"]


def test_shards(spark, docs):
    rows = QUERIES["op2_sharding"](spark, DATA).collect()
    assert len(rows) == len(docs) and all(0 <= r["shard"] < 16 and r["size"] == len(docs[r["doc_id"]]["text"].encode()) + 1 for r in rows)
    for s in range(16):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    size = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(16)]
    assert max(abs(x - sum(size) / 16) for x in size) <= max(r["size"] for r in rows)


def test_held_out_accuracy(spark, docs):
    lang = [r for r in QUERIES["op3_language_id"](spark, DATA).collect() if r["held_out"]]
    assert np.mean([docs[r["doc_id"]]["lang"] == r["lang_pred"] for r in lang]) > 0.97
    labels = {r["doc_id"]: r["quality"] for r in read(spark, DATA, "labels").collect()}
    scored = [r for r in QUERIES["op4_quality_classifier"](spark, DATA).collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in scored]) > 0.9 and all(r["predicted"] == (r["score"] >= 0.3) for r in scored)


def test_near_duplicates(spark, docs):
    prints = {i: brute_fingerprint(d["text"]) for i, d in docs.items()}
    parts = brute_components(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, f in prints.items():
        least[parts[f]] = min(i, least.get(parts[f], i))
    rows = QUERIES["op7_simhash_dedup"](spark, DATA).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{f:016x}", least[parts[f]]) for i, f in prints.items()}


def test_stages_keep_the_columns(spark):
    before = read(spark, DATA, "documents").selectExpr("*", "1 AS __score", "2 AS score", "3 AS __said", "4 AS fp")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, before, DATA).schema == before.schema


def test_folds(spark):
    rows = QUERIES["op4_quality_classifier"](spark, DATA).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[f.__name__ for _, f in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, odd_docs, no_docs, library, stage):
    """Nulls in any column, empty and very long texts, copies, repeated rows and no rows at all."""
    assert stage(spark, no_docs, DATA).count() == 0
    got, rows = stage(spark, odd_docs, DATA).collect(), odd_docs.collect()
    if stage is corpus_pipeline.encoding_stage:
        want = [(r["doc_id"], None if r["text"] is None else library.encode(r["text"])) for r in rows]
        assert sorted(map(str, ((r["doc_id"], r["token_ids"]) for r in got))) == sorted(map(str, want))
        return
    if stage is corpus_pipeline.quality_stage:
        trees = quality_classifier.fit(read(spark, DATA, "documents"), read(spark, DATA, "labels"))
        stays = [walked(trees, [quality_classifier.statistics(r["text"])])[0] >= corpus_pipeline.QUALITY for r in rows]
    elif stage is corpus_pipeline.language_stage:
        model = language_id.fit(read(spark, DATA, "documents"))
        bits = model.lengths([r["text"] or "" for r in rows])
        share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
        stays = [p >= corpus_pipeline.CONFIDENCE and any(c.isalpha() for c in r["text"] or "") for r, p in zip(rows, share, strict=True)]
    elif stage is corpus_pipeline.decontamination_stage:
        items = [(r["item_id"], r["text"]) for r in read(spark, DATA, "benchmark").collect()]
        stays = [not leaked(r["text"], items) for r in rows]
    else:
        sets = [shingle_set(r["text"]) for r in rows]
        parts = brute_components(list(range(len(rows))), lambda a, b: jaccard(sets[a], sets[b]))
        groups = {}
        for k, r in enumerate(rows):
            groups.setdefault(parts[k], []).append((r["doc_id"] is None, r["doc_id"]))
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((a, b or 0) for a, b in map(min, groups.values()))
        return
    assert sorted(map(str, got)) == sorted(str(r) for r, keep in zip(rows, stays, strict=True) if keep)


def leaked(text, items):
    words = " " + " ".join(brute_words(text)) + " "
    for item, t in items:
        ws = brute_words(t)
        if item is not None and any(f" {' '.join(ws[k : k + 10])} " in words for k in range(max(1, len(ws) - 9)) if ws):
            return True
    return False


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def jaccard(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_pipeline_by_hand_at_five_words(spark, docs, library):
    """The stages by brute force, near-duplicates as stated: five words, a Jaccard similarity of 0.8."""
    trees = quality_classifier.fit(read(spark, DATA, "documents"), read(spark, DATA, "labels"))
    left = [i for i in sorted(docs) if walked(trees, [quality_classifier.statistics(docs[i]["text"])])[0] >= corpus_pipeline.QUALITY]
    model = language_id.fit(read(spark, DATA, "documents"))
    bits = model.lengths([docs[i]["text"] for i in left])
    best = 1 / np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1)
    left = [i for i, p in zip(left, best, strict=True) if p >= corpus_pipeline.CONFIDENCE and any(c.isalpha() for c in docs[i]["text"])]
    sets = {i: shingle_set(docs[i]["text"]) for i in left}
    parts = brute_components(left, lambda a, b: jaccard(sets[a], sets[b]))
    items = [(r["item_id"], r["text"]) for r in read(spark, DATA, "benchmark").collect()]
    left = [i for i in sorted(set(parts.values())) if not leaked(docs[i]["text"], items)]
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"]: r["token_ids"] for r in got} == {i: library.encode(docs[i]["text"]) for i in left}
