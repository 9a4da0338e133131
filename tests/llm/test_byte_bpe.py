"""Operator 11 against the tokenizer library."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from palaver.llm import byte_bpe_codec as B
from palaver.llm.common import read

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SIGNS = [*"abcdestmlrv''''  \n\t\r0123!.,-", " '", " 's", "'ll", "'re", "'ve", "   ", "é", "日本", "😀", " ", "　", "ſ", "²", "٣", " ", "\x1c", "\x85", "\x00", "Ɤ", "Ᲊ"]


@pytest.fixture(scope="module")
def table():
    with open(PATH, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def codec(table):
    return B.Codec(B.ranks_of(table))


@pytest.fixture(scope="module")
def library(table):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.ranks_of(table), special_tokens={})


def random_texts(n, most):
    rnd = random.Random(n)
    return ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, most))) for _ in range(n)]


def test_pattern_is_that_of_the_tokenizers():
    assert B.PATTERN == public_tokenizers.PATTERN


@pytest.mark.parametrize(("window", "block"), [(B.WINDOW, B.BLOCK), (7, 4), (64, 8), (1, 1)])
def test_ids_are_the_librarys_whatever_the_windows(window, block, codec, library, monkeypatch):
    monkeypatch.setattr(B, "WINDOW", window)
    monkeypatch.setattr(B, "BLOCK", block)
    texts = [*random_texts(1500 if window > 1 else 200, 40), None, "", "x" * 3000, "ab" * 300 + "c", "<|endoftext|>", "'s's'sa ''s 's  's\n's"]
    ids, ends = codec.encode(pa.array(texts))
    assert ids.to_pylist() == [None if t is None else library.encode_ordinary(t) for t in texts]
    raw = [None if t is None else t.encode() for t in texts]
    assert codec.decode(ids, ends).to_pylist() == codec.decode(ids).to_pylist() == raw
    for t, x, e in zip(raw, ids.to_pylist(), ends.to_pylist(), strict=True):
        if t is not None:
            assert [t[a:b] for a, b in zip([0, *e], e, strict=False)] == [library.decode_single_token_bytes(i) for i in x]


def test_slices_of_arrays(codec, library):
    texts = pa.array(["skipped", *random_texts(50, 30), "skipped"]).slice(1, 50)
    ids, ends = codec.encode(texts)
    assert ids.to_pylist() == [library.encode_ordinary(t) for t in texts.to_pylist()]
    assert codec.decode(ids.slice(3, 9), ends.slice(3, 9)).to_pylist() == [t.encode() for t in texts.to_pylist()[3:12]]
    assert len(codec.encode(pa.array([], pa.string()))[0]) == 0


def test_scan_is_the_automaton_step_by_step():
    rnd = random.Random(4)
    symbols = B.np.array([rnd.randrange(9) for _ in range(2000)], B.np.uint8)
    for first in range(B.STATES):
        state, want = first, []
        for s in symbols.tolist():
            want.append(state := int(B.FOLLOWS[state, s]))
        assert B.states(symbols, first).tolist() == want


def test_long_slices(codec, library):
    rnd = random.Random(5)
    for text in ("".join(rnd.choice("etaoinshrdlu") for _ in range(200_000)), "=" * 100_001, "的一是不了在人有" * 8000, "0123456789" * 3000, "\n" * 50_000 + "a"):
        assert codec.encode(pa.array([text]))[0].to_pylist() == [library.encode_ordinary(text)]
        assert all(len(w) <= B.KEPT for w in codec.memo)


def test_full_memo_changes_nothing(codec, library, monkeypatch):
    monkeypatch.setattr(B, "MEMO_ENTRIES", 5)
    texts = random_texts(100, 30)
    assert codec.encode(pa.array(texts))[0].to_pylist() == [library.encode_ordinary(t) for t in texts]


def test_columns(spark, odd_docs, no_docs, library, table):
    df = odd_docs.withColumns({"__coded": F.lit(1), "n_tokens": F.lit("replaced")})
    rows = B.decode_documents(B.encode_documents(df, PATH), PATH).collect()
    assert len(rows) == df.count()
    for r in rows:
        if r["text"] is None:
            assert (r["n_tokens"], r["token_ids"], r["token_ends"], r["decoded"]) == (0, None, None, None)
        else:
            ids = library.encode_ordinary(r["text"])
            assert (r["n_tokens"], r["token_ids"], bytes(r["decoded"])) == (len(ids), ids, r["text"].encode())
        assert r["__coded"] == 1
    assert B.encode_documents(no_docs, PATH).count() == 0
    ids = B.encoded(F.col("text"), table)["ids"]
    assert all(r["back"] == (r["text"] and r["text"].encode()) for r in odd_docs.where("text <> ''").select("text", B.decoded(ids, table).alias("back")).collect())


def test_query(spark, library):
    docs = read(spark, "/root/testdata/sf0.001", "documents").collect()
    got = {r["doc_id"]: r for r in B.op11_byte_bpe_codec(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for d in docs:
        text = d["text"] or ""
        ids, r = library.encode_ordinary(text), got[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
