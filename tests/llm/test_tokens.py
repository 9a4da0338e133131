"""Operators 1 and 6 against the tokenizer library."""

import base64
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from palaver.llm import sentencepiece_codec, token_counts
from palaver.llm.pieces import Pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = [*"abcdefghijklmnopqrstuvwxyz  \n\t▁éßñ0123456789.,;:(){}<>/\\'\"-_=+*&^%$#@!", *"日本語中文漢字한국어абвгдאבג😀🎉ａ\x00\r", " the", " of", "tion", "▁▁", "<s>", "<0x0A>", "<unk>"]


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def random_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_counts_and_ids_are_the_librarys(model, library):
    texts = random_texts(1500, 1)
    want = library.encode(texts)
    machine, codec = token_counts.Transducer(Pieces(model)), sentencepiece_codec.Codec(Pieces(model))
    assert [machine.text(t) for t in texts] == [len(x) for x in want]
    got = codec.encode(texts)
    assert [x.tolist() for x in got] == want
    assert [codec.decode(x) for x in want] == [library.decode(x) for x in want]


def test_block_maps_compose_associatively(model, library):
    machine, rnd = token_counts.Transducer(Pieces(model)), random.Random(2)
    for t in random_texts(300, 3):
        if t:
            escaped = "▁" + t.replace(" ", "▁")
            assert token_counts.long_text(machine, escaped, rnd.randint(1, 9)) == len(library.encode(t))
            a, b, c = (token_counts.block_map(machine, escaped[k::1][: max(1, len(escaped) // 3)]) for k in (0, len(escaped) // 3, 2 * len(escaped) // 3))
            total = lambda m: machine.word(m.head) + (0 if m.tokens is None else m.tokens + machine.word(m.tail))
            assert total(token_counts.compose(machine, token_counts.compose(machine, a, b), c)) == total(token_counts.compose(machine, a, token_counts.compose(machine, b, c)))


def test_full_memos_change_nothing(model, library, monkeypatch):
    texts = random_texts(200, 5)
    monkeypatch.setattr(token_counts, "STATES", 20)
    monkeypatch.setattr(token_counts, "MEMO_ENTRIES", 10)
    monkeypatch.setattr(sentencepiece_codec, "MEMO_ENTRIES", 10)
    monkeypatch.setattr(sentencepiece_codec, "INDEX_CHARS", 50)
    machine, codec = token_counts.Transducer(Pieces(model)), sentencepiece_codec.Codec(Pieces(model))
    assert [machine.text(t) for t in texts] == [len(x) for x in library.encode(texts)]
    assert [x.tolist() for t in texts for x in codec.encode([t])] == library.encode(texts)


def test_columns(spark, odd_docs, no_docs, library):
    df = odd_docs.withColumn("__coded", F.lit(1))
    for r in token_counts.count_tokens(df, PATH).collect():
        text = r["text"] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(library.encode(text)))
        assert r["over_limit"] == (r["n_tokens"] > 4096) and r["__coded"] == 1
    coded = sentencepiece_codec.encode_documents(df, PATH).collect()
    assert len(coded) == df.count()
    for r in coded:
        if r["text"] is None:
            assert (r["token_ids"], r["n_tokens"], r["round_trip"]) == (None, 0, None)
        else:
            assert r["token_ids"] == library.encode(r["text"]) and r["round_trip"]
    ids = sentencepiece_codec.encoded(F.col("text"), sentencepiece_codec.model_bytes(PATH))
    back = odd_docs.select("text", sentencepiece_codec.decoded(ids, sentencepiece_codec.model_bytes(PATH)).alias("back")).collect()
    assert all(r["back"] == (r["text"] if r["text"] is None else r["text"].replace("▁", " ")) for r in back)
    assert token_counts.count_tokens(no_docs, PATH).count() == sentencepiece_codec.encode_documents(no_docs, PATH).count() == 0


def long_parts():
    """Texts without a place that no piece can lie across: letters, digits and symbols, Chinese, one sign."""
    rnd = random.Random(8)
    return {
        "letters": "".join(rnd.choice("abcdefghijklmnop") for _ in range(150_000)),
        "base64": base64.b64encode(rnd.randbytes(300_000)).decode(),
        "chinese": "".join(rnd.choice("的一是不了在人有我他这中大来上国个到说们为子和你地出道也时年") for _ in range(120_000)),
        "sign": "=" * 100_001,
        "lone": "\u4e9c\U0001f600a" * 20_000,
        "five megabytes": "".join(rnd.choice("etaoinshrdlu") for _ in range(5 << 20)),
    }


@pytest.mark.parametrize("kind", list(long_parts()))
def test_long_parts_are_the_librarys(kind, model, library, monkeypatch):
    text = long_parts()[kind]
    want = library.encode(text)
    if len(text) < 1 << 20:
        monkeypatch.setattr(token_counts, "STATES", 2000)
    machine = token_counts.Transducer(Pieces(model))
    assert machine.text(text) == len(want) and len(machine.states) < token_counts.STATES + 100
    if len(text) < 1 << 20:
        monkeypatch.setattr(sentencepiece_codec, "INDEX_CHARS", 50_000)
        codec = sentencepiece_codec.Codec(Pieces(model))
        got, short, _ = codec.encode([text, "some words", text])
        assert got.tolist() == want and short.tolist() == library.encode("some words")
        assert codec.decode(got.tolist()) == text and all(len(w) <= sentencepiece_codec.LONG for w in codec.memo)
