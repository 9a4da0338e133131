"""Scalar functions on Unicode, empty and odd values."""

import re
import time

import pytest
from pyspark.sql import functions as F

from palaver.functions import text as T
from palaver.functions import times

TEXTS = ["The cat sat on the mat", "concatenate THE", "été et ÉTÉ ou détériorer", "", "a.b a+b", "x\ny the\tend", "naïve café, CAFÉ-bar", "the the the"]


def python_score(text, query):
    """Scoring written out from its rule."""
    text, query = text.lower(), query.lower().strip()
    score, found = 10.0 if query in text else 0.0, 0
    for w in query.split():
        if re.search(r"\b" + re.escape(w) + r"\b", text):
            score, found = score + 2, found + 1
        elif w in text:
            score, found = score + 1, found + 1
    return score + (5 if found == len(query.split()) > 1 else 0)


@pytest.mark.parametrize("query", ["the", "cat the", "été", "the the", "a.b", "CAFÉ", "on the mat", "\\E", "a+b a"])
def test_score_match(spark, query):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = [r["s"] for r in df.select(T.score_match(F.col("t"), query).alias("s")).collect()]
    assert got == [python_score(t, query) for t in TEXTS]


@pytest.mark.parametrize("literal", ["the", "é", ".", "cat"])
def test_snippets_match_positions(spark, literal):
    texts = [*TEXTS, "x" * 150 + literal + "y" * 30 + literal.upper() + "z" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [(r["s"], r["n"]) for r in df.select(T.snippets(F.col("t"), literal).alias("s"), T.occurrences(F.col("t"), literal).alias("n")).collect()]
    for text, (found, n) in zip(texts, got, strict=True):
        want = []
        for m in re.finditer(re.escape(literal), text, re.I):
            a, b = max(0, m.start() - 100), min(len(text), m.end() + 100)
            want.append(("..." if a else "") + text[a:b].replace("\n", " ").strip() + ("..." if b < len(text) else ""))
        assert found == want and n == len(want)


@pytest.mark.parametrize(
    ("model", "want"),
    [("claude-opus-4-8", "Opus 4.8"), ("claude-sonnet-4-5-20250929", "Sonnet 4.5"), ("claude-fable-5", "Fable 5"), ("gpt-4o", "GPT-4o"), ("other", "other"), ("", ""), (None, "")],
)
def test_prettify_model(one, model, want):
    assert one(T.prettify_model(F.col("m")), m=model) == want


@pytest.mark.parametrize(("name", "want"), [("My  chat: a/b!", "My-chat-ab"), ("--", "untitled"), ("", "untitled"), (None, "untitled"), ("é x", "x")])
def test_sanitize_name(one, name, want):
    assert one(T.sanitize_name(F.col("n")), n=name) == want


def test_names_and_paths(one):
    assert one(T.truncate_name(F.col("n"), 5), n="\u00a0 ab  cdefg\nmore") == "ab cd…"
    assert one(T.ws_trim(F.col("n")), n="\u2003 x \t") == "x"
    assert one(T.preview(F.col("a")), a=["", " hello\nworld "]) == "hello world"
    assert one(T.preview(F.col("a")), a=["y" * 300]) == "y" * 200 + "..."
    assert one(T.normalize_uuid(F.col("u")), u=" https://claude.ai/chat/AB-1 ") == "ab-1"
    assert one(T.normalize_hostname(F.col("h")), h=" Mac.LOCAL ") == "mac"
    assert [one(T.abbreviate_home(F.col("p"), "/home/me"), p=p) for p in ("/home/me", "/home/me/x", "/home/mex")] == ["~", "~/x", "/home/mex"]
    assert [one(T.archive_path(F.col("p"), "sessions"), p=p) for p in ("/a/sessions/b/c.jsonl", "/a/x", "/a/sessions/../b")] == ["b/c.jsonl", None, None]
    assert one(T.body_after_rule(F.col("d")), d="a\n---\nb\n---\nc") == "b\n---\nc"


def test_entropy_mask_substitute(one):
    assert one(T.entropy(F.col("t")), t="aabb") == pytest.approx(1.0)
    assert one(T.entropy(F.col("t")), t="") == 0.0
    a, b = (one(T.mask_id(F.col("t")), t="019e8f7d-51e3-7ba2") for _ in range(2))
    assert a == b != "019e8f7d-51e3-7ba2" and re.fullmatch("[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}", a)
    assert one(T.substitute(F.col("t"), {"bob": "x$1", "bobby": "y"}), t="BOBBY and Bob") == "y and x$1"
    assert one(T.highlight(F.col("t"), ["a", "ab"]), t="xABa") == "x<<AB>><<a>>"
    assert one(T.trigrams(F.col("t")), t="ABcab\nx") == ["abc", "bca", "cab", "ab\n", "b\nx"]
    assert one(T.json_strings(F.col("j")), j='{"k": "v \\"q\\"", "n": [1, "w"], "e": {"x": "\\u00e9"}}') == ['v "q"', "w", "é"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("2024-03-01T10:00:00Z", "2024-03-01 10:00:00"), ("2024-03-01T10:00:00+02:00", "2024-03-01 08:00:00"), ("2024-03-01", "2024-03-01 00:00:00"), ("2024-03-01 nonsense", "2024-03-01 00:00:00"), ("bad", None), (None, None)],
)
def test_parse_iso(one, text, want):
    got = one(times.parse_iso(F.col("t")).cast("string"), t=text)
    assert got == want


def test_times(one):
    assert one(times.to_utc_iso(F.col("s")), s=1700000000.0) == "2023-11-14T22:13:20Z"
    assert one(times.to_utc_iso(F.col("s")), s=1700000000.5) == "2023-11-14T22:13:20.500000Z"
    assert one(times.file_stem(F.col("t"), F.col("n")), t="2024-01-02T00:00:00Z", n="a b") == "2024-01-02_a-b"
    assert one(times.file_date(F.col("t")), t="?") == "unknown-date"
    boost = lambda t: one(times.recency_boost(times.parse_iso(F.col("t")), times.parse_iso(F.lit("2024-01-01T00:00:00Z"))), t=t)
    assert [boost("2024-01-01"), boost("2023-01-01"), boost("2020-01-01"), boost("x")] == [5.0, 0.0, 0.0, 0.0] and boost("2024-02-01") > 5
    assert one(times.display(F.col("t"), "Europe/Paris"), t="2024-01-01T00:00:00Z") == "2024-01-01 01:00:00"


def test_snippets_of_very_many_occurrences(spark):
    """40,000 occurrences in a text, side by side and apart: the work grows with their number, not with its square."""
    texts = ["ab" * 40_000, "".join(f"{k} AB\n" for k in range(40_000))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    start = time.monotonic()
    got = [r["s"] for r in df.select(T.snippets(F.col("t"), "ab").alias("s")).collect()]
    assert time.monotonic() - start < 60
    for text, found in zip(texts, got, strict=True):
        spans = [(max(0, m.start() - 100), min(len(text), m.end() + 100)) for m in re.finditer("ab", text, re.I)]
        assert found == [("..." if a else "") + text[a:b].replace("\n", " ").strip() + ("..." if b < len(text) else "") for a, b in spans]
