"""Operator 12 against a trie of Python dictionaries."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from palaver.llm import conversation_trie as C

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(rows, regrow):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    for c, own in turns.items():
        own.sort(key=lambda x: (x[:3], hashlib.sha256(f"{len(x[2].encode())}:{x[2]}{x[3]}".encode()).digest()[:16]))
        turns[c] = [x[2:] for x in own]
    if not regrow:
        return dict(turns)
    out = {}
    for c, own in turns.items():
        h, rest = zlib.crc32(str(c).encode()) % 4, abs(c) % 20 * (1 if c >= 0 else -1)
        out[c] = turns.get(c - rest, [])[:h] + own[h:]
    return out


def brute(seqs):
    members = defaultdict(list)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        words = len(re.findall(C.WORD, p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * words
    out = set()
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(p))))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def odd_rows():
    rnd, rows = random.Random(3), []
    texts = ["", None, "a", "a b", " a\tb c ", "tell me more", "x" * 300, "wörd " * 40]
    for c in range(-30, 130):
        for t in range(rnd.choice([0, 1, 2, 3, 5, 9, 17])):
            rows.append((c, t if rnd.random() < 0.9 else None, rnd.choice(["user", "assistant", None, ""]), rnd.choice(texts[: 2 + t % 6])))
    for c in range(200, 300):  # copies
        rows += [(c, 1, "user", "same"), (c, 2, "assistant", "same again"), (c, 3, "user", f"own {c % 3}")]
    rows += [(300, 0, "user", "once"), (300, 0, "user", "once"), (None, 1, "user", "nobody"), (None, None, None, None), (1 << 40, 1, "user", "far"), (1 << 40, 1, "assistant", "tied")]
    return rows


@pytest.mark.parametrize("regrow", [False, True])
def test_trie_is_the_dictionaries(spark, regrow, monkeypatch):
    monkeypatch.setattr(C, "LISTED", 7)
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"name": F.lit("clash"), "words": F.lit(1), "__k": F.lit(1), "pos": F.lit("x"), "len": F.lit(2)}).repartition(5)
    turns = C.ordered(df)
    got = C.trie(*(C.regrown(turns) if regrow else C.whole(turns))).select(*COLUMNS).collect()
    want = brute(sequences(rows, regrow))
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_long_conversations(spark):
    """Conversations of hundreds of turns that part at every depth, and one that all others repeat."""
    rnd = random.Random(4)
    base = [("user" if k % 2 else "assistant", f"turn {rnd.randrange(50)} of some") for k in range(300)]
    rows = []
    for c in range(24):
        keep = [0, 1, 2, 63, 64, 65, 127, 128, 255, 256, 299, 300][c % 12]
        rows += [(c, t, role, text if t < keep else f"own {c // 12}") for t, (role, text) in enumerate(base[: keep + c % 5])]
    got = C.trie(*C.whole(C.ordered(spark.createDataFrame(rows, SCHEMA)))).select(*COLUMNS).collect()
    want = brute(sequences(rows, False))
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_empty_tables_have_no_root(spark):
    for rows in ([], [(None, 1, "user", "a")]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert C.trie(*C.regrown(C.ordered(df))).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = C.op12_conversation_trie(spark, "/root/testdata/sf0.001").select(*COLUMNS).collect()
    assert {tuple(r) for r in got} == brute(sequences(rows, True)) and len(got) == len(set(got))
