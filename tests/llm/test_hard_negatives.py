"""Operator 13 against all pairs of rows."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palaver.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=3, every=50):
    good = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: max(-H.FAR, min(H.FAR, sum(int(x) * int(y) for x, y in zip(a, b, strict=False))))
    out = []
    for a, label, v in good:
        if a % every == 0:
            mine = sorted((-score(v, w), i) for i, k, w in good if k == label and i != a)[:positives]
            others = sorted((-score(v, w), i) for i, k, w in good if k != label)
            for s, p in mine:
                inside = [(n, i) for n, i in others if 50 * -s <= 100 * -n <= 95 * -s][:negatives]
                out += [(a, p, rank, i, -s, -n) for rank, (n, i) in enumerate(inside, 1)]
    return sorted(out)


def made(n, dim, seed, spread=0.4, copies=0):
    rnd = np.random.default_rng(seed)
    centers = rnd.normal(size=(7, dim))
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    common, rows = (centers[0] * 0.9).tolist(), []
    for k in range(n):
        label = int(rnd.integers(7))
        v = (centers[label] + centers[(label + 1) % 7] * 0.5 + rnd.normal(size=dim) * spread / math.sqrt(dim)).astype(np.float32).tolist()
        rows.append((k, np.float32(common).tolist() if k % 100 < copies else v, label))
    return rows


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"block": F.lit("x"), "n": F.lit(1), "id": F.lit(2)}).repartition(3)
    got = H.mine(df, **options).collect()
    return sorted(tuple(r) for r in got)


@pytest.mark.parametrize(("block", "anchors", "first"), [(H.BLOCK_ROWS, H.BLOCK_ANCHORS, H.FIRST), (16, 4, 1)])
def test_all_pairs(spark, block, anchors, first, monkeypatch):
    for name, value in (("BLOCK_ROWS", block), ("BLOCK_ANCHORS", anchors), ("FIRST", first), ("TASK_BLOCKS", 5)):
        monkeypatch.setattr(H, name, value)
    rows = made(600, 12, 1, copies=30)  # a third has one vector
    assert mined(spark, rows, every=20) == brute(rows, every=20) != []


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_ROWS", 7)
    rows = made(120, 4, 2)
    rows += [(None, [1.0] * 4, 1), (150, None, 1), (151, [1.0, None, 1.0, 1.0], 1), (152, [float("nan")] * 4, 1), (153, [float("inf")] * 4, 1), (154, [1.0] * 4, None), (None, None, None)]
    rows += [(200, [0.0] * 4, 1), (250, [], 2), (251, [1.0], 2), (300, [1.0] * 6, 3), (301, [-1.0] * 4, 3), (350, [1.0] * 4, 50)]  # zero, short and long vectors, a label of its own
    rows += [rows[3], rows[3], rows[9]]
    got = mined(spark, rows, every=10, positives=3, negatives=2)
    assert got == brute(rows, 3, 2, 10) and got


def test_no_rows_and_no_anchors(spark):
    for rows in ([], [(1, [1.0], 1)], [(50, [1.0], 1)], [(50, [], 1), (51, [], 1), (52, [], 2)], [(50, [1.0], 1), (51, [1.0], 1)]):
        assert mined(spark, rows) == brute(rows)


def test_large_numbers_are_exact(spark):
    rows = [(k, [float(x) * 2.0**e for x in (1 + k % 5, k % 7, -k % 3)], k % 2) for e in (20, 24, 60) for k in range(0, 60, 2)]
    rows = [(i * 3 + n % 3, *r) for n, (i, *r) in enumerate(rows)]
    assert mined(spark, rows, every=3) == brute(rows, every=3)


def test_bounds_hold_and_save_work():
    rnd = np.random.default_rng(3)
    codes = np.floor(rnd.normal(size=(300, 8)) * rnd.choice([1, 50, 3000], size=(300, 1)))
    codes[:50] = codes[50:100]  # angles of 0
    codes[100:120] = -codes[120:140]  # and of pi
    refs = codes[:5] / np.maximum(H._norms(codes[:5]), 1)[:, None]
    angles, norms = H._angles(codes, refs), H._norms(codes)
    apart = np.abs(angles[:, None] - angles[None]).max(axis=2)
    total = angles[:, None] + angles[None]
    product = norms[:, None] * norms
    low, high = H._Anchors._bounds(apart, np.minimum(total, 2 * np.pi - total).min(axis=2), (product, product))
    exact = codes @ codes.T
    assert (low <= exact).all() and (exact <= high).all() and (high < product * 0.9).mean() > 0.2


def test_matrix_pads():
    got = H._matrix(pa.array([[0.5, -0.001], [], [1.0, 2.0, 3.0]]))
    assert got.tolist() == [[128, -1, 0], [0, 0, 0], [256, 512, 768]]
