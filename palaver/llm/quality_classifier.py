"""Operator 4: quality scores by histogram gradient-boosted trees.

Each text becomes a row of ``FEATURES`` statistics. The fit takes about ``rows`` labelled ids (chosen by
hash, of several texts of an id one); their statistics, a bounded matrix, come to the driver, which cuts
each into quantile bins and grows complete trees of fixed depth on gradient histograms. The trees
are flattened into arrays, so that all rows of a batch walk a tree in one numpy step a level.

Null and empty texts have all-zero statistics and are scored like any other. Labels other than 0 and
1 and null labels are not used; a repeated id has the mean of its labels, rounded. Without any label
of either kind, every score is the share of label 1 (0.5 without labels). Repeated rows are scored each,
very long texts whole; an empty table gives no rows; ``quality`` is a column, so no name can clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, read, sampled, small_batches

ROWS = 20_000
BINS, DEPTH, TREES, RATE, RIDGE = 64, 4, 100, 0.15, 1.0

FEATURES = [
    "bytes", "words", "word_length", "long_words", "distinct_words", "repeats_next", "top_word", "distinct_pairs",
    "lines", "distinct_lines", "line_words", "upper", "lower", "digits", "non_ascii", "spaces", "stops", "bars", "bangs",
    "symbols", "word_ends_symbol", "caps_words", "lone_words", "entropy",
]

_KINDS = np.zeros((9, 256))
for _k, _chars in enumerate([bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), bytes(range(128, 256)), b" \t\r\n", b".,;:?", b"|", b"!", b"#$%&*+<=>@^_`{}~\\/[]"]):
    _KINDS[_k, list(_chars)] = 1


def statistics(text: str | None) -> list[float]:
    """The features of a whole text, in the order of FEATURES."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [float(len(data)), *[0.0] * (len(FEATURES) - 1)]
    n, seen = len(words), {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    size = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in data.split(b"\n") if x.strip()]
    byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = byte[byte > 0] / len(data)
    upper, lower, digits, high, spaces, stops, bars, bangs, symbols = (_KINDS @ byte / len(data)).tolist()
    last = np.bincount(np.fromiter((w[-1] for w in words), np.uint8, n), minlength=256)
    return [
        float(len(data)), float(n), size.mean(), (size > 12).mean(), len(seen) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, max(seen.values()) / n, len(set(zip(words, words[1:], strict=False))) / n,
        float(len(lines)), len(set(lines)) / len(lines), n / len(lines), upper, lower, digits, high, spaces, stops, bars, bangs,
        symbols, (last * (_KINDS[6] + _KINDS[7] + _KINDS[8])).sum() / n, sum(map(bytes.isupper, seen)) / len(seen),
        seen_once(seen) / n, -(share * np.log2(share)).sum(),
    ]


def seen_once(seen: dict[bytes, int]) -> int:
    return sum(v == 1 for v in seen.values())


@dataclass
class Trees:
    """Complete trees in arrays: node k's children are 2k + 1 and 2k + 2."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (1 << DEPTH) + 1]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost logistic loss on histograms of binned features."""
    inner, leaves, width = (1 << DEPTH) - 1, 1 << DEPTH, x.shape[1]
    share = min(max(y.mean() if len(y) else 0.5, 1e-6), 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    none = Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if len(y) == 0 or y.min() == y.max():
        return none
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    total, out = np.full(len(y), base), ([], [], [])
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for depth in range(DEPTH):
            first, many = (1 << depth) - 1, 1 << depth
            cell = ((node - first)[:, None] * width + np.arange(width)) * BINS + binned
            size = many * width * BINS
            gs, hs = (np.bincount(cell.reshape(-1), weights=np.repeat(v, width), minlength=size).reshape(many, width, BINS).cumsum(axis=2) for v in (g, h))
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + RIDGE) + (ga - gs) ** 2 / (ha - hs + RIDGE) - ga**2 / (ha + RIDGE)
            gain[(hs < 1) | (ha - hs < 1)] = 0
            for k in range(many):
                f, b = divmod(int(gain[k].argmax()), BINS)
                if gain[k, f, b] > 1e-9 and b < len(cuts[f]):
                    feature[first + k], threshold[first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        at = node - inner
        leaf = -RATE * np.bincount(at, weights=g, minlength=leaves) / (np.bincount(at, weights=h, minlength=leaves) + RIDGE)
        total += leaf[at]
        for kept, new in zip(out, (feature, threshold, leaf), strict=True):
            kept.append(new)
    return Trees(base, *map(np.array, out))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = ROWS) -> Trees:
    """Learn from a sample of the labelled rows that are not held out."""
    known = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("i").isNotNull() & ~held_out(F.col("i")))
    known = known.groupBy("i").agg(F.round(F.avg("y")).cast("int").alias("y"))
    share = min(1.0, rows / max(1, known.count()))
    sample = known.where(sampled([F.col("i")], share))
    # About `rows` ids, as a hash takes them: small enough to broadcast.
    chosen = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(F.broadcast(sample), "i")

    def measure(batches):
        for part in batches:
            yield pd.DataFrame({"h": part["h"], "x": [statistics(t) for t in part["t"]], "y": part["y"]})

    measured = chosen.select(F.xxhash64("i").alias("h"), "t", "y").mapInPandas(measure, "h long, x array<double>, y int")
    found = measured.groupBy("h", "y").agg(F.min("x").alias("x")).toPandas()
    x = np.array(found["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T)  # the sums below then don't depend on the order of partitions
    return grow(x[order], found["y"].to_numpy(np.float64)[order])


def quality(text: Column, trees: Trees, spark) -> Column:
    """Score (0 to 1) of each whole text."""
    small_batches(spark)
    held = spark.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(held.value.score(np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(FEATURES))))

    return score(text)


def op4_quality_classifier(spark, sf_dir: str, cutoff: float = 0.3) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    trees = fit(docs, read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality(F.col("text"), trees, spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))
