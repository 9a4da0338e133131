"""Trigram index: a superset of the items that can match, narrowed before the exact test.

The index is (gram, key) with a table of how many items have each gram. A query looks up only its
rarest grams: fewer than all is still a superset, and a gram that most items have is never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Buckets of the written index; readers of a gram read the files of one of them.
BUCKETS = 64
#: Characters whose trigrams are sorted at once, and (trigram, item) pairs of a chunk, which bound a task's arrays.
CHARS = 1 << 21
PAIRS = 1 << 22
_CODES = 0x110000
_CODE_BITS = 21


def build(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(gram, key), once for each item."""
    return texts.select(*key, F.explode(T.trigrams(F.col(text))).alias("gram")).distinct()


def frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("gram").agg(F.count("*").alias("items"))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write(index: DataFrame, path: str, mode: str = "error") -> None:
    """By bucket of the gram, sorted inside, so that a lookup prunes both files and row groups."""
    index.withColumn("bucket", _bucket(F.col("gram"))).repartition("bucket", F.pmod(F.xxhash64(*index.columns), F.lit(16))).sortWithinPartitions("bucket", "gram").write.mode(mode).partitionBy("bucket").parquet(path)


def query_grams(query: str, exact: bool = False) -> list[str]:
    """Grams that each matching item must have; none if all words are too short."""
    words = [query.lower().strip()] if exact else query.lower().split()
    return sorted({w[k : k + 3] for w in words for k in range(len(w) - 2)})


def candidates(index: DataFrame, query: str, key: list[str], exact: bool = False, most: int = 8) -> DataFrame | None:
    """Keys of items that have the query's rarest grams; None: no usable gram, all items are candidates."""
    grams = query_grams(query, exact)
    if not grams:
        return None
    wanted = index.where(F.col("gram").isin(grams))
    if "bucket" in index.columns:  # literals, so that the scan of a written index prunes by them
        asked = index.sparkSession.createDataFrame([(g,) for g in grams], "gram string")
        wanted = wanted.where(F.col("bucket").isin([r["b"] for r in asked.select(_bucket(F.col("gram")).alias("b")).distinct().collect()]))
    if len(grams) > most:
        # The query's own grams only: a handful of rows.
        counts = {r["gram"]: r["items"] for r in frequencies(wanted).collect()}
        grams = sorted(grams, key=lambda g: (counts.get(g, 0), g))[:most]
        wanted = wanted.where(F.col("gram").isin(grams))
    return wanted.groupBy(*key).agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).drop("n")


def narrowed(texts: DataFrame, index: DataFrame, query: str, key: list[str], exact: bool = False) -> DataFrame:
    """Texts of the candidates only."""
    found = candidates(index, query, key, exact)
    return texts if found is None else texts.join(found, key, "left_semi")


def posted(texts: DataFrame, key: str) -> DataFrame:
    """bucket, chunk, gram, n, numbers of texts (bucket, number, ``key``, text) that are sorted by bucket and number inside
    of their partitions. A chunk is what one task holds of a bucket's texts at once; in it each gram has one row, with
    the sorted numbers of the items that have it. A text lies in one chunk. A row without a key gives one of nulls.

    The grams of some texts are found as numbers, all places at once, and sorted inside the task that has the texts,
    so that no row is made for each gram of each text."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunk, held, pairs = None, None, [], 0
        for batch in batches:
            for bucket, begin, end in _runs(batch.column(0).to_numpy()):
                if held and bucket != now:
                    yield _chunk(now, chunk, held)
                    held, pairs = [], 0
                now = bucket
                rows = batch.slice(begin, end - begin)
                absent = rows.column(2).to_pylist()
                if blanks := sum(absent):
                    yield _rows([bucket] * blanks, [None] * blanks, [None] * blanks, [None] * blanks, pa.nulls(blanks, pa.list_(pa.int64())))
                there = [(n, t) for n, a, t in zip(rows.column(1).to_pylist(), absent, rows.column(3).to_pylist(), strict=True) if not a and t]
                for some in _grouped(there):
                    if not held:
                        chunk = some[0][0]
                    held.append(_pairs([t for _, t in some], np.array([n for n, _ in some], np.int64)))
                    pairs += len(held[-1][0])
                    if pairs >= PAIRS:
                        yield _chunk(now, chunk, held)
                        held, pairs = [], 0
        if held:
            yield _chunk(now, chunk, held)

    low = texts.select("bucket", "number", F.col(key).isNull().alias("absent"), F.lower("text").alias("text"))
    return low.mapInArrow(post, "bucket int, chunk long, gram string, n int, numbers array<long>")


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of each run of equal values."""
    ends = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return ((int(values[a]), a, b) for a, b in zip(ends, ends[1:], strict=False) if a < b)


def _grouped(rows: list[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """(number, text) rows in groups of about ``CHARS`` characters; a longer text is one group."""
    group, chars = [], 0
    for row in rows:
        group.append(row)
        chars += len(row[1])
        if chars >= CHARS:
            yield group
            group, chars = [], 0
    if group:
        yield group


def _once(values: np.ndarray) -> np.ndarray:
    """Sorted, each value once. (``np.unique`` hashes, which takes ten times as long here.)"""
    values.sort()
    return values[np.append(True, values[1:] != values[:-1])[: len(values)]]


def _pairs(texts: list[str], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram, number) of the texts, each pair of a gram and a text once, sorted by gram, then by text."""
    if len(texts) == 1 and len(texts[0]) > 2 * CHARS:  # windows that share two characters
        cuts = [_pairs([texts[0][k : k + CHARS + 2]], numbers)[0] for k in range(0, len(texts[0]) - 2, CHARS)]
        found = _once(np.concatenate(cuts))
        return found, np.full(len(found), numbers[0])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen = np.zeros(_CODES, bool)
    seen[codes] = True
    alphabet = np.flatnonzero(seen)
    size = len(alphabet)
    if size**3 * len(texts) >= 1 << 63:  # more different characters than one number can tell apart
        half = len(texts) // 2
        return tuple(np.concatenate(x) for x in zip(_pairs(texts[:half], numbers[:half]), _pairs(texts[half:], numbers[half:]), strict=True))
    place = (np.cumsum(seen) - 1)[codes]
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    gram = ((place[:-2] * size + place[1:-1]) * size + place[2:]) * len(texts) + owner[:-2]
    found = _once(gram[owner[:-2] == owner[2:]])
    gram, owner = np.divmod(found, len(texts))
    gram, last = np.divmod(gram, size)
    first, middle = np.divmod(gram, size)
    return (alphabet[first] << 2 * _CODE_BITS) | (alphabet[middle] << _CODE_BITS) | alphabet[last], numbers[owner]


def _chunk(bucket: int, chunk: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows of a chunk, sorted by gram."""
    gram, number = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(gram, kind="stable")
    gram, number = gram[order], number[order]
    new = np.append(True, gram[1:] != gram[:-1])[: len(gram)]
    once = new | np.append(True, number[1:] != number[:-1])[: len(gram)]
    gram, number, new = gram[once], number[once], new[once]
    starts = np.flatnonzero(new)
    mask = (1 << _CODE_BITS) - 1
    names = np.stack([gram[starts] >> 2 * _CODE_BITS, (gram[starts] >> _CODE_BITS) & mask, gram[starts] & mask], 1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    ends = np.append(starts, len(gram)).astype(np.int32)
    return _rows([bucket] * len(starts), [chunk] * len(starts), [names[k : k + 3] for k in range(0, len(names), 3)], np.diff(ends), pa.ListArray.from_arrays(ends, pa.array(number)))


def _rows(bucket, chunk, gram, n, numbers) -> pa.RecordBatch:
    columns = [pa.array(bucket, pa.int32()), pa.array(chunk, pa.int64()), pa.array(gram, pa.string()), pa.array(n, pa.int32()), numbers]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", "gram", "n", "numbers"])
