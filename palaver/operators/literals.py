"""Very many literals at once, in one pass over each text.

A table whose literals have up to ``MOST_CHARS`` characters in all goes to every task as an Aho-Corasick automaton.
Of a larger one every task gets two bit tables of hashes: of how literals begin, in as many characters as the largest
power of two that fits, and of whole literals. Hashes of all places of a text are doubled from one such width to the
next; a place whose beginning is known is tried with each length of literals that begin in that width. What passes
crosses the network as a string and is joined to the literals, so hashes only spare work: a chance match is dropped,
and texts stay where they are, however many literals there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import fresh, kept

#: Characters of the literals of one automaton: some 100 bytes each.
MOST_CHARS = 1_000_000
#: Bits of a table of hashes, at least and at most; in between 64 for each literal. More literals than that make more
#: chance matches.
FEWEST_BITS, MOST_BITS = 1 << 16, 1 << 28
#: Characters of a text whose hashes are held at once.
CHARS = 1 << 20


def folded(text: str) -> str:
    """Lower-cased character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def automaton(pairs: list[tuple[str, str]], fold: bool = False):
    """Of (literal, stand-in) pairs; of equal literals the smallest stand-in counts, empty ones don't."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for literal, stand_in in sorted(((folded(a) if fold else a, b) for a, b in pairs if a), reverse=True):
        found.add_word(literal, (len(literal), stand_in))
    found.make_automaton()
    return found


def longest(machine, text: str, fold: bool = False) -> list[tuple[int, int, str]]:
    """(begin, end, stand-in) of the longest literal at each place where one begins."""
    best: dict[int, tuple[int, str]] = {}
    if len(machine):
        for last, (size, stand_in) in machine.iter(folded(text) if fold else text):
            if best.get(last + 1 - size, (0, ""))[0] < size:
                best[last + 1 - size] = (size, stand_in)
    return [(a, a + n, s) for a, (n, s) in best.items()]


def put_in(text: str, hits: list[tuple[int, int, str]]) -> str:
    """The text with the leftmost literals replaced, the longest of those that begin together."""
    out, at = [], 0
    for begin, end, stand_in in sorted(hits, key=lambda h: (h[0], -h[1], h[2])):
        if begin >= at:
            out += [text[at:begin], stand_in]
            at = end
    return "".join([*out, text[at:]])


def _sized(table: DataFrame) -> tuple[DataFrame, int]:
    """literal, stand_in, each literal once, written; and its characters in all."""
    pairs = kept(table.toDF("literal", "stand_in").where("literal <> ''").groupBy("literal").agg(F.min("stand_in").alias("stand_in")))
    return pairs, pairs.agg(F.sum(F.length("literal"))).first()[0] or 0


def replaced(rows: DataFrame, text: str, table: DataFrame, fold: bool = False, most: int = MOST_CHARS) -> DataFrame:
    """``rows`` with all literals of ``table`` (literal, stand-in) replaced in ``text``, leftmost and longest first,
    with ``fold`` without case. What is put in is not looked at again. A null stand-in is an empty one."""
    pairs, chars = _sized(table.select(*[F.coalesce(c, F.lit("")) if k else F.col(c) for k, c in enumerate(table.columns)]))
    if chars <= most:
        sent = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in pairs.collect()])  # `most` bounds it

        @F.pandas_udf("string")
        def one_pass(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            machine = automaton(sent.value, fold)
            for texts in batches:
                yield pd.Series([t if t is None else put_in(t, longest(machine, t, fold)) for t in texts], dtype=object)

        return rows.withColumn(text, one_pass(text))
    number, hits = fresh(rows, "number", "hits")
    rows = kept(rows.withColumn(number, F.monotonically_increasing_id()))
    found = _found(rows.select(F.col(number).alias("number"), F.col(text).alias("text")), pairs, fold, True)
    # Of the literals that begin at a place the longest; of equal ones the smallest stand-in.
    found = found.groupBy("number", "begin").agg(F.min_by(F.struct("begin", "end", "stand_in"), F.struct(-F.col("end"), "stand_in")).alias("hit"))
    found = found.groupBy(F.col("number").alias(number)).agg(F.collect_list("hit").alias(hits))

    @F.pandas_udf("string")
    def together(texts: pd.Series, hits: pd.Series) -> pd.Series:
        return pd.Series([t if h is None else put_in(t, [(x["begin"], x["end"], x["stand_in"]) for x in h]) for t, h in zip(texts, hits, strict=True)], dtype=object)

    joined = rows.join(found, number, "left")
    return joined.withColumn(text, together(text, hits)).select(*[c for c in rows.columns if c != number])


def holding(rows: DataFrame, text: str, literals: DataFrame, line: str, fold: bool = True, most: int = MOST_CHARS) -> DataFrame:
    """literal, line of each row that holds it, once for each row."""
    column = literals.columns[0]
    pairs, chars = _sized(literals.select(F.col(column), F.col(column).alias("stand_in")))
    if fold:  # one literal for all that differ by case alone
        named, pairs = pairs, kept(pairs.groupBy(F.lower("literal").alias("stand_in")).agg(F.min("literal").alias("literal")).select("literal", "stand_in"))
    numbered = rows.select(F.monotonically_increasing_id().alias("number"), F.col(line).alias("line"), F.col(text).alias("text"))
    if chars <= most:
        sent = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in pairs.collect()])  # `most` bounds it

        @F.pandas_udf("array<string>")
        def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            machine = automaton(sent.value, fold)
            for texts in batches:
                yield pd.Series([_held(machine, t, fold) for t in texts], dtype=object)

        found = numbered.select("line", F.explode(held("text")).alias("literal"))
    else:
        found = _found(numbered, pairs, fold, False).dropDuplicates(["number", "stand_in"]).select("line", F.col("stand_in").alias("literal"))
    if fold:
        found = found.withColumnRenamed("literal", "low").join(named.select("literal", F.lower("literal").alias("low")), "low")
    return found.select("literal", "line")


def _held(machine, text: str | None, fold: bool) -> list[str]:
    if text is None or not len(machine):
        return []
    return sorted({stand_in for _, (_, stand_in) in machine.iter(folded(text) if fold else text)})


def _found(texts: DataFrame, pairs: DataFrame, fold: bool, places: bool) -> DataFrame:
    """The texts' columns but ``text``, with begin, end, stand_in of every literal at every place; without ``places`` once for
    each text, as a rule."""
    spark = texts.sparkSession

    @F.pandas_udf("string")
    def plain(literals: pd.Series) -> pd.Series:
        return pd.Series([folded(x) for x in literals], dtype=object)

    keys = pairs.withColumn("literal", plain("literal")).groupBy("literal").agg(F.min("stand_in").alias("stand_in")) if fold else pairs
    keys = kept(keys)
    bits = min(MOST_BITS, max(FEWEST_BITS, 1 << (64 * keys.count()).bit_length()))

    @F.pandas_udf("struct<size: int, first: long, whole: long>")
    def hashed(literals: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_literal_hashes(x, bits) for x in literals], columns=["size", "first", "whole"])

    known = kept(keys.select(hashed("literal").alias("h")).select("h.*"))
    sizes: dict[int, list[int]] = {}  # by width
    for row in known.select("size").distinct().collect():  # as many as there are lengths
        sizes.setdefault(_width(row["size"]), []).append(row["size"])
    sent = spark.sparkContext.broadcast((bits, {w: sorted(x) for w, x in sizes.items()}, _bit_table(known, "first", bits), _bit_table(known, "whole", bits)))

    @F.pandas_udf("array<struct<begin: int, end: int, literal: string>>")
    def candidates(column: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _candidates(folded(t) if fold else t, sent.value, places) for t in column], dtype=object)

    rest = [c for c in texts.columns if c != "text"]
    each = texts.select(*rest, F.explode(candidates("text")).alias("c")).select(*rest, "c.*")
    return each.join(keys, "literal").drop("literal")


def _width(size: int) -> int:
    """The largest power of two up to ``size``."""
    return 1 << (size.bit_length() - 1)


def _mixed(left: np.ndarray, right: np.ndarray | int) -> np.ndarray:
    """Hashes of two neighbours in one."""
    right = np.atleast_1d(np.asarray(right, np.uint64))
    x = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _coded(text: str) -> np.ndarray:
    return _mixed(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), 1)


def _literal_hashes(literal: str, bits: int) -> tuple[int, int, int]:
    """Its length, and the bits of its beginning and of all of it."""
    size, width = len(literal), _width(len(literal))
    head, tail = _coded(literal[:width]), _coded(literal[size - width :])
    while len(head) > 1:
        head, tail = _mixed(head[::2], head[1::2]), _mixed(tail[::2], tail[1::2])
    mask = np.uint64(bits - 1)
    return size, int((_mixed(head, width) & mask)[0]), int((_mixed(_mixed(head, tail), size) & mask)[0])


def _bit_table(known: DataFrame, column: str, bits: int) -> np.ndarray:
    """A table of ``bits`` bits with those of the column set, put together of 64 at a time."""
    words = known.select((F.col(column) / 64).cast("long").alias("word"), F.expr(f"shiftleft(1L, cast({column} % 64 as int))").alias("bit"))
    table = np.zeros(bits // 64, np.uint64)
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()  # at most bits / 64
    table[rows.column("word").to_numpy()] = rows.column("bit").to_numpy().view(np.uint64)
    return table


def _set(table: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = hashes & np.uint64(bits - 1)
    return ((table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def _candidates(text: str, known: tuple, places: bool) -> list[dict]:
    """Strings of the text that may be literals, with their places; without ``places`` each string once."""
    bits, sizes, first, whole = known
    if not sizes:
        return []
    longest, out = max(x[-1] for x in sizes.values()), {}
    for start in range(0, len(text), CHARS):  # windows that reach as far beyond their places as literals do
        window = text[start : start + CHARS + longest - 1]
        hashes, width = _coded(window), 1
        while len(hashes):
            if width in sizes:
                begins = np.flatnonzero(_set(first, _mixed(hashes[:CHARS], width), bits))
                for size in sizes[width]:
                    at = begins[begins + size <= len(window)]
                    at = at[_set(whole, _mixed(_mixed(hashes[at], hashes[at + size - width]), size), bits)]
                    for a in at.tolist():
                        out.setdefault((a + start, size) if places else window[a : a + size], (a + start, a + start + size, window[a : a + size]))
            if 2 * width > longest:
                break
            hashes, width = _mixed(hashes[:-width], hashes[width:]), 2 * width
    return [{"begin": a, "end": b, "literal": x} for a, b, x in out.values()]
