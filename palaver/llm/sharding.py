"""Operator 2: shards of near-equal bytes by histogram sort.

The rows' sort key is (hash of the text, hash of the id), so equal texts stand together. A first
round counts the exact bytes in equal key ranges; each splitter lies in one of them, and every
further round divides only the ranges that hold a splitter and counts again, until a range's end is
within the tolerance or the range is one key. Only ``FANOUT`` counts for each of at most
``shards`` - 1 splitters come to the driver. The shard of each row then follows from the splitters,
and the rows are exchanged once.

Groups of equal texts stay together unless a splitter falls inside one that is larger than the
tolerance: the rounds then go on with the second half of the key, so a text that makes up a third
of all rows is divided evenly too. Rows that agree in text and id can't be divided. A null text has
no bytes (size 1), the crc32 and the key of the empty text; null ids share one key half. Repeated
rows get a slot each. An empty table gives no rows.

Slots are gapless in a shard: rows are numbered inside of cells (shard, text range, id range) in
parallel, and each cell starts where the cells before it end. The more rows, the finer the cells, by
bits of the id's hash, so that a very common text is cut up too. Null, empty and very long texts are
dealt with alike; columns named as those that are added are replaced.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh, read

FANOUT = 512
#: Key halves are longs from 0 on.
KEY_BITS = 62
#: Bits of the halves that make a cell, at least; rows a cell should hold at most, on average.
CELL_BITS, CELL_ROWS = (8, 6), 100_000


def splitters(keys: DataFrame, size: str, halves: tuple[str, str], shards: int, tolerance: float) -> list[tuple[int, int]]:
    """The lowest key of the shards 1, 2, ... in order."""
    total = keys.agg(F.sum(size)).first()[0] or 0
    top = (1 << KEY_BITS) - 1
    #: By splitter: (key half that is divided, value of the first half, range, bytes below the range).
    searching = {s: (0, 0, 0, top, 0) for s in range(1, shards)} if total else {}
    found: dict[int, tuple[int, int]] = {}
    while searching:
        spans = {span: k for k, span in enumerate(dict.fromkeys(x[:4] for x in searching.values()))}
        step = {span: -(-(span[3] - span[2] + 1) // FANOUT) for span in spans}
        number = None
        for span, k in spans.items():
            half, first, low, high = span
            inside = F.col(halves[half]).between(low, high) & (F.lit(half == 0) | (F.col(halves[0]) == first))
            part = F.expr(f"cast(({halves[half]} - {low}L) div {step[span]}L as int)") + k * FANOUT
            number = F.when(inside, part) if number is None else number.when(inside, part)
        value = F.when(F.lit(False), F.lit(None).cast("long"))
        for span, k in spans.items():
            value = value.when(F.col("part").between(k * FANOUT, (k + 1) * FANOUT - 1), F.col(halves[span[0]]))
        counted = keys.select(number.alias("part"), size, *halves).where("part IS NOT NULL").groupBy("part")
        counts = {r["part"]: r for r in counted.agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"), F.min(value).alias("low"), F.max(value).alias("high")).collect()}
        for s, (half, first, low, high, below) in list(searching.items()):
            span = (half, first, low, high)
            want, slack, mass, part = total * s / shards, tolerance * total / shards, 0, None
            for p in range(FANOUT):
                if r := counts.get(spans[span] * FANOUT + p):
                    below, mass, part = below + mass, r["bytes"], r
                    if below + mass > want:
                        break
            start, end = part["low"], part["high"]  # no keys lie outside
            one = part["rows"] == 1 or start == end and half == 1
            cut = None
            if want - below <= slack or one and want - below <= mass / 2:
                cut = start
            elif below + mass - want <= slack or one:
                cut = end + 1
            if cut is not None:
                found[s] = (first, cut) if half else (cut, 0)
                del searching[s]
            elif start == end:
                searching[s] = (1, start, 0, top, below)
            else:
                searching[s] = (half, first, start, end, below)
    return [found[s] for s in sorted(found)]


def shard_documents(docs: DataFrame, shards: int = 16, text: str = "text", doc_id: str = "doc_id", tolerance: float = 0.001) -> DataFrame:
    """``docs`` with size, text_crc32, law (``bytes``), shard, slot and grown_shard (null)."""
    k1, k2, b1, b2, first_slot = fresh(docs, "k1", "k2", "b1", "b2", "first_slot")
    filled = F.coalesce(F.col(text), F.lit(""))
    half = lambda h: F.shiftrightunsigned(h, 64 - KEY_BITS)
    keyed = docs.withColumns({
        "size": F.octet_length(filled).cast("long") + 1,
        "text_crc32": F.crc32(F.encode(filled, "UTF-8")),
        k1: half(F.xxhash64(filled)),
        k2: half(F.xxhash64(F.col(doc_id))),
    })
    narrow = checkpointed(keyed.select("size", k1, k2))
    cuts = splitters(narrow, "size", (k1, k2), shards, tolerance)

    def placed(df: DataFrame) -> DataFrame:
        shard = F.lit(0)
        for a, b in cuts:
            shard = shard + F.when((F.col(k1) > a) | ((F.col(k1) == a) & (F.col(k2) >= b)), 1).otherwise(0)
        return df.withColumns({"shard": shard, b1: F.shiftright(k1, KEY_BITS - CELL_BITS[0]).cast("int"), b2: F.shiftright(k2, KEY_BITS - CELL_BITS[1] - min(finer, 24)).cast("int")})

    finer = max(0, ceil(log2(max(1, narrow.count()) / (CELL_ROWS << CELL_BITS[0]))) - CELL_BITS[1])
    cell = ["shard", b1, b2]
    counts = placed(narrow).groupBy(cell).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy(b1, b2).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*cell, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first_slot))
    inside = F.row_number().over(Window.partitionBy(cell).orderBy(k1, k2))
    starts = starts if finer else F.broadcast(starts)  # (256 + shards) * 64 rows; else joined as the cells are dealt out
    return (
        placed(keyed)
        .withColumn("slot", inside - F.lit(1))
        .join(starts, cell)
        .withColumns({"slot": F.col("slot") + F.col(first_slot), "law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
        .drop(k1, k2, b1, b2, first_slot)
    )


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_documents(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
