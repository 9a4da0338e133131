"""Operator 10: benchmark decontamination by a distributed positional inverted index.

Index: one pass over the corpus cuts it into blocks of texts of bounded size, lays the words of a block
end to end (with gaps between texts) and stores, as a Parquet table in the folder that all machines
share, one posting list for each term of a block: the sorted places where it stands. Beside them it
stores where each text begins and how many words it has. Lists are kept of the benchmark's terms, as no
others can be asked for; if it has over ``MOST_TERMS`` different ones, of all terms. Nothing of the
corpus is read again.

Queries: the benchmark is a table too. Each window of ``size`` consecutive words of an item becomes a
row, windows with one text become one, and its terms are put in order by their counts in the index, the
rarest first. The lists of the rarest term are joined to the windows; moved back by the term's offset
they are the places where the window may begin. In each block, these are intersected with the moved
lists of the other terms, from the next rarest on. What is left are exact phrase matches. A word inside
of one is hit.

Proximity matches come from the same lists: an item also counts as near if its ``near_terms`` rarest
different words (all of them, if it has fewer) stand within ``near_span`` consecutive words of a text.

Terms and windows are 64-bit hashes of words and of sequences of those; a chance collision is not told
apart. A block, hence a text, is worked on by one task. An item of fewer words than a window, but not
none, is one window. Null and empty texts have no words; null item ids take no part; repeated items
count once by id; repeated documents are judged each; very long texts are one block each, cut into
words piece by piece; empty tables give no rows or no matches.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MOST_SENT, checkpointed, fresh, read, shared_dir, small_batches

#: Words of an index block, unless a single text has more.
BLOCK_WORDS = 500_000
#: Different benchmark words up to which the tasks get them (some 100 bytes each) as a filter.
MOST_TERMS = 400_000
#: Bytes of a text that are cut into words at once, and words whose hashes a task remembers.
PIECE, MEMO = 1 << 20, 200_000

#: A-Z become a-z; of ASCII, all but letters and digits separates words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def term(word: bytes) -> int:
    """A word's hash; 0 is kept for words that are not wanted."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(word)).view(np.int64)) or 1


class Terms:
    """Turns texts into hashes of their words, those in ``wanted`` (by word; None: all)."""

    def __init__(self, wanted: dict[bytes, int] | None):
        self.all = wanted is None
        self.hashes = {} if self.all else wanted

    def look(self, data: bytes | None) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of words, and the places and terms of the wanted ones."""
        data, n, places, terms, at = (data or b"").translate(_TABLE), 0, [], [], 0
        while at < len(data):
            end = len(data) if at + PIECE >= len(data) else data.find(b" ", at + PIECE)
            end = len(data) if end < 0 else end
            words = data[at:end].split()
            at = end
            if self.all:
                if len(self.hashes) > MEMO:
                    self.hashes.clear()
                self.hashes.update((w, term(w)) for w in set(words) if w not in self.hashes)
            found = np.fromiter(map(self.hashes.get, words, repeat(0)), np.int64, len(words))
            known = np.flatnonzero(found)
            places.append(known + n)
            terms.append(found[known])
            n += len(words)
        return n, np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.int64), *terms])


def build_index(docs: DataFrame, wanted, path: str, gap: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the index of ``docs`` below ``path`` and read it. Rows with a term: block, term, places, n
    (how many). Rows without: block, doc (the id), mark (hash of the text), first (place of its first
    word), n (words). ``wanted``: a broadcast of the words to keep and their terms, or of None."""
    import pyarrow as pa

    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField(c, t) for c, t in (("block", T.LongType()), ("term", T.LongType()), ("places", T.ArrayType(T.IntegerType())), ("n", T.IntegerType()), ("doc", kind), ("mark", T.LongType()), ("first", T.IntegerType()))])
    most = BLOCK_WORDS

    def index(batches):
        from pyspark import TaskContext

        terms, block = Terms(wanted.value), TaskContext.get().partitionId() << 32
        names = ["block", "term", "places", "n", "doc", "mark", "first"]

        def lists(places: list, found: list, arrow_kind):
            place, code = np.concatenate(places), np.concatenate(found)
            order = np.argsort(code, kind="stable")
            place, code = place[order].astype(np.int32), code[order]
            cuts = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
            held = np.append(cuts, len(code)).astype(np.int32)
            k = len(cuts)
            none = pa.nulls(k, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.full(k, block)), pa.array(code[cuts]), pa.ListArray.from_arrays(pa.array(held), pa.array(place)), pa.array(np.diff(held)), pa.nulls(k, arrow_kind), none, pa.nulls(k, pa.int32())], names)

        places, found, used = [], [], 0
        for part in batches:
            blocks, firsts, counts, arrow_kind = [], [], [], part.column("doc").type
            for data in part.column("text").to_pylist():
                n, at, code = terms.look(data)
                if used and used + n > most:
                    yield lists(places, found, arrow_kind)
                    places, found, used, block = [], [], 0, block + 1
                blocks.append(block)
                firsts.append(used)
                counts.append(n)
                places.append(at + used)
                found.append(code)
                used += n + gap
            k = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int32())), pa.array(counts, pa.int32()), part.column("doc"), part.column("mark"), pa.array(firsts, pa.int32())], names)
        if places:
            yield lists(places, found, arrow_kind)

    rows = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("mark"), F.col(text).cast("binary").alias("text"))
    rows.mapInArrow(index, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def item_words(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """The different words of all items with an id, as column ``word``."""

    @F.pandas_udf("array<string>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({w.decode("utf-8", "surrogatepass") for w in words_of(t)}) for t in texts], dtype=object)

    return benchmark.where(F.col(item_id).isNotNull()).select(F.explode(of(F.col(text).cast("string"))).alias("word")).distinct()


def item_terms(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """item, terms (hashes in the order of the text) of every item with an id and a word."""

    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([[term(w) for w in words_of(t)] for t in texts], dtype=object)

    named = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(text).cast("string").alias("text")).where("item IS NOT NULL")
    return named.select("item", of("text").alias("terms")).where(F.size("terms") > 0).distinct()


def windows_of(items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Different windows: win, terms, owner; and (owner, item): windows with the same items have one owner."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("terms") - (size - 1)))
    own = items.select("item", F.explode(F.transform(at, lambda k: F.slice("terms", k, size))).alias("terms"))
    own = own.select("item", "terms", F.xxhash64("terms", F.size("terms")).alias("win")).distinct()
    h = F.xxhash64("item")
    wins = own.groupBy("win").agg(F.any_value("terms").alias("terms"), F.xxhash64(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 8))).alias("owner"))
    wins = checkpointed(wins)
    lead = wins.groupBy("owner").agg(F.min("win").alias("win"))
    return wins, checkpointed(own.select("win", "item").join(lead, "win").select("owner", "item").distinct())


def ranked(entries: DataFrame, key: list[str], counts: DataFrame, many: int = 1 << 30) -> DataFrame:
    """``entries``: key, offset, term. One row for each key whose terms all stand in the corpus: terms and
    offsets in ``e``, the rarest first, ``many`` at most."""
    known = entries.join(counts, "term", "left").select(*key, F.struct(F.coalesce("total", F.lit(0)).alias("total"), "term", "offset").alias("e"))
    return known.groupBy(*key).agg(F.slice(F.sort_array(F.collect_list("e")), 1, many).alias("e")).where(F.col("e")[0]["total"] > 0)


class Block:
    """The posting lists of one block, as one sorted array of (term number, place)."""

    def __init__(self, lists: pd.DataFrame):
        self.terms = lists["term"].to_numpy(np.int64)
        order = np.argsort(self.terms)
        self.terms = self.terms[order]
        places = [np.asarray(lists["places"].iloc[k], np.int64) for k in order]
        self.cuts = np.cumsum([0, *map(len, places)])
        self.places = np.concatenate([np.zeros(0, np.int64), *places])
        self.keys = (np.repeat(np.arange(len(places)), np.diff(self.cuts)) << 32) | self.places

    def number(self, terms: np.ndarray) -> np.ndarray:
        """Numbers of terms, -1 for those that the block doesn't have."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        k = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[k] == terms, k, -1)

    def has(self, number: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = (number << 32) | place
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (number >= 0) & (place >= 0) & (self.keys[k] == key)

    def phrases(self, hope: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``hope``, place where the window begins) of all exact matches."""
        if not len(hope):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        length = np.array([len(x) for x in hope["terms"]], np.int64)
        offsets, numbers = np.zeros((len(hope), length.max()), np.int64), np.full((len(hope), length.max()), -1, np.int64)
        filled = np.arange(length.max()) < length[:, None]
        offsets[filled] = np.concatenate([np.asarray(x, np.int64) for x in hope["offsets"]])
        numbers[filled] = self.number(np.concatenate([np.asarray(x, np.int64) for x in hope["terms"]]))
        many = np.array([len(x) for x in hope["places"]], np.int64)
        row = np.repeat(np.arange(len(hope)), many)
        start = np.concatenate([np.asarray(x, np.int64) for x in hope["places"]]) - offsets[row, 0]
        for k in range(1, length.max()):  # the lists of each further term, rarest first
            ok = (length[row] <= k) | self.has(numbers[row, k], start + offsets[row, k])
            row, start = row[ok], start[ok]
        ok = start >= 0
        return row[ok], start[ok]

    def near(self, terms: np.ndarray, span: int) -> np.ndarray:
        """Ends of stretches of ``span`` words in which all ``terms``, the rarest first, stand."""
        numbers = self.number(terms)
        if (numbers < 0).any():
            return np.zeros(0, np.int64)
        lists = [self.places[self.cuts[k] : self.cuts[k + 1]] for k in numbers.tolist()]
        ends = np.concatenate(lists)
        for p in lists:  # each term has a posting in (end - span, end]
            k = np.searchsorted(p, ends, "right") - 1
            ends = ends[(k >= 0) & (p[np.maximum(k, 0)] > ends - span)]
        return ends


FOUND = "block long, first int, spans array<struct<first: int, last: int>>, owners array<long>, near_items array<long>"


def find_in_block(hope: pd.DataFrame, rows: pd.DataFrame, span: int) -> pd.DataFrame:
    """Matches by text of one block. ``hope``: asked (owner; item if close), terms, offsets, places.
    ``rows``: term and places, or term 0 and first."""
    begin = np.sort(rows["first"].to_numpy()[rows["term"].to_numpy() == 0].astype(np.int64))
    block = Block(rows[rows["term"] != 0])
    of = lambda place: np.searchsorted(begin, place, "right") - 1
    exact, close = hope[~hope["close"]], hope[hope["close"]]
    row, start = block.phrases(exact)
    length = np.array([len(x) for x in exact["terms"]], np.int64)
    stop = start + length[row] if len(row) else start
    owner = exact["asked"].to_numpy(np.int64)[row]
    near: dict[int, set[int]] = {}
    for item, terms in zip(close["asked"].tolist(), close["terms"], strict=True):
        for k in set(of(block.near(np.asarray(terms, np.int64), span)).tolist()):
            near.setdefault(k, set()).add(int(item))
    text, out = of(start), []
    order = np.lexsort((start, text))
    text, start, stop, owner = text[order], start[order], stop[order], owner[order]
    cuts = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    phrases = {int(text[a]): (a, b) for a, b in zip(cuts, np.append(cuts[1:], len(text)), strict=True)} if len(text) else {}
    for k in sorted(phrases.keys() | near.keys()):
        a, b = phrases.get(k, (0, 0))
        s, e = start[a:b] - begin[k], np.maximum.accumulate(stop[a:b] - begin[k])
        new = np.flatnonzero(np.append(True, s[1:] > e[:-1])) if b > a else np.zeros(0, np.int64)
        last = np.append(new[1:] - 1, len(s) - 1)[: len(new)]
        spans = [{"first": int(x), "last": int(y) - 1} for x, y in zip(s[new], e[last], strict=True)]
        out.append((int(rows["block"].iloc[0]), int(begin[k]), spans, np.unique(owner[a:b]).tolist(), sorted(near.get(k, ()))))
    return pd.DataFrame(out, columns=["block", "first", "spans", "owners", "near_items"])


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, near_terms: int = 6, near_span: int = 20) -> DataFrame:
    """One row for each of ``docs``: doc (its id), mark (hash of its text), n_words, n_hit, spans (first and
    last word of each hit stretch), items (ids with exact matches), near_items (ids with proximity
    matches); the arrays are sorted."""
    spark = docs.sparkSession
    small_batches(spark)
    items = checkpointed(item_terms(benchmark, item_id, item_text))
    words = item_words(benchmark, item_id, item_text).limit(MOST_TERMS + 1).collect()
    few = len(words) <= MOST_TERMS
    known = (r["word"].encode("utf-8", "surrogatepass") for r in words)
    wanted = spark.sparkContext.broadcast({w: term(w) for w in known} if few else None)
    path = shared_dir(spark, "postings")
    index = build_index(docs, wanted, path, max(size, near_span), doc_id, text)
    lists, texts = index.where("term IS NOT NULL"), index.where("term IS NULL")

    counts = lists.groupBy("term").agg(F.sum("n").alias("total"))
    counts = checkpointed(counts if few else counts.join(items.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi"))
    wins, owners = windows_of(items, size)
    placed = wins.select("win", "owner", F.posexplode("terms").alias("offset", "term"))
    exact = ranked(placed, ["win", "owner"], counts).select(F.lit(False).alias("close"), F.col("owner").alias("asked"), "e")
    different = items.select("item", F.xxhash64("terms").alias("said"), F.explode("terms").alias("term")).distinct().withColumn("offset", F.lit(0))
    near = ranked(different, ["item", "said"], counts, near_terms).select(F.lit(True).alias("close"), F.col("item").alias("asked"), "e")
    asked = checkpointed(exact.unionByName(near).select("close", "asked", F.col("e.term").alias("terms"), F.col("e.offset").alias("offsets"), F.col("e")[0]["term"].alias("term")))
    anchors = checkpointed(asked.select("term").distinct())
    anchors = F.broadcast(anchors) if anchors.count() <= MOST_SENT else anchors
    hope = lists.select("block", "term", "places").join(anchors, "term", "left_semi").join(asked, "term").select("block", "close", "asked", "terms", "offsets", F.when(~F.col("close"), F.col("places")).alias("places"))

    again = spark.read.schema(index.schema).parquet(path).where("term IS NOT NULL")  # a plan of its own, to be joined to the one above
    used = again if few else again.join(asked.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi")
    rows = used.select("block", "term", "places", F.lit(0).alias("first")).unionByName(texts.select("block", F.lit(0).cast("long").alias("term"), "places", "first"))

    def find(hopes: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        return find_in_block(hopes, part, near_span) if len(hopes) else pd.DataFrame([], columns=["block", "first", "spans", "owners", "near_items"])

    found = checkpointed(hope.groupBy("block").cogroup(rows.groupBy("block")).applyInPandas(find, FOUND))
    named = found.select("block", "first", F.explode("owners").alias("owner")).join(owners, "owner")
    named = named.groupBy("block", "first").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hits = checkpointed(found.drop("owners").join(named, ["block", "first"], "left"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    keyed = texts.select("block", "first", "doc", "mark", F.col("n").cast("long").alias("n_words"))
    joined = keyed.join(hits, ["block", "first"], "left")
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    return joined.select("doc", "mark", "n_words", F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"), empty("spans", "array<struct<first: int, last: int>>"), empty("items", "array<long>"), empty("near_items", "array<long>"))


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with n_words, n_hit, items, near_items and spans, which replace columns of the same names.
    The results of each text are joined to its rows, so texts are shuffled if there are many."""
    (mark,) = fresh(docs, "mark")
    rows = docs.withColumn(mark, F.xxhash64(text))
    found = matches(rows, benchmark, mark, text, **options).dropDuplicates(["mark"])
    names = ["n_words", "n_hit", "items", "near_items", "spans"]
    kept = rows.select([c for c in rows.columns if c.lower() not in names])
    return kept.join(found.select(F.col("mark").alias(mark), *names), mark).drop(mark)


def drop_leaked(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark window. The hashes of such texts go to all
    tasks, so that no text is shuffled, or are joined if they are too many."""
    (mark,) = fresh(docs, "mark")
    found = matches(docs.select(F.lit(0).alias("doc_id"), F.col(text).alias("text")), benchmark, **options)
    gone = checkpointed(found.where("n_hit > 0").select(F.col("mark").alias(mark)).distinct())
    gone = F.broadcast(gone) if gone.count() <= MOST_SENT else gone
    return docs.withColumn(mark, F.xxhash64(text)).join(gone, mark, "left_anti").drop(mark)


def joined_ids(items: Column) -> Column:
    """Ids sorted as strings, joined by commas."""
    return F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ",")


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = matches(docs, read(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("doc").alias("doc_id"), "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(joined_ids(F.col("items")), "UTF-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontamination_proximity(spark, sf_dir: str) -> DataFrame:
    """The other half of operator 10's matches: of every document the items whose six rarest words (of those that occur
    in the corpus at all, if all do) stand within 20 words of it, in any order: doc_id, n_near, near_sha256."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = matches(docs, read(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.size("near_items").cast("long").alias("n_near"), F.sha2(F.encode(joined_ids(F.col("near_items")), "UTF-8"), 256).alias("near_sha256"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, len(p) AS n, array_to_string(p, ' ') AS phrase FROM (
    SELECT item_id, unnest(list_transform(range(greatest(1, len(w) - 9)), lambda k: w[k + 1 : k + 10])) AS p FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win
), place AS (
  SELECT r, n, k, array_to_string(w[k + 1 : k + n], ' ') AS phrase FROM (
    SELECT r, w, n, unnest(range(len(w) - n + 1)) AS k FROM d, sizes WHERE len(w) >= n)
), found AS (
  SELECT r, k, win.n AS n, item_id FROM place JOIN win USING (n, phrase)
), hits AS (
  SELECT r, count(DISTINCT h) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS h FROM found) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""
