"""Operator 3: language identification by prediction by partial matching.

For each language a tree of byte contexts up to three bytes long is counted from labelled texts and
then frozen. A byte costs -log2 of its probability in the longest context the language knows; if it
was never seen there, the context's escape (method C: distinct followers / (followers + distinct))
is paid and the next shorter context asked, down to a uniform order -1. The language with the
shortest code for the whole text wins; the score is its share of 2 ** -length over all languages.

Texts are lower-cased. The fit takes, per language, about ``rows`` texts of any length (chosen by hash of
id and text; fewer where there are very many languages), of equal ones one; counts are summed on Spark.
Costs are tabled beforehand. A small model has a row with all languages for each four-byte number, so
that scoring is one lookup a byte. A larger one (``SparseModel``) keeps only what each language has seen
and falls back through its escapes. Its size is bounded: 0.5 MB of two-byte contexts a language, at most
``MOST_LANGUAGES`` of them (more are refused), and ``most_grams`` entries for each of three tables: costs of
four- and three-byte numbers, escapes of three-byte contexts. Where more were counted, each language keeps as
many as all can have, its most frequent ones. Totals, followers and all shorter orders are counted
before that cut: what is cut costs as if unseen in that one context, and nothing else changes.

Null texts and texts without a letter are ``und`` with score 0; ties go to the first language in
order; without any labelled row every text is ``und``. Repeated rows are scored each; very long texts are
scored whole, in slices; columns that clash are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh, held_out, read, sampled, small_batches

ROWS = 1500
#: Sampled texts over all languages, entries of a table over all languages (16 to 40 bytes each), languages.
MOST_ROWS, MOST_GRAMS, MOST_LANGUAGES = 100_000, 3_000_000, 256
#: Bytes of tables up to which rows with all languages are kept.
DENSE_BYTES = 128 << 20
ORDER = 3
PAD = b"\n" * ORDER
#: Bytes looked up at once.
SLICE = 1 << 19


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def grams(data: np.ndarray) -> np.ndarray:
    """Each byte with the three before it, as one number; the first three bytes are only context."""
    d = data.astype(np.uint32)
    return (d[:-3] << 24) | (d[1:-2] << 16) | (d[2:-1] << 8) | d[3:]


class Table:
    """A frozen hash table from numbers to rows."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(4 * len(keys) + 1).bit_length())
        self.mask = np.int64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int64)
        self.rows = np.zeros(1 << bits, np.int32)
        left, step = np.arange(len(keys)), 0
        keys = keys.astype(np.int64)
        while len(left):
            at = (self._hash(keys[left]) + step) & self.mask
            free = self.slots[at] == -1
            self.slots[at[free]] = keys[left[free]]
            put = self.slots[at] == keys[left]
            self.rows[at[put]] = left[put]
            left, step = left[~put], step + 1

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(0x1E3779B97F4A7C15)) >> np.int64(29)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        keys = keys.astype(np.int64)
        at = self._hash(keys)
        got = self.slots[at]
        out = np.where(got == keys, self.rows[at], -1)
        left = np.flatnonzero((got != keys) & (got != -1))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            got = self.slots[at[left]]
            hit = got == keys[left]
            out[left[hit]] = self.rows[at[left[hit]]]
            left = left[~hit & (got != -1)]
        return out


class Model:
    """Frozen context trees of all languages. ``counts``: per language (four-byte numbers, counts)."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        k = len(self.languages)
        keys = {4: _union([g for g, _ in counts.values()], 0), 3: None}
        keys[3] = np.unique(np.concatenate([keys[4] >> 8, keys[4] & 0xFFFFFF]))
        self.four, self.three = Table(keys[4]), Table(keys[3])
        self.cost4 = np.zeros((len(keys[4]), k), np.float32)
        self.cost3 = np.zeros((len(keys[3]), k), np.float32)
        self.escape3 = np.zeros((len(keys[3]), k), np.float32)
        self.cost2 = np.zeros((1 << 16, k), np.float32)
        self.escape2 = np.zeros((1 << 16, k), np.float32)
        for j, name in enumerate(self.languages):
            gram, n = counts[name]
            gram, n = gram.astype(np.int64), n.astype(np.int64)
            n1 = np.bincount(gram & 0xFF, weights=n, minlength=256)
            cost, total, kinds = np.full(256, 8.0), n1.sum(), (n1 > 0).sum()
            cost = np.where(n1 > 0, -np.log2(np.maximum(n1, 1) / (total + kinds)), cost - np.log2(kinds / (total + kinds)))
            n2 = np.bincount(gram & 0xFFFF, weights=n, minlength=1 << 16).reshape(256, 256)
            escape, cost = _shorter(n2, np.broadcast_to(cost, (256, 256)))
            self.cost2[:, j] = cost.reshape(-1)
            three = gram & 0xFFFFFF
            n3 = np.bincount(three, weights=n, minlength=1 << 24).reshape(1 << 16, 256)
            total, kinds = n3.sum(axis=1), (n3 > 0).sum(axis=1)
            self.escape2[:, j] = np.where(kinds > 0, -np.log2(np.maximum(kinds, 1) / np.maximum(total + kinds, 1)), 0)
            self.cost3[:, j] = self._cost(n3.reshape(-1)[keys[3]], keys[3], 8, total, kinds, self.escape2[:, j], self.cost2[:, j][keys[3] & 0xFFFF])
            del n3
            context = np.searchsorted(keys[3], gram >> 8)
            total = np.bincount(context, weights=n, minlength=len(keys[3]))
            kinds = np.bincount(context, minlength=len(keys[3]))
            self.escape3[:, j] = np.where(kinds > 0, -np.log2(np.maximum(kinds, 1) / np.maximum(total + kinds, 1)), 0)
            n4 = np.zeros(len(keys[4]))
            n4[np.searchsorted(keys[4], gram)] = n
            context = np.searchsorted(keys[3], keys[4] >> 8)
            seen = n4 > 0
            below = self.escape3[context, j] + self.cost3[np.searchsorted(keys[3], keys[4] & 0xFFFFFF), j]
            self.cost4[:, j] = np.where(seen, -np.log2(np.maximum(n4, 1) / np.maximum(total + kinds, 1)[context]), below)

    @staticmethod
    def _cost(n, keys, shift, total, kinds, escape, shorter):
        context = keys >> shift
        return np.where(n > 0, -np.log2(np.maximum(n, 1) / np.maximum(total + kinds, 1)[context]), escape[context] + shorter)

    def costs(self, gram: np.ndarray) -> np.ndarray:
        """Bits of each byte in each language."""
        row = self.four.find(gram)
        out = self.cost4[np.maximum(row, 0)] if len(self.cost4) else np.zeros((len(gram), len(self.languages)), np.float32)
        miss = np.flatnonzero(row < 0)
        if len(miss):
            g = gram[miss].astype(np.int64)
            context, tail = self.three.find(g >> 8), self.three.find(g & 0xFFFFFF)
            low = np.where((tail >= 0)[:, None], self.cost3[np.maximum(tail, 0)], self.escape2[(g >> 8) & 0xFFFF] + self.cost2[g & 0xFFFF])
            out[miss] = low + np.where((context >= 0)[:, None], self.escape3[np.maximum(context, 0)], 0)
        return out

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Code length in bits of each whole text in each language."""
        parts = [PAD + _bytes(t) for t in texts]
        data = np.frombuffer(b"".join(parts), np.uint8)
        size = np.array([len(p) for p in parts], np.int64)
        begin = np.cumsum(size) - size
        out = np.zeros((len(texts), len(self.languages)))
        for a in range(0, len(data) - ORDER, SLICE):
            b = min(len(data) - ORDER, a + SLICE)  # byte a + 3 is the first that is coded
            bits = self.costs(grams(data[a : b + ORDER]))
            owner = np.searchsorted(begin, np.arange(a, b) + ORDER, "right") - 1
            coded = np.arange(a, b) + ORDER - begin[owner] >= ORDER
            bits[~coded] = 0
            first, last = owner[0], owner[-1]
            cuts = np.searchsorted(owner, np.arange(first, last + 1))
            out[first : last + 1] += np.add.reduceat(bits, cuts, axis=0, dtype=np.float64)
        return out


class Entries:
    """Bits by number and language, only where there are some."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        """``parts``: for each language (numbers, bits)."""
        keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.table = Table(keys[new])
        self.start = np.append(new, len(keys)).astype(np.int32)
        self.language = np.repeat(np.arange(len(parts)), [len(k) for k, _ in parts]).astype(np.uint8)[order]
        self.bits = np.concatenate([b for _, b in parts]).astype(np.float32)[order] if parts else np.zeros(0, np.float32)

    def put(self, out: np.ndarray, keys: np.ndarray, add: bool = False) -> None:
        """Into rows of ``out``, one for each key: replaces, or adds to, what stands there."""
        row = self.table.find(keys)
        hit = np.flatnonzero(row >= 0)
        start = self.start[row[hit]]
        many = self.start[row[hit] + 1] - start
        at = np.repeat(hit, many)
        which = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start, many)
        if add:
            out[at, self.language[which]] += self.bits[which]
        else:
            out[at, self.language[which]] = self.bits[which]


def _escape(total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    return np.where(kinds > 0, -np.log2(np.maximum(kinds, 1) / np.maximum(total + kinds, 1)), 0)


class SparseModel(Model):
    """The same trees by what was seen. ``two``: by language the counts of two-byte numbers, totals and followers of
    two-byte contexts (65,536 each); ``four``, ``three``, ``escapes``: by language (numbers, bits)."""

    def __init__(self, languages: list[str], two: list[tuple], four: list[tuple], three: list[tuple], escapes: list[tuple]):
        self.languages = languages
        self.cost2 = np.zeros((1 << 16, len(languages)), np.float32)
        self.escape2 = np.zeros((1 << 16, len(languages)), np.float32)
        for j, (n2, total, kinds) in enumerate(two):
            n2 = n2.reshape(256, 256)
            n1 = n2.sum(axis=0)
            all_, different = n1.sum(), (n1 > 0).sum()
            cost = np.where(n1 > 0, -np.log2(np.maximum(n1, 1) / (all_ + different)), 8 - np.log2(different / (all_ + different)))
            self.cost2[:, j] = _shorter(n2, np.broadcast_to(cost, (256, 256)))[1].reshape(-1)
            self.escape2[:, j] = _escape(total, kinds)
        self.four, self.three, self.escapes = Entries(four), Entries(three), Entries(escapes)

    @classmethod
    def of(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> SparseModel:
        """From all four-byte counts, uncut."""
        languages = sorted(counts)
        two, four, three, escapes = [], [], [], []
        for name in languages:
            gram, n = (x.astype(np.int64) for x in counts[name])
            g3, n3 = _summed(gram & 0xFFFFFF, n)
            total2, kinds2 = (np.bincount(g3 >> 8, weights=w, minlength=1 << 16) for w in (n3, np.ones(len(g3))))
            two.append((np.bincount(g3 & 0xFFFF, weights=n3, minlength=1 << 16), total2, kinds2))
            three.append((g3, -np.log2(n3 / (total2 + kinds2)[g3 >> 8])))
            context, total = _summed(gram >> 8, n)
            at = np.searchsorted(context, gram >> 8)
            kinds = np.bincount(at, minlength=len(context))
            escapes.append((context, _escape(total, kinds)))
            four.append((gram, -np.log2(n / (total + kinds)[at])))
        return cls(languages, two, four, three, escapes)

    def costs(self, gram: np.ndarray) -> np.ndarray:
        out = np.empty((len(gram), len(self.languages)), np.float32)
        step = max(1024, (4 * SLICE) // max(4, len(self.languages)))  # the expanded entries of a step stay small
        for a in range(0, len(gram), step):
            g = gram[a : a + step].astype(np.int64)
            part = self.escape2[(g >> 8) & 0xFFFF] + self.cost2[g & 0xFFFF]
            self.three.put(part, g & 0xFFFFFF)
            self.escapes.put(part, g >> 8, add=True)
            self.four.put(part, g)
            out[a : a + step] = part
        return out

    def nbytes(self) -> int:
        tables = [x for e in (self.four, self.three, self.escapes) for x in (e.start, e.language, e.bits, e.table.slots, e.table.rows)]
        return sum(x.nbytes for x in [self.cost2, self.escape2, *tables])


def model_of(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The smaller form where rows with all languages would be large."""
    keys4 = len(_union([g for g, _ in counts.values()], 0))
    keys3 = min(2 * keys4, 1 << 24)
    return Model(counts) if (keys4 + 2 * keys3) * 4 * len(counts) <= DENSE_BYTES else SparseModel.of(counts)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out, back = np.unique(keys, return_inverse=True)
    return out, np.bincount(back, weights=n, minlength=len(out)).astype(np.int64)


def quota(sizes: list[int], most: int) -> int:
    """So many entries each language may keep that all together are at most ``most``."""
    left, many = most, len(sizes)
    for size in sorted(sizes):
        if size * many > left:
            return left // many
        left, many = left - size, many - 1
    return max(sizes, default=0)


def _union(arrays: list[np.ndarray], _: int) -> np.ndarray:
    return np.unique(np.concatenate([a.astype(np.int64) for a in arrays])) if arrays else np.zeros(0, np.int64)


def _shorter(n: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Escape bits of each context (row) and bits of each follower."""
    total, kinds = n.sum(axis=1, keepdims=True), (n > 0).sum(axis=1, keepdims=True)
    escape = np.where(kinds > 0, -np.log2(np.maximum(kinds, 1) / np.maximum(total + kinds, 1)), 0)
    return escape, np.where(n > 0, -np.log2(np.maximum(n, 1) / np.maximum(total + kinds, 1)), escape + cost)


def shares(have: dict[str, int], rows: int = ROWS) -> dict[str, float]:
    """The share of each language's texts to learn from; never 0."""
    if len(have) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    each = max(1, min(rows, MOST_ROWS // max(1, len(have))))
    return {name: min(1.0, each / n) for name, n in have.items()}


def count_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The different four-byte contexts of some texts and their counts; a text is counted in slices."""
    found = []
    for t in texts:
        data = np.frombuffer(PAD + _bytes(t), np.uint8)
        for a in range(0, max(1, len(data) - ORDER), SLICE):
            found.append(np.unique(grams(data[a : a + SLICE + ORDER]), return_counts=True))
    gram, n = (np.concatenate(x) for x in zip(*found, strict=True))
    gram, back = np.unique(gram, return_inverse=True)
    return gram, np.bincount(back, weights=n, minlength=len(gram)).astype(np.int64)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = ROWS, most_grams: int = MOST_GRAMS) -> Model:
    """Count the context trees of a sample of the labelled rows that are not held out."""
    labelled = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).where(F.col("i").isNotNull() & F.col("l").isNotNull() & F.col("t").isNotNull() & ~held_out(F.col("i")))
    have = {r["l"]: r["n"] for r in labelled.groupBy("l").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if not have:
        return Model({})
    share = F.lit(0.0)
    for name, part in shares(have, rows).items():
        share = F.when(F.col("l") == name, part).otherwise(share)
    sample = labelled.where(sampled([F.col("i"), F.col("t")], share)).select("l", "t").distinct()

    def count(batches):
        for part in batches:
            for name, group in part.groupby("l"):
                gram, n = count_grams(list(group["t"]))
                yield pd.DataFrame({"l": name, "g": gram.astype(np.int64), "n": n})

    names = sorted(have)
    number = F.lit(-1)
    for j, name in enumerate(names):
        number = F.when(F.col("l") == name, j).otherwise(number)
    counts = checkpointed(sample.mapInPandas(count, "l string, g long, n long").groupBy(number.alias("j"), "g").agg(F.sum("n").alias("n")))
    if counts.count() <= most_grams:
        found = counts.toPandas()  # numbers only
        return model_of({names[j]: (g["g"].to_numpy(), g["n"].to_numpy()) for j, g in found.groupby("j")})
    return _cut_model(names, counts, most_grams)


def _cut_model(names: list[str], counts: DataFrame, most: int) -> SparseModel:
    """Costs and escapes are made on Spark from all counts (j, g, n); only the most frequent ones come here."""
    bits = lambda part, whole: -F.log2(F.col(part) / F.col(whole))
    three = checkpointed(counts.groupBy("j", F.col("g").bitwiseAND(0xFFFFFF).alias("g")).agg(F.sum("n").alias("n")))
    above4 = counts.groupBy("j", F.shiftright("g", 8).alias("c")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    above4 = checkpointed(above4.withColumn("both", F.col("total") + F.col("kinds")))
    above3 = three.groupBy("j", F.shiftright("g", 8).alias("c")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    above3 = checkpointed(above3.withColumn("both", F.col("total") + F.col("kinds")))

    def most_frequent(rows: DataFrame, key: str, by: str) -> DataFrame:
        sizes = [r["count"] for r in rows.groupBy("j").count().collect()]
        if sum(sizes) <= most:
            return rows
        rank = F.row_number().over(Window.partitionBy("j").orderBy(F.desc(by), key))
        return rows.withColumn("rank", rank).where(F.col("rank") <= quota(sizes, most)).drop("rank")

    def arrays(rows: DataFrame) -> list[tuple]:
        by = {j: (g["k"].to_numpy(np.int64), g["bits"].to_numpy()) for j, g in rows.toPandas().groupby("j")}
        return [by.get(j, (np.zeros(0, np.int64), np.zeros(0))) for j in range(len(names))]

    def of(rows: DataFrame, above: DataFrame) -> list[tuple]:
        rows = most_frequent(rows, "g", "n").withColumn("c", F.shiftright("g", 8)).join(above, ["j", "c"])
        return arrays(rows.select("j", F.col("g").alias("k"), bits("n", "both").alias("bits")))

    def dense(rows: DataFrame, key: str, value: str) -> list[np.ndarray]:
        out = [np.zeros(1 << 16) for _ in names]
        for j, g in rows.select("j", key, value).toPandas().groupby("j"):  # 65,536 rows a language at most
            out[j][g[key].to_numpy(np.int64)] = g[value].to_numpy()
        return out

    n2 = three.groupBy("j", F.col("g").bitwiseAND(0xFFFF).alias("g")).agg(F.sum("n").alias("n"))
    two = list(zip(dense(n2, "g", "n"), dense(above3, "c", "total"), dense(above3, "c", "kinds"), strict=True))
    escapes = arrays(most_frequent(above4, "c", "total").select("j", F.col("c").alias("k"), bits("kinds", "both").alias("bits")))
    return SparseModel(names, two, of(counts, above4), of(three, above3), escapes)


def predict(text: Column, model: Model, spark) -> Column:
    """struct<lang, score, bits_per_byte> of each whole text."""
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang: string, score: double, bits_per_byte: double>")
    def say(texts: pd.Series, lettered: pd.Series) -> pd.DataFrame:
        m: Model = held.value
        at = np.flatnonzero(lettered.to_numpy(bool) & bool(m.languages))
        lang, score, rate = np.full(len(texts), "und", object), np.zeros(len(texts)), np.full(len(texts), np.nan)
        if len(at):
            mine = [texts.iloc[k] for k in at]
            bits = m.lengths(mine)
            best = bits.argmin(axis=1)
            least = bits[np.arange(len(at)), best]
            lang[at] = [m.languages[b] for b in best]
            score[at] = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
            rate[at] = least / np.array([max(1, len(_bytes(t))) for t in mine])
        return pd.DataFrame({"lang": lang, "score": score, "bits_per_byte": rate})

    return say(text, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and bits_per_byte (null for ``und``)."""
    (said,) = fresh(docs, "said")
    return (
        docs.withColumn(said, predict(F.col(text), model, docs.sparkSession))
        .withColumns({"lang_pred": F.col(f"{said}.lang"), "score": F.col(f"{said}.score"), "bits_per_byte": F.nanvl(f"{said}.bits_per_byte", F.lit(None).cast("double"))})
        .drop(said)
    )


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")
