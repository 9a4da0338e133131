"""Operator 6: SentencePiece encoding and decoding by suffix-array matching.

The distinct parts of a batch's texts (cut where no piece can lie across) are laid end to end and
indexed by a suffix array. Every piece of the vocabulary is binary-searched for its range of
occurrences; each occurrence is an edge from its first to behind its last character. Edges are
sorted by position and relaxed front to back: an edge is taken if its piece may follow the one that
ends where it starts. The model is BPE, so exactly one edge into each position passes; following
them back gives the ids that the public library gives. Parts met before are kept in a bounded memo. Short
parts are relaxed side by side; one of more than ``LONG`` characters (a text without a sure cut) is
indexed piece by piece and its edges are walked one after another.

Null texts give null ids; empty texts none; repeated rows are encoded each; very long texts whole; other
columns pass, and columns named n_tokens, token_ids or round_trip are replaced; an empty table gives no rows.
Decoding inverts encoding for every text without a literal U+2581, which the model reads as a space.
"""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, read, small_batches
from .pieces import MEMO_ENTRIES, SPACE, Pieces, loaded, model_bytes

#: Characters of distinct parts indexed at once, which bounds the arrays of a batch.
INDEX_CHARS = 1 << 16
#: Characters of a part from which on it is encoded by itself.
LONG = 2000
_CACHE_BITS = 20
_ID_BITS = 21


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the ``depth`` codes from there on, at least, by prefix doubling from three
    codes on. Code 0 ends parts."""

    def ahead(values: np.ndarray, step: int) -> np.ndarray:
        out = np.zeros_like(values)
        out[:-step] = values[step:]
        return out

    wide = codes.astype(np.int64)
    key, step = (wide << 42) | (ahead(wide, 1) << 21) | ahead(wide, 2), 3
    while step < depth:
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = rank * (len(rank) + 2) + ahead(rank + 1, step)
        step *= 2
    return np.argsort(key)


def occurrence_ranges(codes: np.ndarray, order: np.ndarray, needles: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each needle (a row of codes) the range of ``order`` whose suffixes begin with it."""
    low = np.zeros(len(needles), np.int64)
    high = np.full(len(needles), len(order), np.int64)
    padded = np.concatenate([codes, np.zeros(needles.shape[1], codes.dtype)])
    for d in range(needles.shape[1]):
        live = np.flatnonzero((lengths > d) & (low < high))
        if not len(live):
            break
        want = needles[live, d]
        ends = []
        for upper in (False, True):
            a, b = low[live].copy(), high[live].copy()
            while True:
                open_ = a < b
                if not open_.any():
                    break
                mid = np.where(open_, (a + b) >> 1, 0)
                got = padded[order[mid] + d]
                right = open_ & ((got <= want) if upper else (got < want))
                a = np.where(right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)
            ends.append(a)
        low[live], high[live] = ends
    return low, high


class Codec:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.names = [""] * pieces.size
        for text, i in pieces.ids.items():
            self.names[i] = text
        self.start = pieces.size + 0x110000  # the id that stands for the beginning of a part
        texts = list(pieces.ids)
        self.needle_ids = np.array([pieces.ids[t] for t in texts], np.int64)
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.needles = np.zeros((len(texts), pieces.longest), np.uint32)
        for k, t in enumerate(texts):
            self.needles[k, : len(t)] = [ord(c) + 1 for c in t]
        self.piece_length = np.zeros(pieces.size, np.int64)
        self.piece_length[self.needle_ids] = self.lengths
        self.keys = np.full(1 << _CACHE_BITS, -1, np.int64)
        self.oks = np.zeros(1 << _CACHE_BITS, bool)
        self.memo: dict[str, bytes] = {}
        self.single = np.zeros(0x110000, bool)
        self.single[[ord(t) for t in texts if len(t) == 1]] = True
        self.raw = [b.replace(SPACE.encode(), b" ") for b in pieces.raw]

    def _name(self, token: int) -> str:
        if token == self.start:
            return ""
        return self.names[token] if token < self.pieces.size else chr(token - self.pieces.size)

    def _may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The neighbour rule for arrays of tokens, through a direct-mapped cache."""
        key = (left << _ID_BITS) | right
        slot = ((key * 0x9E3779B97F4A7C1) >> 24) & ((1 << _CACHE_BITS) - 1)
        ok, miss = self.oks[slot], np.flatnonzero(self.keys[slot] != key)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            mask = (1 << _ID_BITS) - 1
            said = np.array([self.pieces.neighbours(self._name(k >> _ID_BITS), self._name(k & mask)) for k in new.tolist()], bool)
            ok[miss] = said[back]
            at = ((new * 0x9E3779B97F4A7C1) >> 24) & ((1 << _CACHE_BITS) - 1)
            self.keys[at] = new
            self.oks[at] = said
            wrong = self.keys[at] != new  # two new keys for one slot: the last one stays, with its own answer
            if wrong.any():
                last = dict(zip(new.tolist(), said.tolist(), strict=True))
                self.oks[at] = [last[k] for k in self.keys[at].tolist()]
        return ok

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first position, token, length) of every occurrence of a piece, and of lone characters."""
        order = suffix_array(codes, self.pieces.longest)
        low, high = occurrence_ranges(codes, order, self.needles, self.lengths)
        n = high - low
        total = int(n.sum())
        which = np.repeat(np.arange(len(n)), n)
        at = order[np.arange(total) - np.repeat(np.cumsum(n) - n, n) + low[which]]
        lone = np.flatnonzero((codes > 0) & ~self.single[np.maximum(codes, 1) - 1])
        return (
            np.concatenate([at, lone]),
            np.concatenate([self.needle_ids[which], codes[lone].astype(np.int64) - 1 + self.pieces.size]),
            np.concatenate([self.lengths[which], np.ones(len(lone), np.int64)]),
        )

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of each part, as bytes of int32."""
        long = [k for k, w in enumerate(parts) if len(w) > LONG]
        if long:
            out = iter(self.encode_parts([w for w in parts if len(w) <= LONG]))
            return [self._encode_long(w) if len(w) > LONG else next(out) for w in parts]
        if not parts:
            return []
        size = np.array([len(w) for w in parts], np.int64)
        begin = np.cumsum(size + 1) - size - 1
        codes = np.frombuffer("\0".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint32) + np.uint32(1)
        codes[begin + size] = 0
        first, token, length = self._edges(codes)
        offset = np.arange(len(codes)) - np.repeat(begin, size + 1)
        reach = offset[first] + length
        by_end = np.argsort(reach.astype(np.uint16) if reach.max(initial=0) < 1 << 16 else reach, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(reach))])
        before = np.zeros(len(codes), np.int64)  # the token that ends at a position
        before[begin] = self.start
        for k in range(1, len(cuts) - 1):
            e = by_end[cuts[k] : cuts[k + 1]]
            e = e[self._may_follow(before[first[e]], token[e])]
            before[first[e] + length[e]] = token[e]
        # Back from the ends, all parts at once.
        part, at, found_part, found = np.arange(len(parts)), begin + size, [], []
        while len(part):
            t = before[at]
            found_part.append(part)
            found.append(t)
            at = at - np.where(t < self.pieces.size, self.piece_length[np.minimum(t, self.pieces.size - 1)], 1)
            more = at > begin[part]
            part, at = part[more], at[more]
        owner, ids = np.concatenate(found_part[::-1]), np.concatenate(found[::-1])
        ids = ids[np.argsort(owner, kind="stable")]
        flat, ends = ids.astype(np.int32).tobytes(), np.cumsum(np.bincount(owner, minlength=len(parts))) * 4
        out = [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        for k in set(np.concatenate(found_part)[np.concatenate(found) >= self.pieces.size].tolist()):
            out[k] = self._bytes_for_lone(np.frombuffer(out[k], np.int32))
        return out

    def _encode_long(self, part: str) -> bytes:
        """Ids of one part of any length: edges in the order of their first characters, each taken if its piece
        may follow the one that ends there."""
        size, may, names = self.pieces.size, self.pieces.neighbours, self.names
        before = array("q", bytes(8 * (len(part) + 1)))  # the token that ends at a place
        before[0] = self.start
        for a in range(0, len(part), INDEX_CHARS):
            window = part[a : a + INDEX_CHARS + self.pieces.longest]
            codes = np.append(np.frombuffer(window.encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1), np.uint32(0))
            first, token, length = self._edges(codes)
            mine = np.flatnonzero(first < INDEX_CHARS)
            mine = mine[np.argsort(first[mine], kind="stable")]
            for at, t, n in zip((first[mine] + a).tolist(), token[mine].tolist(), length[mine].tolist(), strict=True):
                old = before[at]
                if may("" if old == self.start else names[old] if old < size else chr(old - size), names[t] if t < size else chr(t - size)):
                    before[at + n] = t
        ids, at = [], len(part)
        while at > 0:
            ids.append(t := before[at])
            at -= len(names[t]) if t < size else 1
        out = np.array(ids[::-1], np.int64)
        return out.astype(np.int32).tobytes() if (out < size).all() else self._bytes_for_lone(out)

    def _bytes_for_lone(self, ids: np.ndarray) -> bytes:
        """Characters without a piece become the pieces of their bytes."""
        out: list[int] = []
        for i in ids.tolist():
            out += [i] if i < self.pieces.size else [self.pieces.byte_ids[b] for b in chr(i - self.pieces.size).encode("utf-8", "surrogatepass")]
        return np.array(out, np.int32).tobytes()

    def _learn(self, parts: list[str]) -> None:
        group, chars = [], 0
        for w in [*parts, None]:
            if w is None or chars > INDEX_CHARS:
                self.memo.update(zip(group, self.encode_parts(group), strict=True))
                group, chars = [], 0
            if w is not None:
                group.append(w)
                chars += min(len(w), LONG) + 1

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        if len(self.memo) >= MEMO_ENTRIES:
            self.memo.clear()
        words = [self.pieces.words(t) if t is not None else None for t in texts]
        new: set[str] = set()
        for ws in words:
            new.update(ws or ())
        new.difference_update(self.memo)
        self._learn(sorted(new))
        get = self.memo.__getitem__
        out = [None if ws is None else np.frombuffer(b"".join(map(get, ws)), np.int32) for ws in words]
        for w in new:
            if len(w) > LONG:  # too large to be kept
                del self.memo[w]
        return out

    def decode(self, ids) -> str:
        """The text of ids; broken byte runs give U+FFFD. The space put before a text is removed."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_codec: dict[int, Codec] = {}


def codec_of(model: bytes) -> Codec:
    pieces = loaded(model)
    if id(pieces) not in _codec:
        _codec.clear()
        _codec[id(pieces)] = Codec(pieces)
    return _codec[id(pieces)]


#: Characters of the texts encoded together, which bounds by how much the memo can outgrow its limit.
BATCH_CHARS = 1 << 19


def in_groups(texts: list[str | None], most: int = BATCH_CHARS):
    group, chars = [], 0
    for t in texts:
        group.append(t)
        chars += len(t or "")
        if chars > most:
            yield group
            group, chars = [], 0
    yield group


def encoded(text: Column, model: bytes) -> Column:
    """Token ids of each whole text, as a column of array<int>."""

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        codec = codec_of(model)
        return pd.Series([ids for group in in_groups(list(texts)) for ids in codec.encode(group)], dtype=object)

    return encode(text)


def decoded(ids: Column, model: bytes) -> Column:
    """The text of token ids, as a column."""

    @F.pandas_udf("string")
    def decode(column: pd.Series) -> pd.Series:
        codec = codec_of(model)
        return pd.Series([None if x is None else codec.decode(x.tolist()) for x in column], dtype=object)

    return decode(ids)


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", check: bool = True) -> DataFrame:
    """``docs`` with n_tokens, token_ids and, if ``check``, round_trip: do the ids give the text back
    (U+2581 read as a space)? One narrow pass, no shuffle."""
    small_batches(docs.sparkSession)
    model = model_bytes(model_path)
    (pair,) = fresh(docs, "coded")

    @F.pandas_udf("struct<ids: array<int>, same: boolean>")
    def code(texts: pd.Series) -> pd.DataFrame:
        codec, ids, same = codec_of(model), [], []
        for group in in_groups(list(texts)):
            for t, x in zip(group, codec.encode(group), strict=True):
                ids.append(x)
                same.append(None if x is None else codec.decode(x.tolist()) == t.replace(SPACE, " ") if check else None)
        return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "same": pd.Series(same, dtype=object)})

    out = docs.withColumn(pair, code(F.col(text)))
    added = {"n_tokens": F.coalesce(F.size(f"{pair}.ids"), F.lit(0)).cast("long"), "token_ids": F.col(f"{pair}.ids")}
    if check:
        added["round_trip"] = F.col(f"{pair}.same")
    return out.withColumns(added).withColumn("n_tokens", F.greatest("n_tokens", F.lit(0))).drop(pair)


def op6_sentencepiece_codec(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, round_trip of every document."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")
