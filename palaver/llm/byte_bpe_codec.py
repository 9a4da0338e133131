"""Operator 11: byte-level BPE encoding and decoding without a regular expression.

A batch's texts become one array of code points, and each code point a class (letter, number, space,
other white space, apostrophe, other). What the pattern needs to look ahead for (a contraction's letters,
whether white space goes on) is read from shifted arrays and folded into the class: the result is a
string over nine symbols, on which pre-tokens are found by an automaton of nine states. Its transition
functions form a small monoid. Symbols are mapped to elements of it and composed by an associative
scan: inside of all blocks side by side, then over the blocks' totals by doubling, which gives the state
before each code point and with it every boundary at once. The slices between boundaries are made
distinct per batch, the distinct ones merged pair by pair through a bounded memo, and the ids dealt
back to the slices by array gathers. Each token keeps the offset behind its last byte; decoding places
the tokens' bytes by those.

Letters and numbers are those of the tokenizer library's own Unicode version, asked of it once by each
worker. Null texts give null ids, empty texts none; repeated rows are encoded each; texts of any length
are encoded whole (a long one window by window, the automaton's state carried on); other columns pass,
columns named as the added ones are replaced, and an empty table gives no rows. Decoding gives the
bytes of any list of ids; null ids give null.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, read, small_batches
from .pieces import MEMO_ENTRIES, model_bytes

# The pattern whose matches are the pre-tokens, the letters that follow an apostrophe in it,
# and the code points that \s matches.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ONE_LETTER = "stmd"
TWO_LETTERS = ("re", "ve", "ll")
WHITE_SPACE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

#: Classes of code points; END stands behind each text.
LETTER, NUMBER, OTHER, SPACE, WHITE, APOSTROPHE, END = range(7)
END_CODE = 0x110000
#: Symbols: the first three classes as they are; apostrophes before one and two letters of a contraction;
#: white space that more of it (or the end) follows; the last of a run before something else; the end.
S_ONE, S_TWO, S_MORE, S_LAST_SPACE, S_LAST, S_END = range(3, 9)
#: States: nothing before; in letters, numbers, others, white space; a space that the next token takes;
#: a token that is over; one or two letters of a contraction to come.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, PREFIX, OVER, ONE_MORE, TWO_MORE = range(9)
STATES = 9
#: Code points that are looked at together.
WINDOW = 1 << 21
#: Code points of a scan block.
BLOCK = 512
#: Bytes of a slice up to which its merges are found by looking through all pairs, and up to which it is kept in the memo.
SHORT, KEPT = 48, 256


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, is there a boundary before the symbol) by state and symbol."""
    follows, cut = np.zeros((STATES, 9), np.uint8), np.ones((STATES, 9), bool)
    runs = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}
    for state in range(STATES):
        for symbol, run in runs.items():
            follows[state, symbol], cut[state, symbol] = run, state not in (run, PREFIX)
        for symbol, left in ((S_ONE, ONE_MORE), (S_TWO, TWO_MORE)):  # a contraction only where a token begins
            inside = state in (IN_OTHERS, PREFIX)
            follows[state, symbol], cut[state, symbol] = IN_OTHERS if inside else left, not inside
        follows[state, S_MORE], cut[state, S_MORE] = IN_WHITE, state != IN_WHITE
        follows[state, S_LAST_SPACE], follows[state, S_LAST], follows[state, S_END] = PREFIX, OVER, START
    for state, then in ((TWO_MORE, ONE_MORE), (ONE_MORE, OVER)):
        follows[state, LETTER], cut[state, LETTER] = then, False
    return follows, cut


def _monoid(follows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that compositions of the symbols' functions give: their values by state, the element of
    each symbol, and the flat table of compositions (first, then second). Element 0 is the identity."""
    generators = [tuple(int(x) for x in follows[:, s]) for s in range(follows.shape[1])]
    known = {tuple(range(STATES)): 0}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in generators:
            if (h := tuple(g[x] for x in f)) not in known:
                known[h] = len(known)
                todo.append(h)
    values = np.array(list(known), np.uint8)
    table = np.array([[known[tuple(g[f].tolist())] for g in values] for f in values], np.uint16)
    return values, np.array([known[g] for g in generators], np.uint16), table.ravel()


FOLLOWS, CUT = _automaton()
VALUES, ELEMENT, COMPOSED = _monoid(FOLLOWS)


def states(symbols: np.ndarray, first: int = START) -> np.ndarray:
    """The automaton's state behind each symbol, if it begins in ``first``: an associative scan."""
    n, many = len(symbols), len(VALUES)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint16)
    padded[:n] = ELEMENT[symbols]
    scanned = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    for k in range(1, BLOCK):  # all blocks side by side
        scanned[k] = COMPOSED[scanned[k - 1].astype(np.int32) * many + scanned[k]]
    total, step = scanned[-1].copy(), 1
    while step < blocks:
        total[step:] = COMPOSED[total[:-step].astype(np.int32) * many + total[step:]]
        step *= 2
    enter = np.concatenate([[first], VALUES[total[:-1], first]]).astype(np.uint8)
    return VALUES[scanned, enter].T.ravel()[:n]


def symbols_of(codes: np.ndarray, classes: np.ndarray, n: int) -> np.ndarray:
    """Symbols of the first ``n`` code points; up to three more are there to be looked at."""
    ahead = np.concatenate([codes, np.full(max(0, n + 2 - len(codes)), END_CODE, codes.dtype)])
    kind = classes[ahead[: n + 1]]
    out = np.array([LETTER, NUMBER, OTHER, S_LAST_SPACE, S_LAST, OTHER, S_END], np.uint8)[kind[:n]]
    white = (kind == SPACE) | (kind == WHITE)
    out[white[:n] & (white[1:] | (kind[1:] == END))] = S_MORE
    at = np.flatnonzero(kind[:n] == APOSTROPHE)
    if len(at):
        one, two = ahead[at + 1], ahead[at + 2]
        out[at[np.isin(one, [ord(c) for c in ONE_LETTER])]] = S_ONE
        out[at[np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in TWO_LETTERS])]] = S_TWO
    return out


def letter_classes(pattern: str = PATTERN) -> np.ndarray:
    """Classes of all code points, as the tokenizer library sees them: a token list in which an ASCII
    character merges with the first byte of whatever shares its match tells letters, numbers and others."""
    import tiktoken

    classes = np.full(END_CODE + 1, WHITE, np.uint8)
    codes = np.array([c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000], np.uint32)
    size = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    singles = {bytes([b]): b for b in range(256)}
    for beside, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
        pairs = {beside.encode() + bytes([b]): 256 + b for b in range(256)}
        probe = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=singles | pairs, special_tokens={})
        for a in range(0, len(codes), 1 << 14):
            part, width = codes[a : a + (1 << 14)], size[a : a + (1 << 14)] + 1
            ids = np.array(probe.encode_ordinary(beside + beside.join(map(chr, part.tolist()))))
            first = np.zeros(int(width.sum()) + 1, np.int32)
            begin = np.cumsum(1 + (ids >= 256)) - 1 - (ids >= 256)
            first[begin] = ids
            classes[part[first[np.cumsum(width) - width] >= 256]] = kind
    ascii_ = np.arange(0x80)
    classes[ascii_] = OTHER
    classes[[c for c in ascii_ if chr(c).isalpha()]] = LETTER
    classes[[c for c in ascii_ if chr(c).isdigit()]] = NUMBER
    classes[list(WHITE_SPACE)] = WHITE
    classes[[ord(" "), ord("'"), END_CODE]] = SPACE, APOSTROPHE, END
    return classes


class Codec:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.classes = ranks, letter_classes()
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte has no token")
        self.memo: dict[bytes, list[int]] = {}
        size = max(ranks.values()) + 1
        raw = [b""] * size
        for token, i in ranks.items():
            raw[i] = token
        self.raw = pa.array(raw, pa.binary())
        self.length = np.array([len(x) for x in raw], np.int64)

    def boundaries(self, codes: Iterator[np.ndarray]) -> np.ndarray:
        """Where slices begin in the code points of several texts, each closed by END_CODE, which begins a
        slice, too. ``codes``: consecutive parts; a part's last two are given again by the next one."""
        found, state, at = [], START, 0
        part = next(codes, None)
        while part is not None:
            following = next(codes, None)
            n = len(part) if following is None else len(part) - 2
            symbols = symbols_of(part, self.classes, n)
            after = states(symbols, state)
            before = np.concatenate([[state], after[:-1]]).astype(np.uint8)
            found.append(np.flatnonzero(CUT[before, symbols]) + at)
            state, at, part = int(after[-1]), at + n, following
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def slices(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets where slices of the texts begin in their data, with the end of the last one; and, for
        each text, its first slice, with the number of all."""
        starts, firsts, at, many = [], [], 0, 0
        for group in _groups(texts):
            sizes = []

            def parts(group=group, sizes=sizes) -> Iterator[np.ndarray]:
                for part, fresh_ in _windows(group):
                    kept = part[:fresh_]
                    width = 1 + (kept >= 0x80).astype(np.int8) + (kept >= 0x800) + (kept >= 0x10000)
                    width[kept == END_CODE] = 0
                    sizes.append(width)
                    yield part

            where = self.boundaries(parts())
            width = np.concatenate(sizes)
            behind = np.cumsum(width, dtype=np.int64)
            begin = behind - width
            end = width[where] == 0
            starts.append(begin[where[~end]] + at)
            # The slices before each text: those that begin before the end of the text before it.
            before = np.cumsum(~end)[end]
            firsts.append(np.concatenate([[0], before[:-1]]) + many)
            at, many = at + int(behind[-1]), many + int((~end).sum())
        return np.concatenate([*starts, [at]]).astype(np.int64), np.concatenate([*firsts, [many]]).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """For each text its token ids and, for each token, the offset behind its last byte."""
        texts = texts.cast(pa.large_string())
        null = np.asarray(texts.is_null())
        filled = texts.fill_null("")
        if not len(filled):
            return pa.array([], pa.list_(pa.int32())), pa.array([], pa.list_(pa.int32()))
        filled = pa.concat_arrays([filled])
        starts, firsts = self.slices(filled)
        base = int(np.frombuffer(filled.buffers()[1], np.int64)[filled.offset])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts + base), filled.buffers()[2]])
        distinct = words.dictionary_encode()
        which = np.asarray(distinct.indices)
        ids = [self.word(w) for w in distinct.dictionary.to_pylist()]
        many = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(many.sum()))
        begin = np.concatenate([[0], np.cumsum(many)])
        count = many[which]
        behind = np.cumsum(count)
        at = np.repeat(begin[which] - (behind - count), count) + np.arange(int(count.sum()))
        tokens = flat[at]
        token_behind = np.cumsum(self.length[tokens])
        cuts = np.concatenate([[0], behind])[firsts]  # tokens before each text
        text_begin = np.concatenate([[0], token_behind])[cuts[:-1]]
        ends = token_behind - np.repeat(text_begin, np.diff(cuts))
        offsets = pa.array(cuts.astype(np.int32), mask=np.append(null, False))
        return pa.ListArray.from_arrays(offsets, pa.array(tokens, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(ends.astype(np.int32), pa.int32()))

    def decode(self, ids: pa.Array, ends: pa.Array | None = None) -> pa.Array:
        """The bytes of each list of ids, placed by the offsets kept with them (else by the tokens' lengths)."""
        flat, many = ids.flatten(), np.asarray(ids.value_lengths().fill_null(0))
        if flat.null_count:
            raise ValueError("a token id is null")
        data = self.raw.take(flat)
        cuts = np.concatenate([[0], np.cumsum(many)])
        if ends is None:
            size = np.add.reduceat(np.append(self.length[np.asarray(flat)], 0), cuts[:-1]) * (many > 0) if len(many) else np.zeros(0)
        else:
            size = np.append(np.asarray(ends.flatten()), 0)[np.maximum(cuts[1:] - 1, 0)] * (many > 0)
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        base = int(np.frombuffer(data.buffers()[1], np.int32)[data.offset]) if len(data) else 0
        if offsets[-1] != int(self.length[np.asarray(flat)].sum()):
            raise ValueError("offsets are not those of the tokens")
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(many), [None, pa.py_buffer(offsets + base), data.buffers()[2] or pa.py_buffer(b"")])
        return pa.array(whole.to_pylist(), pa.binary(), mask=np.asarray(ids.is_null()))

    def word(self, word: bytes) -> list[int]:
        ids = self.memo.get(word)
        if ids is None:
            whole = self.ranks.get(word)
            ids = [whole] if whole is not None else self._merged(word) if len(word) <= SHORT else self._merged_long(word)
            if len(word) <= KEPT:
                if len(self.memo) >= MEMO_ENTRIES:
                    self.memo.clear()
                self.memo[word] = ids
        return ids

    def _merged(self, word: bytes) -> list[int]:
        """Merge the pair of the lowest rank, the first of equals, until no pair is a token."""
        ranks = self.ranks
        parts = [word[k : k + 1] for k in range(len(word))]
        pairs = [ranks.get(word[k : k + 2]) for k in range(len(word) - 1)]
        while True:
            best, at = None, -1
            for k, r in enumerate(pairs):
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1])

    def _merged_long(self, word: bytes) -> list[int]:
        """The same with a heap over a linked list, for slices of any length."""
        ranks, n = self.ranks, len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # by first byte of a part
        now = [ranks.get(word[k : k + 2], -1) for k in range(n)]  # rank of a part with the one behind it
        now[n - 1] = -1
        heap = [(r, k) for k, r in enumerate(now) if r >= 0]
        heapq.heapify(heap)

        def rank(k: int) -> int:
            return ranks.get(word[k : end[end[k]]], -1) if end[k] < n else -1

        while heap:
            r, k = heapq.heappop(heap)
            if now[k] != r:
                continue
            gone = end[k]
            end[k], now[gone] = end[gone], -1
            if end[k] < n:
                before[end[k]] = k
            for x in (k, before[k]):
                if x >= 0:
                    now[x] = new = rank(x)
                    if new >= 0:
                        heapq.heappush(heap, (new, x))
        out, k = [], 0
        while k < n:
            out.append(ranks[word[k : end[k]]])
            k = end[k]
        return out


def _groups(texts: pa.LargeStringArray) -> Iterator[list[str]]:
    """Consecutive texts of about WINDOW characters; a longer one is a group of its own."""
    group, size = [], 0
    for value in texts:
        text = value.as_py()
        if group and size + len(text) > WINDOW:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def _windows(group: list[str]) -> Iterator[tuple[np.ndarray, int]]:
    """Code points of the texts, each closed by END_CODE, in parts; two more follow in each but the last part."""
    close = END_CODE.to_bytes(4, "little")
    if len(group) > 1 or len(group[0]) <= WINDOW:
        data = b"".join(x for t in group for x in (t.encode("utf-32-le", "surrogatepass"), close))
        yield np.frombuffer(data, np.uint32), len(data) // 4
        return
    text = group[0]
    for a in range(0, len(text), WINDOW):
        last = a + WINDOW >= len(text)
        data = text[a : a + WINDOW + 2].encode("utf-32-le", "surrogatepass") + (close if a + WINDOW + 2 > len(text) else b"")
        codes = np.frombuffer(data, np.uint32)
        if last:
            yield codes, len(codes)
        else:
            codes = np.append(codes, np.full(WINDOW + 2 - len(codes), END_CODE, np.uint32)) if len(codes) < WINDOW + 2 else codes[: WINDOW + 2]
            yield codes, WINDOW


_loaded: dict[int, Codec] = {}


def ranks_of(table: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, table.splitlines()) if a}


def codec_of(table: bytes) -> Codec:
    """The codec of a rank table, once for each Python worker."""
    key = hash(table)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Codec(ranks_of(table))
    return _loaded[key]


def encoded(text: Column, table: bytes) -> Column:
    """ids and ends (the offset behind each token's last byte in the text's UTF-8), as a struct; null of null."""

    @F.arrow_udf("struct<ids: array<int>, ends: array<int>>")
    def encode(texts: pa.Array) -> pa.Array:
        ids, ends = codec_of(table).encode(texts)
        return pa.StructArray.from_arrays([ids, ends], ["ids", "ends"])

    return encode(text)


def decoded(ids: Column, table: bytes, ends: Column | None = None) -> Column:
    """The bytes of token ids, as a binary column."""

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        return codec_of(table).decode(ids)

    @F.arrow_udf("binary")
    def decode_by(ids: pa.Array, ends: pa.Array) -> pa.Array:
        return codec_of(table).decode(ids, ends)

    return decode(ids) if ends is None else decode_by(ids, ends)


def encode_documents(docs: DataFrame, ranks_path: str, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, token_ids and token_ends. One narrow pass, no shuffle."""
    small_batches(docs.sparkSession)
    (pair,) = fresh(docs, "coded")
    out = docs.withColumn(pair, encoded(F.col(text), model_bytes(ranks_path)))
    n = F.greatest(F.coalesce(F.size(f"{pair}.ids"), F.lit(0)), F.lit(0)).cast("long")
    return out.withColumns({"n_tokens": n, "token_ids": F.col(f"{pair}.ids"), "token_ends": F.col(f"{pair}.ends")}).drop(pair)


def decode_documents(coded: DataFrame, ranks_path: str) -> DataFrame:
    """``encode_documents``' rows with their bytes as ``decoded``."""
    return coded.withColumn("decoded", decoded(F.col("token_ids"), model_bytes(ranks_path), F.col("token_ends")))


def op11_byte_bpe_codec(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; a null text is an empty one."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = decode_documents(encode_documents(docs, path).drop("text"), path)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return coded.select("doc_id", "n_tokens", F.sha2(F.encode(ids, "UTF-8"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
