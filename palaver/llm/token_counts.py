"""Operator 1: token counts by a compiled transducer.

The tokenizer becomes a deterministic finite-state transducer over characters. A state is what a
prefix of a text leaves open: for each place where a piece may still begin, the open part of that
piece, the last token before it, and its token count relative to the count of the whole prefix.
Pieces have a bounded length, so the states are finite. A transition carries the change of the token count. The
transducer is determinised on demand: a state is built when a text first reaches it.

A block of text is a map from states to (state, tokens). Beyond its first sure cut (a place that no
piece can lie across) the map is constant, so it is kept as the part before that cut, the tokens
after it and the last state. Such maps compose associatively; a text's blocks are combined in a tree.

The blocks of a text are mapped and composed in the task that has the text.

Null and empty texts have 0 tokens; repeated rows are counted each; other columns pass through, and
columns named n_bytes, n_tokens or over_limit are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, small_batches
from .pieces import MEMO_ENTRIES, SPACE, Pieces, loaded, model_bytes

#: Characters of a block; a longer text is cut into blocks whose maps are composed.
BLOCK = 1 << 16
#: States of the transducer before it is built anew, which bounds memory on endless random text.
STATES = 300_000


class Transducer:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.memo: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        start = (("", "", 0),)
        self.states = [start]
        self.numbers = {start: 0}
        self.next: list[dict[str, tuple[int, int]]] = [{}]

    def _step(self, state: int, char: str) -> tuple[int, int]:
        """Build the transition: which open part ends in a token here decides all."""
        p, old = self.pieces, self.states[state]
        grown = [(s + char, last, rel) for s, last, rel in old if s + char in p.begins]
        if not any(s and s + char in p.begins or s + char in p.ids for s, _, _ in old if s):
            old, grown = (("", "", 0),), [(char, "", 0)] if char in p.begins else []  # a sure cut
        for s, last, rel in old:
            token = s + char
            if (not s or token in p.ids) and p.neighbours(last, token):
                break
        else:
            raise AssertionError("no token ends here")  # a prefix always has an encoding
        delta = rel + p.width(token)
        new = (("", token, 0), *((s, last, r - delta) for s, last, r in grown))
        if len(self.states) > STATES:  # start anew from the state that is reached now
            self._reset()
            state = None
        if new not in self.numbers:
            self.numbers[new] = len(self.states)
            self.states.append(new)
            self.next.append({})
        out = (self.numbers[new], delta)
        if state is not None:
            self.next[state][char] = out
        return out

    def run(self, text: str, state: int = 0) -> tuple[int, int]:
        """The state after ``text`` and the tokens it added."""
        total, nxt = 0, self.next
        for char in text:
            t = nxt[state].get(char)
            if t is None:
                t, nxt = self._step(state, char), self.next
            state = t[0]
            total += t[1]
        return state, total

    def word(self, text: str) -> int:
        """Tokens of a part between two sure cuts."""
        n = self.run(text)[1]
        if len(text) <= 64:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            self.memo[text] = n
        return n

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        if len(text) > BLOCK:
            return long_text(self, SPACE + text.replace(" ", SPACE))
        memo, words, total = self.memo.get, self.pieces.words(text), 0
        for w in words:
            n = memo(w)
            total += self.word(w) if n is None else n
        return total


@dataclass(frozen=True)
class BlockMap:
    """What a block does to the state: ``head`` comes before its first sure cut; ``tokens`` and
    ``tail`` (the open part at its end) are None if it has no such cut."""

    head: str
    tokens: int | None = None
    tail: str | None = None


def block_map(machine: Transducer, block: str) -> BlockMap:
    """``block``'s first word may go on from the block before, its last word into the one after."""
    words = machine.pieces.split.findall(block)
    if len(words) < 2:
        return BlockMap(block)
    return BlockMap(words[0], sum(machine.memo.get(w) or machine.word(w) for w in words[1:-1]), words[-1])


def compose(machine: Transducer, a: BlockMap, b: BlockMap) -> BlockMap:
    """First ``a``, then ``b``. Associative."""
    if a.tokens is None:
        if b.tokens is None:
            return _between(machine, a.head + b.head)
        c = _between(machine, a.head + b.head)
        return BlockMap(c.head, b.tokens, b.tail) if c.tokens is None else BlockMap(c.head, c.tokens + machine.word(c.tail) + b.tokens, b.tail)
    c = _between(machine, a.tail + b.head)
    if c.tokens is None:
        return BlockMap(a.head, a.tokens, c.head) if b.tokens is None else BlockMap(a.head, a.tokens + machine.word(c.head) + b.tokens, b.tail)
    inner = a.tokens + machine.word(c.head) + c.tokens
    return BlockMap(a.head, inner, c.tail) if b.tokens is None else BlockMap(a.head, inner + machine.word(c.tail) + b.tokens, b.tail)


def _between(machine: Transducer, text: str) -> BlockMap:
    """The map of the short part where two blocks meet; a cut may fall just between them."""
    return block_map(machine, text)


def long_text(machine: Transducer, escaped: str, block: int = BLOCK) -> int:
    maps = [block_map(machine, escaped[k : k + block]) for k in range(0, len(escaped), block)]
    while len(maps) > 1:
        maps = [compose(machine, *maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
    m = maps[0]
    return machine.word(m.head) + (0 if m.tokens is None else m.tokens + machine.word(m.tail))


_machine: dict[int, Transducer] = {}


def machine_of(model: bytes) -> Transducer:
    pieces = loaded(model)
    if id(pieces) not in _machine:
        _machine.clear()
        _machine[id(pieces)] = Transducer(pieces)
    return _machine[id(pieces)]


def token_count(text: Column, model: bytes) -> Column:
    """Tokens of each whole text, as a column."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        machine = machine_of(model)
        return pd.Series([machine.text(t) for t in texts], dtype="int64")

    return count(text)


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit; no shuffle, one narrow pass."""
    small_batches(docs.sparkSession)
    return docs.withColumns({
        "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"),
        "n_tokens": token_count(F.col(text), model_bytes(model_path)),
    }).withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")
