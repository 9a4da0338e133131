"""The pieces of a SentencePiece BPE model, and the rule that says which pieces may be neighbours.

SentencePiece BPE joins, again and again, the adjacent pair whose union is the best-ranked piece
(leftmost on ties). A sequence of pieces is what it returns for a text exactly if each two
neighbours are what it returns for those two alone: a join across one border needs nothing outside
the two pieces beside it. Both the transducer and the suffix-array encoder rest on that rule.
"""

from __future__ import annotations

import re

SPACE = "▁"
#: Inside of a character class: ASCII letters and digits, Latin, Greek and Cyrillic letters.
LETTERS = "A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0370-\u052f"
#: Entries of the memo of neighbour tests and of word memos; a full memo is emptied, results stay.
MEMO_ENTRIES = 150_000


class Pieces:
    """Normal pieces by text, their rank (the lower, the earlier they are joined), and byte ids."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = sp.get_piece_size()
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.raw: list[bytes] = [b""] * self.size
        for i in range(self.size):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(text[3:5], 16)] = i
                self.raw[i] = bytes([int(text[3:5], 16)])
            elif sp.is_unknown(i):
                self.raw[i] = " ⁇ ".encode()
            elif not sp.is_control(i):
                self.ids[text] = i
                self.raw[i] = text.encode()
        self.rank = {t: -sp.get_score(i) for t, i in self.ids.items()}
        if b"".join(self.raw[i] for i in sp.encode(" a  \ufb01\u3000b ")).decode() != "▁▁a▁▁\ufb01\u3000b▁":
            raise ValueError("only models without text normalisation are supported")
        self.longest = max(map(len, self.ids))
        #: Proper beginnings of pieces, the empty one included.
        self.begins = {t[:k] for t in self.ids for k in range(len(t))}
        self.split = self._splitter()
        self._pairs: dict[tuple[str, str], bool] = {}

    def _splitter(self) -> re.Pattern:
        """Cuts that no piece can lie across, each known from the two characters beside it: before a
        run of spaces, around line ends, and after a letter or digit before anything else. Holds for
        a model only if none of its pieces has such a place inside; else a text is one part."""
        crossing = re.compile(f"[^{SPACE}]{SPACE}|\n|[{LETTERS}][^{LETTERS}]")
        if any(crossing.search(t) for t in self.ids):
            return re.compile(r"(?s).+")
        rest = f"[^{LETTERS}{SPACE}\n]"
        return re.compile(f"{SPACE}*{rest}*[{LETTERS}]+|{SPACE}*{rest}+|{SPACE}+|\n+")

    def words(self, text: str) -> list[str]:
        """The text as the model sees it, cut into parts that are encoded independently."""
        return self.split.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def joined(self, text: str) -> list[str]:
        """Plain BPE of a short string."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def neighbours(self, left: str, right: str) -> bool:
        """May ``right`` follow ``left``? With an empty ``left``: may a text begin with ``right``?"""
        key = (left, right)
        ok = self._pairs.get(key)
        if ok is None:
            if len(self._pairs) >= MEMO_ENTRIES:
                self._pairs.clear()
            ok = self._pairs[key] = self.joined(left + right) == ([left, right] if left else [right])
        return ok

    def width(self, part: str) -> int:
        """Tokens of a part: one for a piece, one for each byte of a character without a piece."""
        return 1 if part in self.ids else len(part.encode())


_loaded: dict[int, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    """The pieces of a model file, once for each Python worker."""
    key = hash(model)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(model)
    return _loaded[key]


def model_bytes(path: str, most: int = 16 << 20) -> bytes:
    """The model file, which goes to the tasks with their code; ``most`` bounds its size."""
    with open(path, "rb") as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise ValueError(f"model file over {most} bytes")
    return data
