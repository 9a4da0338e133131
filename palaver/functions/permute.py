"""Masks by a permutation: strings of one shape are mapped onto strings of that shape, one to one.

A string's ASCII letters and digits may change, all else stays, and so do the kinds of characters that
occur (digits, small and capital letters; in UUIDs and commit hashes only hexadecimal ones). All strings
over these characters are numbers of so many digits to one base; a keyed Feistel network permutes them. One
step goes to the number's successor in the permuted order, and on until the shape is the same again, so
the strings of a shape form a single cycle: a step never stays, and no two strings step to the same one.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import combinations

# The shapes of ids whose letters are hexadecimal digits, and a beginning that stays.
HEXADECIMAL = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9a-fA-F]{40}")
CALL = "call_"

DIGITS, SMALL, CAPITAL = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROUNDS = 10
#: Numbers of an order that is written out; a network needs two halves.
TABLE = 4096


def shape(value: str) -> str:
    """What stays: kinds of characters, hexadecimal or not, and the layout, in which ``*`` may change."""
    head = CALL if value.startswith(CALL) and len(value) > len(CALL) else ""
    rest = value[len(head) :]
    kinds = "".join(k for k, chars in zip("dsc", (DIGITS, SMALL, CAPITAL), strict=True) if any(c in chars for c in rest))
    hexadecimal = "x" if not head and HEXADECIMAL.fullmatch(rest) else "a"
    return f"{hexadecimal}{kinds}:{head}" + re.sub(r"[0-9A-Za-z]", "*", rest.replace("\\", "\\\\").replace("*", "\\!"))


@lru_cache(maxsize=1024)
def alphabets(kind: str) -> tuple[str, ...]:
    wide = 6 if kind[0] == "x" else 26
    return tuple({"d": DIGITS, "s": SMALL[:wide], "c": CAPITAL[:wide]}[k] for k in kind[1:])


def size(of: str) -> int:
    """How many strings have a shape (in rare cases a few less: those that would be another shape)."""
    kind, _, layout = of.partition(":")
    sizes, n = [len(a) for a in alphabets(kind)], layout.count("*")
    return sum((-1) ** (len(sizes) - k) * sum(c) ** n for k in range(len(sizes) + 1) for c in combinations(sizes, k)) if n else 1


def _part(key: bytes, number: int, other: int, modulus: int) -> int:
    width = (modulus.bit_length() + 7) // 8 + 8
    data = key + bytes([number]) + other.to_bytes((other.bit_length() + 7) // 8, "big")
    out = b"".join(hashlib.sha256(bytes([k]) + data).digest() for k in range(-(-width // 32)))
    return int.from_bytes(out[:width], "big") % modulus


@lru_cache(maxsize=64)
def _table(key: bytes, many: int) -> tuple[list[int], list[int]]:
    order = sorted(range(many), key=lambda x: (hashlib.sha256(key + x.to_bytes(4, "big")).digest(), x))
    place = [0] * many
    for k, x in enumerate(order):
        place[x] = k
    return place, order


def permuted(x: int, base: int, n: int, key: bytes, back: bool = False) -> int:
    """A keyed permutation of the numbers of ``n`` digits, or its inverse."""
    if base**n <= TABLE or n < 2:
        return _table(key, base**n)[back][x]
    low = base ** (n - n // 2)
    high = base ** (n // 2)
    a, b = divmod(x, low)
    for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
        sign = -1 if back else 1
        if k % 2:
            b = (b + sign * _part(key, k, a, low)) % low
        else:
            a = (a + sign * _part(key, k, b, high)) % high
    return a * low + b


def step(value: str, salt: str = "") -> str:
    """The next string of the same shape; the string itself if it is the only one."""
    of = shape(value)
    kind, _, layout = of.partition(":")
    chars, n = "".join(alphabets(kind)), layout.count("*")
    if size(of) < 2:
        return value
    head = CALL if layout.startswith(CALL) else ""
    places = [k for k, c in enumerate(value) if k >= len(head) and c.isascii() and c.isalnum()]
    base, at, key = len(chars), {c: k for k, c in enumerate(chars)}, hashlib.sha256(f"{len(salt)}:{salt}{of}".encode()).digest()
    x = 0
    for p in places:
        x = x * base + at[value[p]]
    out = list(value)
    while True:
        x = permuted((permuted(x, base, n, key) + 1) % base**n, base, n, key, back=True)
        y = x
        for p in reversed(places):
            y, digit = divmod(y, base)
            out[p] = chars[digit]
        if shape(new := "".join(out)) == of:
            return new
