"""Plain versions of the contracts, row by row, and rows that hold every special case."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def raw(text: str | None) -> bytes:
    return (text or "").encode()


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def repeated(sequences: list, width: int) -> list[list[bool]]:
    """For each sequence, which members a window covers that occurs twice or more in all of them."""
    count = Counter(s[p:p + width] for s in sequences for p in range(len(s) - width + 1))
    out = []
    for s in sequences:
        gone = [False] * len(s)
        for p in range(len(s) - width + 1):
            if count[s[p:p + width]] > 1:
                gone[p:p + width] = [True] * width
        out.append(gone)
    return out


def special_rows(seed: int = 3) -> list[tuple]:
    """(doc_id, text): variants of a few texts, nulls, empty, periodic, long and repeated rows, odd white space."""
    rng = random.Random(seed)
    bases = [[rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(220)] for _ in range(4)]
    rows: list[tuple] = []
    for i in range(90):
        words = rng.choice(bases)
        start = rng.randrange(0, 120)
        words = list(words[start:start + rng.randrange(20, 100)])
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(["é", "ZZ", " x"])
        rows.append((i, rng.choice([" ", "\n", "\t", "\x0b "]).join(words) + rng.choice(["", "\n", " end of " + str(i)])))
    rows += [(500, None), (501, ""), (502, "a " * 3000), (503, "a b " * 300), (503, "a b " * 300), (504, " \t\n"), (None, " ".join(bases[0])), (505, "one"), (506, "\n\none two\n\nthree\n"), (507, "x" * 5000)]
    return rows
