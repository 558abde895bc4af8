"""Texts of Arrow batches as flat byte arrays, their words, and hashes of any slice of either.

Everything here runs inside tasks on one bounded piece of a partition at a time. A piece holds whole
texts and about ``PIECE`` bytes; only a text that is longer by itself makes a larger piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1_500_000
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_U = np.uint64


@dataclass
class Piece:
    """Rows of a batch with their text bytes; ``data[starts[i]:starts[i + 1]]`` is the text of row i (null: empty)."""

    rows: pa.RecordBatch
    data: np.ndarray
    starts: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.starts[i + 1]].tobytes()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the place where each row starts."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[starts[0]:starts[-1]], starts - starts[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE) -> Iterator[Piece]:
    """Cut batches into runs of whole rows of about ``limit`` text bytes each."""
    for batch in batches:
        data, starts = flat(batch.column(batch.schema.get_field_index(column)))
        first, n = 0, batch.num_rows
        while first < n:
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + limit, "right")) - 1)
            last = min(last, n)
            yield Piece(batch.slice(first, last - first), data[starts[first]:starts[last]], starts[first:last + 1] - starts[first])
            first = last


def word_bounds(data: np.ndarray, starts: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each row; ``breaks[b]``: byte b stands between words."""
    n = len(data)
    gap = breaks[data]
    edge = np.ones(n + 1, bool)
    edge[1:] = False
    edge[starts] = True
    before = edge.copy()
    before[1:] |= gap
    after = edge[1:].copy()
    after[:-1] |= gap[1:]
    after[-1:] = True
    first = np.flatnonzero(~gap & before[:-1])
    end = np.flatnonzero(~gap & after) + 1
    return first, end, np.searchsorted(first, starts)


def space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(SPACES)] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the splitmix64 finalizer)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@lru_cache(maxsize=4)
def _base(family: int) -> tuple[int, int, np.ndarray]:
    seeds = np.random.default_rng(7919 + family)
    base = int(seeds.integers(1, 2**63)) * 2 + 1
    return base, pow(base, -1, 2**64), seeds.integers(0, 2**64 - 1, 256, dtype=np.uint64)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(family: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(family)
    if have is None or len(have[0]) < n:
        base, inverse, _ = _base(family)
        size = max(n, 1024)
        out = []
        for b in (base, inverse):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        have = _POWERS[family] = (out[0], out[1])
    return have


class Hashes:
    """64-bit hashes of slices of one sequence: prefix sums of a polynomial with random coefficients.

    Equal slices have equal hashes wherever they stand, in every piece and on every machine. Two families
    make 128 bits. ``values`` are bytes, or 64-bit codes of words that are spread already.
    """

    def __init__(self, values: np.ndarray, family: int = 0):
        self.family = family
        codes = _base(family)[2][values] if values.dtype == np.uint8 else values
        powers, self.inverse = _powers(family, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(codes * powers[:len(values)], out=self.sums[1:])

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = self.sums[end] - self.sums[first]
        out *= self.inverse[first]
        return out

    def windows(self, width: int) -> np.ndarray:
        """Hash of the ``width`` values from each place on."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return (self.sums[width:] - self.sums[:n]) * self.inverse[:n]


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Place of the least key in each window of ``width`` keys, the leftmost of equal ones.

    Keys are compared by their upper 33 bits, so that the place fits beside them and the choice depends
    on nothing but the window.
    """
    n = len(keys) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = _U(2**31 - 1)
    packed = np.full(-(-len(keys) // width) * width, _U(2**64 - 1))
    packed[:len(keys)] = (keys & ~low) | np.arange(len(keys), dtype=np.uint64)
    blocks = packed.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    return (np.minimum(ahead[:n], behind[width - 1:width - 1 + n]) & low).astype(np.int64)


@dataclass
class Segments:
    """Runs of windows of a row with the same anchor: ``row``, first window and count, and the anchor's place."""

    row: np.ndarray
    first: np.ndarray
    count: np.ndarray
    anchor: np.ndarray


def segments(hashes: Hashes, starts: np.ndarray, width: int, core: int) -> Segments:
    """Cut the windows of ``width`` values of each row by their anchor, the ``core`` values with the least hash in them.

    The anchor depends on the window alone, so equal windows have equal cores at the same offset: a window
    can repeat only where its core does. Windows never cross rows.
    """
    none = np.zeros(0, np.int64)
    place = sliding_least(mix(hashes.windows(core)), width - core + 1)
    have = np.maximum(np.diff(starts) - width + 1, 0)
    rows = np.flatnonzero(have)
    if not len(rows):
        return Segments(none, none, none, none)
    first, stop = starts[rows], starts[rows] + have[rows]
    change = np.zeros(len(place) + 1, bool)
    change[1:-1] = place[1:] != place[:-1]
    inside = np.zeros(len(place) + 1, np.int8)
    inside[first] += 1
    np.subtract.at(inside, stop, 1)
    change &= np.cumsum(inside, dtype=np.int8).astype(bool)
    change[first] = True
    cut = np.flatnonzero(change)
    row = rows[np.searchsorted(first, cut, "right") - 1]
    end = np.minimum(np.append(cut[1:], len(place)), starts[row] + have[row])
    return Segments(row, cut, end - cut, place[cut])
