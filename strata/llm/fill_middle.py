"""Fill-in-the-middle: texts cut into prefix, middle and suffix, and written with the middle last.

Places in a text are bytes; a sparse index of the multibyte characters turns them into code points and back.
It has an entry for each such character, its byte and the excess bytes so far, and nothing for ASCII, where the
distance from the entry before is all there is to add. All cuts of a piece of texts are turned by one search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.batches import PIECE, Piece, pieces

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Per cent of the texts that are cut, and per cent of those that begin with their suffix.
CUT, SUFFIX_FIRST = 100, 50
UNITS = ("line", "char")
ADDED = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


@dataclass(frozen=True)
class Exceptions:
    """The multibyte characters of UTF-8 bytes: where each begins, in bytes and in code points, and the excess before and after it."""

    byte: np.ndarray
    char: np.ndarray
    excess: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray) -> Exceptions:
        byte = np.flatnonzero(data >= 0xC0)
        lead = data[byte]
        excess = np.zeros(len(byte) + 1, np.int64)
        np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0), out=excess[1:])
        return cls(byte, byte - excess[:-1], excess)

    def chars(self, byte: np.ndarray) -> np.ndarray:
        """Code points before each byte place (the first byte of a character, or the end)."""
        return byte - self.excess[np.searchsorted(self.byte, byte)]

    def bytes(self, char: np.ndarray) -> np.ndarray:
        """Byte place of each code point."""
        return char + self.excess[np.searchsorted(self.char, char)]


class Lines:
    """Lines of the texts of a piece; a line ends behind its newline, the last one at the end of the text."""

    def __init__(self, piece: Piece, index: Exceptions):
        self.ends, self.starts = np.flatnonzero(piece.data == 0x0A) + 1, piece.starts
        self.before = np.searchsorted(self.ends, piece.starts, "right")
        full = np.diff(self.before)
        last = np.zeros(len(piece), np.int64)
        last[full > 0] = self.ends[self.before[1:][full > 0] - 1]
        self.n = full + (np.where(full > 0, last, piece.starts[:-1]) < piece.starts[1:])

    def places(self, units: np.ndarray) -> np.ndarray:
        """Byte place in the piece behind so many units of each text."""
        inner = np.append(self.ends, 0)[np.minimum(self.before[:-1] + units - 1, len(self.ends))]
        return np.where(units == 0, self.starts[:-1], np.where(units >= self.n, self.starts[1:], inner))


class Chars:
    """Code points of the texts of a piece."""

    def __init__(self, piece: Piece, index: Exceptions):
        self.index, self.first = index, index.chars(piece.starts)
        self.n = np.diff(self.first)

    def places(self, units: np.ndarray) -> np.ndarray:
        return self.index.bytes(self.first[:-1] + units)


def _piece(piece: Piece, drawn: str, unit: str, cut: int, suffix_first: int) -> pa.RecordBatch:
    rows, index = piece.rows, Exceptions.of(piece.data)
    units = Lines(piece, index) if unit == "line" else Chars(piece, index)
    at = rows.schema.get_field_index(drawn)
    draws = np.frombuffer(b"".join(rows.column(at).to_pylist()), ">u4").reshape(len(piece), -1).astype(np.int64)
    one, two = draws[:, 0] % (units.n + 1), draws[:, 1] % (units.n + 1)
    first, second = units.places(np.minimum(one, two)), units.places(np.maximum(one, two))
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    form, outputs = [], []
    for row in range(len(piece)):
        text = piece.text(row)
        if not text or draws[row, 2] % 100 >= cut or any(m in text for m in marks):
            form.append("plain")
            outputs.append(text)
            continue
        a, b = first[row] - piece.starts[row], second[row] - piece.starts[row]
        prefix, middle, suffix = marks[0] + text[:a], marks[2] + text[a:b], marks[1] + text[b:]
        form.append("spm" if draws[row, 3] % 100 < suffix_first else "psm")
        outputs.append(suffix + prefix + middle if form[-1] == "spm" else prefix + suffix + middle)
    plain = np.array([f == "plain" for f in form], bool)
    bounds = index.chars(np.stack([piece.starts[:-1], first, second]))
    prefix_chars, middle_chars = np.diff(bounds, axis=0)
    columns = [c for k, c in enumerate(rows.columns) if k != at]
    columns += [pa.array(units.n), pa.array(form), pa.array(prefix_chars, mask=plain), pa.array(middle_chars, mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[*(n for n in rows.schema.names if n != drawn), *ADDED])


def transform(documents: DataFrame, *, unit: str = "line", seed: int = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``documents`` with ``n`` units, ``form``, ``prefix_chars``, ``middle_chars`` (code points) and ``output``.

    Units are lines or code points; the two cuts, the form and whether a text is cut at all are drawn from the
    SHA-256 of ``seed:doc_id``, so repeated rows come out alike, and a null id draws as an empty one. ``psm`` is
    prefix, suffix, middle; ``spm`` begins with the suffix. A text that is null, empty or holds one of the three
    marks stays ``plain``, unchanged (null: empty), with null lengths. Long texts are cut whole; a line without an end is a line.
    Rows keep their other columns; earlier columns of the five names are replaced. An empty table stays empty.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    own = [F.col(f"`{c}`") for c in documents.columns if c.lower() not in ADDED]
    drawn = "draws" + "_" * max(map(len, documents.columns))  # longer than any name of the table
    draws = F.unhex(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256))
    source = documents.select(*own, draws.alias(drawn))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*own).schema] + [f"`{n}` {kind}" for n, kind in ADDED.items()]

    limit = PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (_piece(piece, drawn, unit, cut, suffix_first) for piece in pieces(batches, limit=limit))

    return source.mapInArrow(run, ", ".join(schema))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone. Marks stand in no cut text, so they part it."""
    def halves(text: Column, mark: str) -> tuple[Column, Column]:
        return F.split_part(text, F.lit(mark), F.lit(1)), F.split_part(text, F.lit(mark), F.lit(2))

    front, middle = halves(output, MIDDLE)
    prefix, suffix = halves(front, SUFFIX)
    late_suffix, late_prefix = halves(front, PREFIX)
    behind = lambda part, mark: F.substring(part, len(mark) + 1, 2**31 - 1)
    psm = F.concat(behind(prefix, PREFIX), middle, suffix)
    spm = F.concat(late_prefix, middle, behind(late_suffix, SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(documents: DataFrame) -> DataFrame:
    """One row for each document with its form, lengths, and the digests of the output and of the text rebuilt from it."""
    made = transform(documents.select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def _sql() -> str:
    draw = ", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
    part = lambda a, b: f"coalesce(array_to_string(list_slice(lines, {a}, {b}), ''), '')"
    return rf"""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT *, len(lines) AS n, {draw} FROM cut),
placed AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {CUT} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, {part('1', 'a')} AS p, {part('a + 1', 'b')} AS m, {part('b + 1', 'n')} AS s FROM placed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts"""


SQL = _sql()
