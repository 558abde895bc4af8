"""Line deduplication by overlapping windows of three lines.

Consecutive lines that hold a word are hashed in windows of ``width``. Spark finds the windows that repeat and their
first occurrence with one aggregate that combines in the map tasks; the other occurrences go back to their
documents by a join, and each document merges them to covered lines and drops those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.batches import PIECE, Hashes, Piece, mix, pieces, space_table
from strata.llm.repeats import KEY, covered, keyed, listed, unzipped, with_lists, written

WIDTH = 3
GAPS = space_table()


def lines(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each line and the lines before each row; which lines hold a word, and those before each row."""
    breaks = np.flatnonzero(piece.data == 10)
    first = np.sort(np.concatenate([piece.starts[:-1], breaks + 1]))
    end = np.sort(np.concatenate([breaks, piece.starts[1:]]))
    before = np.searchsorted(breaks, piece.starts) + np.arange(len(piece) + 1)
    filled = np.concatenate([[0], np.cumsum(~GAPS[piece.data])])
    worded = np.flatnonzero(filled[end] > filled[first])
    return first, end, before, worded, np.searchsorted(worded, before)


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            first, end, _, worded, before = lines(piece)
            codes = [mix(Hashes(piece.data, k).of(first[worded], end[worded]) + (end - first)[worded].astype(np.uint64)) for k in (0, 1)]
            count = np.maximum(np.diff(before) - width + 1, 0)
            row = np.repeat(np.arange(len(piece)), count)
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            at = before[row] + place
            column = lambda name: piece.rows.column(piece.rows.schema.get_field_index(name)).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*[pa.array(Hashes(c, k).of(at, at + width).view(np.int64)) for k, c in enumerate(codes)], column("doc_id"), *[column(k) for k in KEY], pa.array(place)],
                                             names=["h0", "h1", "doc_id", *KEY, "place"])
    return run


def mark(documents: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """``doc_id, text, n_lines, n_removed, kept`` for each row; ``kept`` is the text without the removed lines.

    Lines end at ``\\n``. A window is ``width`` consecutive lines with a word of one text, compared byte for byte; lines
    without a word stand in no window and always stay. Of a window that occurs again, the occurrence in the
    document with the least id (null last) and there the earliest stays, and the lines of all others go;
    a line goes if any of its windows does. Rows that repeat (same id and text) are one document and get the
    same result. A null text counts as one empty line and stays null; a short text stays whole.
    """
    docs = keyed(documents)
    kind = documents.schema["doc_id"].dataType.simpleString()
    found = docs.select("text", "doc_id", *KEY).mapInArrow(_windows(width), f"h0 long, h1 long, doc_id {kind}, id long, tag long, place long")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEY, "place")
    firsts = found.groupBy(F.col("h0").alias("f0"), F.col("h1").alias("f1")).agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least <> most").drop("most")
    firsts = written(firsts, "windows")
    later = found.join(firsts, (F.col("h0") == F.col("f0")) & (F.col("h1") == F.col("f1"))).where(place != F.col("least")).select(*KEY, "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in unzipped(batches, PIECE):
            first, end, before, worded, worded_before = lines(piece)
            row, (start,) = listed(piece, ["place"])
            gone = np.zeros(len(first), bool)
            if len(row):
                gone[worded] = covered(row, start, np.ones(len(row), np.int64), worded_before, width)
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = np.diff(total[before])
            texts = piece.rows.column(1).to_pylist()
            for i in np.flatnonzero(removed):
                own = np.flatnonzero(~gone[before[i]:before[i + 1]]) + before[i]
                texts[i] = b"\n".join([piece.data[s:e].tobytes() for s, e in zip(first[own].tolist(), end[own].tolist())]).decode(errors="replace")
            yield pa.RecordBatch.from_arrays([piece.rows.column(0), piece.rows.column(1).cast(pa.string()), pa.array(np.diff(before)), pa.array(removed), pa.array(texts, pa.string())], names=["doc_id", "text", "n_lines", "n_removed", "kept"])

    joined = with_lists(docs, later, "place", how="left").select("doc_id", "text", "list")
    return joined.mapInArrow(run, f"doc_id {kind}, text string, n_lines long, n_removed long, kept string")


def digest(documents: DataFrame) -> DataFrame:
    return mark(documents).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


#: The same in SQL: line by line, windows as strings.
SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents
), worded AS (
  SELECT doc_id, n, line, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k,
         lead(line, 1) OVER (PARTITION BY doc_id ORDER BY n) AS second, lead(line, 2) OVER (PARTITION BY doc_id ORDER BY n) AS third
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), later AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY line, second, third ORDER BY doc_id, k) AS place FROM worded WHERE third IS NOT NULL) WHERE place > 1
), gone AS (
  SELECT DISTINCT doc_id, k + d AS k FROM later, (SELECT unnest([0, 1, 2]) AS d)
), marked AS (
  SELECT l.doc_id, l.n, l.line, g.k IS NOT NULL AS removed
  FROM lines l LEFT JOIN worded w ON w.doc_id = l.doc_id AND w.n = l.n LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.k = w.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT removed), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
