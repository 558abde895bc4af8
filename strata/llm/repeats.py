"""Segments of documents that can hold repeated windows, found without shipping a row for each window.

The windows of a document fall into segments by their anchor (``batches.segments``), about one segment for
half a window's length. Only the hashes of segments are shuffled: of the core, whose repetition is necessary
for a repeated window, and of the whole segment. Segments with equal text are one class; ``copies`` counts
them, and ``variants`` counts the classes of a core.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.batches import Hashes, Piece, pieces, segments
from strata.session import scratch_path

#: From a piece, the values that windows are made of, and the number of them before each row.
Parse = Callable[[Piece], tuple[np.ndarray, np.ndarray]]
KEY = ["id", "tag"]
ANCHOR_BITS, COUNT_BITS = 12, 12


def keyed(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and a 128-bit key. Rows that repeat share it; a null id or text has a key as well."""
    return documents.select("doc_id", "text", F.xxhash64(F.lit("id"), F.col("doc_id").cast("string")).alias("id"), F.xxhash64(F.lit("tag"), "text", F.col("doc_id").cast("string")).alias("tag"))


def pack(first: np.ndarray, count: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    return first << (ANCHOR_BITS + COUNT_BITS) | count << ANCHOR_BITS | ahead


def unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, and the anchor's distance from the first."""
    return at >> (ANCHOR_BITS + COUNT_BITS), at >> ANCHOR_BITS & 2**COUNT_BITS - 1, at & 2**ANCHOR_BITS - 1


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` through a table in the shared folder.

    A small side of a join that is an aggregate over the join's key is written first: the join then has an
    exchange of its own on either side, and adaptive execution can split a hot key.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def repeated_segments(docs: DataFrame, parse: Parse, width: int, core: int, limit: int) -> DataFrame:
    """``core, cls, id, tag, at, copies, variants, chosen`` of segments whose core is repeated; ``chosen``: one of each class."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=limit):
            values, starts = parse(piece)
            hashes, others = Hashes(values), Hashes(values, 1)
            s = segments(hashes, starts, width, core)
            column = lambda name: piece.rows.column(piece.rows.schema.get_field_index(name)).take(pa.array(s.row))
            yield pa.RecordBatch.from_arrays([
                pa.array(hashes.of(s.anchor, s.anchor + core).view(np.int64)), pa.array(others.of(s.first, s.first + s.count + width - 1).view(np.int64)),
                column("id"), column("tag"), pa.array(pack(s.first - starts[s.row], s.count, s.anchor - s.first)),
            ], names=["core", "cls", "id", "tag", "at"])

    found = docs.select("text", *KEY).mapInArrow(cut, "core long, cls long, id long, tag long, at long")
    cores = written(found.groupBy(F.col("core").alias("c")).count().where("count > 1").select("c"), "cores")
    rows = written(found.join(cores, F.col("core") == F.col("c")).drop("c"), "segments")
    classes = rows.groupBy("core", "cls").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "tag", "at")).alias("least"))
    classes = written(classes, "classes")
    variants = written(classes.groupBy(F.col("core").alias("c")).agg(F.count(F.lit(1)).alias("variants")).where("variants > 1"), "variants")
    classes = classes.join(variants, F.col("core") == F.col("c"), "left").select(F.col("core").alias("c"), F.col("cls").alias("d"), "copies", "least", F.coalesce("variants", F.lit(1)).alias("variants"))
    classes = classes.where("copies > 1 OR variants > 1")
    out = rows.join(classes, (F.col("core") == F.col("c")) & (F.col("cls") == F.col("d")))
    return written(out.select("core", "cls", *KEY, "at", "copies", "variants", (F.struct("id", "tag", "at") == F.col("least")).alias("chosen")), "repeats")


def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with each ``text`` compressed by itself; null stays null."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for piece in pieces([batch]):
            at = piece.rows.schema.get_field_index("text")
            texts = [None if not full else pack(piece.text(i)) for i, full in enumerate(piece.rows.column(at).is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()) if k == at else c for k, c in enumerate(piece.rows.columns)], names=piece.rows.schema.names)


def unzipped(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[Piece]:
    """Pieces of rows whose ``text`` has come compressed."""
    open_ = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            at = part.schema.get_field_index("text")
            texts = pa.array([None if t is None else open_(t) for t in part.column(at).to_pylist()], pa.large_binary()).cast(pa.large_string())
            yield from pieces([pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(part.columns)], names=part.schema.names)], limit=limit)


def with_lists(docs: DataFrame, rows: DataFrame, *columns: str, how: str = "inner") -> DataFrame:
    """``docs`` with ``list``: the different ``columns`` of the rows that have the document's key.

    The texts cross the shuffle compressed one by one, and stay so until ``unzipped`` reads them in a task.
    """
    schema = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema)
    docs = docs.mapInArrow(zipped, schema)
    lists = rows.select(*KEY, *columns).distinct().groupBy(*KEY).agg(F.collect_list(F.struct(*columns)).alias("list"))
    lists = lists.select(F.col("id").alias("i"), F.col("tag").alias("t"), "list")
    return docs.join(lists, (F.col("id") == F.col("i")) & (F.col("tag") == F.col("t")), how).drop("i", "t")


def listed(piece: Piece, names: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row of each entry of ``list`` in a piece, and the entries' columns."""
    column = piece.rows.column(piece.rows.schema.get_field_index("list"))
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    entries = column.flatten()
    return np.repeat(np.arange(len(piece)), lengths), [entries.field(n).to_numpy(zero_copy_only=False) for n in names]


def covered(rows: np.ndarray, first: np.ndarray, count: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Mark of each value of a piece that a window stands over; windows ``first`` and the next ``count - 1`` of a row."""
    change = np.zeros(starts[-1] + 1, np.int64)
    np.add.at(change, starts[rows] + first, 1)
    np.add.at(change, starts[rows] + first + count + width - 1, -1)
    return np.cumsum(change[:-1]) > 0
