"""Repeated word sequences by a compacted de Bruijn graph.

A window of ``width`` words is an edge between its first and its last ``width - 1`` words. Edges are never all
shipped: the windows of a segment (``repeats``) are a ready path of edges, and equal segments are one path with a number of
copies. Only the segments of a core with several variants, where the graph can branch, are taken
apart into single edges, which Spark counts. Paths that follow one another at a node that does not branch are
compacted by joining the nodes' degrees; the source coordinates of each occurrence are held against the
text before anything is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.batches import PIECE, Hashes, Piece, mix, space_table, word_bounds
from strata.llm.repeats import KEY, covered, keyed, listed, repeated_segments, unpack, unzipped, with_lists, written

WIDTH, CORE = 35, 12
GAPS = space_table()


def _words(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    first, end, before = word_bounds(piece.data, piece.starts, GAPS)
    return first, end, before, mix(Hashes(piece.data).of(first, end))


def _values(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    _, _, before, codes = _words(piece)
    return codes, before


def _take_apart(width: int):
    """Paths as they are (``single`` false, with their end nodes), and the single edges of paths at branches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in unzipped(batches, PIECE):
            codes, before = _values(piece)
            one, two = Hashes(codes), Hashes(codes, 1)
            row, (at, copies, variants) = listed(piece, ["at", "copies", "variants"])
            first, count, _ = unpack(at)
            whole = np.flatnonzero(copies > 1)
            apart = np.flatnonzero(variants > 1)
            entry = np.repeat(apart, count[apart])
            inner = np.arange(len(entry)) - np.repeat(np.cumsum(count[apart]) - count[apart], count[apart])
            window = first[entry] + inner
            begin = np.concatenate([before[row[whole]] + first[whole], before[row[entry]] + window])
            end = begin + np.concatenate([count[whole], np.ones(len(entry), np.int64)]) + width - 1
            source = np.concatenate([whole, entry])
            column = lambda name: piece.rows.column(piece.rows.schema.get_field_index(name)).take(pa.array(row[source]))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(len(source)) >= len(whole)), pa.array(one.of(begin, end).view(np.int64)), pa.array(two.of(begin, end).view(np.int64)),
                pa.array(one.of(begin, begin + width - 1).view(np.int64), mask=np.arange(len(source)) >= len(whole)),
                pa.array(one.of(end - width + 1, end).view(np.int64), mask=np.arange(len(source)) >= len(whole)),
                pa.array(copies[source]), column("id"), column("tag"), pa.array(begin - before[row[source]]),
            ], names=["single", "e0", "e1", "start", "stop", "copies", *KEY, "first"])
    return run


def repeated_edges(docs: DataFrame, *, width: int = WIDTH, core: int = CORE) -> DataFrame:
    """``id, tag, first, count, e1, joins``: occurrences of repeated paths; ``joins``: the node before it does not branch."""
    rows = repeated_segments(docs, _values, width, core, PIECE)
    chosen = with_lists(docs, rows.where("chosen"), "at", "copies", "variants")
    edges = written(chosen.select("text", *KEY, "list").mapInArrow(_take_apart(width), "single boolean, e0 long, e1 long, start long, stop long, copies long, id long, tag long, first long"), "edges")
    paths = edges.where("NOT single").select("e0", "e1", "start", "stop").distinct()
    nodes = paths.select(F.col("start").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(paths.select(F.col("stop").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    plain = nodes.groupBy("node").agg(F.sum("out").alias("out"), F.sum("in").alias("in")).where("out = 1 AND in = 1").select("node")
    compact = paths.join(plain, F.col("start") == F.col("node"), "left").select(F.col("e1").alias("e"), F.col("start"), F.col("node").isNotNull().alias("joins"))
    compact = written(compact.groupBy("e").agg(F.min("joins").alias("joins")), "paths")
    settled = rows.where("copies > 1").select(*KEY, F.shiftright("at", 24).alias("first"), F.shiftright("at", 12).bitwiseAND(4095).alias("count"), F.col("cls").alias("e1"))
    settled = settled.join(compact, F.col("e1") == F.col("e"), "left").select(*KEY, "first", "count", "e1", F.coalesce("joins", F.lit(False)).alias("joins"))
    singles = edges.where("single")
    counted = written(singles.groupBy("e0", "e1").agg(F.sum("copies").alias("n")).where("n > 1").select(F.col("e0").alias("f0"), F.col("e1").alias("f1")), "repeated-edges")
    found = singles.where("copies = 1").select("e0", "e1", *KEY, "first").join(counted, (F.col("e0") == F.col("f0")) & (F.col("e1") == F.col("f1")))
    return settled.unionByName(found.select(*KEY, "first", F.lit(1).cast("long").alias("count"), "e1", F.lit(False).alias("joins")))


def _spans(row: np.ndarray, first: np.ndarray, count: np.ndarray, joins: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compacted paths of each row: row, first word and words."""
    order = np.lexsort((first, row))
    row, first, count, joins = row[order], first[order], count[order], joins[order]
    new = np.append(True, (row[1:] != row[:-1]) | (first[1:] != first[:-1] + count[:-1]) | ~joins[1:]) if len(row) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(row)) - 1
    return row[head], first[head], first[last] + count[last] - first[head] + width - 1 if len(head) else head


def mark(documents: DataFrame, *, width: int = WIDTH, core: int = CORE) -> DataFrame:
    """``doc_id, text, n_words, n_removed, paths, kept`` for each row.

    Each word goes that a window of ``width`` words covers whose words also start anywhere else in the corpus,
    in the same text too; windows are judged on the input. ``paths`` are the compacted repeated paths in
    the text (first word, words; they may overlap by up to ``width - 1`` words), ``kept`` the other words joined by
    one space. A null or empty text has no words; one with fewer than ``width`` words keeps all. Rows
    that repeat (same id and text) are occurrences of their own. No rows: no rows.
    """
    docs = keyed(documents)
    edges = repeated_edges(docs, width=width, core=core)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in unzipped(batches, PIECE):
            begin, end, before, codes = _words(piece)
            row, (first, count, e1, joins) = listed(piece, ["first", "count", "e1", "joins"])
            if len(row):  # the coordinates must hold the words of the path
                at = before[row] + first
                true = (at + count + width - 1 <= before[row + 1])
                row, first, count, e1, joins, at = (x[true] for x in (row, first, count, e1, joins, at))
                true = Hashes(codes, 1).of(at, at + count + width - 1).view(np.int64) == e1
                row, first, count, joins = (x[true] for x in (row, first, count, joins))
            gone = covered(row, first, count, before, width) if len(row) else np.zeros(len(codes), bool)
            path_row, path_first, path_words = _spans(row, first, count, joins.astype(bool), width)
            where = np.searchsorted(path_row, np.arange(len(piece) + 1))
            total = np.concatenate([[0], np.cumsum(gone)])
            removed, kept, paths = np.diff(total[before]), [], []
            for i in range(len(piece)):
                text, base = piece.text(i), piece.starts[i]
                if removed[i]:
                    own = np.flatnonzero(~gone[before[i]:before[i + 1]]) + before[i]
                    kept.append(b" ".join([text[s:e] for s, e in zip((begin[own] - base).tolist(), (end[own] - base).tolist())]))
                else:
                    kept.append(b" ".join(text.split()))
                a, b = where[i], where[i + 1]
                paths.append([{"first": f, "words": w} for f, w in zip(path_first[a:b].tolist(), path_words[a:b].tolist())])
            yield pa.RecordBatch.from_arrays([piece.rows.column(0), piece.rows.column(1).cast(pa.string()), pa.array(np.diff(before)), pa.array(removed), pa.array(paths, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))), pa.array([k.decode(errors="replace") for k in kept], pa.string())],
                                             names=["doc_id", "text", "n_words", "n_removed", "paths", "kept"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    joined = with_lists(docs, edges, "first", "count", "e1", "joins", how="left").select("doc_id", "text", "list")
    return joined.mapInArrow(run, f"doc_id {kind}, text string, n_words long, n_removed long, paths array<struct<first: long, words: long>>, kept string")


def digest(documents: DataFrame) -> DataFrame:
    return mark(documents).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("paths").alias("n_paths"))
