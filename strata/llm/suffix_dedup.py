"""Repeated byte strings by a sparse suffix array.

A repeated string starts inside a segment whose core repeats (``repeats``). Where the whole segment repeats,
all strings that start in it do: copies are aggregated before anything is sorted. What is left are the variants
of a core, segments that differ somewhere. Their suffixes go in blocks of up to ``BLOCK`` neighbouring starts that share
all but a few bytes. Sampled splitters range-partition the blocks by the leading token (the hash of the shared
bytes), so blocks with equal leading tokens never stand on two sides of a boundary; each bucket is sorted by
a multikey quicksort over its tokens, and the suffixes of a run are compared to their full length. A leading
token with more blocks than a bucket holds, that of a passage which very many texts share, is counted first and left
out of the buckets: its blocks are taken apart into their strings, which Spark counts with a combine in the map tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.batches import Hashes, Piece, flat, mix
from strata.llm.repeats import KEY, covered, keyed, listed, repeated_segments, unpack, unzipped, with_lists, written
from strata.session import scratch_path

WIDTH, CORE, BLOCK = 200, 64, 16
#: Blocks in a bucket, about.
BUCKET = 150_000
#: Bytes of text that a task holds hashes of (about 20 arrays of 8 bytes for each).
LIMIT = 1_000_000
_U = np.uint64


def _bytes(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    return piece.data, piece.starts


def multikey_sort(tokens: list[np.ndarray]) -> np.ndarray:
    """Order of rows by their token sequences: quicksort by one token, then on with the runs of equal tokens only."""
    order = np.argsort(tokens[0])
    group = np.cumsum(np.append(False, tokens[0][order][1:] != tokens[0][order][:-1])) if len(order) else order
    for token in tokens[1:]:
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        inner = np.lexsort((token[order[tied]], group[tied]))
        order[tied] = order[tied][inner]
        new = np.append(False, (group[1:] != group[:-1]) | (token[order][1:] != token[order][:-1]))
        group = np.cumsum(new)
    return order


def _blocks(row: np.ndarray, at: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Blocks of the listed segments: entry, block, least and greatest offset before the anchor, and the anchor's place."""
    first, count, ahead = unpack(at)
    high, low = ahead, ahead - count + 1
    number = high // BLOCK - low // BLOCK + 1
    entry = np.repeat(np.arange(len(at)), number)
    block = low[entry] // BLOCK + np.arange(len(entry)) - np.repeat(np.cumsum(number) - number, number)
    return entry, block, np.maximum(low[entry], block * BLOCK), np.minimum(high[entry], block * BLOCK + BLOCK - 1), (starts[row] + first + ahead)[entry]


def _emit(width: int):
    """Rows of blocks: tokens of the shared bytes, key of the whole block, the bytes around, copies, and where it stands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in unzipped(batches, LIMIT):
            row, (at, copies) = listed(piece, ["at", "copies"])
            entry, block, low, high, anchor = _blocks(row, at, piece.starts, width)
            one, two = Hashes(piece.data), Hashes(piece.data, 1)
            begin = anchor - block * BLOCK
            end = begin + width - BLOCK + 1
            left, right = anchor - high, anchor - low + width
            around = np.zeros((len(entry), 2 * BLOCK - 2), np.uint8)  # outwards from both ends of the shared bytes
            for k in range(BLOCK - 1):
                there = begin - 1 - k >= left
                around[there, k] = piece.data[begin[there] - 1 - k]
                there = end + k < right
                around[there, BLOCK - 1 + k] = piece.data[end[there] + k]
            key = mix(two.of(left, right) ^ mix((block << 20 | (high - low) << 10 | (low - block * BLOCK)).astype(np.uint64)))
            names = {"t0": one.of(begin, end).view(np.int64), "t1": two.of(begin, end).view(np.int64), "whole": key.view(np.int64), "span": block << 8 | (low - block * BLOCK) << 4 | high - block * BLOCK}
            column = lambda name: piece.rows.column(piece.rows.schema.get_field_index(name)).take(pa.array(row[entry]))
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * BLOCK - 2), len(entry), [None, pa.py_buffer(around.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*[pa.array(v) for v in names.values()], flat, pa.array(copies[entry]), column("id"), column("tag"), pa.array(at[entry])],
                                             names=[*names, "around", "copies", *KEY, "at"])
    return run


def _sides(around: np.ndarray) -> list[list[np.ndarray]]:
    """Hashes of the first 0, 1, ... bytes to the left of the shared ones, and to the right."""
    sides = []
    for part in (around[:, :BLOCK - 1], around[:, BLOCK - 1:]):
        sums = [np.zeros(len(part), np.uint64)]
        for k in range(BLOCK - 1):
            sums.append(mix(sums[-1] * _U(0x9E3779B97F4A7C15) + part[:, k].astype(np.uint64) + _U(1)))
        sides.append(sums)
    return sides


def _string(sides: list[list[np.ndarray]], offset: int, own: np.ndarray) -> np.ndarray:
    return sides[0][offset][own] * _U(0xD6E8FEB86659FD93) ^ sides[1][BLOCK - 1 - offset][own]


def _take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each string of each block: the block's tokens, the offset and the hash of the bytes around the shared ones."""
    for batch in batches:
        get = lambda n: batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False)  # noqa: E731,B023
        span, sides = get("span"), _sides(flat(batch.column(batch.schema.get_field_index("around")))[0].reshape(-1, 2 * BLOCK - 2))
        for offset in range(BLOCK):
            own = np.flatnonzero(((span >> 4 & 15) <= offset) & (offset <= (span & 15)))
            columns = [get("t0")[own], get("t1")[own], span[own] >> 8, get("whole")[own], np.full(len(own), offset), _string(sides, offset, own).view(np.int64), get("copies")[own]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["t0", "t1", "block", "whole", "o", "string", "copies"])


def _hot_masks(blocks: DataFrame) -> DataFrame:
    """``u0, w, mask`` of blocks of hot tokens, whatever their number: strings are counted instead of sorted."""
    strings = blocks.select("t0", "t1", "whole", "span", "around", "copies").mapInArrow(_take_apart, "t0 long, t1 long, block long, whole long, o long, string long, copies long")
    key = ["t0", "t1", "block", "o", "string"]
    many = strings.groupBy(*key).agg(F.sum("copies").alias("n")).where("n > 1").select(*[F.col(k).alias(f"m_{k}") for k in key])
    condition = F.lit(True)
    for k in key:
        condition = condition & (F.col(k) == F.col(f"m_{k}"))
    found = strings.join(written(many, "strings"), condition)
    return found.groupBy(F.col("t0").alias("u0"), F.col("whole").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(o AS INT))")).alias("mask"))


def hot_tokens(blocks: DataFrame, total: int, limit: int) -> DataFrame | None:
    """Leading tokens with more than ``limit`` blocks, written; None if there are none.

    Slots of tokens are counted first, so that the usual table is not shuffled for it.
    """
    slots = F.pmod("t0", F.lit(max(2**16, total // 10_000)))
    full = written(blocks.groupBy(slots.alias("slot")).count().where(F.col("count") > limit).select("slot"), "slots")
    if full.isEmpty():
        return None
    counts = blocks.select("t0", slots.alias("s")).join(full, F.col("s") == F.col("slot"), "left_semi").groupBy("t0").count()
    hot = written(counts.where(F.col("count") > limit).select(F.col("t0").alias("h")), "hot")
    return None if hot.isEmpty() else hot


def _sort_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with a mask of the offsets whose strings stand twice or more in their run."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    get = lambda n: table.column(n).to_numpy()
    t0, t1, span, copies, whole = (get(n) for n in ("t0", "t1", "span", "copies", "whole"))
    around = flat(table.column("around"))[0].reshape(-1, 2 * BLOCK - 2)
    order = multikey_sort([t0, t1, span >> 8])
    t0, t1, span, copies, whole, around = t0[order], t1[order], span[order], copies[order], whole[order], around[order]
    fresh = np.append(True, (t0[1:] != t0[:-1]) | (t1[1:] != t1[:-1]) | (span[1:] >> 8 != span[:-1] >> 8))
    run = np.cumsum(fresh) - 1
    low, high = span >> 4 & 15, span & 15
    sides = _sides(around)
    mask = np.zeros(len(t0), np.int64)
    many = np.bincount(run)[run] > 1
    mask[~many & (copies > 1)] = -1
    for offset in range(BLOCK):
        own = np.flatnonzero((low <= offset) & (offset <= high) & many)
        string = _string(sides, offset, own)
        at = np.lexsort((string, run[own]))
        new = np.append(True, (run[own][at][1:] != run[own][at][:-1]) | (string[at][1:] != string[at][:-1])) if len(at) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        total = np.bincount(group, copies[own][at]) if len(at) else np.zeros(0)
        mask[own[at]] |= (total[group] > 1).astype(np.int64) << offset
    keep = mask != 0
    yield pa.RecordBatch.from_arrays([pa.array(t0[keep]), pa.array(whole[keep]), pa.array(mask[keep])], names=["u0", "w", "mask"])


def repeated_starts(docs: DataFrame, *, width: int = WIDTH, core: int = CORE) -> DataFrame:
    """``id, tag, first, count``: runs of places where a string starts that also starts elsewhere."""
    spark = docs.sparkSession
    rows = repeated_segments(docs, _bytes, width, core, LIMIT)
    settled = rows.where("copies > 1").select(*KEY, F.shiftright("at", 24).alias("first"), F.shiftright("at", 12).bitwiseAND(4095).alias("count"))
    open_rows = rows.where("variants > 1 AND chosen")
    source = with_lists(docs, open_rows, "at", "copies")
    path = scratch_path(spark, "blocks")
    source.select("text", *KEY, "list").mapInArrow(_emit(width), "t0 long, t1 long, whole long, span long, around binary, copies long, id long, tag long, at long").write.parquet(path)
    blocks = spark.read.parquet(path)
    total = blocks.count()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    hot = hot_tokens(blocks, total, BUCKET)
    usual = blocks if hot is None else blocks.join(hot, F.col("t0") == F.col("h"), "left_anti")
    distinct = usual.groupBy("t0", "t1", "whole", "span").agg(F.first("around").alias("around"), F.sum("copies").alias("copies"))
    masks = distinct.repartitionByRange(buckets, "t0").mapInArrow(_sort_bucket, "u0 long, w long, mask long")
    if hot is not None:
        masks = masks.unionByName(_hot_masks(blocks.join(hot, F.col("t0") == F.col("h"), "left_semi")))
    starts = F.explode(F.filter(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda o: (F.get("bits", o) == 1) & (o >= F.col("low")) & (o <= F.col("high"))))
    found = blocks.where("copies = 1").select("t0", "whole", "span", *KEY, "at").join(masks, (F.col("t0") == F.col("u0")) & (F.col("whole") == F.col("w")))
    found = found.select(*KEY, "at", "span", "mask").withColumns({
        "low": F.shiftright("span", 4).bitwiseAND(15).cast("int"), "high": F.col("span").bitwiseAND(15).cast("int"),
        "bits": F.array(*[F.shiftright("mask", o).bitwiseAND(1) for o in range(BLOCK)]),
    })
    offset = found.select(*KEY, "at", "span", starts.alias("o"))
    first = F.shiftright("at", 24) + F.col("at").bitwiseAND(4095) - F.shiftright("span", 8) * BLOCK - F.col("o")
    return settled.unionByName(offset.select(*KEY, first.alias("first"), F.lit(1).cast("long").alias("count")))


def mark(documents: DataFrame, *, width: int = WIDTH, core: int = CORE) -> DataFrame:
    """``doc_id, text, n_bytes, n_removed, spans, kept`` for each row: spans are maximal runs [start, end) of removed bytes.

    Every byte goes that a string of ``width`` bytes covers which also starts anywhere else in the corpus, in
    the same text too. Strings are judged on the input. A null text is empty; a text shorter than ``width``
    keeps everything. Rows that repeat (same id and text) are occurrences of their own, so all of a
    long text goes from each. ``kept`` holds bytes, as a cut may fall inside a character. No rows: no rows.
    """
    docs = keyed(documents)
    spans = repeated_starts(docs, width=width, core=core)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in unzipped(batches, LIMIT):
            row, (first, count) = listed(piece, ["first", "count"])
            gone = covered(row, first, count, piece.starts, width) if len(row) else np.zeros(len(piece.data), bool)
            total = np.concatenate([[0], np.cumsum(gone)])
            removed, out, ranges = np.diff(total[piece.starts]), [], []
            for i in range(len(piece)):
                a, b = piece.starts[i], piece.starts[i + 1]
                if removed[i]:
                    step = np.diff(gone[a:b].astype(np.int8), prepend=0, append=0)
                    ranges.append([{"start": s, "end": e} for s, e in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist())])
                    out.append(piece.data[a:b][~gone[a:b]].tobytes())
                else:
                    ranges.append([])
                    out.append(piece.text(i))
            yield pa.RecordBatch.from_arrays([piece.rows.column(0), piece.rows.column(1).cast(pa.string()), pa.array(np.diff(piece.starts)), pa.array(removed), pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(out, pa.binary())],
                                             names=["doc_id", "text", "n_bytes", "n_removed", "spans", "kept"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    joined = with_lists(docs, spans, "first", "count", how="left").select("doc_id", "text", "list")
    return joined.mapInArrow(run, f"doc_id {kind}, text string, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")


def digest(documents: DataFrame) -> DataFrame:
    return mark(documents).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
