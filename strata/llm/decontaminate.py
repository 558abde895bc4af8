"""Benchmark decontamination with an FM-index per shard of the training texts.

Each task cuts its part of the documents into shards of bounded size. A shard's words become numbers of
the benchmark's vocabulary (0 for every other word), its suffixes an FM-index, and the benchmark's windows
are searched in it backwards, located by sampled places and merged to spans. Documents are neither
shuffled nor joined. Spark cuts the benchmark into blocks of bounded size; the documents are read once
for each block, which is broadcast alone, and what earlier blocks have found travels with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.batches import Hashes, Piece, lower_table, mix, pieces, word_bounds
from strata.llm.fm_index import FmIndex
from strata.llm.numbering import running
from strata.llm.repeats import written

#: Words of an item window; a shorter item is one window.
WINDOW = 10
#: Words of the benchmark in one broadcast block, some 60 MB of windows, and in a part of a long item.
BLOCK_WORDS, PART_WORDS = 1_000_000, 100_000
#: Bytes of text in a shard; a longer text is a shard by itself.
SHARD = 500_000
LOWER = lower_table()
#: Bytes between words, after A-Z became a-z: all ASCII but digits and letters.
BREAKS = np.zeros(256, bool)
BREAKS[:128] = True
BREAKS[0x30:0x3A] = BREAKS[0x61:0x7B] = False


def words_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of the words, words before each row, and a 64-bit code of each word."""
    data = LOWER[data]
    first, end, before = word_bounds(data, starts, BREAKS)
    return first, end, before, mix(Hashes(data).of(first, end))


class Phrases:
    """A block of benchmark items: their vocabulary and their windows as word numbers, by length."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        texts = [text.encode() for _, text in items]
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        _, _, before, codes = words_of(data, starts)
        self.vocabulary = np.unique(codes)
        numbers = (np.searchsorted(self.vocabulary, codes) + 1).astype(np.int32)
        self.names = [name for name, _ in items]
        found: dict[int, dict[bytes, set[int]]] = {}
        for item in range(len(items)):
            own = numbers[before[item]:before[item + 1]]
            length = min(window, len(own))
            for at in range(len(own) - length + 1 if length else 0):
                found.setdefault(length, {}).setdefault(own[at:at + length].tobytes(), set()).add(item)
        self.windows = []
        for length, owners in sorted(found.items()):
            table = np.frombuffer(b"".join(owners), np.int32).reshape(-1, length)
            lists = [sorted(x) for x in owners.values()]
            self.windows.append((length, table, np.cumsum([0, *map(len, lists)]), np.concatenate(lists)))


def find(phrases: Phrases, codes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the words inside occurrences, and (row, item) pairs of the items that occur."""
    n, rows = len(codes), len(before) - 1
    hit, none = np.zeros(n, bool), np.zeros((0, 2), np.int64)
    if not n or not phrases.windows:
        return hit, none
    at = np.searchsorted(phrases.vocabulary, codes)
    at[at == len(phrases.vocabulary)] = 0
    row = np.repeat(np.arange(rows), np.diff(before))
    number = np.zeros(n + rows, np.int32)  # a separator ends each text
    number[np.arange(n) + row] = np.where(phrases.vocabulary[at] == codes, at + 1, 0)
    word = np.full(n + rows, -1, np.int32)
    word[np.arange(n) + row] = np.arange(n)
    ends = np.flatnonzero(number == 0)  # runs of vocabulary words too short for any window go
    run = np.diff(np.concatenate([[-1], ends])) - 1
    keep = np.repeat(run >= phrases.windows[0][0], run + 1)
    number, word = number[keep], word[keep]
    if not len(number):
        return hit, none
    used, number = np.unique(number, return_inverse=True)  # numbers of this shard only
    local = np.full(len(phrases.vocabulary) + 2, len(used) + 1, np.int32)
    local[used] = np.arange(len(used))
    index = FmIndex(number)
    change, pairs = np.zeros(n + 1, np.int64), [none]
    for length, table, first_owner, owners in phrases.windows:
        mapped = local[table]
        present = np.flatnonzero((mapped <= len(used)).all(axis=1))
        low, high = index.search(mapped[present])
        count = high - low
        phrase = np.repeat(np.arange(len(present)), count)
        if not len(phrase):
            continue
        begin = word[index.locate(np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count))]
        np.add.at(change, begin, 1)
        np.add.at(change, begin + length, -1)
        seen = np.unique(np.stack([row[begin], present[phrase]], axis=1), axis=0)
        many = np.diff(first_owner)[seen[:, 1]]
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first_owner[seen[:, 1]], many)
        pairs.append(np.stack([np.repeat(seen[:, 0], many), owners[inner]], axis=1))
    return np.cumsum(change[:-1]) > 0, np.unique(np.concatenate(pairs), axis=0)


def blocks(benchmark: DataFrame, *, window: int = WINDOW, block_words: int = BLOCK_WORDS, part_words: int = PART_WORDS) -> tuple[DataFrame, int]:
    """``name, text, block`` of the items that have words, and the number of blocks.

    A block has about ``block_words`` words; an item of over ``part_words`` is cut into parts that share the
    words of all windows across a cut.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=SHARD):
            first, end, before, _ = words_of(piece.data, piece.starts)
            rows, texts, sizes = [], [], []
            for row in range(len(piece)):
                for a in range(before[row], before[row + 1], part_words):
                    b = min(a + part_words + window - 1, before[row + 1])
                    if a == before[row] or b - a >= window:  # else the part before has all its windows
                        rows.append(row)
                        texts.append(piece.data[first[a]:end[b - 1]].tobytes())
                        sizes.append(b - a)
            yield pa.RecordBatch.from_arrays([piece.rows.column(0).take(pa.array(rows, pa.int64())), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64())], names=["name", "text", "size"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text")
    parts = written(items.mapInArrow(cut, "name string, text string, size long"), "items")
    placed = running(parts, [], F.xxhash64("name", "text"), [F.col("name"), F.col("text")], F.col("size"))
    table = written(placed.select("name", "text", F.expr(f"before div {block_words}").alias("block")), "blocks")
    return table, (table.agg(F.max("block")).first()[0] or 0) + 1


def mark(documents: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_words: int = BLOCK_WORDS, part_words: int = PART_WORDS, clean: bool = False) -> DataFrame:
    """``documents`` with ``n_words``, ``n_hit``, ``items`` (ids of the items that occur, as strings, distinct) and ``spans``.

    Spans are byte ranges [start, end) of merged occurrences, from the first to the last word of each. With
    ``clean`` the text loses these ranges (the sides are joined by a space) and keeps its other bytes.
    A null or empty text has no words, hits or items and stays as it is. An item without words is never
    found; an item without an id counts under the id ''. Items and rows that repeat change nothing; rows
    keep all their columns, and an earlier column of one of the four names is replaced. Long texts are
    searched whole. No benchmark: nothing is marked.
    """
    spark = documents.sparkSession
    added = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
    marked = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c.lower() not in added])
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema)
    schema = f"{own}, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"
    table, count = blocks(benchmark, window=window, block_words=block_words, part_words=part_words)

    def search(piece: Piece, phrases: Phrases, again: bool, cleaned: bool) -> pa.RecordBatch:
        first, end, before, codes = words_of(piece.data, piece.starts)
        n, old = len(piece), piece.rows
        hit, pairs = find(phrases, codes, before)
        del codes
        items: list[list[str]] = old.column(old.schema.get_field_index("items")).to_pylist() if again else [[] for _ in range(n)]
        for row, item in pairs.tolist():
            items[row].append(phrases.names[item])
        if again:
            spans = old.column(old.schema.get_field_index("spans"))
            row = np.repeat(np.arange(n), spans.value_lengths().to_numpy(zero_copy_only=False))
            change = np.zeros(len(hit) + 1, np.int32)
            for name, by in (("start", 1), ("end", -1)):
                np.add.at(change, np.searchsorted(first, piece.starts[row] + spans.flatten().field(name).to_numpy(zero_copy_only=False)), by)
            hit |= np.cumsum(change[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(hit)])
        found: list[list[dict]] = [[] for _ in range(n)]
        changed, texts = [], []
        for row in np.flatnonzero(np.diff(total[before])):
            own = hit[before[row]:before[row + 1]].astype(np.int8)
            step = np.diff(own, prepend=0, append=0)
            begin = first[before[row] + np.flatnonzero(step == 1)] - piece.starts[row]
            stop = end[before[row] + np.flatnonzero(step == -1) - 1] - piece.starts[row]
            found[row] = [{"start": a, "end": b} for a, b in zip(begin.tolist(), stop.tolist())]
            if cleaned:
                text = piece.text(row)
                sides = [text[a:b].strip(b" ") for a, b in zip([0, *stop.tolist()], [*begin.tolist(), len(text)])]
                texts.append(b" ".join(x for x in sides if x))
                changed.append(row)
        kept = [k for k, name in enumerate(old.schema.names) if name not in added]
        columns = [old.column(k) for k in kept]
        if texts:
            at = [old.schema.names[k] for k in kept].index("text")
            mask = np.zeros(n, bool)
            mask[changed] = True
            columns[at] = pc.replace_with_mask(columns[at], pa.array(mask), pa.array(texts, pa.binary()).cast(columns[at].type))
        new = [pa.array(np.diff(before)), pa.array(np.diff(total[before])), pa.array([sorted(set(x)) for x in items], added["items"]), pa.array(found, added["spans"])]
        return pa.RecordBatch.from_arrays(columns + new, names=[*(old.schema.names[k] for k in kept), *added])

    for k in range(count):
        block = spark.sparkContext.broadcast(Phrases([(r.name, r.text) for r in table.where(F.col("block") == k).select("name", "text").collect()], window))
        last = k == count - 1

        def run(batches: Iterator[pa.RecordBatch], block=block, again=k > 0, cleaned=clean and last) -> Iterator[pa.RecordBatch]:
            return (search(piece, block.value, again, cleaned) for piece in pieces(batches, limit=SHARD))

        marked = marked.mapInArrow(run, schema)
        if not last:
            marked = written(marked, "marked")
            block.destroy()
    return marked


def digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document with counts, and the digest of the ids of the items that occur in it."""
    marked = mark(documents.select("doc_id", "text"), benchmark)
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without the passages of the benchmark; one that has nothing else goes. ``n_chars`` follows the text."""
    marked = mark(documents, benchmark, clean=True)
    kept = marked.where((F.col("n_hit") == 0) | (F.col("n_words") > F.col("n_hit")))
    if "n_chars" in documents.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_hit") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*[F.col(f"`{c}`") for c in documents.columns])
