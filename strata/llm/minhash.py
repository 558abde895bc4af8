"""MinHash near-duplicates by one-permutation hashing with optimal densification.

One hash of each shingle does for all: its upper part names a bin, and the least hash of a bin is the bin's
value. An empty bin takes the value of the first full one in a random order of its own, the same for all texts,
so that bins agree with the probability of the Jaccard similarity. Bands of bins are buckets; their members
are joined to stars, and ``set_links`` confirms and completes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import set_links
from strata.llm.batches import mix, pieces
from strata.llm.components import components
from strata.llm.repeats import written

SHINGLE, PER_CENT = 4, 80
#: A pair at similarity 0.8 agrees in no band with probability (1 - 0.8^5)^32, 3 in a million, and less above.
BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
#: ``ORDER[bin]``: the place of each other bin in the order that an empty bin goes by.
ORDER = np.argsort(np.random.default_rng(47).random((BINS, BINS)), axis=1).astype(np.int16)


def sketches(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bins of each set, no bin left empty. The hashes of a set are in order; no set may be empty."""
    n = len(starts) - 1
    row = np.repeat(np.arange(n), np.diff(starts))
    cell = row * BINS + ((values >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    least = np.ones(len(cell), bool)
    least[1:] = cell[1:] != cell[:-1]  # bins are in the order of hashes
    full, out = np.zeros(n * BINS, bool), np.zeros(n * BINS, np.uint64)
    full[cell[least]] = True
    out[cell[least]] = values[least]
    full, out = full.reshape(n, BINS), out.reshape(n, BINS)
    for i in np.flatnonzero(~full.all(axis=1)):
        have, empty = np.flatnonzero(full[i]), np.flatnonzero(~full[i])
        out[i, empty] = out[i, have[ORDER[np.ix_(empty, have)].argmin(axis=1)]]
    return out


def bands(sketch: np.ndarray) -> np.ndarray:
    """Bucket of each band of each sketch."""
    out = np.empty((len(sketch), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sketch), band, np.uint64)
        for at in range(band * ROWS, (band + 1) * ROWS):
            key = mix(key ^ sketch[:, at]) * np.uint64(0x9E3779B97F4A7C15)
        out[:, band] = key
    return out


def marks(documents: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``node, size, bands, sketch`` (packed) of every text, row by row; without words: size 0 and empty lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            values, starts = set_links.shingles(piece, width)
            have = np.diff(starts) > 0
            sketch = sketches(values, np.append(starts[:-1][have], len(values))) if have.any() else np.zeros((0, BINS), np.uint64)
            before = np.concatenate([[0], np.cumsum(have)])
            keys, low = bands(sketch), set_links.packed(sketch)
            others = [c for k, c in enumerate(piece.rows.columns) if piece.rows.schema.names[k] != "text"]
            names = [c for c in piece.rows.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*others, pa.array(np.diff(starts)), set_links.lists(keys.ravel(), before * BANDS), set_links.lists(low.ravel(), before * low.shape[1])], names=[*names, "size", "bands", "sketch"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in documents.schema if f.name != "text")
    source = documents.withColumn("node", set_links.node_of(F.coalesce("text", F.lit(""))))
    return source.mapInArrow(run, f"{fields}node binary, size long, bands array<long>, sketch array<long>")


def links(named: DataFrame, documents: DataFrame, width: int, per_cent: int = PER_CENT) -> DataFrame:
    """``(a, b)``: nodes (MD5 of the text) of similar texts, so many that all similar ones are connected; ``named``: written ``marks``."""
    distinct = named.where("size > 0").select("node", "size", "bands", "sketch").dropDuplicates(["node"])
    return set_links.links(documents, written(distinct, "nodes"), width, per_cent, BINS)


def near(documents: DataFrame, *, width: int, per_cent: int = PER_CENT) -> DataFrame:
    """``links`` of the texts of ``documents``. Null texts and texts without a word have none, copies count once."""
    return links(written(marks(documents.select("text"), width), "marks"), documents, width, per_cent)


def classes(documents: DataFrame, *, width: int = SHINGLE, per_cent: int = PER_CENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: the least ``doc_id`` that links reach, and whether it is the row's own.

    Texts link if their sets of ``width``-word shingles have 100 * intersection >= per_cent * union; a text of fewer words
    has one shingle. Null texts and texts without words have an empty set and link with nothing: their component is
    their own id. Equal texts always link, so rows that repeat share a component and are all kept if it is theirs. A null
    id is a component's id only if it has no other. Texts count whole, however long; an empty table stays empty.
    """
    named = written(marks(documents.select("doc_id", "text"), width), "marks")
    roots = components(links(named, documents, width, per_cent)).select(F.col("node").alias("m"), "root")
    least = named.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = written(least.join(roots, F.col("node") == F.col("m"), "left").select("node", "least", F.coalesce("root", "node").alias("root")), "rooted")
    ids = written(rooted.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("id")), "ids")
    labels = written(rooted.join(ids, F.col("root") == F.col("r")).select(F.col("node").alias("m"), "id"), "labels")
    out = named.select("doc_id", "node", "size").join(labels, F.col("node") == F.col("m"), "left")
    component = F.when(F.col("size") > 0, F.col("id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def digest(documents: DataFrame) -> DataFrame:
    return classes(documents)
