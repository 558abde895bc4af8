"""SimHash near-duplicates: exact links within a Hamming radius by a vantage-point tree over the fingerprints.

The tree is fitted on a bounded sample; every inner node has a vantage fingerprint and a distance. A
fingerprint goes left up to that distance and right above it, and right as well if it lies so close under the
boundary that something within the radius can be beyond it (triangle inequality). Each leaf is a shard: two
linked fingerprints meet in at least one. A leaf links its members into stars of its own, of which Spark makes components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.batches import SPACES, Piece, lower_table, pieces, space_table, word_bounds
from strata.llm.components import components
from strata.llm.set_links import node_of
from strata.session import scratch_path

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Different fingerprints in a leaf, and in the sample that the tree is fitted on.
LEAF, SAMPLE = 1024, 60_000
LOWER, GAPS = lower_table(), space_table()


def fingerprints(piece: Piece, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprint of each text: a bit is 1 if over half of its shingles' hashes have it; no words: 0."""
    out = np.zeros(len(piece), np.uint64)
    data = LOWER[piece.data]
    first, end, before = word_bounds(data, piece.starts, GAPS)
    if not len(first):
        return out
    if len(SPACES) and np.any(end[:-1] + 1 != first[1:]) or np.any(data[end[:-1]] != 0x20):
        lengths = end - first  # write the words joined by one space each
        target = np.concatenate([[0], np.cumsum(lengths + 1)])
        joined = np.full(target[-1], 0x20, np.uint8)
        source = np.repeat(first - target[:-1], lengths + 1) + np.arange(target[-1])
        inner = np.arange(target[-1]) < np.repeat(target[:-1] + lengths, lengths + 1)
        joined[inner] = data[source[inner]]
        data, first, end = joined, target[:-1], target[1:] - 1
    text, digest = data.tobytes(), xxhash.xxh64_intdigest
    counts = np.diff(before)
    for row in np.flatnonzero(counts):
        a, b = before[row], before[row + 1]
        width = min(shingle, b - a)
        hashes = np.array([digest(text[s:e], SEED) for s, e in zip(first[a:b - width + 1].tolist(), end[a + width - 1:b].tolist())], np.uint64)
        ones = np.zeros(64, np.int64)
        for part in range(0, len(hashes), 8192):
            ones += np.unpackbits(hashes[part:part + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[row] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return out


def distances(values: np.ndarray, one: np.uint64 | np.ndarray) -> np.ndarray:
    return np.bitwise_count(values ^ one).astype(np.int64)


def _split(values: np.ndarray, rng: np.random.Generator, radius: int) -> tuple[np.uint64, int] | None:
    """Vantage fingerprint and distance with the fewest members near the boundary, each side having at least a quarter."""
    best = None
    for vantage in rng.choice(values, min(8, len(values)), replace=False):
        count = np.bincount(distances(values, vantage), minlength=65)
        left = np.cumsum(count)
        near = left - np.concatenate([np.zeros(radius, np.int64), left[:-radius]])
        fair = (left >= len(values) / 4) & (left <= len(values) * 3 / 4)
        for cut in np.flatnonzero(fair):
            if best is None or near[cut] < best[0]:
                best = (near[cut], vantage, int(cut))
    return None if best is None or best[0] > len(values) / 2 else (best[1], best[2])


@dataclass
class Tree:
    """Inner nodes in order; a child is a node, or a leaf as ``-1 - leaf``. Without nodes there is leaf 0 alone."""

    vantage: np.ndarray
    cut: np.ndarray
    children: np.ndarray
    radius: int

    def leaves(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf and index of the value, for each leaf that each value belongs to."""
        node = np.full(len(values), 0 if len(self.cut) else -1, np.int64)
        which = np.arange(len(values))
        done = []
        while len(node):
            final = node < 0
            done.append((-1 - node[final], which[final]))
            node, which = node[~final], which[~final]
            far, cut = distances(values[which], self.vantage[node]), self.cut[node]
            left, right = far <= cut, far > cut - self.radius
            node, which = np.concatenate([self.children[node[left], 0], self.children[node[right], 1]]), np.concatenate([which[left], which[right]])
        return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])


def fit(sample: np.ndarray, total: int, *, radius: int = RADIUS, leaf: int = LEAF, seed: int = 5) -> Tree:
    """Tree whose leaves hold about ``leaf`` of ``total`` different fingerprints, as far as the sample lets it see."""
    rng, scale = np.random.default_rng(seed), total / max(1, len(sample))
    vantage, cut, children, leaves = [], [], [], 0
    todo = [(sample, -1, 0)]
    while todo:
        own, parent, side = todo.pop()
        split = _split(own, rng, radius) if len(own) * scale > leaf and len(own) >= 16 else None
        if split is None:
            name, leaves = -1 - leaves, leaves + 1
        else:
            name, far = len(cut), distances(own, split[0])
            vantage.append(split[0])
            cut.append(split[1])
            children.append([0, 0])
            todo += [(own[far <= split[1]], name, 0), (own[far > split[1] - radius], name, 1)]
        if parent >= 0:
            children[parent][side] = name
    return Tree(np.array(vantage, np.uint64), np.array(cut, np.int64), np.array(children, np.int64).reshape(-1, 2), radius)


def stars(values: np.ndarray, radius: int = RADIUS, limit: int = 4 * LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Links of distinct fingerprints to one member of their component inside this set: at most one each.

    A set over ``limit`` is split by vantage points of its own as long as that separates anything.
    """
    if len(values) > limit and (split := _split(values, np.random.default_rng(len(values)), radius)):
        far = distances(values, split[0])
        sides = [stars(values[part], radius, limit) for part in (far <= split[1], far > split[1] - radius)]
        return np.concatenate([s[0] for s in sides]), np.concatenate([s[1] for s in sides])
    members, heads, left = [], [], values
    while len(left) > 1:
        head, left = left[0], left[1:]
        front = [head]
        while front and len(left):
            near = np.bitwise_count(left ^ front.pop()) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                members.append(found)
                heads.append(np.full(len(found), head))
                front.extend(found)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(members), np.concatenate(heads)) if members else (none, none)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def with_fingerprint(documents: DataFrame) -> DataFrame:
    """``documents`` with ``fingerprint`` (its 64 bits as a long); a column of that name is replaced."""
    source = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c.lower() != "fingerprint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            columns = [*piece.rows.columns, _signed(fingerprints(piece))]
            yield pa.RecordBatch.from_arrays(columns, names=[*piece.rows.schema.names, "fingerprint"])

    return source.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + ", fingerprint long")


def linked(prints: DataFrame, *, radius: int = RADIUS, leaf: int = LEAF, sample: int = SAMPLE, more: DataFrame | None = None) -> DataFrame:
    """``(node, root)`` for the fingerprints of ``prints`` that have another within ``radius`` bits, all pairs considered.

    Equal fingerprints count once, so groups of copies add nothing. Nulls are left out. ``more`` are links
    ``(a, b)`` of fingerprints that hold besides.
    """
    distinct = prints.where("fingerprint IS NOT NULL").select("fingerprint").distinct()
    total = distinct.count()
    part = [r[0] for r in distinct.sample(min(1.0, sample / max(1, total)), seed=11).limit(2 * sample).collect()]
    tree = fit(np.array(sorted(part), np.int64).view(np.uint64), total, radius=radius, leaf=leaf)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            leaves, which = tree.leaves(values.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(leaves), pa.array(values[which])], names=["leaf", "fingerprint"])

    def link(group: pa.Table) -> pa.Table:
        member, head = stars(np.sort(group.column("fingerprint").to_numpy()).view(np.uint64), radius)
        return pa.table({"a": _signed(member), "b": _signed(head)})

    met = distinct.mapInArrow(route, "leaf long, fingerprint long").groupBy("leaf").applyInArrow(link, "a long, b long")
    return components(met if more is None else met.unionByName(more))


def _prints(documents: DataFrame) -> DataFrame:
    """``doc_id, node, fingerprint`` of each row; the node is the MD5 of the text (null: empty)."""
    path = scratch_path(documents.sparkSession, "prints")
    with_fingerprint(documents.select("doc_id", "text", node_of(F.coalesce("text", F.lit(""))).alias("node"))).drop("text").write.parquet(path)
    return documents.sparkSession.read.parquet(path)


def _named(prints: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """``doc_id, fingerprint, root, component_id`` for each row of ``prints``; the root is one fingerprint of the component."""
    groups = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    roots = linked(prints, more=more)
    rooted = groups.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select(F.col("fingerprint").alias("__f"), "root", "component_id")
    return prints.join(named, F.col("fingerprint") == F.col("__f")).select("doc_id", "fingerprint", "root", "component_id")


def classes(documents: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (a long) and ``component_id``, the least ``doc_id`` that links reach from the document.

    Null and empty texts have fingerprint 0 and link like any others. Rows that repeat have the same
    fingerprint. A null id is never a component's id unless the component has no other.
    """
    return _named(_prints(documents)).select("doc_id", "fingerprint", "component_id")


def digest(documents: DataFrame) -> DataFrame:
    return classes(documents).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """One row of each component, with its own columns: that with the least id, a null id only if there is no other.

    If rows of the component share that id, or it is null, the one with the least text of them stays, and of
    equal ones one. An id that stands on one row alone finds its row; only the rows of null and shared ids are
    told apart by their fingerprints. ``more`` are links ``(a, b)`` of texts, by the MD5 of each, that hold besides.
    """
    spark, prints = documents.sparkSession, _prints(documents)
    if more is not None:
        by_node = prints.select("node", "fingerprint").distinct()
        more = more.join(by_node.withColumnsRenamed({"node": "a", "fingerprint": "x"}), "a").join(by_node.withColumnsRenamed({"node": "b", "fingerprint": "y"}), "b")
        more = more.select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct()
    path = scratch_path(spark, "kept")
    first = _named(prints, more).where("doc_id <=> component_id").select("doc_id", "fingerprint", "root").distinct()
    first.select(*[F.col(c).alias(f"__{c}") for c in first.columns]).write.parquet(path)
    first = spark.read.parquet(path)
    path = scratch_path(spark, "shared")
    prints.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("__shared")).write.parquet(path)
    shared = spark.read.parquet(path)
    own = [F.col(f"`{c}`") for c in documents.columns]
    single = first.where("__doc_id IS NOT NULL").join(shared, F.col("__doc_id") == F.col("__shared"), "left_anti")
    once = documents.join(single, F.col("doc_id") == F.col("__doc_id")).select(*own)
    unsure = documents.where("doc_id IS NULL").unionByName(documents.join(shared, F.col("doc_id") == F.col("__shared"), "left_semi"))
    packed = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(own)]).alias("__row")
    met = with_fingerprint(unsure.select("doc_id", "text", packed)).join(first, F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("fingerprint") == F.col("__fingerprint")))
    best = met.groupBy("__root").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("t"), F.col("__row").alias("row"))).alias("best"))
    return once.unionByName(best.select(*[F.col(f"best.row.c{i}").alias(c) for i, c in enumerate(documents.columns)]))
