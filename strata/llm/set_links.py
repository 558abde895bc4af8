"""Links between texts whose sets of word shingles are similar, found from banded buckets of any kind.

A text is known by the MD5 of its bytes. The members of a bucket are candidates of one of them, its head, only: a
star, whose pairs grow with the bucket. Members of a bucket that the stars leave in different components go on to
their rarest shingles: stars again, of which each shingle has one, and at last the exact join of what is still
apart (``prefix_pairs``). Each pair is confirmed on whole sets; a head's set goes to a task once for ``SPLIT`` members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.batches import PIECE, Hashes, Piece, lower_table, mix, space_table, word_bounds
from strata.llm.components import components
from strata.llm.repeats import unzipped, written, zipped

#: Members that are compared with a head in one group.
SPLIT = 250
#: Rounds of stars over rare shingles before what is left is joined pair by pair.
STARS = 1
#: Four bits of each bin of a sketch, packed into longs.
BITS, WORD_BITS = 4, 64
#: Standard deviations that the agreement of two sketches may stay under its mean; less is passed over (2 in 10^8).
SIGMAS = 5.5
LOWER, GAPS = lower_table(), space_table()


def shingles(piece: Piece, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Different shingle hashes of each text in order, and where each text's begin; fewer words: one shingle of all, no words: none."""
    data = LOWER[piece.data]
    first, end, before = word_bounds(data, piece.starts, GAPS)
    words = np.diff(before)
    size = np.minimum(words, width)
    count = np.where(words > 0, words - size + 1, 0)
    row = np.repeat(np.arange(len(piece)), count)
    place = before[row] + np.arange(len(row)) - (np.cumsum(count) - count)[row]
    values = mix(Hashes(mix(Hashes(data).of(first, end)), 1).of(place, place + size[row]))
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[new], np.searchsorted(row[new], np.arange(len(piece) + 1))


def node_of(text: Column) -> Column:
    return F.unhex(F.md5(text))


def lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.view(np.int64)))


def sets_of(documents: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``(node, set)`` of the texts that ``nodes`` names. Copies of a text become one row before they are shuffled, compressed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in unzipped(batches, PIECE):
            yield pa.RecordBatch.from_arrays([piece.rows.column(0), lists(*shingles(piece, width))], names=["node", "set"])

    texts = documents.where("text IS NOT NULL").select(node_of(F.col("text")).alias("node"), "text").mapInArrow(zipped, "node binary, text binary").dropDuplicates(["node"])
    return written(texts.join(nodes.select("node").distinct(), "node", "left_semi").mapInArrow(run, "node binary, set array<long>"), "sets")


def _similar(batches: Iterator[pa.RecordBatch], per_cent: int) -> Iterator[pa.RecordBatch]:
    """From rows (head, salt, member or null, set), sorted so that a head's own row leads its members: the similar pairs."""
    head = np.zeros(0, np.uint64)
    for batch in batches:
        heads, members, column = batch.column(0), batch.column(2), batch.column(3)
        starts = column.offsets.to_numpy().astype(np.int64)
        values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
        leads = np.flatnonzero(~members.is_valid().to_numpy(zero_copy_only=False))
        near = np.zeros(batch.num_rows, bool)
        for lead, last in zip([-1, *leads.tolist()], [*leads.tolist(), batch.num_rows]):
            if lead >= 0:  # the rows before the first lead belong to the head of the batch before
                head = values[starts[lead]:starts[lead + 1]].copy()
            first = lead + 1
            if first == last or not len(head):
                continue
            own = values[starts[first]:starts[last]]
            at = np.minimum(np.searchsorted(head, own), len(head) - 1)
            total = np.concatenate([[0], np.cumsum(head[at] == own)])
            common = np.diff(total[starts[first:last + 1] - starts[first]])
            sizes = np.diff(starts[first:last + 1])
            near[first:last] = 100 * common >= per_cent * (sizes + len(head) - common)
        found = pa.array(np.flatnonzero(near))
        yield pa.RecordBatch.from_arrays([members.take(found), heads.take(found)], names=["a", "b"])


def confirmed(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sets have 100 * intersection >= per_cent * union, written. ``b`` may be the head of very many."""
    count = written(pairs.groupBy(F.col("b").alias("h")).count(), "heads")
    salted = pairs.join(count, F.col("b") == F.col("h")).select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("count") / SPLIT)).alias("salt"))
    salted = written(salted, "salted")
    members = salted.join(sets, F.col("a") == F.col("node")).select("b", "salt", "a", "set")
    heads = salted.select("b", "salt").distinct().join(sets, F.col("b") == F.col("node")).select("b", "salt", F.lit(None).cast("binary").alias("a"), "set")
    rows = members.unionByName(heads).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
    return written(rows.mapInArrow(lambda batches: _similar(batches, per_cent), "a binary, b binary"), "similar")


def packed(sketch: np.ndarray) -> np.ndarray:
    """The low bits of all bins of each sketch, as rows of longs."""
    per = WORD_BITS // BITS
    low = (mix(sketch) & np.uint64(2**BITS - 1)).reshape(len(sketch), -1, per) << np.arange(0, WORD_BITS, BITS, dtype=np.uint64)
    return np.bitwise_or.reduce(low, axis=2)


def _differ(one: str, two: str, words: int) -> str:
    """SQL for the number of bins whose low bits differ."""
    spread = "|".join(f"shiftrightunsigned({one}[{{0}}] ^ {two}[{{0}}], {k})" for k in range(BITS))
    mask = sum(1 << k for k in range(0, WORD_BITS, BITS))
    return " + ".join(f"bit_count(({spread.format(w)}) & {mask}L)" for w in range(words))


def _may_differ(bins: int, per_cent: int, sigmas: float) -> int:
    """Bins in which the sketches of two sets at the limit differ, with ``sigmas`` standard deviations more."""
    agree = per_cent / 100 + (1 - per_cent / 100) / 2**BITS
    return int(bins * (1 - agree) + sigmas * (bins * agree * (1 - agree)) ** 0.5) + 1


def rare_shingles(involved: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """``node, size, left, token, sketch``: the rare shingles of each involved text that others have as well, written.

    Shingles are ordered by how many involved texts have them, rarest first; ``left`` counts those from this one
    on. Two similar sets have one of the first ``size - ceil(t * size) + 1`` of either in common.
    """
    inside = involved.join(sets, "node").select("node", "size", F.explode("set").alias("token"))
    counts = written(inside.groupBy(F.col("token").alias("t")).count().where("count > 1"), "shared")
    ranked = inside.join(counts, F.col("token") == F.col("t"), "left").select("node", "size", "token", F.coalesce("count", F.lit(1)).alias("n"))
    length = F.expr(f"size - (({per_cent} * size + 99) div 100) + 1")
    rare = ranked.groupBy("node", "size").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "token"))), 1, F.max(length).cast("int")).alias("rare"))
    posted = rare.select("node", "size", F.posexplode("rare").alias("at", "x")).where("x.n > 1").select(F.col("node").alias("m"), "size", (F.col("size") - F.col("at")).alias("left"), F.col("x.token").alias("token"))
    return written(posted.join(involved.select("node", "sketch"), F.col("m") == F.col("node")).drop("m"), "rare")


def _open(posted: DataFrame, roots: DataFrame) -> DataFrame:
    """Rare shingles that stand in several components, with ``comp`` and the one that has the shingle most often."""
    placed = posted.join(roots, F.col("node") == F.col("m"), "left").select(*posted.columns, F.coalesce("root", "node").alias("comp"))
    placed = written(placed, "placed")
    spread = placed.groupBy(F.col("token").alias("t"), F.col("comp").alias("c")).count().groupBy("t").agg(F.max_by("c", "count").alias("most"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    return written(placed.join(written(spread, "spread"), F.col("token") == F.col("t")).drop("t", "comps"), "open")


def _near(met: DataFrame, per_cent: int, bins: int, sigmas: float = SIGMAS) -> DataFrame:
    """Of rows with the columns of two texts (the other's with ``x_``): the different pairs that can be similar, written.

    The first rare shingle that similar sets have in common stands so early in both that the rest can still hold
    their intersection; and their sketches do not differ in too many bins.
    """
    p = per_cent
    met = met.where(f"100 * least(size, x_size) >= {p} * greatest(size, x_size) AND {100 + p} * least(left, x_left) >= {p} * (size + x_size)")
    met = met.where(f"{_differ('sketch', 'x_sketch', bins * BITS // WORD_BITS)} <= {_may_differ(bins, p, sigmas)}")
    return written(met.select("node", "x_node").distinct().select(F.col("node").alias("a"), F.col("x_node").alias("b")), "rare-pairs")


def _renamed(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"x_{c}") for c in ("node", "comp", "size", "token", "left", "sketch")])


def star_pairs(posted: DataFrame, roots: DataFrame, per_cent: int, bins: int, seed: int) -> DataFrame:
    """Pairs ``(a, b)`` of each text with one text, ``b``, of each of its rare shingles, in different components."""
    rows = _open(posted, roots)
    chosen = rows.groupBy("token").agg(F.min_by(F.struct("node", "comp", "size", "left", "sketch"), F.xxhash64(F.lit(seed), "node")).alias("x"))
    heads = _renamed(written(chosen.select("token", "x.*"), "chosen"))
    return _near(rows.join(heads, F.col("token") == F.col("x_token")).where("comp <> x_comp"), per_cent, bins)


def prefix_pairs(posted: DataFrame, roots: DataFrame, per_cent: int, bins: int, sigmas: float = SIGMAS) -> DataFrame:
    """All pairs ``(a, b)`` of texts of different components that can be similar by their rare shingles and sketches.

    Texts of one template differ in so many rare shingles that they hardly meet. ``roots``: (m, root).
    """
    rows = _open(posted, roots)
    x = _renamed(rows.where("comp <> most"))
    # of a pair outside the most frequent component, which both sides hold, one order is enough
    return _near(x.join(rows, F.col("x_token") == F.col("token")).where("comp <> x_comp AND (comp = most OR node < x_node)"), per_cent, bins, sigmas)


def links(documents: DataFrame, marks: DataFrame, width: int, per_cent: int, bins: int) -> DataFrame:
    """``(a, b)``: nodes of similar texts, so many that all similar texts that share a bucket are connected.

    ``marks``: ``node, size, bands, sketch`` (packed) of texts with words, a row for each different text.
    """
    named = marks.select(F.xxhash64("node").alias("short"), "node", "size")  # two nodes of one short name share their candidates
    every = marks.select(F.explode("bands").alias("band"), F.xxhash64("node").alias("short"))
    heads = written(every.groupBy(F.col("band").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("short").alias("head")).where("n > 1"), "buckets")
    met = written(every.join(heads, F.col("band") == F.col("k")).where("short <> head").select("band", "short", "head", "n"), "met")
    pairs = met.select("short", "head").distinct().join(named, "short").select(F.col("node").alias("a"), F.col("size").alias("x"), "head")
    pairs = pairs.join(named, F.col("head") == F.col("short")).where(f"100 * least(size, x) >= {per_cent} * greatest(size, x)")
    pairs = written(pairs.select("a", F.col("node").alias("b")), "stars")
    met = written(met.where("n > 2").select("band", "short").join(named, "short").select("band", "node", "size"), "crowds")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(met.select("node"))
    sets = sets_of(documents, nodes, width)
    near = confirmed(pairs, sets, per_cent)

    def roots() -> DataFrame:
        return components(near).select(F.col("node").alias("m"), "root")

    labelled = met.join(roots(), F.col("node") == F.col("m"), "left").select("band", "node", "size", F.coalesce("root", "node").alias("comp"))
    labelled = written(labelled, "labelled")
    split = written(labelled.groupBy(F.col("band").alias("k")).agg(F.min("comp").alias("one"), F.max("comp").alias("other")).where("one <> other").select("k"), "split")
    involved = labelled.join(split, F.col("band") == F.col("k")).select("node", "size").distinct()
    involved = written(involved.join(marks.select(F.col("node").alias("m"), "sketch"), F.col("node") == F.col("m")).drop("m"), "involved")
    posted = rare_shingles(involved, sets, per_cent)
    for seed in range(STARS):
        near = near.unionByName(confirmed(star_pairs(posted, roots(), per_cent, bins, seed), sets, per_cent))
    for sigmas in (0.0, SIGMAS):  # pairs that look similar first: what they join needs no others
        near = near.unionByName(confirmed(prefix_pairs(posted, roots(), per_cent, bins, sigmas), sets, per_cent))
    return near
