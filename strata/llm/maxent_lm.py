"""Hashed maximum-entropy language model with a class-factored softmax.

P(token | history) = P(class | history) * P(slot | class, history) * P(token | slot): a softmax over classes, a softmax
over the slots of a class, both with weights for features of the history, and an add-one estimate inside a slot with
one unseen token, so the probabilities sum to one. A slot is one frequent token or a few units of a class. The features are the
previous token, the token two back and, for classes, also the previous two tokens and the token three back (each hashed into a table
of rows whose number follows the training tokens up to ``MOST``), and the classes of the previous tokens. Spark counts what is seen with
each row over all training tokens, which gives the first weights; then each gradient step is a job over all
training tokens that sums expected counts by row, and steps go on until these agree with the counts.

Three passes read the texts: counts, neighbours (from which the classes come), codes; training and scores read the codes. What
a task holds is bounded by the model's parameters; counts beyond the broadcast table are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.batches import Hashes, Piece, flat, lower_table, mix, pieces, space_table, word_bounds
from strata.llm.repeats import KEY, keyed
from strata.session import scratch_path

#: Most frequent tokens that every task gets a table of (24 bytes each), and those with a class of their own.
TABLE, OWN = 400_000, 8_192
#: Classes, slots of a class, endings that give the other tokens their class, buckets of neighbours.
CLASSES, SLOTS, ENDINGS, NEIGHBOURS = 16, 16, 512, 32
#: Kinds of hashed features of both softmaxes; rows of the table of a kind at least and at most, training tokens for each row.
KINDS, LEAST, MOST, PER_ROW = (4, 2), 2**8, 2**17, 2**12
#: Rate of the first gradient step; what is added to counts of a row, and the share of its log ratio that a row starts with.
RATE, PRIOR, START = 1.0, 8.0, 0.35
#: Training ends when all slopes of a table (observed less expected counts and penalty) add up to this share of the observed counts.
CLOSE = 0.01
SEED = 31
#: Tokens that are evaluated at once, rows of a table that are summed as one block.
CHUNK, BLOCK = 8_192, 4_096
#: Tokens whose features are listed at once, unless a text is longer by itself.
SPAN = 131_072
#: Bytes of text in a piece of the counting passes.
LIMIT = 1_500_000
LOWER, GAPS = lower_table(), space_table()
#: Code and ending of the token that ends each text.
END, END_ENDING = np.uint64(0x9E3779B97F4A7C15), 0
UNITS = OWN + ENDINGS


def training(key: str = "doc_id") -> Column:
    """True for training documents: crc32 of the id as text, mod 7, is not 2. A null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")) % 7 != 2


def tokens(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit codes and the ending of each token, and the number of tokens before each row; every text has an end."""
    data = LOWER[piece.data]
    first, end, before = word_bounds(data, piece.starts, GAPS)
    n = len(piece)
    place = np.arange(len(first)) + np.repeat(np.arange(n), np.diff(before))
    one = Hashes(data)
    out = []
    for values, last, kind in ((mix(one.of(first, end)), END, np.uint64), (mix(Hashes(data, 1).of(first, end)), END, np.uint64), (mix(one.of(np.maximum(first, end - 3), end)) % np.uint64(ENDINGS), END_ENDING, np.int64)):
        column = np.full(len(first) + n, last, kind)
        column[place] = values
        out.append(column)
    return out[0], out[1], out[2], before + np.arange(n + 1)


def counts(docs: DataFrame) -> DataFrame:
    """``h, g, ending, c``: how often each token stands in ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=LIMIT):
            h, g, ending, _ = tokens(piece)
            _, at, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(g[at].view(np.int64)), pa.array(ending[at]), pa.array(n)], names=["h", "g", "ending", "n"])

    return docs.select("text").mapInArrow(run, "h long, g long, ending long, n long").groupBy("h", "g").agg(F.first("ending").alias("ending"), F.sum("n").alias("c"))


@dataclass
class Model:
    """What the tasks need: the table of frequent tokens by code, the classes of units, and later the class probabilities."""

    codes: np.ndarray  # sorted
    count: np.ndarray
    unit: np.ndarray
    total: int
    distinct: int
    class_of: np.ndarray | None = None
    slot_of: np.ndarray | None = None
    slot_log: np.ndarray | None = None  # log10 of the denominator of P(token | slot), by class and slot
    buckets: int = LEAST
    weights: list[np.ndarray] | None = None  # of the softmax over classes and of that over slots

    def look_up(self, h: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each token in the table, 0 beyond it, and its unit."""
        if not len(self.codes):
            return np.zeros(len(h), np.int64), OWN + ending
        at = np.searchsorted(self.codes, h)
        at[at == len(self.codes)] = 0
        here = self.codes[at] == h
        unit = np.where(here, self.unit[at], -1)
        return np.where(here, self.count[at], 0), np.where(unit >= 0, unit, OWN + ending)


def _shifted(values: np.ndarray, before: np.ndarray, steps: int, start: int) -> np.ndarray:
    """The value ``steps`` tokens earlier in the same row; ``start`` where there is none."""
    out = np.full(len(values), start, values.dtype)
    out[steps:] = values[:-steps] if steps < len(values) else out[steps:]
    for place in range(steps):
        at = before[:-1] + place
        out[at[at < before[1:]]] = start
    return out


def _end_unit(model: Model) -> int:
    return int(model.look_up(np.array([END]), np.array([END_ENDING]))[1][0])


def _cells(docs: DataFrame, model: Model, size: int, cell) -> DataFrame:
    """Sums of ``cell(tokens' units, tokens before each row)`` numbers: ``cell, n`` over all of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for piece in pieces(batches):
            h, _, ending, before = tokens(piece)
            sums += np.bincount(cell(shared.value, shared.value.look_up(h, ending)[1], before), minlength=size)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["cell", "n"])

    return docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def _neighbour_cells(model: Model, unit: np.ndarray, before: np.ndarray) -> np.ndarray:
    bucket = (mix(unit.astype(np.uint64) + np.uint64(1)) % np.uint64(NEIGHBOURS)).astype(np.int64)
    end = np.zeros(len(unit), bool)
    end[before[1:] - 1] = True
    pairs = np.flatnonzero(~end[:-1])  # neighbours inside a text
    return np.concatenate([unit[pairs] * NEIGHBOURS + bucket[pairs + 1], unit[pairs + 1] * NEIGHBOURS + bucket[pairs]])


def cluster(vectors: np.ndarray, classes: int = CLASSES, seed: int = SEED) -> np.ndarray:
    """Class of each unit: k-means over the roots of its neighbours' shares, heavier units counting more."""
    weight = vectors.sum(axis=1)
    points = np.sqrt((vectors + 0.1) / (vectors + 0.1).sum(axis=1, keepdims=True))
    rng = np.random.default_rng(seed)
    heavy = np.sqrt(weight) + 1e-9
    centres = points[[int(np.argmax(weight))]]
    while len(centres) < classes:
        far = np.min([((points - c) ** 2).sum(axis=1) for c in centres], axis=0) * heavy
        centres = np.vstack([centres, points[rng.choice(len(points), p=far / far.sum()) if far.sum() > 0 else 0]])
    for _ in range(25):
        own = np.argmin(((points[:, None, :] - centres[None]) ** 2).sum(axis=2), axis=1)
        for k in range(classes):
            if (own == k).any():
                centres[k] = np.average(points[own == k], axis=0, weights=heavy[own == k])
    return own


def slots(class_of: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slot of each unit inside its class, of about equal weight: a heavy unit has one to itself, light ones share."""
    out = np.zeros(len(class_of), np.int64)
    for k in range(CLASSES):
        left, slot, held = weight[class_of == k].sum(), 0, 0.0
        own = np.flatnonzero(class_of == k)
        for u in own[np.argsort(-weight[own], kind="stable")]:
            if held and slot < SLOTS - 1 and held + weight[u] / 2 > left / (SLOTS - slot):
                left, slot, held = left - held, slot + 1, 0.0
            out[u] = slot
            held += weight[u]
    return out


def _features(history: np.ndarray | None = None) -> list[np.ndarray]:
    """For each history of three classes (default: all), the number of its row in the table without hashing."""
    return [np.arange(CLASSES**3) if history is None else history]


def feature_rows(codes: np.ndarray, kind: np.ndarray, before: np.ndarray, end: int, end_kind: int, buckets: int) -> list[list[np.ndarray]]:
    """Rows of each token's features in the two weight tables: that of classes, and that of slots of its class ``kind``.

    The hashed kinds come first, ``buckets`` rows each: previous token, token two back and, only for classes, previous two tokens and
    token three back. Then a row for the classes of the previous three tokens; for slots, of the previous two and the token itself.
    """
    mixed = mix(codes.astype(np.uint64) + np.uint64(1))
    first = int(mix(np.array([end + 1], np.uint64))[0])
    one, two, three = (_shifted(mixed, before, k, first) for k in (1, 2, 3))
    a, b, c = (_shifted(kind, before, k, end_kind) for k in (1, 2, 3))
    shift, odd = np.uint64(64 - (buckets - 1).bit_length()), np.uint64(0x9E3779B97F4A7C15)
    own = (np.arange(1, CLASSES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).take(kind)
    tables: list[list[np.ndarray]] = [[], []]
    for k, key in enumerate((one, two, mix(one + np.uint64(3) * two), three)):
        for level, table in enumerate(tables):
            if k < KINDS[level]:
                row = ((key ^ own if level else key) * odd >> shift).astype(np.int32)
                row += np.int32(k * buckets)
                table.append(row)
    for level, history in enumerate(((a * CLASSES + b) * CLASSES + c, (a * CLASSES + b) * CLASSES + kind)):
        tables[level] += [(KINDS[level] * buckets + row).astype(np.int32) for row in _features(history)]
    return tables


def _sizes(buckets: int) -> list[tuple[int, int]]:
    return [(KINDS[0] * buckets + CLASSES**3, CLASSES), (KINDS[1] * buckets + CLASSES**3, SLOTS)]


def _scores(weights: list[np.ndarray], features: list[np.ndarray]) -> np.ndarray:
    """Sum of the weights of each outcome; those of a token may all be off by the same amount."""
    scores = weights[0].take(features[0], axis=0, mode="clip")
    part = np.empty_like(scores)
    for w, f in zip(weights[1:], features[1:]):
        scores += w.take(f, axis=0, out=part, mode="clip")
    if max(scores.max(initial=0), -scores.min(initial=0)) > 60:  # far from what training gives
        scores -= scores.max(axis=1, keepdims=True)
    return scores


def _log_probabilities(weights: list[np.ndarray], features: list[np.ndarray]) -> np.ndarray:
    scores = _scores(weights, features)
    return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))


def _probabilities(weights: list[np.ndarray], features: list[np.ndarray]) -> np.ndarray:
    scores = _scores(weights, features)
    np.exp(scores, out=scores)
    scores /= np.einsum("ij->i", scores)[:, None]
    return scores


def _log_probability(weights: list[np.ndarray], features: list[np.ndarray], outcome: np.ndarray) -> np.ndarray:
    """That of the outcome alone."""
    scores = _scores(weights, features)
    own = scores[np.arange(len(outcome)), outcome]
    return own - np.log(np.einsum("ij->i", np.exp(scores, out=scores)))


def _packed(values: np.ndarray, before: np.ndarray) -> pa.Array:
    """The values of each row as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(before) - 1, [None, pa.py_buffer((before * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of whole rows with about ``SPAN`` tokens: the rows, codes and units of tokens, and the number of tokens before each row."""
    for piece in pieces(batches, "codes", 4 * SPAN):
        units, _ = flat(piece.rows.column(piece.rows.schema.get_field_index("units")))
        yield piece.rows, np.frombuffer(piece.data, np.uint32), np.frombuffer(units, np.int16), piece.starts // 4


def _evaluated(model: Model, codes: np.ndarray, unit: np.ndarray, before: np.ndarray, levels: Iterable[int] = (0, 1), chunk: int = CHUNK) -> Iterator[tuple[slice, int, list[np.ndarray], np.ndarray]]:
    """For chunks of tokens and each level: the chunk, level, rows of features and outcomes."""
    kind, slot = model.class_of[unit], model.slot_of[unit]
    rows = feature_rows(codes, kind, before, int(END & np.uint64(2**32 - 1)), int(model.class_of[_end_unit(model)]), model.buckets)
    for at in range(0, len(codes), chunk):
        part = slice(at, at + chunk)
        for level in levels:
            yield part, level, [r[part].astype(np.int64) for r in rows[level]], (kind, slot)[level][part]


def observed_part(model: Model, tokens: tuple[np.ndarray, np.ndarray, np.ndarray], sums: dict[int, np.ndarray]) -> None:
    """Add how often each outcome stands with each row of features, for the levels in ``sums`` (outcomes by rows)."""
    for _, level, rows, outcome in _evaluated(model, *tokens, sums):
        flat, ones = sums[level].reshape(-1), np.ones(len(outcome))
        for r in rows:
            np.add.at(flat, outcome * sums[level].shape[1] + r, ones)


def expected_part(model: Model, tokens: tuple[np.ndarray, np.ndarray, np.ndarray], sums: dict[int, np.ndarray]) -> None:
    """Add the probability that the model gives each outcome with each row of features, for the levels in ``sums``.

    One kind of features and one outcome at a time, whose sums fit a processor's cache.
    """
    for _, level, rows, _ in _evaluated(model, *tokens, sums, SPAN):
        p = np.empty((len(sums[level]), len(rows[0])))
        for at in range(0, len(rows[0]), CHUNK):
            p[:, at:at + CHUNK] = _probabilities([model.weights[level]] * len(rows), [r[at:at + CHUNK] for r in rows]).T
        for k, r in enumerate(rows):
            first, size = k * model.buckets, model.buckets if k < KINDS[level] else CLASSES**3
            r -= first
            for added, share in zip(sums[level][:, first:first + size], p):
                added += np.bincount(r, share, size)


def _summed(coded: DataFrame, model: Model, part, levels: Iterable[int] = (0, 1)) -> list[np.ndarray]:
    """What ``part`` adds up for the weight tables of ``levels`` over all of ``coded``: each task's tables in blocks of rows, summed by block."""
    spark = coded.sparkSession
    shared = spark.sparkContext.broadcast(model)
    sizes = {level: _sizes(model.buckets)[level] for level in levels}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, some = {level: np.zeros(size[::-1]) for level, size in sizes.items()}, False
        for _, *read in _coded(batches):
            part(shared.value, read, sums)
            some = True
        for level, table in sums.items() if some else ():
            for first in range(0, sizes[level][0], BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([level], pa.int32()), pa.array([first], pa.int64()), pa.array([table[:, first:first + BLOCK].T.astype(np.float32).tobytes()])], names=["level", "first", "sums"])

    def total(group: pa.Table) -> pa.Table:
        parts = sorted(group.column("sums").to_pylist())  # one order, one result
        added = sum((np.frombuffer(p, np.float32).astype(np.float64) for p in parts[1:]), np.frombuffer(parts[0], np.float32).astype(np.float64))
        return pa.table({"level": group.column("level")[:1], "first": group.column("first")[:1], "sums": pa.array([added.tobytes()])})

    kind = "level int, first long, sums binary"
    out = {level: np.zeros(size) for level, size in sizes.items()}
    tasks = coded.coalesce(max(1, spark.sparkContext.defaultParallelism))  # a task gives whole tables once
    for level, first, sums in tasks.mapInArrow(run, kind).groupBy("level", "first").applyInArrow(total, kind).collect():  # the model's parameters
        block = np.frombuffer(sums).reshape(-1, sizes[level][1])
        out[level][first:first + len(block)] = block
    shared.destroy()
    return list(out.values())


def first_weights(observed: list[np.ndarray], buckets: int) -> list[np.ndarray]:
    """Weights before the first step: logs of an outcome's share after the classes before it, and of its share with a hashed row over that of all."""
    out = []
    for level, seen in enumerate(observed):
        base = KINDS[level] * buckets
        own = np.zeros(len(seen) - base, np.int64) if level == 0 else np.arange(len(seen) - base) % CLASSES  # what the rows of classes fall back on
        total = np.zeros((CLASSES if level else 1, seen.shape[1]))
        np.add.at(total, own, seen[base:])
        share = (total + 1) / (total + 1).sum(axis=1, keepdims=True)
        every = (total.sum(axis=0) + 1) / (total.sum(axis=0) + 1).sum()
        table = START * np.log((seen + PRIOR * every) / (seen.sum(axis=1, keepdims=True) + PRIOR) / every)
        table[base:] = np.log((seen[base:] + PRIOR * share[own]) / (seen[base:].sum(axis=1, keepdims=True) + PRIOR))
        out.append(table.astype(np.float32))
    return out


def step(weights: list[np.ndarray], observed: list[np.ndarray], expected: list[np.ndarray], rate: float = RATE) -> list[np.ndarray]:
    """Weights after a gradient step: each moves by observed less expected count over the sum of both."""
    return [(w + rate * (o - e) / (o + e + PRIOR)).astype(np.float32) for w, o, e in zip(weights, observed, expected)]


@dataclass
class Ascent:
    """One table on its way to the most likely weights: the penalty is ``PRIOR / 2`` times the squared distance from the first ones.

    The first move is ``step``. Later ones also use how the last move changed the slope (BFGS with a memory of one pair).
    """

    observed: np.ndarray
    first: np.ndarray
    scale: np.ndarray | None = None
    slope: np.ndarray | None = None  # before the last move
    move: np.ndarray | None = None

    def next(self, weights: np.ndarray, expected: np.ndarray) -> np.ndarray | None:
        """Weights after the next move, None if these are close enough."""
        slope = (self.observed - expected - PRIOR * (weights - self.first)).astype(np.float32)
        if np.abs(slope).sum(dtype=np.float64) <= CLOSE * self.observed.sum():
            return None
        if self.move is None:
            self.scale = (self.observed + expected + PRIOR).astype(np.float32)
            moved = step([weights], [self.observed], [expected])[0]
        else:
            ahead, past = _dot(self.move, self.slope), _dot(self.move, slope)
            if past < -ahead / 2:  # too far beyond the top of this line: back to where its slope would be 0
                back = self.move * np.float32(ahead / (ahead - past) - 1)
                self.move += back
                return weights + back
            change = self.slope - slope
            bend = _dot(self.move, change)
            share = _dot(self.move, slope) / bend
            aim = (slope - np.float32(share) * change) / self.scale
            aim *= np.float32(bend / _dot(change, change / self.scale))
            aim += np.float32(share - _dot(change, aim) / bend) * self.move
            moved = weights + aim
        self.slope, self.move = slope, moved - weights
        return moved


def _dot(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.einsum("ij,ij->", a, b, dtype=np.float64))


def train(coded: DataFrame, model: Model) -> list[np.ndarray]:
    """The weights of both tables, from the ``codes`` and ``units`` of all training texts.

    Each move takes the expected counts of all training tokens. A table is done when its slopes add up to at most
    ``CLOSE`` of its counts; there is no set number of moves.
    """
    observed = _summed(coded, model, observed_part)
    model.weights = first_weights(observed, model.buckets)
    paths = {level: Ascent(o.astype(np.float32), w) for level, (o, w) in enumerate(zip(observed, model.weights))}
    while paths:
        for level, expected in zip(list(paths), _summed(coded, model, expected_part, list(paths))):
            moved = paths[level].next(model.weights[level], expected)
            if moved is None:
                del paths[level]
            else:
                model.weights[level] = moved
    return model.weights


def fit(docs: DataFrame, vocabulary: DataFrame) -> Model:
    """The model of training texts ``docs`` (column ``text``) with their ``counts``, still without weights."""
    spark = docs.sparkSession
    total, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # the most frequent tokens down to a level of counts (eighths of an octave, so few levels) that keeps them within the table
    level = F.floor(F.log2("c") * 8)
    room, least = TABLE, None
    for row in sorted(vocabulary.groupBy(level.alias("level")).count().collect(), reverse=True):
        room -= row["count"]
        if room < 0:
            break
        least = row.level
    top = vocabulary.where(level >= F.lit(least)).select("h", "ending", "c").toArrow()
    codes, count, ending = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy(), top.column("ending").to_numpy()
    order = np.lexsort((codes, -count))
    codes, count, ending = codes[order], count[order], ending[order]
    unit = np.where(np.arange(len(codes)) < OWN, np.arange(len(codes)), -1)
    order = np.argsort(codes)
    model = Model(codes[order], count[order], unit[order], int(total), int(distinct))

    def dense(cells: DataFrame, size: int) -> np.ndarray:
        got = cells.toArrow()
        out = np.zeros(size)
        out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
        return out

    vectors = dense(_cells(docs, model, UNITS * NEIGHBOURS, _neighbour_cells), UNITS * NEIGHBOURS).reshape(UNITS, NEIGHBOURS)
    model.class_of = cluster(vectors)
    # tokens and different tokens of each unit: all of an ending's, less those with a unit of their own
    amounts = np.zeros((UNITS, 2))
    for e, c, n in vocabulary.groupBy("ending").agg(F.sum("c"), F.count(F.lit(1))).collect():
        amounts[OWN + e] = c, n
    own = min(OWN, len(codes))
    np.subtract.at(amounts, OWN + ending[:own], np.stack([count[:own], np.ones(own)], axis=1))
    amounts[:own] = np.stack([count[:own], np.ones(own)], axis=1)
    model.slot_of = slots(model.class_of, amounts[:, 0])
    held = np.zeros((CLASSES * SLOTS, 2))
    np.add.at(held, model.class_of * SLOTS + model.slot_of, amounts)
    model.slot_log = np.log10(held.sum(axis=1) + 1)
    model.buckets = min(MOST, max(LEAST, 2 ** int(total // PER_ROW).bit_length()))
    return model


def score(documents: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row.

    Learns from the rows of ``documents`` that ``training`` picks. Null and empty texts consist of their end. Without
    training rows every token is unseen: the base score is 0, the classes and slots are uniform. Rows that repeat
    are trained on as often as they stand and get the same scores.
    """
    spark = documents.sparkSession
    docs = keyed(documents).withColumn("held_out", ~training())
    own = docs.where("NOT held_out")
    path = scratch_path(spark, "vocabulary")
    counts(own).write.parquet(path)
    vocabulary = spark.read.parquet(path)
    model = fit(own, vocabulary)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        base = np.log10(m.total + m.distinct + 1)
        kind = pa.list_(pa.struct([("h", pa.int64()), ("g", pa.int64()), ("n", pa.int64())]))
        for piece in pieces(batches):
            h, g, ending, before = tokens(piece)
            count, unit = m.look_up(h, ending)
            codes = (h & np.uint64(2**32 - 1)).astype(np.uint32)
            add = lambda x: np.add.reduceat(x, before[:-1])  # noqa: E731  no row is without tokens
            known = add(np.log10(count + 1.0))
            row = np.repeat(np.arange(len(piece)), np.diff(before))
            rest = np.flatnonzero(count == 0)  # counts beyond the table: one entry for each different token of a text
            rest = rest[np.lexsort((h[rest], row[rest]))]
            new = np.append(True, (row[rest][1:] != row[rest][:-1]) | (h[rest][1:] != h[rest][:-1])) if len(rest) else np.zeros(0, bool)
            head = np.flatnonzero(new)
            entries = pa.StructArray.from_arrays([pa.array(h[rest[head]].view(np.int64)), pa.array(g[rest[head]].view(np.int64)), pa.array(np.diff(np.append(head, len(rest))))], names=["h", "g", "n"])
            offsets = np.searchsorted(row[rest[head]], np.arange(len(piece) + 1)).astype(np.int32)
            n = np.diff(before)
            get = lambda name: piece.rows.column(piece.rows.schema.get_field_index(name))
            yield pa.RecordBatch.from_arrays([
                get("doc_id"), *[get(k) for k in KEY], get("held_out"), pa.array(n), pa.array(add((count > 0).astype(np.int64))),
                pa.array(known - n * base), pa.array(known), pa.ListArray.from_arrays(pa.array(offsets), entries).cast(kind),
                _packed(codes, before), _packed(unit.astype(np.int16), before),
            ], names=["doc_id", *KEY, "held_out", "n_tokens", "n_known", "base", "known", "rest", "codes", "units"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    path = scratch_path(spark, "codes")
    plain = f"doc_id {kind}, id long, tag long, held_out boolean, n_tokens long, n_known long, base double"
    docs.mapInArrow(run, f"{plain}, known double, rest array<struct<h: long, g: long, n: long>>, codes binary, units binary").write.parquet(path)
    coded = spark.read.parquet(path)
    train(coded.where("NOT held_out").select("codes", "units"), model)
    trained = spark.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = trained.value
        for batch, codes, unit, before in _coded(batches):
            given = -m.slot_log[m.class_of[unit] * SLOTS + m.slot_of[unit]]
            for part, level, found, outcome in _evaluated(m, codes, unit, before):
                given[part] += _log_probability([m.weights[level]] * len(found), found, outcome) / np.log(10)
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            names = ["doc_id", *KEY, "held_out", "n_tokens", "n_known", "base"]
            own = np.add.reduceat(given, before[:-1]) + get("known").to_numpy()  # no row is without tokens
            yield pa.RecordBatch.from_arrays([*map(get, names), pa.array(own)], names=[*names, "own"])

    path = scratch_path(spark, "scores")
    coded.drop("rest").mapInArrow(weigh, f"{plain}, own double").write.parquet(path)
    rows = spark.read.parquet(path)
    rest = coded.select(*KEY, F.explode("rest").alias("r")).select(*KEY, F.col("r.h").alias("h"), F.col("r.g").alias("g"), F.col("r.n").alias("n"))
    found = rest.join(vocabulary.select(F.col("h").alias("vh"), F.col("g").alias("vg"), "c"), (F.col("h") == F.col("vh")) & (F.col("g") == F.col("vg")))
    more = found.groupBy(F.col("id").alias("i"), F.col("tag").alias("t")).agg(F.sum("n").alias("known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("logs"))
    times = rows.groupBy(F.col("id").alias("j"), F.col("tag").alias("u")).agg(F.count(F.lit(1)).alias("times"))  # rows that repeat have brought their entries as often
    out = rows.join(more, (F.col("id") == F.col("i")) & (F.col("tag") == F.col("t")), "left").join(times, (F.col("id") == F.col("j")) & (F.col("tag") == F.col("u")))
    extra = lambda name: F.coalesce(F.col(name) / F.col("times"), F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + extra("known").cast("long")).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
                      (F.col("base") + extra("logs")).alias("base_score"), (F.col("own") + extra("logs")).alias("score"))
