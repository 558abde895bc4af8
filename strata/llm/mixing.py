"""Mixing sources to target weights by capped water-filling.

Targets share a total by weight; a source whose share is over ``epochs`` times its size is clamped there and
the excess goes to the others by weight, until none is above. Ordered by size over weight, the clamped sources
are the first ones, so running sums over the sources' table, segment by segment, find the level at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.numbering import running
from strata.llm.quality_rules import words
from strata.llm.repeats import written
from strata.operators.windows import NUMBERED_ROWS, number_rows, window
from strata.session import scratch_path

EPOCHS = 3
WEIGHTS = (1.0, 2.0, 3.0)
SEED = 29


def n_words(text: Column) -> Column:
    """Number of runs of other characters than ASCII white space; null has none."""
    return F.size(words(F.coalesce(text, F.lit("")))).cast("long")


def water_fill(sources: DataFrame, total: float | None = None, *, epochs: float = EPOCHS) -> DataFrame:
    """Targets of a table (source, source_size, weight): min(epochs * size, level * weight), which add up to ``total``.

    The total defaults to the sum of the sizes; one that exceeds epochs * all sizes gives every source
    its cap. A source of size 0 has target 0. The table has a row for each source and no text; however many
    these are, its order is cut into segments whose sums are carried over, and the driver gets the level only.
    """
    keyed = sources.withColumns({"__cap": F.col("source_size") * F.lit(float(epochs)), "__rate": F.col("source_size") / F.col("weight"), "__null": F.col("source").isNull()})
    sums = {"__caps": {"function": "running_sum", "column": "__cap"}, "__weights": {"function": "running_sum", "column": "weight"}}
    summed = written(window(keyed, [], ["__rate", "__null", "source"], sums, [], NUMBERED_ROWS), "levels")
    sizes, weights = summed.agg(F.sum("source_size"), F.max("__weights")).first()
    amount = sizes if total is None else total
    if amount is None:  # no sources
        return sources.withColumn("target", F.lit(None).cast("double"))
    # the level that would hold if exactly the sources before this one were clamped
    level = F.try_divide(F.lit(float(amount)) - (F.col("__caps") - F.col("__cap")), F.lit(weights) - F.col("__weights") + F.col("weight"))
    # of those that leave the source under its cap, the highest has clamped no source too many
    found = summed.agg(F.max(F.when(level * F.col("weight") <= F.col("__cap"), level))).first()[0]
    target = F.col("__cap") if found is None else F.least("__cap", F.lit(found) * F.col("weight"))
    return summed.withColumn("target", target).select(*sources.columns, "target")


def weigh(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``weight``: the given ones in turn, sources by code point, null last."""
    numbered = number_rows(sources.withColumn("__null", F.col("source").isNull()), ["__null", "source"], "__turn", tie_break=[])
    turn = ((F.col("__turn") - 1) % len(weights) + 1).cast("int")
    return numbered.select(*sources.columns, F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn).alias("weight"))


def mix(documents: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED, size: Column | None = None) -> DataFrame:
    """``documents`` with ``size`` (words), ``source_size``, ``target`` and ``copies``, how often the mix takes each.

    Each document is taken whole as often as its source's rate allows. The fraction that is left goes to the
    first documents in a seeded order, up to the one whose middle passes it: first among the documents
    of over a fiftieth of the fraction, then among the others for what those leave, so that one long
    text does not carry a source off its target. Null and empty texts have size 0 and are never taken; a
    null source is a source. Repeated rows have places of their own in the order; equal ones are
    interchangeable. An empty table stays empty. Earlier columns of the four names are replaced.
    """
    new = ("size", "source_size", "target", "copies")
    spark = documents.sparkSession
    source = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c.lower() not in new])
    sized = source.withColumn("__h", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("text"))).withColumn("size", n_words(F.col("text")) if size is None else size)
    path = scratch_path(spark, "sized")  # words are counted once; the passes below read narrow columns
    sized.write.parquet(path)
    sized = spark.read.parquet(path)
    sources = weigh(written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources"), weights)
    rate = F.try_divide(F.col("target"), F.col("source_size"))
    targets = water_fill(sources, epochs=epochs).select(F.col("source").alias("__s"), "source_size", "target", F.floor(rate).alias("__whole"), (rate - F.floor(rate)).alias("__part"))
    placed = sized.join(targets, F.col("source").eqNullSafe(F.col("__s"))).withColumn("__long", F.col("size") * 50 > F.col("__part") * F.col("source_size"))
    narrow = placed.select("source", "doc_id", "__h", "size", "__long", "__part", "source_size")
    totals = narrow.where("__long").groupBy("source").agg(F.sum("size").alias("__sum"))
    long_taken = running(narrow.where("__long"), ["source"], F.col("__h"), [F.col("__h"), F.col("doc_id")], F.col("size"), "__before") \
        .join(totals.withColumnRenamed("source", "__t"), F.col("source").eqNullSafe(F.col("__t"))) \
        .where(F.col("__before") + F.col("size") / 2 <= F.col("__part") * F.col("__sum")).groupBy("source").agg(F.sum("size").alias("__taken"))
    left = totals.join(long_taken.withColumnRenamed("source", "__t"), F.col("source").eqNullSafe(F.col("__t")), "left").select(F.col("source").alias("__u"), "__sum", F.coalesce("__taken", F.lit(0)).alias("__taken"))
    ordered = running(placed, ["source", "__long"], F.col("__h"), [F.col("__h"), F.col("doc_id")], F.col("size"), "__before")
    joined = ordered.join(left, F.col("source").eqNullSafe(F.col("__u")), "left")
    wanted = F.when(F.col("__long"), F.col("__part") * F.col("__sum")).otherwise(F.col("__part") * F.col("source_size") - F.coalesce("__taken", F.lit(0)))
    extra = (F.col("__part") > 0) & (F.col("__before") + F.col("size") / 2 <= wanted)
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("__whole") + extra.cast("int"))
    return joined.select(*[F.col(f"`{c}`") for c in source.columns], "size", "source_size", "target", copies.cast("int").alias("copies"))


def digest(documents: DataFrame) -> DataFrame:
    narrow = documents.select("doc_id", "source", F.xxhash64("text").alias("text"), n_words(F.col("text")).alias("__n"))
    out = mix(narrow, size=F.col("__n"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def repeat(documents: DataFrame) -> DataFrame:
    """The mixed documents as rows, each as often as it is taken, with their own columns, whatever these are called."""
    aside = {c: f"__own_{c}" for c in documents.columns if c.lower() in ("size", "source_size", "target", "copies")}
    mixed = mix(documents.withColumnsRenamed(aside)).where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies")))
    return mixed.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in documents.columns])
