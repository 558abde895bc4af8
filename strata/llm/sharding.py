"""Sharding by weighted rendezvous hashing.

Every shard draws a number for a record key, and the record goes to the shard with the highest score
``-weight / ln(u)``, u in (0, 1). The draw needs only the key and the shard's number: no state, no shuffle,
and a new shard takes records into itself only, a share of weight / (sum of weights) of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.numbering import running

SHARDS = 16
SEED = 17


def shard_of(key: Column, weights: Sequence[float], seed: int = SEED) -> Column:
    """Shard number of a record key; of equal scores the higher shard wins. A null key is a key like any other."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    text = F.coalesce(key.cast("string"), F.lit("\x00null"))

    def score(shard: int) -> Column:
        drawn = F.shiftrightunsigned(F.xxhash64(text, F.lit(seed), F.lit(shard)), 11)  # 53 bits
        return F.struct((-F.lit(float(weights[shard])) / F.log((drawn + 0.5) / F.lit(float(2**53)))).alias("score"), F.lit(shard).alias("shard"))

    best = score(0) if len(weights) == 1 else F.greatest(*[score(i) for i in range(len(weights))])
    return best["shard"]


def assign(documents: DataFrame, *, weights: Sequence[float] = (1.0,) * SHARDS, grown: float = 1.0, key: str = "doc_id") -> DataFrame:
    """``documents`` with ``shard``, ``slot`` and ``grown_shard`` (with one more shard of weight ``grown``).

    Slots number the rows of a shard from 0 without gaps. Rows with the same key, repeated rows among
    them, share a shard and get different slots; equal rows are interchangeable. A null or empty text
    moves nothing, since only the key decides. An empty table stays empty. Earlier columns of the three
    names are replaced; all others stay.
    """
    new = ("shard", "slot", "grown_shard")
    source = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c.lower() not in new])
    placed = source.withColumns({"shard": shard_of(F.col(f"`{key}`"), weights), "grown_shard": shard_of(F.col(f"`{key}`"), [*weights, grown])})
    rest = [F.col(f"`{f.name}`") for f in source.schema if f.name != key and f.dataType.typeName() not in ("map", "variant", "struct", "array")]
    out = running(placed, ["shard"], F.xxhash64(F.col(f"`{key}`").cast("string")), [F.col(f"`{key}`"), *rest], name="slot")
    return out.select(*[F.col(f"`{c}`") for c in source.columns], *new)


def digest(documents: DataFrame) -> DataFrame:
    """Sizes, check sums and places of all documents; the law is that of keys."""
    text = F.coalesce("text", F.lit(""))
    narrow = documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return assign(narrow).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
