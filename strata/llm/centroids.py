"""Centroid clustering of integer vectors with built-in expressions alone.

Vectors become integers once and are written to the shared folder. A round is one aggregate over that table:
``zip_with`` and ``aggregate`` give the product with each centroid, an array literal, and so the squared distance; ``array_min`` of
(distance, number) structs names the cluster; one sum for each component, combined in the map tasks, moves the
centroids. Only the sums of the few centroids reach the driver, where they are divided as whole numbers.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.session import scratch_path

CLUSTERS, SIZE, ROUNDS, SCALE, SEED = 8, 64, 10, 1024, 3
#: Integers up to this size have squared distances that fit a long; a table with larger ones is reckoned in decimals.
NARROW = 2**27
#: Integers beyond this size are taken as this size; so far all sums fit 38 digits.
WIDE = 10**17


@dataclass(frozen=True)
class Centroids:
    """Centroids by number; ``wide``: their table is reckoned in decimals."""

    values: tuple[tuple[int, ...], ...]
    wide: bool = False

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.values]


def usable(vector: Column, size: int = SIZE) -> Column:
    """True for vectors of ``size`` components, none of them null, infinite or not a number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == size) & fine, F.lit(False))


def integers(vector: Column, wide: bool, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as double."""
    def whole(x: Column) -> Column:
        value = x.cast("double") * F.lit(float(scale))
        if not wide:
            return F.floor(value).cast("long")
        return F.floor(F.least(F.greatest(value, F.lit(-float(WIDE))), F.lit(float(WIDE)))).cast("decimal(18,0)")

    return F.transform(vector, whole)


def _kinds(wide: bool) -> tuple[str, str]:
    """Types of a component and of a sum of products."""
    return ("decimal(18,0)", "decimal(38,0)") if wide else ("bigint", "bigint")


def _sum(products: str, wide: bool) -> str:
    total = _kinds(wide)[1]
    return f"aggregate({products}, CAST(0 AS {total}), (s, x) -> CAST(s + x AS {total}))"


def square(column: str, wide: bool) -> str:
    """Squared length of an integer vector column, as an SQL expression."""
    return _sum(f"transform({column}, x -> x * x)", wide)


def distance(column: str, length: str, centroid: tuple[int, ...], wide: bool) -> str:
    """Squared Euclidean distance of an integer vector column to a centroid, as an SQL expression.

    ``length`` is the column of squared lengths: |v|^2 - 2 v.c + |c|^2 is exact in whole numbers, and leaves one product and
    one sum for each component to the lambdas, which Spark interprets.
    """
    kind, total = _kinds(wide)
    literal = f"array({', '.join(f'CAST({c} AS {kind})' for c in centroid)})"
    product = _sum(f"zip_with({column}, {literal}, (a, b) -> a * b)", wide)
    twice = f"CAST({product} * 2 AS {total})" if wide else f"{product} * 2"
    return f"CAST({length} - {twice} + CAST({sum(c * c for c in centroid)} AS {total}) AS {total})"


def nearest(column: str, length: str, centroids: Centroids) -> Column:
    """(distance, cluster) of the nearest centroid; of equally near ones that with the smaller number."""
    found = [f"struct({distance(column, length, c, centroids.wide)} AS distance, {i} AS cluster)" for i, c in enumerate(centroids.values)]
    return F.expr(f"array_min(array({', '.join(found)}))")


def _kept(vectors: DataFrame, key: str, column: str, size: int, scale: int) -> tuple[DataFrame, bool]:
    """(``__id``, ``__v``, squared length ``__n``) of the usable vectors, written; and whether their integers need decimals."""
    vector = F.col(f"`{column}`")
    source = vectors.where(usable(vector, size)).select(F.col(f"`{key}`").alias("__id"), vector.alias("__v"))
    most = source.agg(F.max(F.greatest(F.array_max("__v").cast("double"), -F.array_min("__v").cast("double")))).first()[0]
    wide = most is not None and most * scale + 1 > NARROW
    path = scratch_path(vectors.sparkSession, "vectors")
    source.select("__id", integers(F.col("__v"), wide, scale).alias("__v")).select("*", F.expr(square("__v", wide)).alias("__n")).write.parquet(path)
    return vectors.sparkSession.read.parquet(path), wide


def _first(kept: DataFrame, clusters: int, seed: int, wide: bool) -> Centroids:
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("__id").cast("string"), F.lit(""))), 256)
    rows = kept.select(drawn.alias("__h"), "__v").orderBy("__h", "__v").limit(clusters).collect()
    return Centroids(tuple(tuple(int(x) for x in r["__v"]) for r in rows), wide)


def _moved(kept: DataFrame, now: Centroids) -> Centroids:
    size = len(now.values[0])
    named = kept.select("__v", nearest("__v", "__n", now)["cluster"].alias("__k"))
    sums = named.groupBy("__k").agg(F.count(F.lit(1)), *[F.expr(f"sum(__v[{i}])") for i in range(size)])
    values = list(now.values)
    for k, n, *own in sums.collect():  # one row for each centroid at most
        values[k] = tuple(int(x) // n for x in own)
    return Centroids(tuple(values), now.wide)


def _fit(kept: DataFrame, wide: bool, clusters: int, rounds: int, seed: int) -> Centroids:
    now = _first(kept, clusters, seed, wide)
    for _ in range(rounds if now.values else 0):
        later = _moved(kept, now)
        if later == now:  # every further round would find the same
            break
        now = later
    return now


def fit(vectors: DataFrame, *, key: str = "vec_id", column: str = "embedding", clusters: int = CLUSTERS, size: int = SIZE, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> Centroids:
    """Centroids after ``rounds`` rounds over all usable vectors.

    They start as the vectors whose keys have the least SHA-256 of ``seed:key``; a null key counts as an empty
    one, and rows of one key are told apart by their vectors, so repeated rows can be two equal centroids (the
    second stays empty and where it is). With fewer vectors than ``clusters`` each is a centroid; without
    any there are none. Vectors of another length and those with a null or non-finite component count nowhere.
    """
    return _fit(*_kept(vectors, key, column, size, scale), clusters, rounds, seed)


def assign(vectors: DataFrame, centroids: Centroids, *, column: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """The usable rows with ``cluster`` and ``distance``; earlier columns of these names are replaced, all others stay.

    A squared distance that is no long (integers beyond ``NARROW`` only) is null. Repeated rows stay repeated.
    No centroids: no rows.
    """
    own = [F.col(f"`{c}`") for c in vectors.columns if c.lower() not in ("cluster", "distance")]
    if not centroids.values:
        return vectors.where("1 = 0").select(*own, F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    vector = F.col(f"`{column}`")
    work = "__v" + "_" * max(map(len, vectors.columns))  # longer than any name of the table
    length = work + "_"
    whole = vectors.where(usable(vector, size)).withColumn(work, integers(vector, centroids.wide, scale)).withColumn(length, F.expr(square(work, centroids.wide)))
    found = whole.select(*own, nearest(work, length, centroids).alias(work))
    return found.select(*own, F.col(f"{work}.cluster").alias("cluster"), F.col(f"{work}.distance").try_cast("long").alias("distance"))


def digest(vectors: DataFrame) -> DataFrame:
    """One row for each usable vector: its cluster, its distance, and the inertia of its cluster and of all.

    An inertia that is no long is null.
    """
    spark = vectors.sparkSession
    kept, wide = _kept(vectors, "vec_id", "embedding", SIZE, SCALE)
    final = _fit(kept, wide, CLUSTERS, ROUNDS, SEED)
    if not final.values:
        return kept.where("1 = 0").selectExpr("__id AS vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    path = scratch_path(spark, "clusters")
    kept.select(F.col("__id").alias("vec_id"), nearest("__v", "__n", final).alias("best")).select("vec_id", "best.*").write.parquet(path)
    found = spark.read.parquet(path)
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}

    def long(value: int) -> Column:
        return F.lit(value if value < 2**63 else None).cast("long")

    by_cluster = lambda items: F.element_at(F.array(*items), F.col("cluster") + 1)
    return found.select(
        "vec_id", "cluster", F.col("distance").try_cast("long").alias("distance"), by_cluster([long(sums.get(i, 0)) for i in range(len(final.values))]).alias("cluster_inertia"),
        long(sum(sums.values())).alias("inertia"), by_cluster([F.lit(d) for d in final.digests()]).alias("centroid_sha256"),
    )


def _sql() -> str:
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        f" WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {SIZE})",
        f"c0 AS MATERIALIZED (SELECT k, v FROM (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS k, v FROM kept) WHERE k < {CLUSTERS})",
    ]
    near = "SELECT vec_id, v, min({{'d': list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'k': k}}) AS b FROM (SELECT i, vec_id, kept.v, k, m.v AS c FROM (SELECT row_number() OVER () AS i, * FROM kept) kept, c{0} m) GROUP BY i, vec_id, v"
    for r in range(ROUNDS):
        # both operands are whole, so floor division is the quotient less one where a negative sum leaves a rest
        steps.append(
            f"c{r + 1} AS MATERIALIZED (SELECT o.k, coalesce(n.v, o.v) AS v FROM c{r} o LEFT JOIN (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM"
            f" (SELECT b.k AS k, i, sum(v[i]) AS s, count(*) AS n FROM ({near.format(r)}), range(1, {SIZE + 1}) g(i) GROUP BY b.k, i) GROUP BY k) n ON o.k = n.k)"
        )
    steps.append(f"found AS MATERIALIZED ({near.format(ROUNDS)})")
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, CAST(b.k AS INTEGER) AS cluster, CAST(b.d AS BIGINT) AS distance, CAST(sum(b.d) OVER (PARTITION BY b.k) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{ROUNDS}.v, ',')) AS centroid_sha256 FROM found JOIN c{ROUNDS} ON c{ROUNDS}.k = b.k"
    )


SQL = _sql()
