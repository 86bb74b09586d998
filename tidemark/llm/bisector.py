"""Centroid clustering by a bisector tournament, in whole numbers.

Two centroids are told apart by the hyperplane between them: with normal ``2 (a - b)`` and threshold ``|a|^2 - |b|^2``, a vector lies nearer to ``a``
where its product with the normal exceeds the threshold. Normals and thresholds of all pairs are made once a round. A vector's champion meets each later centroid, so
``k - 1`` sign tests leave the nearest one; zero favours the smaller number. Only the winner's distance is computed, and all of it is exact.

Centroids begin at the vectors whose hashed ids are smallest and move to the floor of their vectors' means. What reaches the driver in a round is bounded by the number of centroids and of
components; vectors aren't shuffled.

Defined results: vectors of another length, with a null or a non-finite component, and null vectors are left out. Fewer vectors than centroids give fewer centroids, none an empty table. Ids may be null (hashed as the
empty text) and may repeat: rows of one id begin in the order of their components. Equal centroids are won by the smaller number, and the other stays as it is. Components may be as
large as a double: beyond what 64 bits hold, the same steps are done with Python's integers; a distance or sum that no long can hold is given as the largest long. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, staged

LARGEST = (1 << 63) - 1
#: Components of this size and beyond are handled as Python's integers: sums of 4,096 products of smaller ones stay within 64 bits.
WIDE = 1 << 24


@dataclass(frozen=True)
class Clustering:
    """``k`` centroids of ``width`` components, which move ``rounds`` times. Components are multiplied by ``scale`` and rounded down; ``salt`` goes before the id where it is hashed."""

    k: int = 40
    rounds: int = 5
    width: int = 64
    scale: int = 256
    salt: str = "2:"

    def __post_init__(self):
        if self.k < 1 or not 1 <= self.width <= 1024:
            raise ValueError("a centroid at least, and 1 to 1024 components")


def whole(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are kept, and those as integers."""
    lengths = np.array(pa.compute.fill_null(pa.compute.list_value_length(column), -1))
    fits = np.flatnonzero(lengths == width)
    flat = column.take(pa.array(fits)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype("float64").reshape(len(fits), width)
    good = np.isfinite(x).all(axis=1) & ~np.array(flat.is_null()).reshape(len(fits), width).any(axis=1)
    x = x[good]
    if not len(x) or np.abs(x).max() * scale < WIDE:
        return fits[good], np.floor(x * scale).astype("int64")
    # A double is a ratio of integers, so that nothing is lost however large it is.
    exact = [(p * scale) // q for p, q in map(float.as_integer_ratio, x.ravel().tolist())]
    return fits[good], np.array(exact, dtype=object).reshape(x.shape)


def narrow(x: np.ndarray) -> np.ndarray:
    """Integers as 64-bit ones where products of two of them may be summed without overflow."""
    if x.dtype != object or not x.size:
        return x.astype("int64") if not x.size else x
    return x.astype("int64") if np.abs(x).max() < WIDE else x


def bisectors(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normals and thresholds of all pairs."""
    squares = (centroids * centroids).sum(axis=1)
    return 2 * (centroids[:, None] - centroids[None, :]), squares[:, None] - squares[None, :]


def nearest(x: np.ndarray, centroids: np.ndarray, normals: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The winner of each vector's tournament, and its squared distance."""
    if x.dtype != centroids.dtype:
        x, centroids, normals, thresholds = (v.astype(object) for v in (x, centroids, normals, thresholds))
    winner = np.zeros(len(x), "int64")
    for rival in range(1, len(centroids)):
        side = (x * normals[winner, rival]).sum(axis=1) - thresholds[winner, rival]
        winner[side < 0] = rival
    off = x - centroids[winner]
    return winner, (off * off).sum(axis=1)


def beginnings(vectors: DataFrame, plan: Clustering) -> np.ndarray:
    """The first centroids: kept vectors (id, vector) by the hash of their ids."""
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = vectors.filter((F.size("vector") == plan.width) & finite)
    ordered = kept.select(F.sha2(F.concat(F.lit(plan.salt), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256).alias("hash"), "vector").orderBy("hash", "vector")
    chosen = pa.array([list(r.vector) for r in ordered.limit(plan.k).collect()], pa.list_(pa.float64()))
    return whole(chosen, plan.width, plan.scale)[1]


def moved(vectors: DataFrame, plan: Clustering, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round. Every task adds up its own vectors, 16 tasks add up these sums, and the driver the 16."""
    width, scale, (normals, thresholds) = plan.width, plan.scale, bisectors(centroids)
    shipped = vectors.sparkSession.sparkContext.broadcast((centroids, normals, thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        for batch in batches:
            x = whole(batch.column(0), width, scale)[1]
            if len(x):
                winner = nearest(x, *shipped.value)[0]
                for c in np.unique(winner).tolist():
                    mine = x[winner == c]
                    new = [len(mine), *mine.sum(axis=0).tolist()]
                    sums[c] = [a + b for a, b in zip(sums[c], new)] if c in sums else new
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([",".join(map(str, v)) for v in sums.values()], pa.string())], ["cluster", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        for batch in batches:
            for c, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new = list(map(int, said.split(",")))
                sums[c] = [a + b for a, b in zip(sums[c], new)] if c in sums else new
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([",".join(map(str, v)) for v in sums.values()], pa.string())], ["cluster", "sums"])

    # Sums are written as digits, since no integer type bounds them. They are dealt whole, so that a cluster of a third of all rows is no task of its own.
    parts = map_arrow(vectors.select("vector"), run, "cluster int, sums string").repartition(16)
    totals: dict[int, list[int]] = {}
    for c, said in map_arrow(parts, add, "cluster int, sums string").collect():
        new = list(map(int, said.split(",")))
        totals[c] = [a + b for a, b in zip(totals[c], new)] if c in totals else new
    shipped.unpersist()
    return narrow(np.array([[s // totals[c][0] for s in totals[c][1:]] if c in totals else old.tolist() for c, old in enumerate(centroids)], dtype=object))


def assigned(vectors: DataFrame, plan: Clustering, centroids: np.ndarray) -> DataFrame:
    """id, cluster and distance of each kept vector."""
    width, scale, (normals, thresholds) = plan.width, plan.scale, bisectors(centroids)
    shipped = vectors.sparkSession.sparkContext.broadcast((centroids, normals, thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = whole(batch.column(1), width, scale)
            winner, far = nearest(x, *shipped.value) if len(x) else (np.zeros(0, "int64"), np.zeros(0, "int64"))
            far = [min(int(f), LARGEST) for f in far.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(winner, pa.int32()), pa.array(far, pa.int64())], ["id", "cluster", "distance"])

    return map_arrow(vectors.select("id", "vector"), run, f"id {vectors.schema['id'].dataType.simpleString()}, cluster int, distance long")


def clustered(vectors: DataFrame, plan: Clustering = Clustering(), vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Cluster and squared distance of each kept vector (id, cluster, distance), and the final centroids."""
    given = vectors.select(vectors[f"`{vec_id}`"].alias("id"), vectors[f"`{vector}`"].cast("array<double>").alias("vector"))
    centroids = beginnings(given, plan)
    if not len(centroids):
        return given.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), centroids
    for _ in range(plan.rounds):
        centroids = moved(given, plan, centroids)
    return assigned(given, plan, centroids), centroids


def op11(vectors: DataFrame, plan: Clustering = Clustering()) -> DataFrame:
    """Cluster, distance, inertia and the centroid's digest of each vector."""
    found, centroids = clustered(vectors, plan)
    found = staged(found, "clusters")
    # A row for each centroid: as many as the plan has.
    wide, most = "decimal(38,0)", F.lit(LARGEST).cast("decimal(38,0)")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast(wide)).cast(wide).alias("sum"))
    total = sums.agg(F.sum("sum").cast(wide).alias("total"))
    digests = found.sparkSession.createDataFrame([(c, hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest()) for c, v in enumerate(centroids)], "cluster int, centroid_sha256 string")
    told = digests.join(sums, "cluster").join(F.broadcast(total))
    as_long = lambda c: F.least(F.col(c), most).cast("long")
    told = told.select("cluster", as_long("sum").alias("cluster_inertia"), as_long("total").alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(told), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(plan: Clustering = Clustering()) -> str:
    """DuckDB SQL for ``op11``: the distances of all pairs in each round."""
    far = "list_sum(list_transform(range(1, {w} + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))".format(w=plan.width)
    mean = "list(CASE WHEN s % n < 0 THEN (s - (s % n) - n) // n ELSE (s - (s % n)) // n END ORDER BY i)"
    steps = []
    for r in range(plan.rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT row, min({{'d': d, 'cluster': cluster}}) AS best FROM (SELECT row, cluster, CAST({far} AS BIGINT) AS d FROM v, c{r}) GROUP BY row)")
        if r < plan.rounds:
            steps.append(f"s{r} AS (SELECT best.cluster AS cluster, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN v USING (row), range(1, {plan.width} + 1) t(i) GROUP BY 1, 2)")
            steps.append(f"m{r} AS (SELECT cluster, {mean} AS c FROM s{r} GROUP BY cluster)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m USING (cluster))")
    last = plan.rounds
    return f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings WHERE len(embedding) = {plan.width} AND len(list_filter(embedding, lambda x: isfinite(x))) = {plan.width}),
v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, x, list_transform(x, lambda y: CAST(floor({plan.scale} * y) AS BIGINT)) AS v FROM e),
c0 AS MATERIALIZED (SELECT cluster, v AS c FROM (SELECT row_number() OVER (ORDER BY sha256('{plan.salt}' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS cluster, v FROM v) WHERE cluster < {plan.k}),
{", ".join(steps)},
told AS (SELECT vec_id, best.cluster AS cluster, best.d AS distance FROM a{last} JOIN v USING (row))
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM told JOIN c{last} USING (cluster)
"""
