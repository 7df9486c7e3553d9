"""Centroid clustering, exact: float32 products screen the centroids, whole numbers decide what they leave open.

Vectors become whole numbers, ``floor(scale * x)``.  To assign a batch, one float32 matrix product gives all inner
products with the centroids at once.  Each comes with an interval that holds the true value: a product of n terms
in any order, of factors that were rounded, is off by (n + 2) u / (1 - (n + 2) u) times the product of the two
vectors' lengths at most, u being 2**-24, and what is added in double precision is off by its own far smaller bound.
Centroids whose interval reaches below the smallest upper end are a vector's shortlist.  A shortlist of one is the
answer; where intervals overlap, these few distances are worked out again in whole numbers and ties go to the
smallest number.  The result is thus that of exact arithmetic, whatever the processor's order of summation.

A round is one map over the stored vectors: each task sends a sum for each centroid, and the new centroids, exact
floors of sum by count, are ``k`` rows on the driver.  Nothing else is shuffled or gathered, however many vectors a
cluster has.  Sums are decimals of 38 digits, so that they are exact too.

Nulls: vectors that are null, hold a null, NaN or infinite component, or have not ``dims`` components take no part.
A vector without id is assigned like others and begins as a centroid only after all that have one.  Rows that share
an id are vectors of their own.  With fewer than ``k`` vectors there are as many centroids.  An empty table gives an
empty result, and further columns, whatever their names, are ignored.  Components so large that a squared
distance may not fit 64 bits, 2**27 in whole numbers at 64 components, are refused with an error.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densika.llm.storage import store
from densika.llm.wordbytes import tidy

UNIT = 2.0**-24  # of float32
TOTALS = "decimal(38,0)"


def whole_vectors(vectors: DataFrame, dims: int = 64, scale: int = 256) -> DataFrame:
    """``(id, v array<int>)`` of the vectors that take part."""
    most = math.isqrt((1 << 63) // dims) // 2
    x = F.transform("embedding", lambda e: e.cast("double"))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    good = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == dims) & ~F.coalesce(bad, F.lit(True)))
    fits = lambda e: F.when(F.abs(e * scale) < most, F.floor(e * scale).cast("int")).otherwise(F.raise_error(F.lit(f"a component of {most} / {scale} or more")).cast("int"))
    return good.select(F.col("vec_id").cast("long").alias("id"), F.transform(x, fits).alias("v"))


@dataclass
class Centroids:
    """Whole numbers, a row each.  ``screened`` counts vectors, those with a shortlist of several, and its members."""

    x: np.ndarray
    screened: list[int] = field(default_factory=lambda: [0, 0, 0])

    def intervals(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the squared distances less the vectors' squared lengths."""
        m = (v.shape[1] + 2) * UNIT
        products = (v.astype(np.float32) @ self.x.astype(np.float32).T).astype(np.float64)
        square = (self.x**2).sum(1).astype(np.float64)
        lengths = np.sqrt((v.astype(np.float64) ** 2).sum(1))[:, None] * np.sqrt(square)
        near = square - 2 * products
        reach = (2 * m / (1 - m) * lengths + 2.0**-50 * (square + 2 * np.abs(products))) * (1 + 2.0**-20)
        return near - reach, near + reach

    def nearest(self, v: np.ndarray) -> np.ndarray:
        low, high = self.intervals(v)
        least = high.min(1)
        short = low <= least[:, None]
        out = short.argmax(1)
        several = np.flatnonzero(short.sum(1) > 1)
        if len(several):
            row, centroid = np.nonzero(short[several])
            exact = ((v[several[row]] - self.x[centroid]) ** 2).sum(1)
            opens = np.flatnonzero(np.diff(row, prepend=-1))
            best = exact == np.minimum.reduceat(exact, opens)[row]
            first = np.flatnonzero(best)
            first = first[np.diff(row[first], prepend=-1) != 0]
            out[several] = centroid[first]
            self.screened[2] += len(row)
        self.screened[0] += len(v)
        self.screened[1] += len(several)
        return out

    def distances(self, v: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        return ((v - self.x[cluster]) ** 2).sum(1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def _batches(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 10_000):
            part = batch.slice(lo, 10_000)
            yield part, _matrix(part.column("v"), dims)


def _totals(vectors: DataFrame, centroids: Centroids) -> list:
    """Of each cluster with members: its number, their count, the sum of their distances, and the sum of each component."""
    k, dims = centroids.x.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, inertia, sums = np.zeros(k, np.int64), [0] * k, np.zeros((k, dims), np.int64)
        for _, v in _batches(batches, dims):
            cluster = centroids.nearest(v)
            n += np.bincount(cluster, minlength=k)
            np.add.at(sums, cluster, v)
            distance = centroids.distances(v, cluster)
            for c in np.unique(cluster):
                inertia[c] += int(sum(map(int, distance[cluster == c]))) if distance.max() > 1 << 48 else int(distance[cluster == c].sum())
        own = np.flatnonzero(n)
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * dims), pa.array(sums[own].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n[own]), pa.array([str(inertia[c]) for c in own], pa.string()), listed], ["cluster", "n", "inertia", "sums"])

    parts = vectors.select("v").mapInArrow(tidy(run), "cluster int, n long, inertia string, sums array<long>")
    each = [F.sum(F.get("sums", F.lit(i)).cast(TOTALS)).alias(f"s{i}") for i in range(dims)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("inertia").cast(TOTALS)).alias("inertia"), *each).collect()  # k rows


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest digests of seed and id."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    chosen = vectors.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r.v for r in chosen], np.int64)


def fit(vectors: DataFrame, k: int, rounds: int, seed: int) -> Centroids:
    found = Centroids(starts(vectors, k, seed))
    for _ in range(rounds if len(found.x) else 0):
        x = found.x.copy()
        for r in _totals(vectors, found):
            x[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(x.shape[1])]
        found = Centroids(x)
    return found


def assigned(vectors: DataFrame, centroids: Centroids) -> DataFrame:
    """``id, cluster, distance`` of every vector."""
    dims = centroids.x.shape[1] if len(centroids.x) else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, v in _batches(batches, dims):
            cluster = centroids.nearest(v)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster.astype(np.int32)), pa.array(centroids.distances(v, cluster))], ["id", "cluster", "distance"])

    return vectors.mapInArrow(tidy(run), "id long, cluster int, distance long")


def cluster(embeddings: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256) -> tuple[DataFrame, DataFrame]:
    """``(vec_id, cluster, distance)`` of every vector, and ``(cluster, centroid, n, cluster_inertia, inertia)``, a row a centroid."""
    spark = embeddings.sparkSession
    vectors = store(whole_vectors(embeddings, dims, scale), "vectors")
    found = fit(vectors, k, rounds, seed)
    totals = {r.cluster: (r.n, int(r.inertia)) for r in _totals(vectors, found)} if len(found.x) else {}
    whole = sum(t for _, t in totals.values())
    rows = [(c, x.tolist(), *totals.get(c, (0, 0)), whole) for c, x in enumerate(found.x)]
    known = spark.createDataFrame(rows, "cluster int, centroid array<long>, n long, cluster_inertia long, inertia long")
    return assigned(vectors, found).withColumnRenamed("id", "vec_id"), known


def centroid_digest(centroid: np.ndarray | list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def op13(embeddings: DataFrame) -> DataFrame:
    found, known = cluster(embeddings)
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
    known = known.select("cluster", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # at most k rows


def _round(i: int) -> str:
    """Assignment to the centroids ``c{i}`` and, from it, the next ones."""
    return f"""
a{i} AS MATERIALIZED (SELECT row, cluster, d FROM (
  SELECT v.row, c.cluster, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d,
         row_number() OVER (PARTITION BY v.row ORDER BY d, c.cluster) AS turn FROM v, c{i} c) WHERE turn = 1),
s{i} AS (SELECT a.cluster, p.pos, sum(v.x[p.pos]) AS s, count(*) AS n FROM a{i} a JOIN v USING (row), (SELECT unnest(range(1, 65)) AS pos) p GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{i} c
  LEFT JOIN (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS x FROM s{i} GROUP BY cluster) m USING (cluster)),"""


SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (SELECT CAST(turn - 1 AS INTEGER) AS cluster, x FROM (
  SELECT x, row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, x) AS turn FROM v) WHERE turn <= 40),
{"".join(_round(i) for i in range(6))}
t AS (SELECT cluster, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a5 GROUP BY cluster)
SELECT v.vec_id, a.cluster, CAST(a.d AS BIGINT) AS distance, t.cluster_inertia, (SELECT CAST(sum(d) AS BIGINT) FROM a5) AS inertia,
       sha256(array_to_string(c5.x, ',')) AS centroid_sha256
FROM a5 a JOIN v USING (row) JOIN t USING (cluster) JOIN c5 USING (cluster)
"""
