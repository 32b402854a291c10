"""Centroid clustering: exact integer k-means, its candidate centroids filtered in PCA-rotated coordinates.

A component x counts as ``floor(SCALE * x)``.  The scatter matrix of all vectors gives the rotation; every vector keeps its ``LEADING`` rotated
coordinates and the norm of what is left.  The squared distance of the leading coordinates plus the squared difference of the two
norms is a lower bound of the squared distance (triangle inequality in the left-over space).  The centroid of the least bound is measured in
integers first, and only centroids whose bound, less the rounding of floating point, does not exceed that distance are measured as well.  The
assignment is therefore exact whatever the rotation.

A round is one pass over the rotated table: a task sends one row of sums per cluster, however many vectors a cluster holds, and the
driver gets ``K`` rows of totals.  Vectors are never shuffled.

Defined cases: vectors that are null, of another length, or with null or non-finite components are left out, and so are
those with a component beyond ``LARGEST`` after scaling, whose squared distances no long can hold; repeated rows count as rows; ties
between centroids go to the smaller number; a null vec_id starts no centroid while others can, and is clustered like any other; with fewer than ``K``
vectors there are as many centroids; an empty table gives no rows; sums that no long can hold are null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import aside, table

K, LENGTH, SCALE, ROUNDS, SEED = 8, 64, 1024, 10, "3:"
LEADING = 16
LARGEST = 2**27
#: Rounding of the rotation and of the bound, relative to the squared norms; double precision stays four digits below it.
SLACK = 1e-9


def _kept(length: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, packed = [], []
            for i, value in enumerate(batch.column("embedding")):
                if not value.is_valid or len(value.values) != length or value.values.null_count:
                    continue
                scaled = np.floor(scale * value.values.to_numpy().astype(np.float64))
                if np.isfinite(scaled).all() and np.abs(scaled).max(initial=0) <= LARGEST:
                    rows.append(i)
                    packed.append(scaled.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows, pa.int64())), pa.array(packed, pa.binary())], ["vec_id", "vector"])

    return run


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    width = len(column[0].as_buffer())
    return np.frombuffer(b"".join(x.as_buffer() for x in column), kind).reshape(len(column), width // np.dtype(kind).itemsize)


def _scatter(length: int):
    """Per task: count, sums and the upper half of the sums of products."""
    upper = np.triu_indices(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(length), np.zeros((length, length))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("vector"), "<i4").astype(np.float64)
                n, total, products = n + len(x), total + x.sum(0), products + x.T @ x
        if n:
            values = np.concatenate([[n], total, products[upper]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["at", "value"])

    return run


def rotation(vectors: DataFrame, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean of all vectors and the principal axes as columns, the leading ones first."""
    sums = vectors.select("vector").mapInArrow(_scatter(length), "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    values = np.zeros(1 + length + length * (length + 1) // 2)
    for r in sums.collect():  # one number per pair of coordinates
        values[r["at"]] = r["value"]
    n, mean = max(values[0], 1), values[1:1 + length] / max(values[0], 1)
    square = np.zeros((length, length))
    square[np.triu_indices(length)] = values[1 + length:] / n
    square = square + np.triu(square, 1).T - np.outer(mean, mean)
    return mean, np.linalg.eigh(square)[1][:, ::-1].copy()


class Rotated:
    """Vectors and centroids by their leading coordinates and the norm of the rest."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray, leading: int):
        self.mean, self.axes, self.leading = mean, axes, leading

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = (x - self.mean) @ self.axes
        return turned[:, :self.leading], np.sqrt((turned[:, self.leading:] ** 2).sum(1))

    def store(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lead, rest = self.of(_matrix(batch.column("vector"), "<i4").astype(np.float64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("vector"), pa.array([r.tobytes() for r in lead], pa.binary()), pa.array(rest)],
                    ["vec_id", "vector", "lead", "rest"])


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, how: Rotated) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of every row (ties: smaller number), its squared distance, and how many distances were measured in integers."""
    c_lead, c_rest = how.of(centroids.astype(np.float64))
    bound = ((lead[:, None, :] - c_lead[None]) ** 2).sum(2) + (rest[:, None] - c_rest[None]) ** 2
    reach = (lead**2).sum(1) + rest**2
    error = 1 + SLACK * (reach[:, None] + ((c_lead**2).sum(1) + c_rest**2)[None] + 2 * np.abs(how.mean).max() ** 2 * len(how.mean))
    exact = lambda rows, k: ((x[rows].astype(np.int64) - centroids[k]) ** 2).sum(1)
    first = bound.argmin(1)
    best = np.empty(len(x), np.int64)
    for k in range(len(centroids)):
        rows = np.flatnonzero(first == k)
        best[rows] = exact(rows, k)
    cluster, limit, measured = first.copy(), best.astype(np.float64), len(x)
    for k in range(len(centroids)):
        rows = np.flatnonzero((bound[:, k] - error[:, k] <= limit) & (first != k))
        found = exact(rows, k)
        wins = (found < best[rows]) | ((found == best[rows]) & (k < cluster[rows]))
        best[rows[wins]], cluster[rows[wins]] = found[wins], k
        measured += len(rows)
    return cluster, best, measured


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, how: Rotated):
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("vector"), "<i4")
            yield batch, x, *nearest(x, _matrix(batch.column("lead"), "<f8"), batch.column("rest").to_numpy(), centroids, how)


def _sums(centroids: np.ndarray, how: Rotated):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, x, cluster, _, _ in _assigned(batches, centroids, how):
            counts += np.bincount(cluster, minlength=len(centroids))
            for k in range(len(centroids)):
                sums[k] += x[cluster == k].sum(0, dtype=np.int64)
        have = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(have.astype(np.int32)), pa.array(counts[have]), pa.array([list(map(int, s)) for s in sums[have]], pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _labels(centroids: np.ndarray, how: Rotated):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, cluster, distance, _ in _assigned(batches, centroids, how):
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def clusters(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, length: int = LENGTH, scale: int = SCALE, seed: str = SEED, leading: int = LEADING) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that takes part."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    kept = embeddings.select("vec_id", "embedding").mapInArrow(_kept(length, scale), f"vec_id {kind}, vector binary")
    how = Rotated(*rotation(kept, length), leading)
    stored = aside(kept.mapInArrow(how.store, f"vec_id {kind}, vector binary, lead binary, rest double"))
    rank = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    starts = stored.select(rank.alias("rank"), "vector").orderBy(F.col("rank").asc_nulls_last(), "vector").limit(k).collect()
    centroids = np.array([np.frombuffer(bytes(r["vector"]), "<i4") for r in starts], np.int64).reshape(len(starts), length)
    if len(centroids):
        for _ in range(rounds):
            part = stored.select("vector", "lead", "rest").mapInArrow(_sums(centroids, how), "cluster int, n long, sums array<long>")
            totals = part.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(length)]).alias("sums"))
            centroids = centroids.copy()
            for r in totals.collect():  # k rows
                centroids[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    labels = stored.select("vec_id", "vector", "lead", "rest").mapInArrow(_labels(centroids, how), f"vec_id {kind}, cluster int, distance long")
    inertia = {r["cluster"]: int(r["s"]) for r in labels.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda v: v if v < 2**63 else None
    final = [(i, fits(inertia.get(i, 0)), fits(sum(inertia.values())), sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    known = embeddings.sparkSession.createDataFrame(final, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return labels.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds written out one after the other."""
    near = lambda c: (
        f"SELECT rn, vec_id, e, arg_min(k, d * {K} + k) AS k, min(d) AS d FROM (SELECT v.rn, v.vec_id, v.e, c.k, "
        f"list_sum(list_transform(list_zip(v.e, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, {c} c) GROUP BY rn, vec_id, e")
    rounds = []
    for i in range(ROUNDS):
        rounds.append(f"a{i} AS MATERIALIZED ({near(f'c{i}')})")
        rounds.append(
            f"s{i} AS (SELECT k, j, sum(e[j]) AS s, count(*)::HUGEINT AS n FROM a{i}, (SELECT unnest(range(1, {LENGTH + 1})) AS j) GROUP BY k, j), "
            f"m{i} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS c FROM s{i} GROUP BY k), "
            f"c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN m{i} m ON m.k = c.k)")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = {LENGTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{SEED}' || vec_id), e) - 1)::INTEGER AS k, e AS c FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('{SEED}' || vec_id), e) <= {K}),
{", ".join(rounds)},
z AS MATERIALIZED ({near(f"c{ROUNDS}")})
SELECT z.vec_id, z.k AS cluster, z.d AS distance, (sum(z.d) OVER (PARTITION BY z.k))::BIGINT AS cluster_inertia, (sum(z.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM z JOIN c{ROUNDS} c ON c.k = z.k
"""


OP12_SQL = _sql()
