"""Centroid clustering in exact integers, with a progressive search on Walsh-Hadamard coefficients.

A kept vector has exactly ``DIM`` components, none NULL or non-finite; each
component x becomes the integer floor(64 x).  The first ``K`` centroids are the
vectors with the smallest SHA-256 of ``1:<vec_id>``.  A round assigns every
vector to its nearest centroid (squared Euclidean distance; ties: the smaller
number) and moves every centroid that has vectors to the floor of their mean.

The search for the nearest centroid works on the exact integer transform, which
multiplies squared distances by ``DIM``.  Coefficients come in order of their
sign changes, so the first ones are the coarse shape of a vector:

* the centroid that looks best on the first coefficients gives a bound, its
  whole distance;
* coefficient differences are added coarse to fine (1, 2, 4, ... coefficients),
  and a centroid whose sum is already strictly larger than the bound goes;
* those that remain are finished over all coefficients, so distances are exact.

A task returns one row of sums for each centroid, as whole numbers of any size;
they are added up in ``SALTS`` parts for each centroid, and the driver gets
those (at most ``K`` x ``SALTS`` rows) and nothing that grows with the vectors.

Integers of more than ``SAFE`` bits are worked out in Python's own integers by
the same steps.  Distances past a long are given as the largest long.

Defined results: rows whose vector is NULL, of another length or has NULL or
non-finite components have no row in the result; repeated rows are vectors of
their own; a NULL id is hashed as an empty one; vectors with one id start as
centroids in the order of their components; with fewer than ``K`` kept vectors
there are fewer centroids; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, text_batches

DIM = 64
K = 16
ROUNDS = 3
SEED = 1
SCALE = 64
SAFE = 24                  # bits of a component for which all sums fit 64 bits: 64 * 64 * (2 * 2^24)^2 = 2^62
SALTS = 64
BATCH_ROWS = 8192
LONGEST = (1 << 63) - 1


# ---------------------------------------------------------------- transform and search

def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """The transform of each row (length a power of two), in whole numbers; squared lengths grow by the row length."""
    x = x.copy()
    n, half = x.shape[1], 1
    while half < n:
        pairs = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        half *= 2
    return x


def _coarse_to_fine() -> np.ndarray:
    """Coefficients by the number of sign changes of their pattern."""
    patterns = walsh_hadamard(np.eye(DIM, dtype=np.int64))
    return np.argsort((np.diff(patterns, axis=0) != 0).sum(axis=0), kind="stable")


ORDER = _coarse_to_fine()
STAGES = [(0, 1), *[(1 << k, 2 << k) for k in range(int(math.log2(DIM)))]]


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of doubles: 64-bit integers if all are safe, else Python integers."""
    if not len(vectors) or np.abs(vectors).max() * SCALE < 2 ** SAFE:
        return np.floor(vectors * SCALE).astype(np.int64)
    # doubles past 2^53 are whole numbers themselves
    flat = [int(x) * SCALE if abs(x) > 2.0 ** 53 else math.floor(x * SCALE) for x in vectors.ravel().tolist()]
    return np.array(flat, dtype=object).reshape(vectors.shape)


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of each point; both are whole numbers, 64-bit or Python's."""
    if points.dtype == object or centroids.dtype == object:
        points, centroids = points.astype(object), centroids.astype(object)
    x, c = walsh_hadamard(points)[:, ORDER], walsh_hadamard(centroids)[:, ORDER]
    first = (x[:, None, 0] - c[None, :, 0]) ** 2
    guess = first.argmin(axis=1)
    bound = ((x - c[guess]) ** 2).sum(axis=1)
    rows, cents = np.nonzero(first <= bound[:, None])
    sums = first[rows, cents]
    for lo, hi in STAGES[1:]:
        sums = sums + ((x[rows, lo:hi] - c[cents, lo:hi]) ** 2).sum(axis=1)
        stay = (sums <= bound[rows]).astype(bool)               # only strictly worse ones go
        rows, cents, sums = rows[stay], cents[stay], sums[stay]
    finished = np.repeat((bound + 1)[:, None], len(c), axis=1)
    finished[rows, cents] = sums
    best = finished.argmin(axis=1)                              # the first of equal ones
    return best, finished[np.arange(len(x)), best] // DIM


# ---------------------------------------------------------------- vectors in Spark

def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the kept vectors, as doubles."""
    v = F.col("vector")
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return plain.filter(v.isNotNull() & (F.size(v) == DIM) & ~F.exists(
        v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def _points(batch) -> np.ndarray:
    return whole(batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM))


def _as_array(rows: list) -> np.ndarray:
    """Centroids, as 64-bit integers if all are safe."""
    big = max((abs(v) for r in rows for v in r), default=0)
    return np.array(rows, dtype=np.int64 if big <= 1 << SAFE else object).reshape(len(rows), DIM)


def first_centroids(usable: DataFrame, k: int) -> list[list[int]]:
    """The integers of the ``k`` vectors with the smallest hash of their id."""
    key = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = usable.select("vector", key.alias("key")).orderBy("key", "vector").limit(k).collect()       # k rows
    return [[int(v) for v in whole(np.array([r["vector"]]))[0]] for r in rows]


def moved_centroids(usable: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round."""
    held = _as_array(centroids)

    def sums(batches):
        total, count = [[0] * DIM for _ in centroids], [0] * len(centroids)
        for batch in batches:
            points = _points(batch)
            best, _ = nearest(points, held)
            for k in np.unique(best).tolist():
                own = points[best == k]
                count[k] += len(own)
                total[k] = [t + int(s) for t, s in zip(total[k], own.sum(axis=0))]
        used = [k for k, n in enumerate(count) if n]
        salt = TaskContext.get().partitionId() % SALTS
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([salt] * len(used), pa.int32()),
             pa.array([count[k] for k in used], pa.int64()),
             pa.array([[str(v) for v in total[k]] for k in used], pa.list_(pa.string()))],
            ["cluster", "salt", "n", "sums"])

    def add_up(group: pa.Table) -> pa.Table:
        total = [sum(map(int, column)) for column in zip(*group.column("sums").to_pylist())]
        return pa.table({"cluster": group.column("cluster").slice(0, 1).cast(pa.int32()),
                         "n": pa.array([sum(group.column("n").to_pylist())], pa.int64()),
                         "sums": pa.array([[str(v) for v in total]], pa.list_(pa.string()))})

    parts = (usable.select("vector").mapInArrow(sums, "cluster int, salt int, n long, sums array<string>")
             .groupBy("cluster", "salt").applyInArrow(add_up, "cluster int, n long, sums array<string>").collect())
    count, total = [0] * len(centroids), [[0] * DIM for _ in centroids]
    for r in parts:                                             # at most K * SALTS rows
        count[r["cluster"]] += r["n"]
        total[r["cluster"]] = [t + int(v) for t, v in zip(total[r["cluster"]], r["sums"])]
    return [[t // n for t in s] if n else old for old, s, n in zip(centroids, total, count)]


def assigned(usable: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    held = _as_array(centroids)

    def run(batches):
        for batch in batches:
            best, gap = nearest(_points(batch), held)
            gap = np.array([min(int(g), LONGEST) for g in gap], dtype=np.int64) if gap.dtype == object else gap
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(best.astype(np.int32)), pa.array(gap)],
                                             ["id", "cluster", "distance"])

    return usable.mapInArrow(run, "id long, cluster int, distance long")


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
              rounds: int = ROUNDS) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    spark = vectors.sparkSession
    text_batches(spark, BATCH_ROWS)
    usable = usable_vectors(vectors, id_col, vector_col)
    centroids = first_centroids(usable, k)
    for _ in range(rounds if centroids else 0):
        centroids = moved_centroids(usable, centroids)
    near = cut(assigned(usable, centroids), "centroid-near") if centroids else usable.select(
        "id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0)
    names = [(n, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for n, c in enumerate(centroids)]
    names = spark.createDataFrame(names, "cluster int, centroid_sha256 string")
    own = near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    every = F.sum("own").over(Window.partitionBy(F.lit(1)))     # over a row for each centroid

    def long(c):
        return F.least(c, F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    about = own.join(names, "cluster").select("cluster", long(F.col("own")).alias("cluster_inertia"),
                                              long(every).alias("inertia"), "centroid_sha256")
    return near.join(F.broadcast(about), "cluster").select(     # a row for each centroid
        "id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def centroid_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector with its cluster, distance and the cluster's figures."""
    return clustered(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def _centroid_sql() -> str:
    near = """near{n} AS MATERIALIZED (SELECT rid, m % {k} AS cluster, m // {k} AS distance FROM (
  SELECT rid, min({k} * list_sum(list_transform(range(1, {d} + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))
                  + c.cluster) AS m FROM v, c{n} c GROUP BY rid))"""
    means = """c{n} AS MATERIALIZED (SELECT o.cluster, coalesce(s.x, o.x) AS x FROM c{last} o LEFT JOIN (
  SELECT cluster, list(CAST((t - ((t % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
    SELECT cluster, i, sum(x) AS t, count(*) AS n FROM (
      SELECT a.cluster, unnest(v.x) AS x, unnest(range(1, {d} + 1)) AS i FROM near{last} a JOIN v ON v.rid = a.rid)
    GROUP BY cluster, i) GROUP BY cluster) s ON s.cluster = o.cluster)"""
    steps = []
    for n in range(ROUNDS + 1):
        if n:
            steps.append(means.format(n=n, last=n - 1, d=DIM))
        steps.append(near.format(n=n, k=K, d=DIM))
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id,
    list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor({SCALE} * x) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1 AS cluster, x FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) <= {K}),
{(',' + chr(10)).join(steps)},
own AS (SELECT cluster, sum(distance) AS s FROM near{ROUNDS} GROUP BY cluster)
SELECT v.vec_id, CAST(a.cluster AS INT) AS cluster, CAST(a.distance AS BIGINT) AS distance,
       CAST(o.s AS BIGINT) AS cluster_inertia, CAST((SELECT sum(s) FROM own) AS BIGINT) AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM near{ROUNDS} a JOIN v ON v.rid = a.rid JOIN own o ON o.cluster = a.cluster JOIN c{ROUNDS} c ON c.cluster = a.cluster
"""


CENTROID_SQL = _centroid_sql()
