"""Centroid clustering against plain Python integers, and edge cases."""

import hashlib
import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcounts.llm import centroids as C

SF = "/root/testdata/sf0.001"


def plain(rows, k=16, rounds=3):
    """Sorted (id, cluster, distance, cluster_inertia, inertia, sha) of the kept rows, in Python integers."""
    kept = [(i, [math.floor(64 * Fraction(x)) for x in v], v) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))
    cents = [r[1] for r in first[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents)) for _, v, _ in kept]
    for _ in range(rounds):
        near = assign()
        for n in range(len(cents)):
            own = [v for (_, v, _), (_, m) in zip(kept, near) if m == n]
            if own:
                cents[n] = [sum(c) // len(own) for c in zip(*own)]
    near = assign()
    inertia = {n: sum(d for d, m in near if m == n) for n in range(len(cents))}
    top = (1 << 63) - 1
    key = lambda r: (r[0] is not None, *r[:1], *r[1:]) if r[0] is not None else (False, 0, *r[1:])
    return sorted(((i, m, min(d, top), min(inertia[m], top), min(sum(inertia.values()), top),
                    hashlib.sha256(",".join(map(str, cents[m])).encode()).hexdigest())
                   for (i, _, _), (d, m) in zip(kept, near)), key=key)


def rows_of(df):
    got = [(r[0], r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()]
    return sorted(got, key=lambda r: (r[0] is not None, *r[:1], *r[1:]) if r[0] is not None else (False, 0, *r[1:]))


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def made(n, seed=1, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(size=64) * spread + rng.integers(-3, 4)).tolist()) for i in range(n)]


def test_transform_is_exact():
    x = np.random.default_rng(0).integers(-1000, 1000, (5, 64))
    y = C.walsh_hadamard(x)
    assert (C.walsh_hadamard(y) == 64 * x).all() and ((y ** 2).sum(axis=1) == 64 * (x ** 2).sum(axis=1)).all()
    changes = (np.diff(C.walsh_hadamard(np.eye(64, dtype=np.int64)), axis=0) != 0).sum(axis=0)
    assert changes[C.ORDER].tolist() == list(range(64))


@pytest.mark.parametrize("size", [3, 10 ** 30])
def test_nearest_with_ties(size):
    rng = np.random.default_rng(4)
    kind = np.int64 if size == 3 else object
    points = rng.integers(-2, 3, (200, 64)).astype(kind) * size
    cents = rng.integers(-2, 3, (16, 64)).astype(kind) * size
    cents[7] = cents[2]
    points[:20] = cents[np.arange(20) % 16]
    best, gap = C.nearest(points, cents)
    for p, b, g in zip(points, best, gap):
        assert (g, b) == min((int(((p - c) ** 2).sum()), n) for n, c in enumerate(cents))


def test_clusters_against_plain_version(spark):
    rows = made(300)
    assert rows_of(C.clustered(frame_of(spark, rows).repartition(5))) == plain(rows)


def test_edges(spark):
    rows = made(40, 2) + [(50, None), (51, []), (52, [1.0] * 63), (53, [1.0] * 65), (54, [float("nan")] + [0.0] * 63),
                          (55, [float("-inf")] + [0.0] * 63), (56, [None] + [0.0] * 63), (57, [0.0] * 64), (57, [0.5] * 64),
                          (57, [0.5] * 64), (None, [0.25] * 64), (58, [-1e-300] * 64), (59, [-0.0] * 64)]
    frame = frame_of(spark, rows)
    assert rows_of(C.clustered(frame)) == plain(rows)
    more = frame.withColumns({c: F.lit("mine") for c in ("id", "cluster", "distance", "inertia", "vector")})
    assert rows_of(C.clustered(more)) == plain(rows)
    assert rows_of(C.clustered(frame.limit(5))) == plain(rows[:5])                  # fewer vectors than centroids
    empty = C.clustered(frame.limit(0))
    assert empty.count() == 0 and empty.columns == [
        "id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_huge_components(spark):
    rows = made(30, 3, 1e6) + [(100, [1e300] * 64), (101, [-1.7e308] * 64), (102, [2.0 ** 40] * 64), (103, [0.1] * 64)]
    assert rows_of(C.clustered(frame_of(spark, rows).repartition(3))) == plain(rows)


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    rel = con.sql(C.CENTROID_SQL)
    assert rel.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    got = rows_of(C.centroid_query(spark, SF))
    assert got == sorted(rel.fetchall()) and got
    assert got == plain([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()])
