"""The distributed heuristic scan and density centres against their definitions on whole lists."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.operators import features, peaks, scans
from ionloom.operators.peaks import kde_argmax


def masses(seed, n=900):
    rnd = random.Random(seed)
    out = []
    while len(out) < n:
        kind = rnd.random()
        at = rnd.uniform(100, 101)
        if kind < 0.3:  # a dense stretch over many buckets
            out += [at * (1 + i * rnd.uniform(1e-6, 8e-6)) for i in range(rnd.randint(20, 120))]
        elif kind < 0.5:  # equal masses
            out += [at] * rnd.randint(2, 9)
        elif kind < 0.7:  # each just past the bound of the mean so far
            total, k, x = at, 1, at
            out.append(at)
            for _ in range(rnd.randint(2, 12)):
                x = max(x, total / k) * (1 + rnd.uniform(0.8e-5, 1.02e-5))
                total, k = total + x, k + 1
                out += [x] * rnd.choice([1, 1, 2])
        else:
            out.append(at)
    return out


def frame(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "mz double")


@pytest.mark.parametrize("seed, width", [(1, 64), (2, 64), (3, 33), (4, 200)])
def test_clusters_equal_the_scan(spark, seed, width):
    values = np.sort(np.array(masses(seed)))
    want = []
    for a, b in features.heuristic_scan(values, 10, 3):
        skip = a - np.searchsorted(values, values[a])
        take = b - np.searchsorted(values, values[b - 1])
        want.append((values[a], skip, values[b - 1], take, b - a))
    got = scans.heuristic_clusters(frame(spark, values).repartition(5), 10, 3, width=width)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 40
    clusters = got.collect()
    members = scans.cluster_members(frame(spark, values), spark.createDataFrame(clusters, got.schema)).groupBy("first", "skip").agg(F.sum("n").alias("n")).collect()
    assert sorted((r["first"], r.skip, r.n) for r in members) == sorted((r["first"], r.skip, r.size) for r in clusters)


def settled(values, ppm=10, points=500):
    parts = [values[a:b] for a, b in features.heuristic_scan(values, ppm, 3)]
    return features.settle_centers(parts, [kde_argmax(p, points) for p in parts], ppm, lambda v: kde_argmax(v, points))


@pytest.mark.parametrize("seed, width", [(5, 256), (6, 80), (7, 40)])
def test_centers_equal_the_settled_ones(spark, seed, width):
    values = np.sort(np.array(masses(seed, 1500)))
    got = sorted(r[0] for r in scans.heuristic_centers(frame(spark, values), points=500, width=width).collect())
    assert got == sorted(settled(values)) and len(got) > 15


def test_one_endless_island(spark):
    """All masses hang together, and each scan reaches over many buckets."""
    rnd = random.Random(3)
    values, x = [], 500.0
    for _ in range(4000):
        x *= 1 + rnd.choice([1e-6, 2e-6, 7e-6])
        values.append(x)
    values = np.array(values)
    got = sorted(r[0] for r in scans.heuristic_centers(frame(spark, values), points=300, width=64).collect())
    assert got == sorted(settled(values, points=300))


def test_nothing_and_odd_masses(spark):
    assert scans.heuristic_centers(frame(spark, [])).count() == 0
    odd = spark.createDataFrame([(None,), (float("nan"),), (-1.0,), (0.0,), (float("inf"),), *[(7.0,)] * 5], "mz double")
    assert [tuple(r) for r in scans.heuristic_clusters(odd).collect()] == [(7.0, 0, 7.0, 5, 5)]
    assert [r[0] for r in scans.heuristic_centers(odd).collect()] == [7.0]


def test_large_groups_have_the_same_center(spark):
    rnd = np.random.default_rng(6)
    rows = []
    for g in range(5):
        v = np.concatenate([rnd.normal(300 + g, 0.4 + g, 400), rnd.normal(302 + 2 * g, 0.2, 250), rnd.uniform(200, 400, 30)])
        rows += [(g, float(round(x, 3))) for x in v]
    rows += [(7, 5.0)] * 3000 + [(8, None), (8, float("nan")), (9, 1.0)] + [(10, 5.0)] * 900 + [(10, 6.0)] * 20
    df = spark.createDataFrame(rows, "g int, mz double")
    by = {}
    for g, x in rows:
        by.setdefault(g, []).append(np.nan if x is None else x)
    for points in (50, 2000):
        want = {g: kde_argmax(np.array(v), points) for g, v in by.items()}
        for limit in (0, 10**9):
            got = {r.g: r.center for r in peaks.density_center(df, ["g"], points=points, kernel_rows=limit).collect()}
            assert got.keys() == want.keys() and got[8] is None
            assert all(got[g] == pytest.approx(want[g], rel=1e-12) for g in want if g != 8)
    counted = df.where("mz IS NOT NULL AND NOT isnan(mz)").groupBy("g", "mz").agg(F.count("*").alias("n"))
    got = {r.g: r.center for r in peaks.density_center(counted, ["g"], weight="n", kernel_rows=100).collect()}
    assert all(got[g] == pytest.approx(kde_argmax(np.array(by[g])), rel=1e-12) for g in got)
