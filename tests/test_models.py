"""Linkage, leaf order and PCA by blocks against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.operators import ml


def plain_linkage(d, method):
    """Heights by looking through all pairs for the nearest, again and again."""
    groups, heights = [[i] for i in range(len(d))], []
    of = {"complete": np.max, "single": np.min, "average": np.mean}[method]
    while len(groups) > 1:
        h, a, b = min((of(d[np.ix_(x, y)]), i, j) for (i, x), (j, y) in itertools.combinations(enumerate(groups), 2))
        heights.append((h, sorted(groups[a] + groups[b])))
        groups = [g for i, g in enumerate(groups) if i not in (a, b)] + [groups[a] + groups[b]]
    return heights


def points(n, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, 3))
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


@pytest.mark.parametrize("method", ["complete", "single", "average"])
def test_linkage_equals_the_plain_one(method):
    for n in (2, 3, 9, 24):
        d = points(n, n)
        merges, leaves = ml.linkage(d, method)
        members = {i: [i] for i in range(n)}
        for new, (a, b, h, size) in enumerate(merges, n):
            members[new] = sorted(members[int(a)] + members[int(b)])
            assert len(members[new]) == size
        want = plain_linkage(d, method)
        assert [h for h, _ in want] == pytest.approx(merges[:, 2].tolist())
        assert [g for _, g in want] == [members[n + i] for i in range(n - 1)] and sorted(leaves) == list(range(n))


def orders(merges, n):
    kinds = {i: [[i]] for i in range(n)}
    for new, (a, b, *_) in enumerate(merges, n):
        kinds[new] = [x + y for p, q in ((int(a), int(b)), (int(b), int(a))) for x in kinds[p] for y in kinds[q]]
    return kinds[n + len(merges) - 1]


def test_optimal_order_is_the_least_of_all():
    cost = lambda d, o: sum(d[a, b] for a, b in itertools.pairwise(o))
    for n in (2, 3, 5, 8):
        d = points(n, 10 + n)
        merges, _ = ml.linkage(d, "average")
        every = orders(merges, n)
        got = ml.optimal_order(merges, d)
        assert got in every and cost(d, got) == pytest.approx(min(cost(d, o) for o in every))
    assert ml.optimal_order(np.zeros((0, 4)), np.zeros((1, 1))) == [0]


def test_dendrogram_in_optimal_order(spark):
    rows = [(i, g, np.random.default_rng(g).normal(size=5).tolist()) for g in range(6) for i in range(3)]
    df = spark.createDataFrame(rows, "cell int, g int, v array<double>")
    plain, best = ml.dendrogram(df, "g"), ml.dendrogram(df, "g", optimal=True)
    d = 1 - plain["correlation"]
    cost = lambda o: sum(d[a, b] for a, b in itertools.pairwise(o))
    assert sorted(best["order"]) == list(range(6)) and cost(best["order"]) <= cost(plain["order"]) + 1e-12


@pytest.mark.parametrize("parts", [1, 11])
def test_blocks_equal_pca(spark, parts):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 7)) @ np.diag([5, 4, 3, 2, 1, 0.3, 0.1]) + 7
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "cell long, v array<double>").repartition(parts)
    one, two = ml.pca(df, 4), ml.pca_by_blocks(df, 4, block_rows=16, fan=3)
    assert two["variance"] == pytest.approx(one["variance"]) and two["variance_ratio"] == pytest.approx(one["variance_ratio"])
    assert two["loadings"] == pytest.approx(one["loadings"], abs=1e-8)
    a, b = ({r.cell: r.pcs for r in out["scores"].collect()} for out in (one, two))
    assert all(a[i] == pytest.approx(b[i], abs=1e-7) for i in a)
    low = ml.pca_by_blocks(df, 2, rank=4, block_rows=16, fan=3)
    assert low["variance"] == pytest.approx(one["variance"][:2], rel=0.02)


def test_blocks_of_wide_and_few_rows(spark):
    df = spark.createDataFrame([(i, [float((i * j) % 7) for j in range(30)]) for i in range(5)], "cell long, v array<double>").repartition(3)
    out = ml.pca_by_blocks(df, 10)
    assert len(out["variance"]) == 4 and out["variance_ratio"].sum() == pytest.approx(1)
    assert df.where(F.lit(False)).count() == 0


def test_dual_branch(spark):
    from ionloom.operators import pseudotime

    schema = "bin long, metabolite string, stat double, frac double"
    left = [(0, "a", 1.0, 0.5), (10, "a", 3.0, None), (0, "b", 2.0, 0.25), (0, "d", 1.0, 1.0), (0, "e", 1.0, 9.0)]
    right = [(0, "a", 5.0, 0.0), (20, "a", None, 0.1), (0, "b", 2.0, 1.0), (0, "c", 1.0, 1.0), (0, "e", 1.0, 0.0)]
    order = spark.createDataFrame([("b", 1), ("a", 5), ("c", 2)], "metabolite string, position int")
    p = spark.createDataFrame([("a", 0.00123), ("b", None)], "metabolite string, pval_adj double")
    got = {(r.branch, r.metabolite, r.y): r for r in pseudotime.dual_branch(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), order, p).collect()}
    assert {k[:2] + (k[2], r.x) for k, r in got.items()} == {("left", "a", 0, 1), ("left", "a", 10, 1), ("right", "a", 0, 1), ("right", "a", -20, 1), ("left", "b", 0, 0), ("right", "b", 0, 0)}
    sd = np.std([1.0, 3.0, 5.0])
    assert got["left", "a", 0].z == pytest.approx(-2 / sd) and got["right", "a", -20].z is None and got["left", "b", 0].z == 0
    assert got["left", "a", 0].label == "a (1.23E-03)" and got["left", "b", 0].label == "b"
    assert got["right", "b", 0].size == 300 and got["left", "a", 10].size == 20 and got["left", "b", 0].size == 90


def test_selection_makes_metrics_anew(spark):
    from ionloom.operators import matrix

    long = spark.createDataFrame([(1, "f", 2.0), (1, "g", 0.0), (2, "f", 4.0), (2, "g", None), (3, "f", 0.0), (3, "g", 9.0)], "cell int, feature string, value double")
    obs = spark.createDataFrame([(1, 1.0), (2, 5.0), (3, None), (4, 2.0)], "cell int, own double")
    got = matrix.select_cells(long, obs, {"own": (1.0, 5.0)})
    assert {r.cell for r in got["obs"].collect()} == {1, 2, 4} and got["matrix"].count() == 4
    assert {r.feature: (r.hits, r.hit_rate, r.mean_intensity) for r in got["var"].collect()} == {"f": (2, 100.0, 3.0), "g": (0, 0.0, 0.0)}
    got = matrix.select_features(long, matrix.feature_metrics(long), {"hits": (2, None)})
    assert {r.cell: (r.n_metabolites, r.total_intensity) for r in got["obs"].collect()} == {1: (1, 2.0), 2: (1, 4.0), 3: (0, 0.0)}
    none = matrix.select_features(long, matrix.feature_metrics(long), {"hits": (9, None)})
    assert {tuple(r) for r in none["obs"].collect()} == {(1, 0, 0.0), (2, 0, 0.0), (3, 0, 0.0)}
    with pytest.raises(ValueError):
        matrix.select_cells(long, obs, {"other": (0, 1)})


@pytest.mark.parametrize("n, width, k", [(700, 5, 4), (900, 10, 45), (40, 3, 50)])
def test_nearest_equals_brute_force(n, width, k):
    rnd = np.random.default_rng(n)
    x, ids = rnd.integers(0, 4, (n, width)).astype(float), rnd.permutation(n) * 3
    x[8:20], x[20:30], x[5], x[6], x[7] = x[8], 1e9 + rnd.normal(size=(10, width)), np.nan, 1e200, 1e-30
    near = ml.Nearest(ids, x, k)
    for lo in range(0, n, 133):
        near.meet(ids[lo : lo + 133], x[lo : lo + 133], block=64)
    with np.errstate(all="ignore"):
        d = np.zeros((n, n))
        for j in range(width):
            d += (x[:, j, None] - x[None, :, j]) ** 2
        d = np.sqrt(d)
    d[np.diag_indices(n)] = np.inf
    for i in range(n):
        want = [(ids[j], d[i, j]) for j in np.lexsort((ids, d[i]))[:k] if np.isfinite(d[i, j])]
        there = np.isfinite(near.distance[i])
        assert want == list(zip(near.near[i][there], near.distance[i][there]))


def test_copies_of_a_vector_do_not_meet_all_their_like(spark):
    rows = [(i, [1.0, 2.0]) for i in range(3000)] + [(3000 + i, [float(i), 0.0]) for i in range(5)]
    got = ml.neighbours(spark.createDataFrame(rows, "cell long, v array<double>"), 3, vector="v", shard_rows=500)
    assert {(r.src, r.dst) for r in got.where("src = 2999 or src = 1").collect()} == {(2999, 0), (2999, 1), (2999, 2), (1, 0), (1, 2), (1, 3)}
    assert got.count() == 3 * 3005
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()
