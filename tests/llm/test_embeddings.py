"""Hard negatives and whitening on awkward vectors, against brute force."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.llm import hard_negatives, queries, whitening

SCHEMA = "vec_id long, embedding array<double>, label int"
CLASH = ["y", "v", "place", "asks", "list", "away", "turn", "windows", "x", "i", "n", "part"]


def awkward_vectors(n=260, width=6, seed=4):
    rnd = random.Random(seed)
    centers = [[rnd.gauss(0, 0.5) for _ in range(width)] for _ in range(5)]
    out = [(i, [c + rnd.gauss(0, 0.2) for c in centers[i % 5]], rnd.choice([i % 5, rnd.randrange(10)])) for i in range(n)]
    hot = [0.3] * width
    out += [(n + i, hot, i % 3) for i in range(130)]  # a third of the rows, all ties
    out += [(7, out[7][1], out[7][2]), (50, out[50][1], out[50][2]), (100, [0.1] * width, 3)]  # repeated rows, one id with two vectors
    out += [(None, hot, 1), (2000, None, 1), (2050, hot, None), (2100, [], 1), (2150, [float("nan")] + hot[1:], 1), (2200, [float("inf")] + hot[1:], 1), (2250, [None] + hot[1:], 1), (2300, hot + hot, 1), (2350, [0.0] * width, 2), (-50, hot, 4)]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in CLASH})


def whole(v, scale):
    return [math.floor(scale * x) for x in v]


def usable(rows, width):
    return [r for r in rows if r[1] is not None and len(r[1]) == width and all(x is not None and math.isfinite(x) for x in r[1])]


def brute_negatives(rows, width=6, scale=256, own_id=lambda i: i % 50 == 0):
    fine = [(i, whole(v, scale), lab) for i, v, lab in usable(rows, width) if i is not None and lab is not None]
    anchors = {}
    for i, v, lab in sorted((r for r in fine if own_id(r[0])), key=lambda r: (r[0], r[2], r[1])):
        anchors.setdefault(i, (v, lab))
    out = []
    for a, (v, lab) in anchors.items():
        scored = sorted(((-sum(p * q for p, q in zip(v, w)), i, other) for i, w, other in fine if i != a))
        for s, i, _ in [x for x in scored if x[2] == lab][:5]:
            fits = [x for x in scored if x[2] != lab and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(a, i, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fits[:3])]
    return out


@pytest.mark.parametrize("lists, part_rows", [(None, 8192), (40, 16), (1, 100), (200, 1)])
def test_hard_negatives(spark, lists, part_rows):
    rows = awkward_vectors()
    got = hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0, lists=lists, part_rows=part_rows).collect()
    want = brute_negatives(rows)
    assert len(want) > 40 and collections.Counter(map(tuple, got)) == collections.Counter(want)


def test_hard_negatives_beyond_doubles(spark):
    rnd = random.Random(9)
    rows = [(i, [rnd.choice([-1, 1]) * rnd.uniform(1, 2) * 1e6 for _ in range(6)], i % 3) for i in range(120)]
    got = hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0, lists=9).collect()
    assert max(r.positive_score for r in got) > 1 << 53
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute_negatives(rows))
    huge = [(i, [1e300, -1e300, 1.0], i % 2) for i in range(60)]
    assert {r.positive_score for r in hard_negatives.hard_negatives(frame(spark, huge), F.col("vec_id") % 50 == 0).collect()} <= {hard_negatives.MOST}


def test_hard_negatives_of_nothing(spark):
    for rows in ([], [(None, None, None)], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 2)]):
        got = hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and got.count() == 0


def test_lists_that_cannot_matter_are_not_visited(spark):
    rnd = random.Random(1)
    rows = [(100 * g + i, g % 2, [100 * (g + 1) * (j == g // 2) + rnd.randrange(3) for j in range(10)]) for g in range(20) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, label long, y array<bigint>")
    index = hard_negatives.build(df, 20)
    assert np.median(index.radii) < 10  # most lists are tight
    window = F.array(F.struct(F.lit(0).alias("name"), F.lit(9000).cast("long").alias("lo"), F.lit(12000).cast("long").alias("hi")))
    held = spark.sparkContext.broadcast((index.centroids, index.radii, index.first, index.parts))
    asks = df.where("vec_id = 50").withColumn("windows", window)
    kinds = f"place long, vec_id long, label long, y array<bigint>, windows array<{hard_negatives._WINDOW}>"
    assert 0 < asks.mapInArrow(hard_negatives._send(held, 0, 20), kinds).count() < 8


def test_hard_negatives_query(spark, tmp_path):
    rows = awkward_vectors()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op12_hard_negatives(spark, str(tmp_path)).collect()
    moved = [(i, v, (lab + 1) % 10 if i is not None and lab is not None and i % 7 == 0 else lab) for i, v, lab in rows]
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute_negatives(moved))


def test_jacobi():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 3, 8, 33):
        m = rnd.normal(size=(n, n))
        m = m + m.T
        values, vectors = whitening.jacobi(m)
        assert np.allclose(values, np.linalg.eigvalsh(m)[::-1], atol=1e-12 * max(1, n))
        assert np.allclose(vectors @ np.diag(values) @ vectors.T, m, atol=1e-11) and np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-13)
    # small eigenvalues of a graded matrix to full precision: those of [[1, s/2], [s/2, s^2]] for a small s
    s = 1e-9
    values, _ = whitening.jacobi(np.array([[1, s / 2], [s / 2, s * s]]))
    assert values[1] == pytest.approx(0.75 * s * s, rel=1e-12)
    assert whitening.jacobi(np.zeros((0, 0)))[0].shape == (0,) and (whitening.jacobi(np.zeros((4, 4)))[0] == 0).all()


def test_whitening(spark):
    rows = awkward_vectors(width=40)
    fine = [(i, whole(v, 64)) for i, v, _ in usable(rows, 40)]
    x = np.array([v for _, v in fine], dtype=np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 32 * n and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10
    dev = collections.Counter((i, int(d)) for (i, _), d in zip(fine, ((n * x - total) ** 2).sum(axis=1)))
    assert collections.Counter((r.vec_id, int(r.deviation)) for r in got if r.component == 1) == dev
    z = x - total / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    by = collections.defaultdict(dict)
    for r in got:
        by[r.component].setdefault(r.vec_id, []).append(r.whitened)
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    for c in range(1, 33):
        want = z @ vectors[:, c - 1] / np.sqrt(values[c - 1])
        pairs = [(sorted(by[c][i]), w) for (i, _), w in zip(fine, want) if len(by[c][i]) == 1]
        sign = np.sign(pairs[0][0][0] * pairs[0][1])
        assert max(abs(sign * g[0] - w) for g, w in pairs) < 1e-6


def test_whitening_of_little(spark):
    for rows in ([], [(None, None, None)], [(1, [2.0, 3.0], 1)], [(1, [2.0], 1), (2, [2.0], 1)], [(1, [], 1)]):
        assert whitening.whiten(frame(spark, rows)).count() == 0
    got = whitening.whiten(frame(spark, [(1, [1.0, 5.0, 1.0], 1), (2, [2.0, 5.0, 1.0], 1), (None, [4.0, 5.0, 1.0], 1)])).collect()
    assert {(r.vec_id, r.component) for r in got} == {(1, 1), (2, 1), (None, 1)} and {r.explained for r in got} == {1.0}
    huge = whitening.whiten(frame(spark, [(1, [1e300, 5.0], 1), (2, [-1e300, 5.0], 1), (3, [0.5, 7.0], 1)])).collect()
    assert len(huge) in (3, 6) and all(math.isfinite(r.whitened) for r in huge)


def test_whitening_query_has_longs(spark, tmp_path):
    spark.createDataFrame(awkward_vectors(), SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op13_whitening(spark, str(tmp_path))
    assert dict(got.dtypes)["deviation"] == "bigint" and got.where("deviation IS NULL").count() == 0
