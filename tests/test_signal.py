"""Hand-computed cases of the signal and position operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.functions import ppm, scalars
from ionloom.operators import features, joins, peaks, signal


def positions(spark, values):
    return spark.createDataFrame([(v,) for v in values], "index long")


def ids(df, column="index"):
    return sorted(r[0] for r in df.select(column).collect())


def test_bounds(spark):
    row = spark.range(1).select(*ppm.bounds(F.lit(500.0), 10), *ppm.bounds(F.lit(400.0), "TypeI"), *ppm.bounds(F.lit(500.0), "TypeI")).first()
    assert [round(x, 6) for x in row] == [499.995, 500.005, 399.997, 400.003, 499.995, 500.005]


def test_correction(spark):
    df = spark.createDataFrame([(500.0,)], "mz double")
    assert ppm.correct_to_reference(df, 760.5803).first()[0] == pytest.approx(499.996844514, abs=1e-8)
    with pytest.raises(KeyError):
        ppm.correct_to_reference(df, 760.0, mz_col="x")


def test_offset_joins_have_no_gaps_filled(spark):
    a, b = positions(spark, [10, 20, 30]), positions(spark, [11, 22, 30, 40])
    assert ids(joins.offset_semi(a, b, 1)) == [10, 30]
    assert ids(joins.offset_semi(b, a, 1)) == [11, 30]
    assert ids(joins.offset_anti(b, a, 1)) == [22, 40]
    assert ids(joins.offset_semi(a, b, 2)) == [20, 30]
    assert ids(joins.offset_anti(b, a, 2)) == [11, 40]


def test_chains_keep_the_first_of_the_strongest(spark):
    rows = [(100.0, 5.0), (100.0005, 9.0), (100.0012, 9.0), (100.0030, 7.0), (200.0, 1.0)]
    df = spark.createDataFrame([("c", *r) for r in rows], "cell string, mz double, intensity double")
    got = sorted((r.mz, r.intensity) for r in peaks.merge_chains(df, ["cell"], 10).collect())
    assert got == [(100.0005, 9.0), (100.003, 7.0), (200.0, 1.0)]


@pytest.mark.parametrize(("distance", "expected"), [(3, [5]), (2, [2, 5, 8])])
def test_suppression(spark, distance, expected):
    df = spark.createDataFrame([("a", 2, 3.0), ("a", 5, 5.0), ("a", 8, 4.0)], "k string, index long, signal double")
    assert ids(signal.suppress(df, ["k"], distance)) == expected


def test_suppression_by_islands_equals_the_whole(spark):
    rnd = random.Random(3)
    rows = [(i, float(rnd.randint(0, 20))) for i in sorted(rnd.sample(range(400), 120))]
    left, gone = sorted(rows, key=lambda r: (-r[1], -r[0])), set()
    kept = []
    for i, h in left:
        if i not in gone:
            kept.append(i)
            gone |= {j for j, _ in rows if abs(j - i) <= 4}
    df = spark.createDataFrame([("a", i, h) for i, h in rows], "k string, index long, signal double")
    assert ids(signal.suppress(df, ["k"], 4)) == sorted(kept)


def test_last_two_blocks_merge(spark):
    df = spark.createDataFrame([("a", i) for i in range(250)] + [("b", i) for i in range(40)], "k string, index long")
    got = {(r.k, r.block): r["count"] for r in signal.blocks(df, ["k"], 100).groupBy("k", "block").count().collect()}
    assert got == {("a", 0): 100, ("a", 1): 150, ("b", 0): 40}


def test_trimmed_threshold(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (0, 0, 1, 2, 1, 0, 3, 0, 10, 0)], "k string, signal double")
    assert signal.trimmed_threshold(df, ["k"], k=3).first().threshold == pytest.approx(3.8689839, abs=1e-6)


def test_maxima_edges_and_gaps(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.0, 2.0, 2.0, 1.0, 3.0, None, 5.0, 1.0])], "k string, index long, signal double")
    assert ids(signal.local_maxima(df, ["k"], edge="rising")) == [1]
    assert ids(signal.local_maxima(df, ["k"], edge="falling")) == [2]
    assert ids(signal.local_maxima(df, ["k"], edge=None)) == []
    assert ids(signal.local_maxima(df.limit(2), ["k"])) == []


def test_baseline_of_missing_blocks(spark):
    rows = [("a", i, 5.0 if i % 5 == 0 else None) for i in range(100)] + [("a", i, float(i % 7)) for i in range(100, 200)] + [("a", i, 1.0) for i in range(200, 300)]
    df = spark.createDataFrame(rows, "k string, index long, data double")
    base = {r["index"]: r.baseline for r in signal.median_baseline(df, ["k"]).collect()}
    assert base[0] is None and base[150] is not None
    fitted = {r["index"]: r.baseline for r in signal.mixture_baseline(df, ["k"]).collect()}
    assert fitted[0] is None and fitted[1] is None and fitted[150] is not None


def test_spline_lies_below_peaks():
    x = np.linspace(0, 1, 150)
    y = 10 + 3 * x
    y[[30, 31, 90]] += [40, 60, 50]
    fit = signal.spline_baseline(y)
    assert np.abs(np.delete(fit - (10 + 3 * x), [29, 30, 31, 32, 89, 90, 91])).max() < 2


def test_hits(spark):
    rows = [(100.0, "a"), (100.0005, "b"), (100.0009, "a"), (100.00149, "c"), (200.0, "a")]
    got = features.hits(spark.createDataFrame(rows, "mz double, cell string"), 10).orderBy("mz").collect()
    assert [r.hits for r in got] == [2, 3, 3, 3, 1]
    assert [r.left_hits for r in got] == [1, 2, 2, 3, 1]
    assert [r.right_hits for r in got] == [2, 2, 1, 0, 0]


def test_herfindahl(spark):
    df = spark.createDataFrame([(1, 5, h) for h in (5, 5, 4, 3)], "c int, hit int, hits int")
    assert features.herfindahl(df, ["c"]).first().hhi == pytest.approx(0.7763932, abs=1e-6)


def test_annotation_joins_names_in_library_order(spark):
    f = spark.createDataFrame([(1, 500.0), (2, 900.0)], "feature long, mz_mean double")
    lib = spark.createDataFrame([(500.001, "B", 2), (499.999, "A", 1), (501.0, "C", 3)], "lib_mz double, metabolite string, lib_pos int")
    assert {r.feature: r.metabolite for r in features.annotate(f, lib).collect()} == {1: "A/B", 2: ""}


def test_band_join_equals_all_pairs(spark):
    rnd = random.Random(5)
    a, b = [rnd.uniform(100, 110) for _ in range(300)], [rnd.uniform(100, 110) for _ in range(100)]
    left = spark.createDataFrame([(x,) for x in a], "x double")
    right = spark.createDataFrame([(y,) for y in b], "y double")
    got = sorted((r.x, r.y) for r in ppm.band_join(left, right, "x", "y", 500).collect())
    assert got == sorted((x, y) for x in a for y in b if abs(x - y) / y * 1e6 <= 500)


def test_global_chains_equal_one_window(spark):
    rnd = random.Random(7)
    values = sorted({rnd.uniform(100, 101) for _ in range(2000)})
    want, n = {}, 0
    for i, v in enumerate(values):
        n += i == 0 or (v - values[i - 1]) / values[i - 1] * 1e6 > 5
        want[v] = n
    df = spark.createDataFrame([(v,) for v in values], "mz double")
    assert {r.mz: r.island for r in peaks.global_chains(df, 5).collect()} == want


def test_heuristic_scan_sizes():
    assert features.heuristic_scan(np.array([100.0, 100.0001, 100.0002]), 10, 3) == []
    assert features.heuristic_scan(np.array([100.0, 100.0001, 100.0002, 100.0003, 200.0]), 10, 3) == [(0, 4)]
    assert features.settle_centers([np.array([1.0]), np.array([2.0])], [1.0, 2.0], 10, np.mean) == [1.0, 2.0]


def test_hit_rate_clusters_take_one_point_per_cell():
    mz = np.array([100.0, 100.0001, 100.0002, 100.0003, 100.0004, 300.0])
    found = features.hit_rate_clusters(mz, np.array(["a", "b", "c", "d", "a", "e"]), 3, 10)
    assert len(found) == 1 and found[0]["hits"] == 4


def test_kde_argmax():
    assert peaks.kde_argmax(np.array([5.0, 5.0])) == 5.0
    assert math.isnan(peaks.kde_argmax(np.array([])))
    assert peaks.kde_argmax(np.array([1.0, 1.1, 1.05, 3.0])) == pytest.approx(1.05, abs=0.1)


def test_marker_mask(spark):
    mask = scalars.MarkerMask([("m1", "#1"), ("m2", "#2")])
    df = spark.createDataFrame([(1, "m1"), (2, "m1"), (2, "m2"), (3, None)], "c int, m string")
    got = mask.encode(df, ["c"], "m").select("c", "encode", mask.name(F.col("encode")).alias("n"), mask.label(F.col("encode")).alias("l")).orderBy("c").collect()
    assert [(r.encode, r.n, r.l) for r in got] == [(1, "m1", "m1"), (3, "Mixed", "m1,m2"), (0, "Unknown", "")]
    with pytest.raises(Exception, match="unknown marker"):
        mask.encode(spark.createDataFrame([(1, "x")], "c int, m string"), ["c"], "m").collect()


def test_feature_names(spark):
    df = spark.createDataFrame([(1, 760.58031, " PC 34  1 "), (2, 760.58031, ""), (3, 760.58031, None)], "feature int, mz_center double, metabolite string")
    assert [r.name for r in scalars.feature_names(df).orderBy("feature").collect()] == ["PC_34_1", "mz_760.580", "mz_760.580-1"]


def test_periods():
    assert signal.normal_periods((1, 2)) == [(1, 2)]
    with pytest.raises(ValueError, match="after its end"):
        signal.normal_periods([(2, 1)])


def test_flanks_equal_sliding_means(spark):
    import numpy as np

    rnd = np.random.default_rng(2)
    rows = [(k, int(i * 3), None if rnd.random() < 0.2 else float(rnd.normal(50, 9))) for k, n in (("a", 9000), ("b", 7), ("c", 1)) for i in range(n)]
    rows += [(None, i, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, index long, baseline double").repartition(5)
    for reach in (5, 2500, 5000):
        got = {(r.k, r["index"]): r for r in signal.flank_check(df, ["k"], reach=reach).collect()}
        assert len(got) == len(rows) and set(next(iter(got.values())).asDict()) == {"k", "index", "baseline", "flank", "stable"}
        for key in ("a", "b", "c", None):
            own = [(i, v) for k, i, v in rows if k == key]
            for at in {0, 1, len(own) // 2, len(own) - 1, min(4095, len(own) - 1), min(4096, len(own) - 1), min(4999, len(own) - 1)}:
                if at >= len(own):
                    continue
                after, before = ([v for _, v in part if v is not None] for part in (own[at : at + reach], own[max(0, at - reach) : at]))
                flank = got[key, own[at][0]].flank
                if after and before:
                    assert flank == pytest.approx(np.mean(after) - np.mean(before), abs=1e-9)
                else:
                    assert flank is None
