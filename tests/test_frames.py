"""Frames, thresholds, optical traces, several regressors, whole analyses: against brute force."""

import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.functions import scalars
from ionloom.operators import frames, matrix, ml, peaks, ranges, signal, workflows
from ionloom.sources import spectra, tables


def test_positions_masks_and_columns(spark):
    df = spark.createDataFrame([(["a", "b", "a"], True, 0.5), (None, None, None), ([], False, 1.0)], "w array<string>, m boolean, p double")
    assert [r.at for r in df.select(frames.positions(F.col("w"), "a").alias("at")).collect()] == [[0, 2], None, []]
    assert [r.m for r in df.select(frames.mask_column(df, "m").alias("m")).collect()] == [True, False, False]
    assert [r.p for r in df.select(frames.mask_column(df, "p", True).alias("p")).collect()] == [0.5, 0.0, 1.0]
    with pytest.raises(TypeError):
        frames.mask_column(df, "p")
    with pytest.raises(KeyError):
        frames.mask_column(df, "q")
    with pytest.raises(Exception, match="probability"):
        df.select(frames.mask_column(df, F.col("p") * 3, True)).collect()
    assert frames.drop_columns(df, "m").columns == ["w", "p"]
    assert frames.drop_columns(df, keep=["p"]).columns == ["p"]
    with pytest.raises(KeyError):
        frames.drop_columns(df, ["zz"])
    roots = spark.createDataFrame([(4.0,), (-1.0,), (None,)], "x double").select(scalars.sqrt(F.col("x")).alias("x"))
    assert [r.x for r in roots.collect()] == [2.0, None, None]


def test_labels_names_and_order(spark):
    df = spark.createDataFrame([("10",), ("2",), (None,), ("2",)], "c string")
    assert [r.c for r in frames.cluster_names(df, "c").collect() if r.c] == ["Cluster 1", "Cluster 1", "Cluster 2"] or sorted(r.c or "" for r in frames.cluster_names(df, "c").collect()) == ["", "Cluster 1", "Cluster 1", "Cluster 2"]
    assert frames.without_labels(spark.createDataFrame([("N/A",), ("x",), (None,)], "c string"), "c").count() == 1
    assert {(r.c, r.position) for r in frames.reorder(df.where("c is not null"), "c", ["2", "10"]).collect()} == {("2", 0), ("10", 1)}
    grouped = frames.reorder(spark.createDataFrame([("f1",), ("f2",)], "f string"), "f", ["B", "A"], {"A": ["f1"], "B": ["f2"]})
    assert {(r.f, r.position) for r in grouped.collect()} == {("f2", 0), ("f1", 1)}
    with pytest.raises(Exception, match="not in the order"):
        frames.reorder(df, "c", ["2"]).collect()
    assert frames.distinct_colors(spark.createDataFrame([("a", "1"), ("a", "1"), (None, "2")], "n string, c string"), "n", "c").count() == 1


def test_stack_and_heatmap(spark):
    wide = spark.createDataFrame([(1, 2.0, 3.0)], "`k` int, `s|a` double, `s|b` double")
    assert sorted(map(tuple, frames.stack(wide, ["k"], ["s"], ["a", "b", "c"]).collect())) == [(1, "a", 2.0), (1, "b", 3.0), (1, "c", None)]
    obs = spark.createDataFrame([("c1", "x", 1.0), ("c2", "y", 9.0), ("c3", None, 5.0)], "cell string, t string, n double")
    long = spark.createDataFrame([("c1", "f", 0.0), ("c2", "f", 3.0), ("c1", "g.1", 7.0)], "cell string, feature string, value double")
    rows = {r.cell: r for r in frames.heatmap_frame(obs, long, ["f", "g.1"], ["t"], log=True).collect()}
    assert rows["c2"]["f"] == pytest.approx(np.log(4)) and rows["c2"]["g.1"] is None and rows["c1"]["category"] == "x"
    rows = {r.cell: r for r in frames.heatmap_frame(obs, long, ["f"], ["n"], num_categories=2, scale="var").collect()}
    assert (rows["c1"]["category"], rows["c2"]["category"], rows["c2"]["f"], rows["c3"]["f"]) == ("0", "1", 1.0, 0.0)
    assert {r["f"] for r in frames.heatmap_frame(obs, long, ["f"], ["t"], scale="obs").collect()} == {0.0}
    assert frames.choose_representation(long, 20)[0] == "X" and frames.choose_representation(long, 200) == ("pcs", None)
    assert frames.export_columns(obs.withColumn("UMAP1", F.lit(0.0)), ["cell"]).columns == ["cell", "UMAP1"]


def test_several_regressors(spark):
    rng = np.random.default_rng(3)
    rows = [(g, i, *map(float, rng.normal(size=3))) for g in "ab" for i in range(30)] + [("c", 0, 1.0, 1.0, 4.0), ("a", 99, None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, i int, x double, z double, value double")
    got = {(r.g, r.i): r.value for r in matrix.regress_out_many(df, ["g"], ["x", "z"]).collect()}
    for g in "ab":
        own = np.array([r[2:] for r in rows if r[0] == g and r[1] < 30])
        a = np.c_[own[:, :2], np.ones(len(own))]
        left = own[:, 2] - a @ np.linalg.lstsq(a, own[:, 2], rcond=None)[0]
        assert np.allclose([got[g, i] for i in range(30)], left)
    assert got["c", 0] == pytest.approx(0) and got["a", 99] is None
    assert matrix.regress_out_many(df.limit(0), ["g"], ["x"]).count() == 0


def test_numbers_do_not_need_one_task(spark):
    rng = np.random.default_rng(4)
    rows = [(None if x < 2 else float(x % 50), int(i)) for i, x in enumerate(rng.integers(0, 400, 1000))]
    df = spark.createDataFrame(rows, "t double, i int")
    want = {i: n + 1 for n, (_, i) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0.0, r[1])))}
    assert {r.i: r.number for r in ranges.running(df, ["t", "i"], parts=7).collect()} == want
    assert ranges.running(df.limit(0), ["t", "i"]).count() == 0


def brute_maxima(x):
    return [i for i in range(1, len(x) - 1) if x[i - 1] is not None and x[i] is not None and x[i + 1] is not None and x[i] > x[i - 1] and x[i] >= x[i + 1]]


def brute_suppressed(at, x, distance):
    left, kept = sorted(at, key=lambda i: (-x[i], -i)), []
    while left:
        kept.append(left[0])
        left = [i for i in left[1:] if abs(i - kept[-1]) > distance]
    return sorted(kept)


def test_suppressed_peaks(spark):
    rng = np.random.default_rng(5)
    x = [None if i % 37 == 0 else float(v) for i, v in enumerate(rng.integers(0, 40, 600))]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(x)], "k string, index long, data double")
    got = sorted(r["index"] for r in signal.suppress(signal.local_maxima(df, ["k"], "data"), ["k"], 6, "data").collect())
    assert got == brute_suppressed(brute_maxima(x), x, 6)


def test_optical_peaks(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = [float(v) for v in 10 + rng.integers(0, 3, 450)]
    for i in range(20, 440, 35):
        x[i] += 30
    folder = tmp_path / "lif"
    folder.mkdir()
    (folder / "run [1]_FITC.txt").write_text("\n".join(f"{i / 10}\t{v}" for i, v in enumerate(x)), encoding="utf-16")
    (folder / "other_PE.txt").write_bytes(b"\xff\xfe")
    got = spectra.load_optical(spark, str(folder), "run [1]", 3, 10, size=100, reach=100, most=5.0, method="median", drop_zero=True).collect()
    size, n = 100, len(x)
    block = [min(i // size, max(-(-n // size) - 2, 0)) for i in range(n)]
    base = [float(np.median([v for v, b in zip(x, block) if b == block[i]])) for i in range(n)]
    sig = np.array([max(v - b, 0.0) for v, b in zip(x, base)])
    lo, hi = np.percentile(sig, [5, 95])
    inside = sig[(sig >= lo) & (sig <= hi)]
    limit = inside.mean() + 3 * inside.std()
    tops = brute_suppressed([i for i in brute_maxima(x) if x[i] >= limit], x, 10)
    stable = [i for i in tops if i and abs(np.mean(base[i : i + 100]) - np.mean(base[max(0, i - 100) : i])) < 5 and sig[i] > 0]
    assert {(r.channel, r.idx, r.corrected_intensity) for r in got} == {("FITC", i, sig[i]) for i in stable} and stable


def test_channel_found_twice(spark):
    rng = np.random.default_rng(7)
    rows = [("r", i, p, float(m), float(j)) for i in range(60) for p, (m, j) in enumerate(zip(500 + rng.normal(0.002, 0.0005, 3), rng.integers(1, 9, 3)))]
    spectra_ = spark.createDataFrame(rows, "run_id string, index long, pos long, mz double, intensity double")
    scans = spark.createDataFrame([("r", i) for i in range(61)], "run_id string, index long")
    found, center = peaks.extract_channel_twice(scans, spectra_, 500.0, 2, keys=("run_id", "index"), order=("pos",))
    nearest = [min((r for r in rows if r[1] == i), key=lambda r: (abs(r[3] - 500.0), r[2])) for i in range(60)]
    assert abs(center - peaks.kde_argmax(np.array([r[3] for r in nearest]))) < 1e-9
    got = {r["index"]: r.mz for r in found.collect()}
    for i in range(60):
        near = [r for r in rows if r[1] == i and abs(r[3] - center) / center * 1e6 <= 2]
        assert (got[i] is None) == (not near)
    assert got[60] is None


def test_intensity_and_raw_threshold(spark):
    df = spark.createDataFrame([("k", float(v), b) for v, b in zip(range(100), [1.0, None] * 50)], "k string, data double, baseline double")
    one = peaks.intensity_threshold(df, "data").first()
    assert (one["mean"], one["median"]) == (49.5, 49.5)
    x = np.arange(100.0)
    inside = x[(x >= np.percentile(x, 5)) & (x <= np.percentile(x, 95))]
    limit = inside.mean() + 5 * inside.std()
    assert {round(r.threshold, 9) for r in signal.raw_threshold(df, ["k"]).collect()} == {round(limit, 9), round(limit - 1, 9)}


def test_removal_and_new_features(spark):
    cells = spark.createDataFrame([("r", 10 * i) for i in range(1, 7)], "run_id string, scan_index long")
    gone = spark.createDataFrame([("r", 2), ("r", 2), ("q", 1)], "run_id string, number long")
    kept = workflows.without_events(cells, gone).orderBy("scan_index").collect()
    assert [(r.scan_index, r.cell) for r in kept] == [(10, "Cell00001"), (30, "Cell00002"), (40, "Cell00003"), (50, "Cell00004"), (60, "Cell00005")]
    peak_rows = [("r", 10 * i, 0, 500.0 + i * 1e-4, 900.0) for i in range(1, 7)]
    peak_table = spark.createDataFrame(peak_rows, "run_id string, scan_index long, pos long, mz double, intensity double")
    library = spark.createDataFrame([(500.0003, "PC", 0)], "lib_mz double, metabolite string, lib_pos int")
    out = workflows.update_matrix(cells, gone, peak_table, library)
    feature = out["features"].collect()
    assert [(f.hits, f.metabolite) for f in feature] == [(5, "PC")]


def test_merged_study(spark):
    head = "batch string, mz_mean string, metabolite string, Cell00001 string, Cell00002 string"
    batches = spark.createDataFrame([("k1", "100.0", "A", "5", ""), ("k1", "200.0", "", "", "7"), ("k2", "100.0005", "B", "1", "2"), ("k2", "300", None, None, None)], head)
    groups = spark.createDataFrame([("k1", "Cell00001", "g"), ("k1", "Cell00002", "g"), ("k2", "Cell00002", "h")], "batch string, CellNumber string, Group string")
    parts = workflows.split_batches(batches, 2)
    assert parts["meta"].count() == 4 and parts["matrix"].count() == 4
    out = workflows.merge_all(batches, groups, 2)
    rows = {round(r.mz_mean, 4): r for r in out["features"].collect()}
    assert rows[100.0002 if 100.0002 in rows else 100.0003].counts == "1/1" and rows[200.0].counts.startswith("1/")
    assert {(r.cell, r.value) for r in out["matrix"].collect()} == {("k1_Cell1", 5.0), ("k1_Cell2", 7.0), ("k2_Cell2", 2.0)}
    assert {r.name for r in out["cells"].collect()} == {"k1_Cell1", "k1_Cell2", "k2_Cell2"}


def test_events_of_several_markers_and_their_tables(spark):
    n = 400
    tic = [10.0 + (50.0 if i % 40 == 20 else i % 3) for i in range(n)]
    scans = spark.createDataFrame([("r", i, i / 60, v) for i, v in enumerate(tic)], "run_id string, scan_index long, scan_start_time double, tic double")
    rows = [("r", i, 0, 760.58, 500.0 if i % 80 == 21 else 5.0 + i % 2) for i in range(n)]
    peak_table = spark.createDataFrame(rows, "run_id string, scan_index long, pos long, mz double, intensity double")
    out = workflows.extract_events(scans, peak_table, {"TIC": None, "PC": 760.58}, "TIC", method="median")
    found = {s: sorted(r.scan_index for r in out["events"].where(F.col("strategy") == s).collect()) for s in ("TIC", "PC")}
    assert found == {"TIC": list(range(20, n, 40)), "PC": list(range(21, n, 80))}
    merged = sorted(r.scan_index for r in out["cells"].collect())
    assert merged == list(range(20, n, 80))
    tables_ = workflows.assemble(out["cells"], out["cells"].select("cell", F.lit("f").alias("feature"), F.when(F.col("scan_index") > 100, "3").otherwise("x").alias("value")), out["signals"])
    obs = {r.scan_index: r for r in tables_["obs"].collect()}
    assert obs[20].n_metabolites == 0 and obs[180].n_metabolites == 1
    assert all(r.tic_corrected == pytest.approx(r.tic - r.tic_baseline) and r.tic_baseline == 11.0 for r in obs.values())
    assert tables_["var"].first().n_cells == sum(i > 100 for i in merged)


def test_log_and_library(spark, tmp_path):
    log = tables.RunLog()
    logger = logging.getLogger("run")
    logger.addHandler(log)
    logger.warning("step %d", 1)
    assert [(r.level, r.message) for r in log.table(spark).collect()] == [("WARNING", "step 1")]
    path = tmp_path / "library.csv"
    path.write_text("mz,Metabolite\n100.5,PC\n")
    assert tables.read_library(spark, str(path), {"Metabolite": "metabolite"}).columns == ["mz", "metabolite"]
    with pytest.raises(KeyError):
        tables.read_library(spark, str(path), {"x": "y"})


def test_neighbours_components_and_clustermap(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 4, (300, 5)).astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "cell long, pcs array<double>")
    got = {(r.src, r.dst) for r in ml.neighbours(df, 4, shard_rows=70, block=32).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert got == {(i, j) for i in range(300) for _, j in sorted((d[i, j], j) for j in range(300) if j != i)[:4]}
    mean, cov, n = ml.covariance(df, "pcs")
    assert n == 300 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True))
    flat = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "cell long, v array<double>")
    assert np.allclose(ml.covariance(flat, "v")[1], [[2, 0], [0, 0]])
    scores = np.array([r.pcs for r in ml.pca(df, 3, vector="pcs")["scores"].orderBy("cell").collect()])
    assert np.allclose(np.cov(scores.T, bias=True), np.diag(np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1][:3]))
    groups = spark.createDataFrame([(g, [float(g // 2 * 10 + g), float(g), 5.0]) for g in (3, 0, 2, 1)], "g int, v array<double>")
    found = ml.clustermap(groups, "g")
    assert {frozenset(found["rows"][:2]), frozenset(found["rows"][2:])} == {frozenset((0, 1)), frozenset((2, 3))} and sorted(found["columns"]) == [0, 1, 2]


def test_percentile_rank_without_groups(spark):
    values = [3.0, None, 1.0, 3.0, 2.0, None]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    got = {r.i: r.pct_rank for r in matrix.percentile_rank(df, "x").collect()}
    want = {r.i: r.pct_rank for r in matrix.percentile_rank(df.withColumn("k", F.lit(1)), "x", ["k"]).collect()}
    assert got == pytest.approx(want)


def test_neighbours_over_chunks(spark):
    rng = np.random.default_rng(9)
    rows = [(None if s == 2 else str(s), int(i), None if rng.random() < 0.1 else float(rng.integers(0, 5))) for s in range(3) for i in sorted(rng.choice(200, 60, replace=False))]
    df = spark.createDataFrame(rows, "k string, index long, x double")
    got = {(r.k, r["index"]): (r._before, r._after) for r in signal.beside(df, ["k"], F.col("x"), chunk=7).collect()}
    for key in ("0", "1", None):
        own = [r for r in rows if r[0] == key]
        for a, b, c in zip([None, *own[:-1]], own, [*own[1:], None]):
            assert got[key, b[1]] == (a and a[2], c and c[2])
    assert len(got) == 180
