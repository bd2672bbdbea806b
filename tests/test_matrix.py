"""Small cases of the matrix, model and source operators."""

import base64
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.operators import matrix, ml, pseudotime
from ionloom.sources import config, spectra, tables


def test_half_minimum(spark):
    df = spark.createDataFrame([(1, 1, 8.0), (2, 1, None), (3, 1, 12.0), (1, 2, None)], "cell int, feature int, value double")
    got = {(r.cell, r.feature): r.value for r in matrix.fill_missing(df, "half_min").collect()}
    assert got == {(1, 1): 8.0, (2, 1): 4.0, (3, 1): 12.0, (1, 2): None}
    with pytest.raises(ValueError, match="fraction"):
        matrix.fill_missing(df, "min_fraction", 0)


def test_aggregate_rules(spark):
    df = spark.createDataFrame([("a", 1, 2.0, True), ("a", 1, 4.0, False), ("a", 1, None, True), ("b", 1, 3.0, True)], "g string, feature int, value double, keep boolean")
    got = {r.g: r for r in matrix.aggregate(df, ["g"], ["count_nonzero", "sum", "mean", "median", "var"], mask=F.col("keep")).collect()}
    assert (got["a"].count_nonzero, got["a"].sum, got["a"].median) == (2, 2.0, 3.0)
    assert got["a"].mean == pytest.approx(2 / 3)
    assert got["b"]["var"] is None
    with pytest.raises(ValueError, match="unknown"):
        matrix.aggregate(df, ["g"], "mode")


def test_flat_features_scale_to_zero(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (2, 1, 5.0), (1, 2, None)], "cell int, feature int, value double")
    assert {r.value for r in matrix.standard_scale(df, "feature").collect()} == {0.0}
    assert [r.value for r in matrix.z_score(df.where("feature = 1"), ["feature"]).collect()] == [0.0, 0.0]


def test_slope(spark):
    df = spark.createDataFrame([("m", 1, 2.0), ("m", 2, 4.0), ("m", 3, 7.0), ("n", 1, 1.0)], "metabolite string, bin long, stat double")
    assert {r.metabolite: r.slope for r in pseudotime.slopes(df).collect()} == {"m": pytest.approx(2.5), "n": None}


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4)) @ np.diag([5, 3, 1, 0.1]) + 7
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "cell long, v array<double>")
    out = ml.pca(df, 2)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert out["variance"] == pytest.approx(values[:2])
    scores = np.array([r.pcs for r in out["scores"].orderBy("cell").collect()])
    assert scores == pytest.approx((x - x.mean(0)) @ out["loadings"])


def test_linkage_is_complete():
    d = np.array([[0, 1, 5.0], [1, 0, 4], [5, 4, 0]])
    merges, order = ml.linkage(d)
    assert merges[:, 2].tolist() == [1.0, 5.0] and sorted(order) == [0, 1, 2]
    assert ml.correlations(np.array([[1.0, 2, 3], [3, 2, 1]]), "kendall")[0, 1] == pytest.approx(-1)


def test_centroid_takes_a_real_point(spark):
    df = spark.createDataFrame([("a", i, float(i), 0.0) for i in range(5)], "g string, id int, x double, y double")
    assert matrix.centroid(df, ["g"], ["x", "y"], "id").first().id == 2


def test_text_spectra(spark, tmp_path):
    one = """spectrum:
        index: {i}
        id: scanId={i}7
        cvParam: total ion current, {t}, number of detector counts
              cvParam: scan start time, 0.{i}, minute
        binaryDataArray:
          cvParam: m/z array, m/z
          binary: [2] 100.5 200.25
        binaryDataArray:
          cvParam: intensity array, number of detector counts
          binary: [2] 7 8
"""
    path = tmp_path / "run.txt"
    path.write_text("mzML:\n" + one.format(i=0, t="12.5") + one.format(i=1, t="x") + "chromatogram:\n  cvParam: intensity array, number of detector counts\n  binary: [1] 3\n")
    got = spectra.load(spark, str(path)).orderBy("scan_index").collect()
    assert [(r.scan_id, r.scan_start_time, r.tic) for r in got] == [("07", 0.0, 12.5), ("17", 0.1, None)]
    assert [(p.mz, p.intensity) for p in got[1].peaks] == [(100.5, 7.0), (200.25, 8.0)]
    with pytest.raises(ValueError, match="neither"):
        spectra.load(spark, "x.raw")


def test_mzml_spectra(spark, tmp_path):
    def array(values, kind):
        raw = base64.b64encode(zlib.compress(np.array(values, "<f8").tobytes())).decode()
        return f'<binaryDataArray><cvParam accession="MS:1000523"/><cvParam accession="MS:1000574"/><cvParam accession="{kind}"/><binary>{raw}</binary></binaryDataArray>'

    path = tmp_path / "run.mzML"
    path.write_text(
        '<mzML><run><spectrumList><spectrum index="0" id="controllerType=0 scan=5"><cvParam accession="MS:1000285" value="9.5"/><scanList><scan>'
        '<cvParam accession="MS:1000016" value="90" unitAccession="UO:0000010"/></scan></scanList><binaryDataArrayList>'
        + array([1.5, 2.5], "MS:1000514") + array([10, 20], "MS:1000515") + "</binaryDataArrayList></spectrum></spectrumList></run></mzML>"
    )
    r = spectra.load(spark, str(path)).first()
    assert (r.scan_id, r.scan_start_time, r.tic) == ("5", 1.5, 9.5)
    assert [(p.mz, p.intensity) for p in r.peaks] == [(1.5, 10.0), (2.5, 20.0)]


def test_optical_traces(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x_FITC.TXT").write_bytes("0.1\t5\r\n0.2\t6\r\n".encode("utf-16"))
    (tmp_path / "y_PE.txt").write_bytes("1\t2\n".encode("utf-16"))
    got = spectra.read_lif(spark, str(tmp_path), "x").orderBy("idx").collect()
    assert [(r.channel, r.idx, r.times, r.intensity) for r in got] == [("FITC", 0, 0.1, 5.0), ("FITC", 1, 0.2, 6.0)]


def test_annotations(spark):
    files = spark.createDataFrame([("run1-20240101@T$m1#FITC&B$m2#PE@.txt",), ("plain.txt",)], "filename string")
    markers = spark.createDataFrame([("m1", 1.0), ("m2", 2.0)], "marker_name string, mz double")
    colors = spark.createDataFrame([("T", "#1"), ("B", "#2")], "cell_type string, color_code string")
    got = tables.annotations(files, markers, colors).orderBy("filename", "cell_type").collect()
    assert [(r.base, r.cell_type, r.channel, r.mz, r.is_marker) for r in got] == [("plain", None, None, None, False), ("run1-20240101", "B", "PE", 2.0, True), ("run1-20240101", "T", "FITC", 1.0, True)]
    with pytest.raises(Exception, match="unknown marker"):
        tables.annotations(files, markers.limit(0), colors).collect()


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"offset": 2, "signal": {"sn_ratio": 10}, "ppm_tolerance": 5, "cell_marker": {"PC": 760.5}, "main_cell_marker": "PC"}')
    c = config.load(str(path))
    assert (c.offset, c.sn_ratio, c.ppm_threshold, c.main_cell_marker) == (2, 10, 5, "PC")
    with pytest.raises(ValueError, match="above 0"):
        config.Config(offset=0)
    with pytest.raises(ValueError, match="none is the main"):
        config.Config(cell_marker={"a": 1.0, "b": 2.0})
    assert config.prefer_text(["a.txt", "a.mzML", "b.mzML"]) == ["a.txt", "b.mzML"]


def test_dataset_and_sinks(spark, tmp_path):
    df = spark.range(3)
    tables.Dataset({"t": df}).save(str(tmp_path / "d"))
    assert tables.Dataset.load(spark, str(tmp_path / "d"), ["t"]).tables["t"].count() == 3
    tables.write(df, str(tmp_path / "o.tsv"))
    with pytest.raises(ValueError, match="can't write"):
        tables.write(df, "x.xls")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "Group info_k1.csv").write_text("CellNumber,Group\nCell1,x\n")
    assert tables.read_batches(spark, str(tmp_path / "b"), "Group info_").first().batch == "k1"
