"""Readers of raw acquisitions: scans with ragged peak lists."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.signal import optical_peaks
from .tables import file_name

PEAKS = "array<struct<mz:double,intensity:double>>"
#: Marker lines of the text export (fixed values of the format).
MZ_LINE, INTENSITY_LINE = "cvParam: m/z array, m/z", "cvParam: intensity array, number of detector counts"
#: Lines of a scan in the same export, with the value they carry (fixed values of the format).
ID_LINE, START_LINE, TIC_LINE = r"id: scanId=(.*)", r"cvParam: scan start time, (.*), minute", r"cvParam: total ion current, (.*), number of detector counts"
#: Accessions of the controlled vocabulary (fixed values).
MZ_ARRAY, INTENSITY_ARRAY, FLOAT32, FLOAT64, ZLIB, TIC, START = "MS:1000514", "MS:1000515", "MS:1000521", "MS:1000523", "MS:1000574", "MS:1000285", "MS:1000016"
MINUTE = "UO:0000031"


def load(spark: SparkSession, path: str) -> DataFrame:
    """``run_id, scan_index, scan_id, scan_start_time`` (minutes)``, tic, peaks`` by the path's extension, .txt or .mzML."""
    if path.endswith(".txt"):
        return read_text(spark, path)
    if path.lower().endswith(".mzml"):
        return read_mzml(spark, path)
    raise ValueError(f"neither .txt nor .mzML: {path}")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """The text export: one record per spectrum, so a long file is many splits; chromatograms at the end are passed over.

    A total ion current that is no number is null.
    """
    records = spark.read.option("lineSep", "spectrum:").text(path).select("value", file_name().alias("run_id"))
    value = F.col("value")

    def numbers(marker: str):
        line = F.regexp_extract(value, r"(?m)^\s*" + marker.replace("/", r"\/") + r"\s*\n\s*(.*)$", 1)
        return F.transform(F.slice(F.filter(F.split(line, r"\s+"), lambda x: x != ""), 3, 1 << 30), lambda x: x.try_cast("double"))

    scans = records.where(value.contains("scanId=")).select(
        "run_id",
        F.regexp_extract(value, r"index:\s*(\d+)", 1).try_cast("long").alias("scan_index"),
        F.trim(F.regexp_extract(value, ID_LINE, 1)).alias("scan_id"),
        F.regexp_extract(value, START_LINE, 1).try_cast("double").alias("scan_start_time"),
        F.regexp_extract(value, TIC_LINE, 1).try_cast("double").alias("tic"),
        numbers(MZ_LINE).alias("_mz"),
        numbers(INTENSITY_LINE).alias("_in"),
    )
    return scans.withColumn("peaks", F.zip_with("_mz", "_in", lambda a, b: F.struct(a.alias("mz"), b.alias("intensity")))).drop("_mz", "_in")


_XML = """_index long, _id string, cvParam array<struct<_accession:string,_value:string>>,
scanList struct<scan:array<struct<cvParam:array<struct<_accession:string,_value:string,_unitAccession:string>>>>>,
binaryDataArrayList struct<binaryDataArray:array<struct<cvParam:array<struct<_accession:string>>,binary:string>>>"""


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("mz", pa.float64()), ("intensity", pa.float64())]))
    for batch in batches:
        peaks = []
        for arrays in batch.column(batch.num_columns - 1).to_pylist():
            found: dict[str, np.ndarray] = {}
            for a in arrays or []:
                names = {c["_accession"] for c in a["cvParam"]}
                raw = base64.b64decode(a["binary"] or "")
                raw = zlib.decompress(raw) if ZLIB in names and raw else raw
                values = np.frombuffer(raw, "<f4" if FLOAT32 in names else "<f8").astype(float)
                for key in (MZ_ARRAY, INTENSITY_ARRAY):
                    if key in names:
                        found[key] = values
            mz, intensity = found.get(MZ_ARRAY, np.empty(0)), found.get(INTENSITY_ARRAY, np.empty(0))
            peaks.append([{"mz": float(a), "intensity": float(b)} for a, b in zip(mz, intensity)])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(peaks, kind)], names=[*batch.schema.names[:-1], "peaks"])


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """mzML through the splittable XML source, a row per spectrum; only the binary arrays are decoded outside the JVM.

    The scan id is what follows the last '=' of the native id; times in seconds become minutes.
    """
    rows = spark.read.format("xml").option("rowTag", "spectrum").schema(_XML).load(path)
    of = lambda params, name: F.get(F.filter(params, lambda c: c["_accession"] == name), F.lit(0))
    start = of(F.col("scanList.scan")[0]["cvParam"], START)
    seconds = start["_value"].try_cast("double")
    scans = rows.select(
        file_name().alias("run_id"),
        F.col("_index").alias("scan_index"),
        F.element_at(F.split("_id", "="), -1).alias("scan_id"),
        F.when(start["_unitAccession"] == MINUTE, seconds).otherwise(seconds / 60).alias("scan_start_time"),
        of(F.col("cvParam"), TIC)["_value"].try_cast("double").alias("tic"),
        F.col("binaryDataArrayList.binaryDataArray").alias("arrays"),
    )
    return scans.mapInArrow(_decode, f"run_id string, scan_index long, scan_id string, scan_start_time double, tic double, peaks {PEAKS}")


def exploded(scans: DataFrame) -> DataFrame:
    """``run_id, scan_index, pos, mz, intensity``: a row for each peak."""
    return scans.select("run_id", "scan_index", F.posexplode("peaks").alias("pos", "p")).select("run_id", "scan_index", "pos", "p.mz", "p.intensity")


def read_lif(spark: SparkSession, path: str, prefix: str = "", suffixes: tuple[str, ...] = (".txt", ".tsv", ".csv")) -> DataFrame:
    """Optical traces: header-less, tab-separated UTF-16 files anywhere below ``path`` whose name starts with ``prefix``.

    ``channel`` is what stands between the first underscore and the extension; ``idx`` the row in the file.
    """
    import re

    # other names aren't opened; the characters that a pattern gives a meaning stand for themselves
    starts = re.sub(r"([\[\]{}*?\\])", r"\\\1", prefix)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"{starts}*").load(path).select("path", "content")
    name = F.element_at(F.split("path", "/"), -1)
    ends = "|".join(re.escape(s.lower()) for s in suffixes)
    wanted = files.where(name.startswith(prefix) & F.lower(name).rlike(f"({ends})$"))
    lines = wanted.select(name.alias("name"), F.posexplode(F.split(F.decode("content", "UTF-16"), r"\r?\n")).alias("idx", "line")).where(F.trim("line") != "")
    cells = F.split("line", "\t")
    return lines.select(
        F.regexp_extract("name", r"_(.*?)\.[^.]+$", 1).alias("channel"),
        F.col("idx").cast("long").alias("idx"),
        F.get(cells, F.lit(0)).try_cast("double").alias("times"),
        F.get(cells, F.lit(1)).try_cast("double").alias("intensity"),
    )


def load_optical(spark: SparkSession, path: str, prefix: str = "", k: float = 3, interval: int = 6, **options) -> DataFrame:
    """Optical peaks of every channel whose file's name starts with ``prefix``; no file gives no rows."""
    return optical_peaks(read_lif(spark, path, prefix), ["channel"], k, interval, **options)
