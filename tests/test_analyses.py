"""Registered analyses on small fixtures against brute force."""

import datetime as dt
import itertools

import pytest

from ionloom.operators import signal
from ionloom.plans import all_queries
from ionloom.plans.roles import signal as series


def test_cell_peaks_takes_all_scans(spark, tmp_path):
    orders = [1, 2, 3, 7, 50, 51, 100]
    items = [(k, n, 10 * k + n, 1000.0 + 40 * n + (k % 3) * 0.1, float(1 + (7 * k + n) % 11)) for k in orders for n in (1, 2, 3)]
    spark.createDataFrame([(k, 1.0) for k in orders], "o_orderkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {(r.cell, r.mz, r.intensity, r.pos) for r in all_queries()["cell_peaks"](spark, str(tmp_path)).collect()}
    want = set()
    for cell in orders:
        around = sorted((m, k - cell, q) for k, n, _, m, q in items if abs(k - cell) <= 1)
        chain = []
        for one, after in itertools.zip_longest(around, around[1:]):
            chain.append(one)
            if after is None or after[0] - one[0] > one[0] * 200e-6:
                m, d, q = min(chain, key=lambda x: (-x[2], x[0], x[1]))
                want.add((f"Cell{cell:05d}", m, q, d))
                chain = []
    assert got == want


def test_peak_matching_covers_every_position(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=i), "click", 50.0 if i % 97 == 40 else 1.0 + (i * 13 % 10) / 10) for i in range(7000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.cell, r.apex) for r in all_queries()["peak_matching"](spark, str(tmp_path)).collect()}
    signals = series(spark, str(tmp_path)).withColumnRenamed("event_type", "feature")
    apexes = [r[0] for r in signal.detect_events(signals, ["feature"], 2, 6, 100, "median").select("index").collect()]
    want = set()
    for i in range(7000):
        near = [(abs(a - i), a) for a in apexes if abs(a - i) <= 1]
        if near:
            want.add((f"Cell{i:05d}", min(near)[1]))
    assert max(apexes) > 6000 and got == want
