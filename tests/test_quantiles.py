"""Exact quantiles by range counts against numpy."""

import random

import numpy as np
import pytest

from ionloom.operators.quantiles import exact_quantiles


def test_equal_numpy(spark):
    rnd = random.Random(4)
    rows = [("a", rnd.gauss(0, 5)) for _ in range(5000)] + [("b", float(rnd.choice([1, 1, 1, 2, 9]))) for _ in range(3001)]
    rows += [("c", 7.0), ("d", 1.0), ("d", 2.0), ("e", None), (None, 3.0), (None, 5.0), (None, None)] + [("f", 4.0)] * 2000 + [("f", rnd.random()) for _ in range(900)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = [0.0, 0.05, 0.25, 0.5, 0.731, 0.95, 1.0]
    for accuracy in (20, 1000):
        got = {r.g: r.quantiles for r in exact_quantiles(df.repartition(7), ["g"], "v", shares, accuracy=accuracy).collect()}
        assert got.keys() == {g for g, _ in rows} and got["e"] is None
        for g in got.keys() - {"e"}:
            want = np.percentile([v for k, v in rows if k == g and v is not None], [100 * s for s in shares])
            assert got[g] == pytest.approx(want.tolist(), rel=1e-12, abs=1e-12)


def test_without_keys_and_without_rows(spark):
    df = spark.createDataFrame([(float(x),) for x in range(101)], "v double")
    assert exact_quantiles(df, [], "v", [0.5, 0.95]).first().quantiles == [50.0, 95.0]
    assert exact_quantiles(df.limit(0).selectExpr("v", "1 AS g"), ["g"], "v", [0.5]).count() == 0


def test_two_keys(spark):
    df = spark.createDataFrame([(i % 2, i % 3, float(i)) for i in range(600)], "a int, b int, v double")
    got = {(r.a, r.b): r.q for r in exact_quantiles(df, ["a", "b"], "v", [0.5], "q").collect()}
    assert got == {(a, b): [float(np.median([i for i in range(600) if i % 2 == a and i % 3 == b]))] for a in range(2) for b in range(3)}
