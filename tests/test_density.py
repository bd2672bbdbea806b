"""The registered density centres use the operator's own grid."""

import random

from ionloom.operators.peaks import kde_argmax
from ionloom.plans import all_queries


def test_kde_center_has_the_default_grid(spark, tmp_path):
    rnd = random.Random(3)
    items = [(k, k % 4, 1, k, round(rnd.uniform(900, 90_000), 2), 1.0) for k in range(200)]
    schema = "l_orderkey long, l_suppkey long, l_linenumber int, l_partkey long, l_extendedprice double, l_quantity double"
    spark.createDataFrame(items, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.cell: r.center for r in all_queries()["kde_center"](spark, str(tmp_path)).collect()}
    import numpy as np

    assert got == {c: kde_argmax(np.array([m for _, cell, _, _, m, _ in items if cell == c]), 10_000) for c in range(4)}
