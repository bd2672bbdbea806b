"""Rows of one id with different texts."""

import corpus_pipeline
import pytest

from ionloom.llm import simhash

from .conftest import prose


@pytest.mark.parametrize("keep", [simhash.keep_one, lambda df: corpus_pipeline.near_duplicate_stage(None, df, "unused")])
def test_texts_of_one_id_are_documents_of_their_own(spark, keep):
    a, b, c = (prose(k, 100, 3_000) for k in (31, 32, 33))
    rows = [(1, a), (2, b), (2, None), (2, a), (3, c), (3, c), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text or "") for r in keep(df).collect()))
    assert got == sorted([(1, a), (2, b), (2, ""), (3, c)])
