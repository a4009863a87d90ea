"""Registered queries run over whole tables of the smallest data."""

import pytest

import __spark_entry__ as entry

NAMES = [n for n in entry.queries() if n.startswith("op")]


@pytest.mark.parametrize("name", NAMES)
def test_registered(spark, name):
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    table = {"op2_rabitq": "embeddings", "op7_warc": "pages"}.get(name, "documents")
    rows = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").count()
    n = df.count()
    assert n >= rows if name in ("op1_packing", "op3_mixing") else n == rows if name != "op6_pivots" else n > 0
