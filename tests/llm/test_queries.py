"""The queries of the subpackage against their SQL on the smallest data set, and at other partitionings."""

import os

import pytest

from plantgauge.llm.queries import QUERIES, SQL
from tests.oracle import compare, connect, rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    said = compare(spark, connect(SF), QUERIES[name], SQL[name], SF)
    assert said.startswith("same"), said


@pytest.mark.parametrize("name", ["p4_found", "p5_percentiles", "p7_ids", "p8_found", "p9_found"])
def test_partitioning_does_not_show(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = QUERIES[name](spark, SF)
            got.append(rows_of(df.columns, [tuple(r) for r in df.collect()]))
        assert got[0] == got[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
