"""Joins whose keys may hold any share of the rows."""

import pytest
from pyspark.sql import functions as F

from docgraph.llm.common import spread_join, stored

KEYS = ["a", "b", None, "c"]


def tables(spark, n):
    rows = [("a" if i % 3 == 0 else KEYS[i % 4] if i % 5 else f"k{i % 40}", i) for i in range(n)]
    left = spark.createDataFrame(rows, "key string, i bigint")
    right = spark.createDataFrame([(k, v) for v, k in enumerate(["a", "c", None, "k5", "k10", "unknown"])], "key string, v int")
    sizes = stored(left.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    return left, right, sizes


@pytest.mark.parametrize("n", [0, 1, 2000])
def test_equals_a_plain_join(spark, n):
    left, right, sizes = tables(spark, n)
    for how in ("left_semi", "inner"):
        got = spread_join(left, right, ["key"], sizes, ["i"], how)
        want = left.join(right, "key", how)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rows_missing_from_sizes_are_kept(spark):
    left, right, sizes = tables(spark, 300)
    got = spread_join(left, right, ["key"], sizes.filter("key = 'a'"), ["i"], "inner")
    assert got.count() == left.join(right, "key").count()
