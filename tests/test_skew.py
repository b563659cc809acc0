"""Joins of hot keys, and tables written in between."""

import os

import pytest
from pyspark.sql import functions as F

from kollate.operators.skew import spread_join
from kollate.session import cut, release


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_the_plain_join(spark, how):
    many = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 97 == 0, F.lit(None)).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    few = spark.createDataFrame([(1, "a"), (1, "b"), (7, "c"), (None, "d"), (99, "e")], "k long, w string")
    got = spread_join(many, few, ["k"], how, rows=100)
    want = many.join(few, ["k"], how)
    order = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert order(got) == order(want)


def test_spread_join_of_empty_tables(spark):
    df = spark.createDataFrame([(1, 2)], "k long, v long")
    assert spread_join(df.limit(0), df.withColumnRenamed("v", "w"), ["k"]).count() == 0 and spread_join(df, df.limit(0).withColumnRenamed("v", "w"), ["k"]).count() == 0


def test_released_tables_are_removed(spark):
    df = cut(spark.range(10), "kept")
    later = cut(df.filter("id > 3"), "later", df)
    folder = df._cut.removeprefix("file://")
    assert later.count() == 6 and not os.path.exists(folder)
    release(later)
    assert not os.path.exists(later._cut.removeprefix("file://"))
