"""Joins on a hot key: the final plan, not only the result, must not leave the key in one task."""

import pytest
from pyspark.sql import functions as F

from stockloom.operators.checks import fk_violations
from stockloom.operators.nesting import take_while_rows

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture()
def skewed(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    # A third of all rows on one key; several map tasks, so that its partition has pieces to split.
    rows = spark.range(0, 120_000, numPartitions=12)
    yield rows.select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("bigint").alias("k"), F.col("id").alias("v"))
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_take_while_splits_a_hot_group(skewed):
    out = take_while_rows(skewed, ["k"], ["v"], (F.col("v") == 99_999) | (F.col("v") % 1000 == 1))
    assert "skew=true" in final_plan(out)
    # Of the hot group, the rows before 2001 (a multiple of 3), and 7 itself.
    assert out.filter("k = 7").count() == 668


def test_references_split_a_hot_key(spark, skewed):
    parents = spark.range(1_000, numPartitions=12).unionByName(spark.range(1_000))
    out = fk_violations(skewed, F.col("k"), parents, "id", "d", "f", F.col("v"), parent_unique=False)
    assert "skew=true" in final_plan(out)
    assert out.count() == skewed.filter("k >= 1000").count()
