import os

import pytest
from pyspark.sql import functions as F

from claimloom import session
from claimloom.plans import sql_catalog


def test_stored_tables_can_be_cleared(spark):
    session.clear_stored(spark)
    kept = session.stored(spark.range(5))
    folder = kept.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert kept.count() == 5 and os.path.exists(folder)
    assert session.clear_stored(spark) == 1 and not os.path.exists(folder) and session.clear_stored(spark) == 0


def test_salted_join_equals_a_left_join(spark):
    left = spark.range(300).selectExpr("id", "if(id % 3 = 0, null, cast(id % 7 as string)) k", "1 __wpart")
    right = spark.createDataFrame([("1", 10), ("2", 20), (None, 30)], "k string, v int")
    got = {(r.id, r.k, r.v) for r in session.salted_join(left, right, "k", F.col("id")).collect()}
    assert got == {(r.id, r.k, r.v) for r in left.join(right, "k", "left").collect()} and len(got) == 300
    # As a struct, null is a value.
    named = F.struct("k").alias("s")
    both = session.salted_join(left.withColumn("s", named), right.select(named, "v"), "s", F.col("id"))
    assert {r.v for r in both.filter("k is null").collect()} == {30} and both.count() == 300


def test_a_hot_key_is_spread(spark):
    left = spark.range(8000).selectExpr("id", "'hot' k")
    right = spark.range(50_000).selectExpr("if(id = 0, 'hot', cast(id as string)) k", "id v")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        joined = session.salted_join(left, right, "k", F.col("id"))
        sizes = joined.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == 8000 and max(sizes) < 8000 / 2


def test_only_inputs_of_one_partition_are_dealt(spark):
    assert session.dealt(spark.range(100).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert session.dealt(spark.range(0, 100, 1, 3)).rdd.getNumPartitions() == 3
    shuffled = spark.range(10).groupBy("id").count()
    assert session.dealt(shuffled) is shuffled


def test_reports_reach_the_driver_within_a_bound(spark):
    spark.range(20).createOrReplaceTempView("twenty")
    report = sql_catalog.Report("SELECT id FROM twenty", {})
    assert len(sql_catalog.run_or_none(spark, report)) == 20
    with pytest.raises(ValueError):
        sql_catalog.run_or_none(spark, report, most=5)
    assert sql_catalog.run_or_none(spark, sql_catalog.Report("SELECT * FROM no_such_table", {})) is None
