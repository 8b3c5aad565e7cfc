from pyspark.sql import functions as F

from arbora.plans.shared import saved, unbroadcast


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_tables_with_small_files_are_not_broadcast(spark):
    one = saved(spark.range(700_000).select("id", F.lit(1).alias("a"), F.lit(2).alias("b")))
    two = saved(spark.range(700_000).select("id", F.lit(3).alias("c")))
    assert "BroadcastHashJoin" not in plan(one.join(two, "id"))
    assert "BroadcastHashJoin" not in plan(one.where("a = 1").join(two.groupBy("id").agg(F.max("c").alias("c")), "id", "left"))
    parts = two.unionByName(two)
    assert "BroadcastHashJoin" not in plan(two.select("id").unionByName(two.select("id")).join(unbroadcast(parts, 1_400_000), "id"))


def test_small_tables_are_broadcast_to_large_ones(spark):
    large, small = saved(spark.range(700_000).select("id", F.lit(1).alias("a"))), saved(spark.range(100).select("id"))
    assert "BroadcastHashJoin" in plan(large.join(small, "id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan(large.join(saved(spark.range(100).select("id")), "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lists_count_as_their_values(spark):
    rows = saved(spark.range(20_000).select("id", F.sequence("id", F.col("id") + 63).alias("xs")))
    other = saved(spark.range(400_000).select("id", F.lit(1).alias("a"))).where("a = 1")
    assert "BroadcastHashJoin" not in plan(other.join(rows, "id"))
