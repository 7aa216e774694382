from pyspark.sql import functions as F

from feedyard.operators.skew import hot_keys, salted_join


def frames(spark):
    k = F.col("id") % 3
    big = spark.range(6000).select(F.when(k == 0, F.lit(7)).when(k == 1, F.lit(None)).otherwise(F.col("id") % 50).alias("k"),
                                   F.col("id").alias("v"))
    return big, spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))


def test_salted_join_equals_plain_join(spark):
    big, small = frames(spark)
    for how in ("inner", "left"):
        plain = sorted(map(str, big.join(small, "k", how).collect()))
        assert plain == sorted(map(str, salted_join(big, small, ["k"], how, salt_of="v", threshold=100).collect()))


def test_salts_follow_the_count(spark):
    big, _ = frames(spark)
    assert {r["k"]: r["_n"] for r in hot_keys(big, ["k"], 100).collect() if r["k"] is not None} == {7: 21}


def test_hot_and_null_keys_are_split(spark):
    """No task of the join holds the 2,000 rows of the hot key, nor those without a key."""
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for c, v in zip(old, ("16", "false", "-1"), strict=True):
            spark.conf.set(c, v)
        big, small = frames(spark)
        parts = salted_join(big, small, ["k"], "left", salt_of="v", threshold=100).withColumn("p", F.spark_partition_id())
        for rows in (parts.filter("k = 7"), parts.filter("k is null")):
            sizes = [r["count"] for r in rows.groupBy("p").count().collect()]
            assert sum(sizes) >= 2000 and len(sizes) >= 8 and max(sizes) <= 600
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
