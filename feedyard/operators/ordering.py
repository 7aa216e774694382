"""Ordered numbering without a single-partition window."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedyard.session import fresh_scratch_path


def stage(df: DataFrame, kind: str) -> DataFrame:
    """Write `df` once to the shared scratch folder and read it back."""
    path = fresh_scratch_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def global_rank(df: DataFrame, order_cols: list, out: str = "rank") -> DataFrame:
    """1-based position of each row in `order_cols` order (keys must be unique).

    A range-partitioned sort, an id taken right after it, the sorted rows
    checkpointed (so both uses below see the same partitions), then per-partition
    counts (one row per partition) turned into offsets.
    """
    ranked = (df.orderBy(*order_cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    parts = ranked.groupBy("_pid").agg(F.count("*").alias("_n"), F.min("_mid").alias("_min"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    # one row per shuffle partition: bounded, safe to broadcast
    return (ranked.join(F.broadcast(parts.select("_pid", "_min", "_off")), "_pid")
            .withColumn(out, F.col("_off") + F.col("_mid") - F.col("_min") + 1)
            .drop("_pid", "_mid", "_min", "_off"))
