"""Load a feed directory into classified rows with ordinals and batch numbers."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedyard import schemas as S
from feedyard.operators import clean
from feedyard.operators.ordering import stage
from feedyard.session import scratch_root
from feedyard.sources import feed as FD


@dataclass
class Feed:
    facts: DataFrame   # one row per file
    rows: DataFrame    # every data row: file_rank, path, ord, outcome, cleaned values
    acc: DataFrame     # accepted rows + acc_ord and batch


def load_feed(spark: SparkSession, path: str | list[str], batch_size: int = S.IMPORT_BATCH_SIZE,
              in_order: bool = False) -> Feed:
    scratch_root(spark)  # make sure checkpoints have a shared home
    facts = stage(FD.file_facts(spark, path, in_order), "facts")
    # Stage the parsed, classified rows once: the ids taken at the scan stay valid for the
    # later ordinal joins, and an executor loss re-reads the stage, not the CSV.
    n = FD.shape(facts)
    small = n["files"] <= FD.SMALL_TABLE_ROWS
    staged = clean.classify(FD.scan_feed(spark, path, facts, n)).checkpoint(eager=True)

    rows = FD.with_ordinals(staged)

    # the accepted rows' ids: in scan order, if the file table was broadcast; a shuffled join
    # has moved the rows, so they are numbered inside their block
    block = Window.partitionBy("file_rank", "bs").orderBy("m1")
    acc = clean.accepted(staged)
    acc = acc.withColumn("m2", F.monotonically_increasing_id() if small else F.row_number().over(block).cast("long"))
    all_blocks = FD.block_offsets(staged, "m1", "blk").select("file_rank", "bs", "blk_min", "blk_off")
    acc_blocks = FD.block_offsets(acc, "m2", "acc").select("file_rank", "bs", "acc_min", "acc_off")
    blocks = all_blocks.join(acc_blocks, ["file_rank", "bs"])
    acc = (FD.join_small(acc, blocks, ["file_rank", "bs"])
           .withColumn("ord", F.col("blk_off") + F.col("m1") - F.col("blk_min") + 1)
           .withColumn("acc_ord", F.col("acc_off") + F.col("m2") - F.col("acc_min") + 1)
           .withColumn("batch", F.ceil(F.col("acc_ord") / F.lit(batch_size)).cast("long")))
    return Feed(facts=facts, rows=rows, acc=acc)
