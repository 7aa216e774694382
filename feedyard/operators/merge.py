"""Catalog changes: keep-last de-dup, batch/file upsert, create, patch, delete.

The upsert reproduces a loop that applies a file batch by batch, where each batch
keeps the last row per case-insensitive SKU, updates name / description / active of
an existing row (its id, created_at, updated_at and stored spelling stay) and inserts
new keys.  As one set job:
  level 1  per (file, batch, key): last row's values and spelling      (A3)
  level 2  per key: values of the last row overall; spelling of the
           last row inside the first batch that held the key           (D2)
  join     full outer with the table on the key                        (J2)
  ids      new keys numbered after max(id) in first-appearance order
Both aggregates combine map-side, so a key holding a third of the rows collapses
to one record per map task before any shuffle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedyard.operators.ordering import global_rank
from feedyard.operators.skew import salted_join

VALUE_FIELDS = ("sku", "name", "description", "active")


def keep_last(acc: DataFrame, group=("file_rank", "batch")) -> DataFrame:
    """A3: per (file, batch, key) the last row wins; first position kept."""
    return acc.groupBy(*group, "sku_key").agg(
        F.max_by(F.struct(*VALUE_FIELDS), "ord").alias("last"),
        F.min("ord").alias("first_ord"),
        F.max("ord").alias("last_ord"),
        F.count("*").alias("n_rows"),
    )


def per_key(acc: DataFrame, key_partitions: int | None = None) -> DataFrame:
    """D2 level 2: one row per key over all files and batches, in file order.

    `key_partitions` places the level-2 shuffle on sku_key with that many
    partitions (the catalog's bucket count), so the merge join needs no other one.
    """
    lvl1 = keep_last(acc)
    if key_partitions:
        lvl1 = lvl1.repartition(key_partitions, "sku_key")
    return lvl1.groupBy("sku_key").agg(
        F.min_by(F.col("last.sku"), F.struct("file_rank", "batch")).alias("first_spelling"),
        F.max_by(F.col("last"), F.struct("file_rank", "last_ord")).alias("final"),
        F.min(F.struct("file_rank", "first_ord")).alias("first_pos"),
    )


def upsert(table: DataFrame, acc: DataFrame, run_ts, key_partitions: int | None = None, max_id: int | None = None) -> DataFrame:
    """The table after applying every accepted feed row.

    With a catalog bucketed by sku_key, pass its bucket count as `key_partitions`.
    `max_id`: the largest id so far, where `table` is only a part of the catalog.
    """
    keys = per_key(acc, key_partitions)
    j = table.alias("t").join(keys.alias("k"), "sku_key", "full_outer")
    hit = F.col("k.first_pos").isNotNull()
    existing = j.filter(F.col("t.id").isNotNull()).select(
        F.col("t.id").alias("id"),
        F.col("t.sku").alias("sku"),
        F.when(hit, F.col("k.final.name")).otherwise(F.col("t.name")).alias("name"),
        F.when(hit, F.col("k.final.description")).otherwise(F.col("t.description")).alias("description"),
        F.when(hit, F.col("k.final.active")).otherwise(F.col("t.active")).alias("active"),
        F.col("t.created_at").alias("created_at"),
        F.col("t.updated_at").alias("updated_at"),
        F.col("sku_key"),
    )
    if max_id is None:
        max_id = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    fresh = j.filter(F.col("t.id").isNull()).select(
        F.col("k.first_pos").alias("first_pos"),
        F.col("k.first_spelling").alias("sku"),
        F.col("k.final.name").alias("name"),
        F.col("k.final.description").alias("description"),
        F.col("k.final.active").alias("active"),
        F.col("sku_key"),
    )
    fresh = global_rank(fresh, ["first_pos"], "rank").select(
        (F.lit(max_id) + F.col("rank")).cast("long").alias("id"),
        "sku", "name", "description", "active",
        F.lit(run_ts).cast("timestamp").alias("created_at"),
        F.lit(run_ts).cast("timestamp").alias("updated_at"),
        "sku_key",
    )
    return existing.unionByName(fresh)


def batch_rows_affected(acc: DataFrame, table: DataFrame) -> DataFrame:
    """A4: per (file, batch) distinct keys, split into inserted and updated.

    A key counts as an update when the table held it before the run or an earlier
    batch (in file order) already inserted it.
    """
    lvl1 = keep_last(acc).select("file_rank", "batch", "sku_key")
    first = lvl1.groupBy("sku_key").agg(F.min(F.struct("file_rank", "batch")).alias("fb"))
    known = table.select("sku_key").withColumn("in_table", F.lit(True))
    per_key = first.join(known, "sku_key", "left")   # one row per feed key
    x = (salted_join(lvl1, per_key, ["sku_key"], "inner", salt_of="batch")
         .withColumn("is_insert", F.col("in_table").isNull()
                     & (F.col("fb.file_rank") == F.col("file_rank")) & (F.col("fb.batch") == F.col("batch"))))
    return x.groupBy("file_rank", "batch").agg(
        F.count("*").alias("rows_affected"),
        F.count_if("is_insert").alias("inserted"),
        F.count_if(~F.col("is_insert")).alias("updated"),
    )
