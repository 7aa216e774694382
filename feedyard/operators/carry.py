"""Last given values along a key's rows, when one key may hold a large share of them.

The rows of a hot key are cut in blocks by their order; each block's last values are one
narrow row, a scan over the blocks of a key gives what every block starts from, and these
rows are joined back.  Other keys are one block, decided by a plain window.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedyard.operators.skew import hot_keys

#: Order numbers that a block of a hot key spans; a key with more rows is hot.
BLOCK = 100_000


def in_blocks(rows: DataFrame, key: str, order: str, block: int = BLOCK) -> DataFrame:
    """Adds `_blk`: the row's block for hot keys, -1 for the others.  At most rows / block
    keys are hot, so their list is broadcast."""
    hot = hot_keys(rows.select(key), [key], block).select(key, F.lit(True).alias("_hot"))
    return (rows.join(F.broadcast(hot), key, "left")
            .withColumn("_blk", F.when(F.col("_hot"), F.floor(F.col(order) / block)).otherwise(F.lit(-1)).cast("long")).drop("_hot"))


def last_given(rows: DataFrame, key: str, order: str, values: dict[str, Column]) -> DataFrame:
    """Adds now_<name> and was_<name>: the last non-null value up to the row, with and without
    it.  `rows` come from `in_blocks`; a null value is one not given."""
    rows = rows.withColumns({f"_v_{n}": v for n, v in values.items()})
    last = {n: F.max_by(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))) for n in values}
    earlier = Window.partitionBy(key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (rows.filter(F.col("_blk") >= 0).groupBy(key, "_blk").agg(*[v.alias(f"_l_{n}") for n, v in last.items()])
               .select(key, "_blk", *[F.last(f"_l_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in values]))
    rows = rows.join(carried, [key, "_blk"], "left")
    w = Window.partitionBy(key, "_blk").orderBy(order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    out = {}
    for n in values:
        for name, frame in (("now", upto), ("was", before)):
            out[f"{name}_{n}"] = F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(frame), F.col(f"_c_{n}"))
    return rows.withColumns(out).drop(*[f"_{k}_{n}" for k in "vc" for n in values])
