"""Connected components by alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedyard.llm.common import stage, unstage


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of longs to (v, comp): the smallest vertex reachable, for every
    vertex that has an edge to another one.

    Every step keeps connectivity and pulls vertices towards the smallest neighbour;
    the number of steps grows with the logarithm of the longest path.  Each step is
    written to the shared folder.  Links never reach the driver, only their count and a
    checksum.  Self links and repeated links change nothing.
    """
    e = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = _mark(e)
    while mark[0]:
        # large star: each vertex ties its larger neighbours to the smallest it sees
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v"))
        # small star: each vertex ties its smaller neighbours, and itself, to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct())
        new = stage(small, "links")
        unstage(e)
        e, old, mark = new, mark, _mark(new)
        if mark == old:
            break
    return e.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("v"), "comp").unionAll(
        e.select(F.col("v"), F.col("v").alias("comp")).distinct())
