"""Joins that stay balanced when one key holds a large share of the rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_KEY_ROWS = 1_000_000   # a key with more rows than this on the big side is split
TASK_ROWS = 500_000        # rows a task sorts, while this makes at most PLAIN_PARTS tasks
MOST_TASK_ROWS = 2_000_000
FEW_ROWS = 10_000
PLAIN_PARTS = 200          # a shuffle to no more partitions is written without buffering its rows
BINS = 1 << 16             # hash bins in which rows are counted, where keys are too many


def spread(rows: DataFrame, least: int = 1, along: tuple[str, ...] = ()) -> DataFrame:
    """The rows dealt evenly over several tasks a core, and over `least` tasks, ahead of a step that
    makes many rows of each: a small table is often read by one task.  With `along`, a task has
    rows that follow each other in the order of these columns."""
    spark = rows.sparkSession
    n = max(least, 4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartitionByRange(n, *along) if along else rows.repartition(n)


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions for a step that sorts `rows` rows: a task's share stays bounded as the input grows.
    A small input has no more of them than it has work for."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // FEW_ROWS),
               min(PLAIN_PARTS, -(-rows // TASK_ROWS)), -(-rows // MOST_TASK_ROWS))


def _bin(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BINS)).cast("int")


def hot_bins(rows: DataFrame, key: str, threshold: int) -> DataFrame:
    """Hash bins of `key` (NULL has one too) with more than `threshold` rows, and the number of salts
    `_n` that brings each salt to about `threshold` rows.  At most BINS rows however many keys
    there are: they are counted in bounded memory and broadcast."""
    return (rows.groupBy(_bin(key).alias("_bin")).count().filter(F.col("count") > threshold)
            .select("_bin", F.ceil(F.col("count") / threshold).cast("int").alias("_n")))


def bin_salted(rows: DataFrame, hot: DataFrame, key: str, salt_of: str) -> DataFrame:
    """`rows` with `_salt`: 0, or in a hot bin one of its `_n` by the hash of `salt_of`."""
    salt = F.pmod(F.xxhash64(salt_of), F.coalesce("_n", F.lit(1))).cast("int")
    return rows.withColumn("_bin", _bin(key)).join(F.broadcast(hot), "_bin", "left").withColumn("_salt", salt).drop("_bin", "_n")


def bin_repeated(per_key: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """One row per key, repeated for each `_salt` that `bin_salted` gives rows of the key's bin."""
    salts = F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1)
    return per_key.withColumn("_bin", _bin(key)).join(F.broadcast(hot), "_bin", "left").withColumn("_salt", F.explode(salts)).drop("_bin", "_n")


def hot_keys(big: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    """Keys holding more than `threshold` rows (counted with map-side combine), and the
    number of salts `_n` that brings each salt to about `threshold` rows.

    At most rows / threshold keys can qualify, so the result has a proven bound and
    is broadcast.
    """
    return (big.groupBy(*keys).count().filter(F.col("count") > threshold)
            .select(*keys, F.ceil(F.col("count") / threshold).cast("int").alias("_n")))


def salted_join(big: DataFrame, small_per_key: DataFrame, keys: list[str], how: str = "inner",
                salt_of: str | None = None, threshold: int = HOT_KEY_ROWS) -> DataFrame:
    """Join many rows per key (`big`) to one row per key (`small_per_key`).

    Only hot keys are salted: their rows on the big side are spread over count / threshold
    salt values (hash of `salt_of`, or of all columns) and their single row on the
    small side is repeated once per salt value, so the small side grows by at most
    rows / threshold rows.  Rows with a NULL key match nothing: they are spread over
    negative salts.  `how` is inner or left.
    """
    hot = F.broadcast(hot_keys(big, keys, threshold))
    src = F.col(salt_of) if salt_of else F.struct(*[F.col(c) for c in big.columns])
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    spread = F.xxhash64(src)
    b = (big.join(hot, keys, "left")
         .withColumn("_salt", F.when(no_key, -1 - F.pmod(spread, F.lit(1 << 20)))
                     .when(F.col("_n").isNotNull(), F.pmod(spread, F.col("_n"))).otherwise(F.lit(0)).cast("int"))
         .drop("_n"))
    s = (small_per_key.join(hot, keys, "left")
         .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_n"), F.lit(1)) - 1)))
         .drop("_n"))
    return b.join(s, keys + ["_salt"], how).drop("_salt")
