"""The landing zone, a folder that uploaded feeds arrive in, as a stream.

Each micro-batch puts its files through the gates and the sample validation.  Rejected files
are logged with their messages; the others are imported as version batch_id + 1 of the
catalog.  An import that raises is logged as a try and raised again: the micro-batch stays
uncommitted, its files stay in the folder, and the next start of the stream takes it up.
The last try is logged as failed and lets the stream go on.  Files leave the folder
(`clean_source`) only after their micro-batch was committed: imported, rejected or failed.

The files of a micro-batch share its tries; `max_files=1` gives each file its own.  A file of
no bytes, which Spark's scans leave out, is judged with the next micro-batch.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedyard import schemas as S
from feedyard.operators import validate
from feedyard.operators.ordering import stage
from feedyard.session import fresh_scratch_path, path_exists
from feedyard.sources import feed as FD
from feedyard.sources.feed_loader import load_feed
from feedyard.sources.partitioned import PartitionedCatalog
from feedyard.streaming.streams import _run

LOG_SCHEMA = "path STRING, outcome STRING, tries INT, total_rows BIGINT, message STRING"


def _outcomes(log: str, batch_id: int) -> str:
    return f"{log}/outcomes/batch={batch_id:09d}"


def _try(log: str, batch_id: int, n: int) -> str:
    return f"{log}/tries/batch={batch_id:09d}/try={n}"


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """Every decision: files accepted, rejected or failed, and those retried, by micro-batch."""
    there = [f"{log}/{kind}" for kind in ("outcomes", "tries") if path_exists(spark, f"{log}/{kind}")]
    if not there:
        return spark.createDataFrame([], f"{LOG_SCHEMA}, batch INT")
    parts = [spark.read.schema(f"{LOG_SCHEMA}, batch INT").parquet(p).drop("try") for p in there]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _empty_arrivals(spark: SparkSession, feed_path: str, log: str, batch_id: int) -> list[str]:
    """Files of no bytes that no other micro-batch has judged."""
    found = FD.list_files(spark, feed_path).filter("length = 0").select("path")
    judged = read_log(spark, log).filter((F.col("batch") != batch_id) & (F.col("outcome") != "retried")).select("path")
    return [r["path"] for r in found.join(judged, "path", "left_anti").orderBy("path").collect()]


def land(spark: SparkSession, feed_path: str, store: PartitionedCatalog, run_ts, log: str,
         batch_size: int = S.IMPORT_BATCH_SIZE, tries: int = S.IMPORT_TRIES, max_mb: float | None = None,
         checkpoint: str | None = None, clean_source: str | None = None, archive_dir: str | None = None,
         max_files: int = 1000) -> None:
    """Run the stream over what has arrived; version 0 of `store` is the starting table.

    `clean_source` is "delete" or "archive" (with `archive_dir`).  Raises the import's error
    on each try but the last; start it again with the same `checkpoint` for the next one.
    """
    listing = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"
    reader = spark.readStream.format("binaryFile").schema(listing).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files)
    if clean_source:
        reader = reader.option("cleanSource", clean_source)
        if archive_dir:
            reader = reader.option("sourceArchiveDir", archive_dir)

    def record(rows: DataFrame, folder: str) -> None:
        rows.write.mode("overwrite").parquet(folder)

    def apply(batch: DataFrame, batch_id: int) -> None:
        arrived = batch.select("path").orderBy("modificationTime", "path").collect()  # at most max_files names
        paths = [r["path"] for r in arrived]
        paths += [p for p in _empty_arrivals(spark, feed_path, log, batch_id) if p not in paths]
        if not paths:
            store.publish_parts(None, batch_id + 1, batch_id, [])
            return
        n = 1
        while path_exists(spark, _try(log, batch_id, n)):
            n += 1
        files = None
        try:
            feed = load_feed(spark, paths, batch_size, in_order=True)
            verdict = validate.verdict(feed.facts, feed.rows, max_mb=max_mb).join(feed.facts.select("file_rank", "path"), "file_rank")
            files = stage(verdict.select("file_rank", "path", "is_valid", "total_rows", "errors"), "landing")
            valid = files.filter("is_valid").select("file_rank")
            store.upsert(FD.join_small(feed.acc, valid, "file_rank", "left_semi"), run_ts, batch_id, batch_id + 1)
            failure = None
        except Exception as e:
            failure = f"{type(e).__name__}: {e}"
            if n < tries:
                names = spark.createDataFrame([(p,) for p in paths], "path string")
                record(names.select("path", F.lit("retried").alias("outcome"), F.lit(n).alias("tries"), F.lit(None).cast("long").alias("total_rows"),
                                    F.lit(failure).alias("message")), _try(log, batch_id, n))
                raise
            store.publish_parts(None, batch_id + 1, batch_id, [])
        if files is None:  # not even read
            files = spark.createDataFrame([(p,) for p in paths], "path string").select(
                "path", F.lit(True).alias("is_valid"), F.lit(0).cast("long").alias("total_rows"), F.lit("").alias("errors"))
        taken = F.lit("accepted" if failure is None else "failed")
        record(files.select("path", F.when(F.col("is_valid"), taken).otherwise("rejected").alias("outcome"), F.lit(n).alias("tries"), "total_rows",
                            F.when(F.col("is_valid") & F.lit(failure is not None), F.lit(failure)).otherwise(F.nullif("errors", F.lit(""))).alias("message")),
               _outcomes(log, batch_id))
        store.drop_before(batch_id)

    _run(reader.load(feed_path).select("path", "modificationTime").writeStream.foreachBatch(apply)
         .option("checkpointLocation", checkpoint or fresh_scratch_path(spark, "ckpt-landing")))
