"""Job ledger: latest state per job, counters, recent jobs, outcome under retries."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedyard import schemas as S
from feedyard.functions import text as X
from feedyard.operators.skew import bin_repeated, bin_salted, hot_bins, parts_for


#: A job with more events than this is folded by several tasks first.
HOT_JOB_EVENTS = 100_000


def _given(c: str):
    """(seq, value) of `c` where it is given."""
    return F.when(F.col(c).isNotNull() & F.col("seq").isNotNull(), F.struct("seq", F.col(c).alias("value")))


def latest(events: DataFrame) -> DataFrame:
    """A5 + A6 + D8: fold a job-event log into the job row.

    Status events overwrite status; processed_rows / error_message are overwritten
    only when given; increments add to processed_rows after the last explicit value.
    The last values hold texts, so the folds sort.  Each is dealt by job, and by salt where a job's
    log is huge, to a number of tasks that follows the number of events, and a task's share is
    bounded; what the salts found is folded again by job.
    """
    spark = events.sparkSession
    parts = parts_for(spark, events.count())
    hot = hot_bins(events, "job_id", HOT_JOB_EVENTS)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "job_id", "_salt")

    cells = bin_salted(events, hot, "job_id", "seq")
    sets = (dealt(cells.filter(F.col("processed_rows").isNotNull()).select("job_id", "_salt", "seq"))
            .groupBy("job_id", "_salt").agg(F.max("seq").alias("set_seq"))
            .repartition(parts, "job_id").groupBy("job_id").agg(F.max("set_seq").alias("set_seq")))
    # a NULL job has a row, but its increments belong to no job
    counts = F.col("job_id").isNotNull() & (F.col("set_seq").isNull() | (F.col("seq") > F.col("set_seq")))
    folded = (dealt(cells).join(dealt(bin_repeated(sets, hot, "job_id")), ["job_id", "_salt"], "left")
              .groupBy("job_id", "_salt").agg(
                  *[F.max(_given(c)).alias(c) for c in ("status", "processed_rows", "error_message")],
                  F.sum(F.when(counts, F.col("increment"))).alias("inc_after"), F.max("at").alias("updated_at"))
              .repartition(parts, "job_id").groupBy("job_id").agg(
                  *[F.max(c).alias(c) for c in ("status", "processed_rows", "error_message", "updated_at")],
                  F.sum("inc_after").alias("inc_after")))
    return folded.select(
        "job_id", F.col("status.value").alias("status"),
        (F.coalesce("processed_rows.value", F.lit(0)) + F.coalesce("inc_after", F.lit(0))).cast("long").alias("processed_rows"),
        F.col("error_message.value").alias("error_message"), "updated_at")


def counters(increments: DataFrame) -> DataFrame:
    """A5: processed_rows += n, per job."""
    return increments.groupBy("job_id").agg(F.sum("increment").cast("long").alias("processed_rows"),
                                            F.count("*").alias("n_increments"))


def recent(jobs: DataFrame, limit: int = S.RECENT_JOBS) -> DataFrame:
    """Newest jobs first (job_id breaks ties)."""
    return jobs.orderBy(F.col("created_at").desc(), F.col("job_id").desc()).limit(limit)


def outcome(attempts: DataFrame, missing: DataFrame, max_retries: int = S.MAX_RETRIES) -> DataFrame:
    """Final status of each job under automatic retries.

    `attempts` (job_id, attempt 0.., error_type, error_text[, tie]): one row per try,
    error NULL on success; `tie` orders rows that share an attempt number.  A job fails only when the last allowed try fails; before that
    its progress says importing with the error.  `missing` lists jobs whose file was
    gone: failed at once, no retry, no event.
    """
    err = F.when(F.col("error_type").isNotNull(), X.error_text("error_type", "error_text"))
    a = attempts.withColumn("err", err)
    order = F.struct("attempt", "tie") if "tie" in attempts.columns else F.col("attempt")
    per = a.groupBy("job_id").agg(
        F.min(F.when(F.col("err").isNull(), F.col("attempt"))).alias("ok_at"),
        F.max("attempt").alias("last_try"),
        F.max_by("err", F.when(F.col("attempt") <= max_retries, order)).alias("last_err"),
    )
    per = per.join(missing.select("job_id", "path").withColumn("gone", F.lit(True)), "job_id", "left")
    done = F.col("ok_at").isNotNull() & (F.col("ok_at") <= max_retries)
    status = (F.when(F.col("gone"), "failed").when(done, "done")
              .when(F.col("last_try") >= max_retries, "failed").otherwise("importing"))
    return per.select(
        "job_id", status.alias("status"),
        F.when(F.col("gone"), F.lit(1)).when(done, F.col("ok_at") + 1)
        .when(F.col("last_try") >= max_retries, F.lit(max_retries + 1))
        .otherwise(F.col("last_try") + 1).cast("int").alias("attempts_used"),
        F.when(F.col("gone"), F.format_string(S.MSG_IMPORT_FILE_MISSING, F.col("path")))
        .when(~done, F.col("last_err")).alias("error_message"),
        F.when(F.col("gone"), F.lit(None).cast("string")).when(done, F.lit("import.completed"))
        .when(F.col("last_try") >= max_retries, F.lit("import.failed")).alias("event_type"),
    )


# progress statuses of the bulk delete that are stored as import statuses
STORED_STATUS = {"preparing": "parsing", "deleting": "importing"}


def stored_status(c):
    out = F.col(c) if isinstance(c, str) else c
    expr = out
    for k, v in STORED_STATUS.items():
        expr = F.when(out == k, F.lit(v)).otherwise(expr)
    return expr


def check_jobs(jobs: DataFrame) -> DataFrame:
    """P16 + enum rules: stripped file name not empty, counts >= 0, known status and type."""
    valid = ((F.length(X.py_strip("filename")) > 0) & (F.col("total_rows") >= 0)
             & (F.col("processed_rows") >= 0) & F.col("status").isin(*S.JOB_STATUSES)
             & F.col("job_type").isin(*S.JOB_TYPES))
    return jobs.select("job_id", valid.alias("valid"), stored_status("status").alias("stored_status"))
