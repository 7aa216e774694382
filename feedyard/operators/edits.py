"""Catalog edits as table jobs: create, patch, delete and bulk delete.

Inside a request set, requests apply in req_id order: the first request for a key wins,
and patches of one id build on each other.  The `after_*` functions give the table that
follows, for S7 to publish.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedyard import schemas as S
from feedyard.functions import text as X
from feedyard.operators import carry
from feedyard.operators.ordering import global_rank, stage
from feedyard.operators.skew import salted_join


def _valid_text(c: Column) -> Column:
    return c.isNotNull() & X.text_in_bounds(X.py_strip(c))


def create(table: DataFrame, requests: DataFrame, run_ts, strict_description: bool = False) -> DataFrame:
    """D3 + J3: per request: created (with a new id), conflict or invalid, and for created
    ones the whole new row.

    `strict_description` adds the editor's 1000-character description limit.  The first
    valid request for a key is marked by one aggregate, whose result is joined back with
    hot and NULL keys spread.
    """
    valid = _valid_text(F.col("sku")) & _valid_text(F.col("name"))
    if strict_description:
        valid = valid & (F.col("description").isNull()
                         | (F.length("description") <= S.EDITOR_DESCRIPTION_MAX))
    req = requests.withColumn("valid", valid).withColumn(
        "sku_s", F.when(F.col("valid"), X.py_strip("sku"))).withColumn("sku_key", F.lower("sku_s"))
    first = (req.filter("valid").groupBy("sku_key").agg(F.min("req_id").alias("first_req"))
             .join(table.select("sku_key").withColumn("taken", F.lit(True)), "sku_key", "left"))
    j = salted_join(req, first, ["sku_key"], "left", salt_of="req_id")
    outcome = (F.when(~F.col("valid"), "invalid")
               .when(F.col("taken").isNotNull() | (F.col("req_id") != F.col("first_req")), "conflict")
               .otherwise("created"))
    j = stage(j.withColumn("outcome", outcome), "create")  # used for the numbering and for the report
    top = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    made = global_rank(j.filter(F.col("outcome") == "created").select("req_id"), ["req_id"], "rank")
    made = made.join(F.broadcast(top)).select("req_id", (F.col("top") + F.col("rank")).cast("long").alias("id"))
    new = F.col("outcome") == "created"
    at = F.when(new, F.lit(run_ts).cast("timestamp"))
    return (j.join(made, "req_id", "left")
            .select("req_id", "outcome", "id", F.col("sku_s").alias("sku"), "sku_key",
                    F.when(new, X.py_strip("name")).alias("name"), F.when(new, F.col("description")).alias("description"),
                    F.when(new, F.coalesce("active", F.lit(True))).alias("active"),
                    at.alias("created_at"), at.alias("updated_at")))


def after_create(table: DataFrame, report: DataFrame) -> DataFrame:
    """The catalog with the created rows (what S7 publishes after the request set)."""
    cols = [f.name for f in S.CATALOG]
    return table.select(*cols).unionByName(report.filter(F.col("outcome") == "created").select(*cols))


def patch(table: DataFrame, requests: DataFrame, run_ts, block: int = carry.BLOCK) -> DataFrame:
    """D4 + J4 + J3: not_found, invalid, conflict, unchanged or patched; result row values.

    Requests for one id build on each other in req_id order: a field keeps the last value
    given before.  NULL request fields leave the column as it is (so description cannot be
    reset to NULL).  A key belongs to its holder in the table, else to the id of the first
    valid request for it; requests of other ids conflict.  updated_at moves only when some
    value really changes.
    """
    sku_given = F.col("r.sku").isNotNull()
    name_given = F.col("r.name").isNotNull()
    valid = (~sku_given | _valid_text(F.col("r.sku"))) & (~name_given | _valid_text(F.col("r.name")))
    known = table.select("id", F.struct("sku", "name", "description", "active", "updated_at").alias("t"))
    req = requests.select("req_id", "id", F.struct("sku", "name", "description", "active").alias("r"))
    found = F.col("t").isNotNull()
    j = salted_join(req, known, ["id"], "left", salt_of="req_id").select(
        "req_id", "id", found.alias("found"), valid.alias("valid"),
        X.py_strip("r.sku").alias("sku"), X.py_strip("r.name").alias("name"),
        F.col("r.description").alias("description"), F.col("r.active").alias("active"),
        F.when(found & valid, F.lower(X.py_strip("r.sku"))).alias("new_key"), "t")
    claims = (j.filter(F.col("new_key").isNotNull()).groupBy("new_key").agg(F.min_by("id", "req_id").alias("claimant"))
              .join(table.select(F.col("sku_key").alias("new_key"), F.col("id").alias("holder")), "new_key", "left"))
    j = salted_join(j, claims, ["new_key"], "left", salt_of="req_id")
    conflict = F.col("new_key").isNotNull() & (F.coalesce("holder", "claimant") != F.col("id"))
    j = j.select("req_id", "id", "found", "valid", "sku", "name", "description", "active", "t", conflict.alias("conflict"))
    j = stage(j, "patch").withColumn("ok", F.col("found") & F.col("valid") & ~F.col("conflict"))  # read by every block step
    fields = ("sku", "name", "description", "active")
    j = carry.in_blocks(j, "id", "req_id", block)
    j = carry.last_given(j, "id", "req_id", {f: F.when(F.col("ok"), F.col(f)) for f in fields})
    j = j.withColumns({f"{k}_{f}": F.coalesce(F.col(f"{k}_{f}"), F.col(f"t.{f}")) for f in fields for k in ("now", "was")})
    changed = F.lit(False)
    for f in fields:
        changed = changed | ~F.col(f"now_{f}").eqNullSafe(F.col(f"was_{f}"))
    outcome = (F.when(~F.col("found"), "not_found").when(~F.col("valid"), "invalid")
               .when(F.col("conflict"), "conflict").when(changed, "patched").otherwise("unchanged"))
    j = j.withColumn("outcome", outcome)
    j = carry.last_given(j, "id", "req_id", {"moved": F.when(F.col("outcome") == "patched", F.lit(True))})
    moved = F.col("now_moved")
    return j.select(
        "req_id", "id", "outcome", *[F.when(F.col("ok"), F.col(f"now_{f}")).alias(f) for f in fields],
        F.when(F.col("ok"), F.when(moved, F.lit(run_ts).cast("timestamp")).otherwise(F.col("t.updated_at"))).alias("updated_at"))


def after_patch(table: DataFrame, report: DataFrame) -> DataFrame:
    """The catalog after the request set: per id the values of its last successful request."""
    last = (report.filter(F.col("outcome").isin("patched", "unchanged")).groupBy("id")
            .agg(F.max_by(F.struct("sku", "name", "description", "active", "updated_at"), "req_id").alias("n")))
    new = F.col("n").isNotNull()
    cols = [F.when(new, F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) if c in ("sku", "name", "description", "active", "updated_at")
            else F.when(new, F.lower("n.sku")).otherwise(F.col("sku_key")).alias(c) if c == "sku_key" else F.col(c)
            for c in [f.name for f in S.CATALOG]]
    return table.join(last, "id", "left").select(*cols)


def delete(table: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report per requested id: deleted | not_found, table after the delete)."""
    req = ids.select("id").distinct()
    report = (req.join(table.select("id").withColumn("hit", F.lit(True)), "id", "left")
              .select("id", F.when(F.col("hit"), "deleted").otherwise("not_found").alias("outcome")))
    return report, table.join(req, "id", "left_anti")


def bulk_delete_progress(jobs: DataFrame, table: DataFrame, batch_size: int = S.DELETE_BATCH_SIZE) -> DataFrame:
    """Progress records of every bulk delete job, in order of (created_at, job_id).

    The first job deletes the whole table in batches, the later ones find it empty:
    preparing/counting, then (when there are rows) deleting/batch_0 ... batch_n with the
    running deleted count, then done/completed.
    """
    runs = jobs.filter(F.col("job_type") == "bulk_delete").select("job_id", "created_at")
    first = runs.agg(F.min(F.struct("created_at", "job_id")).alias("f"))
    total = table.agg(F.count("*").alias("n"))
    one = F.broadcast(first.join(total))  # one row
    r = runs.join(one).select("job_id", F.when(F.col("job_id") == F.col("f.job_id"), F.col("n")).otherwise(F.lit(0)).alias("total_rows"))
    batches = F.ceil(F.col("total_rows") / batch_size).cast("long")
    last = F.when(F.col("total_rows") > 0, batches + 2).otherwise(F.lit(1)).cast("long")
    r = r.select("job_id", "total_rows", last.alias("last"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("seq"))
    i = F.col("seq") - 1
    head, end = F.col("seq") == 0, F.col("seq") == F.col("last")
    done = F.when(head, F.lit(0)).when(end, F.col("total_rows")).otherwise(F.least(i * batch_size, F.col("total_rows"))).cast("long")
    return r.select("job_id", "seq",
                    F.when(head, "preparing").when(end, "done").otherwise("deleting").alias("status"),
                    F.when(head, S.STAGE_COUNTING).when(end, S.STAGE_COMPLETED).otherwise(F.format_string(S.STAGE_BATCH, i)).alias("stage"),
                    done.alias("processed_rows"), F.col("total_rows").cast("long").alias("total_rows"),
                    X.percent(done, F.col("total_rows")).alias("progress"))


def after_bulk_delete(table: DataFrame, progress: DataFrame) -> DataFrame:
    """The catalog after the jobs: the rows stay only if no job has finished."""
    done = progress.filter(F.col("status") == "done").agg(F.count("*").alias("runs"))
    return table.join(F.broadcast(done)).filter(F.col("runs") == 0).drop("runs")  # one row


def job_type_guard(jobs: DataFrame) -> DataFrame:
    """A bulk delete runs only for bulk_delete jobs; others get an error record."""
    return jobs.select(
        "job_id",
        (F.col("job_type") == "bulk_delete").alias("runs"),
        F.when(F.col("job_type") != "bulk_delete",
               F.format_string(S.MSG_NOT_BULK_DELETE, F.col("job_id"), F.col("job_type")))
        .alias("error"),
    )
