"""Progress records: per-batch progress, field-wise snapshot, default, tail, client view."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedyard import schemas as S
from feedyard.functions import text as X
from feedyard.operators.ordering import global_rank, stage
from feedyard.operators.skew import salted_join

FIELDS = ("status", "stage", "processed_rows", "total_rows", "progress", "error_message")


def batch_progress(acc: DataFrame, rows: DataFrame, batch_size: int) -> DataFrame:
    """The forced progress records of an import, per file.

    starting, batch_0, one record per batch (running processed rows; the last one is
    `batch_n_final` unless it is full), completed.  Percent uses all data rows of the
    file as total.
    """
    per_batch = acc.groupBy("file_rank", "batch").agg(F.count("*").alias("n"))
    totals = rows.groupBy("file_rank").agg(F.count("*").alias("total_rows"))
    w = Window.partitionBy("file_rank").orderBy("batch")
    last = F.max("batch").over(Window.partitionBy("file_rank"))
    b = per_batch.select(
        "file_rank", (F.col("batch") + 1).alias("seq"), F.lit("importing").alias("status"),
        F.when((F.col("batch") == last) & (F.col("n") < batch_size),
               F.format_string(S.STAGE_BATCH_FINAL, F.col("batch")))
        .otherwise(F.format_string(S.STAGE_BATCH, F.col("batch"))).alias("stage"),
        F.sum("n").over(w).cast("long").alias("processed_rows"))
    done = per_batch.groupBy("file_rank").agg(F.sum("n").cast("long").alias("processed_rows"),
                                              F.max("batch").alias("nb"))
    files = totals.join(done, "file_rank", "left")
    start = files.select("file_rank", F.lit(-1).cast("long").alias("seq"), F.lit("parsing").alias("status"),
                         F.lit(S.STAGE_STARTING).alias("stage"), F.lit(0).cast("long").alias("processed_rows"))
    b0 = files.select("file_rank", F.lit(0).cast("long").alias("seq"), F.lit("importing").alias("status"),
                      F.format_string(S.STAGE_BATCH, F.lit(0)).alias("stage"), F.lit(0).cast("long").alias("processed_rows"))
    end = files.select("file_rank", (F.coalesce("nb", F.lit(0)) + 1).cast("long").alias("seq"),
                       F.lit("done").alias("status"), F.lit(S.STAGE_COMPLETED).alias("stage"),
                       F.coalesce("processed_rows", F.lit(0)).cast("long").alias("processed_rows"))
    out = start.unionByName(b0).unionByName(b.withColumn("seq", F.col("seq").cast("long"))).unionByName(end)
    return (out.join(totals, "file_rank")
            .withColumn("progress", X.percent("processed_rows", "total_rows")))


def last_run(events: DataFrame, ttl_s: int) -> DataFrame:
    """(job_id, run_start): first update after the job's last gap of `ttl_s` seconds.

    Inside a time slot of `ttl_s` there is no such gap, so the updates are first folded to
    one row per (job, slot), and gaps are looked for between slots.
    """
    at = F.unix_micros(F.col("updated_at").cast("timestamp"))
    slot = F.floor(at / (ttl_s * 1_000_000))
    slots = (events.groupBy("job_id", slot.alias("slot"))
             .agg(F.min("updated_at").alias("a"), F.min(at).alias("lo"), F.max(at).alias("hi")))
    before = F.lag("hi").over(Window.partitionBy("job_id").orderBy("slot"))
    starts = before.isNull() | ((F.col("lo") - before) >= ttl_s * 1_000_000)
    return (slots.withColumn("starts", starts).filter("starts")
            .groupBy("job_id").agg(F.max("a").alias("run_start")))


def snapshot(events: DataFrame, asof=None, ttl_s: int = S.SNAPSHOT_TTL_S) -> DataFrame:
    """Merge updates field by field (a field missing later keeps its value).

    A snapshot expires `ttl_s` seconds after its last write, and the next write starts an
    empty one: only the updates since the last gap of `ttl_s` are merged.  `live` is FALSE
    once `ttl_s` seconds passed since the last write (as of `asof`).
    """
    ev = events if asof is None else events.filter(F.col("updated_at") <= asof)
    ev = salted_join(ev, last_run(ev, ttl_s), ["job_id"], "inner", salt_of="seq").filter(F.col("updated_at") >= F.col("run_start")).drop("run_start")
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in FIELDS]
    snap = ev.groupBy("job_id").agg(*aggs, F.max("updated_at").alias("updated_at"),
                                    F.max("seq").alias("last_seq"))
    if asof is not None:
        snap = snap.withColumn(
            "live", F.col("updated_at") > (F.lit(asof).cast("timestamp") - F.expr(f"INTERVAL {ttl_s} SECONDS")))
    return snap


def or_default(jobs: DataFrame, snap: DataFrame) -> DataFrame:
    """The snapshot while it lives, else the job row as a queued record."""
    j = jobs.alias("j").join((snap.filter("live") if "live" in snap.columns else snap).alias("s"), "job_id", "left")
    has = F.col("s.last_seq").isNotNull()
    return j.select(
        "job_id",
        F.when(has, F.col("s.status")).otherwise(F.col("j.status")).alias("status"),
        F.when(has, F.col("s.stage")).otherwise(F.lit(S.STAGE_QUEUED)).alias("stage"),
        F.when(has, F.col("s.processed_rows")).otherwise(F.col("j.processed_rows")).alias("processed_rows"),
        F.when(has, F.col("s.total_rows")).otherwise(F.col("j.total_rows")).alias("total_rows"),
        F.when(has, F.col("s.progress")).otherwise(F.lit(0.0)).alias("progress_percent"),
        has.alias("from_snapshot"),
    )


def tail(jobs: DataFrame, events: DataFrame, asof) -> DataFrame:
    """What a reader attached at `asof` receives, as rows with a position.

    pos 0: snapshot (or default); then updates after `asof` up to and including the
    first done/failed; then a close record.  A terminal snapshot closes at once; a default
    record does not, whatever the job row's status.
    """
    known = or_default(jobs, snapshot(events, asof))
    first = known.select(
        "job_id", F.lit(0).cast("long").alias("pos"), F.lit("progress").alias("kind"), "status", "stage",
        "processed_rows", "progress_percent")
    later = events.filter(F.col("updated_at") > asof).join(jobs.select("job_id"), "job_id", "left_semi")
    term = later.filter(F.col("status").isin(*S.TERMINAL_STATUSES)).groupBy("job_id").agg(
        F.min("seq").alias("stop_seq"))
    snap_terminal = known.filter(F.col("from_snapshot") & F.col("status").isin(*S.TERMINAL_STATUSES)).select(
        "job_id", F.lit(True).alias("snap_done"))
    gate = (jobs.select("job_id").join(term, "job_id", "left").join(snap_terminal, "job_id", "left"))
    upd = (salted_join(later, gate, ["job_id"], "inner", salt_of="seq")
           .filter(F.col("snap_done").isNull() & (F.col("stop_seq").isNull() | (F.col("seq") <= F.col("stop_seq"))))
           .select("job_id", F.col("seq").alias("pos"), F.lit("progress").alias("kind"), "status", "stage",
                   "processed_rows", F.col("progress").alias("progress_percent")))
    closing = gate.filter(F.col("snap_done") | F.col("stop_seq").isNotNull()).select(
        "job_id", F.lit(9223372036854775807).alias("pos"), F.lit("close").alias("kind"),
        F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("stage"),
        F.lit(None).cast("long").alias("processed_rows"), F.lit(None).cast("double").alias("progress_percent"))
    return first.unionByName(upd).unionByName(closing)


MESSAGE_SCHEMA = ("event STRING, job_id STRING, status STRING, stage STRING, total_rows BIGINT, "
                  "processed_rows BIGINT, progress DOUBLE, progress_percent DOUBLE, "
                  "error_message STRING, updated_at STRING")


def normalise(messages: DataFrame) -> DataFrame:
    """Raw SSE data text -> the client's progress view."""
    m = messages.withColumn("d", F.from_json(F.col("data"), MESSAGE_SCHEMA))
    m = m.filter(F.col("data").isNotNull() & (F.trim("data") != "")
                 & ~F.coalesce(F.col("d.event") == "close", F.lit(False)))
    m = m.filter(F.col("d.status").isNotNull() & (F.col("d.status") != ""))
    ts = F.col("d.updated_at")
    # a number is an epoch; text stays as it is, also where it looks like a number
    sent = F.try_variant_get(F.try_parse_json("data"), "$.updated_at", "variant")
    as_num = F.when(F.schema_of_variant(sent) != "STRING", F.try_variant_get(sent, "$", "double"))
    iso = F.when(as_num.isNotNull(),
                 F.date_format(F.timestamp_micros((as_num * 1e6).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
                 ).otherwise(ts)
    processed = F.coalesce(F.col("d.processed_rows"), F.lit(0))
    total = F.col("d.total_rows")
    pp = F.coalesce(F.col("d.progress_percent"), F.col("d.progress"))
    shown = F.coalesce(pp, F.when(F.coalesce(total, F.lit(0)) > 0, processed / total * 100.0).otherwise(0.0))
    status = F.col("d.status")
    disp = F.coalesce(F.create_map(*[F.lit(x) for kv in S.DISPLAY_STATUS.items() for x in kv])[status],
                      F.lit("idle"))
    text = F.coalesce(F.create_map(*[F.lit(x) for kv in S.STATUS_TEXT.items() for x in kv])[status],
                      F.lit(S.STATUS_TEXT_OTHER))
    text = F.when(status == "failed",
                  F.when(F.coalesce(F.col("d.error_message"), F.lit("")) != "",
                         F.format_string(S.STATUS_TEXT_FAILED_WITH, F.col("d.error_message")))
                  .otherwise(S.STATUS_TEXT_FAILED)).otherwise(text)
    return m.select(
        "msg_id",
        F.coalesce(F.nullif(F.col("d.job_id"), F.lit("")), F.lit("")).alias("job_id"),
        status.alias("status"), F.col("d.stage").alias("stage"), total.alias("total_rows"),
        processed.alias("processed_rows"), pp.alias("progress_percent"),
        F.col("d.error_message").alias("error_message"), iso.alias("updated_at"),
        disp.alias("display_status"), text.alias("status_text"),
        F.format_string("%.1f%%", shown).alias("percent_shown"),
    )


#: Updates of a segment that are folded as one row; longer segments go by pointers.
FOLD = 1_000


def _folded(rows: DataFrame, interval: float) -> DataFrame:
    """Short segments: the updates of one, in order, folded by an expression."""
    items = rows.groupBy("job_id", "segment").agg(F.array_sort(F.collect_list(F.struct("seq", "t"))).alias("items"))
    def state(last: Column, kept: Column) -> Column:
        return F.named_struct(F.lit("last"), last, F.lit("kept"), kept)

    fold = F.aggregate("items", state(F.col("items")[0]["t"], F.array().cast("array<bigint>")), lambda a, x: F.when(
        x["t"] - a["last"] >= interval, state(x["t"], F.concat(a["kept"], F.array(x["seq"])))).otherwise(a))
    later = F.slice("items.seq", 2, F.size("items"))  # the first is decided without the chain
    return (items.select("job_id", fold["kept"].alias("kept"), F.explode(later).alias("seq"))
            .select("job_id", "seq", F.array_contains("kept", F.col("seq")).alias("emitted")))


def _pointed(rows: DataFrame, interval: float) -> DataFrame:
    """Long segments: published updates (job_id, seq) after each segment's first.

    Only an update later than all earlier ones of its segment can be published.  Sorting
    these together with their times plus `interval` gives each its successor, and following
    pointers that double in length reaches the published ones from the segments' first
    updates in as many steps as the longest chain has binary digits.
    """
    segment, block = ["job_id", "segment"], ["job_id", "segment", "bucket"]
    earlier = Window.partitionBy(*segment).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(*block).agg(F.max("t").alias("top")).select(*block, F.max("top").over(earlier).alias("top"))
    before = Window.partitionBy(*block).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    risen = (rows.join(tops, block).withColumn("top", F.greatest("top", F.max("t").over(before)))
             .filter(F.col("top").isNull() | (F.col("t") > F.col("top"))).select(*segment, "seq", "t"))
    nodes = stage(global_rank(risen, [*segment, "t"], "g"), "nodes")
    due = F.col("t") + interval
    # a little early: the exact difference decides among the first three found
    marks = (nodes.select(*segment, "g", "t", F.lit(1).alias("kind"), F.col("t").alias("x"))
             .unionByName(nodes.select(*segment, "g", "t", F.lit(0).alias("kind"), (due - F.abs(due) * 5e-16).alias("x"))))
    found = global_rank(marks, [*segment, "x", "kind", "g"], "p").filter("kind = 0")
    first = F.col("p") - F.col("g") + 1  # nodes before the mark, plus one
    near = found.select(*segment, "g", "t", F.explode(F.sequence(first, first + 2)).alias("nxt"))
    to = nodes.select(F.col("g").alias("nxt"), F.col("t").alias("then"), *[F.col(c).alias(f"_{c}") for c in segment])
    jumps = stage(near.join(to, "nxt").filter((F.col("_job_id") == F.col("job_id")) & (F.col("_segment") == F.col("segment"))
                                              & (F.col("then") - F.col("t") >= interval))
                  .groupBy("g").agg(F.min("nxt").alias("nxt")), "jumps")
    hits = nodes.groupBy(*segment).agg(F.min("g").alias("g")).select("g")
    while not jumps.isEmpty():
        hits = stage(hits.unionByName(hits.join(jumps, "g").select(F.col("nxt").alias("g"))), "hits")
        jumps = stage(jumps.join(jumps.select(F.col("g").alias("nxt"), F.col("nxt").alias("far")), "nxt")
                      .select("g", F.col("far").alias("nxt")), "jumps")
    return nodes.join(hits, "g").select("job_id", "seq")


SEQ_BUCKET = 1_000_000   # updates per window group at most (seq ranges)


def throttled(updates: DataFrame, interval: float = S.PROGRESS_INTERVAL_S,
              seq_bucket: int = SEQ_BUCKET, fold: int = FOLD) -> DataFrame:
    """Which updates are published (forced, or >= interval since the last one).

    The decision is a chain, but it restarts at every forced update and after every
    gap of at least `interval` since the latest time so far (that update is always
    published, whatever came before).  Segments between restarts are found with window functions; one of at most
    `fold` updates is folded by an expression, a longer one is decided by pointers over
    any number of tasks.  The tracker's clock starts at the job's first update, so an
    unforced first update is dropped.

    Windows are partitioned by (job, seq range): no window group holds more than
    `seq_bucket` updates, however many one job has.  A small per-(job, range) table
    carries the latest time of the earlier ranges and the running count of restarts.
    A clock set back is handled: a gap counts from the latest time so far.
    """
    u = (updates.select("job_id", "seq", "t", "forced")
         .withColumn("bucket", F.floor(F.col("seq") / seq_bucket)))
    w = Window.partitionBy("job_id", "bucket").orderBy("seq")
    u = u.withColumn("local_top", F.max("t").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    bw = Window.partitionBy("job_id").orderBy("bucket")
    per_bucket = u.groupBy("job_id", "bucket").agg(F.max("t").alias("top"))
    per_bucket = per_bucket.withColumn("carry_t", F.max("top").over(bw.rowsBetween(Window.unboundedPreceding, -1)))
    u = u.join(per_bucket.select("job_id", "bucket", "carry_t"), ["job_id", "bucket"])
    prev = F.greatest("local_top", "carry_t")  # the latest time so far: no publish was later
    u = u.withColumn("starts_job", prev.isNull()).withColumn(
        "reset", F.col("forced") | prev.isNull() | ((F.col("t") - prev) >= interval))
    u = u.withColumn("local_seg", F.sum(F.col("reset").cast("long")).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    resets = (u.groupBy("job_id", "bucket").agg(F.sum(F.col("reset").cast("long")).alias("n_resets"))
              .withColumn("seg_off", F.coalesce(F.sum("n_resets").over(
                  bw.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    u = (u.join(resets.select("job_id", "bucket", "seg_off"), ["job_id", "bucket"])
         .withColumn("segment", F.col("seg_off") + F.col("local_seg")))
    u = stage(u.select("job_id", "seq", "t", "bucket", "segment", "reset", (F.col("forced") | ~F.col("starts_job")).alias("opens")), "segments")
    sizes = stage(u.groupBy("job_id", "segment").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    # a segment's first update needs no chain: published iff forced or not the job's first
    opened = u.filter("reset").select("job_id", "seq", F.col("opens").alias("emitted"))
    sized = salted_join(u, sizes, ["job_id", "segment"], "inner", salt_of="seq")
    out = opened
    if not sizes.filter(F.col("n") <= fold).isEmpty():
        out = out.unionByName(_folded(sized.filter(F.col("n") <= fold), interval))
    if not sizes.filter(F.col("n") > fold).isEmpty():
        long = sized.filter(F.col("n") > fold)
        hits = _pointed(long, interval).withColumn("hit", F.lit(True))
        later = long.filter(~F.col("reset")).join(hits, ["job_id", "seq"], "left")
        out = out.unionByName(later.select("job_id", "seq", F.coalesce("hit", F.lit(False)).alias("emitted")))
    return out


def to_readers(updates: DataFrame, readers: DataFrame) -> DataFrame:
    """Every reader of a job receives each update published after it subscribed.

    An equi-join on job_id with a time condition; the output is inherently
    readers x updates per job, so a hot job is left to AQE's skew-join splitting.
    """
    r = readers.select("reader_id", "job_id", "attached_at")
    return (updates.join(r, "job_id")
            .filter(F.col("updated_at") >= F.col("attached_at"))
            .select("reader_id", "job_id", "seq", "status", "stage", "processed_rows", "progress"))
