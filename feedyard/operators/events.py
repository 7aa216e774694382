"""Change events, subscriptions, fan-out and the delivery log."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedyard import schemas as S
from feedyard.functions import text as X
from feedyard.operators import carry
from feedyard.operators.skew import spread
from feedyard.sources.feed import SMALL_TABLE_ROWS, join_small


def check_subscriptions(subs: DataFrame) -> DataFrame:
    """Url must start with http:// or https:// (raw text), events not empty."""
    url_ok = F.col("url").startswith("http://") | F.col("url").startswith("https://")
    ev_ok = F.coalesce(F.size("events"), F.lit(0)) > 0
    reasons = F.concat_ws(",", F.when(~url_ok, F.lit("url_scheme")), F.when(~ev_ok, F.lit("events_empty")))
    return subs.select("id", (url_ok & ev_ok).alias("valid"), reasons.alias("reasons"),
                       F.when(url_ok, X.py_strip("url")).alias("url"),
                       F.coalesce(F.size("events"), F.lit(0)).alias("n_events"))


def newest_subscriptions(subs: DataFrame) -> DataFrame:
    """All subscriptions, newest first."""
    return subs.orderBy(F.col("created_at").desc(), F.col("id").desc())


def receivers(subs: DataFrame) -> DataFrame:
    """(event_type, webhook_id) for enabled subscriptions; a repeated type counts once."""
    return (subs.filter(F.col("enabled"))
            .select(F.col("id").alias("webhook_id"), F.explode(F.array_distinct("events")).alias("event_type")))


#: Receivers of an event type that one lookup row holds.
RECEIVER_BLOCK = 256
#: Pairs that a task of the fan-out makes, about.
TASK_PAIRS = 8_000_000


def fan_out(changes: DataFrame, subs: DataFrame) -> DataFrame:
    """Every change event paired with every enabled subscriber of its type."""
    return fan_out_to(changes, receivers(subs))


def fan_out_to(changes: DataFrame, to: DataFrame, max_rows: int = SMALL_TABLE_ROWS, block: int = RECEIVER_BLOCK, along: tuple[str, ...] = ()) -> DataFrame:
    """`changes` paired with the receivers of their type (`to`: event_type, webhook_id and what
    else is known of the receiver).

    An equi-join on the exploded type list (not array_contains, which would be a
    nested-loop join).  A change has many receivers, so the changes are dealt evenly to the tasks
    first (or in order of the columns `along`), to more of them where there are more pairs, and the
    lookup rows hold blocks of receivers, which are read off in a loop.  They are
    broadcast after a size check; else each block number is a join key of its own, so that a
    type with many receivers is dealt to many tasks.

    A task pairs one block with all its changes before it takes the next one: columns of the change
    stay the same over a block and the receivers come again after it, so that files of the pairs
    take a small part of the space.  (A stream cannot be sorted: `streams.to_parquet` and
    `streams.delivery_stream` make the pairs of a micro-batch.)
    """
    known, rest = [c for c in to.columns if c != "event_type"], [c for c in changes.columns if c != "event_type"]
    typed = to.filter(F.col("event_type").isNotNull())
    per_type = typed.groupBy("event_type").agg(F.count("*").alias("_n")).withColumn("_c", F.lit(0))
    if not changes.isStreaming:
        per_type = per_type.drop("_c").join(changes.groupBy("event_type").agg(F.count("*").alias("_c")), "event_type", "left")
    n, most, pairs = [x or 0 for x in per_type.agg(F.sum("_n"), F.max("_n"), F.sum(F.col("_n") * F.col("_c"))).first()]
    blocks = max(1, -(-most // block))
    packed = (typed.groupBy("event_type", F.pmod(F.xxhash64("webhook_id"), F.lit(blocks)).alias("_block"))
              .agg(F.collect_list(F.struct(*known)).alias("_to")))
    if n <= max_rows:
        met = spread(changes, -(-pairs // TASK_PAIRS), along).join(F.broadcast(packed), "event_type")
    else:
        met = changes.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(packed, ["event_type", "_block"])
    if not changes.isStreaming:
        met = met.sortWithinPartitions("event_type", "_block")
    return met.select("event_type", *rest, F.inline("_to"))


def fan_out_size(changes: DataFrame, subs: DataFrame) -> DataFrame:
    """A10: receivers per event, zero kept."""
    per_type = receivers(subs).groupBy("event_type").agg(F.count("*").alias("receivers"))
    return (join_small(changes.select("event_id", "event_type"), per_type, "event_type", "left")
            .select("event_id", "event_type", F.coalesce("receivers", F.lit(0)).alias("receivers")))


def classify_deliveries(pairs: DataFrame, current_subs: DataFrame) -> DataFrame:
    """At delivery time the subscription may be gone (failed) or disabled (skipped)."""
    cur = current_subs.select(F.col("id").alias("webhook_id"), F.col("enabled").alias("enabled_now"))
    j = join_small(pairs, cur, "webhook_id", "left")
    return j.withColumn("action", F.when(F.col("enabled_now").isNull(), "missing")
                        .when(~F.col("enabled_now"), "disabled").otherwise("deliver"))


def outcome_columns(rows: DataFrame) -> DataFrame:
    """What the log stores of an outcome: status, response_body, response_time_ms, completed_at.

    Input: rows with response_code (NULL = timeout / request error), raw_body, elapsed_s,
    attempted_at.  2xx is success; bodies over 1000 chars are cut with a suffix; error texts are
    cut without one.  It depends on the change alone where its deliveries share the outcome, and is
    then found before the fan-out, once a change and not once a pair.
    """
    code = F.col("response_code")
    ok = code.isNotNull() & (code >= 200) & (code < 300)
    body = F.when(code.isNotNull(), X.truncate_body("raw_body")).otherwise(X.cut_text("raw_body"))
    return rows.withColumns({
        "status": F.when(ok, "success").otherwise("failed"), "response_body": body,
        "response_time_ms": (F.col("elapsed_s") * 1000).cast("int"),
        "completed_at": F.expr("timestampadd(MILLISECOND, CAST(elapsed_s * 1000 AS INT), attempted_at)"),
    }).drop("raw_body", "elapsed_s")


def delivery_log(deliver: DataFrame) -> DataFrame:
    """Outcome rows of performed deliveries.

    Input: pairs with the columns that `outcome_columns` takes, or with those it gives.
    """
    if "response_body" not in deliver.columns:
        deliver = outcome_columns(deliver)
    extra = [c for c in ("payload", "internal_failures", "n_changes") if c in deliver.columns]
    return deliver.select("id", "webhook_id", "event_type", "event_id", "status", "response_code", "response_body", "response_time_ms",
                          "attempted_at", "completed_at", *extra)


def history(log: DataFrame, page: int = 1, page_size: int = S.DELIVERY_PAGE_SIZE) -> DataFrame:
    """O5 for every subscription: page `page` of its attempts, newest first (top-k per group;
    Spark applies the limit per partition before the shuffle)."""
    w = Window.partitionBy("webhook_id").orderBy(F.col("attempted_at").desc(), F.col("id").desc())
    return (log.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= page * page_size)
            .filter(F.col("rank") > (page - 1) * page_size)
            .select("id", "webhook_id", "event_type", "status", "response_code", "response_time_ms",
                    "attempted_at", "completed_at", "rank"))


def newest_per_type(changes: DataFrame, n: int) -> DataFrame:
    """Changes that can be among the newest `n` attempts of a receiver, where a delivery is
    attempted at its change's `attempted_at`: a receiver gets every change of its types, so its
    newest `n` are among the newest `n` of each type.  All that share the time of the last one
    stay, since the history orders them by more.  (Spark limits per partition before the shuffle.)"""
    w = Window.partitionBy("event_type").orderBy(F.col("attempted_at").desc())
    return changes.withColumn("_newest", F.rank().over(w)).filter(F.col("_newest") <= n).drop("_newest")


def count_per_type(changes: DataFrame) -> DataFrame:
    """One of the changes of each type, which stands for `n_changes` of them: enough where only
    the number of a receiver's deliveries is asked, as it gets every change of its types."""
    rest = [c for c in changes.columns if c != "event_type"]
    return changes.groupBy("event_type").agg(F.count("*").alias("n_changes"), *[F.first(c).alias(c) for c in rest])


def history_facts(log: DataFrame, page: int = 1, page_size: int = S.DELIVERY_PAGE_SIZE) -> DataFrame:
    """O3 for the delivery history: rows of the page, total, and has_next, which here says
    only that this page is full."""
    n = F.col("total")
    rows = F.greatest(F.lit(0), F.least(F.lit(page_size), n - (page - 1) * page_size)).cast("long")
    return totals(log).select("webhook_id", F.lit(page).alias("page"), F.lit(page_size).alias("page_size"), "total",
                              rows.alias("n_rows"), (rows == page_size).alias("has_next"), F.lit(page > 1).alias("has_previous"))


def latest_status(pairs: DataFrame, max_retries: int = S.MAX_RETRIES) -> DataFrame:
    """The state of each delivery after its tries, and how many rows they left.  It follows
    from the pair's own row (see `attempt_ledger`): no shuffle."""
    p = _tries(pairs, max_retries)
    return p.select("event_id", "webhook_id", "status", F.col("tries").cast("int").alias("attempts"), F.col("tries").cast("long").alias("n_rows"))


def cut_bodies(rows: DataFrame, body: str) -> DataFrame:
    """Keep of a body what the log can store (one character more tells that it was longer),
    before the fan-out copies it to every receiver."""
    return rows.withColumn(body, F.substring(F.col(body), 1, S.BODY_LIMIT + 1))


def totals(log: DataFrame) -> DataFrame:
    """A9.  Rows of `count_per_type` count as often as they stand for."""
    n = F.sum("n_changes") if "n_changes" in log.columns else F.count("*")
    return log.groupBy("webhook_id").agg(n.alias("total"))


def cascade_delete(log: DataFrame, deleted_ids: DataFrame) -> DataFrame:
    """Deleting subscriptions removes their deliveries.  The deleted ids are broadcast after a
    size check, so that the log is not shuffled."""
    return join_small(log, deleted_ids.select(F.col("id").alias("webhook_id")).distinct(), "webhook_id", "left_anti")


def _tries(pairs: DataFrame, max_retries: int) -> DataFrame:
    """tries, exhausted, and the status of the last try."""
    exhausted = F.col("internal_failures") >= max_retries + 1
    runs = ~exhausted & (F.col("running") if "running" in pairs.columns else F.lit(False))
    return (pairs.withColumn("tries", F.least(F.col("internal_failures") + 1, F.lit(max_retries + 1))).withColumn("exhausted", exhausted)
            .withColumn("runs", runs).withColumn("status", F.when(exhausted, "failed").when(runs, "pending").otherwise(F.col("status"))))


def attempt_ledger(pairs: DataFrame, max_retries: int = S.MAX_RETRIES) -> DataFrame:
    """One row per try.  Only internal errors retry; a try that died marks its row failed,
    with the error's text (cut at 1000) and the time it ended; an HTTP error or timeout is a
    final `failed`.  Only a try that still runs is pending.

    Input: pairs with `internal_failures` (tries that died inside the task), the final `status`
    of a try that got through, and if known `internal_error` (text of the error), `completed_at`
    and `running` (the last try has no outcome yet).
    """
    given = lambda c, kind: F.col(c) if c in pairs.columns else F.lit(None).cast(kind)
    p = _tries(pairs, max_retries).withColumn("error", given("internal_error", "string")).withColumn("ended", given("completed_at", "timestamp"))
    p = p.withColumn("error", X.cut_text("error"))  # once a pair, not once a try
    p = p.select("event_id", "webhook_id", "exhausted", F.explode(F.sequence(F.lit(1), F.col("tries"))).alias("attempt"), "tries", "status", "runs", "error", "ended")
    last = F.col("attempt") == F.col("tries")
    died = ~last | F.col("exhausted")
    return p.select(
        "event_id", "webhook_id", F.col("attempt").cast("int").alias("attempt"),
        F.when(died, "failed").otherwise(F.col("status")).alias("status"),
        F.when(died, F.col("error")).alias("error_text"),
        F.when(~(last & F.col("runs")), F.col("ended")).alias("completed_at"),
        last.alias("is_last"), "exhausted",
    )


def _json(*fields: Column) -> Column:
    """A JSON object that keeps NULL fields as null."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _iso(c: str) -> Column:
    """ISO text with microseconds where the time has any."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.unix_micros(F.col(c).cast("timestamp")) % 1000000 == 0, whole).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def payload_json(changes: DataFrame) -> DataFrame:
    """The JSON body per event type (bare payload, as posted)."""
    product = _json(
        F.col("p_id").alias("id"), F.col("p_sku").alias("sku"), F.col("p_name").alias("name"),
        F.col("p_description").alias("description"), F.col("p_active").alias("active"),
        _iso("p_created_at").alias("created_at"), _iso("p_updated_at").alias("updated_at"))
    bulk = _json(F.col("job_id"), F.lit("done").alias("status"),
                 F.col("count").alias("deleted_count"), F.col("total").alias("total_products"))
    done = _json(F.col("job_id"), F.lit("done").alias("status"),
                 F.col("count").alias("processed_rows"), F.col("total").alias("total_rows"))
    failed = _json(F.col("job_id"), F.lit("failed").alias("status"),
                   F.col("error_message"), F.col("count").alias("processed_rows"))
    et = F.col("event_type")
    body = (F.when(et.startswith("product.") & (et != "product.bulk_deleted"), product)
            .when(et == "product.bulk_deleted", bulk).when(et == "import.completed", done)
            .when(et == "import.failed", failed))
    return changes.withColumn("payload", body)


def change_events(created: DataFrame | None = None, patched: DataFrame | None = None,
                  deleted: DataFrame | None = None, bulk: DataFrame | None = None,
                  imports: DataFrame | None = None) -> DataFrame:
    """The change feed produced by edits and job ends.

    created / patched / deleted: edit reports (req_id/id, outcome); bulk: bulk-delete
    progress records; imports: job outcomes.  One event per successful create, successful
    patch (also one that changes nothing), delete, finished bulk delete and finished import; CSV upserts emit no per-product event, a failed bulk delete and
    a missing import file emit none.
    """
    parts = []
    if created is not None:
        parts.append(created.filter(F.col("outcome") == "created")
                     .select(F.lit("product.created").alias("event_type"), F.col("id").cast("string").alias("subject")))
    if patched is not None:
        parts.append(patched.filter(F.col("outcome").isin("patched", "unchanged"))
                     .select(F.lit("product.updated").alias("event_type"), F.col("id").cast("string").alias("subject")))
    if deleted is not None:
        parts.append(deleted.filter(F.col("outcome") == "deleted")
                     .select(F.lit("product.deleted").alias("event_type"), F.col("id").cast("string").alias("subject")))
    if bulk is not None:
        parts.append(bulk.filter(F.col("status") == "done")
                     .select(F.lit("product.bulk_deleted").alias("event_type"), F.col("job_id").alias("subject")))
    if imports is not None:
        parts.append(imports.filter(F.col("event_type").isNotNull())
                     .select("event_type", F.col("job_id").alias("subject")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _sub_valid(url: Column, events: Column) -> Column:
    """P15 on request fields (a NULL field is 'not given' and passes)."""
    url_ok = url.isNull() | url.startswith("http://") | url.startswith("https://")
    ev_ok = events.isNull() | (F.size(events) > 0)
    return url_ok & ev_ok


def create_subscriptions(subs: DataFrame, requests: DataFrame, run_ts) -> DataFrame:
    """D7 create: P15 rules; valid requests get ids after the current maximum, in
    req_id order; the stored url is stripped; enabled defaults to TRUE."""
    from feedyard.operators.ordering import global_rank
    valid = (F.col("url").isNotNull() & F.col("events").isNotNull()
             & _sub_valid(F.col("url"), F.col("events")))
    req = requests.withColumn("outcome", F.when(valid, "created").otherwise("invalid"))
    max_id = subs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    made = global_rank(req.filter(F.col("outcome") == "created").select("req_id"), ["req_id"], "rank")
    made = made.select("req_id", (F.lit(max_id) + F.col("rank")).cast("long").alias("id"))
    return (req.join(made, "req_id", "left")
            .select("req_id", "outcome", "id",
                    F.when(F.col("outcome") == "created", X.py_strip("url")).alias("url"),
                    F.when(F.col("outcome") == "created", F.array_join("events", ",")).alias("events"),
                    F.when(F.col("outcome") == "created", F.coalesce("enabled", F.lit(True))).alias("enabled"),
                    F.when(F.col("outcome") == "created", F.lit(run_ts).cast("timestamp")).alias("created_at")))


def patch_subscriptions(subs: DataFrame, requests: DataFrame, run_ts, block: int = carry.BLOCK) -> tuple[DataFrame, DataFrame]:
    """D7 patch: (report per request, table after the set).

    Requests apply in req_id order; given fields overwrite, NULL fields are left as
    they are, so the result per field is the last given value among valid requests.
    updated_at moves when some valid request changes a value.
    """
    known = subs.select("id").withColumn("found", F.lit(True))
    r = requests.join(known, "id", "left")
    valid = _sub_valid(F.col("url"), F.col("events"))
    r = r.withColumn("outcome", F.when(F.col("found").isNull(), "not_found")
                     .when(~valid, "invalid").otherwise("applied"))
    report = r.select("req_id", "id", "outcome")
    ok = (r.filter(F.col("outcome") == "applied").select("req_id", "id", X.py_strip("url").alias("url"), "events", "enabled")
          .join(subs.select("id", F.struct("url", "events", "enabled").alias("was")), "id"))
    fields = ("url", "events", "enabled")
    ok = carry.last_given(carry.in_blocks(ok, "id", "req_id", block), "id", "req_id", {f: F.col(f) for f in fields})
    changed = F.lit(False)
    for f in fields:  # against the last value given before, else the stored one
        before = F.coalesce(F.col(f"was_{f}"), F.col(f"was.{f}"))
        changed = changed | (F.col(f).isNotNull() & ~F.col(f).eqNullSafe(before))
    ok = ok.withColumn("changed", changed)
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("req_id")))
    per_id = ok.groupBy("id").agg(last("url").alias("new_url"), last("events").alias("new_events"), last("enabled").alias("new_enabled"),
                                  F.max("changed").alias("moved"), F.count("*").alias("n_applied"))
    after = (subs.join(per_id, "id", "left")
             .select("id", F.coalesce("new_url", "url").alias("url"),
                     F.array_join(F.coalesce("new_events", "events"), ",").alias("events"),
                     F.coalesce("new_enabled", "enabled").alias("enabled"),
                     F.coalesce("n_applied", F.lit(0)).alias("n_applied"),
                     "created_at", F.when(F.col("moved"), F.lit(run_ts).cast("timestamp")).otherwise(F.col("updated_at")).alias("updated_at")))
    return report, after


def delete_subscriptions(subs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D7 delete: (report per requested id: deleted | not_found, subscriptions left)."""
    req = ids.select("id").distinct()
    report = (req.join(subs.select("id").withColumn("hit", F.lit(True)), "id", "left")
              .select("id", F.when(F.col("hit"), "deleted").otherwise("not_found").alias("outcome")))
    return report, subs.join(req, "id", "left_anti")


PRODUCT_FIELDS = ("id", "sku", "name", "description", "active", "created_at", "updated_at")


def product_events(table: DataFrame, created: DataFrame, patched: DataFrame, deleted: DataFrame) -> DataFrame:
    """T6 with payloads: the product as created, as after each successful patch, and as it was
    before its deletion (event_type, subject, req_id, payload)."""
    born = table.select("id", "created_at")
    parts = [
        created.filter(F.col("outcome") == "created").select(F.lit("product.created").alias("event_type"), "req_id", *PRODUCT_FIELDS),
        patched.filter(F.col("outcome").isin("patched", "unchanged")).join(born, "id")
        .select(F.lit("product.updated").alias("event_type"), "req_id", *PRODUCT_FIELDS),
        deleted.filter(F.col("outcome") == "deleted").select("id").join(table, "id")
        .select(F.lit("product.deleted").alias("event_type"), F.lit(None).cast("long").alias("req_id"), *PRODUCT_FIELDS)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    none = {c: F.lit(None).cast(k) for c, k in (("job_id", "string"), ("count", "long"), ("total", "long"), ("error_message", "string"))}
    rows = rows.select("event_type", "req_id", *[F.col(c).alias(f"p_{c}") for c in PRODUCT_FIELDS], *[v.alias(c) for c, v in none.items()])
    return payload_json(rows).select("event_type", F.col("p_id").cast("string").alias("subject"), "req_id", "payload")
