"""Fan-out and delivery log when events and receivers are many: the step is dealt to many tasks,
and reads of the log that need little make few of its rows."""
import datetime as dt
from collections import Counter

from pyspark.sql import functions as F

from feedyard.operators import events as EV

T0 = dt.datetime(2024, 1, 1)
CHANGE = "event_id long, event_type string, attempted_at timestamp"
SUB = "id long, events array<string>, enabled boolean"


def changes(spark, n=60):
    rows = [(i if i % 9 else None, ["a", "b", "c", None][i % 4], T0 + dt.timedelta(minutes=i // 3) if i % 7 else None) for i in range(n)]
    return spark.createDataFrame(rows + rows[:5], CHANGE).coalesce(1)


def subs(spark):
    rows = [(i, [["a"], ["a", "b", "a"], ["c"], ["d"], [], None][i % 6], i % 5 != 0) for i in range(40)]
    return spark.createDataFrame([*rows, rows[1], (7, ["c"], True), (None, ["b"], True)], SUB)


def log_inputs(pairs):
    return pairs.select("*", (F.col("event_id") * 100 + F.col("webhook_id")).alias("id"), F.lit(200).alias("response_code"),
                        F.lit("ok").alias("raw_body"), F.lit(0.5).alias("elapsed_s"))


def bag(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def test_fan_out_is_dealt_to_many_tasks_and_keeps_every_pair(spark):
    ch, to = changes(spark), EV.receivers(subs(spark))
    want = Counter((c["event_id"], c["event_type"], c["attempted_at"], r["webhook_id"])
                   for c in ch.collect() for r in to.collect() if c["event_type"] is not None and c["event_type"] == r["event_type"])
    cols = ("event_id", "event_type", "attempted_at", "webhook_id")
    pairs = EV.fan_out(ch, subs(spark))
    assert pairs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism  # one task read the changes
    assert bag(pairs, *cols) == want
    # several blocks a type; and a lookup that is too large to be sent
    assert bag(EV.fan_out_to(ch, to, block=2), *cols) == want
    assert bag(EV.fan_out_to(ch, to, max_rows=0, block=2), *cols) == want


def test_actions_found_once_a_receiver_are_those_of_the_pairs(spark):
    now = spark.createDataFrame([(i, i % 3 != 0) for i in range(40) if i % 7 != 3] + [(5, False)], "id long, enabled boolean")
    cols = ("event_id", "webhook_id", "action")
    want = EV.classify_deliveries(EV.fan_out(changes(spark), subs(spark)), now)
    assert bag(EV.fan_out_to(changes(spark), EV.classify_deliveries(EV.receivers(subs(spark)), now)), *cols) == bag(want, *cols)


def test_history_needs_the_newest_changes_of_each_type_alone(spark):
    ch = changes(spark)
    whole = EV.delivery_log(log_inputs(EV.fan_out(ch, subs(spark))))
    for page in (1, 2):
        few = EV.newest_per_type(ch, 4 * page)
        assert few.count() < ch.count()
        got = EV.history(EV.delivery_log(log_inputs(EV.fan_out(few, subs(spark)))), page=page, page_size=4)
        cols = ("webhook_id", "rank", "attempted_at", "id")
        assert bag(got, *cols) == bag(EV.history(whole, page=page, page_size=4), *cols)


def test_ties_at_the_limit_stay(spark):
    tied = spark.createDataFrame([(i, "a", T0) for i in range(30)], CHANGE)
    assert EV.newest_per_type(tied, 4).count() == 30


def test_totals_from_counted_changes(spark):
    ch = changes(spark)
    few = EV.count_per_type(ch)
    assert few.count() == 4
    whole, less = (EV.delivery_log(log_inputs(EV.fan_out(c, subs(spark)))) for c in (ch, few))
    assert bag(EV.totals(less), "webhook_id", "total") == bag(EV.totals(whole), "webhook_id", "total")
    assert bag(EV.history_facts(less, 2), "webhook_id", "total", "n_rows", "has_next") == bag(EV.history_facts(whole, 2), "webhook_id", "total", "n_rows", "has_next")


def test_cascade_does_not_shuffle_the_log(spark):
    log = spark.createDataFrame([(i, i % 5 if i % 6 else None) for i in range(40)], "id long, webhook_id long")
    gone = spark.createDataFrame([(1,), (1,), (3,), (None,), (99,)], "id long")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the ids came from a large table
    try:
        left = EV.cascade_delete(log, gone)
        assert bag(left, "id", "webhook_id") == Counter((i, i % 5 if i % 6 else None) for i in range(40) if not i % 6 or i % 5 not in (1, 3))
        assert "SortMergeJoin" not in left._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_outcomes_found_before_the_fan_out_give_the_same_log(spark):
    rows = spark.createDataFrame([(1, 7, "t", 11, 200, "b" * 1200, 0.25), (2, 7, "t", 12, None, "e" * 1200, 1.5), (3, 8, "t", 13, 500, "no", None)],
                                 "id long, webhook_id long, event_type string, event_id long, response_code int, raw_body string, elapsed_s double")
    rows = rows.withColumn("attempted_at", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    before = EV.delivery_log(EV.outcome_columns(rows))
    assert before.columns == EV.delivery_log(rows).columns
    assert sorted(map(str, before.collect())) == sorted(map(str, EV.delivery_log(rows).collect()))


def test_the_dated_log_is_small_and_keeps_the_setting(spark, tmpdir_path):
    """Ids of a change's deliveries are stored as differences, 8 bytes each before."""
    import os

    from feedyard.sources import logs
    name = "spark.sql.maxConcurrentOutputFileWriters"
    was = spark.conf.get(name, None)
    log = spark.range(0, 200_000, 1, 1).select((F.floor(F.col("id") / 500) * 100000 + F.col("id") % 500).alias("id"),
                                              F.timestamp_seconds(F.lit(1704067200) + (F.floor(F.col("id") / 500) % 3) * 86400).alias("attempted_at"))
    logs.append_deliveries(log, f"{tmpdir_path}/log")
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{tmpdir_path}/log") for f in fs if f.endswith(".parquet"))
    back = logs.read_deliveries(spark, f"{tmpdir_path}/log")
    assert size < 200_000 and back.count() == 200_000 and back.select("attempt_date").distinct().count() == 3
    assert back.exceptAll(log.withColumn("attempt_date", F.to_date("attempted_at"))).isEmpty() and spark.conf.get(name, None) == was


def test_a_task_pairs_a_block_with_all_its_changes_before_the_next(spark):
    """One change after the other before: a change's rows went through every block."""
    many = spark.createDataFrame([(i, ["a"] if i % 3 else ["a", "b"], True) for i in range(60)], "id long, events array<string>, enabled boolean")
    to = EV.receivers(many)
    blocks = 20  # of the type with most receivers, 60, by 3
    for max_rows in (1_000_000, 0):
        pairs = EV.fan_out_to(changes(spark), to, max_rows=max_rows, block=3)
        at = pairs.select(F.spark_partition_id().alias("task"), "event_type", F.pmod(F.xxhash64("webhook_id"), F.lit(blocks)).alias("block"))
        seen = [tuple(r) for r in at.collect()]
        runs = [x for x, before in zip(seen, [None, *seen], strict=False) if x != before]
        assert len(runs) == len(set(runs)) < len(seen)
        assert bag(pairs, "event_id", "webhook_id") == Counter((c["event_id"], r["webhook_id"]) for c in changes(spark).collect() for r in to.collect() if c["event_type"] == r["event_type"])


def test_tasks_follow_the_number_of_pairs(spark, monkeypatch):
    ch, to = changes(spark), EV.receivers(subs(spark))
    n = EV.fan_out_to(ch, to).count()
    monkeypatch.setattr(EV, "TASK_PAIRS", 5)
    pairs = EV.fan_out_to(ch, to)
    assert pairs.rdd.getNumPartitions() == -(-n // 5) and pairs.count() == n
    dated = EV.fan_out_to(ch, to, along=("attempted_at", "event_id"))
    assert bag(dated, "event_id", "event_type", "webhook_id") == bag(pairs, "event_id", "event_type", "webhook_id")
    assert EV.fan_out_to(ch.limit(0), to).count() == EV.fan_out_to(ch, to.limit(0)).count() == 0


def test_a_stream_makes_the_pairs_of_each_micro_batch(spark, tmpdir_path):
    from feedyard.streaming import streams as ST
    for i in range(2):
        changes(spark, 30 * (i + 1)).write.parquet(f"{tmpdir_path}/in/{i}")
    tasks = []

    def each(batch):
        pairs = EV.fan_out(batch, subs(spark))
        tasks.append((batch.isStreaming, pairs.rdd.getNumPartitions()))
        return pairs
    ST.to_parquet(ST.file_stream(spark, f"{tmpdir_path}/in", changes(spark).schema), f"{tmpdir_path}/out", each=each)
    assert len(tasks) == 2 and all(not s and n >= spark.sparkContext.defaultParallelism for s, n in tasks)
    want = bag(EV.fan_out(changes(spark, 30), subs(spark)), "event_id", "webhook_id") + bag(EV.fan_out(changes(spark), subs(spark)), "event_id", "webhook_id")
    assert bag(spark.read.parquet(f"{tmpdir_path}/out"), "event_id", "webhook_id") == want


def test_history_reads_the_newest_dates_of_each_receiver(spark, tmpdir_path):
    from feedyard.sources import logs
    rows = [(i, i % 7 if i % 11 else None, T0 + dt.timedelta(hours=5 * (i // 7)) if i % 13 else None) for i in range(400)]
    rows += [(900 + i, 50, T0) for i in range(3)] + [(950 + i, 51, None) for i in range(9)] + rows[5:9]
    log = spark.createDataFrame(rows, "id long, webhook_id long, attempted_at timestamp").selectExpr(
        "*", "'t' event_type", "'success' status", "200 response_code", "1 response_time_ms", "attempted_at completed_at")
    logs.append_deliveries(log, f"{tmpdir_path}/log")
    cols = ("webhook_id", "rank", "id", "attempted_at")
    for page in (1, 2):
        for max_rows in (1000, 0):
            few = logs.read_newest(spark, f"{tmpdir_path}/log", 4 * page, max_rows)
            assert few.count() < log.count() / 2
            assert bag(EV.history(few, page, 4), *cols) == bag(EV.history(log, page, 4), *cols)
    dated = log.filter("attempted_at is not null and webhook_id < 7")
    logs.append_deliveries(dated, f"{tmpdir_path}/dated")
    few = logs.read_newest(spark, f"{tmpdir_path}/dated", 4)
    assert bag(EV.history(few, 1, 4), *cols) == bag(EV.history(dated, 1, 4), *cols)
    read = few._jdf.queryExecution().executedPlan().toString()
    assert "attempt_date" in read.split("PartitionFilters:")[1].split("]")[0]  # earlier dates are not read
