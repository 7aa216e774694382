import datetime as dt

from pyspark.sql import functions as F

from feedyard import schemas as S
from feedyard.operators import events as EV
from feedyard.operators import jobs as J
from feedyard.operators import progress as PG

T0 = dt.datetime(2024, 1, 1)


def ev(spark, rows):
    return spark.createDataFrame(
        [(j, s, st, p, inc, e, None, T0 + dt.timedelta(seconds=s)) for j, s, st, p, inc, e in rows], S.JOB_EVENT)


def test_counter_and_latest(spark):
    e = ev(spark, [("j", 0, "queued", 0, None, None), ("j", 1, None, None, 100, None),
                   ("j", 2, None, None, 250, None), ("j", 3, None, None, 650, None)])
    assert J.latest(e).first()["processed_rows"] == 1000
    assert J.counters(e.filter("increment is not null")).first()["processed_rows"] == 1000
    life = ev(spark, [("k", 0, "queued", 0, None, None), ("k", 1, "parsing", None, None, None),
                      ("k", 2, "importing", None, None, None), ("k", 3, None, None, 500, None),
                      ("k", 4, "done", 1000, None, None)])
    r = J.latest(life).first()
    assert (r["status"], r["processed_rows"]) == ("done", 1000)
    fail = ev(spark, [("f", 0, "queued", 0, None, None), ("f", 1, "importing", None, None, None),
                      ("f", 2, None, None, 100, None), ("f", 3, "failed", None, None, "boom")])
    r = J.latest(fail).first()
    assert (r["status"], r["processed_rows"], r["error_message"]) == ("failed", 100, "boom")


def folded(events):
    """The fold of `events`, a row at a time."""
    jobs = {}
    for r in events:
        jobs.setdefault(r["job_id"], []).append(r)
    out = {}
    for job, rows in jobs.items():
        last = {}
        for c in ("status", "processed_rows", "error_message"):
            given = [(r["seq"], r[c]) for r in rows if r[c] is not None and r["seq"] is not None]
            last[c] = max(given) if given else (None, None)
        since = last["processed_rows"][0]
        added = [r["increment"] for r in rows if r["increment"] is not None and (since is None or (r["seq"] is not None and r["seq"] > since))]
        out[job] = (last["status"][1], (last["processed_rows"][1] or 0) + (sum(added) if job is not None else 0),
                    last["error_message"][1], max((r["at"] for r in rows if r["at"] is not None), default=None))
    return out


def test_tasks_of_the_fold_follow_the_events(spark, monkeypatch):
    """A log is folded by as many tasks as it has work for, however few shuffle partitions are set, and
    a huge log of one job (or of none) by several; every event counts."""
    import re

    from feedyard.operators import skew
    monkeypatch.setattr(skew, "TASK_ROWS", 100, raising=False)
    monkeypatch.setattr(J, "HOT_JOB_EVENTS", 50, raising=False)
    rows = []
    for i in range(2000):
        job = "hot" if i % 3 == 0 else None if i % 7 == 0 else f"j{i % 300}"
        rows.append((job, i if i % 31 else None, f"s{i}" if i % 4 == 0 else None, i if i % 5 == 0 and i < 1500 else None,
                     i if i % 5 else None, f"e{i}" if i % 9 == 0 else None, None, T0 + dt.timedelta(seconds=i) if i % 6 else None))
    e = spark.createDataFrame(rows + rows[:40], S.JOB_EVENT)
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for c, v in zip(old, ("2", "false", "-1"), strict=True):
            spark.conf.set(c, v)
        got = J.latest(e)
        want = folded(e.collect())
        assert {r["job_id"]: (r["status"], r["processed_rows"], r["error_message"], r["updated_at"]) for r in got.collect()} == want
        assert got.count() == len(want) and None in want
        dealt = [int(n) for n in re.findall(r"hashpartitioning\(job_id#[^)]*, (\d+)\)", got._jdf.queryExecution().executedPlan().toString())]
        assert dealt and min(dealt) >= 20
        hot = skew.hot_bins(e, "job_id", 50)
        for job in ("job_id = 'hot'", "job_id is null"):
            cells = [r["count"] for r in skew.bin_salted(e, hot, "job_id", "seq").filter(job).groupBy("_salt").count().collect()]
            assert len(cells) >= 3 and max(cells) <= 150
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_recent_and_outcome(spark):
    jobs = spark.createDataFrame([(str(i), T0 + dt.timedelta(days=i)) for i in range(10)], "job_id string, created_at timestamp")
    assert [r["job_id"] for r in J.recent(jobs, 5).collect()] == ["9", "8", "7", "6", "5"]
    att = spark.createDataFrame([("a", 0, "E", "x"), ("a", 1, None, None),
                                 ("b", 0, "E", "1"), ("b", 1, "E", "2"), ("b", 2, "E", "3"), ("b", 3, "E", "4"),
                                 ("c", 0, "E", "only")],
                                "job_id string, attempt int, error_type string, error_text string")
    miss = spark.createDataFrame([("m", "/x.csv")], "job_id string, path string")
    att = att.unionByName(spark.createDataFrame([("m", 0, None, None)], att.schema))
    got = {r["job_id"]: r for r in J.outcome(att, miss).collect()}
    assert got["a"]["status"] == "done" and got["a"]["attempts_used"] == 2
    assert got["b"]["status"] == "failed" and got["b"]["error_message"] == "E: 4" and got["b"]["event_type"] == "import.failed"
    assert got["c"]["status"] == "importing" and got["c"]["error_message"] == "E: only"
    assert got["m"]["status"] == "failed" and got["m"]["event_type"] is None


def prog(spark, rows):
    return spark.createDataFrame([(j, s, st, stg, p, t, pc, e, T0 + dt.timedelta(seconds=s))
                                  for j, s, st, stg, p, t, pc, e in rows], S.PROGRESS_EVENT)


def test_snapshot_merge_default_and_tail(spark):
    p = prog(spark, [("j", 1, "parsing", "starting", 0, 50000, 0.0, None),
                     ("j", 2, "importing", None, 25000, 50000, 50.0, None),
                     ("j", 3, "done", "completed", 50000, 50000, 100.0, None)])
    snap = PG.snapshot(p.filter("seq <= 2")).first()
    assert snap["stage"] == "starting" and snap["processed_rows"] == 25000       # old stage survives
    jobs = spark.createDataFrame([("j", "importing", 0, 50000), ("q", "queued", 0, 10)],
                                 "job_id string, status string, processed_rows long, total_rows long")
    d = {r["job_id"]: r for r in PG.or_default(jobs, PG.snapshot(p)).collect()}
    assert d["q"]["stage"] == "queued" and d["q"]["progress_percent"] == 0.0 and d["j"]["status"] == "done"
    asof = F.lit(T0 + dt.timedelta(seconds=1)).cast("timestamp")
    tail = PG.tail(jobs, p, asof).filter("job_id = 'j'").orderBy("pos").collect()
    assert [r["kind"] for r in tail] == ["progress", "progress", "progress", "close"]
    done_first = PG.tail(jobs, p, F.lit(T0 + dt.timedelta(seconds=9)).cast("timestamp")).filter("job_id = 'j'")
    assert [r["kind"] for r in done_first.orderBy("pos").collect()] == ["progress", "close"]


def test_expired_snapshot_is_forgotten(spark):
    p = prog(spark, [("j", 1, "failed", "batch_3", 30, 50, 60.0, "E"),
                     ("j", 3601, "importing", None, None, 50, None, None),       # exactly one hour later
                     ("k", 1, "done", "completed", 5, 5, 100.0, None)])
    snap = {r["job_id"]: r for r in PG.snapshot(p, T0 + dt.timedelta(seconds=3700)).collect()}
    assert (snap["j"]["status"], snap["j"]["stage"], snap["j"]["processed_rows"], snap["j"]["error_message"]) == ("importing", None, None, None)
    assert snap["j"]["live"] and not snap["k"]["live"]
    jobs = spark.createDataFrame([("j", "importing", 0, 50), ("k", "importing", 1, 5)],
                                 "job_id string, status string, processed_rows long, total_rows long")
    d = {r["job_id"]: r for r in PG.or_default(jobs, PG.snapshot(p, T0 + dt.timedelta(seconds=3700))).collect()}
    assert d["j"]["from_snapshot"] and (d["k"]["status"], d["k"]["stage"], d["k"]["processed_rows"]) == ("importing", "queued", 1)
    tail = PG.tail(jobs, p, F.lit(T0 + dt.timedelta(seconds=3700)).cast("timestamp")).filter("job_id = 'k'").collect()
    assert [r["kind"] for r in tail] == ["progress"]        # an expired terminal snapshot closes nothing
    # nor does the row of a finished job: a reader without a snapshot gets what comes later
    done = spark.createDataFrame([("k", "done", 5, 5)], "job_id string, status string, processed_rows long, total_rows long")
    more = prog(spark, [("k", 4000, "importing", None, 1, 5, 20.0, None), ("k", 4001, "failed", None, 2, 5, 40.0, None), ("k", 4002, "queued", None, 0, 5, 0.0, None)])
    tail = PG.tail(done, more, F.lit(T0 + dt.timedelta(seconds=3700)).cast("timestamp")).orderBy("pos").collect()
    assert [(r["kind"], r["status"]) for r in tail] == [("progress", "done"), ("progress", "importing"), ("progress", "failed"), ("close", None)]


def test_number_and_text_times_and_null_codec(spark):
    from feedyard.functions import codec as CD
    df = spark.createDataFrame([(1, '{"status":"done","updated_at":1700000000.5}'), (2, '{"status":"done","updated_at":"1700000000"}')], "msg_id int, data string")
    got = {r["msg_id"]: r["updated_at"] for r in PG.normalise(df).collect()}
    assert got == {1: "2023-11-14T22:13:20.500Z", 2: "1700000000"}
    vals = spark.createDataFrame([("null",), ('"a"',), ("a",), ("5",)], "v string").select(CD.decode_text("v").alias("d")).collect()
    assert [r["d"] for r in vals] == [None, "a", "a", "5"]


def test_payload_keeps_nulls_and_fractions(spark):
    import json
    row = spark.sql("""select 'product.updated' event_type, 1L p_id, 'S' p_sku, 'n' p_name, cast(null as string) p_description, true p_active,
        timestamp'2024-01-01 00:00:00.25' p_created_at, timestamp'2024-01-01 00:00:00' p_updated_at,
        cast(null as string) job_id, 0L count, 0L total, cast(null as string) error_message""")
    p = json.loads(EV.payload_json(row).first()["payload"])
    assert p["description"] is None and p["created_at"] == "2024-01-01T00:00:00.250000" and p["updated_at"] == "2024-01-01T00:00:00"


def test_percent_batches_and_throttle(spark):
    acc = spark.createDataFrame([(1, 1 + i // 10000) for i in range(12000)], "file_rank int, batch long")
    rows = spark.createDataFrame([(1,)] * 12000, "file_rank int")
    recs = PG.batch_progress(acc, rows, 10000).orderBy("seq").collect()
    assert [r["stage"] for r in recs] == ["starting", "batch_0", "batch_1", "batch_2_final", "completed"]
    assert [r["processed_rows"] for r in recs] == [0, 0, 10000, 12000, 12000]
    assert recs[2]["progress"] == round(10000 / 12000 * 100, 2)
    up = spark.createDataFrame([("j", 1, 0.0, True), ("j", 2, 0.5, False), ("j", 3, 2.6, False), ("j", 4, 2.7, True)],
                               "job_id string, seq long, t double, forced boolean")
    got = {r["seq"]: r["emitted"] for r in PG.throttled(up).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True}


def test_normalise(spark):
    msgs = spark.createDataFrame([(1, "  "), (2, '{"event":"close","job_id":"1"}'), (3, '{"job_id":"1"}'),
                                  (4, '{"status":"failed","error_message":"x","processed_rows":5,"total_rows":10,'
                                      '"updated_at":0}'),
                                  (5, '{"status":"weird","progress":12.5,"updated_at":"2024-01-01T00:00:00Z"}')],
                                 "msg_id long, data string")
    got = {r["msg_id"]: r for r in PG.normalise(msgs).collect()}
    assert set(got) == {4, 5}
    assert got[4]["status_text"] == "Import failed: x" and got[4]["percent_shown"] == "50.0%"
    assert got[4]["updated_at"] == "1970-01-01T00:00:00.000Z" and got[4]["job_id"] == ""
    assert got[5]["display_status"] == "idle" and got[5]["status_text"] == "Processing..."
    assert got[5]["progress_percent"] == 12.5


def subs(spark):
    return spark.createDataFrame(
        [(1, "https://a", ["product.created", "product.created"], True, T0, T0),
         (2, "http://b", ["product.created", "import.failed"], True, T0, T0),
         (3, "https://c", ["product.created"], False, T0, T0),
         (4, "ftp://d", [], True, T0, T0)], S.SUBSCRIPTION)


def test_subscription_rules_and_fanout(spark):
    chk = {r["id"]: r for r in EV.check_subscriptions(subs(spark)).collect()}
    assert chk[4]["valid"] is False and chk[4]["reasons"] == "url_scheme,events_empty" and chk[1]["valid"]
    changes = spark.createDataFrame([(10, "product.created"), (11, "import.failed"), (12, "product.deleted")],
                                    "event_id long, event_type string")
    pairs = sorted((r["event_id"], r["webhook_id"]) for r in EV.fan_out(changes, subs(spark)).collect())
    assert pairs == [(10, 1), (10, 2), (11, 2)]   # duplicate type once, disabled skipped
    sizes = {r["event_id"]: r["receivers"] for r in EV.fan_out_size(changes, subs(spark)).collect()}
    assert sizes == {10: 2, 11: 1, 12: 0}


def test_delivery_rules(spark):
    rows = [(i, 1, "product.created", i, code, body, 0.0123, T0)
            for i, (code, body) in enumerate([(199, "a"), (200, "b" * 1000), (299, "c" * 1001), (300, "d"),
                                              (None, "e" * 1500)])]
    d = spark.createDataFrame(rows, "id long, webhook_id long, event_type string, event_id long, "
                                    "response_code int, raw_body string, elapsed_s double, attempted_at timestamp")
    got = {r["id"]: r for r in EV.delivery_log(d).collect()}
    assert [got[i]["status"] for i in range(5)] == ["failed", "success", "success", "failed", "failed"]
    assert got[1]["response_body"] == "b" * 1000
    assert got[2]["response_body"] == "c" * 1000 + "... (truncated)"
    assert got[4]["response_body"] == "e" * 1000
    assert got[0]["response_time_ms"] == 12
    t = dt.datetime(2024, 1, 1)
    tried = spark.createDataFrame([(1, 1, 0, "success", False, None, t), (2, 1, 2, "failed", False, "E" * 1200, t), (3, 1, 9, "success", True, "x", t), (4, 1, 1, "success", True, "y", t)],
                                  "event_id long, webhook_id long, internal_failures int, status string, running boolean, internal_error string, completed_at timestamp")
    by = {}
    for r in EV.attempt_ledger(tried).orderBy("attempt").collect():
        by.setdefault(r["event_id"], []).append((r["status"], r["error_text"], r["completed_at"]))
    # a try that died leaves a failed row with its error; only a running one is pending
    died = ("failed", "E" * 1000, t)
    assert by == {1: [("success", None, t)], 2: [died, died, ("failed", None, t)], 3: [("failed", "x", t)] * 4, 4: [("failed", "y", t), ("pending", None, None)]}
    last = {r["event_id"]: (r["status"], r["attempts"]) for r in EV.latest_status(tried).collect()}
    assert last == {1: ("success", 1), 2: ("failed", 3), 3: ("failed", 4), 4: ("pending", 2)}
    plain = EV.attempt_ledger(tried.select("event_id", "webhook_id", "internal_failures", "status"))
    assert [r["status"] for r in plain.filter("event_id = 4").orderBy("attempt").collect()] == ["failed", "success"]
    cur = spark.createDataFrame([(1, True), (2, False)], "id long, enabled boolean")
    pairs = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "event_id long, webhook_id long")
    acts = {r["webhook_id"]: r["action"] for r in EV.classify_deliveries(pairs, cur).collect()}
    assert acts == {1: "deliver", 2: "disabled", 3: "missing"}


def test_throttle_segments_equal_sequential_loop(spark):
    import random
    rnd = random.Random(5)
    rows, want = [], {}
    for j in range(6):
        t, last = 0.0, None
        for s in range(rnd.randint(1, 60)):
            t += rnd.choice([0.1, 0.5, 1.0, 1.9, 2.0, 3.5])
            forced = rnd.random() < 0.15
            if last is None:
                last = t                      # clock starts at the first update
            ok = forced or (t - last) >= 2.0
            if ok:
                last = t
            rows.append((f"j{j}", s, t, forced))
            want[(f"j{j}", s)] = ok
    df = spark.createDataFrame(rows, "job_id string, seq long, t double, forced boolean")
    for bucket in (PG.SEQ_BUCKET, 7):        # 7: segments cross the bounded window groups
        got = {(r["job_id"], r["seq"]): r["emitted"] for r in PG.throttled(df, seq_bucket=bucket).collect()}
        assert got == want, bucket


def _sequential(rows, interval=2.0):
    """The publish throttle as the service runs it, one update at a time."""
    last, out = {}, {}
    for job, seq, t, forced in sorted(rows):
        last.setdefault(job, t)
        out[job, seq] = ok = forced or (t - last[job]) >= interval
        if ok:
            last[job] = t
    return out


def test_throttle_by_pointers_equals_sequential_loop(spark):
    import random
    rnd = random.Random(11)
    rows = []
    for j in range(5):
        t = rnd.choice([0.0, 1.7e9])
        for s in range(rnd.randint(1, 120)):
            t += rnd.choice([0.0, 0.1, 0.5, 1.0, 1.9, 1.9, 2.0, -0.7])   # equal times, and a clock set back
            rows.append((f"j{j}", s, t, rnd.random() < 0.04))
    df = spark.createDataFrame(rows, "job_id string, seq long, t double, forced boolean")
    want = _sequential(rows)
    for bucket, fold in ((PG.SEQ_BUCKET, 1), (7, 1), (7, 10), (PG.SEQ_BUCKET, PG.FOLD)):
        got = {(r["job_id"], r["seq"]): r["emitted"] for r in PG.throttled(df, seq_bucket=bucket, fold=fold).collect()}
        assert got == want, (bucket, fold)


def test_throttle_burst_spreads_over_tasks(spark):
    """One job's unforced burst: no Python, and no task that takes all of it."""
    n = 60_000
    df = spark.range(n).select(F.lit("hot").alias("job_id"), F.col("id").alias("seq"), (F.col("id") * 0.125).alias("t"), F.lit(False).alias("forced"))
    out = PG.throttled(df, seq_bucket=5_000)
    got = out.filter("emitted").select("seq").toPandas()["seq"].sort_values().tolist()
    assert got == list(range(16, n, 16))
    assert out.count() == n
    plan = out._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and "Python" not in plan


def test_deep_page_equals_top_k(spark):
    from feedyard.operators import catalog as C
    t = spark.range(30000).select(F.col("id"), (F.col("id") % 997).cast("timestamp").alias("created_at"))
    deep = [r["id"] for r in C.page(t, C.ProductFilter(), 201, 60).collect()]
    rows = sorted(((r["created_at"], r["id"]) for r in t.collect()), reverse=True)
    assert deep == [i for _, i in rows[12000:12060]]


def test_subscription_create_and_patch(spark):
    req = spark.createDataFrame([(1, " https://x", ["product.created"], None), (2, "https://y ", ["import.failed"], False),
                                 (3, "ftp://z", ["product.created"], True), (4, "https://w", [], True)],
                                "req_id long, url string, events array<string>, enabled boolean")
    got = {r["req_id"]: r for r in EV.create_subscriptions(subs(spark), req, "2025-01-01").collect()}
    assert [got[i]["outcome"] for i in (1, 2, 3, 4)] == ["invalid", "created", "invalid", "invalid"]
    assert got[2]["id"] == 5 and got[2]["url"] == "https://y" and got[2]["enabled"] is False
    patches = spark.createDataFrame([(1, 1, "https://new ", None, None), (2, 1, None, None, False),
                                     (3, 1, "ftp://bad", None, None), (4, 9, None, None, True),
                                     (5, 2, None, [], None)],
                                    "req_id long, id long, url string, events array<string>, enabled boolean")
    patches = patches.unionByName(spark.createDataFrame([(6, 2, None, None, None), (7, 3, None, None, True), (8, 3, None, None, False)], patches.schema))
    was = subs(spark).withColumn("created_at", F.lit(T0).cast("timestamp")).withColumn("updated_at", F.lit(T0).cast("timestamp"))
    report, after = EV.patch_subscriptions(was, patches, dt.datetime(2025, 1, 1))
    assert {r["req_id"]: r["outcome"] for r in report.collect()} == \
        {1: "applied", 2: "applied", 3: "invalid", 4: "not_found", 5: "invalid", 6: "applied", 7: "applied", 8: "applied"}
    a = {r["id"]: r for r in after.collect()}
    assert a[1]["url"] == "https://new" and a[1]["enabled"] is False and a[1]["events"] == "product.created,product.created"
    assert a[2]["n_applied"] == 1 and a[2]["updated_at"] == T0          # nothing given, nothing moved
    assert a[1]["updated_at"] == a[3]["updated_at"] == dt.datetime(2025, 1, 1)
    report, left = EV.delete_subscriptions(was, spark.createDataFrame([(1,), (1,), (77,)], "id long"))
    assert {r["id"]: r["outcome"] for r in report.collect()} == {1: "deleted", 77: "not_found"}
    assert 1 not in {r["id"] for r in left.collect()}


def test_progress_to_readers(spark):
    p = prog(spark, [("j", 1, "parsing", None, 0, 10, 0.0, None), ("j", 5, "done", None, 10, 10, 100.0, None),
                     ("k", 2, "importing", None, 1, 10, 10.0, None)])
    readers = spark.createDataFrame([(1, "j", T0), (2, "j", T0 + dt.timedelta(seconds=3)), (3, "x", T0)],
                                    "reader_id long, job_id string, attached_at timestamp")
    got = sorted((r["reader_id"], r["seq"]) for r in PG.to_readers(p, readers).collect())
    assert got == [(1, 1), (1, 5), (2, 5)]
