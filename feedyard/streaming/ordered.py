"""Progress streams in event time: state by job, with an end.

All three operators are `transformWithState` processors on one base, `Ordered`: it holds
the rows of a group of jobs in a list state until the watermark passes them, and then hands them on in
event order, job by job, so files that arrive out of order (by less than the watermark's delay) give the
batch operators' rows.  Timers remove what is no longer needed:

* `throttle`: the last emission of a job goes once `interval` seconds passed without an update,
  since the next update is published whatever came before;
* `snapshot`: a job's fields go `ttl_s` seconds after its last write (an expired row tells);
* `readers`: a reader goes when its job ends or it leaves, the snapshot after `ttl_s` seconds.

A row older than the watermark (the latest event time seen, less the delay) is dropped by Spark,
so the delay is an argument that each caller must give; the snapshot's default is its
time-to-live.  The state store is RocksDB, which holds state on local disk, in the checkpoint
and in bounded memory, whatever the number of jobs.
"""
from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from feedyard import schemas as S

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Rows of a stream that make one group of jobs (see `groups_for`).
GROUP_ROWS = 20_000


def use_rocksdb(spark) -> None:
    """The state store that `transformWithState` needs."""
    spark.conf.set(*STORE)


class Ordered(StatefulProcessor):
    """Rows of a job in order of (event time, seq), once the watermark passed them.

    A key is a group of jobs: a call to the state store costs far more than a row, so a group's
    rows of a micro-batch go to the store as one value, and what is kept of its jobs as another.

    held: names of what is kept of a row that waits; the first three are job_id, `at` (microseconds) and `seq`.
    doubles: those of them that are doubles."""

    held: tuple[str, ...] = ()
    doubles: tuple[str, ...] = ()

    def _row(self, text: str) -> tuple:
        values = json.loads(text)
        for n in self.doubles:
            if values[n] is not None:
                values[n] = float(values[n])  # NaN and infinities come as text
        return tuple(values.values())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.done = handle, None
        self.wait = handle.getListState("wait", "rows binary")  # a value a micro-batch
        self.kept = handle.getListState("kept", "jobs binary")

    def _waiting(self) -> list[list[tuple]]:
        return [pickle.loads(c[0]) for c in self.wait.get()]

    def _kept(self) -> dict:
        return {j: k for c in self.kept.get() for j, k in pickle.loads(c[0])}

    @staticmethod
    def _put(state, values: list) -> None:
        state.put([(pickle.dumps(v, 5),) for v in values]) if values else state.clear()

    @staticmethod
    def _ready(rows: list[tuple]) -> dict:
        """When each job's rows of a micro-batch are all past, in milliseconds."""
        out = {}
        for r in rows:
            out[r[0]] = max(r[1], out.get(r[0], r[1]))
        return {j: at // 1000 for j, at in out.items()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[0] is None:  # a heartbeat has no key: it only moves the watermark
            for _ in rows:
                pass
            return
        new = [self._row(r["held"]) for r in rows]
        self.done = None
        self.wait.appendList([(pickle.dumps(new, 5),)])
        self.handle.registerTimer(min(self._ready(new).values()))
        yield from self.seen({r[0] for r in new})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        if self.done == (key, mark):  # several timers of a group may end at once
            return
        waiting, kept = self._waiting(), self._kept()
        ripe = {j for j, k in kept.items() if (end := self.until(k)) is not None and end <= mark}
        ripe.update(j for rows in waiting for j, at in self._ready(rows).items() if at <= mark)
        due, rest, held = {j: [] for j in ripe}, [], set()
        for rows in waiting:
            left = []
            for r in rows:
                if r[0] in ripe and r[1] // 1000 <= mark:
                    due[r[0]].append(r[1:])
                else:
                    left.append(r)
                    held.add(r[0])
            if left:
                rest.append(left)
        for job, rows in due.items():
            rows.sort(key=itemgetter(0, 1))
            now, out = self.step(job, kept.get(job), rows, mark, job not in held)
            if now is None:
                kept.pop(job, None)
            else:
                kept[job] = now
            yield from out
        if any(due.values()):
            self._put(self.wait, rest)
        if due:
            self._put(self.kept, [list(kept.items())] if kept else [])
        ends = [at for rows in rest for at in self._ready(rows).values()] + [end for k in kept.values() if (end := self.until(k)) is not None]
        if ends:
            self.handle.registerTimer(max(min(ends), mark + 1))
        self.done = (key, mark)

    def seen(self, jobs: set) -> Iterator[Row]:
        """Jobs of which rows have just come; they are not final yet."""
        return iter(())

    def step(self, job, kept, rows: list[tuple], mark: int, last: bool) -> tuple[object, list[Row]]:
        """Final rows of a job, in order: what is kept of it (None: nothing) and the rows to give.
        mark: the watermark in milliseconds; last: nothing waits."""
        raise NotImplementedError

    def until(self, kept) -> int | None:
        """When the job must be looked at again, in milliseconds, though no row comes."""
        raise NotImplementedError

    def close(self) -> None:
        pass


def groups_for(rows: int) -> int:
    """Groups of a stream of some `rows` rows: a group's share stays the same on larger inputs."""
    return max(64, -(-rows // GROUP_ROWS))


def _grouped(rows: DataFrame, groups: int | None) -> DataFrame:
    job = F.col("job_id")
    return rows.withColumn("job_group", F.when(job.isNotNull(), F.pmod(F.xxhash64(job), F.lit(groups)).cast("string")) if groups else job)


def _transform(rows: DataFrame, groups: int | None, processor: StatefulProcessor, out: str, mode: str, begin: DataFrame | None = None) -> DataFrame:
    """groups: how many groups the jobs are dealt to, by a hash; None: each job is one.  It is fixed
    for a checkpoint."""
    use_rocksdb(rows.sparkSession)
    first = _grouped(begin, groups).groupBy("job_group").agg(F.collect_list(F.struct(*begin.columns)).alias("jobs")) if begin is not None else None
    # Python reads a cell at a time, so what is held of a row travels as one
    held = F.to_json(F.struct(*processor.held), {"ignoreNullFields": "false"}).alias("held")
    return (_grouped(rows, groups).select("job_group", "event_time", held).groupBy("job_group")
            .transformWithState(statefulProcessor=processor, outputStructType=out, outputMode=mode, timeMode="eventTime",
                                initialState=first.groupBy("job_group") if first is not None else None))


def _timed(rows: DataFrame, at: str, delay: str) -> DataFrame:
    """`at` in microseconds, with a watermark on the time itself."""
    ts = F.col(at).cast("timestamp")
    return rows.withColumn("event_time", ts).withWatermark("event_time", delay).withColumn("at", F.unix_micros("event_time"))


# ---- T2: throttle ---------------------------------------------------------------------------

class Throttle(Ordered):
    held = ("job_id", "at", "seq", "t", "forced", "started")
    doubles = ("t", "started")
    out = Row("job_id", "seq", "emitted")

    def __init__(self, interval: float):
        self.interval = interval

    def until(self, t0):
        return int((t0 + self.interval) * 1000) + 1

    def step(self, job, t0, rows, mark, last):
        out = []
        for _, seq, t, forced, started in sorted(rows, key=itemgetter(1)):
            ok = bool(forced) or t - (started if t0 is None else t0) >= self.interval
            out.append(self.out(job, seq, ok))
            t0 = t if ok else t0
        return (None if last and t0 is not None and mark > (t0 + self.interval) * 1000 else t0), out


def throttle(updates: DataFrame, delay: str, interval: float = S.PROGRESS_INTERVAL_S, groups: int | None = None) -> DataFrame:
    """W5 / T2 on a live stream: job_id, seq, emitted.

    updates: job_id, seq, t (epoch seconds, along seq), forced, started (when the job's tracker
    was made, epoch seconds: from the job row).  Once `interval` passed since the last emission,
    nothing of it is needed: its state goes."""
    rows = updates.withColumn("when", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    return _transform(_timed(rows, "when", delay), groups, Throttle(interval), "job_id string, seq long, emitted boolean", "append")


# ---- T4: snapshot with time-to-live --------------------------------------------------------------

FIELDS = ("status", "stage", "processed_rows", "total_rows", "progress", "error_message")
_KINDS = ("string", "string", "long", "long", "double", "string")
_FIELD_DDL = ", ".join(f"{f} {k}" for f, k in zip(FIELDS, _KINDS, strict=True))


class Merge:
    """Fields of a job, each from the largest seq that gave it; a pause of `ttl` empties them."""

    ddl = ", ".join(f"{f} {k}, {f}_seq long" for f, k in zip(FIELDS, _KINDS, strict=True)) + ", at long, seq long"

    def __init__(self, ttl_us: int, row: tuple | None = None):
        self.ttl = ttl_us
        self.fields = {f: (row[2 * i], row[2 * i + 1]) for i, f in enumerate(FIELDS) if row[2 * i + 1] is not None} if row else {}
        self.at, self.seq = (row[-2], row[-1]) if row else (None, None)

    def lives(self, at: int) -> bool:
        return self.at is not None and at - self.at < self.ttl

    def add(self, at: int, seq: int, values) -> None:
        """The next update in order of time."""
        if not self.lives(at):
            self.fields, self.seq = {}, None
        for f, v in zip(FIELDS, values, strict=True):
            if v is not None and seq >= self.fields.get(f, (None, seq))[1]:
                self.fields[f] = (v, seq)
        self.at, self.seq = at, max(seq, self.seq if self.seq is not None else seq)

    def get(self, f: str):
        return self.fields.get(f, (None, None))[0]

    def row(self) -> tuple:
        return (*(x for f in FIELDS for x in self.fields.get(f, (None, None))), self.at, self.seq)


class Snapshot(Ordered):
    held = ("job_id", "at", "seq", *FIELDS)
    doubles = ("progress",)
    out = Row("job_id", *FIELDS, "at", "last_seq", "live")

    def __init__(self, ttl_s: int):
        self.ttl = ttl_s * 1_000_000

    def until(self, kept):
        return (kept[-2] + self.ttl) // 1000 + 1

    def _out(self, job, m: Merge, live: bool) -> Row:
        return self.out(job, *[m.get(f) for f in FIELDS], m.at, m.seq, live)

    def seen(self, jobs):
        # what each job looks like now: what is final and all that waits
        kept, waiting = self._kept(), {j: [] for j in jobs}
        for r in chain.from_iterable(self._waiting()):
            if r[0] in waiting:
                waiting[r[0]].append(r[1:])
        for job, rows in waiting.items():
            m = Merge(self.ttl, kept.get(job))
            for at, seq, *values in sorted(rows, key=itemgetter(0, 1)):
                m.add(at, seq, values)
            yield self._out(job, m, live=True)

    def step(self, job, kept, rows, mark, last):
        m = Merge(self.ttl, kept)
        for at, seq, *values in rows:
            m.add(at, seq, values)
        if last and m.at is not None and mark * 1000 > m.at + self.ttl:
            return None, [self._out(job, m, live=False)]
        return m.row() if rows else kept, []


SNAPSHOT_OUT = f"job_id string, {_FIELD_DDL}, at long, last_seq long, live boolean"


def snapshot(events: DataFrame, ttl_s: int = S.SNAPSHOT_TTL_S, delay: str | None = None, groups: int | None = None) -> DataFrame:
    """T4: latest fields per job kept in state, dropped `ttl_s` after the last write.

    Each micro-batch gives the jobs it touched as they are now, also where its rows come late;
    when the watermark passes the last write by `ttl_s`, an expired record (live = FALSE) comes
    and the state goes.  The newest row per job is the snapshot.  delay: how late a row may come
    (the time-to-live unless given)."""
    out = _transform(_timed(events, "updated_at", delay or f"{ttl_s} seconds"), groups, Snapshot(ttl_s), SNAPSHOT_OUT, "update")
    return out.select("job_id", *FIELDS, F.timestamp_micros("at").alias("updated_at"), "last_seq", "live")


# ---- T3 / T5: readers that attach at any time -------------------------------------------------------

CLOSE_POS = 9223372036854775807
UPDATE, ATTACH, LEAVE = 0, 1, 2
READERS_OUT = "reader_id long, job_id string, pos long, kind string, status string, stage string, processed_rows long, progress_percent double"
READER_COLUMNS = [f.split()[0] for f in READERS_OUT.split(", ")]


class Readers(Ordered):
    # an update at the moment of attaching counts to the snapshot
    held = ("job_id", "at", "seq", "kind", "reader_id", *FIELDS)
    doubles = ("progress",)
    out = Row(*READER_COLUMNS)

    def __init__(self, ttl_s: int):
        self.ttl = ttl_s * 1_000_000

    def handleInitialState(self, key, initialState, timerValues) -> None:
        jobs = {}
        for r in initialState["jobs"]:
            jobs.setdefault(r["job_id"], []).append(r["reader_id"])
        self._put(self.kept, [[(j, (None, r)) for j, r in jobs.items()]])

    def until(self, kept):
        return (kept[0][-2] + self.ttl) // 1000 + 1 if kept[0] else None

    def step(self, job, kept, rows, mark, last):
        base, before = kept or (None, [])
        m = Merge(self.ttl, base)
        readers, out = dict.fromkeys(before), []
        close = lambda r: out.append(self.out(r, job, CLOSE_POS, "close", None, None, None, None))
        for at, seq, kind, reader, *values in sorted(rows, key=itemgetter(0, 2, 1)):
            v = dict(zip(FIELDS, values, strict=True))
            if kind == UPDATE:
                m.add(at, seq, values)
                ends = v["status"] in S.TERMINAL_STATUSES
                for r in list(readers):
                    out.append(self.out(r, job, seq, "progress", v["status"], v["stage"], v["processed_rows"], v["progress"]))
                    if ends:
                        close(r)
                        del readers[r]
            elif kind == LEAVE:
                readers.pop(reader, None)
            elif m.lives(at):  # the snapshot comes first; a terminal one is the last
                out.append(self.out(reader, job, 0, "progress", m.get("status"), m.get("stage"), m.get("processed_rows"), m.get("progress")))
                if m.get("status") in S.TERMINAL_STATUSES:
                    close(reader)
                else:
                    readers[reader] = None
            else:  # the job row as a queued record, whatever its status: updates may follow
                out.append(self.out(reader, job, 0, "progress", v["status"], S.STAGE_QUEUED, v["processed_rows"], 0.0))
                readers[reader] = None
        if last and m.at is not None and mark * 1000 > m.at + self.ttl:
            base = None
        elif rows and m.at is not None:
            base = m.row()
        return ((base, list(readers)) if base or readers else None), out


def readers(updates: DataFrame, attached: DataFrame | None, jobs: DataFrame, delay: str, left: DataFrame | None = None, early: DataFrame | None = None,
            ttl_s: int = S.SNAPSHOT_TTL_S, groups: int | None = None) -> DataFrame:
    """T3 / T5 as a stream: what each reader of a job receives, whenever it attaches.

    updates: progress records; attached: reader_id, job_id, attached_at (a stream too); left:
    reader_id, job_id, left_at (readers that went away); early: reader_id, job_id (static) of
    readers that attached before the stream began and have their first record; jobs: the job rows
    (static).  A reader gets the living snapshot, else its job's row as a queued record, at pos 0;
    then each later update up to the first done or failed, then a close record.  A living snapshot
    that is done or failed closes at once.  Readers of unknown jobs get nothing.  Each input has
    its own watermark; the slowest one counts."""
    none = {f: F.lit(None).cast(k) for f, k in zip(FIELDS, _KINDS, strict=True)}

    def rows(df: DataFrame, at: str, kind: int, **given) -> DataFrame:
        cols = {"seq": F.lit(0).cast("long"), "reader_id": F.lit(None).cast("long"), **none, **given}
        df = df.select("job_id", F.col(at).cast("timestamp").alias("when"), F.lit(kind).cast("long").alias("kind"), *[c.alias(n) for n, c in cols.items()])
        return _timed(df, "when", delay)

    both = rows(updates, "updated_at", UPDATE, seq=F.col("seq"), **{f: F.col(f) for f in FIELDS})
    if attached is not None:
        # a left join, so that heartbeats stay; readers of unknown jobs then lose their key
        of = jobs.select("job_id", "status", "processed_rows", "total_rows", F.lit(True).alias("known"))
        who = attached.join(of, "job_id", "left").withColumn("job_id", F.when(F.col("known"), F.col("job_id")))
        both = both.unionByName(rows(who, "attached_at", ATTACH, reader_id=F.col("reader_id"), seq=F.col("reader_id"), **{f: F.col(f) for f in ("status", "processed_rows", "total_rows")}))
    if left is not None:
        both = both.unionByName(rows(left, "left_at", LEAVE, reader_id=F.col("reader_id")))
    return _transform(both, groups, Readers(ttl_s), READERS_OUT, "append", begin=early.select("job_id", "reader_id") if early is not None else None)
