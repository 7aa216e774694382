"""Adapters: deterministic inputs built from the driver tables.

Each adapter has a twin in `plans/oracle.py` written in plain SQL; both must
describe the same rows.  The feed adapter also renders real CSV files (one per
feed file, header first) so that imports go through the CSV source.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedyard.session import path_exists, scratch_path

RUN_TS = "2025-01-01 00:00:00"        # fixed run timestamp of comparable queries
CATALOG_EPOCH = 1704067200            # 2024-01-01 00:00:00 UTC
FEED_BATCH = 100                      # batch size used by the adapter queries

# Feed file layouts: header columns by feed file number (p_partkey % 4).
FEED_HEADERS = {
    0: ("sku", "name", "description", "active"),
    1: ("sku", "name", "description", "active", "price"),
    2: ("name", "sku", "description", "active"),
    3: ("sku", "name", "description"),
}
ACTIVE_TOKENS = ("true", "yes", "0", "N", "", "maybe", " False ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mod(c: Column, n: int) -> Column:
    return c % F.lit(n)


def feed_fields(part: DataFrame) -> DataFrame:
    """Raw text of every feed field, one row per part row (before CSV rendering)."""
    p = F.col("p_partkey")
    # twelve rows a key; about half of the keys are in the catalog
    base = F.concat(F.lit("Sku-"), (F.floor(p / 12) * 24).cast("string"))
    cased = F.when(_mod(p, 3) == 0, F.upper(base)).when(_mod(p, 3) == 1, F.lower(base)).otherwise(base)
    sku = (F.when(_mod(p, 101) == 0, F.lit("")).when(_mod(p, 103) == 0, F.lit("   "))
           .when(_mod(p, 5) == 0, F.concat(F.lit("  "), cased, F.lit(" ")))
           .when(_mod(p, 5) == 1, F.concat(F.lit("\t"), cased)).otherwise(cased))
    name = (F.when(_mod(p, 97) == 0, F.lit("")).when(_mod(p, 89) == 0, F.lit("n" * 300))
            .when(_mod(p, 7) == 3, F.concat(F.lit(" "), F.col("p_name"), F.lit("  ")))
            .otherwise(F.col("p_name")))
    desc = (F.when(_mod(p, 6) == 0, F.lit(""))
            .when(_mod(p, 13) == 0, F.concat(F.col("p_type"), F.lit(', "special"')))
            .otherwise(F.col("p_type")))
    active = F.element_at(F.array(*[F.lit(t) for t in ACTIVE_TOKENS]), (_mod(p, 7) + 1).cast("int"))
    file_no = _mod(p, 4).cast("int")
    width = F.element_at(F.array(*[F.lit(len(FEED_HEADERS[i])) for i in range(4)]), file_no + 1)
    n_fields = (F.when(_mod(p, 53) == 0, 2).when(_mod(p, 59) == 0, 3)
                .when((file_no == 1) & (_mod(p, 61) == 1), 6).otherwise(width))
    return part.select(p.alias("p"), file_no.alias("file_no"), sku.alias("sku"), name.alias("name"),
                       desc.alias("description"), active.alias("active"),
                       F.col("p_size").cast("string").alias("price"), n_fields.alias("n_fields"))


def _quote(c: Column) -> Column:
    return F.when(c.rlike('[,"\r\n]'),
                  F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def feed_lines(part: DataFrame) -> DataFrame:
    """(file_no, ord, line) with a header line (ord 0) per file."""
    f = feed_fields(part)
    ordered = None
    for i, cols in FEED_HEADERS.items():
        arr = F.array(*[_quote(F.col(c)) for c in cols], F.lit("x"))
        ordered = F.when(F.col("file_no") == i, arr) if ordered is None else ordered.when(F.col("file_no") == i, arr)
    data = f.select("file_no", (F.col("p") + 1).alias("ord"),
                    F.array_join(F.slice(ordered, 1, F.col("n_fields")), ",").alias("line"))
    spark = part.sparkSession
    heads = spark.createDataFrame([(i, 0, ",".join(c)) for i, c in FEED_HEADERS.items()],
                                  "file_no int, ord long, line string")
    present = f.select("file_no").distinct()
    return data.unionByName(heads.join(present, "file_no", "left_semi"))


def write_lines(lines: DataFrame, out: str) -> None:
    """Write pre-rendered CSV lines, one file per `file_no`, lines in `ord` order."""
    (lines.repartition("file_no").sortWithinPartitions("file_no", "ord").select("file_no", "line")
     .write.mode("overwrite").partitionBy("file_no")
     .option("sep", "\u0001").option("quote", "\u0002").option("escape", "\u0002")
     .option("escapeQuotes", "false").option("ignoreLeadingWhiteSpace", "false")
     .option("ignoreTrailingWhiteSpace", "false").option("header", "false")
     .csv(out))


def _render_tag(*parts) -> str:
    """Cache key of a rendered feed: input folder plus the rendering code itself, so a
    changed adapter never reuses files rendered by an older one."""
    import inspect
    src = [p if isinstance(p, str) else inspect.getsource(p) for p in parts]
    return hashlib.md5("\n".join(src + [repr(FEED_HEADERS), repr(ACTIVE_TOKENS)]).encode()).hexdigest()[:16]


def feed_dir(spark: SparkSession, sf_dir: str) -> str:
    """CSV feed rendered from `part` (written once per scratch folder and adapter version)."""
    tag = _render_tag(sf_dir, feed_fields, feed_lines, _quote, write_lines)
    out = scratch_path(spark, "feeds", tag)
    if not path_exists(spark, out + "/_SUCCESS"):
        write_lines(feed_lines(table(spark, sf_dir, "part")), out)
    return out


GATE_KINDS = ("good", "upper", "text", "latin", "headless", "empty", "price")


def gate_feed_dir(spark: SparkSession, sf_dir: str) -> str:
    """Feeds from `part` that meet every file gate, one folder a kind: a good file, one with an
    upper-case extension, a .txt file, one with bytes that are no UTF-8, one without a required
    header, an empty one, and one with an unknown header."""
    out = scratch_path(spark, "gates", _render_tag("gates:" + sf_dir, gate_feed_dir))
    if path_exists(spark, out + "/_done/_SUCCESS"):
        return out
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    p = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(_mod(p, len(GATE_KINDS) - 1).alias("k"), p.alias("p"), "p_name")
    for i, kind in enumerate(k for k in GATE_KINDS if k != "empty"):
        second = F.concat(F.lit("é"), F.col("p_name")) if kind == "latin" else F.col("p_name")
        heads = {"headless": ["sku", "title"], "price": ["sku", "name", "price"]}.get(kind, ["sku", "name"])
        cells = [F.concat(F.lit("G-"), F.col("p").cast("string")), second, F.lit("1")][:len(heads)]
        part = rows.filter(F.col("k") == i).repartition(1).sortWithinPartitions("p").select(*[c.alias(h) for c, h in zip(cells, heads)])
        part.write.mode("overwrite").option("header", "true").option("encoding", "ISO-8859-1" if kind == "latin" else "UTF-8").csv(f"{out}/{kind}")
        if kind in ("upper", "text"):
            for f in fs.listStatus(path(f"{out}/{kind}")):
                name = f.getPath().toString()
                if name.endswith(".csv"):
                    fs.rename(f.getPath(), path(name[:-4] + (".CSV" if kind == "upper" else ".txt")))
    fs.create(path(f"{out}/empty/none.csv")).close()
    spark.range(1).write.mode("overwrite").parquet(out + "/_done")
    return out


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existing catalog: one row per part, unique sku 'SKU-<partkey>'."""
    p = F.col("p_partkey")
    sku = F.concat(F.lit("SKU-"), p.cast("string"))
    ts = F.timestamp_seconds(F.lit(CATALOG_EPOCH) + F.floor(p / 4))
    return (table(spark, sf_dir, "part")
            .select((p + 1).alias("id"), sku.alias("sku"), F.col("p_name").alias("name"),
                    F.when(_mod(p, 10) == 0, F.lit(None)).otherwise(F.col("p_type")).alias("description"),
                    (_mod(F.col("p_size"), 3) != 0).alias("active"),
                    ts.alias("created_at"), ts.alias("updated_at"), F.lower(sku).alias("sku_key")))


def run_ts() -> Column:
    return F.lit(RUN_TS).cast("timestamp")


# ---- request sets -------------------------------------------------------------

def lookup_id_requests(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2 + 1).alias("id"))


def lookup_sku_requests(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    k = (F.col("l_partkey") * 2).cast("string")
    arg = (F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("sku-"), k))
           .when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("SKU-"), k))
           .otherwise(F.concat(F.lit("Sku-"), k, F.lit(" "))))
    return li.select(arg.alias("arg"))


def create_requests(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    sku = F.when(key % 211 == 0, F.lit("   ")).otherwise(
        F.concat(F.lit("  Sku-"), (key % 5000).cast("string"), F.lit(" ")))
    return o.select(key.alias("req_id"), sku.alias("sku"),
                    F.concat(F.lit("Order "), key.cast("string")).alias("name"),
                    F.col("o_orderpriority").alias("description"),
                    (F.col("o_orderstatus") != "F").alias("active"))


def patch_requests(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    sku = (F.when(key % 4 == 0, F.concat(F.lit(" sku-"), (key * 2).cast("string")))
           .when(key % 4 == 1, F.concat(F.lit("SKU-"), (key * 2 + 2).cast("string"))))
    name = F.when(key % 3 == 0, F.concat(F.lit("Renamed "), key.cast("string")))
    desc = F.when(key % 5 == 0, F.col("o_orderpriority"))
    active = F.when(F.col("o_orderstatus") == "F", F.lit(False)).when(F.col("o_orderstatus") == "O", F.lit(True))
    first = o.select(key.alias("req_id"), (key * 2 + 1).alias("id"), sku.alias("sku"), name.alias("name"),
                     desc.alias("description"), active.alias("active"))
    # every id again: a new key, the same one twice, a padded or repeated name, a cleared flag
    again = F.when(key % 3 != 1, F.concat(F.lit(" New-"), F.floor(key / 2).cast("string"), F.lit(" ")))
    second = o.select((key + 10_000_000).alias("req_id"), (key * 2 + 1).alias("id"), again.alias("sku"),
                      F.when(key % 2 == 0, F.concat(F.lit("  Renamed "), key.cast("string"), F.lit(" "))).alias("name"),
                      F.lit(None).cast("string").alias("description"), F.lit(None).cast("boolean").alias("active"))
    third = o.filter(key % 2 == 0).select((key + 20_000_000).alias("req_id"), (key * 2 + 1).alias("id"), again.alias("sku"),
                                          F.when(key % 7 == 0, F.lit("   ")).alias("name"), F.col("o_orderpriority").alias("description"),
                                          F.lit(True).alias("active"))
    return first.unionByName(second).unionByName(third)


def delete_requests(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 2 + 1).alias("id"))


# ---- jobs and progress ------------------------------------------------------------

ASOF = "2024-01-15 12:00:00"   # reader attach time for snapshot / tail queries
PROGRESS_TOTAL = 1000


EVENTS_PER_FILE = 5_000_000


def event_files(spark, sf_dir) -> str:
    """`events` as at least four files written one after another, in event order: a stream of
    them carries state from one micro-batch to the next."""
    out = scratch_path(spark, "events", _render_tag("events:" + sf_dir, event_files))
    if not path_exists(spark, out + "/_done/_SUCCESS"):
        e = table(spark, sf_dir, "events")
        row = e.agg(F.count("*").alias("n"), F.coalesce(F.max("event_id"), F.lit(0)).alias("top")).first()
        files, top = max(4, -(-row["n"] // EVENTS_PER_FILE)), row["top"] + 1
        for i in range(files):
            part = e.filter((F.col("event_id") >= top * i // files) & (F.col("event_id") < top * (i + 1) // files))
            part.coalesce(1).write.mode("overwrite").parquet(f"{out}/{i:06d}")
        spark.range(1).write.mode("overwrite").parquet(out + "/_done")
    return out


#: How late rows of the out-of-order files may come.
LATENESS_S = 3600


def late_event_files(spark, sf_dir) -> str:
    """`events` as four files in time, but a third of the rows of a file's last half hour come
    with the next one; then a heartbeat, a row of nulls but for its time, which moves the
    watermark to the last event."""
    out = scratch_path(spark, "events-late", _render_tag("events:" + sf_dir, late_event_files))
    if not path_exists(spark, out + "/_done/_SUCCESS"):
        e = table(spark, sf_dir, "events")
        top = e.agg(F.coalesce(F.max("event_id"), F.lit(0)).alias("top")).first()["top"] + 1
        e = e.withColumn("file", F.floor(F.col("event_id") * 4 / top).cast("int"))
        ends = F.broadcast(e.groupBy("file").agg(F.max("ts").alias("end")))  # four rows
        late = (F.col("event_id") % 3 == 1) & (F.col("ts") > F.col("end") - F.expr(f"INTERVAL {LATENESS_S // 2} SECONDS")) & (F.col("file") < 3)
        e = e.join(ends, "file").withColumn("file", F.col("file") + late.cast("int")).drop("end").checkpoint()
        for i in range(4):
            part = e.filter(F.col("file") == i).drop("file")
            part.coalesce(1).write.mode("overwrite").parquet(f"{out}/{i:06d}")
        last = e.agg((F.max("ts") + F.expr(f"INTERVAL {LATENESS_S} SECONDS")).alias("ts"))
        none = [F.lit(None).cast(k).alias(c) for c, k in table(spark, sf_dir, "events").dtypes if c != "ts"]
        beat = last.filter(F.col("ts").isNotNull()).select(*none, "ts").select(*table(spark, sf_dir, "events").columns)
        beat.coalesce(1).write.mode("overwrite").parquet(f"{out}/{4:06d}")
        spark.range(1).write.mode("overwrite").parquet(out + "/_done")
    return out


def reader_files(spark, sf_dir) -> str:
    """The readers in four files by the time they attach, then a heartbeat at the events' last time."""
    out = scratch_path(spark, "readers", _render_tag("readers:" + sf_dir, reader_files, progress_readers))
    if not path_exists(spark, out + "/_done/_SUCCESS"):
        r = progress_readers(spark, sf_dir)
        for i in range(4):
            part = r.filter((F.col("reader_id") % 720 >= 180 * i) & (F.col("reader_id") % 720 < 180 * (i + 1)))
            part.coalesce(1).write.mode("overwrite").parquet(f"{out}/{i:06d}")
        last = table(spark, sf_dir, "events").agg((F.greatest(F.max("ts"), F.timestamp_seconds(F.lit(CATALOG_EPOCH + 720 * 3600)).cast("timestamp_ntz")) + F.expr(f"INTERVAL {LATENESS_S} SECONDS")).alias("attached_at"))
        last.select(F.lit(None).cast("long").alias("reader_id"), F.lit(None).cast("string").alias("job_id"), "attached_at").select(*r.columns).coalesce(1).write.mode("overwrite").parquet(f"{out}/{4:06d}")
        spark.range(1).write.mode("overwrite").parquet(out + "/_done")
    return out


def trackers(spark, sf_dir) -> DataFrame:
    """When each job's progress tracker was made: at its first update."""
    return throttle_updates(spark, sf_dir).groupBy("job_id").agg(F.min_by("t", "seq").alias("started"))


def jobs(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    status = (F.when(F.col("o_orderstatus") == "O", "importing")
              .when(F.col("o_orderstatus") == "P", "parsing").otherwise("done"))
    total = F.floor(F.col("o_totalprice") / 100).cast("long")
    return o.select(k.cast("string").alias("job_id"),
                    F.concat(F.lit("feed_"), k.cast("string"), F.lit(".csv")).alias("filename"),
                    F.when(k % 10 == 0, "bulk_delete").otherwise("import").alias("job_type"),
                    status.alias("status"), total.alias("total_rows"),
                    F.when(status == "done", total).otherwise(F.lit(0)).cast("long").alias("processed_rows"),
                    F.lit(None).cast("string").alias("error_message"),
                    F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))


def job_events(spark, sf_dir) -> DataFrame:
    zero = F.struct(F.lit(0).cast("long").alias("line"), F.lit(0).cast("long").alias("part"),
                    F.lit(0).cast("long").alias("supp"), F.lit(0.0).alias("qty"), F.lit(0.0).alias("price"))
    created = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("job_id"), zero.alias("seq"),
        F.lit("queued").alias("status"), F.lit(0).cast("long").alias("processed_rows"),
        F.lit(None).cast("long").alias("increment"), F.lit(None).cast("string").alias("error_message"),
        F.col("o_orderdate").alias("at"))
    li = table(spark, sf_dir, "lineitem")
    ln = F.col("l_linenumber")
    odd = ln % 2 == 1
    status = (F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_linestatus") == "F", "done")
              .otherwise("importing"))
    # (l_orderkey, l_linenumber) repeats in the driver data: order events by the
    # whole line so that "last" is well defined
    seq = F.struct(ln.cast("long").alias("line"), F.col("l_partkey").alias("part"),
                   F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("qty"),
                   F.col("l_extendedprice").alias("price"))
    upd = li.select(
        F.col("l_orderkey").cast("string").alias("job_id"), seq.alias("seq"),
        F.when(~odd, status).alias("status"),
        F.when(~odd & (ln % 4 == 0), F.col("l_extendedprice").cast("long")).alias("processed_rows"),
        F.when(odd, F.col("l_quantity").cast("long")).alias("increment"),
        F.when(~odd & (F.col("l_returnflag") == "R"),
               F.concat(F.lit("ValueError: bad row "), F.col("l_partkey").cast("string"))).alias("error_message"),
        F.col("l_shipdate").alias("at"))
    return created.unionByName(upd)


def increments(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("job_id"), F.col("l_linenumber").cast("long").alias("seq"),
        F.col("l_quantity").cast("long").alias("increment"))


def attempts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("job_id"), (F.col("l_linenumber") - 1).alias("attempt"),
        F.when(F.col("l_returnflag") == "R", F.lit("RuntimeError")).alias("error_type"),
        F.concat(F.lit("attempt "), F.col("l_linenumber").cast("string")).alias("error_text"),
        F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("tie"))


def missing_files(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    j = F.col("o_orderkey").cast("string")
    return (o.filter((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 7 == 0))
            .select(j.alias("job_id"), F.concat(F.lit("/uploads/"), j, F.lit(".csv")).alias("path")))


def _progress_status() -> Column:
    et = F.col("event_type")
    return (F.when(et == "click", "importing").when(et == "view", "parsing").when(et == "signup", "queued")
            .when(et == "purchase", "done").when(et == "error", "failed"))


def progress_events(spark, sf_dir) -> DataFrame:
    return progress_events_of(table(spark, sf_dir, "events"))


def progress_events_of(e: DataFrame) -> DataFrame:
    from feedyard.functions.text import percent
    eid = F.col("event_id")
    processed = F.when(eid % 4 != 0, eid % 1000).cast("long")
    return e.select(
        F.col("user_id").cast("string").alias("job_id"), eid.alias("seq"), _progress_status().alias("status"),
        F.when(eid % 3 != 0, F.concat(F.lit("batch_"), (eid % 17).cast("string"))).alias("stage"),
        processed.alias("processed_rows"), F.lit(PROGRESS_TOTAL).cast("long").alias("total_rows"),
        F.when(processed.isNotNull(), percent(processed, F.lit(PROGRESS_TOTAL))).alias("progress"),
        F.when((F.col("event_type") == "error") & (eid % 5 != 0),
               F.concat(F.lit("RuntimeError: event "), eid.cast("string"))).alias("error_message"),
        F.col("ts").alias("updated_at"))


def throttle_updates(spark, sf_dir) -> DataFrame:
    return throttle_updates_of(table(spark, sf_dir, "events"))


def throttle_updates_of(e: DataFrame) -> DataFrame:
    return e.select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"),
                    (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
                    F.col("event_type").isin("purchase", "error").alias("forced"))


def sse_messages(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    eid, uid = F.col("event_id"), F.col("user_id").cast("string")
    q = lambda s: F.lit(s)
    fields = [
        F.when(eid % 7 != 0, F.concat(q('"job_id":"'), uid, q('"'))),
        F.when(eid % 11 != 0, F.concat(q('"status":"'), _progress_status(), q('"'))),
        F.when(eid % 13 != 0, F.concat(q('"processed_rows":'), (eid % 1000).cast("string"))),
        F.when(eid % 17 != 0, q('"total_rows":1000')),
        F.when(eid % 9 != 0, F.when(eid % 2 == 0, F.concat(q('"progress":'), (eid % 100).cast("string")))
               .otherwise(F.concat(q('"progress_percent":'), (eid % 100).cast("string")))),
        F.when(eid % 21 == 0, F.concat(q('"updated_at":"'), eid.cast("string"), q('"')))
        .when(eid % 3 == 0, F.concat(q('"updated_at":'), F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")))
        .otherwise(F.concat(q('"updated_at":"2024-01-0'), (eid % 9 + 1).cast("string"), q('T00:00:00Z"'))),
    ]
    data = (F.when(eid % 23 == 0, q("  "))
            .when(eid % 19 == 0, F.concat(q('{"event":"close","job_id":"'), uid, q('"}')))
            .otherwise(F.concat(q("{"), F.concat_ws(",", *fields), q("}"))))
    return e.select(eid.alias("msg_id"), data.alias("data"))


# ---- subscriptions, change events, deliveries ---------------------------------------

from feedyard.schemas import EVENT_TYPES  # noqa: E402


def subscriptions(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    E = F.array(*[F.lit(t) for t in EVENT_TYPES])
    i = F.floor(k / 6) % 6
    e = lambda off: F.element_at(E, ((i + off) % 6 + 1).cast("int"))
    m = k % 6
    events = (F.when(m == 0, F.array().cast("array<string>")).when(m == 1, F.array(e(0)))
              .when(m == 2, F.array(e(0), e(1))).when(m == 3, F.array(e(0), e(2), e(0)))
              .when(m == 4, F.array(e(0), e(3))).otherwise(F.array(e(4))))
    url = (F.when(k % 9 == 0, F.concat(F.lit("ftp://hooks.example/"), k.cast("string")))
           .when(k % 9 == 1, F.concat(F.lit("  https://hooks.example/"), k.cast("string"), F.lit(" ")))
           .otherwise(F.concat(F.lit("https://hooks.example/s/"), k.cast("string"))))
    ts = F.timestamp_seconds(F.lit(CATALOG_EPOCH) + k * 3600)
    return s.select(k.alias("id"), url.alias("url"), events.alias("events"), (k % 4 != 0).alias("enabled"),
                    ts.alias("created_at"), ts.alias("updated_at"))


def valid_subscriptions(spark, sf_dir) -> DataFrame:
    s = subscriptions(spark, sf_dir)
    ok = (F.col("url").startswith("http://") | F.col("url").startswith("https://")) & (F.size("events") > 0)
    return s.filter(ok)


def current_subscriptions(spark, sf_dir) -> DataFrame:
    """State at delivery time: some deleted, some disabled since the event."""
    s = valid_subscriptions(spark, sf_dir)
    return (s.filter(F.col("id") % 7 != 3)
            .withColumn("enabled", F.col("enabled") & (F.col("id") % 5 != 2)))


def deleted_subscriptions(spark, sf_dir) -> DataFrame:
    """Subscriptions removed after the deliveries were made."""
    return valid_subscriptions(spark, sf_dir).filter(F.col("id") % 7 == 5).select("id")


def changes(spark, sf_dir) -> DataFrame:
    return changes_of(table(spark, sf_dir, "events"), catalog(spark, sf_dir))


def changes_of(e: DataFrame, catalog_df: DataFrame) -> DataFrame:
    eid = F.col("event_id")
    et = (F.when(eid % 50 == 0, "product.bulk_deleted")
          .when(F.col("event_type") == "view", "product.created")
          .when(F.col("event_type") == "click", "product.updated")
          .when(F.col("event_type") == "purchase", "product.deleted")
          .when(F.col("event_type") == "signup", "import.completed")
          .otherwise("import.failed"))
    cat = catalog_df.select(
        F.col("id").alias("p_id"), F.col("sku").alias("p_sku"), F.col("name").alias("p_name"),
        F.col("description").alias("p_description"), F.col("active").alias("p_active"),
        F.col("created_at").alias("p_created_at"), F.col("updated_at").alias("p_updated_at"))
    ev = e.select(eid, et.alias("event_type"), "user_id", "ts", "value",
                  (F.col("user_id") * 2 + 1).alias("pid"))
    ev = ev.join(cat, (ev.pid == cat.p_id) & F.col("event_type").startswith("product.")
                 & (F.col("event_type") != "product.bulk_deleted"), "left")
    return ev.select("event_id", "event_type", "ts", "value", "p_id", "p_sku", "p_name", "p_description",
                     "p_active", "p_created_at", "p_updated_at",
                     F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"),
                     (eid % 1000).alias("count"), F.lit(1000).cast("long").alias("total"),
                     F.when(F.col("event_type") == "import.failed",
                            F.concat(F.lit("RuntimeError: event "), eid.cast("string"))).alias("error_message"))


def with_response_bodies(spark, sf_dir, changes_df: DataFrame) -> DataFrame:
    """Attach the receiver's (simulated) response body per event, before the fan-out:
    the documents join then shuffles events, not event x subscription pairs, and bodies
    are cut to what the log stores before they are copied to every receiver."""
    from feedyard.operators.events import cut_bodies
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), F.col("text").alias("doc"))
    return changes_df.join(cut_bodies(docs, "doc"), "event_id", "left")


def without_response_bodies(changes_df: DataFrame) -> DataFrame:
    """For reads of the log that use no body: no join."""
    return changes_df.withColumn("doc", F.lit(None).cast("string"))


def delivery_outcomes(changes_df: DataFrame) -> DataFrame:
    """Outcome facts that the deliveries of a change share (the HTTP call is not made here),
    before the fan-out copies them to every receiver."""
    eid = F.col("event_id")
    code = F.when(eid % 11 != 0, 200 + 100 * (eid % 4)).cast("int")
    return changes_df.withColumns({
        "response_code": code,
        "raw_body": F.when(code.isNull(), F.concat(F.lit("timed out "), F.repeat(F.lit("."), (eid % 1200).cast("int"))))
        .otherwise(F.coalesce("doc", F.lit("ok"))),
        "elapsed_s": F.col("value") / 100.0, "attempted_at": F.col("ts")})


def delivery_inputs(pairs: DataFrame) -> DataFrame:
    """Outcome facts of each performed delivery."""
    eid = F.col("event_id")
    known = ("status", "response_body", "response_time_ms", "completed_at") if "response_body" in pairs.columns else ("raw_body", "elapsed_s")
    extra = [c for c in ("payload", "n_changes") if c in pairs.columns]
    return pairs.select(
        *extra, (eid * 100000 + F.col("webhook_id")).alias("id"), "webhook_id", "event_type", "event_id",
        "response_code", *known, "attempted_at",
        F.when((eid + F.col("webhook_id")) % 13 == 0, eid % 6).otherwise(F.lit(0)).alias("internal_failures"))


def lineitem_as_part(spark, sf_dir) -> DataFrame:
    """A larger feed source (one feed row per lineitem row) for throughput runs."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("p_partkey"),
                     F.concat_ws(" ", F.col("l_returnflag"), F.col("l_linestatus"),
                                 F.col("l_partkey").cast("string")).alias("p_name"),
                     F.concat(F.lit("TYPE "), F.col("l_suppkey").cast("string")).alias("p_type"),
                     F.col("l_linenumber").alias("p_size"))


def large_feed_dir(spark: SparkSession, sf_dir: str) -> str:
    tag = _render_tag("lineitem:" + sf_dir, lineitem_as_part, feed_fields, feed_lines, _quote, write_lines)
    out = scratch_path(spark, "feeds-large", tag)
    if not path_exists(spark, out + "/_SUCCESS"):
        write_lines(feed_lines(lineitem_as_part(spark, sf_dir)), out)
    return out


def progress_hash(spark, sf_dir) -> DataFrame:
    """Stored progress fields as text: half JSON-encoded, half written with str()."""
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    st = _progress_status()
    return e.select(
        eid.alias("event_id"),
        F.when(eid % 10 == 4, F.lit("null")).when(eid % 2 == 0, F.concat(F.lit('"'), st, F.lit('"'))).otherwise(st).alias("status_raw"),
        (eid % 1000).cast("string").alias("rows_raw"),
        F.when(eid % 3 == 0, F.lit('"2024-01-01T00:00:00+00:00"'))
        .otherwise(F.concat(eid.cast("string"), F.lit(".5"))).alias("updated_raw"),
        F.col("props"))


def _event_type_at(i) -> Column:
    E = F.array(*[F.lit(t) for t in EVENT_TYPES])
    return F.element_at(E, (i % 6 + 1).cast("int"))


def subscription_create_requests(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    url = (F.when(k % 5 == 0, F.concat(F.lit("ftp://c.example/"), k.cast("string")))
           .when(k % 5 == 1, F.concat(F.lit(" https://c.example/"), k.cast("string"), F.lit(" ")))
           .otherwise(F.concat(F.lit("https://c.example/"), k.cast("string"))))
    n = F.col("c_nationkey")
    events = (F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array(_event_type_at(n)))
              .otherwise(F.array(_event_type_at(n), _event_type_at(n + 1))))
    return c.select(k.alias("req_id"), url.alias("url"), events.alias("events"), (k % 3 != 0).alias("enabled"))


def subscription_patch_requests(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    url = (F.when(k % 4 == 0, F.concat(F.lit("https://p.example/"), k.cast("string")))
           .when(k % 4 == 1, F.lit("gopher://x")))
    events = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 5 == 1, F.array(_event_type_at(k)))
    enabled = F.when(k % 3 == 0, F.lit(False)).when(k % 3 == 1, F.lit(True))
    return c.select(k.alias("req_id"), (k % 200).alias("id"), url.alias("url"), events.alias("events"),
                    enabled.alias("enabled"))


def subscription_delete_requests(spark, sf_dir) -> DataFrame:
    """Ids to delete: repeated, and some that no subscription has."""
    c = table(spark, sf_dir, "customer")
    return c.filter(F.col("c_custkey") % 3 == 0).select((F.col("c_custkey") % 201).alias("id"))


def progress_readers(spark, sf_dir) -> DataFrame:
    """Readers attached to a job's progress channel: one per order, on job o_custkey,
    attaching during January 2024."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("reader_id"), F.col("o_custkey").cast("string").alias("job_id"),
                    F.timestamp_seconds(F.lit(CATALOG_EPOCH) + (F.col("o_orderkey") % 720) * 3600)
                    .cast("timestamp_ntz").alias("attached_at"))
