"""A catalog that publishes only the partitions a feed touches."""
import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from feedyard.operators import merge
from feedyard.session import fresh_scratch_path
from feedyard.sources.feed_loader import load_feed
from feedyard.sources.partitioned import PartitionedCatalog
from feedyard.streaming import streams as ST
from tests.conftest import write_file

SCHEMA = "id long, sku string, name string, description string, active boolean, created_at timestamp, updated_at timestamp, sku_key string"
T0 = dt.datetime(2024, 1, 1)


def run_ts():
    return F.lit("2025-01-01 00:00:00").cast("timestamp")


def base(spark, n):
    rnd = random.Random(n)
    return spark.createDataFrame([(i, f"S-{i}", "".join(rnd.choices("abcdefghij", k=200)), None, True, T0, T0, f"s-{i}") for i in range(1, n + 1)], SCHEMA)


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder.removeprefix("file:")) for f in names)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_small_feed_writes_little_and_equals_the_whole_merge(spark, tmpdir_path):
    table = base(spark, 6000)
    store = PartitionedCatalog(spark, fresh_scratch_path(spark, "pc"), partitions=100)
    store.publish(table, 0)
    assert rows(store.read()) == rows(table)
    folder = os.path.join(tmpdir_path, "f")
    os.makedirs(folder)
    write_file(folder, "a.csv", "sku,name\ns-77,changed\n")
    acc = load_feed(spark, folder, 10).acc
    parts = store.upsert(acc, run_ts(), 0, 1)
    assert len(parts) == 1
    assert size(f"{store.root}/data/v=000000001") < 0.05 * size(f"{store.root}/data/v=000000000")
    assert rows(store.read(1)) == rows(merge.upsert(table, acc, run_ts()))
    # a new key takes the id after the largest of all partitions, also of those not read
    write_file(folder, "b.csv", "sku,name\nNEW-1,n\ns-5,five\n")
    both = load_feed(spark, folder, 10).acc
    store.upsert(both, run_ts(), 1, 2)
    got = {r["sku_key"]: r for r in store.read(2).collect()}
    assert got["new-1"]["id"] == 6001 and got["s-77"]["name"] == "changed" and got["s-5"]["name"] == "five" and len(got) == 6001
    # only the touched partitions are read for the merge
    plan = store.read(1, parts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("part=") <= 4 and len(store.read(1, parts).inputFiles()) == len(parts)


def test_replay_restart_and_old_versions(spark, tmpdir_path):
    store = PartitionedCatalog(spark, fresh_scratch_path(spark, "pc"), partitions=16)
    store.publish(base(spark, 40), 0)
    folder = os.path.join(tmpdir_path, "f")
    os.makedirs(folder)
    ckpt = fresh_scratch_path(spark, "ckpt")
    write_file(folder, "a.csv", "sku,name\ns-1,first\nB-2,b\n")
    ST.import_stream(spark, folder, store, run_ts(), batch_size=10, checkpoint=ckpt)
    once = rows(store.read())
    assert store.current_version() == 1
    acc = load_feed(spark, [os.path.join(folder, "a.csv")], 10, in_order=True).acc
    store.upsert(acc, run_ts(), 0, 1)  # the micro-batch again
    assert rows(store.read()) == once and store.versions() == [0, 1]
    for k in range(3):
        path = write_file(folder, f"c{k}.csv", f"sku,name\ns-1,again {k}\nC-{k},c\n")
        os.utime(path, (2_000_000_000 + k, 2_000_000_000 + k))
        ST.import_stream(spark, folder, store, run_ts(), batch_size=10, checkpoint=ckpt)
    got = {r["sku_key"]: (r["id"], r["name"]) for r in store.read().collect()}
    assert got["s-1"] == (1, "again 2") and [got[f"c-{k}"][0] for k in range(3)] == [42, 43, 44] and len(got) == 44
    assert store.versions() == [3, 4]
    ST.import_stream(spark, folder, store, run_ts(), batch_size=10, checkpoint=ckpt)  # nothing new
    assert store.versions() == [3, 4]
    # what no kept version names is gone; the rest of version 0 is still there
    kept = {(r["v"], r["part"]) for v in (3, 4) for r in store._held(v)}
    there = {(int(v[2:]), int(p[5:])) for v in store._names(f"{store.root}/data") for p in store._names(f"{store.root}/data/{v}") if p.startswith("part=")}
    assert there == kept


def test_an_unfinished_version_is_not_read(spark):
    store = PartitionedCatalog(spark, fresh_scratch_path(spark, "pc"), partitions=4)
    with pytest.raises(FileNotFoundError):
        store.read()
    store.publish(base(spark, 8), 0)
    base(spark, 2).withColumn("part", store.part_of()).write.partitionBy("part").parquet(store._data(1))  # data without a manifest
    assert store.current_version() == 0 and store.read().count() == 8
    store.publish(base(spark, 0), 1)
    assert store.read().count() == 0
