"""Upsert cases; random feeds are in test_random_feeds.py."""
import datetime as dt

from pyspark.sql import functions as F

from feedyard.operators import merge

TS0 = dt.datetime(2024, 1, 1)
RUN = dt.datetime(2025, 1, 1)
TABLE_SCHEMA = ("id long, sku string, name string, description string, active boolean, "
                "created_at timestamp, updated_at timestamp, sku_key string")
ACC_SCHEMA = "file_rank int, batch long, ord long, sku string, name string, description string, active boolean"


def table(spark, rows):
    data = [(i, s, n, d, a, TS0, TS0, s.lower()) for i, s, n, d, a in rows]
    return spark.createDataFrame(data, TABLE_SCHEMA)


def acc(spark, rows):
    df = spark.createDataFrame(rows, ACC_SCHEMA)
    return df.withColumn("sku_key", F.lower("sku"))


def upsert(spark, t, a):
    return {r["sku_key"]: r for r in merge.upsert(t, a, F.lit(RUN).cast("timestamp")).collect()}


def test_insert_update_mixed(spark):
    t = table(spark, [(1, "SKU-1", "old", None, True)])
    a = acc(spark, [(1, 1, 1, "SKU-1", "new", "d", False), (1, 1, 2, "SKU-2", "two", None, True),
                    (1, 1, 3, "SKU-3", "three", None, True)])
    out = upsert(spark, t, a)
    assert len(out) == 3
    assert out["sku-1"]["name"] == "new" and out["sku-1"]["id"] == 1 and out["sku-1"]["created_at"] == TS0
    assert out["sku-1"]["updated_at"] == TS0          # bulk upsert does not move updated_at
    assert out["sku-2"]["id"] == 2 and out["sku-3"]["id"] == 3 and out["sku-2"]["created_at"] == RUN


def test_case_insensitive_keeps_stored_spelling(spark):
    t = table(spark, [(5, "sku-001", "a", None, True)])
    out = upsert(spark, t, acc(spark, [(1, 1, 1, "SKU-001", "b", None, True)]))
    assert len(out) == 1 and out["sku-001"]["sku"] == "sku-001" and out["sku-001"]["name"] == "b"


def test_empty_batch_and_null_description(spark):
    t = table(spark, [(1, "A", "a", "keep", True)])
    empty = spark.createDataFrame([], ACC_SCHEMA).withColumn("sku_key", F.lower("sku"))
    out = upsert(spark, t, empty)
    assert list(out) == ["a"] and out["a"]["description"] == "keep"
    out = upsert(spark, t, acc(spark, [(1, 1, 1, "a", "a2", None, True)]))
    assert out["a"]["description"] is None             # a NULL description overwrites


def test_duplicates_in_batch_and_spelling_across_batches(spark):
    a = acc(spark, [(1, 1, 1, "k-1", "first", None, True), (1, 1, 2, "K-1", "second", None, True),
                    (1, 2, 3, "k-1", "third", "d", False)])
    out = upsert(spark, table(spark, []), a)
    r = out["k-1"]
    assert r["sku"] == "K-1" and r["name"] == "third" and r["active"] is False and r["id"] == 1


def test_thousand_rows(spark):
    a = acc(spark, [(1, 1 + i // 100, i + 1, f"S-{i}", f"n{i}", None, True) for i in range(1000)])
    out = upsert(spark, table(spark, []), a)
    assert len(out) == 1000 and sorted(r["id"] for r in out.values()) == list(range(1, 1001))


def test_rows_affected(spark):
    t = table(spark, [(1, "A", "a", None, True)])
    a = acc(spark, [(1, 1, 1, "a", "x", None, True), (1, 1, 2, "b", "x", None, True), (1, 1, 3, "B", "y", None, True),
                    (1, 2, 4, "b", "z", None, True)])
    got = {r["batch"]: (r["rows_affected"], r["inserted"], r["updated"])
           for r in merge.batch_rows_affected(a, t).collect()}
    assert got == {1: (2, 1, 1), 2: (1, 0, 1)}
