import datetime as dt

from pyspark.sql import functions as F

from feedyard.operators import catalog as C
from feedyard.operators import edits as ED

TS = dt.datetime(2024, 1, 1)
RUN = "2025-01-01 00:00:00"
SCHEMA = ("id long, sku string, name string, description string, active boolean, "
          "created_at timestamp, updated_at timestamp, sku_key string")


def table(spark, rows):
    return spark.createDataFrame([(i, s, n, d, a, TS + dt.timedelta(seconds=c), TS, s.lower())
                                  for i, s, n, d, a, c in rows], SCHEMA)


def test_paging_25_rows(spark):
    t = table(spark, [(i, f"S{i}", f"n{i}", None, True, i) for i in range(1, 26)])
    sizes = [C.page(t, C.ProductFilter(), p, 10).count() for p in (1, 2, 3)]
    assert sizes == [10, 10, 5]
    first = [r["id"] for r in C.page(t, C.ProductFilter(), 1, 10).collect()]
    assert first == list(range(25, 15, -1))
    f = C.page_facts(t, C.ProductFilter(), 3, 10).first()
    assert (f["total"], f["total_pages"], f["has_next"], f["has_previous"], f["showing_from"], f["showing_to"]) == \
        (25, 3, False, True, 21, 25)


def test_filters(spark):
    t = table(spark, [(1, "AB_1", "Red Widget", None, True, 1), (2, "ABX1", "blue", "Economy", False, 2),
                      (3, "zz%", "x", "", True, 3)])

    def ids(**kw):
        return sorted(r["id"] for r in C.apply_filter(t, C.ProductFilter(**kw)).collect())

    assert ids(sku="b_1") == [1, 2]           # _ is a wildcard
    assert ids(sku="b\\_1") == [1]            # escaped
    assert ids(sku="%") == [1, 2, 3]
    assert ids(name="WIDGET") == [1]
    assert ids(description="") == [2, 3]      # empty text matches every non-null description
    assert ids(active=False) == [2]
    assert C.count_all(t).first()["total"] == 3


def test_lookups(spark):
    t = table(spark, [(1, "SKU-TEST", "a", None, True, 1)])
    args = spark.createDataFrame([("SKU-TEST",), ("Sku-Test",), ("absent",), (" SKU-TEST",)], "arg string")
    got = {r["arg"]: r["found"] for r in C.lookup_skus(t, args).collect()}
    assert got == {"SKU-TEST": True, "Sku-Test": True, "absent": False, " SKU-TEST": False}
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    assert {r["id"]: r["found"] for r in C.lookup_ids(t, ids).collect()} == {1: True, 2: False}


def test_create_conflicts(spark):
    t = table(spark, [(7, "EXIST", "e", None, True, 1)])
    req = spark.createDataFrame([(1, " new-1 ", "a", None, True), (2, "NEW-1", "b", None, True),
                                 (3, "exist", "c", None, True), (4, "   ", "d", None, True),
                                 (5, "new-2", "e", "x" * 1001, True)], "req_id long, sku string, name string, "
                                "description string, active boolean")
    got = {r["req_id"]: (r["outcome"], r["id"], r["sku"]) for r in ED.create(t, req, RUN).collect()}
    assert got[1] == ("created", 8, "new-1")
    assert got[2][0] == "conflict" and got[3][0] == "conflict" and got[4][0] == "invalid"
    assert got[5] == ("created", 9, "new-2")
    strict = {r["req_id"]: r["outcome"] for r in ED.create(t, req, RUN, strict_description=True).collect()}
    assert strict[5] == "invalid"


def test_patch_rules(spark):
    t = table(spark, [(1, "A-1", "a", "d", True, 1), (2, "B-2", "b", None, True, 2)])
    req = spark.createDataFrame(
        [(1, 1, "a-1", None, None, None),        # case-only change of its own sku: fine
         (2, 2, "A-1", None, None, None),        # collides with row 1
         (3, 2, None, None, None, True),         # no real change
         (4, 9, None, "x", None, None),          # not found
         (5, 2, None, "  ", None, None),         # invalid name
         (6, 1, None, None, None, False)],
        "req_id long, id long, sku string, name string, description string, active boolean")
    got = {r["req_id"]: r for r in ED.patch(t, req, RUN).collect()}
    assert got[1]["outcome"] == "patched" and got[1]["sku"] == "a-1"
    assert got[2]["outcome"] == "conflict"
    assert got[3]["outcome"] == "unchanged" and got[3]["updated_at"] == TS
    assert got[4]["outcome"] == "not_found"
    assert got[5]["outcome"] == "invalid"
    assert got[6]["outcome"] == "patched" and got[6]["active"] is False and got[6]["description"] == "d"


def test_patches_of_one_id_build_on_each_other(spark):
    t = table(spark, [(1, "A-1", "N", "d", True, 1), (2, "B-2", "b", None, True, 2), (3, "C-3", "c", None, True, 3)])
    req = spark.createDataFrame(
        [(1, 1, None, " N ", None, None),         # padded name: nothing changes
         (2, 1, " X-9 ", None, None, None),       # new key
         (3, 1, "x-9", None, None, None),         # same key again, other spelling
         (4, 2, "X-9", None, None, None),         # taken by id 1
         (5, 1, None, None, "e", None),
         (6, 2, None, "bb", None, None),
         (7, 2, None, "bb", None, False)],
        "req_id long, id long, sku string, name string, description string, active boolean")
    rep = ED.patch(t, req, RUN)
    got = {r["req_id"]: r for r in rep.collect()}
    assert [got[i]["outcome"] for i in range(1, 8)] == ["unchanged", "patched", "patched", "conflict", "patched", "patched", "patched"]
    assert (got[5]["sku"], got[5]["name"], got[5]["description"]) == ("x-9", "N", "e")
    assert got[1]["updated_at"] == TS and (got[7]["name"], got[7]["active"]) == ("bb", False)
    after = {r["id"]: r for r in ED.after_patch(t, rep).collect()}
    assert (after[1]["sku"], after[1]["sku_key"], after[1]["description"]) == ("x-9", "x-9", "e")
    assert (after[2]["sku"], after[2]["name"], after[2]["active"]) == ("B-2", "bb", False)
    assert after[3]["updated_at"] == TS and len(after) == 3


def test_created_rows_are_whole(spark):
    t = table(spark, [(7, "EXIST", "e", None, True, 1)])
    req = spark.createDataFrame([(1, " n-1 ", "  a ", "d", None), (2, None, "b", None, True), (3, None, "c", None, True)],
                                "req_id long, sku string, name string, description string, active boolean")
    after = ED.after_create(t, ED.create(t, req, RUN)).collect()
    new = [r for r in after if r["id"] == 8][0]
    assert len(after) == 2 and (new["sku"], new["name"], new["description"], new["active"], new["sku_key"]) == ("n-1", "a", "d", True, "n-1")
    assert new["created_at"] == new["updated_at"]


def test_delete_and_bulk_delete(spark):
    t = table(spark, [(1, "A", "a", None, True, 1), (2, "B", "b", None, True, 2)])
    report, rest = ED.delete(t, spark.createDataFrame([(2,), (3,)], "id long"))
    assert {r["id"]: r["outcome"] for r in report.collect()} == {2: "deleted", 3: "not_found"}
    assert [r["id"] for r in rest.collect()] == [1]
    jobs = spark.createDataFrame([("j", "bulk_delete", 2), ("first", "bulk_delete", 1), ("i", "import", 0)], "job_id string, job_type string, created_at long")
    for total, batches in ((0, 0), (10000, 1), (10001, 2)):
        recs = ED.bulk_delete_progress(jobs, spark.range(total)).orderBy("job_id", "seq").collect()
        stages = [r["stage"] for r in recs if r["job_id"] == "first"]
        assert [r["stage"] for r in recs if r["job_id"] == "j"] == ["counting", "completed"]   # the table is empty by then
        if total == 0:
            assert stages == ["counting", "completed"]
        else:
            assert stages == ["counting"] + [f"batch_{i}" for i in range(batches + 1)] + ["completed"]
            last = [r for r in recs if r["job_id"] == "first"][-2]
            assert last["processed_rows"] == total and last["progress"] == 100.0
    done = ED.bulk_delete_progress(jobs, t)
    assert ED.after_bulk_delete(t, done).count() == 0
    assert ED.after_bulk_delete(t, done.filter("status <> 'done'")).count() == 2
    guard = ED.job_type_guard(spark.createDataFrame([("j1", "import"), ("j2", "bulk_delete")],
                                                    "job_id string, job_type string")).collect()
    assert guard[0]["error"] == "Job j1 is not a bulk_delete job (type: import)" and guard[1]["runs"]


def test_patches_of_a_hot_id_in_blocks(spark):
    import random
    rnd = random.Random(4)
    t = table(spark, [(i, f"S-{i}", "n", None, True, i) for i in range(1, 6)])
    pick = lambda *v: rnd.choice(v)
    rows = [(r, 1 if rnd.random() < 0.5 else rnd.randint(1, 6), pick(None, None, None, "S-1", "s-2", f"new-{rnd.randint(1, 9)}"),
             pick(None, None, "n", "m", " "), pick(None, None, "d"), pick(None, None, None, True, False)) for r in range(1, 400)]
    req = spark.createDataFrame(rows, "req_id long, id long, sku string, name string, description string, active boolean")
    whole = sorted(map(str, ED.patch(t, req, RUN).collect()))
    for block in (5, 64):
        assert sorted(map(str, ED.patch(t, req, RUN, block=block).collect())) == whole


def test_last_given_against_brute_force(spark):
    import random

    from feedyard.operators import carry
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.4 else f"k{rnd.randint(1, 30)}", o, rnd.choice([None, None, f"v{o}"])) for o in rnd.sample(range(5000), 600)]
    want, now = {}, {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        was = now.get(k)
        now[k] = was if v is None else v
        want[o] = (was, now[k])
    df = carry.in_blocks(spark.createDataFrame(rows, "k string, o long, v string"), "k", "o", block=50)
    assert df.filter("_blk >= 0").select("k").distinct().count() == 1
    got = {r["o"]: (r["was_v"], r["now_v"]) for r in carry.last_given(df, "k", "o", {"v": F.col("v")}).collect()}
    assert got == want


def test_deep_pages_sort_one_range(spark):
    import random
    rnd = random.Random(6)
    # a third of all rows of one import share one time
    rows = [(i, 1_700_000_000 if rnd.random() < 0.33 else rnd.randint(1_600_000_000, 1_800_000_000)) for i in range(3000)]
    t = spark.createDataFrame(rows, "id long, s long").select("id", F.timestamp_seconds("s").alias("created_at")).repartition(7)
    order = [i for i, s in sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)]
    for page in (4, 30, 61, 75, 110, 150, 151):
        got = [r["id"] for r in C.page(t, C.ProductFilter(), page, 20, deep_rows=50).collect()]
        assert got == order[(page - 1) * 20:page * 20], page
        found, offset = C.seek(t, (page - 1) * 20, 20, most=50)
        assert offset < 50 and found.count() <= 50 + 20 + 50
