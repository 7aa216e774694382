"""Feed reading and validation cases (modelled on the reproduced service's tests)."""
import os

from pyspark.sql import functions as F

from feedyard.operators import validate as V
from feedyard.sources import feed as FD
from feedyard.sources.feed_loader import load_feed
from tests.conftest import write_file


def verdict_of(spark, folder):
    feed = load_feed(spark, folder)
    v = V.verdict(feed.facts, feed.rows).first()
    errs = [r["message"] for r in V.validation_errors(feed.facts, feed.rows).orderBy("line", "seq").collect()]
    return v, errs, feed


def test_valid_file(spark, tmpdir_path):
    write_file(tmpdir_path, "ok.csv", "sku,name,description\nA-1,Product 1,Desc\nA-2,Product 2,x\nA-3,Product 3,\n")
    v, errs, _ = verdict_of(spark, tmpdir_path)
    assert v["is_valid"] and v["total_rows"] == 3 and v["sample_size"] == 3 and errs == []


def test_flag_values(spark, tmpdir_path):
    write_file(tmpdir_path, "f.csv", "sku,name,active\nA,a,true\nB,b,false\nC,c,yes\nD,d,1\n")
    v, errs, _ = verdict_of(spark, tmpdir_path)
    assert v["is_valid"] and v["total_rows"] == 4


def test_wrong_extension(spark, tmpdir_path):
    write_file(tmpdir_path, "data.txt", "sku,name\nA,a\n")
    v, errs, _ = verdict_of(spark, tmpdir_path)
    assert not v["is_valid"] and errs == ["Invalid file extension: .txt. Expected .csv"]


def test_missing_file(spark, tmpdir_path):
    gone = FD.missing_paths(spark, [os.path.join(tmpdir_path, "absent.csv"), os.path.join(tmpdir_path, "x.txt")])
    msgs = sorted(r["message"] for r in V.missing_file_errors(gone).collect())
    assert msgs[0] == "File not found: " + os.path.join(tmpdir_path, "absent.csv")
    assert msgs[1] == "Invalid file extension: .txt. Expected .csv"


def test_missing_required_header(spark, tmpdir_path):
    write_file(tmpdir_path, "h.csv", "sku,description\nA,x\n")
    v, errs, _ = verdict_of(spark, tmpdir_path)
    assert not v["is_valid"]
    assert errs == ["Missing required headers: name. Found: description, sku"]


def test_empty_file(spark, tmpdir_path):
    write_file(tmpdir_path, "e.csv", "")
    v, errs, _ = verdict_of(spark, tmpdir_path)
    assert not v["is_valid"] and errs == ["CSV file is empty or has no headers"]


def test_empty_fields(spark, tmpdir_path):
    write_file(tmpdir_path, "e.csv", "sku,name\n,Product 1\nSKU-002,\n")
    v, errs, _ = verdict_of(spark, tmpdir_path)
    assert not v["is_valid"]
    assert errs == ["Row 1, field 'sku': String should have at least 1 character",
                    "Row 2, field 'name': String should have at least 1 character"]


def test_unknown_headers_warn(spark, tmpdir_path):
    write_file(tmpdir_path, "u.csv", "sku,name,zeta,price\nA,a,1,2\n")
    v, errs, _ = verdict_of(spark, tmpdir_path)
    assert v["is_valid"] and errs == ["Warning: Unknown headers will be ignored: price, zeta"]


def test_sample_cut(spark, tmpdir_path):
    write_file(tmpdir_path, "s.csv", "sku,name\n" + "".join(f"S{i},n{i}\n" for i in range(200)))
    v, _, _ = verdict_of(spark, tmpdir_path)
    assert v["total_rows"] == 200 and v["sample_size"] == 100


def test_whitespace_is_fine(spark, tmpdir_path):
    write_file(tmpdir_path, "w.csv", "sku,name\n  SKU-1  ,  Name 1  \n")
    v, errs, _ = verdict_of(spark, tmpdir_path)
    assert v["is_valid"] and errs == []


def test_bad_bytes(spark, tmpdir_path):
    write_file(tmpdir_path, "b.csv", b"sku,name\n\xff\xfe\xfd,x\n")
    v, errs, _ = verdict_of(spark, tmpdir_path)
    assert not v["is_valid"] and errs == [V.ENCODING_ERROR]


def test_error_cap(spark, tmpdir_path):
    write_file(tmpdir_path, "c.csv", "sku,name\n" + ",n\n" * 20)
    v, errs, _ = verdict_of(spark, tmpdir_path)
    assert not v["is_valid"] and len(errs) == 11
    assert errs[-1].startswith("Validation stopped after 10 errors")
    assert v["sample_size"] == 10


def test_long_sku_and_blank_only(spark, tmpdir_path):
    write_file(tmpdir_path, "l.csv", "sku,name\n" + "S" * 300 + ",n\n   ,   \n")
    v, errs, _ = verdict_of(spark, tmpdir_path)
    assert errs == ["Row 1, field 'sku': String should have at most 255 characters",
                    "Row 2, field 'sku': String should have at least 1 character",
                    "Row 2, field 'name': String should have at least 1 character"]


def test_bad_flag_is_unexpected_error_only(spark, tmpdir_path):
    write_file(tmpdir_path, "a.csv", "sku,name,active\n,x,maybe\nA,a\n")
    _, errs, _ = verdict_of(spark, tmpdir_path)
    assert errs == ["Row 1: Unexpected error - Cannot parse 'maybe' as boolean",
                    "Row 2: Unexpected error - Cannot parse 'None' as boolean"]


def test_ragged_rows_and_quotes(spark, tmpdir_path):
    text = ('sku,name,description,active\n'
            'A,"multi\nline, ""quoted""",d,true\n'   # quoted newline and doubled quotes
            'B,b,desc\n'                               # 3 fields: active missing -> TRUE
            'C,c\n'                                    # 2 fields: description missing -> rejected
            ',x,y,n\n'                                 # first field empty -> skipped
            'D,d,e,no,extra\n')                        # long row: extras ignored
    write_file(tmpdir_path, "r.csv", text)
    feed = load_feed(spark, tmpdir_path)
    rows = {r["ord"]: r for r in feed.rows.collect()}
    assert rows[1]["outcome"] == "accepted" and rows[1]["name"] == 'multi\nline, "quoted"'
    assert rows[2]["outcome"] == "accepted" and rows[2]["active"] is True
    assert rows[3]["outcome"] == "rejected" and rows[3]["reason"] == "description_missing"
    assert rows[4]["outcome"] == "skipped"
    assert rows[5]["outcome"] == "accepted" and rows[5]["active"] is False
    assert feed.facts.first()["multiline"] is True


def test_header_is_case_sensitive_and_bom(spark, tmpdir_path):
    write_file(tmpdir_path, "a.csv", "﻿sku,Name\nA,a\n")
    feed = load_feed(spark, tmpdir_path)
    assert [r["outcome"] for r in feed.rows.collect()] == ["skipped"]   # 'Name' is not 'name'
    v, errs, _ = verdict_of(spark, tmpdir_path)
    assert errs == ["Missing required headers: name. Found: Name, sku"]


def test_ordinals_across_blocks(spark, tmpdir_path):
    n = 20000
    write_file(tmpdir_path, "big.csv", "sku,name\n" + "".join(f"K{i},n{i}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        feed = load_feed(spark, tmpdir_path, batch_size=7)
        got = feed.acc.select("ord", "sku", "batch").collect()
        blocks = feed.rows.select("path", F.col("ord")).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert blocks == n
    assert all(r["sku"] == f"K{r['ord'] - 1}" for r in got)
    assert all(r["batch"] == (r["ord"] + 6) // 7 for r in got)
    assert sorted(r["ord"] for r in got) == list(range(1, n + 1))


def test_small_import_one_batch(spark, tmpdir_path):
    from feedyard.operators import clean
    write_file(tmpdir_path, "s.csv", "sku,name,active\n" + "".join(
        f"SKU-{i},Product {i},{'true' if i % 2 else 'false'}\n" for i in range(25)))
    feed = load_feed(spark, tmpdir_path)
    s = clean.outcome_summary(feed.rows).first()
    assert s["processed_rows"] == 25 and s["total_rows"] == 25
    assert {r["batch"] for r in feed.acc.select("batch").collect()} == {1}


def test_twelve_thousand_rows_two_batches(spark, tmpdir_path):
    from feedyard.operators import progress as PG
    write_file(tmpdir_path, "b.csv", "sku,name\n" + "".join(f"S{i},n{i}\n" for i in range(12000)))
    feed = load_feed(spark, tmpdir_path)
    sizes = {r["batch"]: r["count"] for r in feed.acc.groupBy("batch").count().collect()}
    assert sizes == {1: 10000, 2: 2000}
    stages = [r["stage"] for r in PG.batch_progress(feed.acc, feed.rows, 10000).orderBy("seq").collect()]
    assert stages == ["starting", "batch_0", "batch_1", "batch_2_final", "completed"]


def test_blank_and_whitespace_only_lines_are_skipped(spark, tmpdir_path):
    # documented deviation: Spark's CSV reader skips whitespace-only lines as well as
    # empty ones (the reproduced service counts a whitespace-only line as a row)
    write_file(tmpdir_path, "w.csv", "sku,name\nA,a\n   \n\nB,b\n")
    feed = load_feed(spark, tmpdir_path)
    got = sorted((r["ord"], r["outcome"], r["sku"]) for r in feed.rows.collect())
    assert got == [(1, "accepted", "A"), (2, "accepted", "B")]


def test_wide_header(spark, tmpdir_path):
    extra = [f"x{i}" for i in range(70)]
    head = ",".join(extra[:30] + ["sku"] + extra[30:] + ["name"])
    row = ",".join(["v"] * 30 + ["K-1"] + ["v"] * 40 + ["Wide"])
    write_file(tmpdir_path, "wide.csv", head + "\n" + row + "\n")
    write_file(tmpdir_path, "narrow.csv", "sku,name\nK-2,Narrow\n")
    feed = load_feed(spark, tmpdir_path)
    got = sorted((r["sku"], r["name"]) for r in feed.acc.collect())
    assert got == [("K-1", "Wide"), ("K-2", "Narrow")]


def test_quoted_header_with_comma_and_quotes(spark, tmpdir_path):
    write_file(tmpdir_path, "q.csv", '"x,y",sku,"na""me",name\n1,A-1,z,Name\n')
    feed = load_feed(spark, tmpdir_path)
    assert feed.facts.first()["names"] == ["x,y", "sku", 'na"me', "name"]
    assert [(r["sku"], r["name"]) for r in feed.acc.collect()] == [("A-1", "Name")]


def test_every_gate(spark, tmpdir_path):
    """Extension, size (only when asked), bytes, header: the first that fails is reported."""
    write_file(tmpdir_path, "a.txt", "sku,name\nA,a\n")
    write_file(tmpdir_path, "b.CSV", "sku,name\nA,a\n")
    write_file(tmpdir_path, "c.csv", b"sku,name\nA,\xff\xfe\n")
    write_file(tmpdir_path, "d.csv", "")
    write_file(tmpdir_path, "e.csv", "sku,price\nA,1\n")
    write_file(tmpdir_path, "f.csv", "sku,name\n" + "A,a\n" * 40_000)
    feed = load_feed(spark, tmpdir_path)
    name = lambda r: os.path.basename(r["path"])
    free = {name(r): r["gate_error"] for r in V.file_gates(feed.facts).collect()}
    assert free == {"a.txt": "Invalid file extension: .txt. Expected .csv", "b.CSV": None, "c.csv": V.ENCODING_ERROR,
                    "d.csv": "CSV file is empty or has no headers", "e.csv": "Missing required headers: name. Found: price, sku", "f.csv": None}
    small = {name(r): r["gate_error"] for r in V.file_gates(feed.facts, max_mb=0.1).collect()}
    assert small["f.csv"] == "File size (0.15 MB) exceeds maximum allowed size (0.1 MB)" and small["b.CSV"] is None
    ok = {r["file_rank"]: r["is_valid"] for r in V.verdict(feed.facts, feed.rows).collect()}
    assert sum(ok.values()) == 2


def test_whole_feed_in_blocks(spark, tmpdir_path):
    # every third row has an error, every ninth an unreadable flag, every fifteenth two errors
    lines, want = [], []
    for i in range(1, 401):
        sku, name, flag = ("" if i % 3 == 0 else f"K{i}"), ("" if i % 15 == 0 else "n"), ("maybe" if i % 9 == 0 else "true")
        lines.append(f"{sku},{name},x,{flag}")
        if i % 9 == 0:
            want.append((i, 1, f"Row {i}: Unexpected error - Cannot parse 'maybe' as boolean"))
        else:
            bad = [f for f, v in (("sku", sku), ("name", name)) if not v]
            want += [(i, k + 1, f"Row {i}, field '{f}': String should have at least 1 character") for k, f in enumerate(bad)]
    write_file(tmpdir_path, "w.csv", "sku,name,description,active\n" + "\n".join(lines) + "\n")
    feed = load_feed(spark, tmpdir_path)
    for block in (7, V.MESSAGE_BLOCK):
        rows = V.sample_messages(feed.rows, None, None, block).orderBy("error_no").collect()
        assert [(r["line"], r["seq"], r["message"]) for r in rows] == want and [r["error_no"] for r in rows] == list(range(1, len(want) + 1))
        cut = V.sample_messages(feed.rows, None, 30, block).orderBy("line", "seq").collect()
        stop = next(i for i, _, m in want if "field" in m and sum(w[0] <= i for w in want) >= 30)
        assert [(r["line"], r["seq"]) for r in cut] == [w[:2] for w in want if w[0] <= stop] + [(stop, V.STOP_SEQ)]


def test_no_window_over_a_whole_file(spark, tmpdir_path):
    write_file(tmpdir_path, "p.csv", "sku,name\nA,\nB,b\n")
    feed = load_feed(spark, tmpdir_path)
    plan = V.sample_messages(feed.rows, None)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x.split("], [") for x in plan.splitlines() if "Window [" in x]
    by_row = [w for w in windows if w[-1].startswith("ord#")]
    assert by_row and all("_blk#" in w[-2] for w in by_row)
