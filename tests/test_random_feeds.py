"""Random feeds whose outcome the generator knows: it decides the fate of each row, and what
the validator must say about it, when it writes the row."""
import datetime as dt
import os
import random
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import functions as F

from feedyard import schemas as S
from feedyard.operators import merge
from feedyard.operators import validate as V
from feedyard.sources.feed_loader import load_feed
from tests.conftest import write_file

TABLE = ("id long, sku string, name string, description string, active boolean, "
         "created_at timestamp, updated_at timestamp, sku_key string")


@dataclass
class Row:
    cells: dict                     # text by column
    keep: dict | None               # what an accepted row stores, else None
    says: list = field(default_factory=list)   # (message, is a field rule) of the validator
    width: int | None = None        # columns written, all by default


def cell(v):
    return '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n') else v


def write(folder, name, header, rows):
    lines = [",".join(cell(h) for h in header)]
    for r in rows:
        lines.append(",".join([cell(r.cells[h]) for h in header][:r.width]))
    write_file(folder, name, "\n".join(lines) + "\n")


def good(rnd, key):
    pad = rnd.choice(["", " ", "\t"])
    name, text = rnd.choice(["a", "b c", "ü"]), rnd.choice(["", "x", "y, z", 'say "hi"', "two\nlines"])
    flag, on = rnd.choice([("yes", True), ("", True), (" N ", False), ("0", False), ("other", True)])
    spelling = rnd.choice([key, key.upper(), key.title()])
    return Row({"sku": pad + spelling + pad, "name": name + pad, "description": text, "active": flag, "price": "1"},
               {"sku": spelling, "name": name, "description": text or None, "active": on})


def bad(rnd, key):
    r = good(rnd, key)
    r.keep = None
    kind = rnd.choice(["no sku", "no name", "blank sku", "long name", "short row"])
    if kind == "short row":
        r.width = 2
    else:
        r.cells |= {"no sku": {"sku": ""}, "no name": {"name": ""}, "blank sku": {"sku": "   "}, "long name": {"name": "n" * 256}}[kind]
    return r


def test_random_imports(spark, tmpdir_path):
    """200 feeds with their own keys in one run: the last accepted row of a key decides its
    values, the first batch that holds it the spelling of a new row."""
    rnd, size, folder = random.Random(2024), 3, os.path.join(tmpdir_path, "many")
    os.makedirs(folder)
    base, want, order = [], {}, {}
    for f in range(200):
        keys = [f"f{f:03d}-k-{i}" for i in range(rnd.randint(2, 8))]
        base.append((f + 1, keys[0].upper(), "old", None, True))
        want[keys[0]] = {"sku": keys[0].upper(), "name": "old", "description": None, "active": True}
        held: dict = {}             # key -> [(file, batch, position, stored row)]
        for i in range(rnd.randint(1, 3)):
            rows = [(bad if rnd.random() < 0.2 else good)(rnd, rnd.choice(keys)) for _ in range(rnd.randint(0, 25))]
            header = rnd.choice([("sku", "name", "description", "active"), ("name", "sku", "description", "active"),
                                 ("sku", "name", "description", "active", "price")])
            write(folder, f"feed{f:03d}_{i}.csv", header, rows)
            for n, r in enumerate(r for r in rows if r.keep):
                held.setdefault(r.keep["sku"].lower(), []).append((i, n // size, n, r.keep))
        for key, seen in held.items():
            last = seen[-1][3]
            spelling = [s for s in seen if s[:2] == seen[0][:2]][-1][3]["sku"]
            want[key] = last | {"sku": want[key]["sku"] if key in want else spelling}
        order[f] = [k for k, s in sorted(held.items(), key=lambda x: (x[1][0][0], x[1][0][2])) if k != keys[0]]
    at = dt.datetime(2024, 1, 1)
    table = spark.createDataFrame([(*r, at, at, r[1].lower()) for r in base], TABLE)
    feed = load_feed(spark, folder, batch_size=size)
    assert feed.facts.filter("multiline").count() and feed.facts.filter("not multiline").count()
    got = {r["sku_key"]: r for r in merge.upsert(table, feed.acc, F.lit("2025-01-01").cast("timestamp")).collect()}
    assert {k: {c: r[c] for c in ("sku", "name", "description", "active")} for k, r in got.items()} == want
    for keys in order.values():
        ids = [got[k]["id"] for k in keys]
        firsts = {}
        for k in keys:
            firsts.setdefault(got[k]["id"], k)
        assert len(firsts) == len(keys) and all(i > len(base) for i in ids)


def judged(rnd, with_flag):
    """A row and what the validator says about it (its number is filled in later)."""
    r = good(rnd, "k")
    r.cells["active"] = rnd.choice(["yes", "0", "t"])
    if rnd.random() < 0.7:
        return r
    fault = rnd.choice(["flag", "sku", "name", "both", "short"])
    if fault == "flag" and with_flag:
        v = rnd.choice(["", "maybe", "2"])
        r.cells["active"] = v
        r.says = [(("flag", v), False)]
    elif fault in ("sku", "name", "both"):
        for f in ("sku", "name") if fault == "both" else (fault,):
            v, msg = rnd.choice([("", S.MSG_TOO_SHORT), (" \t ", S.MSG_TOO_SHORT), ("c" * 256, S.MSG_TOO_LONG)])
            r.cells[f] = v
            r.says.append(((f, msg), True))
    elif fault == "short":
        r.width = 1
        r.says = [(("flag", "None"), False)] if with_flag else [(("name", S.MSG_NOT_STRING), True)]
    return r


def test_random_validations(spark, tmpdir_path):
    rnd, folder = random.Random(77), os.path.join(tmpdir_path, "checked")
    os.makedirs(folder)
    want, seen = {}, {"stopped": 0, "warned": 0, "gate": 0}
    for i in range(150):
        name = f"f{i:03d}.csv"
        if i % 15 == 0:
            header = rnd.choice([("sku", "description"), ("Sku", "name"), ("price",)])
            write(folder, name, header, [Row({h: "v" for h in header}, None)])
            missing = ", ".join(h for h in ("name", "sku") if h not in header)
            want[name] = (False, [S.MSG_MISSING_HEADERS % (missing, ", ".join(sorted(header)))], 0, 0)
            seen["gate"] += 1
            continue
        header = rnd.choice([("sku", "name", "description", "active"), ("sku", "name", "active", "price"), ("sku", "name", "description")])
        rows = [judged(rnd, "active" in header) for _ in range(rnd.randint(1, 140))]
        write(folder, name, header, rows)
        sample = rows[:S.SAMPLE_SIZE]
        counts = list(accumulate(len(r.says) for r in sample))
        stops = [n for n, r in enumerate(sample) if counts[n] >= S.MAX_SAMPLE_ERRORS and any(rule for _, rule in r.says)]
        end = stops[0] + 1 if stops else len(sample)
        text = [S.MSG_UNEXPECTED % (n, v) if f == "flag" else S.MSG_FIELD % (n, f, v)
                for n, r in enumerate(sample[:end], 1) for (f, v), _ in r.says]
        text += [S.MSG_STOPPED] * bool(stops)
        warn = [S.MSG_UNKNOWN_HEADERS % "price"] * ("price" in header)
        want[name] = (not text, warn + text, len(rows), end)
        seen["stopped"] += bool(stops)
        seen["warned"] += bool(warn)
    feed = load_feed(spark, folder)
    names = {r["file_rank"]: os.path.basename(r["path"]) for r in feed.facts.select("file_rank", "path").collect()}
    got = {names[r["file_rank"]]: (r["is_valid"], r["errors"], r["total_rows"], r["sample_size"]) for r in V.verdict(feed.facts, feed.rows).collect()}
    assert got == {k: (ok, "\n".join(m), n, s) for k, (ok, m, n, s) in want.items()}
    assert all(seen.values()), seen


def test_ten_thousand_files_with_many_headers(spark, tmpdir_path):
    """Files with a hundred different headers, some with quoted newlines, are one plan: every
    row is read at its file's own positions."""
    folder, n = os.path.join(tmpdir_path, "files"), 10_000
    os.makedirs(folder)
    for i in range(n):
        extra = [f"x{j}" for j in range(i % 10)]
        cols = ["sku", "name"] if i % 20 < 10 else ["name", "sku"]
        header = extra[:i % 7] + cols + extra[i % 7:]
        values = {"sku": f"K-{i}", "name": "two\nlines" if i % 500 == 0 else f"n{i}"}
        line = ",".join(cell(values.get(h, "v")) for h in header)
        with open(os.path.join(folder, f"f{i:05d}.csv"), "w") as f:
            f.write(",".join(header) + "\n" + line + "\n")
    feed = load_feed(spark, folder, batch_size=10)
    rows = {r["sku"]: r for r in feed.acc.select("sku", "name", "ord", "batch", "file_rank").collect()}
    assert len(rows) == n and feed.facts.count() == n
    assert all(rows[f"K-{i}"]["name"] == ("two\nlines" if i % 500 == 0 else f"n{i}") for i in range(n))
    assert {(r["ord"], r["batch"]) for r in rows.values()} == {(1, 1)}
    assert all(rows[f"K-{i}"]["file_rank"] == i + 1 for i in range(n))
