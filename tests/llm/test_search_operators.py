"""Hard negatives, spelling variants and one-bit nearest neighbours against brute force."""
import math
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from feedyard.llm import onebit, residue_mining, spelling  # noqa: E402
from feedyard.llm.common import prep  # noqa: E402

NAN, INF = float("nan"), float("inf")


def vectors(spark, rows, label="int"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {label}, rid string, x string, asks int, n int, score string")


def made(n, dim, seed, balls=0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        x = rng.normal(size=dim)
        if balls and i % 3 == 0:  # a third of the rows lie about one vector
            x = np.ones(dim) + 0.05 * rng.normal(size=dim)
        x = x / np.linalg.norm(x)
        out.append((i, x.tolist(), int(rng.integers(4))))
    return out


def clashing(rows):
    return [(*r, "rid", "x", 1, 2, "s") for r in rows]


ODD = [(None, [1.0, 2.0, 3.0], 1), (700, None, 1), (800, [1.0, None, 2.0], 1), (900, [NAN, 0.0, 1.0], 1), (1000, [INF, 0.0, 1.0], 1), (1100, [0.0, 0.0, 0.0], 1), (1200, [], 1),
       (1300, [0.5, 0.5, 0.5], None), (1400, [0.25, 0.5], 1), (1500, [0.5, 0.25], 1), (1, [0.5, 0.25], 2), (100, [0.5, -0.5, 0.1], 1), (100, [0.5, 0.5, 0.1], 2), (100, [0.5, -0.5, 0.1], 1)]


def works(x):
    return x is not None and all(v is not None and math.isfinite(v) for v in x)


# ---------------------------------------------------------------- residue arithmetic

@pytest.mark.parametrize("top, dim", [(1, 1), (300, 64), (40_000, 64), (5_000_000, 700), (40_000_000, 3000)])
def test_residue_products_are_exact(top, dim):
    rng = np.random.default_rng(dim)
    a, b = rng.integers(-top, top + 1, (7, dim)), rng.integers(-top, top + 1, (9, dim))
    a[0], b[0] = top, -top
    primes = residue_mining.primes_for(float(dim) * top * top * 1.001)
    got = residue_mining.scores(residue_mining.residues(a, primes), residue_mining.residues(b, primes), primes)
    want = [[sum(int(x) * int(y) for x, y in zip(r, c, strict=True)) for c in b] for r in a]
    assert got.tolist() == want


def test_ranked_both_ways():
    rng = np.random.default_rng(2)
    for scale in (1, 1 << 51):
        s = rng.integers(-4, 5, (6, 40)) * scale
        s[:, ::7] = residue_mining.NONE
        sc, at = residue_mining.ranked(s)
        for r in range(6):
            want = sorted((c for c in range(40) if c % 7), key=lambda c: (-s[r, c], c))  # noqa: B023
            assert at[r, :len(want)].tolist() == want and sc[r, :len(want)].tolist() == s[r, want].tolist()
            assert (sc[r, len(want):] == residue_mining.NONE).all()


def mined(rows, every, scale=256, positives=5, negatives=10, low=30, high=90):
    good = [(i, [math.floor(scale * v) for v in x], lab) for i, x, lab in rows if i is not None and lab is not None and works(x)]
    out = []
    for a, (i, x, lab) in enumerate(good):
        if i % every:
            continue
        sc = [(-sum(p * q for p, q in zip(x, y, strict=True)), j, other) for b, (j, y, other) in enumerate(good) if b != a and len(y) == len(x)]
        for ps, j, _ in sorted((s for s in sc if s[2] == lab), key=lambda s: s[:2])[:positives]:
            fit = sorted((s[0], s[1]) for s in sc if s[2] != lab and low * -ps <= 100 * -s[0] <= high * -ps)[:negatives]
            out += [(i, j, r, k, -ps, -ns) for r, (ns, k) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("n, dim, every, blocks", [(400, 8, 20, True), (300, 3, 10, False)])
def test_mining(spark, monkeypatch, n, dim, every, blocks):
    if blocks:  # many blocks of anchors and rows, and several steps within each
        for name, v in (("ANCHORS", 8), ("LEAST_ROWS", 32), ("STEP_ANCHORS", 3), ("STEP_ROWS", 16), ("MOST_ROWS", 64)):
            monkeypatch.setattr(residue_mining, name, v)
    rows = made(n, dim, 5, balls=1) + (ODD if dim == 3 else [])
    random.Random(3).shuffle(rows)
    got = residue_mining.mine(vectors(spark, clashing(rows)), anchor=F.col("vec_id") % every == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect()) == mined(rows, every)


def test_mining_edges(spark):
    assert residue_mining.mine(vectors(spark, [])).count() == 0
    assert residue_mining.mine(vectors(spark, clashing([(100, [1.0], 1)]))).count() == 0
    same = clashing([(i, [1.0, 0.0], i // 100 % 2) for i in range(0, 4000, 100)])  # ties only: negatives score as the positives
    assert residue_mining.mine(vectors(spark, same)).count() == 0
    got = residue_mining.mine(vectors(spark, same), high=100).collect()
    assert len(got) == 40 * 5 * 10 and all(r.negative_id == [i for i in range(0, 4000, 100) if i % 200 != r.anchor_id % 200][r["rank"] - 1] for r in got)
    with pytest.raises(ValueError, match="norm"):
        residue_mining.mine(vectors(spark, clashing([(100, [1e200], 1), (200, [1.0], 1)])))


# ---------------------------------------------------------------- spelling

def slipped(rows, least, slip):
    import re
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if slip and h % slip == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += len(w) >= least
    return n


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(n, factor=10):
    near = defaultdict(list)
    for a in n:
        for b in n:
            if is_near(a, b):
                near[a].append(b)
    form = {}
    for a in n:
        best = min(near[a], key=lambda b: (-n[b], b), default=None)
        if best is not None and n[best] >= factor * n[a]:
            form[a] = best
    out = {}
    for a in n:
        root = a
        while root in form:
            root = form[root]
        out[a] = (form.get(a), root, n[a], len(near[a]), n[form[a]] if a in form else None)
    return out


def texts(seed):
    rng = random.Random(seed)
    base = ["verbinden", "Verbindung", "straßenbahn", "señalado", "ÜBERMUT", "aaaaaaaa", "aaaaaaaaa", "abababab", "connection", "connections", "letters", "lettters", "settersx"]
    rows = []
    for d in range(300):
        words = []
        for _ in range(60):
            w = list(rng.choice(base) if rng.random() < 0.9 else base[0])
            while rng.random() < 0.25:
                i = rng.randrange(len(w) + 1)
                how = rng.randrange(3)
                w[i:i + (how > 0)] = [] if how == 1 else [rng.choice("abeünß")]
            words.append("".join(w))
        rows.append((d if d % 50 else None, " ".join(words)))
    return [*rows, (1, None), (2, ""), (3, "short word"), (4, "x" * 5000 + " " + "x" * 4999 + " " + "x" * 5000 + "-" + "x" * 4999), (5, "ÀÀÀÀÀÀÀ ÀÀÀÀÀÀà ÀÀÀÀÀÀÀ ÀÀÀÀÀÀà"), rows[7], rows[7]]


@pytest.mark.parametrize("shard, state", [(8192, 1 << 20), (40, 64)])
def test_variants(spark, monkeypatch, shard, state):
    monkeypatch.setattr(spelling, "SHARD", shard)  # the small one cuts halves into parts and blocks
    monkeypatch.setattr(spelling, "STATE_BYTES", state)
    rows = texts(4)
    docs = spark.createDataFrame([(d, t, "w", 5) for d, t in rows], "doc_id long, text string, word string, n int")
    want = grouped({w: c for w, c in slipped(rows, 7, 31).items() if c > 1})
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs).collect()}
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 50 and any(v[1] != v[0] for v in want.values() if v[0]) and len(want) > 200


def test_variants_follow_chains(spark):
    words = [("abcdefgh", 4000), ("abcdefgx", 400), ("abcdefyx", 40), ("abcdezyx", 4)]
    docs = spark.createDataFrame([(1, " ".join([w] * n)) for w, n in words], "doc_id long, text string")
    got = {r.word: (r.form, r.root, r.n_near) for r in spelling.variants(docs, slip=0).collect()}
    assert got == {"abcdefgh": (None, "abcdefgh", 1), "abcdefgx": ("abcdefgh", "abcdefgh", 2), "abcdefyx": ("abcdefgx", "abcdefgh", 2), "abcdezyx": ("abcdefyx", "abcdefgh", 1)}


def test_variants_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(empty).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("least", [1, 2, 3])
def test_short_words(spark, least):
    rng = random.Random(least)
    rows = [(i, " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(200))) for i in range(5)]
    n = {w: c for w, c in slipped(rows, least, 0).items() if c > 1}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs, least=least, slip=0).collect()}
    assert got == grouped(n)


# ---------------------------------------------------------------- nearest neighbours

def near(rows, every, k):
    good = [(i, np.array(x, float)) for i, x, _ in rows if i is not None and works(x) and any(x)]
    out = []
    for a, (i, x) in enumerate(good):
        if i % every == 0:
            s = sorted((-float(x @ y), j) for b, (j, y) in enumerate(good) if b != a and len(y) == len(x))[:k]
            out += [(i, r, j, -v) for r, (v, j) in enumerate(s, 1)]
    return sorted(out, key=lambda r: (r[0], r[1], r[2]))


def found(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()), key=lambda r: (r[0], r[1], r[2]))


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(4000, 64)) * rng.uniform(0.1, 5, (4000, 1)), rng.normal(size=(50, 64))
    turn = onebit.rotation(64)
    assert np.allclose(turn.T @ turn, np.eye(64))
    centre = np.full(64, 0.2)
    code, a, length = onebit.encode(x, centre, turn)
    code = code.view(np.uint64)
    bits, low, step, total, lost = onebit.planes(q, turn)
    pop = np.bitwise_count(code).sum(1)
    dot = 2 * (low[:, None] * pop + step[:, None] * onebit.counts(code, bits)) - total[:, None]
    estimate = q @ centre[:, None] + length * dot / (np.sqrt(len(turn)) * a)
    true = q @ x.T
    off = (estimate - true) / (length * np.linalg.norm(q, axis=1)[:, None])
    assert abs(off.mean()) < 0.001 and 0.02 < off.std() < 0.07
    bound = length * (np.linalg.norm(q, axis=1)[:, None] * np.sqrt(1 - a * a) / a / np.sqrt(len(turn) - 1) + lost[:, None] / (np.sqrt(len(turn)) * a))
    assert 0.6 < ((estimate - true) / bound).std() < 1.1
    assert (np.abs(estimate - true) <= onebit.WIDTH * bound).mean() > 0.999


@pytest.mark.parametrize("cluster, block, queries", [(16384, 32768, 4096), (200, 90, 8)])
def test_search(spark, monkeypatch, cluster, block, queries):
    for name, v in (("CLUSTER", cluster), ("BLOCK", block), ("QUERIES", queries), ("STEP_ROWS", 64), ("STEP_QUERIES", 5)):
        monkeypatch.setattr(onebit, name, v)
    rows = made(1500, 24, 8, balls=1)
    random.Random(1).shuffle(rows)
    got = found(onebit.search(vectors(spark, clashing(rows)), k=20))
    want = near(rows, 20, 20)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    truth = {q: {r[2] for r in want if r[0] == q} for q in {r[0] for r in want}}
    hits = sum(r[2] in truth[r[0]] for r in got)
    assert hits >= 0.99 * len(want)
    by_id = {i: np.array(x) for i, x, _ in rows}
    assert all(abs(r[3] - by_id[r[0]] @ by_id[r[2]]) < 1e-12 for r in got)


def test_search_odd_rows(spark):
    rows = ODD + [(2000, [0.5, 0.5, 0.5], 1), (2000, [0.5, 0.5, 0.5], 1), (2020, [-1.0, 0.0, 0.0], 2), (7, [0.5, 0.5, 0.5], None), (3000, [0.1] * 5, 1)]
    got = found(onebit.search(vectors(spark, clashing(rows)), k=3))
    want = near(rows, 20, 3)
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want])
    assert onebit.search(vectors(spark, [])).count() == 0
    assert onebit.search(vectors(spark, clashing([(20, [1.0], 1)]))).count() == 0


def test_search_of_floats_prunes_far_clusters(spark, monkeypatch):
    """Queries ask only clusters that may hold a near row."""
    monkeypatch.setattr(onebit, "CLUSTER", 100)
    rng = np.random.default_rng(4)
    ends = np.eye(16)[:8] * 10
    rows = [(i, (ends[i % 8] + 0.1 * rng.normal(size=16)).tolist(), 0) for i in range(800)]
    df = spark.createDataFrame([r[:2] for r in rows], "vec_id long, embedding array<float>")
    asked = []
    run = onebit._further
    kept = lambda c, r: (asked.append((c, r)), run(c, r))[1]
    monkeypatch.setattr(onebit, "_further", kept)
    prep(spark)
    as_float = [(i, np.array(x, np.float32).astype(float).tolist(), 0) for i, x, _ in rows]
    got = found(onebit.search(df, k=5))
    want = near(as_float, 20, 5)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    centres, reach = asked[0]
    import pyarrow as pa
    q = pa.RecordBatch.from_arrays([pa.array([16], pa.int32()), pa.array([0]), pa.array([0]), pa.array([rows[0][1]]), pa.array([90.0]), pa.array([-1], pa.int32()), pa.array([0], pa.int32())],
                                   names=["dim", "rid", "vec_id", "x", "floor", "cluster", "part"])
    blocks = sum(b.num_rows for b in run(centres, reach)([q]))
    assert 1 <= blocks < len(reach)
