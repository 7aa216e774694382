"""Near-duplicate documents by HyperMinHash registers, banding and exact verification.

1. Every document becomes its set of k-word shingles (64-bit hashes) and a sketch: the
   top 8 bits of a hash choose one of 256 buckets, and the bucket keeps its smallest
   hash as a 16-bit register, a leading-zero count and 10 mantissa bits.
2. Equal sets are one node (grouped by a 128-bit set hash).
3. Nodes are banded on the compressed registers.  A band reads a fixed pseudo-random
   choice of buckets, wide enough to meet about five filled registers at the node's
   size class (powers of sqrt 2).  A node that may reach the next class at the given
   similarity is banded in both, so that any two nodes that can link share a class.
4. The centre of a band bucket is its member that shares most buckets with others (for a
   group of edited copies that is the text they come from).  Every member is compared with
   its bucket's centre.  What links with the centre is one component; a member that does not
   is compared with all members of the centre's buckets, in blocks whose intersection sizes
   are counted as one matrix.  So every pair that shares a bucket is decided, the compared
   rows grow with the buckets' members, and pairs inside a component cost nothing.
5. A pair with a centre is first judged by the collision-corrected Jaccard estimate of its
   registers (rejected only six standard errors under the limit) and then on the full sets;
   the blocks work on the full sets.

Two sets of similarity 0.8 miss each other in all 42 bands with probability of about 1e-5
or less.  Nothing is capped.

Defined results: a null or wordless text has an empty set and links with nothing; a null
doc_id links with nothing (component null, kept); rows that repeat a doc_id are one vertex
that has the links of each of them; extra columns are ignored.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedyard.llm.common import STEP_BYTES, mix64, only, prep, row_key, shingles, stage, steps, unstage, utf8, word_hashes
from feedyard.llm.components import components

BUCKET_BITS = 8
BUCKETS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
BANDS = 42
#: Filled registers that a band should meet.
BAND_WIDTH = 5.0
#: Set bytes of one block.
BLOCK_BYTES = 2 << 20


# ---------------------------------------------------------------- sketches

def _sets(col: pa.Array, k: int) -> list[np.ndarray]:
    data, off = utf8(col)
    h, first = word_hashes(data, off)
    sh, at = shingles(h, first, k)
    return [np.unique(sh[at[i]:at[i + 1]]) for i in range(len(off) - 1)]


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, 256) registers of sorted sets: 0 for an empty bucket, else one more than the
    leading zeros of the bucket's smallest hash (6 bits) and the bits after its first 1."""
    out = np.zeros((len(sets), BUCKETS), np.uint16)
    if not sets:
        return out
    all_ = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    slot = row * BUCKETS + (all_ >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    new = np.ones(len(slot), bool)
    new[1:] = slot[1:] != slot[:-1]
    rest = all_[new] << np.uint64(BUCKET_BITS)
    # leading zeros from the exponent (53 bits decide it; equal hashes give equal results)
    zeros = np.minimum(64 - np.frexp(rest.astype(np.float64))[1], 62).astype(np.uint64)
    mant = (rest << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA_BITS)
    out.reshape(-1)[slot[new]] = 1 + ((zeros << np.uint64(MANTISSA_BITS)) | mant).astype(np.uint16)
    return out


def sketch(docs: DataFrame, k: int, extra: list | None = None) -> DataFrame:
    """doc_id, row, n (set size), s1, s2 (set hash), regs, and the `extra` columns."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), *(extra or []), F.col("text").alias("text"))
    names = [c for c in src.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            sets = _sets(b.column("text"), k)
            regs = registers(sets)
            s1 = [int(s.sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
            s2 = [int(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in names] + [
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64)),
                    pa.array([r.tobytes() for r in regs], pa.binary())],
                names=[*names, "n", "s1", "s2", "regs"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "text"]
                       + ["n long", "s1 long", "s2 long", "regs binary"])
    return src.mapInArrow(run, schema)


# ---------------------------------------------------------------- bands

def _classes(n: int, limit: float) -> list[int]:
    """The size classes a set of n shingles is banded in."""
    c = int(2 * math.log2(n) + 1e-9)
    return [c, c + 1] if n + 1e-9 >= limit * 2 ** ((c + 1) / 2) else [c]


def _weights(c: int) -> np.ndarray:
    """(256, bands) multipliers: a band's key is the sum of its registers times these."""
    n = 2 ** ((c + 0.5) / 2)
    filled = BUCKETS * -math.expm1(-n / BUCKETS)
    width = min(BUCKETS, max(5, round(BUCKETS * min(BAND_WIDTH / filled, 0.6))))
    rng = np.random.default_rng(7919 + min(c, 24))
    w = np.zeros((BUCKETS, BANDS), np.uint64)
    for j in range(BANDS):
        w[rng.permutation(BUCKETS)[:width], j] = rng.integers(1, 1 << 63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return w


def bands(nodes: DataFrame, limit: float) -> DataFrame:
    """Nodes (v, n, regs) to (key, v), one row per class and band that meets a register."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("v").to_numpy(zero_copy_only=False)
            regs = np.frombuffer(b"".join(b.column("regs").to_pylist()), np.uint16).reshape(-1, BUCKETS).astype(np.uint64)
            by: dict[int, list[int]] = {}
            for i, n in enumerate(b.column("n").to_pylist()):
                for c in _classes(n, limit):
                    by.setdefault(c, []).append(i)
            for c, rows in by.items():
                if c not in made:
                    made[c] = _weights(c)
                w = made[c]
                r = regs[rows]
                keys = r @ w
                ok = keys != 0
                keys = mix64(keys ^ mix64(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(1009) + np.uint64(c)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[ok].view(np.int64)), pa.array(np.repeat(v[rows], ok.sum(1)))], names=["key", "v"])

    return nodes.select("v", "n", "regs").mapInArrow(run, "key long, v long")


# ---------------------------------------------------------------- verification

def estimate(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
    """Collision-corrected Jaccard estimate of two register rows, and the buckets it uses.
    Registers of different minima agree by chance with probability sum 2^-z 2^-z / 2^m
    = 1/3 * 2^-m over leading zeros z."""
    used = int(((a | b) != 0).sum())
    if not used:
        return 0.0, 0
    same = int(((a == b) & (a != 0)).sum()) / used
    chance = (1 / 3) * 2.0 ** -MANTISSA_BITS
    return max(0.0, (same - chance) / (1 - chance)), used


def _linked(ra: bytes, rb: bytes, sa: bytes, sb: bytes, num: int) -> bool:
    na, nb = len(sa) // 8, len(sb) // 8
    if 100 * min(na, nb) < num * max(na, nb):
        return False
    j, used = estimate(np.frombuffer(ra, np.uint16), np.frombuffer(rb, np.uint16))
    lim = num / 100
    if used >= 32 and j < lim - 6 * math.sqrt(lim * (1 - lim) / used):
        return False
    inter = len(np.intersect1d(np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64), assume_unique=True))
    return 100 * inter >= num * (na + nb - inter)


def stars(pairs: DataFrame, sets: DataFrame, num: int) -> DataFrame:
    """(c, v, set, linked) of centres c and members v: whether 100 * intersection >= num * union."""
    left = sets.select("v", F.col("regs").alias("rv"), F.col("set").alias("sv"))
    right = sets.select(F.col("v").alias("c"), F.col("regs").alias("rc"), F.col("set").alias("sc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(x).to_pylist() for x in ("rv", "rc", "sv", "sc")]
            ok = pa.array([_linked(*x, num) for x in zip(*cols, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("c"), b.column("v"), b.column("sv"), ok], names=["c", "v", "set", "linked"])

    return (pairs.join(left, "v").join(right, "c").select("c", "v", "rv", "rc", "sv", "sc")
            .mapInArrow(run, "c long, v long, set binary, linked boolean"))


def intersections(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """(x, y) matrix of intersection sizes of sorted sets."""
    out = np.zeros((len(x), len(y)), np.float32)
    ex, ey = np.concatenate(x), np.concatenate(y)
    rx, ry = np.repeat(np.arange(len(x)), [len(s) for s in x]), np.repeat(np.arange(len(y)), [len(s) for s in y])
    both = np.intersect1d(ex, ey)
    if not len(both):
        return out

    def placed(e: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, e), len(both) - 1)
        ok = both[at] == e
        order = np.argsort(at[ok], kind="stable")
        return at[ok][order], r[ok][order]

    (ux, rx), (uy, ry) = placed(ex, rx), placed(ey, ry)
    nx, ny = np.bincount(ux, minlength=len(both)), np.bincount(uy, minlength=len(both))
    if len(x) * len(y) * len(both) < 300.0 * float((nx * ny).sum()):  # dense: a product of 0/1 matrices
        for lo in range(0, len(both), 4096):
            hi = min(lo + 4096, len(both))
            a, b = (np.zeros((n, hi - lo), np.float32) for n in (len(x), len(y)))
            for m, u, r in ((a, ux, rx), (b, uy, ry)):
                s, e = np.searchsorted(u, [lo, hi])
                m[r[s:e], u[s:e] - lo] = 1
            out += a @ b.T
        return out
    fx, fy = np.cumsum(nx) - nx, np.cumsum(ny) - ny
    at, done = 0, np.cumsum(nx * ny)
    while at < len(both):  # sparse: the rows that share an element, some million at a time
        end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + (1 << 22))))
        n = (nx * ny)[at:end]
        u = np.repeat(np.arange(at, end), n)
        k = np.arange(len(u)) - np.repeat(np.cumsum(n) - n, n)
        out += np.bincount(rx[fx[u] + k // ny[u]] * len(y) + ry[fy[u] + k % ny[u]], minlength=out.size).reshape(out.shape)
        at = end
    return out


def _forest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of the links."""
    up: dict[int, int] = {}

    def root(i: int) -> int:
        while up.get(i, i) != i:
            up[i] = up.get(up[i], up[i])
            i = up[i]
        return i

    out = []
    for i, j in zip(a, b, strict=True):
        ri, rj = root(i), root(j)
        if ri != rj:
            up[max(ri, rj)] = min(ri, rj)
            out.append((i, j))
    return out


def _block_links(num: int):
    """Links in blocks: rows of side 0 and unlinked rows of side 2 against rows of sides 1 and 2
    of the same centre."""

    def run(rows: pa.Table) -> pa.Table:
        c, v, side = (rows.column(x).to_numpy() for x in ("c", "v", "side"))
        linked = rows.column("linked").to_numpy(zero_copy_only=False) if rows.num_rows else np.zeros(0, bool)
        sets = [np.frombuffer(s, np.uint64) for s in rows.column("set").to_pylist()]
        a, b = [], []
        order = np.argsort(c, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(c[order])) + 1):
            xs, ys = part[(side[part] == 0) | ((side[part] == 2) & ~linked[part])], part[side[part] > 0]
            if not len(xs) or not len(ys):
                continue
            inter = intersections([sets[i] for i in xs], [sets[i] for i in ys])
            total = np.array([len(sets[i]) for i in xs])[:, None] + np.array([len(sets[i]) for i in ys])[None]
            i, j = np.nonzero((100 * inter >= num * (total - inter)) & (v[xs][:, None] != v[ys][None]))
            a += v[xs[i]].tolist()
            b += v[ys[j]].tolist()
        tree = _forest(a, b)
        return pa.table([pa.array([t[0] for t in tree], pa.int64()), pa.array([t[1] for t in tree], pa.int64())], names=["u", "v"])

    return run


def within_stars(star: DataFrame, num: int) -> DataFrame:
    """Links between the members of a centre of which at least one does not link with it."""
    size = F.octet_length("set").cast("long") + 64
    part = star.groupBy("c").agg(F.sum(size).alias("b"), F.sum(F.when(~F.col("linked"), size).otherwise(0)).alias("xb"), F.count("*").alias("n")).where("xb > 0 and n > 1")
    part = part.withColumn("ny", F.ceil(F.col("b") / BLOCK_BYTES).cast("int")).withColumn("nx", F.ceil(F.col("xb") / BLOCK_BYTES).cast("int"))
    rows = star.join(part.select("c", "nx", "ny", "b"), "c")
    # small stars go whole, many to a group; of large ones, every block meets every block
    groups = part.where("ny = 1").agg(F.greatest(F.lit(1), F.ceil(F.sum("b") / BLOCK_BYTES)).cast("long")).first()[0] or 1
    small = rows.where("ny = 1").select(F.pmod(F.xxhash64("c"), F.lit(groups)).alias("g"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), "c", "v", "set", "linked", F.lit(2).alias("side"))
    big = rows.where("ny > 1")
    own = F.xxhash64("v")
    x = big.where("not linked").select(F.col("c").alias("g"), F.pmod(own, F.col("nx")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("j"), "c", "v", "set", "linked", F.lit(0).alias("side"))
    y = big.select(F.col("c").alias("g"), F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("i"), F.pmod(own, F.col("ny")).cast("int").alias("j"), "c", "v", "set", "linked", F.lit(1).alias("side"))
    return small.unionAll(x).unionAll(y).groupBy("g", "i", "j").applyInArrow(_block_links(num), "u long, v long")


def _node_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Shingle sets of the wanted nodes (v, row, regs), from their whole texts."""
    src = only(docs, "doc_id", "text").where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("v"), row_key().alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text", STEP_BYTES):
            yield pa.RecordBatch.from_arrays(
                [b.column("v"), b.column("regs"), pa.array([s.tobytes() for s in _sets(b.column("text"), k)], pa.binary())],
                names=["v", "regs", "set"])

    return src.join(wanted, ["v", "row"]).select("v", "regs", "text").mapInArrow(run, "v long, regs binary, set binary").dropDuplicates(["v"])


# ---------------------------------------------------------------- the operator

def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, extra: list | None = None) -> DataFrame:
    """doc_id, row, n_shingles, component_id, kept (and `extra` columns) per document row.

    Two documents link when 100 * |A & B| >= percent * |A | B| over their sets of k-word
    shingles.  component_id is the smallest doc_id reachable over links.
    """
    prep(docs.sparkSession)
    limit = percent / 100
    sk = stage(sketch(docs, k, extra), "sketch")
    named = sk.where("doc_id is not null and n > 0")
    # one node per set, named by its smallest doc_id
    groups = named.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "row")).alias("m"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    nodes = stage(groups.select("s1", "s2", F.col("m.doc_id").alias("v"), F.col("m.row").alias("row"), "n", "regs"), "nodes")
    same = named.join(nodes.select("s1", "s2", "v"), ["s1", "s2"]).where("doc_id <> v").select(F.col("doc_id").alias("u"), "v")

    b = bands(nodes, limit).distinct()
    crowded = b.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = stage(b.join(crowded, "key"), "members")
    shared = members.groupBy("v").agg(F.sum("m").alias("shared"))
    ranked = members.join(shared, "v")
    centre = ranked.groupBy("key").agg(F.max_by(F.col("v"), F.struct(F.col("shared"), -F.col("v"))).alias("c"))
    pairs = stage(members.join(centre, "key").where("v <> c").select("c", "v").distinct(), "pairs")
    wanted = pairs.select("v").unionAll(pairs.select(F.col("c").alias("v"))).distinct().join(nodes.select("v", "row", "regs"), "v")
    sets = stage(_node_sets(docs, wanted, k), "sets")
    unstage(members)
    star = stage(stars(pairs, sets, percent), "stars")
    unstage(sets)
    links = star.where("linked").select(F.col("c").alias("u"), "v").unionAll(within_stars(star, percent)).unionAll(same)
    comp = components(links).select(F.col("v").alias("doc_id"), "comp")
    names = [c for c in sk.columns if c not in ("doc_id", "row", "n", "s1", "s2", "regs")]
    out = (sk.select("doc_id", "row", F.col("n").alias("n_shingles"), *names).join(comp, "doc_id", "left")
            .select("doc_id", "row", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"),
                    F.coalesce(F.coalesce("comp", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"), *names))
    out = stage(out, "near")  # a few numbers a row; what it was made from can go
    for used in (sk, nodes, pairs, star):
        unstage(used)
    return out


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` with one document of each near-duplicate group.  Of rows that
    repeat a doc_id one stays (the smallest row hash); rows without doc_id stay."""
    found = near_duplicates(docs, k, percent).where("kept").select("doc_id", "row")
    named = found.where("doc_id is not null").groupBy("doc_id").agg(F.min("row").alias("row"))
    src = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"))
    w = Window.partitionBy("doc_id", "row").orderBy("doc_id")
    one = src.join(named, ["doc_id", "row"]).withColumn("turn", F.row_number().over(w)).where("turn = 1")
    return one.select("doc.*").unionAll(docs.where("doc_id is null"))


def keep_texts(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` with one row of each group of near-duplicate texts, whatever their ids.

    The vertex of a row is its 64-bit hash of doc_id and text, so texts that share a doc_id, or
    have none, are judged on their own.  The row of the smallest doc_id stays (null last, then the
    smallest hash); of rows equal in doc_id and text one stays, also of those without words."""
    named = docs.select(row_key().alias("doc_id"), F.col("doc_id").cast("long").alias("id"), "text")
    found = near_duplicates(named, k, percent, [F.col("id")])
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "doc_id")).alias("m"))
    src = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("doc"), row_key().alias("v"))
    # the window comes before the join, so that copies go before the shuffle
    one = src.withColumn("turn", F.row_number().over(Window.partitionBy("v").orderBy("v"))).where("turn = 1")
    return one.join(first.select(F.col("m.doc_id").alias("v")), "v").select("doc.*")
