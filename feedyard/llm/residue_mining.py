"""Hard negatives by exact integer scores from a residue-number-system matrix product.

1. Components become integers: floor(scale * component).
2. Scores.  The integer matrices are reduced modulo several small primes, to residues about
   zero.  For each prime one float32 matrix product gives the scores modulo that prime; it is
   exact, since the inner dimension is cut so that no partial sum reaches 2^24.  The signed
   scores come back by Chinese remaindering in balanced mixed-radix digits.  There are as
   many primes as the largest norm of the table asks for (a score is at most its square).
3. Positives.  Anchors meet the rows of their label in blocks; each block gives an anchor's
   best rows, and a window over all blocks keeps the first `positives` of them.
4. Negatives.  Anchors, with their positives' scores, meet all rows in blocks.  Per anchor and
   positive a block keeps the best rows of another label whose score lies in the window
   [low, high] percent of the positive's score; a window function keeps the first `negatives`.

Anchors and rows are dealt into blocks by a hash of a row id, so a label, a ball of copies or
an id that holds a third of the table is spread over many groups.  A group holds at most
`ANCHORS` anchors and about `MOST_ROWS` rows and gives rows bounded by its anchors.

Defined results: a row with a null id, a null label, a null vector, or any null or non-finite
component takes no part.  Rows of different vector length have no score and never meet.  Rows
that repeat an id (or are equal) are rows of their own: a copy of the anchor's row may be its
positive, and a repeated anchor has its rows repeated.  An empty vector scores 0 with empty
vectors.  An anchor without positives, or whose windows are empty, gives no rows.  Extra columns
are ignored.  Integer vectors of a squared norm of 2^55 or more are an error.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedyard.llm.common import apart, prep, stage
from feedyard.operators.skew import salted_join

#: Anchors of a block, at most (to a hash's evenness).
ANCHORS = 8192
#: Rows of a block: the table over the session's parallelism, within these bounds.
LEAST_ROWS, MOST_ROWS = 4096, 262_144
#: Anchors and rows of one step within a block.
STEP_ANCHORS, STEP_ROWS = 256, 8192
#: Squared norms of integer vectors stay under this, so that scores and percentages fit 64 bits.
NORM_LIMIT = float(1 << 55)
NONE = np.iinfo(np.int64).min


# ---------------------------------------------------------------- residue arithmetic

def primes_for(bound: float) -> list[int]:
    """Largest primes under 256 whose product exceeds 2 * bound + 1 (two at least)."""
    out, product = [], 1
    for n in range(255, 2, -1):
        if all(n % d for d in range(2, int(n ** 0.5) + 1)):
            out.append(n)
            product *= n
            if len(out) > 1 and product > 2 * bound + 1:
                return out
    raise ValueError("scores are too large")


def residues(x: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """The integer matrix modulo each prime, about zero, in float32."""
    return [((x + p // 2) % p - p // 2).astype(np.float32) for p in primes]


def product_mod(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p (about zero), for matrices of residues about zero."""
    deep = (1 << 24) // (p // 2) ** 2 - 1  # so many products, and what is carried over, stay under 2^24
    out = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, a.shape[1], deep):
        out += a[:, at:at + deep] @ b[:, at:at + deep].T
        out -= p * np.rint(out / np.float32(p))
    return out


def remainder(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Signed integers from their residues: balanced mixed-radix digits, so that the sum of the
    digits by their weights is the number itself."""
    out, weight = np.zeros(parts[0].shape, np.int64), 1
    for r, p in zip(parts, primes, strict=True):
        digit = (r.astype(np.int64) - out) % p * pow(weight, -1, p)
        out += ((digit + p // 2) % p - p // 2) * weight
        weight *= p
    return out


def scores(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    return remainder([product_mod(x, y, p) for x, y, p in zip(a, b, primes, strict=True)], primes)


# ---------------------------------------------------------------- blocks

def matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(len(col), -1) if len(col) else np.zeros((0, 0), np.int64)


def ranked(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of each row in falling order and their columns; equal ones by column."""
    c = s.shape[1]
    if np.abs(s[s != NONE]).max(initial=0) < (1 << 62) // STEP_ROWS:  # score and column in one number
        key = np.sort(np.where(s == NONE, np.iinfo(np.int64).max, np.arange(c) - s * STEP_ROWS), axis=1)
        none = key == np.iinfo(np.int64).max
        return np.where(none, NONE, -(key // STEP_ROWS)), np.where(none, 0, key % STEP_ROWS)
    order = np.argsort(np.where(s == NONE, np.iinfo(np.int64).max, -s), axis=1, kind="stable")
    return np.take_along_axis(s, order, 1), order


def merged(old: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray], keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The best `keep` along the last axis; the old ones come first where scores are equal."""
    s, at = (np.concatenate(x, axis=-1) for x in zip(old, new, strict=True))
    order = np.argsort(np.where(s == NONE, np.iinfo(np.int64).max, -s), axis=-1, kind="stable")[..., :keep]
    return np.take_along_axis(s, order, -1), np.take_along_axis(at, order, -1)


def _by_id(rows: pa.Table) -> pa.Table:
    return rows.sort_by([("vec_id", "ascending"), ("rid", "ascending")])


def _steps(anchors: pa.Table, rows: pa.Table, primes: list[int]):
    """(anchors from, rows from, scores) of a block, rows in order of their id within each step of anchors."""
    right = residues(matrix(rows.column("x")), primes)
    left = residues(matrix(anchors.column("x")), primes)
    for i in range(0, anchors.num_rows, STEP_ANCHORS):
        for j in range(0, rows.num_rows, STEP_ROWS):
            yield i, j, scores([x[i:i + STEP_ANCHORS] for x in left], [x[j:j + STEP_ROWS] for x in right], primes)


POSITIVES = "a long, anchor_id long, p long, positive_id long, score long"
NEGATIVES = "a long, anchor_id long, k int, positive_id long, positive_score long, negative_id long, score long"


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def _positives(keep: int, primes: list[int]):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        kind = pa.schema([(n, pa.int64()) for n in _names(POSITIVES)])
        if not anchors.num_rows or not rows.num_rows:
            return kind.empty_table()
        rows = _by_id(rows)
        own, rid = anchors.column("rid").to_numpy(), rows.column("rid").to_numpy()
        got: dict[int, tuple] = {}
        for i, j, s in _steps(anchors, rows, primes):
            s[own[i:i + len(s), None] == rid[None, j:j + s.shape[1]]] = NONE
            sc, at = ranked(s)
            new = sc[:, :keep], at[:, :keep] + j
            got[i] = merged(got[i], new, keep) if i in got else new
        sc, at = (np.concatenate([got[i][n] for i in sorted(got)]) for n in (0, 1))
        a, k = np.nonzero(sc != NONE)
        at = at[a, k]
        return pa.table([own[a], anchors.column("vec_id").to_numpy()[a], rid[at], rows.column("vec_id").to_numpy()[at], sc[a, k]], schema=kind)

    return run


def _negatives(keep: int, low: int, high: int, primes: list[int]):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        kind = pa.schema([(n, pa.int32() if n == "k" else pa.int64()) for n in _names(NEGATIVES)])
        if not anchors.num_rows or not rows.num_rows:
            return kind.empty_table()
        rows = _by_id(rows)
        names = {v: n for n, v in enumerate(set(anchors.column("label").to_pylist()))}
        mine = np.array([names[v] for v in anchors.column("label").to_pylist()])
        theirs = np.array([names.get(v, -1) for v in rows.column("label").to_pylist()])
        pos = anchors.column("pos").to_pylist()  # [{k, id, score}], at most a few
        most = max(map(len, pos))
        ps = np.array([[x["score"] for x in p] + [0] * (most - len(p)) for p in pos], np.int64)
        there = np.array([[True] * len(p) + [False] * (most - len(p)) for p in pos])
        # 100 * s >= low * ps and 100 * s <= high * ps, as bounds of the integer s
        least, largest = -(-low * ps // 100), high * ps // 100
        got: dict[int, tuple] = {}
        for i, j, s in _steps(anchors, rows, primes):
            n, c = s.shape
            s[mine[i:i + n, None] == theirs[None, j:j + c]] = NONE
            sc, at = ranked(s)
            over = np.stack([(sc > largest[i:i + n, k, None]).sum(1) for k in range(most)], axis=1)  # before the window
            place = over[..., None] + np.arange(keep)
            here = np.minimum(place, c - 1).reshape(n, -1)
            ts, ta = (np.take_along_axis(x, here, 1).reshape(n, most, keep) for x in (sc, at))
            ok = (place < c) & (ts != NONE) & (ts >= least[i:i + n, :, None]) & there[i:i + n, :, None]
            new = np.where(ok, ts, NONE), ta + j
            got[i] = merged(got[i], new, keep) if i in got else new
        sc, at = (np.concatenate([got[i][n] for i in sorted(got)]) for n in (0, 1))
        a, k, r = np.nonzero(sc != NONE)
        ids = np.array([[x["id"] for x in p] + [0] * (most - len(p)) for p in pos], np.int64)
        return pa.table([anchors.column("rid").to_numpy()[a], anchors.column("vec_id").to_numpy()[a], k.astype(np.int32), ids[a, k], ps[a, k],
                         rows.column("vec_id").to_numpy()[at[a, k, r]], sc[a, k, r]], schema=kind)

    return run


# ---------------------------------------------------------------- the operator

def integers(scale: float) -> Column:
    """The vector's components as integers of 32 bits (what lies beyond fails the norm's check)."""
    return F.transform("x", lambda v: F.least(F.greatest(F.floor(F.lit(float(scale)) * v), F.lit(-(1 << 31) + 1)), F.lit((1 << 31) - 1)).cast("int"))


def meet(anchors: DataFrame, rows: DataFrame, per: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """Every block of a key's anchors with every block of its rows.  per: keys, ni and nj (blocks)."""
    block = lambda n: F.pmod(F.xxhash64("rid"), F.col(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = salted_join(anchors, per, keys, salt_of="rid").withColumn("i", block("ni")).withColumn("j", copies("nj")).drop("ni", "nj")
    r = salted_join(rows, per, keys, salt_of="rid").withColumn("j", block("nj")).withColumn("i", copies("ni")).drop("ni", "nj")
    by = [*keys, "i", "j"]
    return apart(a).groupBy(*by).cogroup(apart(r).groupBy(*by)).applyInArrow(run, schema)


def mine(vectors: DataFrame, anchor: Column | None = None, scale: float = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, embedding, label.  anchor: which rows are anchors (by default those whose
    vec_id is divisible by 100).  low, high: the window, in percent of the positive's score."""
    spark = prep(vectors.sparkSession).sparkContext
    x = F.col("x")
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("string").alias("label"),
                         F.coalesce(anchor if anchor is not None else F.col("vec_id") % 100 == 0, F.lit(False)).alias("anchor"))
    good = src.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    # the row id holds for good once it is written
    rows = stage(good.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", "anchor", F.size("x").alias("dim"), integers(scale).alias("x"))
                 .withColumn("norm", F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v)), "integers")
    count, norm = rows.agg(F.count("*"), F.max("norm")).first()
    if (norm or 0) >= NORM_LIMIT:
        raise ValueError(f"an integer vector has a squared norm of {norm:g}; the scores of such vectors don't fit")
    primes = primes_for((norm or 0) * 1.001)
    block = min(max(-(-count // spark.defaultParallelism), LEAST_ROWS), MOST_ROWS)

    def blocks(*keys: str) -> DataFrame:
        per = rows.groupBy(*keys).agg(F.count_if("anchor").alias("na"), F.count("*").alias("n")).where("na > 0")
        return per.select(*keys, F.ceil(F.col("na") / F.lit(ANCHORS)).cast("int").alias("ni"), F.ceil(F.col("n") / F.lit(block)).cast("int").alias("nj"))

    anchors = rows.where("anchor").select("dim", "label", "rid", "vec_id", "x")
    others = rows.select("dim", "label", "rid", "vec_id", "x")
    best = meet(anchors, others, blocks("dim", "label"), ["dim", "label"], _positives(positives, primes), POSITIVES)
    first = Window.partitionBy("a").orderBy(F.desc("score"), "positive_id", "p")
    pos = best.withColumn("k", F.row_number().over(first)).where(F.col("k") <= positives)
    pos = pos.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("k", F.col("positive_id").alias("id"), "score"))).alias("pos"))  # `positives` entries
    asks = stage(anchors.join(pos.withColumnRenamed("a", "rid"), "rid").select("dim", "label", "rid", "vec_id", "x", "pos"), "positives")
    found = meet(asks, others, blocks("dim"), ["dim"], _negatives(negatives, low, high, primes), NEGATIVES)
    rank = Window.partitionBy("a", "k").orderBy(F.desc("score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", F.col("score").alias("negative_score"))
