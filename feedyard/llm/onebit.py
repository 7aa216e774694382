"""Approximate nearest neighbours by randomly rotated one-bit codes.

1. Index.  Rows are dealt to clusters (centres fitted by k-means on a bounded sample; one
   cluster at the origin while the table is small).  A row's difference from its centre is
   made a unit vector u, turned by a random matrix with orthonormal columns into `bits`
   dimensions, and kept as the signs of these, packed, with two scalars: the length of the
   difference, and a = <o, Ru>, where o is the code as a unit vector.
2. Estimate.  A query is turned once and cut to four bits a dimension.  Its inner product with
   a code is a sum of population counts of the code and the query's four bit planes; divided by
   a it estimates <u, q> without bias, and <x, q> follows with <centre, q> and the length.
   The part of o across u points in a random direction, so the error is within
   `WIDTH` * |q| * sqrt(1 - a^2) / (a * sqrt(bits - 1)), with what the four bits add.
3. Choice.  A row is reranked if its estimate plus its bound reaches the query's k-th best so
   far: the k-th best lower bound at first, the k-th best true score after that.  Reranked
   rows get their inner product on the original vectors in double precision.
4. Search.  A query first searches one block of its own cluster, which gives a true k-th best;
   then the blocks of all clusters whose bound <centre, q> + radius * |q| reaches it.  A
   window over what the blocks found keeps the first k.

Blocks hold at most about `BLOCK` rows and `QUERIES` queries, dealt by hashes of a row id, so a
ball of copies or one cluster is spread over many groups; each gives at most k rows a query.

Defined results: null or zero vectors, null or non-finite components and null ids take no part;
rows of different length never meet (a query has the rows of its own length); rows that repeat
an id are rows of their own (a query's other rows of its id are candidates, and each repeated query
row has its own k); extra columns are ignored.  A missed neighbour is possible only where an
error passes its bound; tests measure recall.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedyard.llm.common import apart, prep, stage

#: Rows that a cluster should have; centres at most; sampled rows that they are fitted on, each.
CLUSTER, CENTRES, FIT = 16_384, 1024, 32
#: Rows and queries of a block.
BLOCK, QUERIES = 32_768, 4096
#: Bits of a code, at least; vectors of more components have as many bits.
LEAST_BITS = 256
#: Bits of a query's dimension.
PLANES = 4
#: Standard deviations of the error bound.
WIDTH = 4.0
STEP_ROWS, STEP_QUERIES = 4096, 64


# ---------------------------------------------------------------- codes

def width(dim: int) -> int:
    """Bits of a code: a multiple of 64."""
    return max(LEAST_BITS, -(-dim // 64) * 64)


def rotation(dim: int) -> np.ndarray:
    """width(dim) x dim, with orthonormal columns; the same for every caller."""
    return np.linalg.qr(np.random.default_rng(1000 + dim).normal(size=(width(dim), dim)))[0]


def matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), float).reshape(len(col), -1)


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, a, and the length of the difference from the row's centre."""
    r = x - centre
    big = np.abs(r).max(1, initial=0, keepdims=True)
    unit = r / np.where(big > 0, big, 1)
    n = np.sqrt((unit * unit).sum(1))
    y = unit / np.where(n > 0, n, 1)[:, None] @ turn.T
    a = np.abs(y).sum(1) / np.sqrt(len(turn))
    return np.packbits(y > 0, axis=1, bitorder="little"), np.where(n > 0, a, 1), n * big[:, 0]


def planes(q: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, ...]:
    """A turned query as integers of `PLANES` bits: bit planes (query, plane, word), offset, step,
    the sum of what they stand for, and the length of what was cut off."""
    y = q @ turn.T
    low = y.min(1)
    step = (y.max(1) - low) / ((1 << PLANES) - 1)
    step = np.where(step > 0, step, 1)
    n = np.rint((y - low[:, None]) / step[:, None]).astype(np.uint8)
    meant = low[:, None] + step[:, None] * n
    bits = np.stack([np.packbits(n >> j & 1, axis=1, bitorder="little").view(np.uint64) for j in range(PLANES)], axis=1)
    return bits, low, step, meant.sum(1), np.sqrt(((y - meant) ** 2).sum(1))


def counts(code: np.ndarray, plane: np.ndarray) -> np.ndarray:
    """Sum over the code's bits of the query's integers, (query, row), by population counts."""
    out = np.zeros((len(plane), len(code)), np.float32)
    for j in range(PLANES):
        part = np.zeros((len(plane), len(code)), np.uint16)
        for w in range(code.shape[1]):
            part += np.bitwise_count(code[None, :, w] & plane[:, j, w, None])
        out += part * np.float32(1 << j)
    return out


# ---------------------------------------------------------------- one block

def cut(q: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each query: higher scores first, then smaller ids."""
    order = np.lexsort((row, ids[row], -score, q))
    q, row, score = q[order], row[order], score[order]
    start = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
    first = np.flatnonzero(start)
    keep = np.arange(len(q)) - first[np.cumsum(start) - 1] < k if len(q) else start
    return q[keep], row[keep], score[keep]


def nearest(rows: dict, q: np.ndarray, own: np.ndarray, known: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the first k rows of each query that reach its known score."""
    x, code, a, length, rid, ids = (rows[n] for n in ("x", "code", "a", "length", "rid", "vec_id"))
    size = len(turn)
    bits, low, step, total, lost = planes(q, turn)
    norm = np.sqrt((q * q).sum(1))
    pop = np.bitwise_count(code).sum(1).astype(np.float32)
    base = q @ centre
    across = np.sqrt(np.maximum(0, 1 - a * a)) / a
    best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    floor = known.copy()
    for i in range(0, len(q), STEP_QUERIES):
        t = slice(i, i + STEP_QUERIES)
        n = len(q[t])
        mine = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for j in range(0, len(x), STEP_ROWS):
            r = slice(j, j + STEP_ROWS)
            dot = 2 * (low[t, None] * pop[None, r] + step[t, None] * counts(code[r], bits[t])) - total[t, None]
            estimate = base[t, None] + length[None, r] * (dot / (np.sqrt(size) * a[None, r]))
            bound = WIDTH * length[None, r] * (norm[t, None] * across[None, r] / np.sqrt(size - 1) + lost[t, None] / (np.sqrt(size) * a[None, r]))
            estimate[own[t, None] == rid[None, r]] = -np.inf
            if estimate.shape[1] >= k:  # k rows are surely this near
                floor[t] = np.maximum(floor[t], np.partition(estimate - bound, -k, axis=1)[:, -k])
            qi, ri = np.nonzero((estimate + bound >= floor[t, None]) & (estimate > -np.inf))
            score = np.empty(len(qi))
            for at in range(0, len(qi), 1 << 16):
                s = slice(at, at + (1 << 16))
                score[s] = np.einsum("ij,ij->i", q[i + qi[s]], x[j + ri[s]])
            mine = cut(*(np.concatenate(p) for p in zip(mine, (qi, ri + j, score), strict=True)), ids, k)
            have = np.bincount(mine[0], minlength=n)
            last = np.cumsum(have) - 1
            full = have == k
            floor[t] = np.where(full, np.maximum(floor[t], mine[2][np.where(full, last, 0)] if len(mine[2]) else -np.inf), floor[t])
        keep = mine[2] >= known[i + mine[0]]
        best = tuple(np.concatenate(p) for p in zip(best, (mine[0][keep] + i, mine[1][keep], mine[2][keep]), strict=True))
    return best


FOUND = "q long, query_id long, vec_id long, score double"


def _block(centres: dict, k: int):
    def run(key: tuple, rows: pa.Table, asks: pa.Table) -> pa.Table:
        kind = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not rows.num_rows or not asks.num_rows:
            return kind.empty_table()
        dim, cluster = key[0].as_py(), key[1].as_py()
        held = {n: rows.column(n).to_numpy() for n in ("a", "length", "rid", "vec_id")} | {"x": matrix(rows.column("x"))}
        held["code"] = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint64).reshape(rows.num_rows, -1)
        own, names = asks.column("rid").to_numpy(), asks.column("vec_id").to_numpy()
        q, r, score = nearest(held, matrix(asks.column("x")), own, asks.column("floor").to_numpy(), centres[dim][cluster], rotation(dim), k)
        return pa.table([own[q], names[q], held["vec_id"][r], score], schema=kind)

    return run


# ---------------------------------------------------------------- the operator

def takes_part(x: Column) -> Column:
    ok = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    return F.coalesce(x.isNotNull() & ok, F.lit(False))


def _kmeans(most: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rid")
        x = matrix(rows.column("x"))
        k = min(most, len(x))
        rng = np.random.default_rng(11)
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(12):
            near = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
            n = np.bincount(near, minlength=k)
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
        return pa.table({"centre": pa.array(c.tolist(), pa.list_(pa.float64()))})

    return run


def fit(rows: DataFrame, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """Centres by vector length: at most `CENTRES` of each, fitted in a task on a sample of `FIT`
    rows a centre, chosen by a hash; the origin alone for `CLUSTER` rows or fewer."""
    out = {}
    for dim, n in sizes.items():
        k = min(CENTRES, -(-n // CLUSTER))
        if k < 2:
            out[dim] = np.zeros((1, dim))
            continue
        share = int(min(1.0, 1.2 * k * FIT / n) * (1 << 30))
        sample = rows.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("rid", F.lit(3)), F.lit(1 << 30)) < share)).select("dim", "rid", "x").limit(k * FIT)
        got = sample.groupBy("dim").applyInArrow(_kmeans(k), "centre array<double>").collect()
        out[dim] = np.array([r.centre for r in got])
    return out


def _codes(centres: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                at = pa.array(np.flatnonzero(dims == dim))
                x, c = matrix(b.column("x").take(at)), centres[dim]
                near = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
                code, a, length = encode(x, c[near], turns.setdefault(dim, rotation(dim)))
                yield pa.RecordBatch.from_arrays([*(b.column(n).take(at) for n in ("rid", "vec_id", "asks", "dim", "x")), pa.array(near.astype(np.int32)),
                                                  pa.array([r.tobytes() for r in code], pa.binary()), pa.array(a), pa.array(length)],
                                                 names=["rid", "vec_id", "asks", "dim", "x", "cluster", "code", "a", "length"])

    return run


def _further(centres: dict[int, np.ndarray], reach: dict):
    """Blocks beyond a query's own that may hold a row as near as its floor.  reach: parts and
    radius by (length, cluster)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                q, c = matrix(b.column("x").take(pa.array(rows))), centres[dim]
                parts = np.array([reach.get((dim, j), (0, 0.0))[0] for j in range(len(c))])
                radius = np.array([reach.get((dim, j), (0, 0.0))[1] for j in range(len(c))])
                most = q @ c.T + radius * np.sqrt((q * q).sum(1))[:, None]
                slack = 1e-9 * (1 + np.abs(most))
                i, j = np.nonzero((most + slack >= b.column("floor").to_numpy()[rows][:, None]) & (parts > 0))
                n = parts[j]
                i, j, part = np.repeat(i, n), np.repeat(j, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                own = (b.column("cluster").to_numpy()[rows][i] == j) & (b.column("part").to_numpy()[rows][i] == part)
                i, j, part = i[~own], j[~own], part[~own]
                at = pa.array(rows[i])
                yield pa.RecordBatch.from_arrays([*(b.column(n).take(at) for n in ("dim", "rid", "vec_id", "x", "floor")), pa.array(j.astype(np.int32)), pa.array(part.astype(np.int32))],
                                                 names=["dim", "rid", "vec_id", "x", "floor", "cluster", "part"])

    return run


def search(vectors: DataFrame, k: int = 20, query: Column | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of the largest inner product with each query.

    vectors: vec_id, embedding.  query: which rows are queries (by default those whose vec_id is
    divisible by 20)."""
    spark = prep(vectors.sparkSession)
    deep = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(deep).alias("x"),
                         F.coalesce(query if query is not None else F.col("vec_id") % 20 == 0, F.lit(False)).alias("asks"))
    good = src.where(takes_part(F.col("x")) & F.col("vec_id").isNotNull())
    # the row id holds for good once it is written
    rows = stage(good.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "asks", F.size("x").alias("dim"), "x"), "vectors")
    centres = fit(rows, {r.dim: r.n for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()})  # a row for each length
    coded = rows.mapInArrow(_codes(centres), f"rid long, vec_id long, asks boolean, dim int, x {deep}, cluster int, code binary, a double, length double")
    coded = stage(coded, "codes")
    per = coded.groupBy("dim", "cluster").agg(F.count("*").alias("n"), F.max("length").alias("radius")).collect()  # a row for each centre
    reach = {(r.dim, r.cluster): (max(-(-r.n // BLOCK), 1), r.radius) for r in per}
    parts = spark.createDataFrame([(d, c, p) for (d, c), (p, _) in reach.items()], "dim int, cluster int, parts int")
    coded = coded.join(F.broadcast(parts), ["dim", "cluster"]).withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
    members = coded.select("dim", "cluster", "part", "rid", "vec_id", "x", "code", "a", "length")
    by = ["dim", "cluster", "part"]

    def blocks(asks: DataFrame) -> DataFrame:
        """What the blocks find for the queries that ask them."""
        many = asks.groupBy(*by).agg(F.ceil(F.count("*") / F.lit(QUERIES)).cast("int").alias("nq"))  # a row for each block
        held = members.join(many, by).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).drop("nq")
        ask = asks.join(many, by).withColumn("b", F.pmod(F.xxhash64("rid"), F.col("nq")).cast("int")).drop("nq")
        return apart(held).groupBy(*by, "b").cogroup(apart(ask).groupBy(*by, "b")).applyInArrow(_block(centres, k), FOUND)

    asks = coded.where("asks").select(*by, "rid", "vec_id", "x")
    first = stage(blocks(asks.withColumn("floor", F.lit(float("-inf")))), "first")
    found = first
    if sum(p for p, _ in reach.values()) > 1:
        floor = first.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("floor"))
        known = asks.join(floor.withColumnRenamed("q", "rid"), "rid", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        more = stage(known.select("dim", "rid", "vec_id", "x", "floor", "cluster", "part").mapInArrow(
            _further(centres, reach), f"dim int, rid long, vec_id long, x {deep}, floor double, cluster int, part int"), "asks")
        found = first.unionAll(blocks(more))
    rank = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
