"""Near-duplicate vectors by a robust-pruned flat graph with range search.

1. Vectors are normalised in double precision; exact copies (same label, same components)
   become one node with a weight and a key of its own.
2. Index.  Per label, centres are fitted by k-means on a bounded sample (`FIT` vectors of a
   label, chosen by a hash), one for each `SHARD` nodes; each node joins the shards of its
   `OVERLAP` nearest centres.  A shard that the sample says is too large is dealt into parts
   by a hash.  In each part every node gets neighbours by robust pruning (a candidate goes
   when a kept neighbour is `ALPHA` times nearer to it than the node is).
3. The adjacency lists that a node has in its shards are united by a grouped aggregation.
4. Search.  A node probes every shard whose primary members may link with it.  Those lie on
   their centre's side of the plane halfway to the node's own centre, so a shard is left out
   only if the node is farther from that plane than a link reaches: no linked pair is lost by
   the choice of shards, whatever the label's size.  In each part the united graph of its
   members is searched for all nodes of a block at once: a greedy beam search from the medoid
   (and from the node itself, where it is a member), then a range expansion that follows edges
   both ways from every node found within reach, until none is left.
5. Audit.  For the nodes whose smallest id is divisible by 20 the part's true links are computed
   by brute force, in blocks.  A block that loses one of them is searched again with a beam
   twice as wide, and beyond `WIDEST` by comparing all members: no audited link is lost.
6. Links are verified by their cosine in double precision.  A node's links are counted in the
   part that holds the other node as primary member, so each is counted once.  The nodes that
   search a part are dealt into blocks of `ASKING` by a hash; a block's links go into a
   union-find one step at a time, and it returns counts and a spanning forest, from which the
   components follow.

A label of up to 2 * `SHARD` vectors is one shard.  In larger labels the probes follow the data:
where vectors lie in clusters most shards are left out; where they have no structure at all the
bound keeps nearly all shards, and the work grows faster than the label.

Defined results: a null or zero vector, null or non-finite components, a null label and a
null id link with nothing (component: itself; kept); vectors of different length are never
compared; rows that repeat an id are vectors of their own in n_links and one vertex in the
components; extra columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedyard.llm.common import apart, prep, sent, stage
from feedyard.llm.components import components

#: Vectors of a label that its centres are fitted on, at most.
FIT = 16_384
#: Nodes that a shard should have; a part holds at most about twice as many primary ones.
SHARD = 8192
#: Centres of a label, at most; beyond that shards have more parts.
CENTRES = 1024
#: Vectors that search a part in one group, and in one step; nodes that one group assigns.
ASKING, STEP, ASSIGN = 4096, 256, 16_384
OVERLAP = 2
DEGREE = 24
CANDIDATES = 64
ALPHA = 1.2
BEAM = 32
#: Open nodes of a beam that are followed at once; a beam that still loses links gives way to brute force.
FOLLOW, WIDEST = 4, 512
#: How far under the limit the range expansion still follows edges (cosine).
SLACK = 0.05


def valid(col: str, label: str) -> Column:
    """Whether a vector takes part."""
    x = F.col(col)
    ok = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    return F.coalesce(F.col(label).isNotNull() & x.isNotNull() & ok, F.lit(False))


def unit(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False), float)
    x = flat.reshape(len(col), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


# ---------------------------------------------------------------- centres

def kmeans(x: np.ndarray, k: int) -> np.ndarray:
    rng = np.random.default_rng(5)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(10):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 1e-12, total / np.maximum(size, 1e-12)[:, None], x[rng.integers(len(x), size=k)])
    return c


def _centres(shard: int, most: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """Centres of one label and the number of parts of each shard."""
        rows = rows.sort_by("v")
        x = unit(rows.column("x"))
        total = rows.column("total")[0].as_py()
        k = 1 if total <= 2 * shard else int(min(most, len(x), -(-total // shard)))
        c = kmeans(x, k)
        share = np.bincount((x @ c.T).argmax(1), minlength=k) / len(x)
        parts = np.maximum(1, np.ceil(share * total / (2 * shard))).astype(int)
        return pa.table([pa.array([key[0].as_py()] * k, pa.string()), pa.array(range(k), pa.int32()), pa.array(c.tolist(), pa.list_(pa.float64())), pa.array(parts, pa.int32())], names=["grp", "shard", "centre", "parts"])

    return run


def probes(x: np.ndarray, c: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, centres): each row's centres, nearest first, and which of them in that order may
    be the nearest centre of a vector with cosine >= limit to the row."""
    s = x @ c.T
    order = np.argsort(-s, axis=1, kind="stable")
    s = np.take_along_axis(s, order, 1)
    apart_by = np.linalg.norm(c[:, None] - c[None], axis=2)[order[:, :1], order]
    reach = np.sqrt(1 - limit * limit) if limit > 0 else np.inf
    # distance to the halfway plane times `apart_by`; 1e-9 is far over the rounding
    return order, s[:, :1] - s <= np.where(apart_by > 0, reach * apart_by, 0) + 1e-9 if reach < np.inf else np.ones_like(s, bool)


PLACED = "grp string, v long, x array<double>, weight long, audit boolean, at array<struct<shard: int, rank: int, part: int, parts: int, asks: boolean>>"


def _assign(limit: float):
    def run(nodes: pa.Table, centres: pa.Table) -> pa.Table:
        """The shards that each node joins or probes, one row a node."""
        at = pa.struct([("shard", pa.int32()), ("rank", pa.int32()), ("part", pa.int32()), ("parts", pa.int32()), ("asks", pa.bool_())])
        kind = pa.schema([("grp", pa.string()), ("v", pa.int64()), ("x", pa.list_(pa.float64())), ("weight", pa.int64()), ("audit", pa.bool_()), ("at", pa.list_(at))])
        if not nodes.num_rows or not centres.num_rows:
            return kind.empty_table()
        centres = centres.sort_by("shard")
        c = np.array(centres.column("centre").to_pylist())
        x, ids, parts = unit(nodes.column("x")), nodes.column("v").to_numpy(), centres.column("parts").to_numpy()
        got = []
        for t in range(0, len(x), 1024):  # each node takes a row of centres
            order, near = probes(x[t:t + 1024], c, limit)
            i, r = np.nonzero(near | (np.arange(len(c)) < OVERLAP))
            got.append((i + t, r, order[i, r], near[i, r]))
        i, r, k, asks = (np.concatenate(a) for a in zip(*got, strict=True))
        part = (ids[i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % parts[k].astype(np.uint64)
        cells = pa.StructArray.from_arrays([pa.array(a.astype(np.int32)) for a in (k, r, part, parts[k])] + [pa.array(asks)], fields=list(at))
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(i, np.arange(len(x) + 1)).astype(np.int32)), cells)
        return pa.table([*(nodes.column(n) for n in ("grp", "v", "x", "weight", "audit")), lists], schema=kind)

    return run


# ---------------------------------------------------------------- graph

def robust_prune(x: np.ndarray) -> list[np.ndarray]:
    """Neighbours of each row: nearest first, dropping those that a kept one covers."""
    n, m = len(x), min(CANDIDATES, len(x) - 1)
    if m < 1:
        return [np.zeros(0, np.int64)] * n
    out = []
    for at in range(0, n, 256):
        sim = x[at:at + 256] @ x.T
        b = np.arange(len(sim))
        sim[b, at + b] = -2
        near = np.argpartition(-sim, m - 1, axis=1)[:, :m]
        s = np.take_along_axis(sim, near, 1)
        order = np.lexsort((near, -s), axis=1)
        near, s = np.take_along_axis(near, order, 1), np.take_along_axis(s, order, 1)
        dist = np.sqrt(np.maximum(0, 2 - 2 * s))
        y = x[near]
        between = np.sqrt(np.maximum(0, 2 - 2 * (y @ y.transpose(0, 2, 1))))
        left, keep = np.ones(near.shape, bool), np.zeros(near.shape, bool)
        for _ in range(min(DEGREE, m)):
            j = left.argmax(1)
            some = left[b, j]
            if not some.any():
                break
            keep[b[some], j[some]] = True
            left &= ALPHA * between[b, j] > dist
            left[b, j] = False
        out += [row[k] for row, k in zip(near, keep, strict=True)]
    return out


def _build(rows: pa.Table) -> pa.Table:
    """Adjacency lists of one part of a shard."""
    ids = rows.column("v").to_numpy()
    near = robust_prune(unit(rows.column("x")))
    return pa.table([pa.array(ids), pa.array([ids[a] for a in near], pa.list_(pa.int64()))], names=["v", "near"])


class Graph:
    """The united graph of a part's members: lists for the beam, edges both ways for the expansion."""

    def __init__(self, x: np.ndarray, edges: np.ndarray):
        """edges: (2, e) places of members, from and to."""
        self.n = n = len(x)
        self.x = x
        self.flat = np.concatenate([x, np.zeros((1, x.shape[1]))]).astype(np.float32)  # the last is no member
        e = np.unique(edges, axis=1)
        rank = np.arange(e.shape[1]) - np.searchsorted(e[0], e[0])
        self.out = np.full((n + 1, max(1, rank.max(initial=0) + 1)), n)
        self.out[e[0], rank] = e[1]
        e = np.unique(np.concatenate([e, e[::-1]], axis=1), axis=1)
        self.both, self.first = e[1], np.searchsorted(e[0], np.arange(n + 1))
        self.medoid = int((x @ x.mean(0)).argmax())

    def _new(self, q: np.ndarray, seen: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, member, cosine) of those pairs that were not seen before; they are now."""
        key = np.unique((i * (self.n + 1) + j)[~seen[i, j]])
        i, j = key // (self.n + 1), key % (self.n + 1)
        seen[i, j] = True
        s = np.empty(len(i), np.float32)
        for at in range(0, len(i), 1 << 15):
            t = slice(at, at + (1 << 15))
            s[t] = np.einsum("ij,ij->i", q[i[t]], self.flat[j[t]])
        return i, j, s

    def search(self, queries: np.ndarray, own: np.ndarray, limit: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) pairs found with cosine >= limit.  own: each query's place, or the
        number of members if it is none of them."""
        n, m, reach = self.n, len(queries), np.float32(limit - SLACK)
        q = queries.astype(np.float32)
        seen = np.zeros((m, n + 1), bool)
        seen[:, n] = True
        at, sim, open_ = np.full((m, beam), n), np.full((m, beam), -np.inf, np.float32), np.zeros((m, beam), bool)
        rows = np.arange(m)
        got = []
        i, j, s = self._new(q, seen, np.concatenate([rows, rows]), np.concatenate([np.full(m, self.medoid), own]))
        while True:
            hit = s >= reach
            got.append((i[hit], j[hit]))
            # what was seen now joins the beam, which keeps its best
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            wide = rank.max(initial=-1) + 1
            ta, ts, to = (np.full((m, wide), v, k) for v, k in ((n, np.int64), (-np.inf, np.float32), (False, bool)))
            ta[i, rank], ts[i, rank], to[i, rank] = j, s, True
            at, sim, open_ = np.concatenate([at, ta], 1), np.concatenate([sim, ts], 1), np.concatenate([open_, to], 1)
            best = np.argsort(-sim, axis=1, kind="stable")[:, :beam]
            at, sim, open_ = (np.take_along_axis(a, best, 1) for a in (at, sim, open_))
            turn = open_ & (np.cumsum(open_, axis=1) <= FOLLOW)
            i, k = np.nonzero(turn)
            if not len(i):
                break
            open_ &= ~turn
            near = self.out[at[i, k]]
            i, j, s = self._new(q, seen, np.repeat(i, near.shape[1]), near.ravel())
        i, j = (np.concatenate(a) for a in zip(*got, strict=True))
        found = [(i, j)]
        while len(i):  # every node within reach is followed
            count = self.first[j + 1] - self.first[j]
            start = np.repeat(self.first[j] - np.cumsum(count) + count, count)
            i, j, s = self._new(q, seen, np.repeat(i, count), self.both[start + np.arange(count.sum())])
            i, j = i[s >= reach], j[s >= reach]
            found.append((i, j))
        i, j = (np.concatenate(a) for a in zip(*found, strict=True))
        ok = np.concatenate([np.einsum("ij,ij->i", queries[i[t:t + (1 << 15)]], self.x[j[t:t + (1 << 15)]]) >= limit for t in range(0, len(i), 1 << 15)] or [np.zeros(0, bool)])
        return i[ok], j[ok]


def every(x: np.ndarray, q: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) pairs with cosine >= limit, by comparing all."""
    i, j = np.nonzero(q @ x.T >= limit - 1e-9)
    ok = np.einsum("ij,ij->i", q[i], x[j]) >= limit
    return i[ok], j[ok]


class Forest:
    """A spanning forest of links that come step by step; holds a number for each member."""

    def __init__(self, members: int):
        self.comp = np.arange(members)
        self.a: list[int] = []
        self.b: list[int] = []

    def add(self, query: int, own: int, ids: np.ndarray, other: np.ndarray) -> None:
        """Links of a node with the members at the places `other`.  own: its place, if it is a member."""
        comp, first = np.unique(self.comp[other], return_index=True)
        mine = self.comp[own] if own < len(ids) else -1
        new = ids[other[first[comp != mine]]].tolist()
        self.a += [query] * len(new)
        self.b += new
        if len(new) + (mine >= 0) > 1:
            old = np.union1d(comp, mine) if mine >= 0 else comp
            self.comp[np.isin(self.comp, old)] = old[0]


def _find(limit: float):
    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        kind = pa.schema([("v", pa.int64()), ("n", pa.int64()), ("w", pa.int64()), ("hits", pa.int64()), ("true_hits", pa.int64()), ("beam", pa.int64())])
        if not members.num_rows or not queries.num_rows:
            return kind.empty_table()
        members = members.sort_by("v")
        ids, weight = members.column("v").to_numpy(), members.column("weight").to_numpy()
        primary = members.column("main").to_numpy()
        x = unit(members.column("x"))
        lists = members.column("near").combine_chunks()
        to = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        frm = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
        place = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
        here = ids[place] == to  # neighbours of other shards are searched there
        graph = Graph(x, np.stack([frm[here], place[here]]))
        queries = queries.sort_by("qv")
        qid, q = queries.column("qv").to_numpy(), unit(queries.column("qx"))
        own = np.minimum(np.searchsorted(ids, qid), len(ids) - 1)
        own = np.where(ids[own] == qid, own, len(ids))
        audit = np.flatnonzero(queries.column("audit").to_numpy())

        def look(rows: np.ndarray, beam: int):
            """Links of the queries, step by step."""
            for at in range(0, len(rows), STEP):
                t = rows[at:at + STEP]
                i, j = graph.search(q[t], own[t], limit, beam) if beam <= WIDEST else every(x, q[t], limit)
                i = t[i]
                yield t, i[own[i] != j], j[own[i] != j]

        true_hits = sum(int((own[audit[at:at + STEP]][i] != j).sum()) for at in range(0, len(audit), STEP) for i, j in [every(x, q[audit[at:at + STEP]], limit)])
        beam = BEAM
        while (hits := sum(len(i) for _, i, _ in look(audit, beam))) < true_hits:
            beam *= 2
        n, tree = np.zeros(len(qid), np.int64), Forest(len(ids))
        for t, i, j in look(np.arange(len(qid)), beam):
            mine = primary[j]
            np.add.at(n, i[mine], weight[j[mine]])
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            cut = np.flatnonzero(np.diff(i)) + 1
            for k, other in zip(i[np.concatenate([[0], cut])].tolist() if len(i) else [], np.split(j, cut), strict=False):
                tree.add(int(qid[k]), int(own[k]), ids, other)
        m = len(tree.a)
        return pa.table([np.concatenate([qid, np.array(tree.a, np.int64)]), np.concatenate([n, np.zeros(m, np.int64)]), pa.array([None] * len(qid) + tree.b, pa.int64()),
                         pa.array([hits] + [0] * (len(qid) + m - 1), pa.int64()), pa.array([true_hits] + [0] * (len(qid) + m - 1), pa.int64()), pa.array([beam] + [0] * (len(qid) + m - 1), pa.int64())], schema=kind)

    return run


# ---------------------------------------------------------------- the operator

def link(vectors: DataFrame, limit: float = 0.93) -> tuple[DataFrame, DataFrame]:
    """(rows: vec_id, n_links, component_id, kept; audit: hits and true hits of the parts, and the
    widest beam that a part took; beyond `WIDEST` it compared all members)."""
    prep(vectors.sparkSession)
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("string").alias("label"))
    good = src.where(valid("x", "label") & F.col("vec_id").isNotNull()).withColumn("grp", F.concat(F.size("x").cast("string"), F.lit("/"), F.col("label"))).withColumn("x", F.transform("x", lambda v: v + F.lit(0.0)))
    good = good.select("vec_id", F.xxhash64("grp", "x").alias("h"), "grp", "x")  # h: cheap to sort by
    copies = good.groupBy("h", "grp", "x").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    # the node's key holds for good once it is written
    nodes = stage(copies.withColumn("v", F.monotonically_increasing_id()), "nodes")

    # centres of each label on a bounded sample
    total = stage(nodes.groupBy("grp").agg(F.count("*").alias("total")), "labels")
    likely = F.pmod(F.xxhash64("v", F.lit(7)), F.lit(1 << 30)) <= F.lit(1.2 * FIT * (1 << 30)) / F.col("total") + F.lit(1 << 16)
    rank = Window.partitionBy("grp").orderBy(F.xxhash64("v"), "v")
    sample = nodes.join(sent(total), "grp").where((F.col("total") <= FIT) | likely).select("grp", "v", "x", "total").withColumn("r", F.row_number().over(rank)).where(F.col("r") <= FIT).drop("r")
    centres = stage(sample.groupBy("grp").applyInArrow(_centres(SHARD, CENTRES), "grp string, shard int, centre array<double>, parts int"), "centres")

    blocks = total.select("grp", F.ceil(F.col("total") / F.lit(ASSIGN)).cast("int").alias("blocks"))
    held = nodes.join(sent(blocks), "grp").select("grp", "v", "x", "weight", (F.col("least") % 20 == 0).alias("audit"), F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int").alias("b"))
    aims = centres.join(blocks, "grp").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    placed = stage(apart(held).groupBy("grp", "b").cogroup(apart(aims).groupBy("grp", "b")).applyInArrow(_assign(limit), PLACED), "placed")
    own = ("grp", "v", "x", "weight", "audit")
    members = placed.select(*own, F.explode(F.filter("at", lambda p: p["rank"] < OVERLAP)).alias("p")).select(*own, "p.*")
    asks = placed.select(*own, F.explode(F.filter("at", lambda p: p["asks"])).alias("p")).select(*own, "p.*")
    lists = members.groupBy("grp", "shard", "part").applyInArrow(_build, "v long, near array<bigint>")
    union = stage(lists.groupBy("v").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "adjacency")
    hold = members.join(union, "v").select("grp", "shard", "part", "v", "x", "weight", (F.col("rank") == 0).alias("main"), "near")
    # every node searches all parts of the shards it probes, and a part meets every block of these nodes
    asked = asks.groupBy("grp", "shard").agg(F.ceil(F.count("*") / F.lit(ASKING)).cast("int").alias("blocks"))
    hold = hold.join(asked, ["grp", "shard"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    ask = asks.join(asked, ["grp", "shard"]).select(
        F.col("grp").alias("qg"), F.col("shard").alias("qs"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("qp"),
        F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int").alias("qb"), F.col("v").alias("qv"), F.col("x").alias("qx"), "audit")
    got = stage(apart(hold).groupBy("grp", "shard", "part", "block").cogroup(apart(ask).groupBy("qg", "qs", "qp", "qb")).applyInArrow(_find(limit), "v long, n long, w long, hits long, true_hits long, beam long"), "links")

    # components of nodes, named by their smallest id; an id over several vectors ties them
    name = nodes.select("v", "least")
    ties = got.where("w is not null").join(name, "v").select(F.col("least").alias("u"), F.col("w").alias("v")).join(name, "v").select("u", F.col("least").alias("v"))
    count = got.where("w is null").groupBy("v").agg(F.sum("n").alias("n"))
    per = nodes.join(count, "v").select("h", "grp", "x", "least", (F.col("n") + F.col("weight") - 1).alias("n_links"))
    rows = stage(good.join(per, ["h", "grp", "x"]).select("vec_id", "n_links", "least"), "rows")
    again = rows.groupBy("vec_id").agg(F.min("least").alias("u"), F.max("least").alias("m")).where("u < m").select("vec_id", "u")
    ties = ties.unionAll(rows.join(again, "vec_id").select("u", F.col("least").alias("v")))
    comp = components(ties).select(F.col("v").alias("least"), "comp")
    out = rows.join(comp, "least", "left").select("vec_id", "n_links", F.coalesce("comp", "least").alias("component_id"))
    bad = src.where(~(valid("x", "label") & F.col("vec_id").isNotNull())).select("vec_id", F.lit(0).cast("long").alias("n_links"))
    # a row that takes no part shares the vertex of its id
    known = rows.select("vec_id", "least").join(comp, "least", "left").groupBy("vec_id").agg(F.min(F.coalesce("comp", "least")).alias("c"))
    bad = bad.join(known, "vec_id", "left").select("vec_id", "n_links", F.coalesce("c", "vec_id").alias("component_id"))
    out = out.unionAll(bad).withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))
    return out, got.agg(F.sum("hits").alias("hits"), F.sum("true_hits").alias("true_hits"), F.max("beam").alias("beam"))
