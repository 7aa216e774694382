"""Removal of repeated strings of 400 bytes (or another length) by a common-prefix-aware distributed merge sort.

A byte goes when a string of that length over it also starts anywhere else in the input.
Sorting every suffix of the corpus would multiply it by hundreds, so a sparse suffix set is
sorted that provably decides every window (string of that length):

1. Anchors.  A window's anchor is its string of a quarter of that length with the smallest
   hash (leftmost at ties).
   Equal windows have equal anchors at equal offsets, so two equal windows always meet at an
   anchor string that occurs twice.  One anchor serves a run of windows [lo, hi].
2. Candidates.  Anchor hashes are counted over the corpus (grouped, pre-aggregated); only
   anchors whose string occurs again go on.
3. Runs.  Each task sorts the suffixes at its candidate anchors (the suffix from the anchor to
   its last window's end, then the bytes before the anchor, read backwards), collapses equal
   ones to one entry with a count, and front-codes the run: the length of the prefix shared
   with the entry before it, and the rest.
4. Exchange.  Runs are cut at sampled splitters over the anchor strings, so that equal anchors
   meet; the front-coded pieces are shuffled by range.
5. Merge.  Each range merges its runs with a loser tree that carries common-prefix lengths:
   where two lengths differ they decide the match, where they are equal bytes are compared
   from there on, so a known prefix is never compared again.
6. Windows.  Neighbours of the merged order that share the anchor string form a group; an
   entry that occurs twice has all its windows repeated, the windows of the others are
   matched in the group by their hash and offset (linear in the group, no pairs).
7. The repeated windows return to their documents and their bytes are cut out.

An anchor string with more than `HOT` occurrences would meet in one range with all its
contexts.  Its windows are counted by (anchor, offset, window hash) in a grouped aggregation
instead, which no hot string can fill; the decision is the same.

Exact but for hash collisions (64 bits in a group, 128 bits for equal entries).

Defined results: a null text is empty; rows that repeat a doc_id are documents of their own,
and what they share counts as repeated; an empty table gives an empty result; extra columns
are ignored or carried as they are.
"""
from __future__ import annotations

import hashlib
import os
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedyard.llm.common import Rolling, mix64, prep, row_key, stage, steps, unstage, utf8

#: Bytes of a window; an anchor string has a quarter of them.
LENGTH = 400
#: Text bytes that the anchor search works on at once (a position takes 24 bits).
PIECE = 1 << 20
#: Front-coded bytes that a range should hold, and bytes of entries in one sorted run.
RANGE_BYTES = 4 << 20
RUN_BYTES = 24 << 20
#: Anchor strings sampled for the splitters.
SPLIT_SAMPLE = 4096
#: Occurrences of one anchor string that a range takes; beyond, its windows are counted one by one.
HOT = 500_000
#: Windows that are matched at once.
MATCH_WINDOWS = 1 << 20


# ---------------------------------------------------------------- anchors

def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, anchor hash) of each anchor, positions in `data`."""
    out = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)]
    at = 0
    while at + length <= len(data):
        end = min(len(data), at + PIECE + length - 1)
        out.append(_piece(data[at:end], off - at, at, length))
        at += PIECE
    a, lo, hi, h = (np.concatenate(x) for x in zip(*out, strict=True))
    return a, lo, hi, h


def _piece(data: np.ndarray, off: np.ndarray, base: int, length: int) -> tuple:
    h = Rolling(data).fixed(length // 4)
    n, w = len(h), length - length // 4 + 1
    key = (h & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)
    # sliding minimum: suffix minima of a block and prefix minima of the next
    pad = -n % w
    k = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
    pre = np.minimum.accumulate(k, axis=1).reshape(-1)
    suf = np.minimum.accumulate(k[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    m = n - w + 1
    low = np.minimum(suf[:m], pre[w - 1:w - 1 + m])
    # windows within one document: none of its bytes but the first may start a document
    ok = np.ones(m, bool)
    edge = off[(off > 0) & (off < len(data))]
    if len(edge):
        d = np.zeros(m + 1, np.int64)
        np.add.at(d, np.clip(edge - length + 1, 0, m), 1)
        np.add.at(d, np.clip(edge, 0, m), -1)
        ok = np.cumsum(d[:-1]) == 0
    p = np.flatnonzero(ok)
    if not len(p):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    a = (low[p] & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(p)]]) - 1
    a, lo, hi = a[first], p[first], p[last]
    return a + base, lo + base, hi + base, h[a]


def _documents(docs: DataFrame, carry: Sequence[str]) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in carry]).alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("k1"), row_key().alias("k2"), text.alias("text"))


def _anchor_rows(src: DataFrame, length: int) -> DataFrame:
    """(h, k1, k2, at): one row per anchor; at = anchor, first and last window (packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text", PIECE):
            data, off = utf8(b.column("text"))
            a, lo, hi, h = anchors(data, off, length)
            if not len(a):
                continue
            r = np.searchsorted(off, lo, "right") - 1
            start = off[r]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), b.column("k1").take(pa.array(r)), b.column("k2").take(pa.array(r)),
                 pa.array(a - start), pa.array((a - lo).astype(np.int32)), pa.array((hi - lo).astype(np.int32))],
                names=["h", "k1", "k2", "a", "back", "more"])

    return src.select("k1", "k2", "text").mapInArrow(run, "h long, k1 long, k2 long, a long, back int, more int")


# ---------------------------------------------------------------- sorted runs

def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, given that the first `at` bytes agree."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    step = 32
    while a[at:at + step] == b[at:at + step]:
        at += step
    return at + len(os.path.commonprefix((a[at:at + step], b[at:at + step])))


#: An entry: right (anchor to the end of the last window), left (before the anchor, reversed),
#: windows less one, count.  Entries sort by right, left, windows.
def front_code(entries: list[tuple[bytes, bytes, int, int]]) -> bytes:
    out, before = [], b""
    for right, left, more, count in entries:
        c = common(before, right)
        tail = right[c:]
        out.append(b"".join((c.to_bytes(2, "little"), len(tail).to_bytes(2, "little"), len(left).to_bytes(2, "little"), more.to_bytes(2, "little"), count.to_bytes(4, "little"), tail, left)))
        before = right
    return b"".join(out)


def decode(run: bytes) -> Iterator[tuple[int, tuple[bytes, bytes, int, int]]]:
    """(prefix shared with the entry before, entry) of a front-coded run."""
    at, before, n = 0, b"", len(run)
    while at < n:
        c, t, m = (int.from_bytes(run[at + i:at + i + 2], "little") for i in (0, 2, 4))
        more, count = int.from_bytes(run[at + 6:at + 8], "little"), int.from_bytes(run[at + 8:at + 12], "little")
        at += 12
        before = before[:c] + run[at:at + t]
        yield c, (before, run[at + t:at + t + m], more, count)
        at += t + m


def entry_key(right: bytes, left: bytes, more: int) -> bytes:
    return hashlib.blake2b(right + left, digest_size=16, salt=(len(left) * 1024 + more).to_bytes(8, "little")).digest()


def merge(runs: list[bytes]) -> Iterator[tuple[int, tuple[bytes, bytes, int, int]]]:
    """Loser tree over front-coded runs: (prefix of `right` shared with the entry put out
    before, entry) in the order of `right`."""
    src = [decode(r) for r in runs]
    size = 1
    while size < len(src):
        size *= 2
    head: list = [None] * size
    lcp = [0] * size  # with the entry put out last
    for i, s in enumerate(src):
        x = next(s, None)
        head[i] = x[1] if x else None

    def play(i: int, j: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix is set against the winner."""
        if head[i] is None:
            return j, i
        if head[j] is None:
            return i, j
        if lcp[i] != lcp[j]:
            return (i, j) if lcp[i] > lcp[j] else (j, i)
        a, b = head[i][0], head[j][0]
        c = common(a, b, lcp[i])
        if a[c:c + 1] < b[c:c + 1] or (a[c:c + 1] == b[c:c + 1] and i < j):
            lcp[j] = c
            return i, j
        lcp[i] = c
        return j, i

    loser = [0] * size
    level = list(range(size))
    for lvl in range(size.bit_length() - 1):
        up = []
        for k in range(0, len(level), 2):
            w, lo = play(level[k], level[k + 1])
            loser[(size >> (lvl + 1)) + k // 2] = lo
            up.append(w)
        level = up
    w = level[0]
    while head[w] is not None:
        yield lcp[w], head[w]
        x = next(src[w], None)
        head[w], lcp[w] = (x[1], x[0]) if x else (None, 0)
        node = (size + w) >> 1
        while node:
            w, loser[node] = play(w, loser[node])
            node >>= 1


def _runs(joined: DataFrame, splitters: list[bytes], length: int) -> DataFrame:
    """(part, run): front-coded pieces of the sorted candidate suffixes of each task."""

    def cut(have: dict) -> Iterator[tuple[int, bytes]]:
        rows = sorted((r, le, m, c) for (r, le, m), c in have.items())
        piece, part = [], None
        for e in rows:
            p = bisect_right(splitters, e[0][:length // 4])
            if p != part:
                if piece:
                    yield part, front_code(piece)
                piece, part = [], p
            piece.append(e)
        if piece:
            yield part, front_code(piece)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[tuple, int] = {}
        size = 0

        def out() -> pa.RecordBatch:
            got = list(cut(have))
            return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.binary())], names=["part", "run"])

        for b in batches:
            for text, aa, bb, mm in zip(*(b.column(c).to_pylist() for c in ("text", "a", "back", "more")), strict=True):
                if not aa:
                    continue
                raw = text.encode()
                for a, back, more in zip(aa, bb, mm, strict=True):
                    e = (raw[a:a - back + more + length], raw[a - back:a][::-1], more)
                    n = have.get(e)
                    if n is None:
                        size += length + back + 200
                        have[e] = 1
                    else:
                        have[e] = n + 1
                if size > RUN_BYTES:
                    yield out()
                    have, size = {}, 0
        if have:
            yield out()

    return joined.select("text", "a", "back", "more").mapInArrow(run, "part int, run binary")


# ---------------------------------------------------------------- repeated windows

def repeated(group: list[list[tuple[bytes, bytes, int, int]]], length: int = LENGTH) -> Iterator[tuple[bytes, int, int]]:
    """For groups of entries that share their anchor string: (entry key, first, last) of the
    runs of windows that occur twice, counted from the entry's first window."""
    items = [(g, e) for g, es in enumerate(group) for e in es]
    # offsets are dealt in blocks, so that a large group is matched in bounded memory
    total = sum(e[2] + 1 for _, e in items)
    blocks = max(1, -(-total // MATCH_WINDOWS))
    width = -(-(length - length // 4 + 1) // blocks)
    marks = [np.full(e[2] + 1, e[3] > 1) for _, e in items]
    if all(m[0] for m in marks):
        blocks = 0
    for k in range(blocks):
        keys, own = [], []
        for at in range(0, len(items), 1024):
            part = items[at:at + 1024]
            size = np.array([len(e[0]) + len(e[1]) for _, e in part])
            base = np.concatenate([[0], np.cumsum(size)])
            roll = Rolling(np.frombuffer(b"".join(e[1][::-1] + e[0] for _, e in part), np.uint8)).fixed(length)
            back = np.array([len(e[1]) for _, e in part])
            more = np.array([e[2] for _, e in part])
            # window w of an entry starts back - w before the anchor
            lo = np.maximum(0, back - (k + 1) * width + 1)
            hi = np.minimum(more, back - k * width)
            n = np.maximum(0, hi - lo + 1)
            row = np.repeat(np.arange(len(part)), n)
            w = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[row]
            g = np.array([x[0] for x in part], np.uint64)[row]
            keys.append(mix64(roll[base[row] + w] ^ mix64((back[row] - w).astype(np.uint64) + (g << np.uint64(20)) + np.uint64(1))))
            own.append(np.stack([row + at, w]))
        key, who = np.concatenate(keys), np.concatenate(own, axis=1)
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = key[1:] == key[:-1]
        twice = np.zeros(len(key), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = who[:, order[twice]]
        order = np.argsort(hit[0], kind="stable")
        r, w = hit[0][order], hit[1][order]
        for i, ws in zip(*_split(r, w), strict=True):
            marks[i][ws] = True
    for (_, e), m in zip(items, marks, strict=True):
        if m.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], m.astype(np.int8), [0]])))
            key = entry_key(e[0], e[1], e[2])
            for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                yield key, a, z - 1


def _split(r: np.ndarray, w: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    if not len(r):
        return [], []
    rows, at = np.unique(r, return_index=True)
    return rows.tolist(), np.split(w, at[1:])


def _fold(entries: Iterator[tuple[int, tuple]], anchor: int) -> Iterator[tuple[bool, tuple]]:
    """(starts a group, entry) with the counts of equal entries of different runs added up.
    Entries of equal `right` arrive together, in any order of their other parts."""
    right, first, have = None, True, {}
    for c, e in entries:
        if right is not None and e[0] == right:
            have[e[1:3]] = have.get(e[1:3], 0) + e[3]
            continue
        for i, ((left, more), n) in enumerate(have.items()):
            yield first and not i, (right, left, more, n)
        right, first, have = e[0], c < anchor, {e[1:3]: e[3]}
    for i, ((left, more), n) in enumerate(have.items()):
        yield first and not i, (right, left, more, n)


def _merge_range(length: int):
    return lambda pieces: _merged(pieces, length)


def _merged(pieces: pa.Table, length: int) -> pa.Table:
    out: list[tuple[bytes, int, int]] = []
    groups: list[list] = []
    group: list = []
    size = 0
    for new, e in _fold(merge(pieces.column("run").to_pylist()), length // 4):
        if new and group:
            if len(group) > 1 or group[0][3] > 1:
                groups.append(group)
                size += sum(x[2] + 1 for x in group)
            group = []
            if size > MATCH_WINDOWS // 2:
                out.extend(repeated(groups, length))
                groups, size = [], 0
        group.append(e)
    if group and (len(group) > 1 or group[0][3] > 1):
        groups.append(group)
    out.extend(repeated(groups, length))
    return pa.table([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32())], names=["key", "lo", "hi"])


# ---------------------------------------------------------------- the operator

def _owners(joined: DataFrame, length: int) -> DataFrame:
    """(key, k1, k2, p): the entry at each candidate anchor, p its first window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, row, p = [], [], []
            for i, (text, aa, bb, mm) in enumerate(zip(*(b.column(c).to_pylist() for c in ("text", "a", "back", "more")), strict=True)):
                raw = text.encode()
                for a, back, more in zip(aa or (), bb or (), mm or (), strict=True):
                    key.append(entry_key(raw[a:a - back + more + length], raw[a - back:a][::-1], more))
                    row.append(i)
                    p.append(a - back)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), b.column("k1").take(at), b.column("k2").take(at), pa.array(p, pa.int64())], names=["key", "k1", "k2", "p"])

    return joined.select("k1", "k2", "text", "a", "back", "more").mapInArrow(run, "key binary, k1 long, k2 long, p long")


def _hot_spans(rows: DataFrame, length: int) -> DataFrame:
    """(k1, k2, x): the repeated windows at anchors of hot strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (text, hot) in enumerate(zip(b.column("text").to_pylist(), b.column("hot").to_pylist(), strict=True)):
                raw = text.encode()
                for x in hot:
                    first = x["a"] - x["back"]
                    w = Rolling(np.frombuffer(raw[first:first + x["more"] + length], np.uint8)).fixed(length)
                    n = len(w)
                    g = int.from_bytes(hashlib.blake2b(raw[x["a"]:x["a"] + length // 4], digest_size=8).digest(), "little", signed=True)
                    own = pa.array([i] * n, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, g)), pa.array(x["back"] - np.arange(n, dtype=np.int32)), pa.array(w.view(np.int64)), b.column("k1").take(own), b.column("k2").take(own),
                                                      pa.array(first + np.arange(n))], names=["g", "d", "w", "k1", "k2", "p"])

    windows = stage(rows.select("k1", "k2", "text", "hot").mapInArrow(run, "g long, d int, w long, k1 long, k2 long, p long"), "windows")
    twice = stage(windows.groupBy("g", "d", "w").agg(F.count("*").alias("n")).where("n > 1").select("g", "d", "w"), "twice")
    return windows.join(twice, ["g", "d", "w"]).select("k1", "k2", F.struct(F.col("p").alias("s"), (F.col("p") + length).alias("e")).alias("x"))


def repeats(docs: DataFrame, carry: Sequence[str] = ("doc_id",), length: int = LENGTH) -> DataFrame:
    """doc (carried columns), text, spans: array of (from, to) byte ranges to remove, maximal,
    in order; one row per document row."""
    prep(docs.sparkSession)
    src = _documents(docs, carry)
    found = stage(_anchor_rows(src, length), "anchors")
    # written, so that both sides of the join are plain shuffles, which Spark splits at a hot hash
    again = stage(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", (F.col("n") > HOT).alias("hot")), "again")
    cand = found.join(again, "h")
    # rows that repeat key and text have the same anchors: list them once
    at = F.struct("a", "back", "more")
    per = cand.groupBy("k1", "k2").agg(F.collect_set(F.when(~F.col("hot"), at)).alias("x"), F.collect_set(F.when(F.col("hot"), at)).alias("y"))
    per = per.select("k1", "k2", *[F.col(f"x.{c}").alias(c) for c in ("a", "back", "more")], F.when(F.size("y") > 0, F.col("y")).alias("hot"))
    joined = stage(src.join(per, ["k1", "k2"], "left").select("doc", "k1", "k2", "text", "a", "back", "more", "hot"), "joined")
    unstage(found)
    some = joined.where("a is not null")  # with any candidate anchor

    size = some.agg(F.sum(F.size("a") * F.lit(length)).alias("b"), F.sum(F.size("a")).alias("n")).first()
    ranges = max(1, -(-int(size["b"] or 0) // RANGE_BYTES))
    splitters: list[bytes] = []
    if ranges > 1:
        share = min(1.0, SPLIT_SAMPLE / size["n"])
        pick = (some.select("text", F.explode(F.filter("a", lambda x: F.pmod(F.xxhash64(x, F.lit(7)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1))).alias("at"))
                .select(F.substring(F.col("text").cast("binary"), (F.col("at") + 1).cast("int"), F.lit(length // 4)).alias("s")).distinct())
        got = sorted(bytes(r["s"]) for r in pick.collect())
        splitters = [got[i * len(got) // ranges] for i in range(1, ranges)] if got else []
        splitters = sorted(set(splitters))
    runs = _runs(some, splitters, length)
    hits = runs.groupBy("part").applyInArrow(_merge_range(length), "key binary, lo int, hi int")
    owned = _owners(some, length).join(hits, "key").select("k1", "k2", F.struct((F.col("p") + F.col("lo")).alias("s"), (F.col("p") + F.col("hi") + length).alias("e")).alias("x"))
    if again.where("hot").limit(1).count():
        owned = owned.unionAll(_hot_spans(joined.where("hot is not null"), length))
    unstage(again)
    spans = owned.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("x")).alias("x"))
    # merge touching ranges: (closed ranges, the open one)
    start = F.struct(F.array().cast("array<struct<s:bigint,e:bigint>>").alias("done"), F.lit(None).cast("struct<s:bigint,e:bigint>").alias("open"))

    def add(acc, x):
        return (F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), x.alias("open")))
                .when(x["s"] <= acc["open"]["e"], F.struct(acc["done"].alias("done"), F.struct(acc["open"]["s"].alias("s"), F.greatest(acc["open"]["e"], x["e"]).alias("e")).alias("open")))
                .otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), x.alias("open"))))

    merged = F.aggregate("x", start, add, lambda acc: F.concat(acc["done"], F.array(acc["open"])))
    spans = spans.select("k1", "k2", merged.alias("spans"))
    ended = some.join(spans, ["k1", "k2"], "left").select("doc", "text", "spans")
    return ended.unionAll(joined.where("a is null").select("doc", "text", F.lit(None).cast("array<struct<s:bigint,e:bigint>>").alias("spans")))


SPACE = b" \t\n\x0b\x0c\r"


def whole_words(raw: bytes, start: int, end: int) -> int:
    """Words that lie wholly within a range of bytes."""
    n = len(raw[start:end].split())
    for at in (start, end):  # an edge within a word
        if n and 0 < at < len(raw) and raw[at - 1] not in SPACE and raw[at] not in SPACE:
            n -= 1
    return n


def cut(docs: DataFrame, carry: Sequence[str] = ("doc_id",), texts: bool = True, length: int = LENGTH, words: int = 0) -> DataFrame:
    """doc, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes) and, with
    `texts`, kept_text (the remaining bytes without characters that a cut has split); one row
    per document row.  words: only ranges of more whole words are cut (0: all)."""
    src = repeats(docs, carry, length)
    names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gone, n, sha, out = [], [], [], [], []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                raw = text.encode()
                keep, at = [], 0
                spans = [x for x in spans or () if not words or whole_words(raw, x["s"], x["e"]) > words]
                for x in spans:
                    keep.append(raw[at:x["s"]])
                    at = x["e"]
                keep.append(raw[at:])
                rest = b"".join(keep)
                size.append(len(raw))
                gone.append(len(raw) - len(rest))
                n.append(len(spans))
                sha.append(hashlib.sha256(rest).hexdigest())
                if texts:
                    out.append("".join(k.decode("utf-8", "ignore") for k in keep))
            yield pa.RecordBatch.from_arrays([b.column("doc"), *(pa.array(x, pa.int64()) for x in (size, gone, n)), pa.array(sha, pa.string()), *([pa.array(out, pa.string())] if texts else [])], names=names)

    return src.mapInArrow(run, f"doc {src.schema['doc'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * texts)


def remove(docs: DataFrame, length: int = LENGTH, words: int = 0) -> DataFrame:
    """`docs` with the repeated strings (of more than `words` words) cut out of `text` and `n_chars` counted anew where
    something was cut; a null text stays null.  A document without text left stays, empty."""
    rest = [c for c in docs.columns if c != "text"]  # the text is a column of its own already
    got = cut(docs.withColumn("_null", F.col("text").isNull()), [*rest, "_null"], length=length, words=words)
    new = {"text": F.when(~F.col("doc._null"), F.col("kept_text"))}
    if "n_chars" in rest:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("doc.n_chars"))
    return got.select(*[(new[c] if c in new else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
