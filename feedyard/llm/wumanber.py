"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of 10 consecutive words of a benchmark item (an item of fewer words,
but not none, is one pattern).  Patterns of one length form a group with

* a shift table over blocks of two words: how far the window's end may safely move;
* buckets of patterns by the hash of their last block, checked by the hash of their first;
* a direct comparison of the words, first by their hashes, then by their bytes.

A document is walked by many lanes at once (each lane owns a stretch of end positions), and
every lane jumps by the shift of the block it stands on.  Documents are only mapped over, so
nothing is shuffled.  The benchmark is sent to the tasks in blocks of bounded bytes
(`BLOCK_BYTES`); a larger benchmark takes more passes, each adding its hits.

Defined results: a null text has no words; a null item text gives no pattern; rows that
repeat an item_id add to one item; a null item_id is named by the empty string; an empty
benchmark contaminates nothing; extra columns are ignored or carried as they are.
"""
from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedyard.llm.common import ALNUM, Rolling, mix64, prep, stage, steps, utf8, words

WINDOW = 10
#: Benchmark bytes that one pass sends to the tasks.
BLOCK_BYTES = 2 << 20
SHIFT_BITS = 16
#: End positions that one lane of the walk owns.
LANE = 512


def _block(wh: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words that end at word `at`."""
    return mix64(wh[at] * np.uint64(3) + mix64(wh[at - 1])) if size == 2 else mix64(wh[at])


class Group:
    """Patterns of one length: shift table, suffix buckets, the words of each pattern."""

    def __init__(self, length: int, wh: np.ndarray, item: np.ndarray, text: list[bytes]):
        self.length, self.block = length, 2 if length > 1 else 1
        base = np.arange(len(item)) * length
        flat = wh.reshape(-1)
        last = _block(flat, base + length - 1, self.block)
        order = np.argsort(last, kind="stable")
        self.suffix, self.item = last[order], item[order]
        self.prefix = _block(flat, base + self.block - 1, self.block)[order]
        self.words, self.text = wh[order], [text[i] for i in order]
        self.shift = np.full(1 << SHIFT_BITS, length - self.block + 1, np.int64)
        for j in range(self.block - 1, length):
            np.minimum.at(self.shift, (_block(flat, base + j, self.block) >> np.uint64(64 - SHIFT_BITS)).astype(np.int64), length - 1 - j)

    def walk(self, block: np.ndarray, first: np.ndarray) -> np.ndarray:
        """End positions at which the shift table says 0, among those that the jumps visit."""
        lo, hi = first[:-1] + self.length - 1, first[1:]
        ok = lo < hi
        lo, hi = lo[ok], hi[ok]
        lanes = -(-(hi - lo) // LANE)
        row = np.repeat(np.arange(len(lo)), lanes)
        part = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        pos = lo[row] + part * LANE
        end = np.minimum(pos + LANE, hi[row])
        shift = self.shift
        found = []
        while len(pos):
            s = shift[block[pos]]
            found.append(pos[s == 0])
            pos = pos + np.maximum(s, 1)
            on = pos < end
            pos, end = pos[on], end[on]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def matches(self, wh: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last word, pattern) of candidate occurrences, equal in all word hashes."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(wh) < self.length:
            return none
        at = np.arange(len(wh))
        hashed = _block(wh, at, self.block)
        pos = self.walk((hashed >> np.uint64(64 - SHIFT_BITS)).astype(np.int64), first)
        lo = np.searchsorted(self.suffix, hashed[pos], "left")
        count = np.searchsorted(self.suffix, hashed[pos], "right") - lo
        pos, lo, count = pos[count > 0], lo[count > 0], count[count > 0]
        if not len(pos):
            return none
        pat = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        pos = np.repeat(pos, count)
        head = hashed[pos - self.length + self.block] == self.prefix[pat]
        pos, pat = pos[head], pat[head]
        for j in range(self.length):
            same = wh[pos - self.length + 1 + j] == self.words[pat, j]
            pos, pat = pos[same], pat[same]
        return pos, pat


def compile_groups(texts: list[str | None]) -> list[Group]:
    """The groups of all patterns of the items; `Group.item` is a position in `texts`."""
    data, off = utf8(pa.array([t or "" for t in texts], pa.large_string()))
    s, e, first = words(data, off, ALNUM)
    wh = Rolling(data, lower=True).of(s, e)
    low = data.tobytes().lower()
    word = [low[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]
    by: dict[int, list[tuple[int, int]]] = {}
    for i in range(len(texts)):
        a, b = int(first[i]), int(first[i + 1])
        size = min(WINDOW, b - a)
        if size:
            by.setdefault(size, []).extend((p, i) for p in range(a, b - size + 1))
    out = []
    for size, at in sorted(by.items()):
        p = np.array([x[0] for x in at])
        out.append(Group(size, wh[p[:, None] + np.arange(size)], np.array([x[1] for x in at]),
                         [b" ".join(word[x:x + size]) for x in p.tolist()]))
    return out


def find(groups: list[Group], data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each row, hit flag of each word, (row, item) pairs that occur)."""
    s, e, first = words(data, off, ALNUM)
    wh = Rolling(data, lower=True).of(s, e)
    edge = np.zeros(len(s) + 1, np.int64)
    seen: set[tuple[int, int]] = set()
    raw = data.tobytes()
    for g in groups:
        pos, pat = g.matches(wh, first)
        rows = np.searchsorted(first, pos, "right") - 1
        for p, t, r in zip(pos.tolist(), pat.tolist(), rows.tolist(), strict=True):
            a = p - g.length + 1
            if b" ".join(raw[s[i]:e[i]] for i in range(a, p + 1)).lower() == g.text[t]:
                edge[a] += 1
                edge[p + 1] -= 1
                seen.add((r, int(g.item[t])))
    return first, np.cumsum(edge[:-1]) > 0, np.array(sorted(seen), np.int64).reshape(-1, 2)


_COMPILED: dict[str, tuple] = {}


def _scan(src: DataFrame, block, more: bool) -> DataFrame:
    """One pass: (doc, text, hits, items) with the hits and items of a block added."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _COMPILED:
            _COMPILED.clear()
            _COMPILED[key] = (compile_groups(block.value[1]), block.value[0])
        groups, names = _COMPILED[key]
        for b in steps(batches, "text"):
            data, off = utf8(b.column("text"))
            first, hit, pairs = find(groups, data, off)
            had = b.column("hits").to_pylist()
            items = [set(x or ()) for x in b.column("items").to_pylist()]
            for r, i in pairs.tolist():
                items[r].add(names[i])
            hits, n_hit = [], []
            for r in range(b.num_rows):
                h = hit[first[r]:first[r + 1]]
                if had[r]:
                    h = h | np.unpackbits(np.frombuffer(had[r], np.uint8))[:len(h)].astype(bool)
                n_hit.append(int(h.sum()))
                hits.append(np.packbits(h).tobytes() if more and n_hit[-1] else None)
            ordered = [sorted(x) for x in items]
            cols = [b.column("doc"), *([b.column("text")] if more else []), pa.array(hits, pa.binary()), pa.array(ordered, pa.list_(pa.string())),
                    pa.array(np.diff(first)), pa.array(n_hit, pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in ordered])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", *(["text"] if more else []), "hits", "items", "n_words", "n_hit", "items_sha256"])

    doc = src.schema["doc"].dataType.simpleString()
    return src.mapInArrow(run, f"doc {doc}, " + "text string, " * more + "hits binary, items array<string>, n_words long, n_hit long, items_sha256 string")


def contamination(docs: DataFrame, benchmark: DataFrame, carry: Sequence[str] = ("doc_id",), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc (struct of the carried columns), items (ids as sorted strings), n_words, n_hit,
    items_sha256: one row per document row."""
    spark = prep(docs.sparkSession)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.col("text").alias("t")).where("t is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // block_bytes))
    src = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in carry]).alias("doc"), F.col("text").alias("text"),
                      F.lit(None).cast("binary").alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    for i in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == i).collect()  # about block_bytes
        block = spark.sparkContext.broadcast(([r["id"] for r in rows], [r["t"] for r in rows]))
        src = _scan(src, block, more=i < blocks - 1)
        if i < blocks - 1:
            src = stage(src.select("doc", "text", "hits", "items"), "hits")
    return src.select("doc", "items", "n_words", "n_hit", "items_sha256")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` in which no benchmark window occurs."""
    return contamination(docs, benchmark, carry=docs.columns).where("n_hit = 0").select("doc.*")
