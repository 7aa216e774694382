"""Language identification by interpolated Kneser-Ney character models.

1. Fit sample: of each language at most `SAMPLE` labelled texts (smallest id hashes), a
   documented bound; one in five of them calibrates, the others train.
2. Texts become letters in lower case; everything between letters is one space.  Character
   n-grams of orders 1 to 5 are counted by grouped aggregations.  The highest order keeps
   its counts; a lower order counts the distinct characters seen before an n-gram
   (continuation counts), taken over the distinct n-grams of the order above.
3. A language's model is, for each order, a sorted array of n-gram hashes with counts and
   a sorted array of context hashes with totals and numbers of distinct followers:
   p(c | h) = max(k(hc) - d, 0) / total(h) + d * followers(h) / total(h) * p(c | h'),
   d = n1 / (n1 + 2 n2) of the order, down to a uniform floor.
4. A text gets the language of the lowest cross-entropy per character.  The score is the
   softmax of -slope * sqrt(characters) * cross-entropy, the slope chosen on the calibration
   texts by log loss.  A text is marked rejected when its best cross-entropy is above what
   99.5 % of the calibration texts of that language reach.

Whole texts are scored; documents are only mapped over.

Defined results: a null text or one without letters is `und` with score 0; equal
cross-entropies go to the smallest language name; null labels and null texts teach nothing;
without any learned language every text is `und`; extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedyard.llm.common import STEP_BYTES, mix64, prep, sent, stage, steps, utf8

ORDER = 5
#: Labelled texts of a language that are learned from, at most.
SAMPLE = 2000
#: Symbols of the uniform floor.
ALPHABET = 1 << 16
SLOPES = np.geomspace(0.05, 200, 60)
REJECT = 0.995


@lru_cache(1)
def _symbols() -> np.ndarray:
    """Symbol of each code point: a letter's lower-case code point, else a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def symbols(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a batch, ORDER - 1 spaces before each row, and the rows' ends: row i's
    symbols lie between ends[i] + ORDER - 1 and ends[i + 1]."""
    data, off = utf8(col)
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    off = lead[off]
    sym = _symbols()[cp]
    space = sym == 32
    keep = np.ones(len(sym), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    first = off[:-1][off[:-1] < off[1:]]
    keep[first] = ~space[first]  # the padding stands for a leading space
    off = np.concatenate([[0], np.cumsum(keep)])[off]
    sym = sym[keep]
    pad = ORDER - 1
    out = np.full(len(sym) + pad * (len(off) - 1), 32, np.uint32)
    out[np.arange(len(sym)) + pad * np.repeat(np.arange(1, len(off)), np.diff(off))] = sym
    return out, off + pad * np.arange(len(off))


def grams(sym: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the `order` symbols that end at each position of `at`."""
    h = np.full(len(at), order, np.uint64)
    for j in range(order - 1, -1, -1):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + sym[at - j].astype(np.uint64) + np.uint64(1))
    return h


def _context(sym: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    return grams(sym, at - 1, order - 1) if order > 1 else np.zeros(len(at), np.uint64)


def positions(ends: np.ndarray) -> np.ndarray:
    """Positions of the rows' own symbols."""
    n = np.diff(ends) - (ORDER - 1)
    return np.repeat(ends[:-1] + ORDER - 1, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


# ---------------------------------------------------------------- model

class Model:
    """The languages' sorted hash arrays: per language and order (n-gram hashes, counts,
    context hashes, totals, followers, discount)."""

    def __init__(self, counts: pa.Table):
        lang = np.array(counts.column("lang").to_pylist(), object)
        order = counts.column("o").to_numpy()
        g, c, s = (counts.column(x).to_numpy().view(np.uint64) for x in ("g", "c", "s"))
        n = counts.column("n").to_numpy()
        self.langs = sorted(set(lang.tolist()))
        self.parts: dict = {}
        for name in self.langs:
            mine = lang == name
            above = None
            for o in range(ORDER, 0, -1):
                at = np.flatnonzero(mine & (order == o))
                key, ctx, k = g[at], c[at], n[at].astype(float)
                if above is not None:  # continuation counts from the distinct n-grams above
                    u, m = np.unique(above, return_counts=True)
                    j = np.minimum(np.searchsorted(u, key), len(u) - 1)
                    k = np.where(u[j] == key, m[j], 1).astype(float)
                above = s[at]
                sort = np.argsort(key)
                n1, n2 = (k == 1).sum(), (k == 2).sum()
                d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
                u, inv = np.unique(ctx, return_inverse=True)
                self.parts[name, o] = (key[sort], k[sort], u, np.bincount(inv, k), np.bincount(inv).astype(float), d)

    def logp(self, sym: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(positions, languages) natural log probabilities."""
        out = np.full((len(at), len(self.langs)), 1 / ALPHABET)
        for o in range(1, ORDER + 1):
            key, ctx = grams(sym, at, o), _context(sym, at, o)
            for i, name in enumerate(self.langs):
                g, k, u, total, follow, d = self.parts[name, o]
                j = np.minimum(np.searchsorted(g, key), len(g) - 1)
                c = np.where(g[j] == key, k[j], 0.0)
                x = np.minimum(np.searchsorted(u, ctx), len(u) - 1)
                seen = u[x] == ctx
                p = (np.maximum(c - d, 0) + d * follow[x] * out[:, i]) / total[x]
                out[:, i] = np.where(seen, p, out[:, i])
        return np.log(out)


class Scorer:
    """Model with a table of the n-grams met so far in the task (one per slot of 2^21, by the
    top bits of the hash): an n-gram's probabilities are computed from the sorted arrays
    when it is met first, or again after another one has taken its slot."""

    BITS = 21

    def __init__(self, model: Model):
        self.model = model
        self.keys = np.zeros(1 << self.BITS, np.uint64)
        self.rows = np.zeros((1 << self.BITS, len(model.langs)), np.float32)

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy per row and language, symbols, letters) of a batch."""
        sym, ends = symbols(col)
        rows = len(ends) - 1
        at = positions(ends)
        row = np.repeat(np.arange(rows), np.diff(ends) - (ORDER - 1))
        key = grams(sym, at, ORDER)
        slot = (key >> np.uint64(64 - self.BITS)).astype(np.int64)
        new = np.flatnonzero(self.keys[slot] != key)
        lp = self.rows[slot]
        if len(new):
            u, first, inv = np.unique(key[new], return_index=True, return_inverse=True)
            found = self.model.logp(sym, at[new[first]]).astype(np.float32)
            lp[new] = found[inv]
            to = slot[new[first]]
            self.keys[to], self.rows[to] = u, found
        n = np.bincount(row, minlength=rows)
        out = np.stack([-np.bincount(row, lp[:, i], rows) for i in range(lp.shape[1])], axis=1) / np.maximum(n, 1)[:, None]
        return out, n, np.bincount(row, sym[at] != 32, rows)


# ---------------------------------------------------------------- fitting

#: Texts that a language has at least before some are set aside.
ASIDE = 10


def _counts(sample: DataFrame) -> DataFrame:
    """Distinct n-grams of each order and language: hash, context, suffix, count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text", STEP_BYTES):
            lang = np.array(b.column("lang").to_pylist(), object)
            sym, ends = symbols(b.column("text"))
            at = positions(ends)
            row = np.repeat(np.arange(b.num_rows), np.diff(ends) - (ORDER - 1))
            for name in sorted(set(lang.tolist())):
                mine = at[(lang == name)[row]]
                for o in range(1, ORDER + 1):
                    key, first, n = np.unique(grams(sym, mine, o), return_index=True, return_counts=True)
                    p = mine[first]
                    suffix = grams(sym, p, o - 1) if o > 1 else np.zeros(len(p), np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(key), pa.string()), pa.array(np.full(len(key), o, np.int32)), pa.array(key.view(np.int64)),
                         pa.array(_context(sym, p, o).view(np.int64)), pa.array(suffix.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "o", "g", "c", "s", "n"])

    rows = sample.select("lang", "text").mapInArrow(run, "lang string, o int, g long, c long, s long, n long")
    return rows.groupBy("lang", "o", "g", "c", "s").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> dict | None:
    """labelled: (id, text, lang).  Model, slope and rejection bounds, or None without texts.  At
    most `sample` rows of a language are used, whatever ids they have (null and repeated ones too)."""
    src = labelled.where("text is not null and lang is not null").select(F.xxhash64("id", "text", F.lit(3)).alias("h"), F.col("text").alias("text"), F.col("lang").cast("string").alias("lang"))
    # rows, not ids, are chosen: about half as many again as are kept pass a bound on their hash,
    # equal rows are one, and then the first `sample` of a language stay
    per = stage(src.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")), "languages")
    share = F.lit(1.5 * sample * (1 << 30)) / F.col("n") + F.lit(1 << 14)
    some = src.join(sent(per), "lang").where((F.col("n") <= sample) | (F.pmod(F.xxhash64("h"), F.lit(1 << 30)) <= share))
    some = some.groupBy("lang", "h").agg(F.min("text").alias("text"))
    of = Window.partitionBy("lang")
    rank = F.row_number().over(of.orderBy("h"))
    # a fifth is set aside to calibrate, by rank, where a language has enough texts
    chosen = some.withColumn("r", rank).withColumn("all", F.count("*").over(of)).where(F.col("r") <= sample)
    chosen = stage(chosen.select("lang", "text", ((F.col("r") % 5 == 0) & (F.col("all") >= ASIDE)).alias("aside")), "labelled")
    got = _counts(chosen.where("not aside")).toArrow()
    if not got.num_rows:
        return None
    model = Model(got)
    share = chosen.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(share.value)
        for b in steps(batches, "text"):
            x, n, letters = score(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(n.astype(np.int64)), pa.array(letters.astype(np.int64)), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["lang", "n", "letters", "x"])

    rows = chosen.where("aside").select("lang", "text").mapInArrow(run, "lang string, n long, letters long, x array<double>").where("letters > 0").collect()  # bounded as the sample
    rows = [r for r in rows if r["lang"] in model.langs]
    out = {"model": share, "langs": model.langs, "slope": 5.0, "bound": [float("inf")] * len(model.langs)}
    if rows:
        x, n = np.array([r["x"] for r in rows]), np.array([r["n"] for r in rows])
        y = np.array([model.langs.index(r["lang"]) for r in rows])
        z = [np.log(np.maximum(_softmax(x, n, s)[np.arange(len(y)), y], 1e-6)).mean() for s in SLOPES]
        out["slope"] = float(SLOPES[int(np.argmax(z))])
        out["bound"] = [float(np.quantile(x[y == i, i], REJECT)) if (y == i).any() else float("inf") for i in range(len(model.langs))]
    return out


def _softmax(x: np.ndarray, n: np.ndarray, slope: float) -> np.ndarray:
    z = -slope * np.sqrt(n)[:, None] * (x - x.min(1, keepdims=True))
    e = np.exp(z)
    return e / e.sum(1, keepdims=True)


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred, score, entropy (per character, of the best language), rejected."""
    src = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    names = ["doc_id", "lang_pred", "score", "entropy", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model["model"].value) if model else None
        for b in steps(batches, "text"):
            if model is None:
                k = b.num_rows
                cols = [pa.array(["und"] * k), pa.array([0.0] * k), pa.array([None] * k, pa.float64()), pa.array([True] * k)]
            else:
                x, n, letters = score(b.column("text"))
                best = x.argmin(1)
                has = letters > 0
                p = np.where(has, _softmax(x, n, model["slope"])[np.arange(len(x)), best], 0.0)
                ent = x[np.arange(len(x)), best]
                cols = [pa.array([model["langs"][i] if h else "und" for i, h in zip(best, has, strict=True)], pa.string()), pa.array(p), pa.array(ent, mask=~has),
                        pa.array(~has | (ent > np.array(model["bound"])[best]))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=names)

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, entropy double, rejected boolean")


def held_out(col: Column, mod: int, rest: int) -> Column:
    """crc32(id as text) mod `mod` is `rest`; a null id counts as remainder 0."""
    return F.pmod(F.coalesce(F.crc32(col.cast("string").cast("binary")), F.lit(0)), F.lit(mod)) == rest


def predict(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy, rejected: learned from the documents that
    are not held out."""
    prep(docs.sparkSession)
    out = held_out(F.col("doc_id"), 3, 1)
    model = fit(docs.where(~out).select(F.col("doc_id").alias("id"), "text", "lang"), sample)
    return identify(docs, model).withColumn("held_out", out)
