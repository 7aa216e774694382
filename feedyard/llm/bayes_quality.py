"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

1. Two document classifiers (low quality, toxic) are fitted on the labelled documents, at
   most `SAMPLE` of them (smallest id hashes).  Their inputs are ten shape ratios of the
   text and the presence of the `MARKERS` words and
   six-byte word stems that tell most about either label
   (likelihood ratio, counted by a grouped aggregation); ridge logistic regression on the
   bounded sample gives the weights.
2. Every document of the corpus is scored on its whole text.
3. The scores of all documents are summed by host and by path in the host.  The spread
   between hosts, less what counting alone explains, gives the strength of the prior
   (method of moments); a host's rate is shrunk to the global rate, a path's to its host's.
   Sparse sites thus stay near the prior, large ones speak for themselves.
4. A document's odds are its classifier's odds times the path's posterior odds over the
   global odds.  It is rejected when either probability passes one half.

Documents are mapped over; only (host, path) sums are shuffled, pre-aggregated in the tasks.

Defined results: a null or empty text is scored as the empty text (never rejected: it has no
evidence); null host or path are values of their own; several labels of one doc_id count as
their maximum, null labels as 0; without labels or without positive labels nothing is rejected; extra columns
are ignored or carried as they are.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedyard.llm.common import ALNUM, SPACED, Rolling, prep, stage, steps, unstage, utf8, words

#: Labelled documents that the classifiers are fitted on, at most.
SAMPLE = 20_000
#: Words and word stems whose presence is an input, half of them for each label.
MARKERS = 512
#: Bytes of a stem.
STEM = 6
#: Likelihood ratio that a marker must reach.
MARKER_G2 = 12.0
RIDGE = 0.5
TARGETS = ("low", "toxic")

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = ~(ALNUM | np.isin(np.arange(256), [9, 10, 11, 12, 13, 32, 33, 34, 39, 44, 45, 46, 58, 59, 63, 124]))
SHAPES = 10


def _tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and of the stems of longer words, and their rows."""
    s, e, first = words(data, off, ALNUM)
    roll = Rolling(data, lower=True)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    long_ = e - s > STEM
    stem = ~roll.of(s[long_], s[long_] + STEM)
    return np.concatenate([roll.of(s, e), stem]), np.concatenate([row, row[long_]])


def features(col: pa.Array, markers: np.ndarray) -> np.ndarray:
    """(rows, SHAPES + markers): ratios of the text, then presence of each marker word."""
    data, off = utf8(col)
    rows = len(off) - 1
    out = np.zeros((rows, SHAPES + len(markers)))

    def count(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[off])

    size = np.maximum(np.diff(off), 1)
    letters = np.maximum(count(_LETTER[data]), 1)
    s, e, first = words(data, off, SPACED)
    n = np.maximum(np.diff(first), 1)
    h = Rolling(data, lower=True).of(s, e)
    row = np.repeat(np.arange(rows), np.diff(first))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    out[:, 0] = count(_UPPER[data]) / letters
    out[:, 1] = count(_SYMBOL[data]) / size
    out[:, 2] = count(data == 33) / n
    out[:, 3] = count(data == 124) / n
    out[:, 4] = count(_DIGIT[data]) / size
    out[:, 5] = np.bincount(row[order][new], minlength=rows) / n
    out[:, 6] = np.bincount(row[again], minlength=rows) / n
    out[:, 7] = size / n / 10
    out[:, 8] = np.log1p(np.diff(first)) / 10
    out[:, 9] = count(data == 10) / n
    if len(markers):
        wh, row = _tokens(data, off)
        at = np.minimum(np.searchsorted(markers, wh), len(markers) - 1)
        hit = markers[at] == wh
        out[row[hit], SHAPES + at[hit]] = 1
    return out


def _word_counts(sample: DataFrame) -> DataFrame:
    """word hash, documents that hold it, of these low ones, of these toxic ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            data, off = utf8(b.column("text"))
            low, tox = (b.column(c).to_numpy(zero_copy_only=False) for c in TARGETS)
            h, row = _tokens(data, off)
            if not len(h):
                continue
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            row = row[new]
            w, at = np.unique(h[new], return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(w.view(np.int64)), *(pa.array(np.bincount(at, x, len(w)).astype(np.int64)) for x in (np.ones(len(row)), low[row], tox[row]))],
                names=["w", "n", *TARGETS])

    return (sample.select("text", *TARGETS).mapInArrow(run, "w long, n long, low long, toxic long")
            .groupBy("w").agg(F.sum("n").alias("n"), *[F.sum(t).alias(t) for t in TARGETS]))


def _markers(sample: DataFrame, total: int, pos: dict[str, int]) -> np.ndarray:
    """Hashes of the words that hold most evidence for a label (both labels' best halves)."""
    counts = _word_counts(sample).where("n >= 4")
    found: set[int] = set()
    for t in TARGETS:
        if not 0 < pos[t] < total:
            continue
        rate = pos[t] / total
        a, n = F.col(t).cast("double"), F.col("n").cast("double")
        part = lambda x, m: F.when(x > 0, x * F.log(x / m)).otherwise(0.0)
        g2 = 2 * (part(a, n * rate) + part(n - a, n * (1 - rate)))
        best = counts.withColumn("g2", g2).where((a > n * rate) & (F.col("g2") >= MARKER_G2)).orderBy(F.desc("g2"), "w").limit(MARKERS // 2)
        found |= {r["w"] for r in best.select("w").collect()}
    return np.sort(np.array(sorted(found), np.int64).view(np.uint64))


def fit_logistic(shapes: np.ndarray, marks: np.ndarray, y: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps on standardised inputs: weights, intercept.
    Inputs are rows of shapes and of packed marker bits; they are unpacked block by block."""
    if not 0 < y.sum() < len(y):
        return np.zeros(width), -12.0 if y.sum() == 0 else 0.0

    def raw() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(0, len(y), 1024):
            bits = np.unpackbits(marks[i:i + 1024], axis=1, count=width - SHAPES)
            yield np.hstack([shapes[i:i + 1024], bits]).astype(float), y[i:i + 1024]

    mean = sum(x.sum(0) for x, _ in raw()) / len(y)
    sd = np.maximum(np.sqrt(sum(((x - mean) ** 2).sum(0) for x, _ in raw()) / len(y)), 1e-3)

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for x, yy in raw():
            yield np.hstack([np.ones((len(x), 1)), (x - mean) / sd]), yy

    w = np.zeros(width + 1)
    pen = np.full(len(w), RIDGE)
    pen[0] = 0

    def loss(w: np.ndarray) -> float:
        return sum(float((np.logaddexp(0, z @ w) - yy * (z @ w)).sum()) for z, yy in blocks()) + 0.5 * float((pen * w * w).sum())

    here = loss(w)
    for _ in range(60):
        g, h = pen * w, np.diag(pen + 1e-9)
        for z, yy in blocks():
            p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
            g = g + z.T @ (p - yy)
            h = h + (z * (p * (1 - p) + 1e-9)[:, None]).T @ z
        step = np.linalg.solve(h, g)
        rate, new = 1.0, loss(w - step)
        while rate > 1e-4 and new > here:
            rate /= 2
            new = loss(w - rate * step)
        w, before, here = w - rate * step, here, new
        if before - here < 1e-6 * max(1.0, before):
            break
    return w[1:] / sd, float(w[0] - (w[1:] * mean / sd).sum())


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """The two document classifiers: marker hashes and (weights, intercept) per target."""
    lab = (labels.where("doc_id is not null").groupBy("doc_id").agg((1 - F.min(F.coalesce("quality", F.lit(1)))).alias("low"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
           .select(F.col("doc_id").alias("_id"), F.col("low").cast("long").alias("low"), F.col("toxic").cast("long").alias("toxic"))
           .orderBy(F.xxhash64("_id"), "_id").limit(sample))
    src = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    one = F.min_by(F.struct("text", *TARGETS), F.xxhash64("text"))  # of the rows that repeat an id
    chosen = stage(src.join(F.broadcast(lab), "_id").groupBy("_id").agg(one.alias("r")).select("r.*"), "labelled")  # at most `sample` rows
    row = chosen.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in TARGETS]).first()
    if not row["n"]:
        return None
    markers = _markers(chosen, row["n"], {t: row[t] for t in TARGETS})
    width = SHAPES + len(markers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            x = features(b.column("text"), markers)
            bits = np.packbits(x[:, SHAPES:].astype(np.uint8), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x[:, :SHAPES].astype(np.float32)], pa.binary()), pa.array([r.tobytes() for r in bits], pa.binary()),
                                              *(b.column(t) for t in TARGETS)], names=["x", "m", *TARGETS])

    got = chosen.mapInArrow(run, "x binary, m binary, low long, toxic long").toArrow()  # at most `sample` rows of some hundred bytes
    unstage(chosen)
    n = got.num_rows
    shapes = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(n, SHAPES)
    marks = np.frombuffer(b"".join(got.column("m").to_pylist()), np.uint8).reshape(n, -1)
    return {"markers": markers, **{t: fit_logistic(shapes, marks, got.column(t).to_numpy().astype(float), width) for t in TARGETS}}


def score(docs: DataFrame, model: dict | None, carry: Sequence[str], host: Column, path: Column) -> DataFrame:
    """doc (carried columns), host, path, l_low, l_toxic (log odds of the document alone)."""
    src = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in carry]).alias("doc"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col("text").alias("text"))
    names = ["doc", "host", "path", "l_low", "l_toxic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            if model is None:
                logit = [np.full(b.num_rows, -12.0)] * 2
            else:
                x = features(b.column("text"), model["markers"])
                empty = np.diff(utf8(b.column("text"))[1]) == 0
                logit = [np.where(empty, -12.0, np.clip(x @ model[t][0] + model[t][1], -30, 30)) for t in TARGETS]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("host"), b.column("path"), *(pa.array(v) for v in logit)], names=names)

    return src.mapInArrow(run, f"doc {src.schema['doc'].dataType.simpleString()}, host string, path string, l_low double, l_toxic double")


def _strength(groups: DataFrame, t: str, prior: Column) -> float:
    """Prior strength (pseudo-documents) by moments: the spread of the groups' rates around
    their priors, less the binomial spread."""
    n, rate = F.col("n"), F.col(t) / F.col("n")
    r = groups.agg(F.sum(n * (rate - prior) ** 2).alias("spread"), F.sum(prior * (1 - prior)).alias("binomial"), F.sum(n).alias("n"),
                   F.sum(n * prior * (1 - prior)).alias("within")).first()
    if not r["n"] or not r["within"]:
        return 1e6
    between = (r["spread"] - r["binomial"]) / r["n"]
    return float(min(1e6, max(1.0, r["within"] / r["n"] / between - 1))) if between > 0 else 1e6


def posteriors(scored: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """(host, path) with the shrunk host and path rates of both targets, and the global rates."""
    prob = lambda c: 1 / (1 + F.exp(-F.col(c)))
    paths = stage(scored.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(prob(f"l_{t}")).alias(t) for t in TARGETS]), "paths")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", *TARGETS)])
    tot = hosts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", *TARGETS)]).first()
    # a rate of its own is kept off 0 and 1 by half a document
    rate = {t: (tot[t] + 0.5) / (tot["n"] + 1.0) for t in TARGETS}
    for t in TARGETS:
        k = _strength(hosts, t, F.lit(rate[t]))
        hosts = hosts.withColumn(f"host_{t}", (F.col(t) + k * rate[t]) / (F.col("n") + k))
    up = hosts.select(F.col("host").alias("_h"), *[f"host_{t}" for t in TARGETS])
    paths = paths.join(up, F.col("host").eqNullSafe(F.col("_h"))).drop("_h")
    for t in TARGETS:
        k = _strength(paths, t, F.col(f"host_{t}"))
        paths = paths.withColumn(f"path_{t}", (F.col(t) + k * F.col(f"host_{t}")) / (F.col("n") + k))
    return paths.select("host", "path", *[f"{lvl}_{t}" for t in TARGETS for lvl in ("host", "path")]), rate


def classify(docs: DataFrame, labels: DataFrame, carry: Sequence[str] = ("doc_id",), host: Column | None = None, path: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc (carried columns), host, path, d_low, d_toxic (document alone), host_*, path_*
    (posterior rates), p_low, p_toxic, rejected.  host and path default to `source` and
    `lang`; for pages pass the parts of the url."""
    prep(docs.sparkSession)
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    model = fit(docs, labels, sample)
    scored = stage(score(docs, model, carry, host, path), "log-odds")  # texts are scored once
    post, rate = posteriors(scored)
    post = post.withColumnsRenamed({"host": "_h", "path": "_p"})
    out = scored.join(post, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p"))).drop("_h", "_p")
    for t in TARGETS:
        shift = F.log(F.col(f"path_{t}") / (1 - F.col(f"path_{t}"))) - math.log(rate[t] / (1 - rate[t]))
        out = out.withColumn(f"d_{t}", 1 / (1 + F.exp(-F.col(f"l_{t}")))).withColumn(f"p_{t}", 1 / (1 + F.exp(-(F.col(f"l_{t}") + shift))))
    # no evidence, no rejection
    out = out.withColumn("rejected", ((F.col("p_low") > 0.5) & (F.col("d_low") > 1e-5)) | ((F.col("p_toxic") > 0.5) & (F.col("d_toxic") > 1e-5)))
    return out.drop("l_low", "l_toxic")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are not rejected."""
    return classify(docs, labels, carry=docs.columns).where("not rejected").select("doc.*")
