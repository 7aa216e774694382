"""Hidden Markov language model: Baum-Welch counts aggregated across partitions, exact
sequence likelihood by scaled forward recursion.

Tokens are words and one end per text.  The states emit symbols: each of the `OWN` most
frequent words is a symbol, the end is one, and every other word belongs to one of `CLASSES`
classes by its last bytes.  A classed word's probability is the state's probability of the
class times the word's share of its class over the whole training corpus,
(c + 0.1) / (C + 0.1 * (V + 1)), so that known and unknown words are all covered.

1. Word counts of all training texts: counted in the tasks, summed by word.
2. Each text becomes its symbol sequence (2 bytes a token, staged).  The words' own shares
   need the counts of all words: those of the `LOOKUP` most frequent ones are sent to the
   tasks (a bounded table), rarer words are joined with the count table by word.
3. States start from clusters of the symbols by their neighbours (neighbour counts of all
   training texts), and `ROUNDS` Baum-Welch rounds follow over all training texts: each task
   returns its expected counts, which are summed by cell.  Training reads long texts in pieces
   of `PIECE` tokens; a piece that does not begin its text starts from the states' shares.
4. Scoring runs the forward recursion over whole texts, many texts side by side.

Defined results: a null text is empty (its one token is the end); rows that repeat a doc_id
are scored each on their own text; a null doc_id counts as crc32 0 (held out
in the query); without training texts the model is uniform over its symbols; extra columns
are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedyard.llm.common import SPACED, Rolling, prep, row_key, stage, steps, utf8, words

ALPHA = 0.1
OWN = 1024
CLASSES = 256
LOOKUP = 1 << 18
STATES = 12
ROUNDS = 4
PIECE = 256
#: Texts side by side in training, and tokens that scoring holds at once.
SIDE = 1024
HOLD = 3 << 20
END = 0
#: Symbols whose neighbourhood counts describe a symbol at the start.
CONTEXTS = 48
SYMBOLS = 1 + OWN + CLASSES
END_WORD = np.uint64(0x45E4D0E4D0E4D0E5)


# ---------------------------------------------------------------- words and counts

def _words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, classes by the last two bytes, first word of each row."""
    data, off = utf8(col)
    s, e, first = words(data, off, SPACED)
    roll = Rolling(data, lower=True)
    cls = (roll.of(np.maximum(e - 2, s), e) >> np.uint64(20)) % np.uint64(CLASSES)
    return roll.of(s, e), cls.astype(np.int64), first


def word_counts(texts: DataFrame) -> DataFrame:
    """(w, cls, c) over all texts; the end is a word of its own with class -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            h, cls, _ = _words(b.column("text"))
            w, at, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(w, END_WORD).view(np.int64)), pa.array(np.append(cls[at], -1).astype(np.int32)), pa.array(np.append(n, b.num_rows).astype(np.int64))], names=["w", "cls", "c"])

    return texts.select("text").mapInArrow(run, "w long, cls int, c long").groupBy("w").agg(F.first("cls").alias("cls"), F.sum("c").alias("c"))


class Vocabulary:
    """What the tasks know of the words: the frequent ones' counts, the own symbols, the
    classes' totals."""

    def __init__(self, counts: DataFrame):
        row = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        self.total, self.distinct = int(row["n"]), int(row["v"])
        # the most frequent words by a histogram of log counts: whole buckets, LOOKUP words at most
        level = F.floor(F.log2("c") * 16)
        steps_ = counts.where("cls >= 0").groupBy(level.alias("b")).agg(F.count("*").alias("n")).collect()  # under 1,024 rows
        least, n = None, 0
        for r in sorted(steps_, key=lambda r: -r["b"]):
            n += r["n"]
            if n > LOOKUP:
                break
            least = r["b"]
        top = counts.where("cls >= 0").where(level >= (least if least is not None else 1 << 20)).select("w", "c").toArrow()
        w, c = top.column("w").to_numpy().view(np.uint64), top.column("c").to_numpy()
        rank = np.lexsort((w.view(np.int64), -c))
        own = np.full(len(w), -1, np.int32)
        own[rank[:OWN]] = np.arange(1, 1 + min(OWN, len(w)))
        sort = np.argsort(w)
        self.words, self.count, self.own = w[sort], c[sort], own[sort]
        self.ends = int(counts.where("cls = -1").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
        # class totals without the words that are symbols of their own
        own_words = [int(x) for x in w[rank[:OWN]].view(np.int64)]
        rest = counts.where("cls >= 0")
        mine = rest.join(F.broadcast(counts.sparkSession.createDataFrame([(x,) for x in own_words], "w long")), "w", "left_anti") if own_words else rest
        self.class_total, self.class_words = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in mine.groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():  # CLASSES rows
            self.class_total[r["cls"]], self.class_words[r["cls"]] = r["c"], r["v"]

    def base_norm(self) -> float:
        return float(np.log10(self.total + ALPHA * (self.distinct + 1)))

    def class_norm(self) -> np.ndarray:
        return np.log10(self.class_total + ALPHA * (self.class_words + 1))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position among the frequent words, whether there)."""
        if not len(self.words):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        j = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return j, self.words[j] == h


def sequences(docs: DataFrame, vocab) -> DataFrame:
    """Per row: symbols (2 bytes each), n_tokens, and sums over the end and the frequent
    words: n_known, base and share (log10)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocab.value
        norm = v.class_norm()
        for b in steps(batches, "text"):
            h, cls, first = _words(b.column("text"))
            rows = b.num_rows
            row = np.repeat(np.arange(rows), np.diff(first))
            j, known = v.find(h)
            own = np.where(known, v.own[j], -1) if len(v.words) else np.full(len(h), -1)
            sym = np.where(own > 0, own, 1 + OWN + cls).astype(np.uint16)
            c = np.where(known, v.count[j], 0).astype(float) if len(v.words) else np.zeros(len(h))
            lg = np.where(known, np.log10(c + ALPHA), 0.0)
            base = np.bincount(row, lg, rows) + np.log10(v.ends + ALPHA)
            share = np.bincount(row, np.where(own > 0, 0.0, lg - norm[cls]), rows)
            n_known = np.bincount(row, known, rows).astype(np.int64) + (v.ends > 0)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("k1"), b.column("k2"), b.column("held_out"), pa.array([np.append(sym[first[i]:first[i + 1]], END).astype(np.uint16).tobytes() for i in range(rows)], pa.binary()),
                 pa.array(np.diff(first) + 1), pa.array(n_known), pa.array(base), pa.array(share)], names=["doc_id", "k1", "k2", "held_out", "sym", "n_tokens", "n_known", "base", "share"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, held_out boolean, sym binary, n_tokens long, n_known long, base double, share double")


def rare_words(docs: DataFrame, vocab) -> DataFrame:
    """(w, k1, k2, tf, part): the words of each row that are not among the frequent ones; part
    adds up to 1 over a row, so that rows of equal key can be told by their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocab.value
        for b in steps(batches, "text"):
            h, _, first = _words(b.column("text"))
            row = np.repeat(np.arange(b.num_rows), np.diff(first))
            _, known = v.find(h)
            h, row = h[~known], row[~known]
            if not len(h):
                continue
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(new)
            tf = np.diff(np.append(at, len(h)))
            r = row[at]
            part = 1.0 / np.bincount(r, minlength=b.num_rows)[r]
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), b.column("k1").take(pa.array(r)), b.column("k2").take(pa.array(r)), pa.array(tf.astype(np.int32)), pa.array(part)], names=["w", "k1", "k2", "tf", "part"])

    return docs.select("k1", "k2", "text").mapInArrow(run, "w long, k1 long, k2 long, tf int, part double")


# ---------------------------------------------------------------- the chain

class Chain:
    """Start shares, shares of the states (for pieces within a text), moves, emissions."""

    def __init__(self, start: np.ndarray, share: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.share, self.move, self.emit = start, share, move, np.ascontiguousarray(emit.T)  # emit: (symbols, states)


def _layout(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest first: (order, all symbols by time, number of sequences at each time)."""
    n = np.array([len(s) for s in seqs])
    order = np.argsort(-n, kind="stable")
    n = n[order]
    alive = len(n) - np.searchsorted(n[::-1], np.arange(n[0]), "right")
    flat = np.concatenate([seqs[i] for i in order]).astype(np.int64)
    off = np.cumsum(n) - n
    t = np.arange(len(flat)) - np.repeat(off, n)
    by = np.empty(len(flat), np.int64)
    by[(np.cumsum(alive) - alive)[t] + np.repeat(np.arange(len(n)), n)] = flat
    return order, by, alive


def loglik(chain: Chain, seqs: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of whole sequences by the scaled forward recursion."""
    if not seqs:
        return np.zeros(0)
    order, by, alive = _layout(seqs)
    out = np.zeros(len(seqs))
    a = np.broadcast_to(chain.start, (len(seqs), len(chain.start)))
    at = 0
    for t, k in enumerate(alive.tolist()):
        a = (a if t == 0 else a[:k] @ chain.move) * chain.emit[by[at:at + k]]
        c = a.sum(1)
        a = a / c[:, None]
        out[:k] += np.log10(c)
        at += k
    res = np.empty(len(seqs))
    res[order] = out
    return res


def expected(chain: Chain, seqs: list[np.ndarray], opening: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts (start, moves, emissions) of pieces; `opening`: the piece begins a text."""
    order, by, alive = _layout(seqs)
    s = len(chain.start)
    off = np.cumsum(alive) - alive
    alpha, scale = np.empty((len(by), s)), np.empty(len(by))
    a = np.where(opening[order][:, None], chain.start, chain.share)
    for t, (o, k) in enumerate(zip(off.tolist(), alive.tolist(), strict=True)):
        a = (a if t == 0 else a[:k] @ chain.move) * chain.emit[by[o:o + k]]
        c = a.sum(1)
        a = a / c[:, None]
        alpha[o:o + k], scale[o:o + k] = a, c
    gamma = np.empty_like(alpha)
    xi = np.zeros((s, s))
    beta = np.ones((alive[-1], s))
    for t in range(len(alive) - 1, -1, -1):
        o, k = int(off[t]), int(alive[t])
        if k > len(beta):
            beta = np.concatenate([beta, np.ones((k - len(beta), s))])
        gamma[o:o + k] = alpha[o:o + k] * beta
        if t:
            nxt = beta * chain.emit[by[o:o + k]] / scale[o:o + k, None]
            before = alpha[off[t - 1]:off[t - 1] + k]
            xi += before.T @ nxt
            beta = nxt @ chain.move.T
    emit = np.stack([np.bincount(by, gamma[:, i], SYMBOLS) for i in range(s)])
    return gamma[:alive[0]][opening[order]].sum(0), xi * chain.move, emit


def _pieces(cols: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    seqs, opening = [], []
    for raw in cols:
        s = np.frombuffer(raw, np.uint16)
        for i in range(0, len(s), PIECE):
            seqs.append(s[i:i + PIECE])
            opening.append(i == 0)
    return seqs, np.array(opening)


def _summed(rows: DataFrame, run, size: int) -> np.ndarray:
    """Sum over tasks of vectors of `size` cells: each task yields its own, cells are summed by a
    grouped aggregation, `size` numbers reach the driver."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for v in run(b for b in batches if b.num_rows):
            total += v
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["i", "x"])

    got = rows.mapInArrow(each, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(size)
    out[got.column("i").to_numpy()] = got.column("x").to_numpy()
    return out


def start_chain(train: DataFrame) -> Chain:
    """Clusters of the symbols by what stands before and after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            v = np.zeros((SYMBOLS, 2 * CONTEXTS + 1))
            for raw in b.column("sym").to_pylist():
                s = np.frombuffer(raw, np.uint16).astype(np.int64)
                c = np.minimum(s, CONTEXTS - 1)
                flat = np.concatenate([s[:-1] * (2 * CONTEXTS + 1) + c[1:], s[1:] * (2 * CONTEXTS + 1) + CONTEXTS + c[:-1], s * (2 * CONTEXTS + 1) + 2 * CONTEXTS])
                np.add.at(v.reshape(-1), flat, 1)
            yield v.reshape(-1)

    v = _summed(train.select("sym"), run, SYMBOLS * (2 * CONTEXTS + 1)).reshape(SYMBOLS, -1)
    n = v[:, -1]
    x = np.sqrt(v[:, :-1] / np.maximum(v[:, :-1].sum(1, keepdims=True), 1))
    used = np.flatnonzero(n > 0)
    rng = np.random.default_rng(11)
    emit = np.full((STATES, SYMBOLS), 1e-3)
    if len(used):
        w = np.sqrt(n[used])
        centre = [x[used[np.argmax(w)]]]
        for _ in range(STATES - 1):  # far points, weighted by how often they occur
            d = np.min([((x[used] - c) ** 2).sum(1) for c in centre], axis=0)
            centre.append(x[used[np.argmax(d * w)]])
        centre = np.array(centre)
        for _ in range(25):
            near = ((x[used][:, None] - centre[None]) ** 2).sum(2).argmin(1)
            for k in range(STATES):
                if (near == k).any():
                    centre[k] = np.average(x[used][near == k], axis=0, weights=w[near == k])
        emit[near, used] += 1.0
        emit = emit * (n + 1.0) * rng.uniform(0.9, 1.1, emit.shape)
    emit /= emit.sum(1, keepdims=True)
    move = np.full((STATES, STATES), 0.5 / STATES) + 0.5 * np.eye(STATES)
    share = np.full(STATES, 1 / STATES)
    return Chain(share, share, move, emit)


def train_chain(train: DataFrame) -> Chain:
    """Baum-Welch over all training sequences (`sym`)."""
    spark = train.sparkSession
    chain = start_chain(train)
    size = STATES + STATES * STATES + STATES * SYMBOLS
    for _ in range(ROUNDS):
        now = spark.sparkContext.broadcast(chain)

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[np.ndarray]:
            seqs, opening = [], []
            for b in batches:
                s, o = _pieces(b.column("sym").to_pylist())
                seqs += s
                opening += o.tolist()
                while len(seqs) >= SIDE:
                    yield np.concatenate([x.reshape(-1) for x in expected(now.value, seqs[:SIDE], np.array(opening[:SIDE]))])
                    seqs, opening = seqs[SIDE:], opening[SIDE:]
            if seqs:
                yield np.concatenate([x.reshape(-1) for x in expected(now.value, seqs, np.array(opening))])

        v = _summed(train.select("sym"), run, size)
        start, move, emit = v[:STATES], v[STATES:STATES * (STATES + 1)].reshape(STATES, -1), v[STATES * (STATES + 1):].reshape(STATES, -1)
        share = emit.sum(1) + 1e-3
        prior = (emit.sum(0) + 1.0) / (emit.sum() + SYMBOLS)
        emit = emit + 5.0 * prior  # every state can emit every symbol
        chain = Chain((start + 0.1) / (start + 0.1).sum(), share / share.sum(), (move + 0.1) / (move + 0.1).sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))
    return chain


# ---------------------------------------------------------------- the operator

def score(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per document row;
    `held_out` is a boolean column of `docs`: rows that are not learned from."""
    spark = prep(docs.sparkSession)
    src = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("k1"), row_key().alias("k2"), held_out.alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    counts = stage(word_counts(src.where("not held_out")), "words")
    vocab_ = Vocabulary(counts)
    vocab = spark.sparkContext.broadcast(vocab_)
    seqs = stage(sequences(src, vocab), "symbols")
    chain = spark.sparkContext.broadcast(train_chain(seqs.where("not held_out")))

    # rare words meet their counts by a join, and return as sums per row
    known = F.col("c").isNotNull()
    lg = F.col("tf") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(ALPHA))
    rare = (rare_words(src, vocab).join(counts.where("cls >= 0").select("w", "c"), "w", "left").groupBy("k1", "k2")
            .agg(F.sum(lg).alias("r_log"), F.sum(F.when(known, F.col("tf")).otherwise(0)).alias("r_known"), F.sum("part").alias("r_rows")))

    names = ["doc_id", "k1", "k2", "held_out", "n_tokens", "n_known", "base", "share", "hmm"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ll = loglik(chain.value, [np.frombuffer(s, np.uint16) for s in t.column("sym").to_pylist()])
            return t.append_column("hmm", pa.array(ll)).select(names).to_batches()[0]

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.column("sym").nbytes // 2
            if size > HOLD:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = seqs.mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, held_out boolean, n_tokens long, n_known long, base double, share double, hmm double")
    got = scored.join(rare, ["k1", "k2"], "left")
    rows = F.greatest(F.round("r_rows"), F.lit(1.0))
    r_log = F.coalesce(F.col("r_log") / rows, F.lit(0.0))
    return got.select("doc_id", "held_out", "n_tokens",
                      (F.col("n_known") + F.coalesce(F.round(F.col("r_known") / rows), F.lit(0))).cast("long").alias("n_known"),
                      F.lit(vocab_.total).cast("long").alias("train_tokens"),
                      (F.col("base") + r_log - F.col("n_tokens") * F.lit(vocab_.base_norm())).alias("base_score"),
                      (F.col("hmm") + F.col("share") + r_log).alias("score"))
