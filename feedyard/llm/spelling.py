"""Spelling variants: words that differ by one code point, by a bit-sliced position index.

1. Vocabulary.  Runs of letters of all texts, lower-cased (A-Z only), with a seeded slip: the
   run of a document whose crc32 the modulus divides loses one code point.  Words are the
   results of at least `least` code points and `often` occurrences; they are counted by one
   grouped aggregation with partial sums.
2. Shards.  Two words that differ by one code point, the shorter of c code points, share their
   first c // 2 code points or their last c - c // 2.  A word joins, for c its own length and
   one less, the shards of both halves, so every near pair meets in a shard.
3. Bit-sliced index.  In a shard, each (position, letter) has a bitset over the shard's words.
   All query words run through it at once, letter by letter, with three sets each: words that
   agree so far (Z), words with one replaced letter (S), and words with one letter more, whose
   positions are shifted by one (I).  With B[i] the bitset of the query's letter at position i:
   S = S & B[i] | Z & ~B[i],  I = I & B[i + 1] | Z' (the extra letter comes here),  Z = Z & B[i].
   Bit operations work on 64 words at a time.  Words with one letter less need no set of their
   own: the longer word is found by the shorter one's query, and both note it.
4. A shard's pairs are never written: it returns for each of its words the number of near
   words and the best of them, and a grouped aggregation adds these up.
5. `form` is the best near word if it is frequent enough; `root` follows forms to their end by
   pointer doubling (the counts grow by `factor` at every step, so chains are short).

A shard of more than `SHARD` words is cut into parts of the index and blocks of the queries by
hashes, so a half that a third of all words share is no task of its own.

Defined results: null texts have no words; a null doc_id counts as empty text in the slip;
repeated rows count each time; extra columns are ignored; no words give an empty table.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedyard.llm.common import apart, prep, stage, unstage

LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Words of an index part, and queries of a block, at most (to a hash's evenness).
SHARD = 8192
#: Bytes of one set of states: queries of a step times the words of the index.
STATE_BYTES = 1 << 20


# ---------------------------------------------------------------- vocabulary

def lower_ascii(w: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise(F.translate(w, upper, upper.lower()))


def vocabulary(docs: DataFrame, letters: str = LETTERS, least: int = 7, often: int = 2, slip: int = 31) -> DataFrame:
    """(word, n): words of at least `least` code points and `often` occurrences.  slip: modulus
    of the seeded deletions (0: none)."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"),
                       F.explode(F.filter(F.regexp_extract_all("text", F.lit(letters), F.lit(0)), lambda w: F.char_length(w) >= least)).alias("run"))
    runs = runs.select("d", lower_ascii(F.col("run")).alias("w"))
    if slip:
        runs = runs.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "w").cast("binary")))
        runs = runs.withColumn("w", F.when(F.col("h") % slip == 0, F.concat(F.expr("substring(w, 1, cast(h % char_length(w) as int))"), F.expr("substring(w, cast(h % char_length(w) as int) + 2)"))).otherwise(F.col("w")))
        runs = runs.where(F.char_length("w") >= least)
    return runs.groupBy(F.col("w").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= often)


# ---------------------------------------------------------------- the index of a shard

def codes(words: list[str], length: int) -> np.ndarray:
    """Code points, one row a word; 0 after its end."""
    return np.array(words, f"U{length}").view(np.uint32).reshape(len(words), length)


class Position:
    """Bitsets of the letters at one position, one after another over the words."""

    def __init__(self, col: np.ndarray, words: int):
        self.letters = np.unique(col)
        bits = np.zeros((len(self.letters) + 1, words * 64), bool)  # the last is the empty set
        bits[np.searchsorted(self.letters, col), np.arange(len(col))] = True
        self.sets = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)

    def of(self, letters: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.letters, letters), len(self.letters) - 1)
        return self.sets[np.where(self.letters[at] == letters, at, len(self.letters))]


def one_error(index: np.ndarray, long: np.ndarray, query: np.ndarray, half: int, tail: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, word) that differ by one replaced letter, or by one letter more in the word.

    index: code points of the words, c + 1 columns; long: which have c + 1 letters; query: code
    points, c columns.  A pair counts where its first `half` letters agree, or, with `tail`,
    where they don't: so that no pair is found on both sides."""
    m, c = len(index), query.shape[1]
    words = -(-m // 64)
    pad = np.zeros(words * 64, bool)
    pad[:m] = long
    longer = np.packbits(pad, bitorder="little").view(np.uint64)
    pad[:m] = ~long
    same = np.packbits(pad, bitorder="little").view(np.uint64)
    at = [Position(index[:, i], words) for i in range(c + 1)] if c < 64 else None
    position = lambda i: at[i] if at else Position(index[:, i], words)  # noqa: E731  long words are few
    found = []
    step = max(1, STATE_BYTES // (words * 8))
    for start in range(0, len(query), step):
        q = query[start:start + step]
        z = np.full((len(q), words), ~np.uint64(0))
        s, more, head = np.zeros_like(z), z.copy(), z
        here = position(0)
        for i in range(c):
            b, here = here.of(q[:, i]), position(i + 1)
            s = (s & b) | (z & ~b)
            z = z & b
            more = (more & here.of(q[:, i])) | z  # z: the extra letter follows letter i
            if i + 1 == half:
                head = z
        hit = (s & same) | (more & longer)
        a, w = np.nonzero(hit)
        if len(a):
            bits = np.unpackbits(hit[a, w].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, bit = np.nonzero(bits)
            agree = (head[a[k], w[k]] >> bit.astype(np.uint64)) & np.uint64(1) == 1
            keep = ~agree if tail else agree
            found.append((a[k][keep] + start, (w[k] * 64 + bit)[keep]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


NEAR = "word string, n_near long, best_n long, best string"


def _shard(key: tuple, words: pa.Table, queries: pa.Table) -> pa.Table:
    """Near words within one part of a shard: for each word their number and the best."""
    kind = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    if not words.num_rows or not queries.num_rows:
        return kind.empty_table()
    c, tail = key[0].as_py(), key[1].as_py()
    mine, theirs = queries.column("word").to_pylist(), words.column("word").to_pylist()
    index = codes(theirs, c + 1)
    q, v = one_error(index, index[:, c] != 0, codes(mine, c), c // 2, tail)
    if not len(q):
        return kind.empty_table()
    nq, nv = queries.column("n").to_numpy(), words.column("n").to_numpy()
    longer = index[v, c] != 0
    # a longer word notes the query too: it makes no query of this class
    of = [mine[i] for i in q] + [theirs[i] for i in v[longer]]
    best = [theirs[i] for i in v] + [mine[i] for i in q[longer]]
    n = np.concatenate([nv[v], nq[q[longer]]])
    t = pa.table({"word": of, "best": best, "n": n})
    t = t.sort_by([("word", "ascending"), ("n", "descending"), ("best", "ascending")])
    g = t.group_by("word", use_threads=False).aggregate([("n", "count"), ("n", "first"), ("best", "first")])
    return pa.table([g.column("word"), g.column("n_count"), g.column("n_first"), g.column("best_first")], schema=kind)


# ---------------------------------------------------------------- the operator

def near_words(vocab: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have near words."""
    size = F.char_length("word")
    classes = vocab.withColumn("c", F.explode(F.filter(F.array(size, size - 1), lambda c: c > 0))).withColumn("asks", F.col("c") == size)
    sides = classes.withColumn("tail", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn(
        "half", F.when(F.col("tail"), F.expr("substring(word, -cast(c - c div 2 as int))")).otherwise(F.expr("substring(word, 1, cast(c div 2 as int))")))
    # shards of a class: as many as its words ask for; then parts and blocks where a half is frequent
    per = sides.groupBy("c", "tail").agg(F.ceil(F.count("*") / F.lit(SHARD / 2)).cast("int").alias("shards"))
    keyed = sides.join(per, ["c", "tail"]).withColumn("shard", F.pmod(F.xxhash64("half"), F.col("shards")).cast("int")).drop("half", "shards")
    placed = stage(keyed, "spelling")
    cut = placed.groupBy("c", "tail", "shard").agg(F.ceil(F.count("*") / F.lit(SHARD)).cast("int").alias("parts"), F.ceil(F.count_if("asks") / F.lit(SHARD)).cast("int").alias("blocks")).where("blocks > 0")
    placed = placed.join(cut, ["c", "tail", "shard"])
    deal = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    words = placed.select("c", "tail", "shard", "word", "n", deal("parts").alias("part"), all_of("blocks").alias("block"))
    asks = placed.where("asks").select("c", "tail", "shard", "word", "n", all_of("parts").alias("part"), deal("blocks").alias("block"))
    by = ["c", "tail", "shard", "part", "block"]
    got = apart(words).groupBy(*by).cogroup(apart(asks).groupBy(*by)).applyInArrow(_shard, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return got.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) to (word, root): the last word that forms lead to, by pointer doubling."""
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stage(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        unstage(now)
        now = new
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")


def variants(docs: DataFrame, letters: str = LETTERS, least: int = 7, often: int = 2, slip: int = 31, factor: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts (docs: doc_id, text)."""
    prep(docs.sparkSession)
    vocab = stage(vocabulary(docs, letters, least, often, slip), "vocabulary")
    near = near_words(vocab)
    own = stage(vocab.join(near, "word", "left").withColumn("form", F.when(F.col("best_n") >= F.col("n") * factor, F.col("best"))).select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form", F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n")), "near")
    root = roots(own.where("form is not null").select("word", "form"))
    return own.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
