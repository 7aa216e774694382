"""Shared helpers: staging, row keys and vectorised word and byte hashing.

Text is handled as UTF-8 bytes taken straight from Arrow buffers, so that the cost of
a document is a few numpy passes over its bytes whatever its language.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedyard.session import prepare, scratch_root

#: Rows of one Arrow batch: whole texts travel in batches, so few rows at a time.
BATCH_ROWS = 256
#: Bytes of text that one numpy step works on (its 8-byte arrays take eight times that).
STEP_BYTES = 1 << 21


def prep(spark: SparkSession) -> SparkSession:
    """Ship the package and keep Arrow batches of texts small."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, kind: str) -> DataFrame:
    """Write `df` as Parquet to the shared scratch folder and read it back: cuts the
    lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{kind}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def unstage(df: DataFrame | None) -> None:
    """Delete a staged table that no later plan reads."""
    path = getattr(df, "_staged", None)
    if path:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns never clash with ours."""
    return df.select(*[F.col(f"`{n}`").alias(n) for n in names])


#: Narrow rows that are sent to every task, at most.
SENT_ROWS = 100_000


def sent(df: DataFrame) -> DataFrame:
    """A staged table of one narrow row a key, sent to the tasks if a count says that it is
    small: what it is joined with then stays where it is.  Else joined by shuffle."""
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


def apart(df: DataFrame) -> DataFrame:
    """The same columns under attributes of their own, for a cogroup with what it was made from."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """Second half of a document's key (its id, this): tells rows apart that repeat an id."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


# ---------------------------------------------------------------- byte buffers

def as_array(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    col = as_array(col)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    kind = np.int64 if wide else np.int32
    if len(col) == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(bufs[1], kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0]:off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def steps(batches: Iterator[pa.RecordBatch], text: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds at most `limit` text bytes or one row."""
    for b in batches:
        if b.num_rows == 0:
            continue
        _, off = utf8(b.column(text))
        at = 0
        while at < b.num_rows:
            end = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
            end = min(max(end, at + 1), b.num_rows)
            yield b.slice(at, end - at)
            at = end


# ---------------------------------------------------------------- hashing

def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (xor-shift-multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_POW = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["p"]) < n:
        m = max(n, 1 << 16)
        for k, b in (("p", _BASE), ("i", _INV)):
            a = np.full(m, b, np.uint64)
            a[0] = 1
            _POW[k] = np.multiply.accumulate(a)
    return _POW["p"], _POW["i"]


def _byte_values(lower: bool) -> np.ndarray:
    v = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    if lower:
        v[65:91] = v[97:123]
    return v


_VALUES = {True: _byte_values(True), False: _byte_values(False)}


class Rolling:
    """Polynomial hashes (modulo 2^64) of any substrings of one byte buffer."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        n = len(data)
        p, self._inv = _powers(n + 1)
        self._h = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[lower][data] * p[:n], out=self._h[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self._h[end] - self._h[start]) * self._inv[start]
        return mix64(h + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    def fixed(self, n: int) -> np.ndarray:
        """Hashes of every substring of n bytes, by its start."""
        m = len(self._h) - n
        if m <= 0:
            return np.zeros(0, np.uint64)
        return mix64((self._h[n:] - self._h[:m]) * self._inv[:m])


# ---------------------------------------------------------------- words

#: Word bytes: all but space and the ASCII controls 9 to 13.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Word bytes: ASCII letters and digits, and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True


def words(data: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of the words of a batch, and the first word of
    each row (one entry more than rows).  A word never crosses rows."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    w = kind[data]
    edge = off[(off > 0) & (off < n)]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    before[edge] = False
    start = np.flatnonzero(w & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = w[1:]
    after[edge - 1] = False
    end = np.flatnonzero(w & ~after) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, off: np.ndarray, kind: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lower-cased) and the first word of each row."""
    s, e, first = words(data, off, kind)
    return Rolling(data, lower=True).of(s, e), first


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row (a row of fewer words but not none has
    one, its whole sequence) and the first shingle of each row."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    start = first[:-1][row] + (np.arange(at[-1]) - at[:-1][row])
    size = np.minimum(n, k)[row]
    out = size.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)
    for j in range(k):
        has = j < size
        step = mix64(out ^ h[np.where(has, start + j, 0)]) if len(h) else out
        out = np.where(has, step + np.uint64(j + 1), out)
    return mix64(out), at


def crc_bucket(ids: pa.Array, mod: int) -> np.ndarray:
    """crc32(id as text) mod `mod`; a null id has 0."""
    import zlib
    return np.array([zlib.crc32(str(i).encode()) % mod if i is not None else 0 for i in ids.to_pylist()], np.int64)
