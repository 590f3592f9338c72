"""Helpers shared by the training-data operators: Arrow text batches, vectorised
word and shingle hashing, shared-folder tables, hash-range counting and
connected components.
"""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

U64 = np.uint64
#: Text handled at once inside a task; bounds the numpy temporaries.
CHUNK_BYTES = 1 << 20

# --------------------------------------------------------------------------
# tables in the shared folder
# --------------------------------------------------------------------------


def write_table(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write ``df`` under the shared checkpoint folder, read it back; ``(table, path)``."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_tables(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that every later table no longer reads."""
    jvm = spark._jvm
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        hp.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hp, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that nothing refers to any more.

    The context cleaner learns of them by the driver's garbage collection, which
    an idle driver may put off until the executors' disks are full.
    """
    spark._jvm.System.gc()


def release() -> None:
    """Give a worker's freed memory back; idle workers are kept and would hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):                 # another C library
        pass


def released(f):
    """``f``, a function over batches or a table, followed by ``release``."""
    if inspect.isgeneratorfunction(f):
        def each(batches):
            yield from f(batches)
            release()
        return each

    def whole(table):
        out = f(table)
        release()
        return out
    return whole


# --------------------------------------------------------------------------
# text batches as byte arrays
# --------------------------------------------------------------------------

def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the ``n + 1`` row offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()).fill_null(b"")
    if col.offset or len(col) == 0:
        col = pa.concat_arrays([col, pa.array([], pa.large_binary())])
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2] if len(col) else None
    buf = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def row_chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges holding about ``limit`` bytes each (one long row stands alone)."""
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


# --------------------------------------------------------------------------
# hashing
# --------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """``base ** i`` modulo 2**64 for ``i < n``; the longest table so far is kept."""
    if len(_POWERS.get(base, ())) < n:
        full = np.full(max(n, CHUNK_BYTES + 4096), base, U64)
        full[0] = 1
        _POWERS[base] = np.cumprod(full, dtype=U64)
    return _POWERS[base][:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit finaliser, so that all bits of a polynomial hash are usable."""
    x = x + U64((salt * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) % 2**64)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """``P`` with ``(P[e] - P[s]) * base ** -s`` the polynomial hash of ``buf[s:e]``."""
    p = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * powers(len(buf)), dtype=U64, out=p[1:])
    return p


def range_hash(p: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the byte ranges, equal for equal bytes at any place."""
    return mix((p[e] - p[s]) * powers(len(p), _INVERSE)[s])


def hash_ranges(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """``range_hash`` of ascending ranges that do not overlap, in memory that a long ``buf`` does not raise.

    The hash is a sum over bytes, so a range that a cut falls into adds up from its parts.
    """
    if len(buf) <= 2 * CHUNK_BYTES:
        return range_hash(prefix_hash(buf), s, e)
    total = np.zeros(len(s), U64)
    for a in range(0, len(buf), CHUNK_BYTES):
        b = min(a + CHUNK_BYTES, len(buf))
        lo, hi = int(np.searchsorted(e, a, "right")), int(np.searchsorted(s, b, "left"))
        if lo >= hi:
            continue
        p = prefix_hash(buf[a:b])
        ss, ee = np.maximum(s[lo:hi], a) - a, np.minimum(e[lo:hi], b) - a
        raw = (p[ee] - p[ss]) * powers(len(p), _INVERSE)[ss]
        if s[lo] < a:                                 # the one range that began before this part
            raw[:1] *= U64(pow(_BASE, a - int(s[lo]), 1 << 64))
        total[lo:hi] += raw
    return mix(total)


def text_parts(buf: np.ndarray, off: np.ndarray, parts_words: np.ndarray, limit: int = CHUNK_BYTES):
    """``(bytes, offsets, row numbers)`` of about ``limit`` bytes; a longer row comes in several, cut after bytes that part words."""
    for lo, hi in row_chunks(off, limit):
        a, end = int(off[lo]), int(off[hi])
        if end - a <= 2 * limit:
            yield buf[a:end], off[lo:hi + 1] - off[lo], np.arange(lo, hi)
            continue
        while a < end:                                # one long row
            b = min(a + limit, end)
            while b < end and not parts_words[buf[b - 1]]:
                ahead = np.flatnonzero(parts_words[buf[b:b + limit]])
                b = b + int(ahead[0]) + 1 if len(ahead) else min(b + limit, end)
            yield buf[a:b], np.array([0, b - a]), np.array([lo])
            a = b


# The characters that separate words in the contracts.
WORD_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_SPACE = np.zeros(256, bool)
_SPACE[list(WORD_SPACE)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(buf: np.ndarray, off: np.ndarray, lower: bool = False):
    """Words of a chunk of rows: ``(hash, row, start, end)`` arrays in text order."""
    if lower:
        buf = _LOWER[buf]
    n = len(buf)
    if n == 0:
        e = np.zeros(0, np.int64)
        return np.zeros(0, U64), e, e, e
    sp = _SPACE[buf]
    head = np.empty(n, bool)
    head[0] = True
    head[1:] = sp[:-1]
    cut = off[(off > 0) & (off < n)]
    head[cut] = True
    tail = np.empty(n, bool)
    tail[-1] = True
    tail[:-1] = sp[1:]
    tail[cut - 1] = True
    starts = np.flatnonzero(head & ~sp)
    ends = np.flatnonzero(tail & ~sp) + 1
    rows = np.searchsorted(off, starts, "right") - 1
    return hash_ranges(buf, starts, ends), rows, starts, ends


def window_hash(words: np.ndarray, rows: np.ndarray, k: int):
    """``(hash, row, first word)`` of every ``k``-word window inside one row."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[:m] == rows[k - 1:])
    h = np.zeros(len(at), U64)
    for i in range(k):
        h = h * U64(_BASE) + words[at + i]
    return mix(h, k), rows[at], at


# --------------------------------------------------------------------------
# connected components
# --------------------------------------------------------------------------

def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, component)`` of the undirected ``edges (a, b)``, by smallest node.

    Alternating star contraction: every round links each node's larger
    neighbours to its smallest one, then its smaller neighbours likewise, until
    nothing changes; rounds grow with the logarithm of the longest chain.  Each
    round is one written table, so a lost executor costs one round.
    """
    spark = edges.sparkSession
    cur, path = write_table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    mark = None
    while True:
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        nxt = (small.select("u", F.col("m").alias("v"))
               .unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
               .distinct())
        nxt, fresh = write_table(nxt, name)
        now = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop_tables(spark, path)
        cur, path = nxt, fresh
        if now == mark:
            break
        mark = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
