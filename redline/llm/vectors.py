"""Integer vectors in blocks, for the exact searches over inner products.

Candidates are dealt evenly to blocks, queries to chunks.  A task holds one
block, builds its index once and streams every chunk past it, so the shuffle
carries each block once and each chunk once a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table

SCALE = 256
BLOCK_ROWS = 16_384
CHUNK_ROWS = 128
_LONG = 1 << 63


def integer_vectors(vectors: DataFrame, *others: str, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, v array<long>, *others)`` of the rows that take part: with an id, a vector and only finite components.

    A finite component that no long holds after scaling is an error, as are its scores.
    """
    x = lambda c: F.floor(c.cast("double") * scale)
    finite = F.forall(F.col(embedding), lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")) & ~F.isnan(c.cast("double")))
    fits = lambda c: F.when(F.abs(c.cast("double")) * scale < float(_LONG), x(c)).otherwise(
        F.raise_error(F.lit(f"a component times {scale} exceeds a long")).cast("long"))
    return (vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & finite)
            .select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(embedding, fits).alias("v"), *others))


@dataclass
class Piece:
    """Rows of a block or chunk: ids, components, further numbers, and lists of numbers a row."""
    ids: np.ndarray
    x: np.ndarray
    longs: list[np.ndarray] = field(default_factory=list)
    lists: list[list[np.ndarray]] = field(default_factory=list)


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    """Rows of an ``array<long>`` column, filled with zeros to ``dims``."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    out = np.zeros((len(col), dims), np.int64)
    lens = np.diff(col.offsets.to_numpy())
    at = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
    out[np.repeat(np.arange(len(col)), lens), at] = col.flatten().to_numpy(zero_copy_only=False)
    return out


def _ragged(col: pa.Array) -> list[np.ndarray]:
    return [np.array(v or (), np.int64) for v in col.to_pylist()]


def _packed(dims: int, rows: int, longs: int, lists: int):
    """Batches regrouped to pieces of ``rows`` rows, each array as bytes; components in the least width that holds them."""
    names = ["ids", "x", *(f"long{i}" for i in range(longs)), *(f"list{i}" for i in range(lists))]

    def piece(parts: list) -> pa.RecordBatch:
        ids, x, *more = parts
        low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
        width = next(w for w in (2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
        cells = [ids.astype("<i8").tobytes(), bytes([width]) + x.astype(f"<i{width}").tobytes(), *(m.astype("<i8").tobytes() for m in more[:longs])]
        for m in more[longs:]:
            cells.append(np.concatenate([np.array([len(v) for v in m], np.int64), *m]).astype("<i8").tobytes())
        return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], names)

    def run(batches):
        held: list[list] = []
        n = 0
        for b in batches:
            held.append([b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1), dims),
                         *(b.column(2 + i).to_numpy(zero_copy_only=False) for i in range(longs)), *(_ragged(b.column(2 + longs + i)) for i in range(lists))])
            n += b.num_rows
            while n >= rows:
                whole = _joined(held)
                yield piece([c[:rows] for c in whole])
                held, n = [[c[rows:] for c in whole]], n - rows
        if n:
            yield piece(_joined(held))

    def _joined(held):
        return [np.concatenate(c) if isinstance(c[0], np.ndarray) else [v for part in c for v in part] for c in zip(*held)]
    return run, names


def _unpacked(cells: list[bytes], longs: int) -> Piece:
    ids = np.frombuffer(cells[0], "<i8")
    x = np.frombuffer(cells[1], f"<i{cells[1][0]}", offset=1)
    lists = []
    for c in cells[2 + longs:]:
        flat = np.frombuffer(c, "<i8")
        lists.append(np.split(flat[len(ids):], np.cumsum(flat[:len(ids)])[:-1]))
    return Piece(ids, x.astype(np.int64).reshape(len(ids), -1), [np.frombuffer(c, "<i8") for c in cells[2:2 + longs]], lists)


def _numbered(df: DataFrame, parts: int, rows: int, dims: int, longs: list[str], lists: list[str], name: str) -> tuple[DataFrame, int]:
    # dealt in turn, so parts differ by a few rows; a piece takes what one part holds
    pack, names = _packed(dims, 2 * rows, len(longs), len(lists))
    rows_of = df.select("vec_id", "v", *longs, *lists).repartition(parts)
    t, _ = write_table(rows_of.mapInArrow(pack, ", ".join(f"{n} binary" for n in names)).withColumn("place", F.monotonically_increasing_id()), name)
    places = t.select("place").withColumn("no", F.row_number().over(Window.orderBy("place")) - 1)     # over pieces, not rows
    return t.join(places, "place").drop("place"), t.count()


def block_search(candidates: DataFrame, queries: DataFrame, index: Callable[[Piece], object], answer: Callable[[object, Piece], tuple[np.ndarray, ...]],
                 schema: str, name: str, longs: tuple[str, ...] = (), query_longs: tuple[str, ...] = (), query_lists: tuple[str, ...] = (),
                 block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows of ``answer(index(block), chunk)`` for every block of candidates and chunk of queries.

    Both inputs hold ``vec_id, v`` and the named number columns; ``answer`` gives one array a column of ``schema``, all long.
    """
    spark = candidates.sparkSession
    dims, n = candidates.agg(F.max(F.size("v")), F.count("*")).first()
    qdims, m = queries.agg(F.max(F.size("v")), F.count("*")).first()
    dims = max(dims or 0, qdims or 0, 1)
    blocks = max(1, -(-n // block_rows), min(spark.sparkContext.defaultParallelism, n // 2048))
    left, n_blocks = _numbered(candidates, blocks, block_rows, dims, list(longs), [], f"{name}_blocks")
    right, _ = _numbered(queries, max(1, -(-m // chunk_rows)), chunk_rows, dims, list(query_longs), list(query_lists), f"{name}_queries")
    none = F.lit(None).cast("binary")
    right_names = [c for c in right.columns if c != "no"]
    width = max(len(left.columns), len(right.columns)) - 1
    cells = lambda t, names: [F.col(c).alias(f"c{i}") for i, c in enumerate(names)] + [none.alias(f"c{i}") for i in range(len(names), width)]
    left = left.select(F.col("no").alias("block"), F.lit(-1).alias("no"), *cells(left, [c for c in left.columns if c != "no"]))
    every = F.explode(F.sequence(F.lit(0), F.lit(max(n_blocks, 1) - 1)))
    right = right.select(every.alias("block"), "no", *cells(right, right_names))
    n_longs, n_query_longs, n_cells = len(longs), len(query_longs), len(right_names)

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, of, names = None, None, None
        for b in batches:
            at, no = b.column(0).to_pylist(), b.column(1).to_pylist()
            names = [f.split()[0] for f in schema.split(", ")]
            for i in range(b.num_rows):
                if no[i] < 0:
                    held, of = index(_unpacked([b.column(2 + j)[i].as_py() for j in range(2 + n_longs)], n_longs)), at[i]
                elif held is not None and of == at[i]:
                    cols = answer(held, _unpacked([b.column(2 + j)[i].as_py() for j in range(n_cells)], n_query_longs))
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names)

    stream = left.unionByName(right).repartitionById(max(1, n_blocks), F.col("block").cast("int")).sortWithinPartitions("block", "no")
    return stream.mapInArrow(run, schema)


def product_bound(a: np.ndarray, b: np.ndarray) -> int:
    """No inner product of a row of ``a`` and one of ``b`` exceeds this in size."""
    top = lambda x: max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    return top(a) * top(b) * max(a.shape[1], 1)


def as_longs(scores: np.ndarray) -> np.ndarray:
    """Exact scores as longs; an error where one does not fit."""
    if scores.dtype == object and any(not -_LONG <= int(s) < _LONG for s in scores):
        raise OverflowError("a score exceeds a long")
    return scores.astype(np.int64)


def best_rows(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores in order, ties by smaller id."""
    at = np.arange(len(scores))
    if len(scores) > k > 0:
        kth = (np.sort(scores) if scores.dtype == object else np.partition(scores, len(scores) - k))[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    return at[np.lexsort((ids[at], -scores[at]))][:k]
