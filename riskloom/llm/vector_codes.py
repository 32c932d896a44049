"""Vector code compression: product quantisation with integer codebooks, nearest entries found in kd-trees.

A vector's components become integers and are cut into equal parts; each part position has a codebook. In a round every part goes to
its nearest entry, and entries become the floors of their parts' means. The driver builds a kd-tree over each codebook, of 256 entries
at most, and sends it to the tasks; these search it by branch and bound, a batch of parts at a time, and add up their parts as
integers, so that any order of adding gives the same codebooks. Nothing but entries and their sums goes through the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
LEAF = 16
#: Beyond all components, see :func:`limit`.
MOST = 1 << 30
#: Parts that a search holds at a time.
SEARCH_ROWS = 8192


def limit(width: int) -> int:
    """The greatest component, either way, of parts of so many: beyond it components count as it, so that squared distances fit 64
    bits. For parts of 16 it is 2^27."""
    return 1 << (61 - math.ceil(math.log2(max(1, width)))) // 2 - 1


@dataclass(frozen=True)
class Tree:
    """A kd-tree's node: bounds of its points, and two children or a leaf's points with their indexes in the codebook."""

    low: np.ndarray
    high: np.ndarray
    children: tuple[Tree, Tree] | None = None
    points: np.ndarray | None = None
    indexes: np.ndarray | None = None

    @staticmethod
    def of(points: np.ndarray, indexes: np.ndarray | None = None, leaf: int = LEAF) -> Tree:
        """Halved at the median of the widest dimension, down to ``leaf`` points or equal ones."""
        indexes = np.arange(len(points)) if indexes is None else indexes
        low, high = points.min(axis=0, initial=MOST), points.max(axis=0, initial=-MOST)
        if len(points) <= leaf or not points.shape[1] or (low == high).all():
            return Tree(low, high, points=points, indexes=indexes)
        order = np.argsort(points[:, np.argmax(high - low)], kind="stable")
        halves = np.array_split(order, 2)
        return Tree(low, high, children=tuple(Tree.of(points[h], indexes[h], leaf) for h in halves))

    def bound(self, queries: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the box, which no point in it is nearer than."""
        out = np.maximum(self.low - queries, 0) + np.maximum(queries - self.high, 0)
        return np.einsum("ij,ij->i", out, out)

    def search(self, queries: np.ndarray, index: np.ndarray, distance: np.ndarray, rows: np.ndarray, bound: np.ndarray) -> None:
        """Puts into ``index`` and ``distance`` the nearest point of each of ``rows`` of the queries, the lower index on ties, if it is
        better than what stands there. A node is left out only if its bound is over the best distance so far: at an equal one
        it may hold an equal point of a lower index."""
        near = bound <= distance[rows]
        rows, bound = rows[near], bound[near]
        if not len(rows):
            return
        if self.children is None:
            own = queries[rows]
            gaps = np.stack([np.einsum("ij,ij->i", d, d) for d in (own - p for p in self.points)], axis=1)
            least = gaps.min(axis=1)
            where = np.where(gaps == least[:, None], self.indexes, len(index) + ENTRIES * PARTS).min(axis=1)
            better = (least < distance[rows]) | ((least == distance[rows]) & (where < index[rows]))
            index[rows[better]], distance[rows[better]] = where[better], least[better]
            return
        a, b = self.children
        to_a, to_b = a.bound(queries[rows]), b.bound(queries[rows])
        first = to_a <= to_b
        for own, x, bx, y, by in ((first, a, to_a, b, to_b), (~first, b, to_b, a, to_a)):
            if own.any():
                x.search(queries, index, distance, rows[own], bx[own])
                y.search(queries, index, distance, rows[own], by[own])

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each query's nearest point."""
        index = np.full(len(queries), ENTRIES * PARTS, dtype=np.int64)
        distance = np.full(len(queries), np.iinfo(np.int64).max, dtype=np.int64)
        for at in range(0, len(queries), SEARCH_ROWS):
            rows = np.arange(at, min(at + SEARCH_ROWS, len(queries)))
            self.search(queries, index, distance, rows, self.bound(queries[rows]))
        return index, distance


def kept(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, x, label), x of doubles: rows whose vector is neither null nor holds null, NaN or an infinity."""
    x = F.col(vector_col).cast("array<double>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    label = F.col(label_col) if label_col in vectors.columns else F.lit(None).cast("int")
    return vectors.select(F.col(id_col).alias("vec_id"), x.alias("x"), label.alias("label")).where(F.col("x").isNotNull() & F.forall("x", finite))


def integers(column: pa.Array, width: int, scale: int = SCALE, parts: int = PARTS) -> np.ndarray:
    """rows x parts x width of floors of ``scale`` times the components; missing ones are 0, as all vectors are as long as the longest."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    most = limit(width)
    flat = np.clip(np.floor(column.flatten().to_numpy(zero_copy_only=False) * float(scale)), -most, most).astype(np.int64)
    out = np.zeros((len(column), parts * width), dtype=np.int64)
    if len(lengths) and (lengths == parts * width).all():
        out[:] = flat.reshape(out.shape)
    else:
        out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat
    return out.reshape(len(column), parts, width)


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook, entries x width, for each part, of :func:`kept` rows; empty arrays if there are none.

    They start as the parts of the ``entries`` smallest ids, nulls last, ties by vector. ``entries`` is at most 256, so that the driver
    and each task hold codebooks of a bounded size. Vectors shorter than the longest, or than its next multiple of ``parts``, end in zeros.
    """
    if not 0 < entries <= ENTRIES:
        raise ValueError(f"entries must be 1 to {ENTRIES}")
    longest = vectors.agg(F.max(F.size("x")).alias("n")).first().n or 0
    width = -(-longest // parts)
    first = vectors.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    start = integers(pa.array([r.x for r in first], pa.list_(pa.float64())), width, parts=parts)
    books = [start[:, p, :] for p in range(parts)]
    for _ in range(rounds if first else 0):
        sums = _sums(vectors, books, width).collect()
        books = [b.copy() for b in books]
        for r in sums:
            books[r.part][r.entry, r.place] = r.total // r.n
    return books


def _sums(vectors: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """(part, entry, place, total, n): sums of the parts nearest to each entry, added up in each task before they are shuffled."""
    trees = vectors.sparkSession.sparkContext.broadcast([Tree.of(b) for b in books])
    shape = (len(books), len(books[0]), width)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        totals, counts = np.zeros(shape, dtype=np.int64), np.zeros(shape[:2], dtype=np.int64)
        for batch in batches:
            x = integers(batch.column(0), width, parts=shape[0])
            for p, tree in enumerate(trees.value):
                index, _ = tree.nearest(x[:, p, :])
                np.add.at(totals[p], index, x[:, p, :])
                counts[p] += np.bincount(index, minlength=shape[1])
        part, entry = np.nonzero(counts)
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(totals[part, entry].tolist(), pa.list_(pa.int64())), pa.array(counts[part, entry])]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "totals", "n"])

    each = vectors.select("x").mapInArrow(run, "part int, entry int, totals array<long>, n long")
    places = each.select("part", "entry", "n", F.posexplode("totals").alias("place", "total"))
    return places.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def encode(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of :func:`kept` rows: the nearest entries' indexes in part order, two hex digits each, and the sum
    of squared distances to them."""
    width = books[0].shape[1]
    trees = vectors.sparkSession.sparkContext.broadcast([Tree.of(b) for b in books])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column(1), width, parts=len(books))
            code, error = np.zeros((batch.num_rows, len(books)), dtype=np.uint8), np.zeros(batch.num_rows, dtype=np.int64)
            for p, tree in enumerate(trees.value):
                index, distance = tree.nearest(x[:, p, :])
                code[:, p], error = index, error + distance
            text = code.tobytes().hex()
            n = 2 * len(books)
            codes = pa.array([text[i * n : i * n + n] for i in range(batch.num_rows)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), codes, pa.array(error)], names=["vec_id", "label", "code", "error"])

    kinds = dict(vectors.dtypes)
    return vectors.select("vec_id", "x", "label").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``codes`` with ``approximation``: the entries that the code names, as doubles again (the middle of each integer's interval)."""
    tables = [F.lit(((b + 0.5) / SCALE).tolist()) for b in books]
    at = [F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + 1 for p in range(len(books))]
    return codes.withColumn("approximation", F.concat(*[F.element_at(t, i) for t, i in zip(tables, at, strict=True)]))


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error (the errors of all rows of the label, null labels together) and codebooks_sha256, for each row
    whose vector is neither null nor holds null, NaN or an infinity.

    Repeated rows and ids are rows each; null ids stay, as the last ones; other columns are ignored; vectors shorter than the longest,
    empty ones too, end in zeros; components have a :func:`limit`. An empty table gives no rows.
    """
    rows = kept(vectors, id_col, vector_col, label_col)
    books = fit(rows)
    if not len(books[0]):
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    codes = written(rows.sparkSession, encode(rows, books), "codes")
    sums = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
