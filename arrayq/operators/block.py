"""Dense vectors and matrices as square tiles.

``tensor*(..) e`` stores them.  A generator, a reduction or a group-by reads the
cells out of a tile where it lies, so what it aggregates is combined tile by
tile before anything is shuffled; arithmetic on equal tilings zips tiles, and
products go through Arrow batches of tiles in NumPy.  Worth it for dense
operands only; sparse ones stay in coordinates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayq.functions.scalars import Val
from arrayq.operators.algebra import combined
from arrayq.tensor import VALUE, Tensor, index_type

EDGE = 256
#: Tiles along the shared dimension that one task multiplies for a result tile.
DEPTH = 64
#: Cells of a panel, the rows of one operand that a task multiplies by as many columns of the other.
PANEL = 1 << 18


@dataclass(frozen=True)
class Blocks(Tensor):
    """A dense vector or matrix held as tiles (see :func:`packed`); ``df`` reads its cells out of them."""

    tiles: DataFrame
    edge: int

    def with_df(self, df: DataFrame) -> Tensor:
        return Tensor(df, self.dims, self.n_dense, self.kind)

    def persisted(self) -> Blocks:
        return of_tiles(self.tiles.persist(), self.dims, self.kind, self.edge)

    def _op(self, name: str, other: Any, flipped: bool = False) -> Tensor:
        own = lambda x: Val(x, self.kind)
        if isinstance(other, Blocks) and (other.dims, other.edge) == (self.dims, self.edge):
            joined = self.tiles.join(other.tiles.select("b0", "b1", F.col("data").alias("_other")), ["b0", "b1"])
            made = lambda x, y: combined(name, own(x), Val(y, other.kind))
            kind = made(F.lit(None), F.lit(None)).kind
            return of_tiles(joined.withColumn("data", F.zip_with("data", "_other", lambda x, y: made(x, y).col)).drop("_other"), self.dims, kind, self.edge)
        if isinstance(other, (bool, int, float)):
            number = Val(F.lit(other), {bool: "boolean", int: "int", float: "double"}[type(other)])
            one = lambda x: combined(name, number, own(x)) if flipped else combined(name, own(x), number)
            return of_tiles(self.tiles.withColumn("data", F.transform("data", lambda x: one(x).col)), self.dims, one(F.lit(None)).kind, self.edge)
        return super()._op(name, other, flipped)

    def __matmul__(self, other: Tensor) -> Tensor:
        return matmul(self, other, self.edge) if multiplied(self, other) else super().__matmul__(other)

    @property
    def t(self) -> Tensor:
        if self.rank != 2:
            return super().t
        turned = F.expr("transform(sequence(0, rows * cols - 1), p -> data[cast((p % rows) * cols + p div rows as int)])")
        swapped = self.tiles.select(F.col("b1").alias("b0"), F.col("b0").alias("b1"), F.col("cols").alias("rows"), F.col("rows").alias("cols"), turned.alias("data"))
        return of_tiles(swapped, self.dims[::-1], self.kind, self.edge)


def packed(t: Tensor, edge: int = EDGE) -> DataFrame:
    """(b0, b1, rows, cols, data): tiles in row-major order; those at the ends are smaller.  A vector is one column."""
    if t.rank not in (1, 2) or not t.is_dense:
        raise ValueError("blocks hold dense vectors and matrices")
    n, m = t.dims if t.rank == 2 else (*t.dims, 1)
    column = F.col("i1") if t.rank == 2 else F.lit(0)
    tiled = t.values().select(
        F.expr(f"cast(i0 div {edge} as int)").alias("b0"), F.floor(column / edge).cast("int").alias("b1"),
        F.struct((F.col("i0") % edge).alias("r"), (column % edge).alias("c"), F.col(VALUE).alias("x")).alias("cell"),
    )
    # a group is one tile: edge * edge cells at most
    held = tiled.groupBy("b0", "b1").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    size = lambda b, d: F.least(F.lit(edge), F.lit(d) - F.col(b) * edge).cast("int")
    return held.select("b0", "b1", size("b0", n).alias("rows"), size("b1", m).alias("cols"), F.transform("cells", lambda e: e["x"]).alias("data"))


def of_tiles(tiles: DataFrame, dims: tuple[int, ...], kind: str, edge: int = EDGE) -> Blocks:
    """The tensor that tiles hold."""
    cells = tiles.select("b0", "b1", "cols", F.posexplode("data").alias("p", VALUE))
    index = [F.expr(f"cast(b0 * {edge} + p div cols as {index_type(dims[0])})").alias("i0")]
    if len(dims) == 2:
        index.append(F.expr(f"cast(b1 * {edge} + p % cols as {index_type(dims[1])})").alias("i1"))
    return Blocks(cells.select(*index, VALUE), tuple(dims), len(dims), kind, tiles, edge)


def blocked(t: Tensor, edge: int = EDGE) -> Blocks:
    """A dense tensor's cells as tiles."""
    return t if isinstance(t, Blocks) and t.edge == edge else of_tiles(packed(t, edge), t.dims, t.kind, edge)


def multiplied(a: Tensor, b: Tensor) -> bool:
    """Whether two tensors are multiplied on tiles: dense matrices of floating-point numbers."""
    return all(x.is_dense and x.rank == 2 and x.kind in ("double", "float") for x in (a, b))


def _floats(t: Tensor, edge: int) -> DataFrame:
    return blocked(t, edge).tiles.withColumn("data", F.col("data").cast("array<double>"))


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the products for each result tile; rows come sorted by result tile, shared coordinate and side."""
    key, total, left = None, None, None

    def made() -> pa.RecordBatch:
        b0, b1, _ = key
        return pa.RecordBatch.from_arrays([pa.array([b0], pa.int32()), pa.array([b1], pa.int32()), pa.array([total.shape[1]], pa.int32()), pa.array([total.ravel()], pa.list_(pa.float64()))], ["b0", "b1", "cols", "data"])

    for batch in batches:
        b0, b1, part, side, rows, cols = (batch.column(k).to_pylist() for k in (0, 1, 2, 4, 5, 6))
        for i in range(batch.num_rows):
            if (b0[i], b1[i], part[i]) != key:
                if total is not None:
                    yield made()
                key, total = (b0[i], b1[i], part[i]), None
            tile = batch.column(7)[i].values.to_numpy(zero_copy_only=False).reshape(rows[i], cols[i])
            if side[i] == 0:
                left = tile
            else:
                total = left @ tile if total is None else total + left @ tile
    if total is not None:
        yield made()


def narrow(n: int, m: int, p: int, edge: int = EDGE) -> bool:
    """Whether a product of ``n x m`` and ``m x p`` has a short shared dimension: whole rows and columns fit into panels."""
    return m <= max(n, p) and m * edge <= PANEL


def _panels(t: Tensor, axis: int, m: int, size: int, name: str) -> DataFrame:
    """(name, name_at, name_x): ``size`` rows (``axis`` 0) or columns of a tensor, a panel in a partition; absent cells are zero."""
    count = max(1, -(-t.dims[axis] // size))
    outer, shared = f"i{axis}", f"i{1 - axis}"
    inside = F.col(outer).between(0, t.dims[axis] - 1) & F.col(shared).between(0, m - 1) & F.col(VALUE).isNotNull()
    at = F.expr(f"cast(({outer} % {size}) * {m} + {shared} as int)").alias("at")
    cells = t.values().where(inside).select(F.expr(f"cast({outer} div {size} as int)").alias(name), F.struct(at, F.col(VALUE).cast("double").alias("x")).alias("cell"))
    every = t.spark.range(count).select(F.col("id").cast("int").alias(name), F.lit(None).cast(cells.schema["cell"].dataType).alias("cell"))
    # a group is one panel: PANEL cells at most
    held = cells.unionByName(every).repartitionById(count, F.col(name)).groupBy(name).agg(F.collect_list("cell").alias("cells"))
    return held.select(name, F.col("cells.at").alias(f"{name}_at"), F.col("cells.x").alias(f"{name}_x"))


def _outer(a: Tensor, b: Tensor, edge: int) -> Blocks:
    """A product with a short shared dimension: every panel of rows meets every panel of columns.

    Both operands are shuffled once.  The tasks of the Cartesian product read the
    same shuffled panels again, so nothing is copied for each result tile; a task
    holds two panels and one result tile.
    """
    (n, m), p = a.dims, b.dims[1]
    # a side has four panels at least if its tiles allow
    low, high = (edge * max(1, min(PANEL // max(1, m), -(-d // 4)) // edge) for d in (n, p))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sides = []
                for k, size in ((0, low), (3, high)):
                    dense = np.zeros(size * m)
                    dense[batch.column(k + 1)[i].values.to_numpy()] = batch.column(k + 2)[i].values.to_numpy()
                    sides.append(dense.reshape(size, m))
                tops, lefts = batch.column(0)[i].as_py() * low, batch.column(3)[i].as_py() * high
                for top in range(0, min(low, n - tops), edge):
                    rows = sides[0][top : min(top + edge, n - tops)]
                    for left in range(0, min(high, p - lefts), edge):
                        tile = rows @ sides[1][left : min(left + edge, p - lefts)].T
                        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in ((tops + top) // edge, (lefts + left) // edge, *tile.shape)), pa.array([tile.ravel()], pa.list_(pa.float64()))], ["b0", "b1", "rows", "cols", "data"])

    pairs = _panels(a, 0, m, low, "p0").hint("shuffle_replicate_nl").crossJoin(_panels(b, 1, m, high, "p1"))
    return of_tiles(pairs.mapInArrow(products, "b0 int, b1 int, rows int, cols int, data array<double>"), (n, p), "double", edge)


def matmul(a: Tensor, b: Tensor, edge: int = EDGE, depth: int = DEPTH) -> Tensor:
    """``a @ b`` on panels where the shared dimension is short, else as a group-by-join on result tiles.

    A left tile is sent to all result tiles of its row and a right one to all of
    its column, in stretches of ``depth`` tiles along the shared dimension, so
    the work is dealt out by result tile and stretch, whatever the shape; a task
    holds one tile of either side and the sum.  Only where the shared dimension
    has several stretches are their sums added, by cell and with map-side
    combining.
    """
    (n, m), p = a.dims, b.dims[1]
    if m != b.dims[0]:
        raise ValueError(f"{a.dims} and {b.dims} do not fit")
    if narrow(n, m, p, edge):
        return _outer(a, b, edge)
    down, across = -(-n // edge), -(-p // edge)
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = _floats(a, edge).withColumnRenamed("b1", "k").withColumn("side", F.lit(0)).withColumn("b1", every(across))
    right = _floats(b, edge).withColumnRenamed("b0", "k").withColumn("side", F.lit(1)).withColumn("b0", every(down))
    both = left.unionByName(right).select("b0", "b1", F.expr(f"cast(k div {depth} as int)").alias("part"), "k", "side", "rows", "cols", "data")
    dealt = both.repartition("b0", "b1", "part").sortWithinPartitions("b0", "b1", "part", "k", "side")
    tiles = dealt.mapInArrow(_products, "b0 int, b1 int, cols int, data array<double>")
    out = of_tiles(tiles.withColumn("rows", F.expr("cast(size(data) div cols as int)")), (n, p), "double", edge)
    if -(-m // edge) <= depth:
        return out
    return out.with_df(out.df.groupBy("i0", "i1").agg(F.sum(VALUE).alias(VALUE)))
