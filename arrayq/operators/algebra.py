"""Tensor algebra over coordinate DataFrames: joins on indices and grouped sums, left to the optimizer."""

from __future__ import annotations

from math import prod
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayq.functions.monoids import BUILT_IN
from arrayq.functions.scalars import Val, arithmetic, wider
from arrayq.tensor import VALUE, Tensor, index_names, index_type, zero_of


#: Products that one task of a contraction makes or adds up, about; and result cells that a task may hold anyway.
PRODUCTS, HELD = 2_000_000, 1 << 22


def combined(op: str, a: Val, b: Val) -> Val:
    if op in ("&&", "||"):
        return Val(a.col & b.col if op == "&&" else a.col | b.col, "boolean")
    return arithmetic(op, a, b)


def cellwise(op: str, a: Tensor, b: Tensor, how: str = "inner") -> Tensor:
    """Cells of equal index combined.  ``inner``: cells stored in both; ``full``: absent cells count as zero."""
    if a.rank != b.rank:
        raise ValueError(f"ranks differ: {a.rank} and {b.rank}")
    names = a.indices
    joined = a.values().withColumnRenamed(VALUE, "_a").join(b.values().withColumnRenamed(VALUE, "_b"), names, how)
    left, right = F.col("_a"), F.col("_b")
    if how == "full":
        left, right = (F.coalesce(c, F.lit(zero_of(t.kind)).cast(t.kind)) for c, t in ((left, a), (right, b)))
    made = combined(op, Val(left, a.kind), Val(right, b.kind))
    dims = tuple(max(x, y) for x, y in zip(a.dims, b.dims, strict=True)) if how == "full" else tuple(min(x, y) for x, y in zip(a.dims, b.dims, strict=True))
    both_dense = a.is_dense and b.is_dense
    out = Tensor(joined.select(*names, made.col.alias(VALUE)), dims, a.rank if both_dense else min(a.n_dense, b.n_dense), made.kind)
    return out if both_dense else out.stored(out.n_dense)


def scalar(op: str, a: Tensor, number: Any, flipped: bool = False) -> Tensor:
    """Stored cells combined with a number."""
    kind = {bool: "boolean", int: "int", float: "double"}[type(number)]
    own, other = Val(F.col(VALUE), a.kind), Val(F.lit(number), kind)
    made = combined(op, other, own) if flipped else combined(op, own, other)
    out = Tensor(a.values().select(*a.indices, made.col.alias(VALUE)), a.dims, a.n_dense, made.kind)
    return out if a.is_dense else out.stored(a.n_dense)


def transpose(a: Tensor) -> Tensor:
    """Rows as columns; a matrix with dense rows and sparse columns has no dense dimension afterwards."""
    if a.rank != 2:
        raise ValueError("only matrices are transposed")
    kept = [F.col("i1").alias("i0"), F.col("i0").alias("i1")] + ([F.col(VALUE)] if VALUE in a.df.columns else [])
    return Tensor(a.df.select(*kept), a.dims[::-1], a.n_dense if a.n_dense in (0, 2) else 0, a.kind)


def _tasks(left: DataFrame, right: DataFrame, a: str, b: str) -> int:
    """Tasks for the products of two frames that meet where ``a`` equals ``b``: by their number, which no size of the operands tells."""
    met = left.groupBy(a).agg(F.count(F.lit(1)).cast("double").alias("_m")).join(right.groupBy(b).agg(F.count(F.lit(1)).cast("double").alias("_n")), F.col(a) == F.col(b))
    return max(1, -(-int(met.agg(F.coalesce(F.sum(F.col("_m") * F.col("_n")), F.lit(0.0))).first()[0]) // PRODUCTS))


def contract(a: Tensor, b: Tensor, axis_a: int, axis_b: int, plus: str = "+", times: str = "*") -> DataFrame:
    """Sums of products over one shared index; columns i0.. (a's left indices, then b's) and v."""
    left = a.named(*[f"a{k}" for k in range(a.rank)], "_a")
    right = b.named(*[f"b{k}" for k in range(b.rank)], "_b")
    made = combined(times, Val(F.col("_a"), a.kind), Val(F.col("_b"), b.kind)) if times in ("+", "-", "*", "/", "&&", "||") else Val(BUILT_IN[times].combine(F.col("_a"), F.col("_b")), wider(a.kind, b.kind))
    keys = [f"a{k}" for k in range(a.rank) if k != axis_a] + [f"b{k}" for k in range(b.rank) if k != axis_b]
    on, cells = (f"a{axis_a}", f"b{axis_b}"), prod(d for t, axis in ((a, axis_a), (b, axis_b)) for k, d in enumerate(t.dims) if k != axis)
    parts = _tasks(left, right, *on) if cells > HELD else 1
    if parts > 1:
        left, right = left.repartition(parts, on[0]), right.repartition(parts, on[1])
    joined = left.join(right, F.col(on[0]) == F.col(on[1]))
    if parts > 1:
        # most products have a cell of their own in a task's share, so combining them before the shuffle only takes memory
        joined = joined.repartition(parts, *keys)
    summed = joined.groupBy(*keys).agg(BUILT_IN[plus].aggregate(made.col).alias(VALUE))
    return summed.select(*[F.col(k).alias(f"i{n}") for n, k in enumerate(keys)], VALUE)


def matmul(a: Tensor, b: Tensor) -> Tensor:
    """Matrix times matrix or vector.  Cells that meet nothing are zero: filled in where the result is dense.

    A join on the shared index pairs every row with every column once for each of
    its values.  Where dense matrices share few of them, and rows and columns are
    many, the product is made of panels instead.
    """
    from arrayq.operators import block

    if a.rank != 2 or b.rank not in (1, 2):
        raise ValueError("a matrix and a matrix or vector are multiplied")
    if block.multiplied(a, b) and a.dims[1] == b.dims[0] and min(a.dims[0], b.dims[1]) > block.EDGE and block.narrow(*a.dims, b.dims[1]):
        out = block.matmul(a, b)
        return out.with_df(out.df)
    cells = contract(a, b, 1, 0)
    dims = (a.dims[0],) if b.rank == 1 else (a.dims[0], b.dims[1])
    kind = cells.schema[VALUE].dataType.simpleString()
    # a sparse result where both operands are sparse; dense otherwise
    n_dense = 0 if not a.is_dense and not b.is_dense else len(dims)
    return Tensor(cells, dims, 0, kind).stored(n_dense, held_sparse=True)


def reduced(a: Tensor, monoid: str, keep: list[int]) -> Tensor:
    """Cells folded over all indices but ``keep``."""
    names = [f"i{k}" for k in keep]
    cells = a.values().groupBy(*names).agg(BUILT_IN[monoid].aggregate(F.col(VALUE)).alias(VALUE)).select(*[F.col(n).alias(f"i{k}") for k, n in enumerate(names)], VALUE)
    return Tensor(cells, tuple(a.dims[k] for k in keep), 0, cells.schema[VALUE].dataType.simpleString()).stored(len(keep), held_sparse=True)


def _bounds(item: slice, dim: int) -> tuple[int, int, int]:
    """First and last source index (both inside the slice) and the stride."""
    low = 0 if item.start is None else item.start
    high = dim - 1 if item.stop is None else min(item.stop, dim - 1)
    return low, high, 1 if item.step is None else item.step


def sliced(a: Tensor, items: tuple[Any, ...]) -> Tensor:
    """``A[2:5, 3:8:2, k]``: ends belong to the slice; a number fixes its index and drops the dimension."""
    if len(items) != a.rank:
        raise ValueError(f"{a.rank} indices expected")
    cells, kept, dims, dense = a.values(), [], [], 0
    for k, item in enumerate(items):
        at = F.col(f"i{k}")
        if isinstance(item, slice):
            low, high, step = _bounds(item, a.dims[k])
            cells = cells.where(at.between(low, high) & ((at - low) % step == 0))
            kept.append(F.expr(f"cast((i{k} - {low}) div {step} as {index_type(a.dims[k])})").alias(f"i{len(dims)}"))
            dims.append(max(0, (high - low) // step + 1))
            dense += k < a.n_dense
        else:
            cells = cells.where(at == int(item))
    out = Tensor(cells.select(*kept, VALUE), tuple(dims), dense if not a.is_dense else len(dims), a.kind)
    return out if VALUE in a.df.columns else out.stored(out.n_dense)


def shifted(a: Tensor, offsets: tuple[int, ...], wrap: bool = True) -> Tensor:
    """Every cell moved by ``offsets``; around the ends, or dropped there."""
    moved = [(F.pmod(F.col(f"i{k}") + o, F.lit(d)) if wrap else F.col(f"i{k}") + o).cast(index_type(d)).alias(f"i{k}") for k, (o, d) in enumerate(zip(offsets, a.dims, strict=True))]
    out = Tensor(a.values().select(*moved, VALUE), a.dims, a.n_dense, a.kind)
    return out.stored(a.n_dense, held_sparse=not wrap)


def merged(a: Tensor, b: Tensor, monoid: str = "+") -> Tensor:
    """Union of the cells of two tensors, combined under a monoid where both have one."""
    m, names = BUILT_IN[monoid], index_names(a.rank)
    joined = a.values().withColumnRenamed(VALUE, "_a").join(b.values().withColumnRenamed(VALUE, "_b"), names, "full")
    made = F.when(F.col("_a").isNull(), F.col("_b")).when(F.col("_b").isNull(), F.col("_a")).otherwise(m.combine(F.col("_a"), F.col("_b")))
    return Tensor(joined.select(*names, made.alias(VALUE)), a.dims, a.n_dense, wider(a.kind, b.kind)).stored(a.n_dense, held_sparse=True)


def overridden(a: Tensor, b: Tensor) -> Tensor:
    """The cells of ``a`` with those of ``b`` in their place; cells only ``b`` has are added."""
    names = a.indices
    fresh = b.values().select(*names, F.col(VALUE).alias("_b"), F.lit(True).alias("_new"))
    # a dense tensor has all cells already
    joined = a.values().withColumnRenamed(VALUE, "_a").join(fresh, names, "left" if a.is_dense else "full")
    made = F.when(F.col("_new"), F.col("_b")).otherwise(F.col("_a"))
    return Tensor(joined.select(*names, made.alias(VALUE)), a.dims, a.n_dense, wider(a.kind, b.kind)).stored(a.n_dense)
