"""Tensors as coordinate DataFrames.

A tensor of rank ``r`` has index columns ``i0 .. i(r-1)`` and a value column
``v``; the index is a key.  The first ``n_dense`` dimensions are dense.  With no
sparse dimension every cell has a row; otherwise only cells with a value other
than the type's zero have one.  Boolean sparse tensors have no value column.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VALUE = "v"


def index_names(rank: int) -> list[str]:
    return [f"i{k}" for k in range(rank)]


def index_type(dim: int) -> str:
    """The type of an index below ``dim``."""
    return "int" if dim < 1 << 31 else "bigint"


def zero_of(kind: str) -> Any:
    """The value that stands for an absent cell."""
    if kind == "boolean":
        return False
    if kind == "string":
        return ""
    if kind in ("double", "float"):
        return 0.0
    return 0


def index_space(spark: SparkSession, dims: tuple[int, ...]) -> DataFrame:
    """Every index of ``dims``, decoded from one distributed range."""
    total = reduce(lambda a, b: a * b, dims, 1)
    columns, step = [], total
    for k, d in enumerate(dims):
        step //= max(d, 1)
        columns.append(F.expr(f"cast((id div {max(step, 1)}) % {max(d, 1)} as {index_type(d)})").alias(f"i{k}"))
    return spark.range(total).select(*columns)


@dataclass(frozen=True)
class Tensor:
    df: DataFrame
    dims: tuple[int, ...]
    n_dense: int
    kind: str

    # --- construction
    @staticmethod
    def of(df: DataFrame, dims: tuple[int, ...], n_dense: int | None = None, indices: list[str] | None = None, value: str | None = VALUE) -> Tensor:
        """A tensor from rows that already have unique indices in range; stored as its layout asks for."""
        names = indices or index_names(len(dims))
        kept = [F.col(c).cast(index_type(d)).alias(f"i{k}") for k, (c, d) in enumerate(zip(names, dims, strict=True))]
        if value is None or value not in df.columns:
            shaped, kind = df.select(*kept, F.lit(True).alias(VALUE)), "boolean"
        else:
            shaped = df.select(*kept, F.col(value).alias(VALUE))
            kind = shaped.schema[VALUE].dataType.simpleString()
        return Tensor(shaped, tuple(dims), 0, kind).stored(len(dims) if n_dense is None else n_dense, held_sparse=True)

    def stored(self, n_dense: int, held_sparse: bool = False) -> Tensor:
        """The same cells in another layout: zeros are filled in or dropped, indices outside the bounds are dropped."""
        rank = len(self.dims)
        inside = reduce(lambda a, b: a & b, [F.col(f"i{k}").between(0, d - 1) for k, d in enumerate(self.dims)], F.lit(True))
        cells = self.values().where(inside)
        if n_dense == rank:
            if held_sparse or not self.is_dense:
                names = index_names(rank)
                space = index_space(cells.sparkSession, self.dims)
                filled = F.coalesce(F.col(VALUE), F.lit(zero_of(self.kind)).cast(self.kind)) if not self.kind.startswith(("struct", "array", "map")) else F.col(VALUE)
                cells = space.join(cells, names, "left").select(*names, filled.alias(VALUE))
            return Tensor(cells, self.dims, n_dense, self.kind)
        if self.kind == "boolean":
            return Tensor(cells.where(F.col(VALUE)).select(*index_names(rank)), self.dims, n_dense, self.kind)
        if not self.kind.startswith(("struct", "array", "map")):
            cells = cells.where(F.col(VALUE) != F.lit(zero_of(self.kind)).cast(self.kind))
        return Tensor(cells, self.dims, n_dense, self.kind)

    # --- views
    @property
    def rank(self) -> int:
        return len(self.dims)

    @property
    def is_dense(self) -> bool:
        return self.n_dense == self.rank

    @property
    def indices(self) -> list[str]:
        return index_names(self.rank)

    @property
    def rows(self) -> int:
        return self.dims[0]

    @property
    def cols(self) -> int:
        return self.dims[1]

    @property
    def length(self) -> int:
        return self.dims[0]

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def values(self) -> DataFrame:
        """Stored cells with a value column, also for boolean tensors."""
        if VALUE in self.df.columns:
            return self.df
        return self.df.withColumn(VALUE, F.lit(True))

    def full(self) -> DataFrame:
        """All cells, absent ones as zero."""
        return self.values() if self.is_dense else self.dense().df

    def dense(self) -> Tensor:
        return self.stored(self.rank)

    def sparse(self, n_dense: int = 0) -> Tensor:
        return self.stored(n_dense)

    def with_df(self, df: DataFrame) -> Tensor:
        return replace(self, df=df)

    def persisted(self) -> Tensor:
        return self.with_df(self.df.persist())

    def named(self, *names: str) -> DataFrame:
        """Cells with other column names: one for each index, then the value's."""
        cells = self.values()
        return cells.select(*[F.col(a).alias(b) for a, b in zip([*self.indices, VALUE], names, strict=True)])

    def value_column(self) -> Column:
        return F.col(VALUE)

    # --- algebra (see arrayq.operators.algebra)
    def _op(self, name: str, other: Any, flipped: bool = False) -> Tensor:
        from arrayq.operators import algebra

        return algebra.cellwise(name, self, other) if isinstance(other, Tensor) else algebra.scalar(name, self, other, flipped)

    def __add__(self, other: Any) -> Tensor:
        return self._op("+", other)

    def __radd__(self, other: Any) -> Tensor:
        return self._op("+", other, True)

    def __sub__(self, other: Any) -> Tensor:
        return self._op("-", other)

    def __rsub__(self, other: Any) -> Tensor:
        return self._op("-", other, True)

    def __mul__(self, other: Any) -> Tensor:
        return self._op("*", other)

    def __rmul__(self, other: Any) -> Tensor:
        return self._op("*", other, True)

    def __truediv__(self, other: Any) -> Tensor:
        return self._op("/", other)

    def __rtruediv__(self, other: Any) -> Tensor:
        return self._op("/", other, True)

    def __and__(self, other: Any) -> Tensor:
        return self._op("&&", other)

    def __or__(self, other: Any) -> Tensor:
        return self._op("||", other)

    def __matmul__(self, other: Tensor) -> Tensor:
        from arrayq.operators import algebra

        return algebra.matmul(self, other)

    @property
    def t(self) -> Tensor:
        from arrayq.operators import algebra

        return algebra.transpose(self)

    def __getitem__(self, items: Any) -> Tensor:
        from arrayq.operators import algebra

        return algebra.sliced(self, items if isinstance(items, tuple) else (items,))
