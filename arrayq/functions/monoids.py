"""Monoids for reductions and increments: an aggregate, an identity, and a way to combine two values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Monoid:
    """``aggregate`` maps a column to its aggregate; ``zero`` is the identity (None: an empty reduction is null).

    ``merge`` is the aggregate of partial aggregates (None: there is no such).
    A monoid that ``folds`` collects what it folds, so it is asked for partial
    aggregates first.  ``finish`` maps the last aggregate to the result, which
    has type ``kind`` then.
    """

    name: str
    aggregate: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column]
    zero: Any = None
    merge: Callable[[Column], Column] | None = None
    folds: bool = False
    finish: Callable[[Column], Column] | None = None
    kind: str | None = None

    def result(self, made: Column) -> Column:
        return self.finish(made) if self.finish else made


def folded(combine: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
    """The aggregate of any associative and commutative column function: a collected list, folded in one pass."""

    def aggregate(value: Column) -> Column:
        held = F.collect_list(value)
        return F.aggregate(F.slice(held, F.lit(2), F.greatest(F.size(held) - 1, F.lit(0))), F.get(held, F.lit(0)), combine)

    return aggregate


def in_steps(df: DataFrame, keys: list[Column], names: list[str], parts: list[tuple[str, Column, Callable[[Column], Column]]]) -> DataFrame:
    """Aggregates ``(name, partial, merge)`` by ``keys``, which get ``names``: within each partition first, then what these yield.

    No list is longer than a partition or the number of partitions, however many rows a key has.
    """
    first = df.groupBy(*keys, F.spark_partition_id().alias("_part")).agg(*[partial.alias(name) for name, partial, _ in parts])
    last = [merge(F.col(name)).alias(name) for name, _, merge in parts]
    return first.groupBy(*names).agg(*last) if names else first.agg(*last)


def _joined(c: Column) -> Column:
    return F.flatten(F.collect_list(c))


BUILT_IN: dict[str, Monoid] = {
    "+": Monoid("+", F.sum, lambda a, b: a + b, 0, F.sum),
    "*": Monoid("*", F.product, lambda a, b: a * b, 1, F.product),
    "max": Monoid("max", F.max, F.greatest, None, F.max),
    "min": Monoid("min", F.min, F.least, None, F.min),
    "&&": Monoid("&&", F.bool_and, lambda a, b: a & b, True, F.bool_and),
    "||": Monoid("||", F.bool_or, lambda a, b: a | b, False, F.bool_or),
    "++": Monoid("++", _joined, F.concat, None, _joined),
    "avg": Monoid("avg", F.avg, lambda a, b: (a + b) / 2),
    "count": Monoid("count", F.count, lambda a, b: a + b, 0, F.sum),
}


def user(name: str, combine: Callable[[Column, Column], Column], zero: Any = None, finish: Callable[[Column], Column] | None = None, kind: str | None = None) -> Monoid:
    """A monoid from a function of two columns; structs fold as well as numbers.  ``finish`` makes the result, of type ``kind``, from the last value."""
    if finish and not kind:
        raise ValueError("a finished monoid states its result's type")
    return Monoid(name, folded(combine), combine, zero, folded(combine), True, finish, kind)


def result_type(name: str, kind: str) -> str:
    """The type of a reduction over values of type ``kind``."""
    if name == "count":
        return "bigint"
    if name == "avg":
        return "double"
    if name == "+" and kind in ("int", "smallint", "tinyint", "bigint"):
        return "bigint"
    return kind
