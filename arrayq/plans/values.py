"""What names and expressions stand for while a comprehension is compiled."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arrayq.functions.scalars import Val
from arrayq.lang import ast as A


class CompileError(ValueError):
    """The program is well formed but has no meaning here."""


@dataclass
class Row:
    """A tuple or record of values in a row."""

    names: list[str]
    items: list[Any]
    record: bool = False

    def get(self, name: str) -> Any:
        if name in self.names:
            return self.items[self.names.index(name)]
        if name.isdigit() and 1 <= int(name) <= len(self.items):
            return self.items[int(name) - 1]
        raise CompileError(f"no component {name!r}")


def tuple_of(items: list[Any]) -> Row:
    return Row([f"_{k}" for k in range(1, len(items) + 1)], items)


@dataclass
class Bag:
    """A variable lifted by a group-by: its value in the rows before grouping."""

    value: Any


@dataclass
class Grouped:
    """After a group-by: which reductions (by syntax node) became which columns."""

    columns: dict[A.Node, Val]
    outer: Any = None


@dataclass
class Relation:
    """The rows of a comprehension: a frame, and the head's value in its columns."""

    df: DataFrame
    value: Any
    unique: frozenset[str] | None = None
    dims: dict[str, int] = field(default_factory=dict)
    complete: bool = False
    same: dict[str, str] = field(default_factory=dict)


@dataclass
class MapRel:
    """A distributed map: a frame with columns ``k`` and ``v``."""

    df: DataFrame


Host = Callable[..., Any]


def column_of(value: Any) -> Val:
    """One column for a value: tuples and records become structs."""
    if isinstance(value, Val):
        return value
    if isinstance(value, Row):
        parts = [column_of(x) for x in value.items]
        kind = ",".join(f"{n}:{p.kind}" for n, p in zip(value.names, parts, strict=True))
        return Val(F.struct(*[p.col.alias(n) for n, p in zip(value.names, parts, strict=True)]), f"struct<{kind}>")
    return literal(value)


def literal(value: Any) -> Val:
    if isinstance(value, bool):
        return Val(F.lit(value), "boolean")
    if isinstance(value, int):
        return Val(F.lit(value).cast("int") if abs(value) < 1 << 31 else F.lit(value), "int" if abs(value) < 1 << 31 else "bigint")
    if isinstance(value, float):
        return Val(F.lit(value), "double")
    if isinstance(value, str):
        return Val(F.lit(value), "string")
    if isinstance(value, tuple):
        return column_of(tuple_of([literal(x) for x in value]))
    if isinstance(value, list):
        parts = [literal(x) for x in value]
        return Val(F.array(*[p.col for p in parts]), f"array<{parts[0].kind if parts else 'int'}>")
    if value is None:
        return Val(F.lit(None), "void")
    raise CompileError(f"a value of type {type(value).__name__} does not fit into a row")


def from_column(col: Any, data_type: T.DataType) -> Any:
    """A value for a column; struct fields become components."""
    if isinstance(data_type, T.StructType):
        names = [f.name for f in data_type.fields]
        record = names != [f"_{k}" for k in range(1, len(names) + 1)]
        return Row(names, [from_column(col.getField(f.name), f.dataType) for f in data_type.fields], record)
    return Val(col, data_type.simpleString())


def unpacked(value: Any) -> Any:
    """A struct-typed column as its components."""
    if isinstance(value, Val) and value.kind.startswith("struct"):
        return from_column(value.col, T._parse_datatype_string(value.kind))
    return value
