"""Scalar values in row expressions: a column with its type, arithmetic, and named functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDTH = {"tinyint": 0, "smallint": 1, "int": 2, "bigint": 3, "float": 4, "double": 5}
_WHOLE = {"tinyint", "smallint", "int", "bigint"}
#: Types named in programs.
TYPES = {"Int": "int", "Long": "bigint", "Double": "double", "Float": "double", "Boolean": "boolean", "String": "string"}


@dataclass(frozen=True)
class Val:
    """A column and its type's name."""

    col: Column
    kind: str

    @property
    def whole(self) -> bool:
        return self.kind in _WHOLE


def wider(a: str, b: str) -> str:
    return a if _WIDTH.get(a, 9) >= _WIDTH.get(b, 9) else b


def arithmetic(op: str, a: Val, b: Val) -> Val:
    """``+ - * / %``: whole division truncates; products and sums of ints are longs, so they do not overflow early."""
    if op == "+" and "string" in (a.kind, b.kind):
        return Val(F.concat(a.col.cast("string"), b.col.cast("string")), "string")
    kind = wider(a.kind, b.kind)
    if op == "/":
        if a.whole and b.whole:
            return Val(F.call_function("div", a.col, b.col), "bigint")
        return Val(F.try_divide(a.col.cast("double"), b.col.cast("double")), "double")
    if op == "%":
        return Val(a.col % b.col, kind)
    if op == "*" and a.whole and b.whole:
        return Val(a.col.cast("bigint") * b.col.cast("bigint"), "bigint")
    made = {"+": lambda: a.col + b.col, "-": lambda: a.col - b.col, "*": lambda: a.col * b.col}[op]()
    return Val(made, kind)


def compare(op: str, a: Val, b: Val) -> Val:
    made = {"==": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op](a.col, b.col)
    return Val(made, "boolean")


def _same(f: Callable[..., Column]) -> Callable[..., Val]:
    return lambda *a: Val(f(*[x.col for x in a]), _widest(a))


def _widest(args: tuple[Val, ...]) -> str:
    kind = args[0].kind
    for x in args[1:]:
        kind = wider(kind, x.kind)
    return kind


def _to(kind: str, f: Callable[..., Column]) -> Callable[..., Val]:
    return lambda *a: Val(f(*[x.col for x in a]), kind)


#: Functions that programs may call by name.
FUNCTIONS: dict[str, Callable[..., Val]] = {
    "max": _same(F.greatest),
    "min": _same(F.least),
    "abs": _same(F.abs),
    "ceil": _to("bigint", F.ceil),
    "floor": _to("bigint", F.floor),
    "sqrt": _to("double", F.sqrt),
    "exp": _to("double", F.exp),
    "log": _to("double", F.log),
    "pow": _to("double", F.pow),
    "sin": _to("double", F.sin),
    "cos": _to("double", F.cos),
    "tanh": _to("double", F.tanh),
    "round": _to("double", F.round),
    "contains": _to("boolean", F.array_contains),
    "range": _to("array<int>", F.sequence),
}


def method(base: Val, name: str, args: list[Val]) -> Val:
    """Methods of row values."""
    casts = {"toInt": "int", "toLong": "bigint", "toDouble": "double", "toString": "string"}
    if name in casts:
        return Val(base.col.cast(casts[name]), casts[name])
    if name == "split":
        return Val(F.split(base.col, args[0].col), "array<string>")
    if name in ("length", "size"):
        return Val(F.size(base.col) if base.kind.startswith(("array", "map")) else F.length(base.col), "int")
    if name == "contains":
        return Val(F.array_contains(base.col, args[0].col) if base.kind.startswith("array") else F.contains(base.col, args[0].col), "boolean")
    if name in ("toLowerCase", "toUpperCase", "trim"):
        return Val({"toLowerCase": F.lower, "toUpperCase": F.upper, "trim": F.trim}[name](base.col), "string")
    if name == "startsWith":
        return Val(F.startswith(base.col, args[0].col), "boolean")
    if name in ("toList", "id"):
        return base
    raise NameError(f"no method {name!r} on a value of type {base.kind}")
