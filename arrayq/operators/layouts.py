"""User-declared layouts: pairs of functions ``view`` (storage to rows) and ``store`` (rows to storage), by name."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from arrayq.lang.ast import TypeMap
    from arrayq.plans.program import Program


class Layouts:
    def __init__(self) -> None:
        self._known: dict[str, tuple[Callable[..., Any], Callable[..., Any]]] = {}

    @property
    def names(self) -> set[str]:
        return set(self._known)

    def register(self, name: str, view: Callable[..., Any], store: Callable[..., Any]) -> None:
        """``view(storage)`` gives a frame of (index, value) rows; ``store(rows, *args)`` the storage."""
        self._known[name] = (view, store)

    def declare(self, name: str, tree: TypeMap, program: Program) -> None:
        """From a ``typemap`` declaration; its bodies run as program text."""
        from arrayq.lang import ast as A
        from arrayq.plans.compile import as_frame
        from arrayq.plans.values import Relation

        def run(function: A.Lambda, args: list[Any]) -> Any:
            names = A.bound_names(function.pattern)
            program.scopes.append(dict(zip(names, args, strict=True)))
            try:
                value = program.value(function.body)
                return as_frame(value) if isinstance(value, Relation) else value
            finally:
                program.scopes.pop()

        self.register(name, lambda *s: run(tree.view, list(s)), lambda *s: run(tree.store, list(s)[-1:]))

    def view(self, name: str, storage: Any) -> Any:
        view = self._known[name][0]
        return view(*storage) if isinstance(storage, tuple) else view(storage)

    def store(self, name: str, *args: Any) -> Any:
        from arrayq.plans.compile import as_frame
        from arrayq.plans.values import Relation

        return self._known[name][1](*[as_frame(a) if isinstance(a, Relation) else a for a in args])


LAYOUTS = Layouts()


def ragged(rows: DataFrame, index: str, position: str, value: str) -> DataFrame:
    """(index, array of values by position): a vector of vectors of different lengths."""
    held = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(value).alias("x"))))
    return rows.groupBy(index).agg(F.transform(held, lambda e: e["x"]).alias("row"))


def unragged(rows: DataFrame, index: str, row: str) -> DataFrame:
    """(index, position, value) of a vector of vectors."""
    return rows.select(index, F.posexplode(row).alias("position", "value"))


def as_map(rows: DataFrame, key: str, value: str, group: str) -> DataFrame:
    """(group, map from key to value), entries in key order."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key), F.col(value))))
    return rows.groupBy(group).agg(F.map_from_entries(entries).alias("entries"))
