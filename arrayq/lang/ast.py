"""Syntax trees.  Nodes compare by identity, so passes can keep facts about them in dictionaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, replace
from typing import Any


@dataclass(eq=False)
class Node:
    def children(self) -> Iterator[Node]:
        for f in fields(self):
            yield from _nodes(getattr(self, f.name))


def _nodes(x: Any) -> Iterator[Node]:
    if isinstance(x, Node):
        yield x
    elif isinstance(x, (list, tuple)):
        for y in x:
            yield from _nodes(y)


# patterns
@dataclass(eq=False)
class VarPat(Node):
    name: str


@dataclass(eq=False)
class TuplePat(Node):
    items: list[Node]


@dataclass(eq=False)
class AnyPat(Node):
    pass


@dataclass(eq=False)
class ConstPat(Node):
    value: Any


# expressions
@dataclass(eq=False)
class Const(Node):
    value: Any
    kind: str


@dataclass(eq=False)
class Var(Node):
    name: str


@dataclass(eq=False)
class Tuple(Node):
    items: list[Node]


@dataclass(eq=False)
class Record(Node):
    items: list[tuple[str, Node]]


@dataclass(eq=False)
class ListE(Node):
    items: list[Node]


@dataclass(eq=False)
class Field(Node):
    """``e#name`` or ``e#2``."""

    base: Node
    name: str


@dataclass(eq=False)
class Index(Node):
    """``A[i, j]``."""

    base: Node
    items: list[Node]


@dataclass(eq=False)
class Slice(Node):
    """One axis ``low:high:step`` of a slice; parts may be missing."""

    low: Node | None
    high: Node | None
    step: Node | None


@dataclass(eq=False)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(eq=False)
class Unary(Node):
    op: str
    arg: Node


@dataclass(eq=False)
class Reduce(Node):
    """``op/e``."""

    op: str
    arg: Node


@dataclass(eq=False)
class Call(Node):
    name: str
    args: list[Node]


@dataclass(eq=False)
class Method(Node):
    base: Node
    name: str
    args: list[Node]


@dataclass(eq=False)
class Lambda(Node):
    pattern: Node
    body: Node


@dataclass(eq=False)
class If(Node):
    cond: Node
    then: Node
    other: Node


@dataclass(eq=False)
class Case(Node):
    pattern: Node
    guard: Node | None
    body: Node


@dataclass(eq=False)
class Match(Node):
    arg: Node
    cases: list[Case]


@dataclass(eq=False)
class Ascribe(Node):
    arg: Node
    type: str


@dataclass(eq=False)
class Store(Node):
    """``tensor(dense)(sparse) e``; starred when distributed."""

    dense: list[Node]
    sparse: list[Node]
    arg: Node
    star: bool


@dataclass(eq=False)
class Comprehension(Node):
    head: Node
    quals: list[Node]


# qualifiers
@dataclass(eq=False)
class Generator(Node):
    pattern: Node
    domain: Node
    full: bool = False


@dataclass(eq=False)
class Range(Node):
    """An inclusive range; only a generator's domain or a list."""

    low: Node
    high: Node
    step: Node


@dataclass(eq=False)
class Let(Node):
    pattern: Node
    value: Node


@dataclass(eq=False)
class Predicate(Node):
    cond: Node


@dataclass(eq=False)
class GroupBy(Node):
    pattern: Node
    key: Node


# statements
@dataclass(eq=False)
class Declare(Node):
    name: str
    type: str | None
    value: Node | None


@dataclass(eq=False)
class Assign(Node):
    target: Node
    value: Node
    op: str | None = None


@dataclass(eq=False)
class For(Node):
    name: str
    range: Range
    body: Node


@dataclass(eq=False)
class ForEach(Node):
    pattern: Node
    domain: Node
    body: Node


@dataclass(eq=False)
class While(Node):
    cond: Node
    body: Node


@dataclass(eq=False)
class IfStmt(Node):
    cond: Node
    then: Node
    other: Node | None


@dataclass(eq=False)
class Def(Node):
    name: str
    params: list[tuple[str, str]]
    result: str
    body: Node


@dataclass(eq=False)
class Return(Node):
    value: Node


@dataclass(eq=False)
class Block(Node):
    items: list[Node]


@dataclass(eq=False)
class TypeMap(Node):
    """A user-declared layout: its ``view`` and ``store`` functions."""

    name: str
    params: list[str]
    view: Lambda
    store: Lambda


def bound_names(pattern: Node) -> list[str]:
    """Names that a pattern binds."""
    if isinstance(pattern, VarPat):
        return [pattern.name]
    if isinstance(pattern, TuplePat):
        return [x for p in pattern.items for x in bound_names(p)]
    return []


def free_names(node: Node | None) -> set[str]:
    """Variables that an expression takes from outside."""
    if node is None:
        return set()
    if isinstance(node, Var):
        return {node.name}
    if isinstance(node, Lambda):
        return free_names(node.body) - set(bound_names(node.pattern))
    if isinstance(node, Case):
        return (free_names(node.guard) | free_names(node.body)) - set(bound_names(node.pattern))
    if isinstance(node, Comprehension):
        found: set[str] = set()
        bound: set[str] = set()
        for q in node.quals:
            found |= free_names(q) - bound
            if isinstance(q, (Generator, Let, GroupBy)):
                bound |= set(bound_names(q.pattern))
        return found | (free_names(node.head) - bound)
    if isinstance(node, Call):
        return {node.name}.union(*(free_names(a) for a in node.args))
    if isinstance(node, (VarPat, TuplePat, AnyPat, ConstPat)):
        return set()
    return set().union(*(free_names(c) for c in node.children()))


def rebuilt(node: Node, change: Callable[[Node], Node]) -> Node:
    """A copy with ``change`` applied to the direct children."""

    def new(x: Any) -> Any:
        if isinstance(x, Node):
            return change(x)
        if isinstance(x, list):
            return [new(y) for y in x]
        if isinstance(x, tuple):
            return tuple(new(y) for y in x)
        return x

    return replace(node, **{f.name: new(getattr(node, f.name)) for f in fields(node)})
