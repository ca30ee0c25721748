"""Programs: declarations, assignments, loops and functions around comprehensions.

Parallel loops become bulk updates: every assignment in a loop body is one
statement over all iterations, run to completion before the next.  ``while``
and loops whose index is used in no array access run on the driver, with a
checkpoint of every tensor they assign after each iteration.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayq.functions import monoids
from arrayq.functions.monoids import Monoid
from arrayq.functions.scalars import TYPES, Val
from arrayq.lang import ast as A
from arrayq.lang.parser import parse
from arrayq.operators import algebra
from arrayq.operators.block import EDGE, Blocks, blocked, multiplied
from arrayq.operators.block import matmul as block_matmul
from arrayq.operators.layouts import LAYOUTS
from arrayq.plans.checkpoint import checkpointed
from arrayq.plans.compile import Compiler, as_frame, as_tensor, walk
from arrayq.plans.values import CompileError, MapRel, Relation, Row, column_of, literal, unpacked
from arrayq.tensor import VALUE, Tensor, index_type, zero_of


class _Returned(Exception):
    def __init__(self, value: Any) -> None:
        self.value = value


def _range(low: int, high: int, step: int = 1) -> range:
    """Both ends belong to it, whichever way it goes."""
    return range(low, high + (1 if step > 0 else -1), step)


_MATH: dict[str, Callable[..., Any]] = {"max": max, "min": min, "abs": abs, "ceil": math.ceil, "floor": math.floor, "sqrt": math.sqrt, "exp": math.exp, "log": math.log, "pow": math.pow, "round": round, "sin": math.sin, "cos": math.cos, "tanh": math.tanh, "range": _range, "format": lambda f, *a: f % a}


class Program:
    """Runs programs over one set of bindings."""

    def __init__(self, spark: SparkSession, bindings: dict[str, Any] | None = None, user_monoids: dict[str, Monoid] | None = None, returns: dict[str, str] | None = None, scalar_functions: set[str] | None = None, seed: int = 42, layout: str = "coo", edge: int | None = None) -> None:
        self.spark, self.seed, self.layout, self.edge = spark, seed, layout, edge
        self.scopes: list[dict[str, Any]] = [dict(bindings or {})]
        self.user_monoids = dict(user_monoids or {})
        self.returns, self.scalar_functions = dict(returns or {}), set(scalar_functions or ())
        self.compiler = Compiler(self)

    # --- names
    def knows(self, name: str) -> bool:
        return any(name in s for s in self.scopes) or name in _MATH or name in monoids.BUILT_IN

    def maybe(self, name: str) -> Any:
        for s in reversed(self.scopes):
            if name in s:
                return s[name]
        return None

    def assign(self, name: str, value: Any) -> None:
        for s in reversed(self.scopes):
            if name in s:
                s[name] = value
                return
        self.scopes[-1][name] = value

    def monoid(self, name: str) -> Monoid:
        if name in self.user_monoids:
            return self.user_monoids[name]
        if name in monoids.BUILT_IN:
            return monoids.BUILT_IN[name]
        function = self.maybe(name)
        if callable(function):
            return monoids.user(name, function)
        raise CompileError(f"no monoid {name!r}")

    def next_seed(self) -> int:
        self.seed += 1
        return self.seed

    # --- running
    def run(self, text: str) -> Any:
        names = set(self.user_monoids) | {n for s in self.scopes for n, v in s.items() if callable(v)}
        tree = parse(text, names)
        out = None
        for s in tree.items:
            out = self.execute(s)
        return out

    def execute(self, s: A.Node) -> Any:
        if isinstance(s, A.Declare):
            value = self.value(s.value) if s.value is not None else self._empty(s.type)
            self.scopes[-1][s.name] = self._settled(value, s.type)
        elif isinstance(s, A.Assign):
            self._assign(s, [])
        elif isinstance(s, A.Block):
            out = None
            for x in s.items:
                out = self.execute(x)
            return out
        elif isinstance(s, A.For):
            if self._parallel(s):
                self._check(s)
                self._bulk(s, [])
            else:
                self._hold(s.body)
                for k in _range(*(self.value(x) for x in (s.range.low, s.range.high, s.range.step))):
                    self.scopes.append({s.name: k})
                    self.execute(s.body)
                    self.scopes.pop()
                    self._cut(s.body)
        elif isinstance(s, A.ForEach):
            self._check(s)
            self._bulk(s, [])
        elif isinstance(s, A.While):
            self._hold(s.body)
            while self.value(s.cond):
                self.execute(s.body)
                self._cut(s.body)
        elif isinstance(s, A.IfStmt):
            if self.value(s.cond):
                return self.execute(s.then)
            if s.other is not None:
                return self.execute(s.other)
        elif isinstance(s, A.Def):
            self.scopes[-1][s.name] = s
        elif isinstance(s, A.Return):
            raise _Returned(self.value(s.value))
        elif isinstance(s, A.TypeMap):
            LAYOUTS.declare(s.name, s, self)
        else:
            value = self.value(s)
            return self._settled(value, None) if isinstance(value, Relation) else value
        return None

    @staticmethod
    def _carried(body: A.Node) -> set[str]:
        """What a loop's body assigns and the next iteration reads: not what it declares itself."""
        own = {x.name for x in walk(body) if isinstance(x, A.Declare)}
        return {next(v.name for v in walk(x.target) if isinstance(v, A.Var)) for x in walk(body) if isinstance(x, A.Assign)} - own

    def _checkpoint(self, name: str) -> None:
        found = self.maybe(name)
        df = found.df if isinstance(found, Tensor) else found
        if isinstance(df, DataFrame) and not df.isStreaming and not getattr(df, "arrayq_cut", False):
            df = checkpointed(df)
            df.arrayq_cut = True
            self.assign(name, found.with_df(df) if isinstance(found, Tensor) else df)

    def _hold(self, body: A.Node) -> None:
        """Before a loop: computes once what its body reads but never changes."""
        for name in sorted({x.name for x in walk(body) if isinstance(x, A.Var)} - self._carried(body)):
            self._checkpoint(name)

    def _cut(self, body: A.Node) -> None:
        """After an iteration: checkpoints what it carries to the next."""
        for name in sorted(self._carried(body)):
            self._checkpoint(name)

    @staticmethod
    def _empty(kind: str | None) -> Any:
        return {"int": 0, "bigint": 0, "double": 0.0, "boolean": False, "string": ""}.get(TYPES.get(kind or "", ""))

    def _settled(self, value: Any, kind: str | None, like: Any = None) -> Any:
        """A relation as a tensor where its dimensions are known, else as a frame."""
        if isinstance(value, Relation):
            if isinstance(like, Tensor):
                return as_tensor(value, like.dims, like.n_dense)
            try:
                return as_tensor(value, None, None)
            except CompileError:
                return as_frame(value)
        if isinstance(like, Tensor) and isinstance(value, Tensor) and value.dims == like.dims and value.n_dense != like.n_dense:
            return value.stored(like.n_dense)
        if kind in ("Double", "Float") and isinstance(value, int):
            return float(value)
        return value

    # --- assignments and parallel loops
    def _assign(self, s: A.Assign, quals: list[A.Node]) -> None:
        target = s.target
        if isinstance(target, A.Var):
            if quals and s.op:
                one = self.monoid("+" if s.op == "-" else s.op)
                value = A.Unary("-", s.value) if s.op == "-" else s.value
                total = self.value(A.Reduce(one.name, A.Comprehension(value, quals)))
                before = self.maybe(target.name)
                self.assign(target.name, self._combine(one, before, total))
                return
            if quals:
                raise CompileError(f"{target.name!r} is overwritten by every iteration")
            old = self.maybe(target.name)
            value = self.value(A.Binary(s.op, target, s.value) if s.op in ("+", "-", "*", "/", "&&", "||", "++", "^") else A.Call(s.op, [target, s.value]) if s.op else s.value)
            self.assign(target.name, self._settled(value, None, old))
            return
        if isinstance(target, A.Field):
            self._assign_field(target, s, quals)
            return
        assert isinstance(target, A.Index)
        if not isinstance(target.base, A.Var):
            raise CompileError("a tensor's element is assigned")
        name = target.base.name
        old = self.maybe(name)
        if not isinstance(old, Tensor):
            raise CompileError(f"{name!r} is no tensor")
        index: A.Node = target.items[0] if len(target.items) == 1 else A.Tuple(target.items)
        if s.op:
            # all increments of an element first, then into the old value
            one = self.monoid("+" if s.op == "-" else s.op)
            value = A.Unary("-", s.value) if s.op == "-" else s.value
            keys = [A.VarPat(self.compiler.fresh("g")) for _ in target.items]
            pattern = keys[0] if len(keys) == 1 else A.TuplePat(keys)
            key = A.Var(keys[0].name) if len(keys) == 1 else A.Tuple([A.Var(k.name) for k in keys])
            own = self.compiler.fresh("w")
            made = self.compiler.comprehension(A.Comprehension(A.Tuple([key, A.Reduce(one.name, A.Var(own))]), [*quals, A.Let(A.VarPat(own), value), A.GroupBy(pattern, index)]))
            cells = self._cells(made, old)
            fresh = cells.select(*old.indices, F.col(VALUE).alias("_b"))
            joined = old.values().withColumnRenamed(VALUE, "_a").join(fresh, old.indices, "left" if old.is_dense else "full")
            before = F.coalesce(F.col("_a"), F.lit(zero_of(old.kind)).cast(old.kind)) if one.zero is not None else F.col("_a")
            both = one.combine(before, F.col("_b"))
            merged = F.when(F.col("_b").isNull(), F.col("_a")).when(before.isNull(), F.col("_b")).otherwise(both).cast(old.kind)
            made_df = joined.select(*old.indices, merged.alias(VALUE))
            self.assign(name, old.with_df(made_df) if old.is_dense else replace(old, df=made_df, n_dense=0).stored(old.n_dense, held_sparse=True))
            return
        made = self.compiler.comprehension(A.Comprehension(A.Tuple([index, s.value]), quals))
        # of several values for an element the largest stays, so the result does not depend on their order
        cells = self._cells(made, old).groupBy(*old.indices).agg(F.max(VALUE).alias(VALUE)) if not self._one_to_one(target.items, quals) else self._cells(made, old)
        new = Tensor(cells.select(*old.indices, F.col(VALUE).cast(old.kind).alias(VALUE)), old.dims, 0, old.kind)
        self.assign(name, algebra.overridden(old, new))

    @staticmethod
    def _cells(made: Relation, old: Tensor) -> DataFrame:
        index, value = unpacked(made.value).items
        index = unpacked(index)
        parts = [column_of(x) for x in (index.items if isinstance(index, Row) else [index])]
        cells = made.df.select(*[p.col.cast(index_type(d)).alias(f"i{k}") for k, (p, d) in enumerate(zip(parts, old.dims, strict=True))], column_of(value).col.alias(VALUE))
        for k, d in enumerate(old.dims):
            cells = cells.where(F.col(f"i{k}").between(0, d - 1))
        return cells

    @staticmethod
    def _one_to_one(items: list[A.Node], quals: list[A.Node]) -> bool:
        """Whether different iterations write different elements: every loop index is an index of the target."""
        loops = [n for q in quals if isinstance(q, A.Generator) for n in A.bound_names(q.pattern)]
        return all(any(isinstance(x, A.Var) and x.name == n for x in items) for n in loops)

    def _assign_field(self, target: A.Field, s: A.Assign, quals: list[A.Node]) -> None:
        """``V[i]#a = e``: one component of the elements' records."""
        path = []
        node: A.Node = target
        while isinstance(node, A.Field):
            path.insert(0, node.name)
            node = node.base
        if not isinstance(node, A.Index) or not isinstance(node.base, A.Var):
            raise CompileError("a component of a tensor's element is assigned")
        old = self.maybe(node.base.name)
        index: A.Node = node.items[0] if len(node.items) == 1 else A.Tuple(node.items)
        made = self.compiler.comprehension(A.Comprehension(A.Tuple([index, s.value]), quals))
        cells = self._cells(made, old)
        one = self.monoid("+" if s.op == "-" else s.op) if s.op else None
        fold = one.aggregate(-F.col(VALUE) if s.op == "-" else F.col(VALUE)) if one else F.max(VALUE)
        fresh = cells.groupBy(*old.indices).agg(fold.alias("_b"))
        joined = old.values().join(fresh, old.indices, "left")
        field = ".".join(path)
        before = F.col(VALUE)
        for p in path:
            before = before.getField(p)
        new = one.combine(before, F.col("_b")) if one else F.col("_b")
        changed = F.when(F.col("_b").isNull(), F.col(VALUE)).otherwise(F.col(VALUE).withField(field, new))
        df = joined.select(*old.indices, changed.alias(VALUE))
        self.assign(node.base.name, Tensor(df, old.dims, old.n_dense, df.schema[VALUE].dataType.simpleString()))

    @staticmethod
    def _combine(one: Monoid, before: Any, total: Any) -> Any:
        if before is None:
            return total
        if total is None:
            return before
        simple = {"+": lambda a, b: a + b, "*": lambda a, b: a * b, "max": max, "min": min, "&&": lambda a, b: a and b, "||": lambda a, b: a or b, "++": lambda a, b: a + b}
        if one.name not in simple:
            raise CompileError(f"{one.name!r} does not fold into a driver value")
        return simple[one.name](before, total)

    def _bulk(self, s: A.Node, quals: list[A.Node]) -> None:
        if isinstance(s, A.For):
            self._bulk(s.body, [*quals, A.Generator(A.VarPat(s.name), s.range)])
        elif isinstance(s, A.ForEach):
            self._bulk(s.body, [*quals, A.Generator(s.pattern, s.domain)])
        elif isinstance(s, A.Block):
            for x in s.items:
                if isinstance(x, A.Declare) and x.value is not None:
                    quals = [*quals, A.Let(A.VarPat(x.name), x.value)]
                else:
                    self._bulk(x, quals)
        elif isinstance(s, A.IfStmt):
            # the guard is judged once, on what the arrays hold before either branch
            held = {n: v for n in A.free_names(s.cond) if isinstance(v := self.maybe(n), Tensor)}
            before = {n: self.compiler.fresh(f"before_{n}_") for n in held}
            for n, v in held.items():
                self.scopes[-1][before[n]] = v
            guard = _renamed(s.cond, before)
            self._bulk(s.then, [*quals, A.Predicate(guard)])
            if s.other is not None:
                self._bulk(s.other, [*quals, A.Predicate(A.Unary("!", guard))])
        elif isinstance(s, A.Assign):
            self._assign(s, quals)
        else:
            raise CompileError(f"{type(s).__name__} does not run in a parallel loop")

    def _parallel(self, s: A.For) -> bool:
        """Whether the loop's index is used in an array access of its body."""
        return any(isinstance(x, A.Index) and s.name in A.free_names(x) - (A.free_names(x.base) if isinstance(x.base, A.Var) else set()) for x in walk(s.body)) and not any(isinstance(x, A.While) for x in walk(s.body))

    def _check(self, s: A.Node) -> None:
        """Targets are affine in the loop indices, and what a loop writes it reads at the same index only."""
        loops: set[str] = set()
        for x in walk(s):
            if isinstance(x, A.For):
                loops.add(x.name)
            elif isinstance(x, A.ForEach):
                loops |= set(A.bound_names(x.pattern))
        written: dict[str, list[list[A.Node]]] = {}
        assigns = [x for x in walk(s) if isinstance(x, A.Assign)]
        for x in assigns:
            target = x.target
            while isinstance(target, A.Field):
                target = target.base
            if isinstance(target, A.Index) and isinstance(target.base, A.Var):
                if not all(_affine(i, loops) for i in target.items):
                    raise CompileError(f"the indices of {target.base.name!r} are not affine in the loop's")
                written.setdefault(target.base.name, []).append(target.items)
        for x in assigns:
            for read in walk(x.value):
                if isinstance(read, A.Index) and isinstance(read.base, A.Var) and read.base.name in written:
                    if not any(_same(read.items, w) for w in written[read.base.name]):
                        raise CompileError(f"{read.base.name!r} is written in a loop that reads it at another index")

    # --- values on the driver
    def value(self, e: A.Node) -> Any:
        return getattr(self, f"_value_{type(e).__name__.lower()}")(e)

    def local(self, value: Any) -> Any:
        """A relation's rows as a list."""
        if isinstance(value, Relation):
            return [_plain(r) for r in as_frame(value).collect()] if isinstance(value.value, Row) else [r[0] for r in as_frame(value).collect()]
        return value

    def frame_of(self, items: list[Any] | range) -> DataFrame:
        """A local list or a range as a frame; ranges are made by the executors."""
        if isinstance(items, range):
            return self.spark.range(items.start, items.stop, items.step).select(F.col("id").cast("int").alias("value"))
        if not items:
            return self.spark.createDataFrame([], "value int")
        if isinstance(items[0], tuple):
            return self.spark.createDataFrame(items, [f"_{k}" for k in range(1, len(items[0]) + 1)])
        return self.spark.createDataFrame([(x,) for x in items], ["value"])

    def _value_const(self, e: A.Const) -> Any:
        return e.value

    def _value_var(self, e: A.Var) -> Any:
        if not any(e.name in s for s in self.scopes):
            raise CompileError(f"no variable {e.name!r}")
        return self.maybe(e.name)

    def _value_tuple(self, e: A.Tuple) -> Any:
        return tuple(self.value(x) for x in e.items)

    def _value_record(self, e: A.Record) -> Any:
        return {n: self.value(x) for n, x in e.items}

    def _value_liste(self, e: A.ListE) -> Any:
        return [self.value(x) for x in e.items]

    def _value_range(self, e: A.Range) -> Any:
        return _range(*(self.value(x) for x in (e.low, e.high, e.step)))

    def _value_comprehension(self, e: A.Comprehension) -> Relation:
        return self.compiler.comprehension(e)

    def _value_field(self, e: A.Field) -> Any:
        base = self.value(e.base)
        return base[int(e.name) - 1] if e.name.isdigit() and not isinstance(base, dict) else base[e.name]

    def _value_unary(self, e: A.Unary) -> Any:
        x = self.value(e.arg)
        return x * -1 if e.op == "-" and isinstance(x, Tensor) else -x if e.op == "-" else not x

    def _value_binary(self, e: A.Binary) -> Any:
        if e.op in ("&&", "||") and not isinstance(left := self.value(e.left), Tensor):
            return bool(left and self.value(e.right)) if e.op == "&&" else bool(left or self.value(e.right))
        a, b = self.value(e.left), self.value(e.right)
        a, b = (self._settled(x, None) if isinstance(x, Relation) else x for x in (a, b))
        if e.op == "@":
            if isinstance(a, Blocks) or not (self.layout == "block" or isinstance(b, Blocks)) or not multiplied(a, b):
                return a @ b
            return block_matmul(a, b, b.edge if isinstance(b, Blocks) else self.edge or EDGE)
        if e.op == "/" and isinstance(a, int) and isinstance(b, int):
            return int(a / b)
        if e.op == "%" and isinstance(a, int) and isinstance(b, int):
            return int(math.fmod(a, b))
        table: dict[str, Callable[[Any, Any], Any]] = {
            "+": lambda x, y: str(x) + str(y) if isinstance(x, str) or isinstance(y, str) else x + y,
            "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: x / y, "%": lambda x, y: x % y,
            "==": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y,
            "^": lambda x, y: x**y, "&&": lambda x, y: x & y, "||": lambda x, y: x | y,
            "++": self._concat, "::": lambda x, y: [x, *y], ":+": lambda x, y: [*x, y],
        }
        return table[e.op](a, b)

    @staticmethod
    def _concat(a: Any, b: Any) -> Any:
        """Bag union."""
        if isinstance(a, DataFrame):
            return a.unionByName(b)
        return [*a, *b] if isinstance(a, (list, range)) else a + b

    def _value_if(self, e: A.If) -> Any:
        return self.value(e.then if self.value(e.cond) else e.other)

    def _value_ascribe(self, e: A.Ascribe) -> Any:
        x = self.value(e.arg)
        return {"Int": int, "Long": int, "Double": float, "Float": float, "String": str, "Boolean": bool}.get(e.type, lambda v: v)(x)

    def _value_match(self, e: A.Match) -> Any:
        value = self.value(e.arg)
        for case in e.cases:
            names: dict[str, Any] = {}
            if not _matches(case.pattern, value, names):
                continue
            self.scopes.append(names)
            try:
                if case.guard is None or self.value(case.guard):
                    return self.value(case.body)
            finally:
                self.scopes.pop()
        raise CompileError("no case matches")

    def _value_lambda(self, e: A.Lambda) -> Any:
        return e

    def _value_reduce(self, e: A.Reduce) -> Any:
        monoid = self.monoid(e.op)
        value = self.value(e.arg)
        if isinstance(value, Tensor):
            df, col = value.values(), Val(F.col(VALUE), value.kind)
        elif isinstance(value, Relation):
            df, col = value.df, column_of(value.value)
        else:
            if isinstance(value, (list, dict, range)):
                value = self.frame_of(value if isinstance(value, range) else list(value))
            df = value
            col = Val(F.col(df.columns[0]) if len(df.columns) == 1 else F.struct(*df.columns), df.schema[0].dataType.simpleString() if len(df.columns) == 1 else "struct")
        if monoid.folds:
            out = monoids.in_steps(df, [], [], [("x", monoid.aggregate(col.col), lambda c: monoid.result(monoid.merge(c)))]).first()[0]
            return monoid.zero if out is None else out
        kind = monoids.result_type(e.op, col.kind)
        made = monoid.aggregate(col.col)
        out = df.agg(made.cast(kind).alias("x") if kind in ("bigint", "int", "double") and e.op in ("+", "*") else made.alias("x")).first()[0]
        return monoid.zero if out is None else out

    def _value_index(self, e: A.Index) -> Any:
        base = self.value(e.base)
        if isinstance(base, Tensor):
            if any(isinstance(x, A.Slice) for x in e.items):
                part = lambda x: slice(*[None if y is None else self.value(y) for y in (x.low, x.high, x.step)]) if isinstance(x, A.Slice) else self.value(x)
                return base[tuple(part(x) for x in e.items)]
            cells = base.values()
            for k, x in enumerate(e.items):
                cells = cells.where(F.col(f"i{k}") == self.value(x))
            found = cells.select(VALUE).first()
            return found[0] if found else zero_of(base.kind)
        keys = [self.value(x) for x in e.items]
        return base[keys[0] if len(keys) == 1 else tuple(keys)]

    def _value_store(self, e: A.Store) -> Tensor:
        made = self._stored(e)
        # a starred dense vector or matrix is held as tiles
        tiled = e.star and not e.sparse and made.rank in (1, 2) and not made.kind.startswith("map")
        return blocked(made, self.edge or EDGE) if tiled else made

    def _stored(self, e: A.Store) -> Tensor:
        dims = tuple(int(self.value(x)) for x in [*e.dense, *e.sparse])
        value = self.value(e.arg)
        if isinstance(value, Tensor):
            return replace(value, dims=dims).stored(len(e.dense), held_sparse=value.dims != dims)
        if isinstance(value, list):
            value = self.frame_of(value)
        if isinstance(value, DataFrame):
            value = self.compiler.compiled([A.Generator(A.VarPat("_row"), A.Var("_frame"))], A.Var("_row"), _with(self, "_frame", value))
        if not isinstance(value, Relation):
            raise CompileError("a tensor is stored from a comprehension, a tensor or a collection")
        return as_tensor(value, dims, len(e.dense))

    def _value_call(self, e: A.Call) -> Any:
        function = self.maybe(e.name)
        if e.name == "println":
            print(*[self.value(x) for x in e.args])
            return None
        if e.name == "cache":
            found = self.value(e.args[0])
            found = self._settled(found, None) if isinstance(found, Relation) else found
            return found.persisted() if isinstance(found, Tensor) else found.persist()
        if e.name in ("rdd", "dataset"):
            found = self.value(e.args[0])
            return as_frame(found) if isinstance(found, Relation) else self.frame_of(found) if isinstance(found, (list, range)) else found
        if e.name == "map":
            found = self.value(e.args[0])
            df = as_frame(found) if isinstance(found, Relation) else self.frame_of(found) if isinstance(found, (list, range)) else found
            return MapRel(df.toDF("k", "v"))
        if e.name == "lift":
            return LAYOUTS.view(e.args[0].name, self.value(e.args[1]))
        if e.name in LAYOUTS.names:
            return LAYOUTS.store(e.name, *[self.value(x) for x in e.args])
        args = [self.value(x) for x in e.args]
        if isinstance(function, A.Def):
            return self._call(function, args)
        if isinstance(function, A.Lambda):
            names: dict[str, Any] = {}
            _matches(function.pattern, args[0] if len(args) == 1 else tuple(args), names)
            self.scopes.append(names)
            try:
                return self.value(function.body)
            finally:
                self.scopes.pop()
        if callable(function):
            return function(*args)
        if e.name in _MATH:
            return _MATH[e.name](*args)
        raise CompileError(f"no function {e.name!r}")

    def _call(self, function: A.Def, args: list[Any]) -> Any:
        self.scopes.append({n: a for (n, _), a in zip(function.params, args, strict=True)})
        try:
            return self.execute(function.body)
        except _Returned as r:
            return r.value
        finally:
            self.scopes.pop()

    def _value_method(self, e: A.Method) -> Any:
        base = self.value(e.base)
        if isinstance(base, Relation):
            base = self._settled(base, None)
        if isinstance(base, Tensor) and e.name in ("t", "dims", "rows", "cols", "length"):
            return getattr(base, e.name)
        if e.name in ("reduce", "reduceByKey"):
            return self._fold(base, e)
        if e.name == "groupByKey" and isinstance(base, DataFrame):
            key, value = base.columns
            return base.groupBy(key).agg(F.collect_list(value).alias(value))
        if e.name == "format" and isinstance(base, str):
            return base % tuple(self.value(a) for a in e.args)
        if e.name == "count" and isinstance(base, (DataFrame, Tensor)):
            return (base.df if isinstance(base, Tensor) else base).count()
        simple: dict[str, Callable[..., Any]] = {"toInt": int, "toLong": int, "toDouble": float, "toString": str, "length": len, "size": len, "toList": list, "split": lambda s, d: s.split(d), "contains": lambda s, x: x in s}
        if e.name in simple:
            return simple[e.name](base, *[self.value(a) for a in e.args])
        if e.name == "textFile":
            from arrayq.sources.text import text_file

            return text_file(self.spark, self.value(e.args[0]))
        raise CompileError(f"no method {e.name!r}")

    def _fold(self, base: Any, e: A.Method) -> Any:
        """``x.reduce(f)`` over values, ``x.reduceByKey(f)`` over (key, value) rows."""
        function = e.args[0]
        assert isinstance(function, A.Lambda)

        def combine(a: Any, b: Any) -> Any:
            from arrayq.plans.compile import Scope

            scope = Scope()
            self.compiler.bind(function.pattern, Row(["_1", "_2"], [Val(a, kind), Val(b, kind)]), scope)
            return column_of(self.compiler.row(function.body, scope)).col

        fold = monoids.folded(combine)
        df = base.values() if isinstance(base, Tensor) else base if isinstance(base, DataFrame) else self.frame_of(base)
        value = df.columns[-1]
        kind = df.schema[value].dataType.simpleString()
        parts = [(value, fold(F.col(value)), fold)]
        if e.name == "reduce":
            return monoids.in_steps(df, [], [], parts).first()[0]
        return monoids.in_steps(df, [F.col(df.columns[0])], [df.columns[0]], parts)


def _with(program: Program, name: str, value: Any) -> Any:
    from arrayq.plans.compile import Scope

    program.scopes[-1][name] = value
    return Scope()


def _plain(r: Any) -> Any:
    return tuple(_plain(x) if isinstance(x, tuple) else x for x in r)


def _matches(pattern: A.Node, value: Any, names: dict[str, Any]) -> bool:
    if isinstance(pattern, A.VarPat):
        names[pattern.name] = value
        return True
    if isinstance(pattern, A.TuplePat):
        return isinstance(value, tuple) and len(value) == len(pattern.items) and all(_matches(p, v, names) for p, v in zip(pattern.items, value, strict=True))
    return isinstance(pattern, A.AnyPat) or (isinstance(pattern, A.ConstPat) and pattern.value == value)


def _renamed(e: A.Node, names: dict[str, str]) -> A.Node:
    if isinstance(e, A.Var):
        return A.Var(names.get(e.name, e.name))
    return A.rebuilt(e, lambda c: _renamed(c, names))


def _affine(e: A.Node, loops: set[str]) -> bool:
    """Sums of loop indices times what does not depend on them."""
    if not A.free_names(e) & loops or isinstance(e, A.Var):
        return True
    if isinstance(e, A.Binary) and e.op in ("+", "-"):
        return _affine(e.left, loops) and _affine(e.right, loops)
    if isinstance(e, A.Binary) and e.op == "*":
        return (not A.free_names(e.left) & loops and _affine(e.right, loops)) or (not A.free_names(e.right) & loops and _affine(e.left, loops))
    return isinstance(e, A.Unary) and _affine(e.arg, loops)


def _same(a: list[A.Node], b: list[A.Node]) -> bool:
    """Whether two index lists are the same text."""

    def equal(x: Any, y: Any) -> bool:
        if isinstance(x, A.Node):
            return type(x) is type(y) and all(equal(p, q) for p, q in zip(vars(x).values(), vars(y).values(), strict=True))
        if isinstance(x, (list, tuple)):
            return len(x) == len(y) and all(map(equal, x, y))
        return bool(x == y)

    return equal(a, b)


__all__ = ["Program", "literal"]
