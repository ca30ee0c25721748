"""Comprehensions to DataFrames.

Qualifiers are walked from left to right with a :class:`Scope`: a frame, what
each name stands for in its columns, and facts about keys.  Every generator gets
fresh column names.  Equality predicates that link a generator to what is bound
already become its join condition; everything else is left to the optimizer.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arrayq.functions import monoids
from arrayq.functions.scalars import FUNCTIONS, TYPES, Val, arithmetic, compare, method
from arrayq.lang import ast as A
from arrayq.plans import rewrite
from arrayq.plans.values import Bag, CompileError, MapRel, Relation, Row, column_of, from_column, literal, tuple_of, unpacked
from arrayq.tensor import VALUE, Tensor, index_type, zero_of

if TYPE_CHECKING:
    from arrayq.plans.program import Program

_COUNT = ("length", "size")
#: Expressions that give equal values for equal rows and need nothing but the row.
_PLAIN = (A.Var, A.Const, A.Binary, A.Unary, A.Tuple, A.Field)


@dataclass
class Scope:
    df: DataFrame | None = None
    env: dict[str, Any] = field(default_factory=dict)
    #: Columns that tell rows apart, if known.
    unique: frozenset[str] | None = frozenset()
    #: Tensor generators so far: the tensor, its index columns, the value's column.
    tensors: list[tuple[Tensor, list[str], str]] = field(default_factory=list)
    #: Extents of index columns.
    dims: dict[str, int] = field(default_factory=dict)
    #: Whether there is a row for every combination of the index columns in ``dims`` (those in ``same`` follow others).
    complete: bool = False
    same: dict[str, str] = field(default_factory=dict)
    #: Columns that stand for whole syntax nodes: reductions and nested comprehensions.
    made: dict[A.Node, Any] = field(default_factory=dict)


class Compiler:
    def __init__(self, program: Program) -> None:
        self.program = program
        self.spark = program.spark
        self.counter = 0
        #: By generator: rows that stand for its domain's (see :meth:`counted`).
        self.held: dict[A.Node, DataFrame] = {}
        #: By alias: an aggregate's partial form, how partial ones merge, and whether it folds a list.
        self.steps: dict[str, tuple[Column, Any, bool]] = {}

    def fresh(self, base: str) -> str:
        self.counter += 1
        return f"_{base}{self.counter}"

    # --- comprehensions
    def comprehension(self, c: A.Comprehension) -> Relation:
        quals, head = self.lowered(rewrite.flattened(c.quals), c.head)
        quals = rewrite.without_ranges(quals, self.is_constant)
        quals, head = self.counted(quals, head)
        return self.compiled(quals, head, Scope())

    def compiled(self, quals: list[A.Node], head: A.Node, scope: Scope) -> Relation:
        quals = list(quals)
        while quals:
            q = quals.pop(0)
            if isinstance(q, A.Generator):
                self.generator(q, scope, quals)
            elif isinstance(q, A.Let):
                self.nested(q.value, scope)
                self.bind(q.pattern, self.row(q.value, scope), scope)
            elif isinstance(q, A.Predicate):
                self.nested(q.cond, scope)
                self.filter(self.row(q.cond, scope), scope)
            elif isinstance(q, A.GroupBy):
                self.group(q, scope, quals, head)
            else:
                raise CompileError(f"{type(q).__name__} is no qualifier")
        self.nested(head, scope)
        value = self.row(head, scope)
        df = scope.df if scope.df is not None else self.unit()
        return Relation(df, value, scope.unique, scope.dims, scope.complete and scope.df is not None, scope.same)

    def unit(self) -> DataFrame:
        return self.spark.range(1).select(F.lit(0).alias(self.fresh("unit")))

    def is_constant(self, node: A.Node) -> bool:
        """Whether an expression needs driver values only."""
        return all(self.program.knows(n) for n in A.free_names(node))

    def lowered(self, quals: list[A.Node], head: A.Node) -> tuple[list[A.Node], A.Node]:
        """Element accesses ``A[i, j]`` become generators over the tensor with equalities on its indices."""
        out: list[A.Node] = []
        bound: set[str] = set()
        held: dict[tuple, A.Var] = {}

        def changed(node: A.Node) -> A.Node:
            if isinstance(node, A.Comprehension):
                return node
            if isinstance(node, A.Index) and isinstance(node.base, A.Var) and node.base.name not in bound and isinstance(self.program.maybe(node.base.name), Tensor) and not any(isinstance(x, A.Slice) for x in node.items):
                items = [changed(x) for x in node.items]
                key = (node.base.name, *(x.name if isinstance(x, A.Var) else id(x) for x in items))
                if key not in held:
                    names = [self.fresh(f"at_{node.base.name}_") for _ in items]
                    value = self.fresh(f"of_{node.base.name}_")
                    index = A.VarPat(names[0]) if len(names) == 1 else A.TuplePat([A.VarPat(n) for n in names])
                    out.append(A.Generator(A.TuplePat([index, A.VarPat(value)]), node.base))
                    out.extend(A.Predicate(A.Binary("==", A.Var(n), x)) for n, x in zip(names, items, strict=True))
                    held[key] = A.Var(value)
                return held[key]
            return A.rebuilt(node, changed)

        for q in quals:
            if isinstance(q, A.Generator):
                out.append(q)
            else:
                out.append(A.rebuilt(q, lambda c: c if isinstance(c, (A.VarPat, A.TuplePat, A.AnyPat, A.ConstPat)) else changed(c)))
            if isinstance(q, (A.Generator, A.Let, A.GroupBy)):
                bound |= set(A.bound_names(q.pattern))
        head = changed(head)
        return out, head

    def counted(self, quals: list[A.Node], head: A.Node) -> tuple[list[A.Node], A.Node]:
        """Joins whose groups are only counted: frames are counted by what the rest needs of them, and joined after that.

        So the join makes a row for each pair of distinct values, not of rows, and
        a group's count is the sum of the products of the counts.
        """
        stop = next((k for k, q in enumerate(quals) if isinstance(q, A.GroupBy)), None)
        if stop is None:
            return quals, head
        generators = [q for q in quals[:stop] if isinstance(q, A.Generator)]
        conditions = [q for q in quals[:stop] if isinstance(q, A.Predicate)]
        names = [n for g in generators for n in A.bound_names(g.pattern)]
        group = quals[stop]
        exprs = [*(q.cond for q in conditions), group.key]
        if len(generators) < 2 or len(generators) + len(conditions) < stop or len(set(names)) < len(names) or not A.free_names(group.key) & set(names):
            return quals, head
        if any(A.free_names(g.domain) & set(names) for g in generators) or not all(isinstance(x, _PLAIN) for e in exprs for x in walk(e)):
            return quals, head
        bagged = set(names) - set(A.bound_names(group.pattern))
        counts = lambda x: isinstance(x, A.Method) and x.name in _COUNT and isinstance(x.base, A.Var) and x.base.name in bagged
        only = lambda x: counts(x) or not isinstance(x, (A.Lambda, A.Comprehension)) and not (isinstance(x, A.Var) and x.name in bagged) and all(map(only, x.children()))
        after = [*quals[stop + 1 :], head]
        if not all(map(only, after)) or not any(counts(x) for e in after for x in walk(e)):
            return quals, head
        weights: list[A.Node] = []
        made: dict[A.Generator, A.Generator] = {}
        for g in generators:
            own = set(A.bound_names(g.pattern))
            source = self.program.maybe(g.domain.name) if isinstance(g.domain, A.Var) and not g.full else None
            if not isinstance(source, DataFrame) or not own:
                continue
            inner = Scope()
            self._source(g, source, inner, [])
            filters = [q for q in conditions if A.free_names(q.cond) & set(names) and not A.free_names(q.cond) & set(names) - own]
            kept: dict[A.Node, tuple[str, Val]] = {}
            needed = [x for q in conditions if q not in filters for x in _largest(q.cond, own, set(names))] + _largest(group.key, own, set(names))
            values = [unpacked(self.row(x, inner)) for x in needed]
            if not needed or not all(isinstance(v, Val) for v in values):
                continue
            for q in filters:
                self.filter(self.row(q.cond, inner), inner)
            for x, v in zip(needed, values, strict=True):
                same = next((n for n, w in kept.values() if str(w.col) == str(v.col)), None)
                kept[x] = (same or self.fresh("x"), v)
            columns = dict(kept.values())
            names += columns
            weight = self.fresh("w")
            rows = inner.df.groupBy(*[v.col.alias(n) for n, v in columns.items()]).agg(F.count(F.lit(1)).alias(weight))
            made[g] = A.Generator(A.TuplePat([A.VarPat(n) for n in (*columns, weight)]), g.domain)
            self.held[made[g]] = rows
            weights.append(A.Var(weight))
            changed = lambda x, kept=kept: A.Var(kept[x][0]) if x in kept else A.rebuilt(x, changed) if not isinstance(x, _PATTERNS) else x  # noqa: B023, E731
            replaced = {q: A.Predicate(changed(q.cond)) for q in conditions if q not in filters}
            quals = [replaced.get(q, q) for q in quals if q not in filters]
            group = A.GroupBy(group.pattern, changed(group.key))
            conditions = list(replaced.values())
        if not weights:
            return quals, head
        product = weights[0]
        for w in weights[1:]:
            product = A.Binary("*", product, w)
        summed = lambda x: A.Reduce("+", product) if counts(x) else x if isinstance(x, _PATTERNS) else A.rebuilt(x, summed)
        at = next(k for k, q in enumerate(quals) if isinstance(q, A.GroupBy))
        return [*(made.get(q, q) for q in quals[:at]), group, *map(summed, quals[at + 1 :])], summed(head)

    # --- generators
    def generator(self, q: A.Generator, scope: Scope, rest: list[A.Node]) -> None:
        domain = q.domain
        if isinstance(domain, A.Range):
            return self._range(q, domain, scope, rest)
        if isinstance(domain, A.ListE) and not A.free_names(domain) & set(scope.env):
            return self._source(q, self.program.value(domain), scope, rest)
        if q in self.held:
            return self._source(q, self.held.pop(q), scope, rest)
        if A.free_names(domain) & set(scope.env):
            self.nested(domain, scope)
            return self._explode(q, self.row(domain, scope), scope)
        self._source(q, self.program.value(domain), scope, rest)
        return None

    def _range(self, q: A.Generator, r: A.Range, scope: Scope, rest: list[A.Node]) -> None:
        name = self.fresh("r")
        if all(map(self.is_constant, (r.low, r.high, r.step))) and not (A.free_names(r) & set(scope.env)):
            low, high, step = (self.program.value(x) for x in (r.low, r.high, r.step))
            stop = high + 1 if step > 0 else high - 1
            df = self.spark.range(low, stop, step).select(F.col("id").cast("int").alias(name))
            self._joined(q.pattern, df, Val(F.col(name), "int"), scope, rest, frozenset([name]), {name: high + 1}, low == 0 and step == 1)
            return
        bounds = [column_of(self.row(x, scope)).col.cast("int") for x in (r.low, r.high, r.step)]
        low, high, step = bounds
        # an empty range has no row
        values = F.when((high - low) * F.signum(step) >= 0, F.sequence(low, high, step))
        scope.df = (scope.df if scope.df is not None else self.unit()).withColumn(name, F.explode(values))
        if scope.unique is not None:
            scope.unique |= {name}
        scope.complete = False
        self.bind(q.pattern, Val(F.col(name), "int"), scope)

    def _explode(self, q: A.Generator, value: Any, scope: Scope) -> None:
        """A dependent generator: the elements of an array or the entries of a map in a row."""
        value = value.value if isinstance(value, Bag) else value
        val = column_of(value)
        kind = T._parse_datatype_string(val.kind)
        assert scope.df is not None
        if isinstance(kind, T.MapType):
            k, v = self.fresh("k"), self.fresh("v")
            scope.df = scope.df.select("*", F.explode(val.col).alias(k, v))
            made: Any = tuple_of([from_column(F.col(k), kind.keyType), from_column(F.col(v), kind.valueType)])
        elif isinstance(kind, T.ArrayType):
            name = self.fresh("e")
            # ragged vectors: ((i, row) <- F, (j, x) <- row) counts elements from 0
            if isinstance(q.pattern, A.TuplePat) and len(q.pattern.items) == 2 and not isinstance(kind.elementType, T.StructType):
                at = self.fresh("p")
                scope.df = scope.df.select("*", F.posexplode(val.col).alias(at, name))
                made = tuple_of([Val(F.col(at), "int"), from_column(F.col(name), kind.elementType)])
            else:
                scope.df = scope.df.withColumn(name, F.explode(val.col))
                made = from_column(F.col(name), kind.elementType)
        else:
            raise CompileError(f"a generator ranges over collections, not {val.kind}")
        scope.unique, scope.complete = None, False
        self.bind(q.pattern, made, scope)

    def _source(self, q: A.Generator, source: Any, scope: Scope, rest: list[A.Node]) -> None:
        if isinstance(source, Tensor):
            return self._tensor(q, source, scope, rest)
        if isinstance(source, (list, range)):
            source = self.program.frame_of(source)
        if isinstance(source, dict):
            source = self.program.frame_of(list(source.items()))
        if isinstance(source, MapRel):
            source = source.df
        if isinstance(source, Relation):
            source = as_frame(source)
        if isinstance(source, DataFrame):
            names = [self.fresh("c") for _ in source.columns]
            df = source.toDF(*names)
            items = [from_column(F.col(n), f.dataType) for n, f in zip(names, source.schema.fields, strict=True)]
            value = items[0] if len(items) == 1 else Row(list(source.columns), items, True)
            return self._joined(q.pattern, df, value, scope, rest, None)
        if isinstance(source, str):
            raise CompileError("a string is no collection")
        raise CompileError(f"a generator ranges over collections, not {type(source).__name__}")

    def _tensor(self, q: A.Generator, t: Tensor, scope: Scope, rest: list[A.Node]) -> None:
        names = [self.fresh("i") for _ in t.indices]
        own = self.fresh("v")
        index = [Val(F.col(n), index_type(d)) for n, d in zip(names, t.dims, strict=True)]
        value = tuple_of([index[0] if t.rank == 1 else tuple_of(index), unpacked(Val(F.col(own), t.kind))])
        # two generators over one tensor with equal indices are one: its index is a key
        if not q.full:
            for other, columns, other_value in scope.tensors:
                if other is t and self._same_index(q.pattern, value, names, columns, scope, rest):
                    same = [Val(F.col(n), index_type(d)) for n, d in zip(columns, t.dims, strict=True)]
                    self.bind(q.pattern, tuple_of([same[0] if t.rank == 1 else tuple_of(same), unpacked(Val(F.col(other_value), t.kind))]), scope)
                    return
        cells = (t.full() if q.full else t.values()).select(*[F.col(a).alias(b) for a, b in zip([*t.indices, VALUE], [*names, own], strict=True)])
        self._joined(q.pattern, cells, value, scope, rest, frozenset(names), dict(zip(names, t.dims, strict=True)), q.full or t.is_dense)
        scope.tensors.append((t, names, own))

    def _same_index(self, pattern: A.Node, value: Row, names: list[str], columns: list[str], scope: Scope, rest: list[A.Node]) -> bool:
        trial = Scope()
        self.bind(pattern, value, trial)
        here = {str(v.col): n for n, v in trial.env.items() if isinstance(v, Val)}
        used = []
        for mine, theirs in zip(names, columns, strict=True):
            var = here.get(str(F.col(mine)))
            found = None
            for q in rest:
                if isinstance(q, A.GroupBy):
                    break
                if var and isinstance(q, A.Predicate) and isinstance(q.cond, A.Binary) and q.cond.op == "==":
                    for x, y in ((q.cond.left, q.cond.right), (q.cond.right, q.cond.left)):
                        if isinstance(x, A.Var) and x.name == var and isinstance(y, A.Var) and isinstance(scope.env.get(y.name), Val) and str(scope.env[y.name].col) == str(F.col(theirs)):
                            found = q
            if found is None:
                return False
            used.append(found)
        for q in used:
            rest.remove(q)
        return True

    def _joined(self, pattern: A.Node, df: DataFrame, value: Any, scope: Scope, rest: list[A.Node], unique: frozenset[str] | None, dims: dict[str, int] | None = None, complete: bool = False) -> None:
        """Joins a new source; takes the predicates out of ``rest`` that link it to what is bound."""
        dims = dims or {}
        if scope.df is None:
            scope.df, scope.unique, scope.complete = df, unique, complete
            scope.dims |= dims
            self.bind(pattern, value, scope)
            return
        columns = {str(F.col(c)): c for c in [*scope.dims, *dims]}
        same: dict[str, str] = {}
        new = Scope(df=df)
        shadowed = set(A.bound_names(pattern))
        self.bind(pattern, value, new)
        conditions: list[Column] = []
        for q in list(rest):
            if isinstance(q, A.GroupBy) or (isinstance(q, (A.Generator, A.Let)) and set(A.bound_names(q.pattern)) & (set(scope.env) | shadowed)):
                break
            if not isinstance(q, A.Predicate):
                continue
            names = A.free_names(q.cond)
            inside = names & set(new.env)
            before = {n for n in names - set(new.env) if n in scope.env}
            known = all(n in new.env or n in scope.env or self.program.knows(n) for n in names)
            if not (known and inside and before) or any(isinstance(x, A.Comprehension) for x in walk(q.cond)):
                continue
            both = Scope(df=None, env=scope.env | new.env, made=scope.made)
            conditions.append(column_of(self.row(q.cond, both)).col)
            complete = complete and self._follows(q.cond, both, columns, scope.dims, dims, same)
            rest.remove(q)
        if conditions:
            condition = conditions[0]
            for c in conditions[1:]:
                condition = condition & c
            scope.df = scope.df.join(new.df, condition)
        else:
            scope.df = scope.df.crossJoin(new.df)
        scope.unique = scope.unique | unique if scope.unique is not None and unique is not None else None
        scope.complete = scope.complete and complete
        scope.dims |= dims
        scope.same |= same
        scope.env |= new.env

    @staticmethod
    def _follows(cond: A.Node, both: Scope, columns: dict[str, str], old: dict[str, int], new: dict[str, int], same: dict[str, str]) -> bool:
        """Whether an equality only makes a new index follow an old one of the same extent."""
        if not (isinstance(cond, A.Binary) and cond.op == "==" and isinstance(cond.left, A.Var) and isinstance(cond.right, A.Var)):
            return False
        ends = [both.env.get(x.name) for x in (cond.left, cond.right)]
        if not all(isinstance(e, Val) and str(e.col) in columns for e in ends):
            return False
        a, b = (columns[str(e.col)] for e in ends)
        a, b = (a, b) if a in new else (b, a)
        if a not in new or b not in old or a in same or b in same.values() or new[a] != old[b]:
            return False
        same[a] = b
        return True

    # --- lets, filters, patterns
    def bind(self, pattern: A.Node, value: Any, scope: Scope) -> None:
        if isinstance(pattern, A.VarPat):
            scope.env[pattern.name] = value
        elif isinstance(pattern, A.TuplePat):
            value = unpacked(value)
            if isinstance(value, Bag):
                inner = unpacked(value.value)
                value = Row(inner.names, [Bag(x) for x in inner.items]) if isinstance(inner, Row) else value
            if isinstance(value, tuple):
                value = tuple_of([literal(x) for x in value])
            if not isinstance(value, Row) or len(value.items) != len(pattern.items):
                raise CompileError(f"a pattern of {len(pattern.items)} parts does not fit")
            for p, v in zip(pattern.items, value.items, strict=True):
                self.bind(p, v, scope)
        elif isinstance(pattern, A.ConstPat):
            self.filter(compare("==", column_of(value), literal(pattern.value)), scope)

    def filter(self, value: Any, scope: Scope) -> None:
        if isinstance(value, bool):
            value = literal(value)
        if not isinstance(value, Val) or value.kind != "boolean":
            raise CompileError("a predicate is a boolean")
        scope.df = (scope.df if scope.df is not None else self.unit()).where(value.col)
        scope.complete = False

    # --- group-by
    def group(self, q: A.GroupBy, scope: Scope, rest: list[A.Node], head: A.Node) -> None:
        self.nested(q.key, scope)
        assert scope.df is not None
        key = self.row(q.key, scope)
        leaves: list[tuple[str, Val]] = []

        def named(v: Any) -> Any:
            v = unpacked(v)
            if isinstance(v, Row):
                return Row(v.names, [named(x) for x in v.items], v.record)
            val = column_of(v)
            leaves.append((self.fresh("k"), val))
            return Val(F.col(leaves[-1][0]), val.kind)

        key_value = named(key)
        bagged = {n: v for n, v in scope.env.items() if n not in A.bound_names(q.pattern)}
        aggregates: dict[A.Node, tuple[str, Val, Val]] = {}  # node -> alias, aggregate, value for a single row
        for node in [*rest, head]:
            self._reductions(node, bagged, scope, aggregates)
        constant = not (A.free_names(q.key) & set(scope.env))
        plain = {str(F.col(c)): c for c in scope.df.columns}
        covered = {plain[str(v.col)] for _, v in leaves if str(v.col) in plain}
        keys = [v.col.alias(n) for n, v in leaves]
        if scope.unique is not None and scope.unique and scope.unique <= covered:
            # the key tells rows apart: every group is one row
            df = scope.df.select(*keys, *[single.col.alias(alias) for alias, _, single in aggregates.values()])
        elif aggregates:
            made = [(alias, agg.col) for alias, agg, _ in aggregates.values()]
            df = self._grouped(scope.df, [], [], made).select("*", *keys) if constant else self._grouped(scope.df, keys, [n for n, _ in leaves], made)
        else:
            df = scope.df.select(*keys).distinct()
        dims = {n: scope.dims[plain[str(v.col)]] for n, v in leaves if str(v.col) in plain and plain[str(v.col)] in scope.dims}
        # groups by index columns of a full index space are a full index space
        scope.complete = scope.complete and len(dims) == len(leaves) and len({scope.same.get(c, c) for c in covered}) == len(leaves)
        scope.df, scope.unique, scope.dims, scope.tensors, scope.same = df, frozenset(n for n, _ in leaves), dims, [], {}
        scope.made |= {node: Val(F.col(alias), agg.kind) for node, (alias, agg, _) in aggregates.items()}
        scope.env = {n: v if isinstance(v, Bag) else Bag(v) for n, v in bagged.items()}
        self.bind(q.pattern, key_value, scope)

    def _reductions(self, node: A.Node, bagged: dict[str, Any], scope: Scope, out: dict[A.Node, tuple[str, Val, Val]]) -> None:
        """Finds what is asked of the lifted variables in ``node`` and compiles it to aggregates."""
        if isinstance(node, A.Reduce) and not isinstance(node.arg, A.Comprehension) and A.free_names(node.arg) & set(bagged) and not any(isinstance(x, (A.Reduce, A.Comprehension)) for x in walk(node.arg)):
            val = column_of(self.row(node.arg, Scope(scope.df, dict(bagged), made=scope.made)))
            out[node] = self._aggregate(node.op, val)
            return
        if isinstance(node, A.Reduce) and isinstance(node.arg, A.Comprehension) and isinstance(node.arg.quals[0], A.Generator) and isinstance(node.arg.quals[0].domain, A.Var) and node.arg.quals[0].domain.name in bagged:
            inner = Scope(scope.df, dict(bagged), made=scope.made)
            self.bind(node.arg.quals[0].pattern, bagged[node.arg.quals[0].domain.name], inner)
            condition: Column | None = None
            for q in node.arg.quals[1:]:
                if isinstance(q, A.Let):
                    self.bind(q.pattern, self.row(q.value, inner), inner)
                elif isinstance(q, A.Predicate):
                    c = column_of(self.row(q.cond, inner)).col
                    condition = c if condition is None else condition & c
                else:
                    raise CompileError("a reduction over a group takes lets and predicates")
            val = column_of(self.row(node.arg.head, inner))
            if condition is not None:
                val = Val(F.when(condition, val.col), val.kind)
            out[node] = self._aggregate(node.op, val)
            return
        if isinstance(node, A.Method) and node.name in _COUNT and isinstance(node.base, A.Var) and node.base.name in bagged:
            out[node] = (self.fresh("n"), Val(F.count(F.lit(1)), "bigint"), Val(F.lit(1).cast("bigint"), "bigint"))
            self.steps[out[node][0]] = (F.count(F.lit(1)), F.sum, False)
            return
        if isinstance(node, A.Var) and node.name in bagged:
            val = column_of(bagged[node.name].value if isinstance(bagged[node.name], Bag) else bagged[node.name])
            kind = f"array<{val.kind}>"
            out[node] = (self.fresh("b"), Val(F.collect_list(val.col), kind), Val(F.array(val.col), kind))
            self.steps[out[node][0]] = (F.collect_list(val.col), lambda c: F.flatten(F.collect_list(c)), False)
            return
        if isinstance(node, (A.Lambda, A.Comprehension)):
            names = A.free_names(node)
            bagged = {n: v for n, v in bagged.items() if n in names}
        for c in node.children():
            self._reductions(c, bagged, scope, out)

    def _aggregate(self, op: str, val: Val) -> tuple[str, Val, Val]:
        monoid = self.program.monoid(op)
        kind = monoid.kind or monoids.result_type(op, val.kind)

        def ended(made: Column) -> Column:
            made = F.coalesce(made, F.lit(monoid.zero)) if monoid.zero is not None else made
            return monoid.result(made).cast(kind) if op in ("+", "*", "avg", "count") else monoid.result(made)

        alias = self.fresh("s")
        if monoid.merge:
            self.steps[alias] = (monoid.aggregate(val.col), lambda c: ended(monoid.merge(c)), monoid.folds)
        return alias, Val(ended(monoid.aggregate(val.col)), kind), Val(ended(F.lit(1) if op == "count" else val.col), kind)

    def _grouped(self, df: DataFrame, keys: list[Column], names: list[str], made: list[tuple[str, Column]]) -> DataFrame:
        """Groups and aggregates; in two steps where an aggregate folds a list and all of them can be merged."""
        steps = [(alias, *self.steps[alias]) for alias, _ in made if alias in self.steps]
        if len(steps) == len(made) and any(folds for *_, folds in steps):
            return monoids.in_steps(df, keys, names, [(alias, partial, merge) for alias, partial, merge, _ in steps])
        aggregates = [col.alias(alias) for alias, col in made]
        return df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)

    # --- nested comprehensions
    def nested(self, node: A.Node, scope: Scope) -> None:
        """Joins what correlated comprehensions inside ``node`` yield to the scope's rows."""
        if node in scope.made:
            return
        reduce = node if isinstance(node, A.Reduce) and isinstance(node.arg, A.Comprehension) else None
        counted = isinstance(node, A.Method) and node.name in _COUNT and isinstance(node.base, A.Comprehension)
        inner = reduce.arg if reduce else node.base if counted else node if isinstance(node, A.Comprehension) else None
        if inner is not None:
            if not A.free_names(inner) & set(scope.env):
                if counted:
                    scope.made[node] = literal(self.program.value(A.Reduce("count", inner)))
                elif not reduce and scope.df is not None:
                    scope.made[node] = self._beside(inner, scope)
                return
            scope.made[node] = self._correlated(inner, reduce.op if reduce else "count" if counted else None, scope)
            return
        for c in node.children():
            self.nested(c, scope)

    def _beside(self, c: A.Comprehension, scope: Scope) -> Val:
        """The bag of a comprehension that no outer row changes: one row, put beside all others without a detour over the driver."""
        assert scope.df is not None
        relation = self.comprehension(c)
        value, alias = column_of(relation.value), self.fresh("b")
        scope.df = scope.df.crossJoin(relation.df.agg(F.collect_list(value.col).alias(alias)))
        return Val(F.col(alias), f"array<{value.kind}>")

    def _correlated(self, c: A.Comprehension, op: str | None, scope: Scope) -> Val:
        """Groups the inner rows by what the equalities compare with outer values, then joins the groups to the outer rows."""
        assert scope.df is not None
        quals, head = self.lowered(rewrite.flattened(c.quals), c.head)
        bound: set[str] = set()
        own: list[A.Node] = []
        links: list[tuple[A.Node, A.Node]] = []
        for q in quals:
            if isinstance(q, (A.Generator, A.Let)):
                bound |= set(A.bound_names(q.pattern))
        outer = set(scope.env) - bound
        for q in quals:
            if isinstance(q, A.Predicate) and A.free_names(q.cond) & outer:
                e = q.cond
                if not (isinstance(e, A.Binary) and e.op == "=="):
                    raise CompileError("a nested comprehension is tied to outer rows by equalities only")
                x, y = (e.left, e.right) if not A.free_names(e.left) & outer else (e.right, e.left)
                if A.free_names(x) & outer or A.free_names(y) & bound:
                    raise CompileError("each side of a linking equality belongs to one level")
                links.append((x, y))
            elif A.free_names(q) & outer:
                raise CompileError("a nested comprehension is tied to outer rows by equalities only")
            else:
                own.append(q)
        if A.free_names(head) & outer:
            raise CompileError("the head of a nested comprehension uses its own variables")
        relation = self.compiled(rewrite.without_ranges(own, self.is_constant), A.Tuple([A.Tuple([x for x, _ in links]), head]), Scope())
        keys = [column_of(v) for v in relation.value.items[0].items]
        value = column_of(relation.value.items[1])
        names = [self.fresh("k") for _ in keys]
        if op is None:
            alias, made, kind = self.fresh("b"), F.collect_list(value.col), f"array<{value.kind}>"
            empty = F.array().cast(kind)
        else:
            alias, agg, _ = self._aggregate(op, value)
            made, kind = agg.col, agg.kind
            zero = self.program.monoid(op).zero
            empty = F.lit(zero).cast(kind)
        groups = self._grouped(relation.df, [k.col.alias(n) for k, n in zip(keys, names, strict=True)], names, [(alias, made)])
        condition: Column | None = None
        for name, (_, y) in zip(names, links, strict=True):
            part = column_of(self.row(y, scope)).col == F.col(name)
            condition = part if condition is None else condition & part
        scope.df = scope.df.join(groups, condition, "left").withColumn(alias, F.coalesce(F.col(alias), empty)).drop(*names)
        return Val(F.col(alias), kind)

    # --- row expressions
    def row(self, e: A.Node, scope: Scope) -> Any:
        if e in scope.made:
            return scope.made[e]
        handler = getattr(self, f"_row_{type(e).__name__.lower()}", None)
        if handler is None:
            raise CompileError(f"{type(e).__name__} has no value in a row")
        return handler(e, scope)

    def _row_const(self, e: A.Const, scope: Scope) -> Any:
        return Val(F.lit(e.value).cast(e.kind), e.kind) if e.value is not None else Val(F.lit(None), "void")

    def _row_var(self, e: A.Var, scope: Scope) -> Any:
        if e.name in scope.env:
            return scope.env[e.name]
        value = self.program.value(e)
        if isinstance(value, range):
            return Val(F.sequence(F.lit(value.start), F.lit(value[-1]), F.lit(value.step)) if value else F.array().cast("array<int>"), "array<int>")
        if isinstance(value, (bool, int, float, str, tuple, list)) or value is None:
            return literal(value)
        return value

    def _row_tuple(self, e: A.Tuple, scope: Scope) -> Any:
        return tuple_of([self.row(x, scope) for x in e.items])

    def _row_record(self, e: A.Record, scope: Scope) -> Any:
        return Row([n for n, _ in e.items], [self.row(x, scope) for _, x in e.items], True)

    def _row_liste(self, e: A.ListE, scope: Scope) -> Any:
        parts = [column_of(self.row(x, scope)) for x in e.items]
        return Val(F.array(*[p.col for p in parts]), f"array<{parts[0].kind if parts else 'int'}>")

    def _row_field(self, e: A.Field, scope: Scope) -> Any:
        value = unpacked(self.row(e.base, scope))
        if not isinstance(value, Row):
            raise CompileError(f"no component {e.name!r} in a plain value")
        return value.get(e.name)

    def _row_index(self, e: A.Index, scope: Scope) -> Any:
        base = self.row(e.base, scope)
        if isinstance(base, Val) and base.kind.startswith("array"):
            kind = T._parse_datatype_string(base.kind).elementType
            return from_column(F.get(base.col, column_of(self.row(e.items[0], scope)).col.cast("int")), kind)
        if isinstance(base, Val) and base.kind.startswith("map"):
            kind = T._parse_datatype_string(base.kind).valueType
            return from_column(F.element_at(base.col, column_of(self.row(e.items[0], scope)).col), kind)
        raise CompileError("only tensors, arrays and maps are indexed")

    def _row_binary(self, e: A.Binary, scope: Scope) -> Any:
        a, b = self.row(e.left, scope), self.row(e.right, scope)
        if e.op in ("==", "!=") and (isinstance(a, Row) or isinstance(b, Row)):
            a, b = unpacked(a), unpacked(b)
            made: Column = F.lit(True)
            for x, y in zip(a.items, b.items, strict=True):
                made = made & compare("==", column_of(x), column_of(y)).col
            return Val(made if e.op == "==" else ~made, "boolean")
        x, y = column_of(a), column_of(b)
        if e.op in ("&&", "||"):
            return Val(x.col & y.col if e.op == "&&" else x.col | y.col, "boolean")
        if e.op in ("==", "!=", "<", "<=", ">", ">="):
            return compare(e.op, x, y)
        if e.op in ("+", "-", "*", "/", "%"):
            return arithmetic(e.op, x, y)
        if e.op == "^":
            return Val(F.pow(x.col, y.col), "double")
        if e.op == "++":
            return Val(F.concat(x.col, y.col), x.kind)
        if e.op == ":+":
            return Val(F.array_append(x.col, y.col), x.kind)
        if e.op == "::":
            return Val(F.array_prepend(y.col, x.col), y.kind)
        raise CompileError(f"no operator {e.op!r} on rows")

    def _row_unary(self, e: A.Unary, scope: Scope) -> Any:
        x = column_of(self.row(e.arg, scope))
        return Val(-x.col, x.kind) if e.op == "-" else Val(~x.col, "boolean")

    def _row_if(self, e: A.If, scope: Scope) -> Any:
        cond, a, b = (self.row(x, scope) for x in (e.cond, e.then, e.other))
        return self._chosen(column_of(cond).col, a, b)

    def _chosen(self, cond: Column, a: Any, b: Any) -> Any:
        a, b = unpacked(a), unpacked(b)
        if isinstance(a, Row) and isinstance(b, Row):
            return Row(a.names, [self._chosen(cond, x, y) for x, y in zip(a.items, b.items, strict=True)], a.record)
        x, y = column_of(a), column_of(b)
        kind = y.kind if x.kind == "void" else x.kind if y.kind == "void" or x.kind == y.kind else arithmetic("+", x, y).kind
        return Val(F.when(cond, x.col).otherwise(y.col).cast(kind) if x.kind != y.kind else F.when(cond, x.col).otherwise(y.col), kind)

    def _row_match(self, e: A.Match, scope: Scope) -> Any:
        value = self.row(e.arg, scope)
        result: Any = Val(F.lit(None), "void")
        for case in reversed(e.cases):
            inner = Scope(scope.df, dict(scope.env), made=scope.made)
            condition = self._fits(case.pattern, value, inner)
            if case.guard is not None:
                guard = column_of(self.row(case.guard, inner)).col
                condition = guard if condition is None else condition & guard
            body = self.row(case.body, inner)
            result = body if condition is None else self._chosen(condition, body, result)
        return result

    def _fits(self, pattern: A.Node, value: Any, scope: Scope) -> Column | None:
        """The condition under which a pattern fits (None: always); binds its names."""
        if isinstance(pattern, A.ConstPat):
            return compare("==", column_of(value), literal(pattern.value)).col
        if isinstance(pattern, A.TuplePat):
            value = unpacked(value)
            out: Column | None = None
            for p, v in zip(pattern.items, value.items, strict=True):
                part = self._fits(p, v, scope)
                out = part if out is None else out if part is None else out & part
            return out
        if isinstance(pattern, A.VarPat):
            scope.env[pattern.name] = value
        return None

    def _row_ascribe(self, e: A.Ascribe, scope: Scope) -> Any:
        x = column_of(self.row(e.arg, scope))
        kind = TYPES.get(e.type)
        return x if kind is None or kind == x.kind else Val(x.col.cast(kind), kind)

    def _row_reduce(self, e: A.Reduce, scope: Scope) -> Any:
        if not A.free_names(e.arg) & set(scope.env):
            return literal(self.program.value(e))
        x = column_of(self.row(e.arg, scope))
        if not x.kind.startswith("array"):
            raise CompileError(f"{e.op}/ folds collections, not {x.kind}")
        # a reduction of an array in a row
        kind = T._parse_datatype_string(x.kind).elementType.simpleString()
        monoid, result = self.program.monoid(e.op), monoids.result_type(e.op, kind)
        if e.op == "count":
            return Val(F.size(x.col).cast("bigint"), "bigint")
        if e.op in ("max", "min"):
            return Val((F.array_max if e.op == "max" else F.array_min)(x.col), kind)
        start = F.lit(monoid.zero).cast(result) if monoid.zero is not None else F.get(x.col, F.lit(0))
        return Val(F.aggregate(x.col, start, lambda s, v: monoid.combine(s, v).cast(result)), result)

    def _row_comprehension(self, e: A.Comprehension, scope: Scope) -> Any:
        return literal(self.program.local(self.program.value(e)))

    def _formatted(self, pattern: A.Node, args: list[A.Node], scope: Scope) -> Val:
        """``format("%s of %d", a, b)`` or ``"%s of %d".format(a, b)``; the pattern is known when the plan is made."""
        text = self.program.value(pattern) if self.is_constant(pattern) and not A.free_names(pattern) & set(scope.env) else None
        if not isinstance(text, str):
            raise CompileError("a format is a constant string")
        return Val(F.format_string(text, *[column_of(self.row(a, scope)).col for a in args]), "string")

    def _row_call(self, e: A.Call, scope: Scope) -> Any:
        function = self.program.maybe(e.name)
        if e.name == "format" and function is None:
            return self._formatted(e.args[0], e.args[1:], scope)
        args = [self.row(x, scope) if not isinstance(x, A.Lambda) else x for x in e.args]
        if isinstance(function, A.Lambda):
            inner = Scope(scope.df, dict(scope.env), made=scope.made)
            self.bind(function.pattern, args[0] if len(args) == 1 else tuple_of(args), inner)
            return self.row(function.body, inner)
        if isinstance(function, A.Def):
            inner = Scope(scope.df, dict(scope.env) | {n: a for (n, _), a in zip(function.params, args, strict=True)}, made=scope.made)
            return self._row_body(function.body, inner)
        if callable(function):
            return self._host(e.name, function, [column_of(a) for a in args], scope)
        if e.name in ("random", "rand"):
            seed = self.program.next_seed()
            if not scope.unique:
                return Val(F.rand(seed), "double")
            # a number for each key, the same however often and however dealt out the rows are read
            return Val(F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in sorted(scope.unique)]), F.lit(1 << 53)) / F.lit(float(1 << 53)), "double")
        if e.name in FUNCTIONS:
            return FUNCTIONS[e.name](*[column_of(a) for a in args])
        raise CompileError(f"no function {e.name!r}")

    def _row_body(self, s: A.Node, scope: Scope) -> Any:
        """The value of a function's body: declarations, then a return or a choice of returns."""
        if isinstance(s, A.Return):
            return self.row(s.value, scope)
        if isinstance(s, A.IfStmt) and s.other is not None:
            return self._chosen(column_of(self.row(s.cond, scope)).col, self._row_body(s.then, scope), self._row_body(s.other, scope))
        if isinstance(s, A.Block):
            for k, x in enumerate(s.items):
                if isinstance(x, A.Declare) and x.value is not None:
                    scope.env[x.name] = self.row(x.value, scope)
                elif isinstance(x, A.IfStmt) and x.other is None:
                    return self._chosen(column_of(self.row(x.cond, scope)).col, self._row_body(x.then, scope), self._row_body(A.Block(s.items[k + 1 :]), scope))
                else:
                    return self._row_body(x, scope)
        return self.row(s, scope)

    def _host(self, name: str, function: Any, args: list[Val], scope: Scope) -> Val:
        """A Python function: of columns if it can be, else a UDF with its declared result type."""
        kind = self.program.returns.get(name)
        if name not in self.program.scalar_functions:
            made = function(*[a.col for a in args])
            if isinstance(made, Column):
                if kind is None:
                    frame = scope.df if scope.df is not None else self.unit()
                    kind = frame.select(made.alias("x")).schema["x"].dataType.simpleString()
                return Val(made, kind)
        if kind is None:
            raise CompileError(f"{name!r} needs a result type: register it with one")
        return Val(F.udf(function, kind, useArrow=True)(*[a.col for a in args]), kind)

    def _row_method(self, e: A.Method, scope: Scope) -> Any:
        if e.name == "format":
            return self._formatted(e.base, e.args, scope)
        base = self.row(e.base, scope)
        if isinstance(base, Tensor):
            return literal(self.program.value(e))
        if e.name in ("reduce", "reduceByKey"):
            raise CompileError(f"{e.name} is applied to whole collections")
        return method(column_of(base), e.name, [column_of(self.row(a, scope)) for a in e.args])


_PATTERNS = (A.VarPat, A.TuplePat, A.AnyPat, A.ConstPat)


def _largest(node: A.Node, own: set[str], names: set[str]) -> list[A.Node]:
    """The largest parts of an expression that need variables of ``own`` and no others of ``names``."""
    used = A.free_names(node) & names
    return [node] if used and used <= own else [x for c in node.children() for x in _largest(c, own, names)]


def walk(node: A.Node) -> list[A.Node]:
    """A node and everything below it."""
    return [node, *(x for c in node.children() for x in walk(c))]


def as_frame(r: Relation) -> DataFrame:
    """The rows of a relation: a column for each component of the head, nested ones as structs."""
    value = r.value
    if isinstance(value, Row):
        return r.df.select(*[column_of(v).col.alias(n) for n, v in zip(value.names, value.items, strict=True)])
    return r.df.select(column_of(value).col.alias("value"))


def as_tensor(r: Relation, dims: tuple[int, ...] | None, n_dense: int | None) -> Tensor:
    """A relation with heads ``(index, value)`` as a tensor; without ``dims`` they come from the indices' generators."""
    value = unpacked(r.value)
    if not isinstance(value, Row) or len(value.items) != 2:
        raise CompileError("a tensor is stored from (index, value) pairs")
    index = unpacked(value.items[0])
    parts = [column_of(x) for x in (index.items if isinstance(index, Row) else [index])]
    if dims is None:
        by_name = {str(F.col(c)): d for c, d in r.dims.items()}
        found = [by_name.get(str(p.col)) for p in parts]
        if any(d is None for d in found):
            raise CompileError("the result's dimensions are unknown: store it in tensor(..)")
        dims = tuple(found)
    if len(parts) != len(dims):
        raise CompileError(f"indices of {len(parts)} parts do not fit {len(dims)} dimensions")
    own = column_of(value.items[1])
    cells = r.df.select(*[p.col.cast(index_type(d)).alias(f"i{k}") for k, (p, d) in enumerate(zip(parts, dims, strict=True))], own.col.alias(VALUE))
    if r.complete and (n_dense is None or n_dense == len(dims)):
        columns = {str(F.col(c)): c for c in r.dims}
        used = [columns.get(str(p.col)) for p in parts]
        free = {c for c in r.dims if c not in r.same}
        # every index of the result has its row already
        if None not in used and len({r.same.get(c, c) for c in used}) == len(used) == len(free) and tuple(r.dims[c] for c in used) == tuple(dims):
            return Tensor(cells, dims, len(dims), own.kind)
    return Tensor(cells, dims, 0, own.kind).stored(len(dims) if n_dense is None else n_dense, held_sparse=True)


__all__ = ["Compiler", "Scope", "as_frame", "as_tensor", "walk", "zero_of"]
