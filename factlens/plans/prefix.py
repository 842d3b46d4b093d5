"""Compiler of the prefix query language to DataFrame plans.

Table expressions become DataFrames, expressions over columns become Columns, and Catalyst plans the whole. A value is
one of: DataFrame (table), Vector (a column of a table), Python scalar, list, dict, Lambda, Datoms.

Conventions where the language's documents leave room: `div` and `/` by zero give null, `pivot: col` with `by:` spreads
the aggregate over the values of a column, rank ties go to the smaller node, `ip` distance is the negated inner product.
"""

from __future__ import annotations

import operator
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.operators import datalog, graph, vector_index, vectors
from factlens.plans.reader import Bracket, EvalError, Pairs, Quoted, Symbol, read

CLAUSES = ("from", "where", "by", "asc", "desc", "take", "pivot")
AGGREGATES: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max, "first": F.first, "last": F.last, "med": F.median, "dev": F.stddev_pop, "var": F.var_pop}
COMPARE = {">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le, "==": operator.eq, "!=": operator.ne}
ARITHMETIC = {"+": operator.add, "-": operator.sub, "*": operator.mul}


@dataclass
class Vector:
    """One column of a table, as a value."""

    table: DataFrame
    column: str


@dataclass
class Lambda:
    """A function of the language; `self` names it in its body."""

    params: list[str]
    body: list
    scope: dict[str, Any]


@dataclass
class Scope:
    """Where a form is compiled: names, and the table whose columns are visible (none outside a select)."""

    names: dict[str, Any]
    table: DataFrame | None = None
    grouped: bool = False


class Engine:
    """An environment of tables and bindings."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None):
        self.spark, self.names = spark, dict(tables or {})
        self.forms: dict[str, Callable[[Scope, list], Any]] = {
            "select": self._select, "count": self._count, "at": self._at, "in": self._in, "and": self._logic, "or": self._logic, "not": self._not, "if": self._if,
            "set": self._set, "do": self._do, "quote": lambda s, a: self._quoted(a[0]), "fn": lambda s, a: Lambda([p.name for p in a[0]], a[1:], s.names), "list": lambda s, a: [self.eval(s, x) for x in a],
            "table": self._table, "dict": self._dict, "concat": self._concat, "distinct": self._distinct, "insert": self._insert,
            "cos-dist": self._distance("cosine"), "l2-dist": self._distance("l2"), "inner-prod": self._pairwise(vectors.inner), "norm": lambda s, a: self._value(vectors.norm(self._array(s, a[0]))), "knn": self._knn, "ann": self._ann, "hnsw-build": self._index, "hnsw-save": self._index_save, "hnsw-load": lambda s, a: vector_index.load(self.spark, self.eval(s, a[0])), "hnsw-info": lambda s, a: self.eval(s, a[0]).info(), "timer": self._timer,
            "datoms": lambda s, a: datalog.Datoms.empty(self.spark), "assert-fact": self._fact(True), "retract-fact": self._fact(False), "rule": self._rule, "query": self._query,
        }
        for name in ("build", "info", "pagerank", "degree", "topsort", "connected", "expand", "var-expand", "shortest-path", "dijkstra", "k-shortest", "cluster", "betweenness", "closeness", "louvain", "mst", "random-walk", "dfs", "free"):
            self.forms[f".graph.{name}"] = self._graph(name)
        self.forms |= {".starts-with": self._text("startswith"), ".ends-with": self._text("endswith"), ".contains": self._text("contains")}
        self.forms |= {".csv.read": self._csv_read, ".csv.write": self._csv_write, ".db.splayed.get": self._read, ".db.splayed.mount": self._read, ".db.parted.get": self._read, ".db.parted.mount": self._read, "read": self._read, ".db.splayed.set": self._write}
        self.rules: list[datalog.Rule] = []

    def run(self, text: str) -> Any:
        """The value of the last form of a program."""
        forms = read(text)
        if not forms:
            raise EvalError("parse", "empty program")
        scope = Scope(self.names)
        value = None
        try:
            for f in forms:
                value = self.eval(scope, f)
        except AnalysisException as e:
            raise EvalError("type" if "DATATYPE" in (e.getCondition() or "") else "name", str(e).split("\n")[0]) from e
        return value

    def rows(self, text: str) -> DataFrame:
        """The result as a table: tables as they are, a scalar as one row `value`, a vector or list as rows `value`, a dict as `key`, `value`."""
        return promote(self.spark, self.run(text))

    def eval(self, s: Scope, form: Any) -> Any:
        """The value of a form."""
        if isinstance(form, Symbol):
            return self._name(s, form.name)
        if isinstance(form, Quoted):
            return self._quoted(form.form)
        if isinstance(form, Bracket):
            return [self.eval(s, x) for x in form]
        if isinstance(form, Pairs):
            return {k: self.eval(s, v) for k, v in form.items}
        if not isinstance(form, list):
            return form
        if not form:
            raise EvalError("type", "an empty form is no call")
        head, args = form[0], form[1:]
        if isinstance(head, Symbol):
            if head.name in self.forms:
                return self._strict(s, head.name, args)
            if head.name in COMPARE:
                return self._compare(s, head.name, args)
            if head.name in ARITHMETIC or head.name in ("div", "/", "%"):
                return self._arithmetic(s, head.name, args)
            if head.name in AGGREGATES:
                return self._aggregate(s, head.name, args)
            if head.name in ("abs", "floor", "ceil", "ln", "exp", "sqrt", "lower", "upper", "length"):
                return self._value(getattr(F, head.name)(self._column(s, args[0])), s)
        fn = self.eval(s, head)
        if not isinstance(fn, Lambda):
            raise EvalError("type", f"{head} is no function")
        return self._call(s, fn, args)

    def _strict(self, s: Scope, name: str, args: list) -> Any:
        try:
            return self.forms[name](s, args)
        except IndexError:
            raise EvalError("domain", f"{name} needs more arguments") from None

    def _name(self, s: Scope, name: str) -> Any:
        if s.table is not None and name in s.table.columns:
            return F.col(f"`{name}`")
        if name in s.names:
            return s.names[name]
        if name in self.names:
            return self.names[name]
        raise EvalError("name", f"{name} is unknown")

    @staticmethod
    def _quoted(form: Any) -> Any:
        return form.name if isinstance(form, Symbol) else form

    def _call(self, s: Scope, fn: Lambda, args: list) -> Any:
        if len(args) != len(fn.params):
            raise EvalError("domain", f"{len(fn.params)} arguments wanted, {len(args)} given")
        inner = Scope({**s.names, **fn.scope, **dict(zip(fn.params, [self.eval(s, a) for a in args], strict=True)), "self": fn}, s.table, s.grouped)
        value = None
        for f in fn.body:
            value = self.eval(inner, f)
        return value

    def _column(self, s: Scope, form: Any) -> Column:
        value = self.eval(s, form)
        if isinstance(value, Column):
            return value
        if isinstance(value, list):
            return F.array(*[F.lit(x) for x in value])
        if value is None or isinstance(value, (int, float, str, bool)):
            return F.lit(value)
        raise EvalError("type", f"{type(value).__name__} is no column")

    def _value(self, c: Column, s: Scope | None = None) -> Any:
        """A column inside a select, its constant value outside."""
        if s is not None and s.table is not None:
            return c
        return self.spark.range(1).select(c.alias("v")).first()[0]

    def _table_of(self, s: Scope, form: Any) -> DataFrame:
        value = self.eval(Scope(s.names), form)
        if isinstance(value, str):
            value = self._name(Scope(s.names), value)
        if not isinstance(value, DataFrame):
            raise EvalError("type", f"{type(value).__name__} is no table")
        return value

    def _constant(self, s: Scope, form: Any) -> Any:
        value = self.eval(Scope(s.names), form)
        if isinstance(value, (Column, DataFrame, Lambda)):
            raise EvalError("type", "a constant is wanted")
        return value

    # --- select

    def _select(self, s: Scope, args: list) -> DataFrame:
        if len(args) != 1 or not isinstance(args[0], Pairs):
            raise EvalError("type", "select takes one {...}")
        clauses = {k: v for k, v in args[0].items if k in CLAUSES}
        outputs = [(k, v) for k, v in args[0].items if k not in CLAUSES]
        if "from" not in clauses:
            raise EvalError("domain", "select needs from:")
        df = self._table_of(s, clauses["from"])
        inner = Scope(s.names, df)
        if "where" in clauses:
            df = self._filter(inner, df, clauses["where"])
            inner = Scope(s.names, df)
        if "by" in clauses:
            df = self._group(s, df, clauses, outputs)
        elif outputs:
            grouped = Scope(s.names, df, True)
            if any(self._has_aggregate(v) for _, v in outputs):
                df = df.agg(*[self._column(grouped, v).alias(k) for k, v in outputs])
            else:
                sort = self._sorting(df, clauses, [k for k, _ in outputs])
                if sort and not all(c in {k for k, _ in outputs} for c, _ in sort):
                    kept = df.select("*", *[self._column(inner, v).alias(f"_out_{k}") for k, v in outputs])
                    named = {k for k, _ in outputs}
                    kept = kept.orderBy(*[(F.col(f"`_out_{c}`") if c in named else F.col(f"`{c}`")).desc() if d else (F.col(f"`_out_{c}`") if c in named else F.col(f"`{c}`")).asc() for c, d in sort])
                    if "take" in clauses:
                        kept = kept.limit(self._constant(s, clauses["take"]))
                    return kept.select(*[F.col(f"`_out_{k}`").alias(k) for k, _ in outputs])
                df = df.select(*[self._column(inner, v).alias(k) for k, v in outputs])
        sort = self._sorting(df, clauses, df.columns)
        if sort:
            for c, _ in sort:
                if c not in df.columns:
                    raise EvalError("name", f"{c} is unknown")
            df = df.orderBy(*[F.col(f"`{c}`").desc() if d else F.col(f"`{c}`").asc() for c, d in sort])
        if "take" in clauses:
            n = self._constant(s, clauses["take"])
            if not isinstance(n, int) or n < 0:
                raise EvalError("domain", "take: wants a count")
            df = df.limit(n)
        return df

    def _sorting(self, df: DataFrame, clauses: dict, outputs: list[str]) -> list[tuple[str, bool]]:
        out = []
        for way in ("asc", "desc"):
            if way in clauses:
                keys = clauses[way] if isinstance(clauses[way], Bracket) else [clauses[way]]
                out += [(self._quoted(k.form) if isinstance(k, Quoted) else k.name, way == "desc") for k in keys]
        return out

    def _has_aggregate(self, form: Any) -> bool:
        if not isinstance(form, list) or isinstance(form, Bracket) or not form:
            return False
        return isinstance(form[0], Symbol) and (form[0].name in AGGREGATES or form[0].name == "count") or any(self._has_aggregate(f) for f in form[1:])

    def _group(self, s: Scope, df: DataFrame, clauses: dict, outputs: list) -> DataFrame:
        keys = clauses["by"] if isinstance(clauses["by"], Bracket) else [clauses["by"]]
        inner, grouped = Scope(s.names, df), Scope(s.names, df, True)
        named = []
        for i, k in enumerate(keys):
            name = k.name if isinstance(k, Symbol) else self._quoted(k.form) if isinstance(k, Quoted) else f"by{i}"
            named.append((F.col(f"`{name}`") if isinstance(k, Quoted) else self._column(inner, k)).alias(name))
        aggregates = [self._column(grouped, v).alias(k) for k, v in outputs] or [F.count(F.lit(1)).alias("count")]
        by = df.groupBy(*named)
        if "pivot" in clauses:
            p = clauses["pivot"]
            by = by.pivot(p.name if isinstance(p, Symbol) else self._quoted(p.form))
        return by.agg(*aggregates)

    def _filter(self, s: Scope, df: DataFrame, form: Any) -> DataFrame:
        """Rows that pass; an `in` over a sub-select becomes a semi join, so that the set is never collected."""
        if isinstance(form, list) and form and form[0] == Symbol("and"):
            for part in form[1:]:
                df = self._filter(Scope(s.names, df), df, part)
            return df
        if isinstance(form, list) and len(form) == 3 and form[0] == Symbol("in"):
            values = self.eval(Scope(s.names), form[2]) if not isinstance(form[2], Symbol) or form[2].name not in df.columns else None
            if isinstance(values, Vector):
                return df.withColumn("_in", self._column(s, form[1])).join(values.table.select(F.col(f"`{values.column}`").alias("_in")).distinct(), "_in", "left_semi").drop("_in")
        return df.where(self._column(s, form))

    # --- expressions

    def _count(self, s: Scope, args: list) -> Any:
        if s.table is not None:
            if not args or args[0] == Symbol("t") or (isinstance(args[0], Symbol) and args[0].name not in s.table.columns):
                return F.count(F.lit(1))
            return F.count(F.lit(1)) if s.grouped else F.lit(1)
        value = self.eval(s, args[0])
        if isinstance(value, DataFrame):
            return value.count()
        if isinstance(value, Vector):
            return value.table.count()
        if isinstance(value, (list, dict, str)):
            return len(value)
        raise EvalError("type", "count wants a table or a list")

    def _aggregate(self, s: Scope, name: str, args: list) -> Any:
        if len(args) != 1:
            raise EvalError("domain", f"{name} takes one argument")
        if s.table is not None:
            return AGGREGATES[name](self._column(s, args[0]))
        value = self.eval(s, args[0])
        if isinstance(value, Vector):
            return value.table.agg(AGGREGATES[name](F.col(f"`{value.column}`"))).first()[0]
        if isinstance(value, list):
            return self.spark.createDataFrame([(x,) for x in value], ["v"]).agg(AGGREGATES[name]("v")).first()[0]
        raise EvalError("type", f"{name} wants a vector")

    def _at(self, s: Scope, args: list) -> Any:
        value, key = self.eval(s, args[0]), self.eval(s, args[1])
        if isinstance(value, DataFrame):
            if key not in value.columns:
                raise EvalError("name", f"{key} is unknown")
            return Vector(value.select(f"`{key}`"), key)
        if isinstance(value, dict):
            if key not in value:
                raise EvalError("domain", f"{key} is no key")
            return value[key]
        if isinstance(value, list):
            return value[key]
        if isinstance(value, Column):
            return value[key]
        raise EvalError("type", "at wants a table or a dict")

    def _compare(self, s: Scope, name: str, args: list) -> Any:
        if len(args) != 2:
            raise EvalError("domain", f"{name} takes two arguments")
        a, b = self.eval(s, args[0]), self.eval(s, args[1])
        if isinstance(a, Column) or isinstance(b, Column):
            return COMPARE[name](a if isinstance(a, Column) else F.lit(a), b if isinstance(b, Column) else F.lit(b))
        if isinstance(a, str) != isinstance(b, str) and name not in ("==", "!="):
            raise EvalError("type", f"{name} of a text and a number")
        return COMPARE[name](a, b)

    def _arithmetic(self, s: Scope, name: str, args: list) -> Any:
        values = [self.eval(s, a) for a in args]
        if not values or (name in ("div", "/", "%") and len(values) != 2):
            raise EvalError("domain", f"{name} has a wrong number of arguments")
        if not any(isinstance(v, Column) for v in values):
            if any(not isinstance(v, (int, float)) for v in values):
                raise EvalError("type", f"{name} wants numbers")
            if name in ("div", "/"):
                return values[0] / values[1] if values[1] else None
            if name == "%":
                return values[0] % values[1] if values[1] else None
            return -values[0] if name == "-" and len(values) == 1 else reduce(ARITHMETIC[name], values)
        cols = [v if isinstance(v, Column) else F.lit(v) for v in values]
        if name in ("div", "/"):
            return F.try_divide(cols[0].cast("double"), cols[1].cast("double"))
        if name == "%":
            return F.pmod(cols[0], F.nullif(cols[1], F.lit(0)))
        return -cols[0] if name == "-" and len(cols) == 1 else reduce(ARITHMETIC[name], cols)

    def _logic(self, s: Scope, args: list) -> Any:
        raise EvalError("type", "unreachable")

    def _not(self, s: Scope, args: list) -> Any:
        v = self.eval(s, args[0])
        return ~v if isinstance(v, Column) else not v

    def _if(self, s: Scope, args: list) -> Any:
        test = self.eval(s, args[0])
        if isinstance(test, Column):
            return F.when(test, self._column(s, args[1])).otherwise(self._column(s, args[2]) if len(args) > 2 else F.lit(None))
        return self.eval(s, args[1]) if test else self.eval(s, args[2]) if len(args) > 2 else None

    def _in(self, s: Scope, args: list) -> Any:
        x, values = self.eval(s, args[0]), self.eval(s, args[1])
        if isinstance(values, Vector):
            raise EvalError("domain", "in over a sub-select stands alone or under and, in where:")
        if isinstance(x, Column):
            return x.isin(*values)
        return x in values

    def _text(self, method: str) -> Callable:
        def go(s: Scope, args: list) -> Any:
            x, y = self.eval(s, args[0]), self.eval(s, args[1])
            if isinstance(x, Column):
                return getattr(x, method)(y)
            return {"startswith": str.startswith, "endswith": str.endswith, "contains": operator.contains}[method](x, y)

        return go

    # --- bindings and constructors

    def _set(self, s: Scope, args: list) -> Any:
        name = args[0].name if isinstance(args[0], Symbol) else self._quoted(args[0].form)
        value = self.eval(s, args[1])
        self.names[name] = value
        s.names[name] = value
        return value

    def _do(self, s: Scope, args: list) -> Any:
        value = None
        for a in args:
            value = self.eval(s, a)
        return value

    def _table(self, s: Scope, args: list) -> DataFrame:
        names = [x.name if isinstance(x, Symbol) else str(self._quoted(x.form) if isinstance(x, Quoted) else x) for x in args[0]]
        cols = self.eval(s, args[1])
        if len(names) != len(cols) or len({len(c) for c in cols}) > 1:
            raise EvalError("domain", "columns of unequal length")
        return self.spark.createDataFrame(list(zip(*cols, strict=True)), names)

    def _dict(self, s: Scope, args: list) -> dict:
        keys = [x.name if isinstance(x, Symbol) else self.eval(s, x) for x in args[0]]
        return dict(zip(keys, self.eval(s, args[1]), strict=True))

    def _concat(self, s: Scope, args: list) -> DataFrame:
        a, b = self._table_of(s, args[0]), self._table_of(s, args[1])
        if set(a.columns) != set(b.columns):
            raise EvalError("domain", "tables of unequal columns")
        return a.unionByName(b)

    def _insert(self, s: Scope, args: list) -> DataFrame:
        name = self.eval(s, args[0])
        self.names[name] = self._table_of(s, Symbol(name)).unionByName(self._table_of(s, args[1]))
        return self.names[name]

    def _distinct(self, s: Scope, args: list) -> Any:
        v = self.eval(s, args[0])
        return Vector(v.table.distinct(), v.column) if isinstance(v, Vector) else v.distinct()

    def _csv_read(self, s: Scope, args: list) -> DataFrame:
        path = self.eval(s, args[-1])
        df = self.spark.read.csv(path, header=True, inferSchema=len(args) == 1)
        if len(args) > 1:
            kinds = {"I64": "long", "I32": "int", "F64": "double", "F32": "float", "BOOL": "boolean", "STR": "string", "SYM": "string", "DATE": "date", "TIMESTAMP": "timestamp_ntz"}
            spec = self.eval(s, args[0])
            spec = [spec] * len(df.columns) if isinstance(spec, str) else spec
            df = df.select(*[F.col(f"`{c}`").cast(kinds[k]).alias(c) for c, k in zip(df.columns, spec, strict=True)])
        return df

    def _csv_write(self, s: Scope, args: list) -> DataFrame:
        df = self._table_of(s, args[0])
        df.write.csv(self.eval(s, args[1]), header=True, mode="overwrite")
        return df

    def _read(self, s: Scope, args: list) -> DataFrame:
        return self.spark.read.parquet(self.eval(s, args[0]))

    def _write(self, s: Scope, args: list) -> DataFrame:
        df = self._table_of(s, args[1])
        df.write.parquet(self.eval(s, args[0]), mode="overwrite")
        return df

    # --- graphs, rules, vectors

    def _node_table(self, edges: DataFrame, value: Any) -> DataFrame:
        kind = dict(edges.dtypes)["src"]
        return self.spark.createDataFrame([(v,) for v in (value if isinstance(value, list) else [value])], f"node {kind}")

    def _graph(self, name: str) -> Callable:
        def go(s: Scope, args: list) -> Any:
            if name == "build":
                df = self._table_of(s, args[0])
                return graph.build(df, *[self.eval(s, a) for a in args[1:]])
            g = self._table_of(s, args[0])
            rest = [self.eval(s, a) for a in args[1:]]
            if name == "info":
                return graph.info(g).first().asDict()
            if name == "free":
                g.unpersist()
                return None
            weight = "weight" if "weight" in g.columns else None
            table: dict[str, Callable] = {
                "pagerank": lambda: graph.pagerank(g, *rest),
                "degree": lambda: graph.degree(g),
                "topsort": lambda: graph.topological(g),
                "connected": lambda: graph.components(g),
                "expand": lambda: graph.reach(g, self._node_table(g, rest[0])).select(F.col("node").alias("_node"), F.col("depth").alias("_depth")),
                "dfs": lambda: graph.dfs(g, rest[0]),
                "var-expand": lambda: graph.reach(g, self._node_table(g, rest[0]), *rest[1:]).select(F.col("node").alias("_node"), F.col("depth").alias("_depth")),
                "shortest-path": lambda: graph.shortest_path(g, rest[0], rest[1]),
                "dijkstra": lambda: graph.shortest(g, self._node_table(g, rest[0]), weight).select(F.col("node").alias("_node"), F.col("distance").alias("_dist")),
                "k-shortest": lambda: graph.k_shortest(g, *rest),
                "cluster": lambda: graph.clustering(g),
                "betweenness": lambda: graph.betweenness(g),
                "closeness": lambda: graph.closeness(g),
                "louvain": lambda: graph.louvain(g),
                "mst": lambda: graph.spanning_forest(g if weight else g.withColumn("weight", F.lit(1.0))),
                "random-walk": lambda: graph.random_walk(g, self._node_table(g, rest[0]), *rest[1:]),
            }
            return table[name]()

        return go

    def _fact(self, add: bool) -> Callable:
        def go(s: Scope, args: list) -> datalog.Datoms:
            db = self.eval(s, args[0])
            e, a, v = (self.eval(s, x) for x in args[1:4])
            new = db.assert_fact(e, a, v) if add else db.retract_fact(e, a, v)
            for n, old in list(self.names.items()):
                if old is db:
                    self.names[n] = new
            return new

        return go

    def _term(self, s: Scope, form: Any) -> Any:
        if isinstance(form, Symbol):
            return datalog.Var(form.name) if form.name.startswith("?") or form.name == "_" else form.name
        return self.eval(s, form)

    def _atom(self, s: Scope, form: list) -> datalog.Atom:
        if len(form) == 3 and isinstance(form[1], Symbol) and form[1].name.startswith(":"):
            return datalog.Atom(form[1].name, [self._term(s, form[0]), self._term(s, form[2])])
        return datalog.Atom(form[0].name, [self._term(s, x) for x in form[1:]])

    def _rule(self, s: Scope, args: list) -> None:
        self.rules.append(datalog.Rule(self._atom(s, args[0]), [self._atom(s, b) for b in args[1:]]))

    def _query(self, s: Scope, args: list) -> DataFrame:
        db = self.eval(s, args[0])
        find = [x.name for x in args[1][1:]]
        where = [self._atom(s, f) for f in args[2][1:]]
        return datalog.Datoms(db.facts, [*db.rules, *self.rules]).query(find, where)

    def _array(self, s: Scope, form: Any) -> Column:
        v = self.eval(s, form)
        return F.array(*[F.lit(float(x)) for x in v]) if isinstance(v, list) else v

    def _distance(self, metric: str) -> Callable:
        return lambda s, a: self._value(vectors.distance(self._array(s, a[0]), self._array(s, a[1]), metric), s)

    def _pairwise(self, f: Callable) -> Callable:
        return lambda s, a: self._value(f(self._array(s, a[0]), self._array(s, a[1])), s)

    def _vectors(self, source: Any) -> tuple[DataFrame, str, Column]:
        """(table, key, vector) of a list of vectors or a table with a key and either an array or wide components."""
        if isinstance(source, list):
            df = self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(source)], "_rowid long, v array<double>")
            return df, "_rowid", F.col("v")
        if isinstance(source, DataFrame):
            arrays = [c for c, t in source.dtypes if t.startswith("array<")]
            return source, next(c for c, t in source.dtypes if t in ("bigint", "int")), F.col(f"`{arrays[0]}`") if arrays else vectors.wide(source)
        raise EvalError("type", "vectors are wanted")

    def _index(self, s: Scope, args: list) -> vector_index.Index:
        metric = self.eval(s, args[1]) if len(args) > 1 else "cosine"
        return vector_index.build(*self._vectors(self.eval(s, args[0])), metric)

    def _index_save(self, s: Scope, args: list) -> vector_index.Index:
        index = self.eval(s, args[0])
        index.save(self.eval(s, args[1]))
        return index

    def _ann(self, s: Scope, args: list) -> DataFrame:
        index = self.eval(s, args[0])
        if not isinstance(index, vector_index.Index):
            raise EvalError("type", "ann wants an index; build one with hnsw-build")
        return index.nearest([float(x) for x in self.eval(s, args[1])], self.eval(s, args[2]))

    def _timer(self, s: Scope, args: list) -> Any:
        """(timer ms n f): calls f with the number of the call, n times (n of 0 is refused, as it never ends), `ms` apart; the last value."""
        ms, n, fn = (self.eval(s, a) for a in args[:3])
        if not isinstance(fn, Lambda) or n <= 0:
            raise EvalError("domain", "timer wants milliseconds, a count and a function")
        value = None
        for i in range(n):
            time.sleep(ms / 1000 if i else 0)
            value = self._call(s, fn, [i] if fn.params else [])
        return value

    def _knn(self, s: Scope, args: list) -> DataFrame:
        source, query, k = self.eval(s, args[0]), self.eval(s, args[1]), self.eval(s, args[2])
        metric = self.eval(s, args[3]) if len(args) > 3 else "cosine"
        return vectors.knn(*self._vectors(source), query, k, metric)


def _logic_of(engine: Engine, name: str) -> Callable:
    def go(s: Scope, args: list) -> Any:
        values = [engine.eval(s, a) for a in args]
        if any(isinstance(v, Column) for v in values):
            cols = [v if isinstance(v, Column) else F.lit(v) for v in values]
            return reduce(operator.and_ if name == "and" else operator.or_, cols)
        return all(values) if name == "and" else any(values)

    return go


def engine(spark: SparkSession, tables: dict[str, DataFrame] | None = None) -> Engine:
    """An engine with the given tables bound by name."""
    e = Engine(spark, tables)
    e.forms |= {n: _logic_of(e, n) for n in ("and", "or")}
    return e


def promote(spark: SparkSession, value: Any) -> DataFrame:
    """A value as rows."""
    if isinstance(value, DataFrame):
        return value
    if isinstance(value, Vector):
        return value.table.select(F.col(f"`{value.column}`").alias("value"))
    if value is None:
        return spark.createDataFrame([], "value string")
    if isinstance(value, (bool, int, float, str)):
        return spark.createDataFrame([(value,)], ["value"])
    if isinstance(value, dict):
        text = any(isinstance(v, (str, bool, list)) for v in value.values())
        return spark.createDataFrame([(str(k), str(v) if text else v) for k, v in value.items()], ["key", "value"]) if value else spark.createDataFrame([], "key string, value string")
    if isinstance(value, list):
        if any(isinstance(v, (list, dict, DataFrame)) for v in value):
            raise EvalError("type", "a list of lists is no result")
        return spark.createDataFrame([(v,) for v in value], ["value"]) if value else spark.createDataFrame([], "value string")
    raise EvalError("type", f"{type(value).__name__} is no result")
