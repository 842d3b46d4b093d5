"""Datalog over a triple store: facts, rules with recursion, queries.

Terms are variables (`?x`), the wildcard `_`, or constants. A body atom is (relation, [terms]); `:attr` patterns match triples of that
attribute. Several rules of one head are a union. Recursion is evaluated semi-naively: each round, every rule is joined once
per recursive atom with only the newest rows in that place. Negation and arithmetic are not supported.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.session import checkpointed


@dataclass(frozen=True)
class Var:
    """A logic variable."""

    name: str


WILD = Var("_")


@dataclass
class Atom:
    """A relation applied to terms; a triple pattern has the relation `:attr` and two terms."""

    relation: str
    terms: list


@dataclass
class Rule:
    """head :- body."""

    head: Atom
    body: list[Atom]


class Datoms:
    """An immutable store of (e, a, v) text triples with rules."""

    def __init__(self, facts: DataFrame, rules: list[Rule] | None = None):
        self.facts, self.rules = facts, rules or []

    @classmethod
    def empty(cls, spark: SparkSession) -> Datoms:
        """A store of no facts."""
        return cls(spark.createDataFrame([], "e string, a string, v string"))

    @classmethod
    def from_edges(cls, edges: DataFrame, attribute: str, src: str = "src", dst: str = "dst") -> Datoms:
        """A store of one attribute, in bulk."""
        return cls(edges.select(F.col(src).cast("string").alias("e"), F.lit(attribute).alias("a"), F.col(dst).cast("string").alias("v")).dropna().distinct())

    def assert_fact(self, e: object, a: str, v: object) -> Datoms:
        """The store with a fact more."""
        row = self.facts.sparkSession.createDataFrame([(str(e), a, str(v))], "e string, a string, v string")
        return Datoms(self.facts.unionByName(row).distinct(), self.rules)

    def retract_fact(self, e: object, a: str, v: object) -> Datoms:
        """The store with a fact less."""
        return Datoms(self.facts.where(~((F.col("e") == str(e)) & (F.col("a") == a) & (F.col("v") == str(v)))), self.rules)

    def with_rules(self, *rules: Rule) -> Datoms:
        """The store with rules more."""
        return Datoms(self.facts, [*self.rules, *rules])

    def _match(self, atom: Atom, table: DataFrame) -> DataFrame:
        """The rows of a relation that fit an atom, one column per variable."""
        names: dict[str, str] = {}
        out = table
        for i, t in enumerate(atom.terms):
            c = F.col(f"c{i}")
            if isinstance(t, Var):
                if t.name == "_":
                    continue
                if t.name in names:
                    out = out.where(c == F.col(names[t.name]))
                else:
                    names[t.name] = f"c{i}"
            else:
                out = out.where(c == F.lit(str(t)))
        return out.select(*[F.col(c).alias(n) for n, c in names.items()])

    def _base(self, relation: str) -> DataFrame:
        return self.facts.where(F.col("a") == relation.lstrip(":")).select(F.col("e").alias("c0"), F.col("v").alias("c1"))

    def _join(self, atoms: list[Atom], tables: list[DataFrame]) -> DataFrame:
        parts = [self._match(atom, table) for atom, table in zip(atoms, tables, strict=True)]
        out = parts.pop(0)
        while parts:
            # An atom that shares a variable comes next; one that shares none with any other may only ask whether it holds.
            at = next((i for i, p in enumerate(parts) if set(p.columns) & set(out.columns)), None)
            if at is not None:
                part = parts.pop(at)
                out = out.join(part, [c for c in part.columns if c in out.columns])
                continue
            part = parts.pop(0)
            if part.columns and out.columns:
                raise ValueError("atoms without a shared variable would pair every row with every other; join them by a variable")
            one = F.broadcast(part.limit(1)) if not part.columns else F.broadcast(out.limit(1))
            out = out.crossJoin(one) if not part.columns else part.crossJoin(one)
        return out

    def relation(self, name: str) -> DataFrame:
        """All rows of a derived relation, as c0, c1, ..."""
        derived = {r.head.relation for r in self.rules}
        if name not in derived:
            return self._base(name)
        width = {r.head.relation: len(r.head.terms) for r in self.rules}
        needed, todo = set(), [name]
        while todo:
            n = todo.pop()
            if n not in needed:
                needed.add(n)
                todo += [a.relation for r in self.rules if r.head.relation == n for a in r.body if a.relation in derived]
        rules = [r for r in self.rules if r.head.relation in needed]
        spark = self.facts.sparkSession
        empty = lambda n: spark.createDataFrame([], ", ".join(f"c{i} string" for i in range(width[n])))
        total, newest = {n: empty(n) for n in needed}, {n: None for n in needed}
        first = True
        while True:
            got: dict[str, DataFrame] = {}
            for r in rules:
                places = [i for i, a in enumerate(r.body) if a.relation in needed]
                if not places and not first:
                    continue
                for at in places or [None]:
                    if at is not None and newest[r.body[at].relation] is None:
                        continue
                    tables = [newest[a.relation] if i == at else total[a.relation] if a.relation in needed else self._base(a.relation) for i, a in enumerate(r.body)]
                    rows = self._join(r.body, tables).select(*[F.col(t.name).alias(f"c{i}") if isinstance(t, Var) else F.lit(str(t)).alias(f"c{i}") for i, t in enumerate(r.head.terms)])
                    h = r.head.relation
                    got[h] = rows if h not in got else got[h].unionByName(rows)
            first = False
            newest = {n: None for n in needed}
            for h, rows in got.items():
                new = checkpointed(rows.distinct().join(total[h], total[h].columns, "left_anti"))
                if not new.isEmpty():
                    newest[h] = new
                    total[h] = checkpointed(total[h].unionByName(new))
            if all(v is None for v in newest.values()):
                return total[name]

    def query(self, find: list[str], where: list[Atom]) -> DataFrame:
        """The distinct values of the variables `find` over all that fits."""
        return self._join(where, [self.relation(a.relation) for a in where]).select(*find).distinct()
