"""The typed table query: project, filter, sort and page, with the comparison rules of a dynamically typed store."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
OPERATORS = ("eq", "ne", "in", "not_in", "contains", "starts_with", "ends_with", "regex", "not_regex", "gt", "gte", "lt", "lte")
EPSILON = 2.220446049250313e-16


class QueryError(ValueError):
    """A query that names no column, has a bad pattern or a bad argument."""


@dataclass
class Filter:
    """One condition."""

    column: str
    op: str = "eq"
    value: Any = None


@dataclass
class Sort:
    """One sort key."""

    column: str
    descending: bool = False


@dataclass
class TableQuery:
    """A whole query; no columns means all."""

    columns: list[str] | None = None
    filters: list[Filter] = field(default_factory=list)
    mode: str = "all"
    sort: list[Sort] = field(default_factory=list)
    offset: int = 0
    limit: int | None = None


def _is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _key(value: Any) -> str:
    """The text by which values of mixed types compare: null is empty, numbers are their text."""
    return "" if value is None else value if isinstance(value, str) else json.dumps(value)


def _equal(col: Column, kind: str, value: Any) -> Column:
    if value is None:
        return col.isNull()
    numeric = kind in NUMBERS and kind != "boolean"
    if numeric and _is_number(value):
        same = F.abs(col - F.lit(value)) < EPSILON if kind in ("float", "double") or isinstance(value, float) else col == F.lit(value)
    elif (kind == "string" and isinstance(value, str)) or (kind == "boolean" and isinstance(value, bool)):
        same = col == F.lit(value)
    else:
        return F.lit(False)
    return F.coalesce(same, F.lit(False))


def condition(filter_: Filter, kinds: dict[str, str]) -> Column:
    """A condition as a column that is never null."""
    if filter_.column not in kinds:
        raise QueryError(f"unknown column {filter_.column}")
    if filter_.op not in OPERATORS:
        raise QueryError(f"unknown operator {filter_.op}")
    col, kind, value, op = F.col(f"`{filter_.column}`"), kinds[filter_.column], filter_.value, filter_.op
    text = kind == "string"
    if op == "eq":
        return _equal(col, kind, value)
    if op == "ne":
        return ~_equal(col, kind, value)
    if op in ("in", "not_in"):
        if not isinstance(value, list):
            return F.lit(False)
        some = reduce(lambda a, b: a | b, [_equal(col, kind, v) for v in value], F.lit(False))
        return some if op == "in" else ~some
    if op in ("contains", "starts_with", "ends_with"):
        if not (text and isinstance(value, str)):
            return F.lit(False)
        test = {"contains": col.contains, "starts_with": col.startswith, "ends_with": col.endswith}[op](value)
        return F.coalesce(test, F.lit(False))
    if op in ("regex", "not_regex"):
        pattern = value if isinstance(value, str) else ""
        try:
            re.compile(pattern)
        except re.error as e:
            raise QueryError(f"invalid pattern {pattern}: {e}") from e
        hit = F.coalesce(col.rlike(pattern), F.lit(False)) if text else F.lit(False)
        return hit if op == "regex" else ~hit
    if kind in NUMBERS and kind != "boolean" and _is_number(value):
        a, b = col.cast("double"), F.lit(float(value))
    else:
        a, b = F.coalesce(col.cast("string"), F.lit("")), F.lit(_key(value))
    test = {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]
    return F.coalesce(test, F.lit(False))


def matching(df: DataFrame, query: TableQuery) -> DataFrame:
    """The rows that match, all columns."""
    kinds = dict(df.dtypes)
    for c in [*(query.columns or []), *[s.column for s in query.sort]]:
        if c not in kinds:
            raise QueryError(f"unknown column {c}")
    tests = [condition(f, kinds) for f in query.filters]
    if not tests:
        return df
    return df.where(reduce((lambda a, b: a & b) if query.mode == "all" else (lambda a, b: a | b), tests))


def run(df: DataFrame, query: TableQuery, stable_by: list[str] | None = None) -> DataFrame:
    """The page a query asks for, as one plan.

    Sorting is stable by `stable_by`, columns that order the rows totally (the store's row order has no meaning in
    Parquet); nulls sort as the least value. A sort with a page becomes a top-k of offset + limit rows.
    """
    out = matching(df, query)
    if query.sort or stable_by:
        keys = [F.col(f"`{s.column}`").desc_nulls_last() if s.descending else F.col(f"`{s.column}`").asc_nulls_first() for s in query.sort]
        keys += [F.col(f"`{c}`").asc_nulls_first() for c in stable_by or []]
        out = out.orderBy(*keys)
    if query.offset:
        out = out.offset(query.offset)
    if query.limit is not None:
        out = out.limit(query.limit)
    return out.select(*[F.col(f"`{c}`") for c in query.columns]) if query.columns else out


def counts(df: DataFrame, query: TableQuery) -> tuple[int, int]:
    """(total rows, matched rows), in one pass."""
    kinds = dict(df.dtypes)
    tests = [condition(f, kinds) for f in query.filters]
    both = reduce((lambda a, b: a & b) if query.mode == "all" else (lambda a, b: a | b), tests) if tests else F.lit(True)
    r = df.agg(F.count("*").alias("total"), F.count_if(both).alias("matched")).first()
    return r["total"], r["matched"]


def parse_value(text: str) -> Any:
    """A value as JSON, else as text."""
    try:
        return json.loads(text)
    except ValueError:
        return text


def from_cli(filters: list[str], columns: str | None = None, sort: list[str] | None = None, descending: bool = False, mode: str = "all", offset: int = 0, limit: int | None = None) -> TableQuery:
    """A query from `column:op:value`, a comma list of columns and `column[:asc|desc]` keys."""
    parsed = []
    for f in filters:
        parts = f.split(":", 2)
        if len(parts) != 3:
            raise QueryError(f"filter {f} is not column:op:value")
        parsed.append(Filter(parts[0], parts[1], parse_value(parts[2])))
    keys = []
    for s in sort or []:
        name, _, way = s.partition(":")
        if way not in ("", "asc", "desc"):
            raise QueryError(f"sort {s} is not column[:asc|desc]")
        keys.append(Sort(name, descending if not way else way == "desc"))
    cols = [c.strip() for c in columns.split(",") if c.strip()] if columns else None
    return TableQuery(cols or None, parsed, mode, keys, offset, limit)


def from_json(args: dict[str, Any]) -> TableQuery:
    """A query from its JSON form: op defaults to eq, mode to all, limit to 100, offset to 0; sort is an object or a list."""
    limit = args.get("limit", 100)
    if not isinstance(limit, int) or limit <= 0:
        raise QueryError("limit must be a positive number")
    sort = args.get("sort") or []
    sort = [sort] if isinstance(sort, dict) else sort
    way = lambda s: bool(s.get("descending", s.get("direction") == "desc"))
    return TableQuery(
        args.get("columns") or None,
        [Filter(f["column"], f.get("op", "eq"), f.get("value")) for f in args.get("filters") or []],
        args.get("filter_mode", "all"),
        [Sort(s["column"], way(s)) for s in sort],
        args.get("offset", 0),
        limit,
    )
