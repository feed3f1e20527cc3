"""Attribute filters: an expression tree of dicts compiled to one boolean Column without nulls, so that Catalyst can push it down.

{field: value | [values] | {op: operand}}, {"and": [...]}, {"or": [...]}, {"not": ...}; keys of one dict must all hold. Missing values
match neq, nin, not and exists: false. All of a filter is validated before anything runs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.errors import InvalidFilterError
from siftwell.functions import jsvalues as J

OPERATORS = ("eq", "neq", "in", "nin", "gt", "gte", "lt", "lte", "exists")
KINDS = ("string", "number", "boolean", "string[]")


@dataclass(frozen=True)
class FilterField:
    """An attribute: its column (name, Column or null for the name itself) is read as one of KINDS."""

    name: str
    kind: str = "string"
    getter: Column | str | None = None

    def __post_init__(self) -> None:
        if not self.name or self.kind not in KINDS:
            raise InvalidFilterError(f"a field has a name and a kind of {KINDS}", self.name or None)

    def source(self) -> Column:
        return F.col(f"`{self.name}`") if self.getter is None else F.col(self.getter) if isinstance(self.getter, str) else self.getter

    def column(self, kind: T.DataType) -> Column:
        """The typed value; null is missing."""
        col = self.source()
        if self.kind == "string" and isinstance(kind, T.StringType):
            return col
        if self.kind == "string":
            return F.when(col.isNotNull(), J.text_column(col, kind))
        return {"number": J.number_column, "boolean": J.boolean_column, "string[]": J.tags_column}[self.kind](col, kind)


Fields = Mapping[str, FilterField]


def attribute(name: str) -> Column:
    """Where prepared data keep a field's typed value."""
    return F.col(f"`_a_{name}`")


Sure = Callable[[Column], Column]


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _bare(c: Column) -> Column:
    """In a filter null and false are one, and a bare comparison is one that a scan can take over."""
    return c


def compile_filter(expr: Any, fields: Fields, at: Callable[[str], Column] = attribute, filtering: bool = False) -> Column:
    """The Column of a filter expression. filtering: it is only used to filter, and may be null for false outside of negations."""
    return _compile(expr, fields, at, _bare if filtering else _sure)


def _compile(expr: Any, fields: Fields, at: Callable[[str], Column], sure: Sure) -> Column:
    if not isinstance(expr, Mapping):
        raise InvalidFilterError("an expression is an object")
    parts = []
    for key, value in expr.items():
        if key in ("and", "or"):
            if not isinstance(value, list | tuple):
                raise InvalidFilterError(f"{key} takes a list")
            inner = [_compile(x, fields, at, sure) for x in value]
            if not inner:
                parts.append(F.lit(key == "and"))
            else:
                parts.append(reduce(lambda a, b: a & b, inner) if key == "and" else reduce(lambda a, b: a | b, inner))
        elif key == "not":
            parts.append(~_compile(value, fields, at, _sure))
        elif key not in fields:
            raise InvalidFilterError("unknown field", key)
        else:
            parts.append(_condition(fields[key], value, at(key), sure))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _condition(field: FilterField, value: Any, col: Column, sure: Sure) -> Column:
    if isinstance(value, list | tuple):
        return _in(field, value, col, sure)
    if not isinstance(value, Mapping):
        return _eq(field, value, col, sure)
    if not value:
        raise InvalidFilterError("an empty comparison", field.name)
    parts = []
    for op, operand in value.items():
        if op not in OPERATORS:
            raise InvalidFilterError(f"unknown operator {op!r}", field.name)
        if op in ("in", "nin") and not isinstance(operand, list | tuple):
            raise InvalidFilterError(f"{op} takes a list", field.name)
        if op == "eq":
            parts.append(_eq(field, operand, col, sure))
        elif op == "neq":
            parts.append(~_eq(field, operand, col, _sure))
        elif op == "in":
            parts.append(_in(field, operand, col, sure))
        elif op == "nin":
            parts.append(~_in(field, operand, col, _sure))
        elif op == "exists":
            parts.append(col.isNotNull() if operand else col.isNull())
        else:
            parts.append(_range(field, op, operand, col, sure))
    return reduce(lambda a, b: a & b, parts)


def _boolean(field: FilterField, value: Any) -> bool:
    if isinstance(value, bool):
        return value
    if value in ("true", "false"):
        return value == "true"
    raise InvalidFilterError(f"{value!r} is no boolean", field.name)


def _eq(field: FilterField, value: Any, col: Column, sure: Sure) -> Column:
    if isinstance(value, Mapping | list | tuple):
        raise InvalidFilterError("eq takes a single value", field.name)
    if value is None:
        return col.isNull()
    if field.kind == "number":
        x = J.number_of(value)
        return F.lit(False) if x is None else sure(col == F.lit(x))
    if field.kind == "boolean":
        return sure(col == F.lit(_boolean(field, value)))
    if field.kind == "string[]":
        return sure(F.array_contains(col, J.text_of(value)))
    return sure(col == F.lit(J.text_of(value)))


def _in(field: FilterField, values: Any, col: Column, sure: Sure) -> Column:
    some = [v for v in values if v is not None]
    if any(isinstance(v, Mapping | list | tuple) for v in some):
        raise InvalidFilterError("in takes single values", field.name)
    out = col.isNull() if len(some) < len(values) else F.lit(False)
    if field.kind == "number":
        known = [x for x in map(J.number_of, some) if x is not None]
    elif field.kind == "boolean":
        known = [_boolean(field, v) for v in some]
    else:
        known = [J.text_of(v) for v in some]
    if not known:
        return out
    found = F.arrays_overlap(col, F.array(*map(F.lit, known))) if field.kind == "string[]" else col.isin(*known)
    return out | sure(found) if len(some) < len(values) else sure(found)


def utf16_order(col: Column) -> Column:
    """A key that orders strings by UTF-16 units."""
    return F.encode(col, "UTF-16BE")


def _range(field: FilterField, op: str, bound: Any, col: Column, sure: Sure) -> Column:
    if field.kind not in ("number", "string"):
        raise InvalidFilterError(f"{op} needs a number or string field", field.name)
    if field.kind == "number":
        x = J.number_of(bound)
        if x is None:
            raise InvalidFilterError(f"{op} needs a finite number", field.name)
        left, right = col, F.lit(x)
    else:
        if bound is None or isinstance(bound, Mapping | list | tuple):
            raise InvalidFilterError(f"{op} needs a single value", field.name)
        text = J.text_of(bound)
        # up to U+D7FF both orders agree on where a text stands: the plain comparison can reach the scan
        plain = all(c < "\ud800" for c in text)
        left, right = (col, F.lit(text)) if plain else (utf16_order(col), utf16_order(F.lit(text)))
    return sure({"gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right}[op])


def implied(expr: Any, names: set[str]) -> dict:
    """Conjunctive comparisons of an expression with values on the named number fields: what passes the expression passes them on the columns as they are, too,
    whatever these hold beside finite numbers."""
    out: list[dict] = []
    for key, value in expr.items():
        if key == "and":
            out += [e for x in value if (e := implied(x, names))]
        elif key in names:
            tests = value if isinstance(value, Mapping) else {"in" if isinstance(value, list | tuple) else "eq": value}
            some = {op: x for op, x in tests.items() if op in ("gt", "gte", "lt", "lte") or op == "eq" and x is not None or op == "in" and None not in x}
            if some:
                out.append({key: some})
    return {"and": out} if out else {}


def compile_bounds(expr: Any, fields: Fields, bounds: Callable[[str], tuple[Column, Column, Column]]) -> Column:
    """Whether rows of given bounds (least value, greatest value, number of nulls of each field) may pass a valid filter: true where any might.

    Negations, lists of tags, and orders that differ from the columns' own are in doubt, and so true.
    """
    parts = []
    for key, value in expr.items():
        if key in ("and", "or"):
            inner = [compile_bounds(x, fields, bounds) for x in value]
            parts.append(reduce((lambda a, b: a & b) if key == "and" else (lambda a, b: a | b), inner) if inner else F.lit(key == "and"))
        elif key != "not" and fields[key].kind != "string[]":
            parts.append(_bounded(fields[key], value, *bounds(key)))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _bounded(field: FilterField, value: Any, lo: Column, hi: Column, nulls: Column) -> Column:
    def among(x: Any) -> Column:
        if x is None:
            return nulls > 0
        known = J.number_of(x) if field.kind == "number" else _boolean(field, x) if field.kind == "boolean" else J.text_of(x)
        return F.lit(False) if known is None else _sure((lo <= F.lit(known)) & (hi >= F.lit(known)))

    def one_of(values: Any) -> Column:
        return reduce(lambda a, b: a | b, map(among, values)) if values else F.lit(False)

    if isinstance(value, list | tuple):
        return one_of(value)
    if not isinstance(value, Mapping):
        return among(value)
    parts = []
    for op, operand in value.items():
        if op == "eq":
            parts.append(among(operand))
        elif op == "in":
            parts.append(one_of(operand))
        elif op == "exists":
            parts.append(lo.isNotNull() if operand else nulls > 0)
        elif op in ("gt", "gte", "lt", "lte"):
            x = J.number_of(operand) if field.kind == "number" else J.text_of(operand)
            if field.kind == "number" or all(c < "\ud800" for c in x):
                edge = hi if op in ("gt", "gte") else lo
                parts.append(_sure({"gt": edge > F.lit(x), "gte": edge >= F.lit(x), "lt": edge < F.lit(x), "lte": edge <= F.lit(x)}[op]))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def references(expr: Any, field: str) -> bool:
    """Does any condition of the expression stand on the field?"""
    if isinstance(expr, list | tuple):
        return any(references(x, field) for x in expr)
    if not isinstance(expr, Mapping):
        return False
    return any(k == field or k in ("and", "or", "not") and references(v, field) for k, v in expr.items())


def without_field(expr: Any, field: str) -> Any:
    """The expression without conditions on the field that stand in conjunctions; or and not stay as they are."""
    out = {}
    for key, value in expr.items():
        if key == "and":
            out[key] = [without_field(x, field) for x in value]
        elif key != field:
            out[key] = value
    return out
