"""What an index is over: its id, search fields, attributes and case rule; and the prepared DataFrame behind it."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.errors import IncompatibleIndexError
from siftwell.functions.jsvalues import text_column
from siftwell.functions.normalize import ascii_normalized, normalized
from siftwell.operators.filters import FilterField
from siftwell.plans.options import PROFILE, hooks_of


@dataclass(frozen=True)
class SearchField:
    """A text field: getter is a column name or Column (the name itself if None); weight is positive."""

    name: str
    weight: float = 1.0
    getter: Column | str | None = None

    def __post_init__(self) -> None:
        w = self.weight
        if not self.name or isinstance(w, bool) or not isinstance(w, int | float) or not math.isfinite(w) or w <= 0:
            raise ValueError("a search field has a name and a positive finite weight")

    def source(self) -> Column:
        return F.col(f"`{self.name}`") if self.getter is None else F.col(self.getter) if isinstance(self.getter, str) else self.getter


@dataclass(frozen=True)
class IndexSchema:
    """Fixed at creation. Fields are ranked by falling weight, then as declared; that is their place."""

    fields: tuple[SearchField, ...]
    id: str = "id"
    filter_fields: tuple[FilterField, ...] = ()
    case_sensitive: bool = False
    ascii_only: bool = False
    order_by: str | None = None
    hooks: Mapping[str, Callable] = field(default_factory=dict)
    profile: str = PROFILE

    def __post_init__(self) -> None:
        if not self.fields:
            raise ValueError("an index needs a search field")
        for what, names in (("search", [f.name for f in self.fields]), ("filter", [f.name for f in self.filter_fields])):
            if len(set(names)) != len(names):
                raise ValueError(f"a {what} field occurs twice")
        object.__setattr__(self, "fields", tuple(sorted(self.fields, key=lambda f: -f.weight)))
        object.__setattr__(self, "hooks", hooks_of(self.hooks))

    @property
    def folded(self) -> bool:
        return not self.case_sensitive

    @property
    def filters(self) -> dict[str, FilterField]:
        return {f.name: f for f in self.filter_fields}

    def places(self, names: list[str] | None) -> list[int]:
        """Places of the named fields (all if None)."""
        if names is None:
            return list(range(len(self.fields)))
        known = {f.name: k for k, f in enumerate(self.fields)}
        for n in names:
            if n not in known:
                raise ValueError(f"unknown search field {n!r}")
        return sorted({known[n] for n in names})

    def prepare(self, docs: DataFrame, batch: int = 0) -> DataFrame:
        """id, doc_index, raw and normalized text of each field, typed attributes, and the record as struct doc.

        Rows of a null or empty id are refused when they are met. One projection: Spark keeps of it what a query reads.
        """
        if self.id not in docs.columns:
            raise IncompatibleIndexError(f"an id column {self.id!r}", docs.columns)
        kinds = {f.name: f.dataType for f in docs.schema.fields}
        both = docs.select(*[s.source().alias(f"_{k}") for k, s in enumerate(self.fields)]).schema
        raw = [text_column(s.source(), both[f"_{k}"].dataType) for k, s in enumerate(self.fields)]
        norm = ascii_normalized if self.ascii_only else normalized
        key = F.col(f"`{self.id}`")
        bad = key.isNull() | (key.cast("string") == "") if isinstance(kinds[self.id], T.StringType) else key.isNull()
        checked = F.when(bad, F.raise_error(F.lit("a document has no id")).cast(kinds[self.id])).otherwise(key)
        place = F.struct(F.lit(batch).alias("batch"), (F.col(f"`{self.order_by}`") if self.order_by else key).alias("place"))
        first = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), checked.alias("id"), place.alias("doc_index"), *[c.alias(f"_r_{k}") for k, c in enumerate(raw)], *self.typed(docs))
        return once(first, {f"_n_{k}": norm(F.col(f"_r_{k}"), self.folded) for k in range(len(raw))})

    def typed(self, docs: DataFrame) -> list[Column]:
        """The typed value of each filter field, as _a_ and its name."""
        kinds = docs.select(*[f.source().alias(f"_f{k}") for k, f in enumerate(self.filter_fields)]).schema
        return [f.column(kinds[f"_f{k}"].dataType).alias(f"_a_{f.name}") for k, f in enumerate(self.filter_fields)]

    def doubles(self, prepared: DataFrame) -> dict[str, str]:
        """Number fields that are columns of doubles of the record, and those columns."""
        kinds = {f.name: f.dataType for f in prepared.schema["doc"].dataType.fields}
        own = {f.name: f.name if f.getter is None else f.getter for f in self.filter_fields if f.kind == "number" and isinstance(f.getter, str | None)}
        return {k: c for k, c in own.items() if isinstance(kinds.get(c), T.DoubleType | T.FloatType)}

    def manifest(self) -> dict:
        return {
            "profile": self.profile, "id": self.id, "case_sensitive": self.case_sensitive, "ascii_only": self.ascii_only, "order_by": self.order_by,
            "fields": [{"name": f.name, "weight": f.weight, "getter": f.getter is not None} for f in self.fields],
            "filter_fields": [{"name": f.name, "kind": f.kind, "getter": f.getter is not None} for f in self.filter_fields],
            "hooks": {k: hook_id(h) for k, h in sorted(self.hooks.items())},
        }


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with more columns that are computed once a row.

    A generator of one row stands between them and what is above: Catalyst neither moves filters on them below (and so computes them
    twice) nor copies their expressions into others; filters on other columns still pass down to the scan.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def hook_id(fn: Callable) -> str:
    return getattr(fn, "hook_id", None) or getattr(fn, "__name__", None) or "anonymous"
