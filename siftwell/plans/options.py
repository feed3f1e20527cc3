"""Search options, validated before anything runs."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from siftwell.errors import IncompatibleOptionError, ProfileMismatchError

MODES = ("substring", "fuzzy", "token", "prefix")
QUERY_MAX, LIMIT_MAX, LIMIT = 128, 8192, 50
FACETS_MAX, RANGES_MAX, TERMS_LIMIT = 32, 100, 10
TIE_BREAKERS = ("score", "field_weight", "exact_match", "matched_length", "id")
PROFILE = "unicode-16.0.0/parity-v1"
HOOKS = ("tokenizer", "scoring_hook", "filter_predicate", "post_process")


def limit_of(value: Any, default: int = LIMIT) -> int:
    """1 to LIMIT_MAX: fractions are floored, what is no number gives the default, None gives 1."""
    if value is None:
        return 1
    try:
        value = float(value)
    except (TypeError, ValueError):
        return default
    return default if math.isnan(value) else int(min(max(math.floor(value) if math.isfinite(value) else (LIMIT_MAX if value > 0 else 1), 1), LIMIT_MAX))


@dataclass(frozen=True)
class Typo:
    """Edits allowed in a term by its length."""

    enabled: bool = False
    max_distance: int = 1
    min_for_one: int = 4
    min_for_two: int = 8
    prefix_exact_length: int = 1

    def __post_init__(self) -> None:
        if self.max_distance not in (1, 2) or isinstance(self.max_distance, bool):
            raise IncompatibleOptionError("typo.max_distance", "1 or 2")
        for name in ("min_for_one", "min_for_two", "prefix_exact_length"):
            v = getattr(self, name)
            if isinstance(v, bool) or not isinstance(v, int) or v < 0:
                raise IncompatibleOptionError(f"typo.{name}", "an integer of 0 or more")
        if self.min_for_two < self.min_for_one:
            raise IncompatibleOptionError("typo.min_for_two", "not below min_for_one")

    def allowed(self, length: int) -> int:
        if not self.enabled or length < self.min_for_one:
            return 0
        return min(1, self.max_distance) if length < self.min_for_two else self.max_distance


@dataclass(frozen=True)
class TokenMatch:
    operator: str = "and"
    min_match_count: int | None = None

    def __post_init__(self) -> None:
        if self.operator not in ("and", "or"):
            raise IncompatibleOptionError("token.operator", "'and' or 'or'")
        m = self.min_match_count
        if m is not None and (isinstance(m, bool) or not isinstance(m, int) or m < 1):
            raise IncompatibleOptionError("token.min_match_count", "an integer of 1 or more")

    def required(self, terms: int) -> int:
        return self.min_match_count or (1 if self.operator == "or" else terms)


@dataclass(frozen=True)
class PrefixMatch:
    prefix_length: int | None = None
    exact_case: bool | None = None

    def __post_init__(self) -> None:
        p = self.prefix_length
        if p is not None and (isinstance(p, bool) or not isinstance(p, int) or p < 1):
            raise IncompatibleOptionError("prefix.prefix_length", "an integer of 1 or more")

    def head(self, query: str) -> str:
        if self.prefix_length is not None and query and self.prefix_length > len(query):
            raise ValueError(f"prefix_length {self.prefix_length} is over the query's length {len(query)}")
        return query[: self.prefix_length] if self.prefix_length else query


@dataclass(frozen=True)
class Budget:
    max_execution_time_ms: float | None = None
    max_candidates: int | None = None


@dataclass(frozen=True)
class Autocomplete:
    limit: int = 5
    mode: str = "prefix"
    fuzzy_distance: int = 0
    field: str | None = None
    tie_breakers: tuple[str, ...] = TIE_BREAKERS

    def __post_init__(self) -> None:
        object.__setattr__(self, "limit", limit_of(self.limit, 5))
        if self.mode not in ("prefix", "fuzzy"):
            raise IncompatibleOptionError("autocomplete.mode", "'prefix' or 'fuzzy'")
        if isinstance(self.fuzzy_distance, bool) or self.fuzzy_distance not in (0, 1, 2):
            raise ValueError("autocomplete.fuzzy_distance is 0, 1 or 2")
        object.__setattr__(self, "tie_breakers", tie_breakers_of(self.tie_breakers))

    @property
    def typo(self) -> Typo:
        return Typo(enabled=True, max_distance=self.fuzzy_distance) if self.fuzzy_distance else Typo()


@dataclass(frozen=True)
class TermsFacet:
    name: str
    field: str
    limit: int = TERMS_LIMIT
    sort_by: str = "count"


@dataclass(frozen=True)
class Range:
    start: float | None = None
    end: float | None = None
    key: str | None = None


@dataclass(frozen=True)
class RangeFacet:
    name: str
    field: str
    ranges: tuple[Range, ...] = ()


@dataclass(frozen=True)
class SearchOptions:
    """All that a search may be asked for; see DocumentIndex.search."""

    mode: str = "fuzzy"
    limit: int = LIMIT
    case_sensitive: bool | None = None
    fields: Sequence[str] | None = None
    filter: Any = None
    facets: Any = None
    facet_mode: str = "auto"
    typo: Typo = field(default_factory=Typo)
    token: TokenMatch = field(default_factory=TokenMatch)
    prefix: PrefixMatch = field(default_factory=PrefixMatch)
    tie_breakers: Sequence[str] = TIE_BREAKERS
    highlight: bool = True
    highlight_fields: str | Sequence[str] = "all-matched"
    tag: str | None = None
    escape_html: bool = False
    hooks: Mapping[str, Callable] | None = None
    autocomplete: Autocomplete | bool | None = None
    budget: Budget = field(default_factory=Budget)
    diagnostics: bool = False
    scorer: str = "exact"
    long_query: str = "error"

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise IncompatibleOptionError("mode", f"one of {MODES}")
        if self.scorer != "exact":
            raise IncompatibleOptionError("scorer", "only 'exact' scores are reproducible here")
        if self.long_query not in ("error", "scan"):
            raise IncompatibleOptionError("long_query", "error or scan")
        if self.facet_mode not in ("auto", "approximate", "force-exact"):
            raise IncompatibleOptionError("facet_mode", "auto, approximate or force-exact; counts are exact in all")
        if isinstance(self.highlight_fields, str) and self.highlight_fields not in ("all-matched", "matched-field", "all-fields"):
            raise TypeError("highlight_fields is all-matched, matched-field, all-fields or a list of field names")
        object.__setattr__(self, "limit", limit_of(self.limit))
        object.__setattr__(self, "tie_breakers", tie_breakers_of(self.tie_breakers))
        object.__setattr__(self, "hooks", hooks_of(self.hooks))
        if self.autocomplete is True:
            object.__setattr__(self, "autocomplete", Autocomplete())

    def check_case(self, case_sensitive: bool) -> None:
        if self.case_sensitive is not None and self.case_sensitive != case_sensitive:
            raise ProfileMismatchError(case_sensitive, self.case_sensitive)
        if self.prefix.exact_case is not None and self.prefix.exact_case != case_sensitive:
            raise ProfileMismatchError(case_sensitive, self.prefix.exact_case, "prefix.exact_case")


def tie_breakers_of(value: Sequence[str] | None) -> tuple[str, ...]:
    """A non-empty choice of TIE_BREAKERS without repeats; the document's place is always last."""
    if value is None:
        return TIE_BREAKERS
    out = tuple(value)
    if not out or len(set(out)) != len(out) or not set(out) <= set(TIE_BREAKERS):
        raise IncompatibleOptionError("tie_breakers", f"a non-empty choice of {TIE_BREAKERS} without repeats")
    return out


def hooks_of(value: Mapping[str, Callable] | None) -> dict[str, Callable]:
    out = dict(value or {})
    for name, fn in out.items():
        if name not in HOOKS:
            raise TypeError(f"unknown hook {name!r}")
        if fn is not None and not callable(fn):
            raise TypeError(f"the hook {name!r} is not callable")
    return {k: f for k, f in out.items() if f is not None}


def merged_hooks(index: Mapping[str, Callable], query: Mapping[str, Callable]) -> dict[str, Callable]:
    """A query's hooks win, name by name."""
    return {**index, **query}


def facets_of(value: Any) -> list[TermsFacet | RangeFacet]:
    """From {name: spec} or [spec, ...] (named by field; of equal names the last stays, at its place)."""
    if value is None:
        return []
    pairs = list(value.items()) if isinstance(value, Mapping) else [(s.get("name", s.get("field")), s) for s in value]
    named: dict[str, Any] = {}
    for name, spec in pairs:
        named.pop(name, None)
        named[name] = spec
    if len(named) > FACETS_MAX:
        raise IncompatibleOptionError("facets", f"at most {FACETS_MAX}")
    out: list[TermsFacet | RangeFacet] = []
    for name, spec in named.items():
        if not isinstance(name, str) or not name:
            raise IncompatibleOptionError("facets", "a facet needs a name")
        target, kind = spec.get("field", name), spec.get("type", "terms")
        if kind == "terms":
            sort = spec.get("sort_by", "count")
            if sort not in ("count", "value"):
                raise IncompatibleOptionError(f"facets.{name}.sort_by", "count or value")
            out.append(TermsFacet(name, target, limit_of(spec.get("limit", TERMS_LIMIT), TERMS_LIMIT), sort))
        elif kind == "range":
            ranges = spec.get("ranges") or ()
            if not ranges or len(ranges) > RANGES_MAX:
                raise IncompatibleOptionError(f"facets.{name}.ranges", f"1 to {RANGES_MAX} ranges")
            made = tuple(Range(r.get("from"), r.get("to"), r.get("key")) for r in ranges)
            for r in made:
                if any(isinstance(x, bool) or x is not None and (not isinstance(x, int | float) or not math.isfinite(x)) for x in (r.start, r.end)):
                    raise IncompatibleOptionError(f"facets.{name}.ranges", "bounds are finite numbers")
                if r.start is not None and r.end is not None and r.start >= r.end:
                    raise IncompatibleOptionError(f"facets.{name}.ranges", "from is below to")
            out.append(RangeFacet(name, target, made))
        else:
            raise IncompatibleOptionError(f"facets.{name}.type", "terms or range")
    return out
