"""Errors of the search engine; each keeps what it is about as attributes."""

from __future__ import annotations


class SearchError(Exception):
    """Base of the engine's errors."""


class IncompatibleHookError(SearchError):
    def __init__(self, hook_id: str, reason: str):
        super().__init__(f"hook {hook_id!r} cannot be used: {reason}")
        self.hook_id, self.reason = hook_id, reason


class CostBudgetExceededError(SearchError):
    def __init__(self, budget_type: str, limit: float, actual: float):
        super().__init__(f"the {budget_type} budget of {limit} is exceeded: {actual}")
        self.budget_type, self.limit, self.actual = budget_type, limit, actual


class InvalidFilterError(SearchError):
    def __init__(self, reason: str, field: str | None = None):
        super().__init__(f"invalid filter{f' on {field!r}' if field else ''}: {reason}")
        self.reason, self.field = reason, field


class QueryTooLongError(SearchError, ValueError):
    def __init__(self, limit: int, actual: int, profile_id: str):
        super().__init__(f"a query of {actual} code points is over the limit of {limit} ({profile_id})")
        self.limit, self.actual, self.profile_id = limit, actual, profile_id


class IncompatibleIndexError(SearchError):
    def __init__(self, expected: object, actual: object):
        super().__init__(f"the index does not fit: expected {expected}, got {actual}")
        self.expected, self.actual = expected, actual


class ProfileMismatchError(SearchError):
    def __init__(self, expected: object, actual: object, prop: str = "case_sensitive"):
        super().__init__(f"{prop} is {actual} but the index has {expected}")
        self.expected, self.actual, self.property = expected, actual, prop


class IncompatibleOptionError(SearchError):
    def __init__(self, option: str, reason: str):
        super().__init__(f"option {option}: {reason}")
        self.option, self.reason = option, reason


class DuplicateIdError(SearchError):
    def __init__(self, doc_id: object):
        super().__init__(f"the document id {doc_id!r} occurs twice")
        self.id = doc_id


class DocumentNotFoundError(SearchError):
    def __init__(self, doc_id: object):
        super().__init__(f"no document has the id {doc_id!r}")
        self.id = doc_id


class ConflictError(SearchError):
    """A batch was made upon a version since which others have touched one of its ids, or have saved the whole."""

    def __init__(self, since: int, now: int, doc_id: object):
        super().__init__(f"a batch made upon version {since} cannot follow version {now}" + ("" if doc_id is None else f": the document {doc_id!r} has changed"))
        self.since, self.now, self.id = since, now, doc_id


class SearchAbortedError(SearchError):
    """A newer search, or the caller, has stopped this one."""
