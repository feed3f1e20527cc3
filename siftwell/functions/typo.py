"""Bounded typo tolerance: optimal string alignment distance (neighbour swaps once) of a term to windows of a text.

One table of distances a start covers all window lengths at once, since a window's prefix distances are rows of the same table.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PENALTY = 100


@dataclass(frozen=True)
class Window:
    start: int
    length: int
    distance: int


def osa(text: Column, term: str, bound: int) -> Column:
    """Distance of each text of a column to a term; past the bound, bound + 1. Texts whose length alone is past it stay in the JVM; null stays null."""

    @F.arrow_udf("int")
    def run(texts: pa.Array) -> pa.Array:
        from siftwell.functions import windows
        from siftwell.functions.normalize import over_texts

        def far(some: list[str]) -> list[int]:
            got = windows.distances(some, term) if len(term) <= windows.WORD else [osa_distance(t, term, bound) for t in some]
            return [min(int(d), bound + 1) for d in got]

        return over_texts(texts, far, pa.int32())

    near = F.abs(F.length(text) - len(term)) <= bound
    return F.when(text.isNull(), F.lit(None)).when(near, run(F.when(near, text))).otherwise(F.lit(bound + 1))


def osa_distance(a: str, b: str, bound: int | None = None) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between a and b; past a bound, bound + 1."""
    row = _last_column(a, b)[len(a)]
    return row if bound is None or row <= bound else bound + 1


def _last_column(text: str, term: str, stop: int | None = None) -> list[int]:
    """Distances of term to each prefix of text; rows over stop end the walk (the rest reads stop + 1)."""
    m = len(term)
    older, row = None, list(range(m + 1))
    out = [row[m]]
    for i, c in enumerate(text, 1):
        new = [i]
        for j in range(1, m + 1):
            d = min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (c != term[j - 1]))
            if older is not None and j > 1 and c == term[j - 2] and text[i - 2] == term[j - 1]:
                d = min(d, older[j - 2] + 1)
            new.append(d)
        out.append(new[m])
        if stop is not None and min(new) > stop and min(row) > stop:
            out += [stop + 1] * (len(text) - i)
            break
        older, row = row, new
    return out


def best_window(text: str, term: str, allowed: int, exact_head: int, starts: list[int] | None = None) -> Window | None:
    """The window of least distance, then of earliest start, then shortest; its first exact_head characters are the term's.

    starts: where a window may begin (anywhere if None).
    """
    n, t = len(text), len(term)
    if not n or not t or t > n + allowed and starts is None:
        return None
    head = term[: min(exact_head, t)]
    least, best = max(1, t - allowed), None
    bound = allowed
    at = text.find(head) if starts is None else -1
    places = iter(starts) if starts is not None else None
    while True:
        if places is not None:
            at = next(places, -1)
            if at >= 0 and not text.startswith(head, at):
                continue
        if at < 0 or at > n - least:
            return best
        part = text[at : at + t + allowed]
        column = _last_column(part, term, bound)
        for w in range(max(least, len(head)), len(part) + 1):
            if column[w] <= bound:
                best, bound = Window(at, w, column[w]), column[w] - 1
                if bound < 0:
                    return best
        if places is None:
            at = text.find(head, at + 1)
