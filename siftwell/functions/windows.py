"""Typo windows of many texts at once: the same windows as typo.best_window, found by a bit-parallel automaton in step over all of them.

Texts of a batch lie end to end as code points. Every place where a window may begin is one automaton of optimal string alignment; its column of distances is two words of
vertical differences (Hyyrö's bit vectors, with neighbour swaps), kept as arrays over all places, and each step feeds every automaton its next
character. Places are those that hold the exact head and, where the term is long enough, one of its pieces as it is near where it belongs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

from siftwell.functions.tokenizers import DELIMITERS
from siftwell.functions.typo import PENALTY

#: Characters of texts handled at a time, and places.
STEP_CHARS, STEP_PLACES = 1 << 21, 1 << 17
#: Characters of a term that fit the words of an automaton.
WORD = 64
_FAR = 1 << 30


@dataclass
class Texts:
    """Texts as code points end to end, where each begins and ends, and of each place its text."""

    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, texts: Sequence[str]) -> Texts:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        # lone surrogates cannot come from UTF-8
        return cls(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), ends - sizes, ends)

    def row(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, "right")

    def heads(self) -> np.ndarray:
        """Places where a token begins: no delimiter, behind one or first in its text."""
        cut = np.isin(self.codes, _codes(DELIMITERS))
        before = np.ones(len(cut), bool)
        before[1:] = cut[:-1]
        before[self.starts[self.starts < len(cut)]] = True
        return np.flatnonzero(~cut & before)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32)


def occurrences(codes: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Whether part stands at each place (also across texts: callers test ends)."""
    n = len(codes) - len(part) + 1
    out = np.zeros(len(codes), bool)
    if n > 0:
        out[:n] = codes[:n] == part[0]
        for k in range(1, len(part)):
            out[:n] &= codes[k : n + k] == part[k]
    return out


def exact(texts: Texts, term: str, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: start of the term's first occurrence (from places only, if given) less the text's own, its length, and distance 0; start -1 without one."""
    part = _codes(term)
    there = occurrences(texts.codes, part)
    found = np.flatnonzero(there) if places is None else places[there[places]]
    row = texts.row(found)
    found, row = found[found + len(part) <= texts.ends[row]], row[found + len(part) <= texts.ends[row]]
    return _first(texts, found, row, np.full(len(found), len(part)), np.zeros(len(found), np.int64))


def _first(texts: Texts, found: np.ndarray, row: np.ndarray, length: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The window of each text that comes first by distance, then start."""
    start, size, far = np.full(len(texts.ends), -1, np.int64), np.zeros(len(texts.ends), np.int64), np.zeros(len(texts.ends), np.int64)
    order = np.lexsort((found, distance, row))
    head = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
    start[row[head]], size[row[head]], far[row[head]] = found[head] - texts.starts[row[head]], length[head], distance[head]
    return start, size, far


def best(texts: Texts, term: str, allowed: int, exact_head: int, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and distance of the best window of each text (start -1: none): least distance, then earliest start, then shortest.

    places: where a window may begin (anywhere if None). Terms of more than WORD characters are none of this function's.
    """
    t, n = len(term), len(texts.codes)
    none = _first(texts, *(np.zeros(0, np.int64) for _ in range(4)))
    if not n or not t:
        return none
    codes, own = texts.codes, _codes(term)
    head = min(exact_head, t)
    least = max(1, t - allowed)
    may = occurrences(codes, own[:head]) if head else np.ones(n, bool)
    if t >= 2 * allowed + 1:
        may &= _near_a_piece(codes, own, allowed)
    found = np.flatnonzero(may) if places is None else places[may[places]]
    row = texts.row(found)
    room = texts.ends[row] - found
    some = room >= max(least, head)
    found, row, room = found[some], row[some], np.minimum(room[some], t + allowed)
    if not len(found):
        return none
    sizes, far = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
    for a in range(0, len(found), STEP_PLACES):
        sizes[a : a + STEP_PLACES], far[a : a + STEP_PLACES] = _windows(codes, found[a : a + STEP_PLACES], room[a : a + STEP_PLACES], own, allowed, max(least, head))
    hit = np.flatnonzero(far <= allowed)
    return _first(texts, found[hit], row[hit], sizes[hit], far[hit])


def _near_a_piece(codes: np.ndarray, own: np.ndarray, allowed: int) -> np.ndarray:
    """Places from which one of the 2 d + 1 pieces of the term stands as it is, at most d characters from where it belongs."""
    n, parts = len(codes), 2 * allowed + 1
    cuts = [k * len(own) // parts for k in range(parts + 1)]
    out = np.zeros(n, bool)
    for a, b in zip(cuts, cuts[1:], strict=False):
        there = occurrences(codes, own[a:b])
        for move in range(max(-allowed, -a), allowed + 1):
            k = a + move
            if k < n:
                out[: n - k] |= there[k:]
    return out


def _steps(codes: np.ndarray, at: np.ndarray, own: np.ndarray, steps: int) -> Iterator[np.ndarray]:
    """Distances of the term to what each place's automaton has read, after each of so many characters from there (beyond the last text: of any)."""
    m = len(own)
    one = np.uint64(1)
    last = np.uint64(1 << (m - 1))
    letters, number = np.unique(own, return_inverse=True)
    masks = np.zeros(len(letters) + 1, np.uint64)
    for j, k in enumerate(number.tolist()):
        masks[k] |= np.uint64(1 << j)
    vp, vn = np.full(len(at), (1 << m) - 1, np.uint64), np.zeros(len(at), np.uint64)
    d0, before = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    distance = np.full(len(at), m, np.int64)
    for i in range(steps):
        c = codes[np.minimum(at + i, len(codes) - 1)]
        k = np.minimum(np.searchsorted(letters, c), len(letters) - 1)
        eq = masks[np.where(letters[k] == c, k, len(letters))]
        swap = ((~d0 & eq) << one) & before
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn | swap
        hp, hn = vn | ~(d0 | vp), d0 & vp
        distance = distance + ((hp & last) != 0) - ((hn & last) != 0)
        hp, hn = (hp << one) | one, hn << one
        vp, vn, before = hn | ~(d0 | hp), hp & d0, eq
        yield distance


def _windows(codes: np.ndarray, at: np.ndarray, room: np.ndarray, own: np.ndarray, allowed: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Length and distance of the best window from each place: its automaton reads on for as long as there is room."""
    far, size = np.full(len(at), _FAR, np.int64), np.zeros(len(at), np.int64)
    for i, distance in enumerate(_steps(codes, at, own, len(own) + allowed)):
        if i + 1 >= least:
            better = (i < room) & (distance < far)
            far[better], size[better] = distance[better], i + 1
    return size, far


def distances(texts: Sequence[str], term: str) -> np.ndarray:
    """Distance of each whole text to a term of at most WORD characters."""
    all_ = Texts.of(texts)
    sizes = all_.ends - all_.starts
    out = np.where(sizes == 0, len(term), sizes)
    if term and len(all_.codes):
        for i, distance in enumerate(_steps(all_.codes, all_.starts, _codes(term), int(sizes.max()))):
            out = np.where(sizes == i + 1, distance, out)
    return out


def chunks(texts: Sequence[str]):
    """(lo, hi) of texts in runs of some STEP_CHARS characters."""
    lo = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= STEP_CHARS:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def scores(texts: Sequence[str], q) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:  # noqa: ANN001
    """Whether each text matches a query of a mode other than fuzzy, its score, and start and length of what matched."""
    got = [_scores(Texts.of(texts[a:b]), q) for a, b in chunks(texts)]
    return tuple(np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, bool), *(np.zeros(0, np.int64) for _ in range(3)))


def _scores(texts: Texts, q) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:  # noqa: ANN001
    n = texts.ends - texts.starts

    def window(term: str, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = q.typo.allowed(len(term))
        return best(texts, term, d, q.typo.prefix_exact_length, places) if d else exact(texts, term, places)

    if q.mode == "token":
        count, base, lens = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        first, last = np.full(len(n), _FAR, np.int64), np.full(len(n), -1, np.int64)
        for term in q.terms:
            start, size, far = window(term)
            here = start >= 0
            count += here
            base += np.where(here, 1000 - 10 * start - PENALTY * far, 0)
            lens += np.where(here, len(term), 0)
            first, last = np.where(here, np.minimum(first, start), first), np.where(here, np.maximum(last, start + size), last)
        found = (count >= q.token.required(len(q.terms))) & (count > 0)
        return found, base - (n - lens) - 2 * np.maximum(0, last - first - lens), first, last - first
    if q.mode == "prefix":
        head = q.prefix.head(q.text)
        start, size, far = window(head, texts.heads())
        return start >= 0, 1000 - 10 * start - (n - len(head)) + np.where(start == 0, 40, 0) - PENALTY * far, start, size
    start, size, far = window(q.text)
    return start >= 0, 1000 - 10 * start - (n - len(q.text)) - PENALTY * far, start, size
