"""Scores of the four match modes over a normalized text column.

Each builder gives a Column: struct<score int, start int, length int>, null where the text does not match. Exact modes are built-in
expressions and a cheap native predicate precedes them (matches()); typo-tolerant ones run in an Arrow UDF behind a native test for the head that a match must hold.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions import windows
from siftwell.functions.tokenizers import DELIMITERS, split_terms
from siftwell.functions.typo import PENALTY, best_window
from siftwell.plans.options import PrefixMatch, TokenMatch, Typo

#: After these a fuzzy match earns the word bonus.
WORD_STARTS = "/_-. :\\"
_D = r"[\t\n\r \p{Punct}]"


@dataclass(frozen=True)
class Query:
    """A normalized query and how it is matched. terms: of token mode."""

    mode: str
    text: str
    terms: tuple[str, ...] = ()
    typo: Typo = Typo()
    token: TokenMatch = TokenMatch()
    prefix: PrefixMatch = PrefixMatch()

    @property
    def native(self) -> bool:
        """Can built-in expressions alone score it (no edits are allowed anywhere)?"""
        if self.mode == "fuzzy":
            return True
        parts = self.terms if self.mode == "token" else (self.prefix.head(self.text) if self.mode == "prefix" else self.text,)
        return not any(self.typo.allowed(len(p)) for p in parts)


def query_of(mode: str, text: str, typo: Typo = Typo(), token: TokenMatch = TokenMatch(), prefix: PrefixMatch = PrefixMatch(), terms: list[str] | None = None) -> Query:
    return Query(mode, text, tuple(split_terms(text) if terms is None else terms) if mode == "token" else (), typo, token, prefix)


def quoted(text: str) -> str:
    """text as a Java pattern, character by character."""
    return "".join(c if c.isalnum() and c.isascii() else f"\\x{{{ord(c):x}}}" for c in text)


def _hit(score: Column, start: Column, length: Column) -> Column:
    return F.struct(score.cast("int").alias("score"), start.cast("int").alias("start"), length.cast("int").alias("length"))


def _none() -> Column:
    return F.lit(None).cast("struct<score:int,start:int,length:int>")


def _at(norm: Column, part: str) -> Column:
    """Place of the first occurrence from 0, -1 without."""
    return F.instr(norm, F.lit(part)) - 1


def substring_hit(norm: Column, q: str) -> Column:
    at, n = _at(norm, q), len(q)
    return F.when(at >= 0, _hit(1000 - 10 * at - (F.length(norm) - n), at, F.lit(n)))


def fuzzy_hit(norm: Column, q: str) -> Column:
    """Leftmost subsequence: each character is found behind the one before; the score is then read off the places alone."""
    chars = F.array(*(F.lit(c) for c in q))

    def further(places: Column, c: Column) -> Column:
        return F.concat(places, F.array(F.call_function("locate", c, norm, F.element_at(places, -1) + 2) - 1))

    def scored(places: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            at, before = F.get(places, i), F.get(places, i - 1)
            run = F.when((i > 1) & (at == before + 1), a["run"] + 1).otherwise(0)
            word = F.when(at > 0, F.when(F.contains(F.lit(WORD_STARTS), F.substr(norm, at, F.lit(1))), 30).otherwise(0)).otherwise(F.when(i == 1, 40).otherwise(0))
            return F.struct(run.alias("run"), (a["sum"] + 15 + 10 * run + word).alias("sum"))

        total = F.aggregate(F.sequence(F.lit(1), F.lit(len(q))), F.struct(F.lit(0).alias("run"), F.lit(100).alias("sum")), step, lambda a: a["sum"])
        first, last = F.get(places, F.lit(1)), F.element_at(places, -1)
        return _hit(total - 2 * (last - first + 1 - len(q)) - (F.length(norm) - len(q)), first, last - first + 1)

    return F.aggregate(chars, F.array(F.lit(-1)), further, scored)


def _fuzzy_pattern(q: str) -> str:
    """Each step takes what is not the character, possessively: one pass over a text, match or not."""
    return "(?s)\\A" + "".join(f"[^{quoted(c)}]*+{quoted(c)}" for c in q)


def token_hit(norm: Column, terms: tuple[str, ...], token: TokenMatch) -> Column:
    places = [(_at(norm, t), len(t)) for t in terms]
    n = sum((F.when(at >= 0, 1).otherwise(0) for at, _ in places), F.lit(0))
    base = sum((F.when(at >= 0, 1000 - 10 * at).otherwise(0) for at, _ in places), F.lit(0))
    lens = sum((F.when(at >= 0, size).otherwise(0) for at, size in places), F.lit(0))
    first = _least([F.when(at >= 0, at) for at, _ in places])
    last = _greatest([F.when(at >= 0, at + size) for at, size in places])
    score = base - (F.length(norm) - lens) - 2 * F.greatest(F.lit(0), last - first - lens)
    return F.when(n >= token.required(len(terms)), _hit(score, first, last - first))


def _least(cols: list[Column]) -> Column:
    return F.least(*cols) if len(cols) > 1 else cols[0]


def _greatest(cols: list[Column]) -> Column:
    return F.greatest(*cols) if len(cols) > 1 else cols[0]


def _prefix_pattern(head: str) -> str:
    return f"(?s)^(.*?)(?:^|(?<={_D}))(?!{_D}){quoted(head)}"


def prefix_hit(norm: Column, q: str, prefix: PrefixMatch) -> Column:
    head = prefix.head(q)
    at = F.length(F.regexp_extract(norm, _prefix_pattern(head), 1))
    score = 1000 - 10 * at - (F.length(norm) - len(head)) + F.when(at == 0, 40).otherwise(0)
    return F.when(norm.rlike(_prefix_pattern(head)), _hit(score, at, F.lit(len(head))))


def token_starts(text: str) -> list[int]:
    return [i for i, c in enumerate(text) if c not in DELIMITERS and (i == 0 or text[i - 1] in DELIMITERS)]


def place(text: str, q: Query) -> tuple[int, list[tuple[int, int]]] | None:
    """Score of one normalized text and the windows (start, length) of its match; None without a match. The plain form of every mode."""
    n = len(text)
    if not n or not q.text:
        return None
    if q.mode == "fuzzy":
        at, run, score, out = -1, 0, 100, []
        for c in q.text:
            new = text.find(c, at + 1)
            if new < 0:
                return None
            run = run + 1 if out and new == at + 1 else 0
            score += 15 + 10 * run + (30 if new and text[new - 1] in WORD_STARTS else 0) + (40 if not out and new == 0 else 0)
            out.append((new, 1))
            at = new
        return score - 2 * (at - out[0][0] + 1 - len(out)) - (n - len(out)), out
    if q.mode == "token":
        if not q.terms:
            return None
        found = [(t, best_window(text, t, q.typo.allowed(len(t)), q.typo.prefix_exact_length) if q.typo.allowed(len(t)) else _exact(text, t)) for t in q.terms]
        got = [(t, w) for t, w in found if w is not None]
        if len(got) < q.token.required(len(q.terms)):
            return None
        lens = sum(len(t) for t, _ in got)
        span = max(w.start + w.length for _, w in got) - min(w.start for _, w in got) if got else 0
        score = sum(1000 - 10 * w.start - PENALTY * w.distance for _, w in got) - (n - lens) - 2 * max(0, span - lens)
        return score, [(w.start, w.length) for _, w in got]
    if q.mode == "prefix":
        head, starts = q.prefix.head(q.text), token_starts(text)
        d = q.typo.allowed(len(head))
        w = best_window(text, head, d, q.typo.prefix_exact_length if d else len(head), starts)
        if w is None:
            return None
        return 1000 - 10 * w.start - (n - len(head)) + (40 if w.start == 0 else 0) - PENALTY * w.distance, [(w.start, w.length)]
    d = q.typo.allowed(len(q.text))
    w = best_window(text, q.text, d, q.typo.prefix_exact_length) if d else _exact(text, q.text)
    return None if w is None else (1000 - 10 * w.start - (n - len(q.text)) - PENALTY * w.distance, [(w.start, w.length)])


def _exact(text: str, term: str):
    from siftwell.functions.typo import Window

    at = text.find(term)
    return Window(at, len(term), 0) if at >= 0 else None


def _typo_hit(norm: Column, q: Query) -> Column:
    """A new UDF for each query: it carries the query itself. All rows of a batch are matched in step; terms beyond the automaton's words, one by one."""
    terms = q.terms if q.mode == "token" else (q.prefix.head(q.text) if q.mode == "prefix" else q.text,)
    short = all(len(t) <= windows.WORD for t in terms)

    @F.pandas_udf("score int, start int, length int")
    def run(texts: pd.Series) -> pd.DataFrame:
        some = texts[texts.notna()]
        out = pd.DataFrame({c: pd.array([None] * len(texts), "Int32") for c in ("score", "start", "length")})
        if short:
            found, *cols = windows.scores(some.tolist(), q)
            at = np.flatnonzero(texts.notna())[found]
            for name, col in zip(out.columns, cols, strict=True):
                out.loc[at, name] = col[found]
        else:
            for i, r in ((i, place(t, q)) for i, t in zip(np.flatnonzero(texts.notna()), some, strict=True)):
                if r:
                    first = min(a for a, _ in r[1])
                    out.loc[i] = [r[0], first, max(a + b for a, b in r[1]) - first]
        return out

    hit = run(F.when(matches(norm, q), norm))
    return F.when(hit["score"].isNotNull(), hit)


def matches(norm: Column, q: Query) -> Column:
    """A native predicate that holds for every match (and, without edits, for nothing else); a null text never matches."""
    if not q.text or q.mode == "token" and not q.terms:
        return F.lit(False)
    if q.mode == "fuzzy":
        out = (F.length(norm) >= len(q.text)) & norm.rlike(_fuzzy_pattern(q.text))
    elif q.mode == "substring":
        out = _may_hold(norm, q, q.text)
    elif q.mode == "prefix":
        head = q.prefix.head(q.text)
        out = norm.rlike(_prefix_pattern(exact_head(q, head)))
        if q.typo.allowed(len(head)):
            out = out & _may_hold(norm, q, head)
    else:
        n = sum((F.when(_may_hold(norm, q, t), 1).otherwise(0) for t in q.terms), F.lit(0))
        out = n >= q.token.required(len(q.terms))
    return F.coalesce(out, F.lit(False)) & (F.length(norm) > 0)


def _may_hold(norm: Column, q: Query, term: str) -> Column:
    """Native test that every text with a match of the term passes: it holds the exact head and one of its pieces as it is."""
    head = F.contains(norm, F.lit(exact_head(q, term)))
    some = pieces(q, term)
    return head & reduce(lambda a, b: a | b, (F.contains(norm, F.lit(p)) for p in some)) if some else head


def exact_head(q: Query, term: str) -> str:
    """What of a term every match holds as it is."""
    return term[: q.typo.prefix_exact_length] if q.typo.allowed(len(term)) else term


def pieces(q: Query, term: str) -> list[str]:
    """Where d edits are allowed, 2 d + 1 pieces of the term of which every match holds one as it is: an edit changes one piece, or two if it swaps characters
    across a cut. None if the term is to be held whole or is too short."""
    d = q.typo.allowed(len(term))
    n = 2 * d + 1
    if not d or len(term) < n:
        return []
    cuts = [k * len(term) // n for k in range(n + 1)]
    return [term[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def hit(norm: Column, q: Query) -> Column:
    """struct<score, start, length> of a match, else null."""
    if not q.text or q.mode == "token" and not q.terms:
        return _none()
    if not q.native:
        return _typo_hit(norm, q)
    if q.mode == "fuzzy":
        return F.when(matches(norm, q), fuzzy_hit(norm, q.text))
    if q.mode == "substring":
        return substring_hit(norm, q.text)
    if q.mode == "prefix":
        return prefix_hit(norm, q.text, q.prefix)
    return token_hit(norm, q.terms, q.token)


def most(length: Column, q: Query) -> Column:
    """What no score of a text of that length (or a longer one) can be above."""
    n = len(q.text)
    if q.mode == "fuzzy":  # every character in one run, each behind a sign, the first at the start
        top, own = 100 + 15 * n + 5 * n * (n - 1) + 30 * n + 10, n
    elif q.mode == "token":
        top, own = 1000 * len(q.terms), sum(map(len, q.terms))
    elif q.mode == "prefix":
        top, own = 1040, len(q.prefix.head(q.text))
    else:
        top, own = 1000, n
    return F.lit(top + own) - length


def weighted(score: Column, weight: float) -> Column:
    """Half up, also below zero."""
    return F.floor(score * F.lit(float(weight)) + 0.5).cast("int")


