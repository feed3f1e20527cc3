"""Scores of single texts, and the Spark expressions against the plain form."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.functions import match
from siftwell.functions.normalize import NEWER_FOLDS, normalize_text, normalized
from siftwell.functions.tokenizers import code_tokenizer, split_terms
from siftwell.functions.typo import best_window, osa_distance
from siftwell.plans.options import PrefixMatch, TokenMatch, Typo


def score(text, mode, query, **how):
    found = match.place(normalize_text(text), match.query_of(mode, normalize_text(query), **how))
    return None if found is None else found[0]


@pytest.mark.parametrize(
    ("text", "mode", "query", "want"),
    [
        ("abc", "fuzzy", "abc", 215), ("hello world", "substring", "world", 934), ("hello world program", "token", "hello", 986),
        ("AuthController", "prefix", "Auth", 1030), ("UserAuthManager", "prefix", "Auth", None), ("", "fuzzy", "a", None), ("abc", "fuzzy", "", None),
        ("abc", "substring", "abcd", None), ("a-b", "token", "--", None), (" user auth", "prefix", "auth", 1000 - 50 - 5), ("-auth", "prefix", "auth", 1000 - 10 - 1),
    ],
)
def test_golden_scores(text, mode, query, want):
    assert score(text, mode, query) == want


def test_typos():
    assert osa_distance("ca", "abc") == 3
    assert osa_distance("ab", "ba") == 1
    assert osa_distance("kitten", "sitting", 2) == 3
    assert best_window("the wigdet shop", "widget", 1, 1) is not None
    assert score("widget", "substring", "wigdet", typo=Typo(enabled=True)) == 1000 - 100
    assert score("widget", "substring", "wigdet") is None
    assert score("red widget", "token", "rde widget", typo=Typo(enabled=True, min_for_one=3)) == 1000 + (1000 - 40) - 1 - 2 * 1 - 100
    assert score("abc", "substring", "xbc", typo=Typo(enabled=True, min_for_one=2)) is None  # the first letter is exact


def brute_window(text, term, allowed, head):
    best = None
    for start in range(len(text)):
        for w in range(max(1, len(term) - allowed), len(term) + allowed + 1):
            if start + w > len(text) or w < min(head, len(term)) or text[start : start + min(head, len(term))] != term[:head]:
                continue
            d = osa_distance(text[start : start + w], term)
            if d <= allowed and (best is None or d < best[2]):
                best = (start, w, d)
    return best


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", min_size=1, max_size=6), st.integers(1, 2), st.integers(0, 2))
def test_windows_against_brute_force(text, term, allowed, head):
    got = best_window(text, term, allowed, head)
    assert (None if got is None else (got.start, got.length, got.distance)) == brute_window(text, term, allowed, head)


CASES = [
    match.query_of("fuzzy", "ab"), match.query_of("fuzzy", "a b/"), match.query_of("substring", "a."), match.query_of("token", "ab c-a"), match.query_of("token", "ab zz c", token=TokenMatch("or")),
    match.query_of("token", "a b c", token=TokenMatch(min_match_count=2)), match.query_of("prefix", "ab"), match.query_of("prefix", "abzz", prefix=PrefixMatch(2)), match.query_of("prefix", "-a"), match.query_of("fuzzy", "é😀"),
    match.query_of("substring", "abca", typo=Typo(enabled=True)), match.query_of("token", "abca b", typo=Typo(enabled=True), token=TokenMatch("or")), match.query_of("prefix", "abca", typo=Typo(enabled=True)), match.query_of("substring", "\\E+"),
]


def test_columns_equal_plain_scores(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abc-. /\\Eé😀\t") for _ in range(rng.randrange(0, 18))) for _ in range(400)] + ["", None, "ab", "x\x0bab", "　ab"]
    df = spark.createDataFrame([(i, t if t is None else normalize_text(t)) for i, t in enumerate(texts)], "i int, t string")
    for q in CASES:
        got = {r.i: r.h and r.h.score for r in df.select("i", match.hit(F.col("t"), q).alias("h")).collect()}
        want = {i: (lambda r: None if r is None else r[0])(match.place(normalize_text(t or ""), q)) for i, t in enumerate(texts)}
        assert got == want, q
        if q.native:
            kept = {r.i for r in df.filter(match.matches(F.col("t"), q)).collect()}
            assert kept == {i for i, s in want.items() if s is not None}, q


def test_normalize(spark):
    texts = ["  Straße ", "İstanbul", "ﬃ", "Σίσυφος", "é", "﻿x﻿", "\x1cA\x1c", "A B\t", "", None, "ϴ", "Ᲊ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.n for r in df.select(normalized(F.col("t")).alias("n"), "i").orderBy("i").collect()]
    assert got == [None if t is None else normalize_text(t) for t in texts]
    assert normalize_text("Straße") == "strasse" and normalize_text("ﬃ") == "ffi" and normalize_text("é", False) == "é"
    assert normalize_text("\x1cA") == "\x1ca" and normalize_text("﻿x") == "x"
    assert all(len(v) == 1 for v in NEWER_FOLDS.values())


def test_tokenizers():
    assert split_terms("a.b  c_d") == ["a", "b", "c", "d"]
    assert code_tokenizer("getHTTPResponse auth2Login UserAuth") == ["get", "HTTP", "Response", "auth", "2", "Login", "User", "Auth"]
    assert code_tokenizer("auth2", split_on_digit_boundaries=False) == ["auth2"]
    assert code_tokenizer("a bc", min_token_length=2) == ["bc"]
    with pytest.raises(ValueError):
        code_tokenizer("a", min_token_length=-1)


def test_weights_round_half_up(spark):
    df = spark.createDataFrame([(-5,), (5,), (3,)], "s int")
    assert [r[0] for r in df.select(match.weighted(F.col("s"), 0.5)).collect()] == [-2, 3, 2]


def test_native_normalization_is_the_plain_one(spark):
    """Every character below U+2100, alone, doubled, in capitals' company and behind blanks."""
    chars = [chr(c) for c in range(1, 0x2100) if not 0xD800 <= c < 0xE000]
    rows = [(f"{before}{c}{after}",) for c in chars for before, after in (("", ""), (" A", "B\t"), ("\u00a0", "\u0301"))]
    df = spark.createDataFrame(rows, "t string").repartition(4)
    for folded in (True, False):
        for r in df.select("t", normalized(F.col("t"), folded).alias("n")).collect():
            assert r.n == normalize_text(r.t, folded), ascii(r.t)
