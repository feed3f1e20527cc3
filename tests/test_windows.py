"""Windows of many texts in step against those of one text."""

from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.functions import windows
from siftwell.functions.match import place, query_of, token_starts
from siftwell.functions.normalize import ascii_bytes, ascii_text, ascii_texts, normalize_text, normalize_texts, normalized
from siftwell.functions.tokenizers import split_column, split_terms
from siftwell.functions.typo import best_window, osa, osa_distance
from siftwell.plans.options import PrefixMatch, TokenMatch, Typo

TEXT = st.text("abcé -_", max_size=14)


@settings(max_examples=600, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6), st.text("abcé ", min_size=1, max_size=7), st.integers(1, 2), st.integers(0, 4), st.booleans())
def test_windows_are_those_of_each_text(texts, term, allowed, head, tokens):
    all_ = windows.Texts.of(texts)
    places = all_.heads() if tokens else None
    start, size, far = windows.best(all_, term, allowed, head, places)
    for i, t in enumerate(texts):
        want = best_window(t, term, allowed, head, token_starts(t) if tokens else None)
        assert (None if start[i] < 0 else (start[i], size[i], far[i])) == (None if want is None else (want.start, want.length, want.distance)), (t, term)


@settings(max_examples=600, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5), st.text("abcé _", min_size=1, max_size=9), st.sampled_from(["substring", "token", "prefix"]), st.integers(1, 2), st.integers(0, 3), st.booleans(), st.one_of(st.none(), st.integers(1, 4)), st.integers(1, 60), st.integers(1, 9))
def test_scores_are_those_of_each_text(texts, asked, mode, distance, head, any_, cut, chars, places):
    typo = Typo(True, max_distance=distance, min_for_one=2, min_for_two=4, prefix_exact_length=head)
    q = query_of(mode, asked, typo, TokenMatch("or" if any_ else "and"), PrefixMatch(cut if cut is not None and cut <= len(asked) else None))
    before = windows.STEP_CHARS, windows.STEP_PLACES
    windows.STEP_CHARS, windows.STEP_PLACES = chars, places
    try:
        found, score, start, size = windows.scores(texts, q)
    finally:
        windows.STEP_CHARS, windows.STEP_PLACES = before
    for i, t in enumerate(texts):
        want = place(t, q)
        if want is None or not want[1]:
            assert not found[i], (t, asked)
        else:
            first = min(a for a, _ in want[1])
            assert found[i] and (score[i], start[i], size[i]) == (want[0], first, max(a + b for a, b in want[1]) - first), (t, asked)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6), st.text("abcé", max_size=8))
def test_distances_of_whole_texts(texts, term):
    assert windows.distances(texts, term).tolist() == [osa_distance(t, term) for t in texts]


def test_long_terms_and_texts():
    rng = np.random.default_rng(2)
    term = "".join(rng.choice(list("abcdef"), 64))
    text = "".join(rng.choice(list("abcdef"), 50_000)) + term[:20] + "x" + term[20:40] + term[41] + term[40] + term[42:] + "b" * 1000
    start, size, far = windows.best(windows.Texts.of(["", text, term]), term, 2, 1)
    want = best_window(text[49_990:], term, 2, 1)
    assert (start[1], size[1], far[1]) == (want.start + 49_990, want.length, want.distance) == (50_000, 65, 2)
    assert start.tolist()[::2] == [-1, 0]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("aÅß́İ\u0000Ɤ\U00010d50  ﬃ가Σς", max_size=12), max_size=6), st.booleans())
def test_a_batch_is_normalized_as_each_text(texts, folded):
    assert normalize_texts(texts, folded) == [normalize_text(t, folded) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aÅé́ﬃ你\u0000 Σ½", max_size=10), max_size=5))
def test_a_batch_in_ascii_is_that_of_each_text(texts):
    assert ascii_texts(texts) == [ascii_bytes(t).decode() for t in texts]


def test_terms_of_a_column(spark):
    texts = ["a-b  c", "", "--", "one_two.three\n4", "é'ü/ß", "~tilde^caret|bar", "x y", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(split_column(F.col("t"))).collect()] == [None if t is None else split_terms(t) for t in texts]


def test_columns_with_nulls(spark):
    texts = ["ŋÉ", None, "", "a", "你́", None, "ﬃ x", "plain", " Ω　"] * 3
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = df.select(normalized(F.col("t")), ascii_text(F.col("t")), osa(F.col("t"), "ab", 2)).collect()
    assert [tuple(r) for r in got] == [(None, None, None) if t is None else (normalize_text(t), ascii_bytes(t).decode(), min(3, osa_distance(t, "ab"))) for t in texts]
