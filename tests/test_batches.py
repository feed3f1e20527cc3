"""What a Python worker holds does not grow with the texts of a batch, and steps lose nothing."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.functions import normalize
from siftwell.functions.normalize import ascii_bytes, ascii_texts, normalize_texts, over_texts, runs
from siftwell.sources import prefixes, segments

TEXTS = st.lists(st.one_of(st.none(), st.text("abé가😀́ ", max_size=12)), max_size=9)


def peak(run):
    """Bytes of Python objects and arrays held at once."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def long_batch(rows):
    rng = random.Random(3)
    words = ["river", "Straße", "ŋame", "garden", "lőw", "thing"]
    texts = pa.array([" ".join(rng.choices(words, k=600)) for _ in range(rows)])
    return pa.RecordBatch.from_arrays([pa.array(["a"] * rows), pa.array(range(rows), pa.int64()), texts], ["file", "id", "text"])


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 20))
def test_runs_are_all_rows(texts, size):
    got = list(runs(pa.array(texts, pa.string()), size))
    assert [i for lo, hi in got for i in range(lo, hi)] == list(range(len(texts)))
    sizes = [len((t or "").encode()) for t in texts]
    assert all(sum(sizes[lo:hi]) <= size or hi == lo + 1 for lo, hi in got)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 9), st.integers(1, 5), st.booleans())
def test_steps_lose_nothing(texts, size, chars, cut):
    column = pa.array(["skipped", *texts], pa.string()).slice(1) if cut else pa.array(texts, pa.string())
    before = segments.STEP_BYTES, segments.STEP_CHARS, normalize.STEP_BYTES
    segments.STEP_BYTES, segments.STEP_CHARS, normalize.STEP_BYTES = size, chars, size
    try:
        bits = {b for codes in segments._codes(column) for b in segments._positions(codes).tolist()}
        forms = over_texts(column, normalize_texts, pa.string()).to_pylist()
    finally:
        segments.STEP_BYTES, segments.STEP_CHARS, normalize.STEP_BYTES = before
    whole = [segments._positions(np.array([ord(c) for c in t or ""], np.uint32)).tolist() for t in texts]
    assert bits == {b for each in whole for b in each}
    assert forms == [None if t is None else normalize.normalize_text(t) for t in texts]


@pytest.mark.parametrize("rows", [500, 3000])
def test_trigrams_of_a_large_batch(rows):
    batch = long_batch(rows).select(["file", "text"])
    assert peak(lambda: list(segments._bitmaps(1)(iter([batch])))) < 64 << 20


@pytest.mark.parametrize("rows", [500, 3000])
def test_normalized_texts_of_a_large_batch(rows):
    texts = long_batch(rows).column(2)
    assert peak(lambda: over_texts(texts, normalize_texts, pa.string())) < 32 << 20


def test_trigrams_of_one_long_text():
    text = "".join(long_batch(2000).column(2).to_pylist())
    batch = pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array([text])], ["file", "text"])
    assert peak(lambda: list(segments._bitmaps(1)(iter([batch])))) < 10 * len(text)


def test_lists_of_prefixes_do_not_depend_on_steps(monkeypatch):
    schema = pa.schema([("prefix", pa.string()), ("field", pa.int32()), ("file", pa.string()), ("id", pa.int64()), ("score", pa.int64()), ("exact_match", pa.bool_()), ("matched_length", pa.int64())])
    monkeypatch.setattr(prefixes, "KEPT", 5)

    def first(step):
        monkeypatch.setattr(prefixes, "STEP_CHARS", step)
        out: dict[str, list] = {}
        for b in prefixes._lists([1.5], schema)(iter([long_batch(60)])):
            for r in b.to_pylist():
                out.setdefault(r["prefix"], []).append((-r["score"], not r["exact_match"], r["matched_length"], r["id"]))
        return {p: sorted(rows)[:5] for p, rows in out.items()}

    assert first(1 << 21) == first(9000) == first(1)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aÅé́̈̀ͅﬃ가\u1100\u1161\u11a8\ufdfa你\0 Σ½", max_size=14), max_size=5), st.integers(1, 6))
def test_the_ascii_form_in_steps(texts, chars):
    before = normalize.STEP_CHARS
    normalize.STEP_CHARS = chars
    try:
        assert ascii_texts(texts) == [ascii_bytes(t).decode() for t in texts]
    finally:
        normalize.STEP_CHARS = before


@pytest.mark.parametrize("rows", [500, 3000])
def test_the_ascii_form_of_a_large_batch(rows):
    texts = long_batch(rows).column(2)
    assert peak(lambda: over_texts(texts, ascii_texts, pa.string())) < 32 << 20


def test_the_ascii_form_of_one_long_text():
    text = "".join(long_batch(2000).column(2).to_pylist())
    assert peak(lambda: ascii_texts([text])) < 8 * len(text)
