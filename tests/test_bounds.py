"""The page from bounds is that of all matches; no score is above its bound."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.functions.match import place, query_of
from siftwell.functions.normalize import COMPOSED, TRIMMED, normalize_text
from siftwell.index import DocumentIndex
from siftwell.operators import rank
from siftwell.operators.filters import FilterField
from siftwell.plans import search as search_plan
from siftwell.plans.options import PrefixMatch, TokenMatch, Typo
from siftwell.plans.schema import SearchField


@settings(max_examples=500, deadline=None)
@given(st.text("ab-_ é", min_size=1, max_size=40), st.text("ab-_ é", min_size=1, max_size=9), st.sampled_from(["fuzzy", "substring", "token", "prefix"]), st.booleans())
def test_no_score_is_above_its_bound(text, asked, mode, typos):
    q = query_of(mode, asked, Typo(True, min_for_one=2) if typos and mode != "fuzzy" else Typo(), TokenMatch("or"), PrefixMatch())
    got = place(text, q)
    n = len(asked)
    top = {"fuzzy": 110 + 45 * n + 5 * n * (n - 1) + n, "substring": 1000 + n, "token": sum(1000 + len(t) for t in q.terms), "prefix": 1040 + n}[mode]
    assert got is None or got[0] <= top - len(text)


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(9)
    words = "thing think thong tin hat ring night thin g t-h-i-n-g a_thing other words of all kinds".split()
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(1, 300 if k % 3 else 4))), rng.choice(words), rng.randint(0, 9)) for k in range(700)] + [(k, "thing", "thing", 1) for k in range(700, 730)]
    docs = spark.createDataFrame(rows, "id bigint, text string, kind string, n bigint")
    return DocumentIndex.create(docs, [SearchField("text", 1.5), SearchField("kind", 0.25)], filter_fields=[FilterField("n", "number")], validate=False)


@pytest.fixture(autouse=True)
def _small_tables_too(monkeypatch):
    monkeypatch.setattr(search_plan, "BOUND_BYTES", 0)
    monkeypatch.setattr(search_plan, "SAMPLE", 0.4)


@pytest.mark.parametrize("limit", [1, 20, 8000])
@pytest.mark.parametrize("asked", [("thing", {}), ("thnig", {"mode": "substring", "typo": Typo(True)}), ("thnig hta", {"mode": "token", "typo": Typo(True, min_for_one=3), "token": TokenMatch("or")}), ("thiing", {"mode": "prefix", "typo": Typo(True)}), ("zq", {}), ("thing", {"filter": {"n": {"lt": 3}}}), ("thing", {"fields": ["kind"]}), ("thing", {"tie_breakers": ("id", "score")})], ids=str)
def test_the_page_is_that_of_all_matches(index, asked, limit):
    text, options = asked
    search = index.plan(text, limit=limit, highlight=False, **options)
    keys = rank.order(tuple(search.options.tie_breakers), search.prepared.schema["id"].dataType)
    want = [(r["rank"], r.id, r.score) for r in rank.top(search.matched, keys, limit).collect()]
    assert sorted((r["rank"], r.id, r.score) for r in search.results.collect()) == sorted(want)


@settings(max_examples=300, deadline=None)
@given(st.text("aAß\u0130\u1100\u1161\u11a8\u03b1\u0313\u0300\u0345e\u0301 \t\u00a0\ufb03", max_size=30))
def test_no_normalized_text_is_shorter(text):
    assert len(normalize_text(text)) >= -(-len(text.strip(TRIMMED)) // COMPOSED)


def test_few_rows_are_scored(index):
    search = index.plan("thing", limit=20, highlight=False, fields=["text"])
    few = search.best_matched
    assert 20 <= few.count() < search.matched.count() / 3
    typos = index.plan("thnig", mode="substring", typo=Typo(True), limit=20, fields=["text"])
    assert typos.best_matched.count() < typos.matched.count() / 2
    assert index.search("thing", limit=20, highlight=False, fields=["text"]).total_matches == search.matched.count()
