"""Indexes end to end: filters, facets, ranking, hooks, highlights, suggestions, changes, snapshots, options."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siftwell import errors as E
from siftwell.functions import jsvalues as J
from siftwell.functions.highlight import align_highlights, guard_cluster_boundary, merge_ranges, render_highlighted
from siftwell.functions.match import query_of
from siftwell.index import DocumentIndex, SearchIndex
from siftwell.operators import filters
from siftwell.operators.filters import FilterField
from siftwell.plans.options import Autocomplete, Budget, SearchOptions, TokenMatch, Typo, limit_of
from siftwell.plans.schema import SearchField
from siftwell.sources import corpus, snapshot

FIELDS = [SearchField("title", 2.0), SearchField("body", 1.0)]
FILTERS = [FilterField("category"), FilterField("price", "number"), FilterField("stock", "boolean"), FilterField("tags", "string[]")]
ROWS = [
    ("1", "Widget One", "a small widget", "tech", 10.0, True, ["new", "hot", "new"]), ("2", "Widget Two", "another", "tech", 55.5, False, ["hot"]), ("3", "Garden Hose", "widget for hoses", "garden", 20.0, True, None),
    ("4", "Home Widget", "lamp", "home", None, None, ["old", None]), ("5", "Widget Five", "fifth", "tech", 1e7, True, []), ("6", "Lamp", "nothing", None, 5.0, False, ["new"]),
]
SCHEMA = "id string, title string, body string, category string, price double, stock boolean, tags array<string>"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def index(docs):
    return DocumentIndex.create(docs, FIELDS, filter_fields=FILTERS)


def ids(index, query="", **how):
    return [r.id for r in index.search(query, highlight=False, **how).results]


@pytest.mark.parametrize(
    ("expr", "want"),
    [
        ({}, "123456"), ({"and": []}, "123456"), ({"or": []}, ""), ({"category": "tech"}, "125"), ({"category": None}, "6"), ({"category": ["tech", None]}, "1256"), ({"category": {"neq": "tech"}}, "346"),
        ({"category": {"nin": ["tech", "home"]}}, "36"), ({"not": {"category": "tech"}}, "346"), ({"price": {"gt": 10, "lte": 55.5}}, "23"), ({"price": "10"}, "1"), ({"price": "x"}, ""), ({"price": {"neq": "x"}}, "123456"),
        ({"price": {"exists": False}}, "4"), ({"stock": True}, "135"), ({"stock": {"neq": "true"}}, "246"), ({"tags": "new"}, "16"), ({"tags": {"in": ["old", "hot"]}}, "124"), ({"tags": {"nin": ["old", "hot"]}}, "356"),
        ({"tags": None}, "35"), ({"tags": {"exists": True}}, "1246"), ({"category": {"gte": "h"}}, "1245"), ({"category": {"lt": "home"}}, "3"), ({"category": "tech", "price": {"lt": 50}}, "1"), ({"category": {"in": []}}, ""),
        ({"or": [{"category": "home"}, {"and": [{"price": {"gte": 1e7}}, {"not": {"stock": False}}]}]}, "45"), ({"not": {"not": {"category": "tech"}}}, "125"), ({"not": {"or": []}}, "123456"), ({"not": {"price": {"gt": 7}}}, "46"),
    ],
)
def test_filters(index, expr, want):
    for filtering in (False, True):
        got = index.prepared.filter(filters.compile_filter(expr, index.schema.filters, filtering=filtering)).select("id").collect()
        assert "".join(sorted(r.id for r in got)) == want


@pytest.mark.parametrize("expr", [{"x": 1}, {"price": {"gt": "x"}}, {"stock": {"gt": 1}}, {"stock": "maybe"}, {"tags": {"lt": "a"}}, {"category": {"like": "a"}}, {"category": {}}, {"and": {}}, [], {"category": {"in": "a"}}])
def test_bad_filters(index, expr):
    with pytest.raises(E.InvalidFilterError):
        index.plan("widget", filter=expr)


def test_ranking(index):
    r = index.search("widget", mode="substring", highlight=False)
    assert r.total_matches == 5
    assert [(x.id, x.score, x.matched_field) for x in r.results][:2] == [("1", 1992, "title"), ("2", 1992, "title")]
    first = r.results[0]
    assert first.matches[0].field == "body" and first.matches[0].score == 1000 - 80 - 8
    assert ids(index, "widget", mode="substring", fields=["body"]) == ["1", "3"] or ids(index, "widget", mode="substring", fields=["body"]) == ["3", "1"]
    assert ids(index, "widget", mode="substring", fields=[]) == []
    assert ids(index, "   ") == []
    assert ids(index, "widget", mode="substring", limit=2) == ["1", "2"]
    assert ids(index, "widget", mode="substring", tie_breakers=("id",), limit=3) == ["1", "2", "3"]


def test_facets(index):
    facets = {"category": {}, "price": {"type": "range", "ranges": [{"to": 20}, {"from": 10, "to": 60}, {"from": 1e9}]}, "tags": {"sort_by": "value"}}
    r = index.search("widget", mode="substring", facets=facets, filter={"category": "tech"}, highlight=False)
    assert [(b.value, b["count"]) for b in r.facets["category"]] == [("tech", 3), ("garden", 1), ("home", 1)]
    assert [(b.key, b["count"]) for b in r.facets["price"]] == [("*-20", 1), ("10-60", 2), ("1000000000-*", 0)]
    assert [(b.value, b["count"]) for b in r.facets["tags"]] == [("hot", 2), ("new", 1)]
    r = index.search("widget", mode="substring", facets=facets, filter={"category": "none"}, highlight=False)
    assert r.facets["category"] == [] and [b["count"] for b in r.facets["price"]] == [0, 0, 0]
    with pytest.raises(ValueError):
        index.plan("a", facets={"title": {}})
    with pytest.raises(E.IncompatibleOptionError):
        index.plan("a", facets={"price": {"type": "range", "ranges": [{"from": 2, "to": 1}]}})


def test_hooks_and_diagnostics(index):
    hooks = {"tokenizer": lambda q: ["widget"], "filter_predicate": lambda df: F.col("doc.price") < 60, "scoring_hook": lambda df: df["score"] + F.when(F.col("id") == "3", 5000).otherwise(0), "post_process": lambda df: df.limit(2)}
    r = index.search("anything", mode="token", hooks=hooks, diagnostics=True, highlight=False)
    assert [x.id for x in sorted(r.results, key=lambda x: x.rank)] == ["3", "1"] and r.total_matches == 3
    assert r.diagnostics["filter_selectivity"] == 1.0
    with pytest.raises(TypeError):
        SearchOptions(hooks={"other": len})
    with pytest.raises(E.IncompatibleHookError):
        index.plan("a", mode="token", hooks={"tokenizer": lambda q: 1 / 0})
    with pytest.raises(E.CostBudgetExceededError):
        index.search("widget", budget=Budget(max_candidates=3))
    assert index.search("widget", budget=Budget(max_execution_time_ms=600_000)).total_matches == 5


def test_options(index):
    assert [limit_of(x) for x in (None, 0, 2.9, "7", "x", float("nan"), 1e9)] == [1, 1, 2, 7, 50, 50, 8192]
    with pytest.raises(E.QueryTooLongError):
        index.plan("x" * 129)
    with pytest.raises(E.ProfileMismatchError):
        index.plan("x", case_sensitive=True)
    with pytest.raises(E.IncompatibleOptionError):
        index.plan("x", scorer="other")
    for bad in ({"tie_breakers": ()}, {"tie_breakers": ("id", "id")}, {"mode": "x"}):
        with pytest.raises(E.IncompatibleOptionError):
            index.plan("x", **bad)
    with pytest.raises(ValueError):
        index.plan("x", fields=["none"])
    with pytest.raises(E.IncompatibleOptionError):
        Typo(max_distance=3)
    with pytest.raises(E.IncompatibleOptionError):
        TokenMatch("xor")


def test_highlights(index, spark):
    q = query_of("substring", "strasse")
    assert align_highlights("  Straße", q) == [(2, 8)]
    assert align_highlights("😀 the é thing", query_of("token", "thing the")) == [(3, 6), (9, 14)]
    assert align_highlights("a1b2", query_of("fuzzy", "ab")) == [(0, 1), (2, 3)]
    assert align_highlights("👩‍💻 x", query_of("substring", "💻")) == [(0, 5)]
    assert align_highlights("abc", query_of("fuzzy", "zz")) == []
    assert merge_ranges([(3, 5), (1, 3), (9, 7), (4, 4)]) == [(1, 5), (7, 9)]
    assert render_highlighted("a<b😀c", [(1, 2), (3, 5)], 'em class="x"', True) == 'a<em class="x">&lt;</em>b<em class="x">😀</em>c'
    with pytest.raises(TypeError):
        render_highlighted("a", [(0, 1)], "<b>")
    assert guard_cluster_boundary("aéb", 2) == 3
    got = index.search("widget", mode="substring", tag="b").results[0]
    assert got.highlighted_text == {"title": "<b>Widget</b> One", "body": "a small <b>widget</b>"}
    assert set(index.search("widget", mode="substring", highlight_fields="matched-field").results[0].highlights) == {"title"}
    assert index.search("lamp", mode="substring", highlight_fields="all-fields").results[0].highlights.keys() == {"title"}


def test_suggestions(index):
    rows = index.autocomplete("wid", limit=3).orderBy("rank").collect()
    assert [(r.text, r.type) for r in rows] == [("Widget One", "completion"), ("Widget Two", "completion"), ("Widget Five", "completion")]
    assert [(x.start, x.end) for x in rows[0].matched_ranges] == [(0, 3)]
    assert index.autocomplete("", limit=3).count() == 0
    rows = index.autocomplete("wigdet", mode="fuzzy", fuzzy_distance=1, field="body").collect()
    assert {r.doc_id for r in rows} == {"1", "3"} and rows[0].type == "did-you-mean"
    r = index.search("widget", mode="substring", autocomplete=Autocomplete(field="body"))
    assert [s.doc_id for s in r.suggestions] == ["3", "1"]
    with pytest.raises(ValueError):
        index.autocomplete("a", field="none")


def test_changes(spark, index, docs):
    new = spark.createDataFrame([("7", "Widget New", "x", "tech", 1.0, True, ["a"])], SCHEMA)
    after = index.add(new)
    assert after.doc_ids().count() == 7 and index.doc_ids().count() == 6
    assert ids(after, "widget new", mode="substring") == ["7"]
    with pytest.raises(E.DuplicateIdError):
        after.add(new)
    with pytest.raises(E.DocumentNotFoundError):
        index.update(new)
    changed = docs.filter("id = '1'").withColumn("title", F.lit("Renamed"))
    after, out = index.apply_batch(add=changed, remove=["2", "none"], upsert=True)
    assert (out.added, out.updated, out.removed, out.compacted) == (0, 1, 1, True)
    assert ids(after, "renamed", mode="prefix") == ["1"] and after.doc_ids().count() == 5
    with pytest.raises(E.DocumentNotFoundError):
        index.apply_batch(update=changed, remove=["1"])
    after, out = index.apply_batch(add=changed, remove=["1"])
    assert (out.added, out.removed) == (1, 1)
    with pytest.raises(E.DuplicateIdError):
        DocumentIndex.create(docs.union(docs), FIELDS)


def test_snapshots(spark, index, docs, tmp_path):
    root = str(tmp_path)
    assert index.save(root, "one") == 1
    back = DocumentIndex.restore(spark, root, "one", index.schema)
    assert ids(back, "widget", mode="substring") == ids(index, "widget", mode="substring")
    assert index.add(spark.createDataFrame([("9", "Ninth", "", None, None, None, None)], SCHEMA)).save(root, "one") == 2
    assert DocumentIndex.restore(spark, root, "one", index.schema).doc_ids().count() == 7
    assert DocumentIndex.restore(spark, root, "one", index.schema, version=1).doc_ids().count() == 6
    with pytest.raises(E.ProfileMismatchError):
        snapshot.load(spark, root, "one", DocumentIndex.create(docs, FIELDS, filter_fields=FILTERS, case_sensitive=True).schema)
    with pytest.raises(E.IncompatibleIndexError):
        snapshot.load(spark, root, "one", DocumentIndex.create(docs, ["title"]).schema)
    index.save(root, "bare", decoupled=True)
    assert DocumentIndex.restore(spark, root, "bare", index.schema, docs=docs).doc_ids().count() == 6
    with pytest.raises(E.IncompatibleIndexError):
        DocumentIndex.restore(spark, root, "bare", index.schema)
    assert snapshot.delete(spark, root, "one") and not snapshot.versions(spark, root, "one")


def test_ingest(spark, index, docs, tmp_path):
    from siftwell.streaming.ingest import ingest

    docs.limit(0).union(spark.createDataFrame([("1", "Streamed", "b", "tech", 1.0, True, None), ("8", "Eighth", "b", "tech", 1.0, True, None)], SCHEMA)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    q = ingest(stream, index, str(tmp_path / "index"), "live", str(tmp_path / "check"))
    q.awaitTermination(120)
    live = DocumentIndex.restore(spark, str(tmp_path / "index"), "live", index.schema)
    assert live.doc_ids().count() == 7 and ids(live, "streamed", mode="prefix") == ["1"]


def test_flat(spark, tmp_path):
    flat = SearchIndex.create(corpus.items(spark, ["src/auth.ts", "lib/Auth", "", "x"]))
    assert [(r.id, r.score) for r in flat.search("auth", mode="substring").results] == [(0, 953), (1, 956)][::-1]
    assert flat.stats()["documents"] == 4
    with pytest.raises(TypeError):
        flat.plan("a", filter={})
    with pytest.raises(TypeError):
        corpus.items(spark, [1])
    case = SearchIndex.create(corpus.items(spark, ["Auth", "auth"]), case_sensitive=True)
    assert [r.id for r in case.search("Auth", mode="prefix").results] == [0]


def test_values(spark):
    assert [J.number_text(x) for x in (50.0, 0.1, 1e21, 1e-7, 123456789012.5, -0.0, 1e7, 0.00001)] == ["50", "0.1", "1e+21", "1e-7", "123456789012.5", "0", "10000000", "0.00001"]
    assert [J.number_of(x) for x in ("", " 5 ", "0x10", "1e3", "Infinity", "abc", True, None, 7)] == [None, 5.0, 16.0, 1000.0, None, None, None, None, 7.0]
    df = spark.createDataFrame([(50.0, "0x10", [1.5, None]), (1e7, " 2 ", []), (0.25, "x", None), (None, None, None), (1e-7, "-Infinity", [2.0])], "d double, s string, a array<double>")
    s = df.schema
    got = df.select(J.text_column(F.col("d"), s["d"].dataType).alias("t"), J.number_column(F.col("s"), s["s"].dataType).alias("n"), J.tags_column(F.col("a"), s["a"].dataType).alias("a"), J.text_column(F.col("a"), s["a"].dataType).alias("at")).collect()
    assert [r.t for r in got] == ["50", "10000000", "0.25", "", "1e-7"]
    assert [r.n for r in got] == [16.0, 2.0, None, None, None]
    assert [r.a for r in got] == [["1.5"], None, None, None, ["2"]] and got[0].at == "1.5"


def test_entry_and_queries(spark, sf):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert entry.entry(spark).count() > 0


def test_imports_without_a_session():
    """The driver reads the queries' names before it has a session; the corpus operators may be missing."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert len(e.queries()) >= 40 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, check=True, timeout=120)


def test_newer_search_aborts_the_older(spark):
    import threading
    import time

    from siftwell.plans.search import Latest

    slow = spark.range(4).select(F.col("id"), F.concat(F.lit("widget "), F.call_function("reflect", F.lit("java.lang.Thread"), F.lit("activeCount"))).alias("title"))

    @F.udf("string")
    def wait(t):
        time.sleep(20)
        return t

    index = DocumentIndex.create(slow.withColumn("title", wait("title")), ["title"], validate=False)
    fast = DocumentIndex.create(slow, ["title"], validate=False)
    latest, failed = Latest(), []
    first, second = (x.plan("widget", mode="substring", highlight=False) for x in (index, fast))

    def old() -> None:
        try:
            latest.run(first)
        except E.SearchAbortedError as e:
            failed.append(e)

    thread = threading.Thread(target=old)
    thread.start()
    for _ in range(300):
        if spark.sparkContext.statusTracker().getActiveJobsIds():
            break
        time.sleep(0.1)
    assert latest.run(second).total_matches == 4
    thread.join(60)
    assert len(failed) == 1
    stopped = fast.plan("widget")
    stopped.abort()
    with pytest.raises(E.SearchAbortedError):
        stopped.collect()
    with pytest.raises(E.CostBudgetExceededError) as late:
        index.search("widget", mode="substring", highlight=False, budget=Budget(max_execution_time_ms=1500))
    assert late.value.budget_type == "time"
