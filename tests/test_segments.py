"""Searches of a stored index open only the files that can match; checksums a file; clustered files."""

from __future__ import annotations

import glob
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.errors import ConflictError, CostBudgetExceededError, IncompatibleIndexError
from siftwell.functions.match import place, query_of
from siftwell.index import DocumentIndex
from siftwell.operators.filters import FilterField, compile_bounds, compile_filter
from siftwell.plans.options import Budget, PrefixMatch, TokenMatch, Typo
from siftwell.plans.schema import SearchField
from siftwell.sources import segments, snapshot

WORDS = "river mountain garden teacher kitchen hospital castle forest dragon pirate rocket planet saffron bicycle umbrella lantern blanket".split()
FILTERS = [FilterField("kind"), FilterField("price", "number"), FilterField("seen", "boolean"), FilterField("tags", "string[]")]


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(5)
    rows = []
    for k in range(1200):
        text = " ".join(rng.choices(WORDS, k=12)) + (f" zyxwv{k // 400}qj Ünïque" if k % 400 == 7 else "")
        rows.append((k, text, "brand " + rng.choice(WORDS), None if k % 50 == 0 else "abcdefgh"[rng.randrange(8)], None if k % 31 == 0 else rng.uniform(0, 1000), rng.random() < 0.5, ["x", "y"][: k % 3]))
    docs = spark.createDataFrame(rows, "id bigint, title string, brand string, kind string, price double, seen boolean, tags array<string>")
    return DocumentIndex.create(docs, [SearchField("title", 2.0), SearchField("brand")], filter_fields=FILTERS, validate=False)


@pytest.fixture(scope="module")
def stored(spark, index, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("segments"))
    index.save(root, "many", files=60)
    index.save(root, "laid", files=60, cluster=["price", "kind"])
    return root


def restored(spark, index, root, name="many"):
    return DocumentIndex.restore(spark, root, name, index.schema)


def files_read(df):
    """Files of records among the inputs of a plan."""
    return len([f for f in df.inputFiles() if "/docs/" in f])


def rows(search):
    return [tuple(r) for r in search.results.select("rank", "id", "score", "matched_field").orderBy("rank").collect()]


QUERIES = [
    ("zyxwv1qj", {"mode": "substring"}, 1), ("zyxwv", {"mode": "substring"}, 3), ("zyxwv0", {"mode": "prefix"}, 1), ("zyxwv2qj river", {"mode": "token"}, 1), ("zyxwv2qj zyxwv1qj", {"mode": "token", "token": TokenMatch("or")}, 2),
    ("zyxwv2qj zy", {"mode": "token"}, 1), ("ünïque", {"mode": "substring"}, 3), ("zyxwv9qj", {"mode": "substring"}, 0), ("zyxvw1qj", {"mode": "substring", "typo": Typo(True)}, 3), ("zyxwv1qj ünïqxe", {"mode": "substring", "typo": Typo(True, max_distance=2)}, 3),
    ("zyxwv1qk", {"mode": "prefix", "typo": Typo(True), "prefix": PrefixMatch()}, 3),
]


@pytest.mark.parametrize(("text", "options", "most"), QUERIES, ids=[f"{q}-{o['mode']}" for q, o, _ in QUERIES])
def test_a_rare_query_opens_few_files(spark, index, stored, text, options, most):
    now = restored(spark, index, stored)
    found = now.plan(text, highlight=False, **options)
    assert rows(found) == rows(index.plan(text, highlight=False, **options))
    assert files_read(found.matched) <= most + 3  # and what has a bit set by chance
    assert found.counts == index.plan(text, **options).counts


@pytest.mark.parametrize(("text", "options"), [("river", {"mode": "substring"}), ("zy", {"mode": "substring"}), ("rvr", {"mode": "fuzzy"}), ("river zz", {"mode": "token", "token": TokenMatch("or")}), ("river zyxwv1qj", {"mode": "token", "token": TokenMatch("or")})])
def test_a_dense_query_reads_the_table(spark, index, stored, text, options):
    found = restored(spark, index, stored).plan(text, highlight=False, **options)
    assert files_read(found.matched) == 60
    assert rows(found) == rows(index.plan(text, highlight=False, **options))


def test_facets_and_whole_searches_over_few_files(spark, index, stored):
    now = restored(spark, index, stored)
    asked = {"mode": "substring", "filter": {"kind": ["a", "b", "c", "d"], "price": {"gte": 100}}, "facets": {"kind": {}, "price": {"type": "range", "ranges": [{"to": 500}, {"from": 500}]}}, "diagnostics": True, "highlight": False}
    for text in ("zyxwv", "river"):
        a, b = now.search(text, **asked), index.search(text, **asked)
        assert (a.results, a.total_matches, a.facets) == (b.results, b.total_matches, b.facets)
        assert a.diagnostics["documents"] == b.diagnostics["documents"] == 1200 and a.diagnostics["filter_selectivity"] == b.diagnostics["filter_selectivity"]
    lazy = now.plan("river", **asked)
    want = index.plan("river", **asked)
    assert {k: df.orderBy("rank").collect() for k, df in lazy.facets.items()} == {k: df.orderBy("rank").collect() for k, df in want.facets.items()}


def test_conditions_that_all_counts_keep_reach_the_scan(spark, index, stored):
    asked = {"filter": {"price": {"lt": 50}, "kind": "a"}, "facets": {"kind": {}}}
    search = restored(spark, index, stored).plan("rvr", **asked)
    assert search.shared_filter == {"price": {"lt": 50}}
    plan = search._hits(search._source(search.shared_filter))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(price), LessThan(price,50.0)" in plan
    assert "_s_0" not in plan  # nothing is scored to be counted


def test_batches_upon_a_stored_index(spark, index, stored):
    now = restored(spark, index, stored)
    new = index.docs.filter("id = 7").drop(index.version.version).withColumn("title", F.lit("nothing rare any more"))
    added = index.docs.filter("id = 8").drop(index.version.version).withColumns({"id": F.lit(5000).cast("long"), "title": F.lit("zyxwv0qj again")})
    after = now.update(new).add(added).remove([407])
    assert {r.id for r in after.plan("zyxwv", mode="substring", highlight=False).results.collect()} == {807, 5000}
    snapshot.append(added, stored, "many", index.schema, removed=spark.createDataFrame([(807,)], "id bigint"))
    again = restored(spark, index, stored)
    found = again.plan("zyxwv", mode="substring", highlight=False)
    assert {r.id for r in found.results.collect()} == {7, 407, 5000} and files_read(found.matched) < 10
    assert DocumentIndex.restore(spark, stored, "many", index.schema, version=1).plan("zyxwv", mode="substring").counts == {"total_matches": 3}


# --- what bounds and bitmaps let through -------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text("abcß é😀", min_size=1, max_size=30), st.text("abcß é😀", min_size=1, max_size=12), st.sampled_from(["substring", "token", "prefix"]), st.integers(0, 2))
def test_a_text_that_matches_has_the_bits(text, asked, mode, typos):
    q = query_of(mode, asked, Typo(True, max_distance=typos, min_for_one=2, min_for_two=5) if typos else Typo())
    held = set(segments.grams_of(text)) if len(text) < 15 else set(segments._positions(segments.np.frombuffer(text.encode("utf-32-le"), segments.np.uint32)).tolist())

    class Bit:
        """A Column's part in the formula, as a value."""

        def __init__(self, x):
            self.x = x

        def __and__(self, o):
            return Bit(self.x and o.x)

        def __or__(self, o):
            return Bit(self.x or o.x)

    if mode == "token" or typos and len(asked) > 4 * typos + 2:
        return  # sums of Columns: over stored files above
    got = segments.needed(q, lambda p: Bit(p in held))
    if place(text, q) is not None and got is not None:
        assert got.x


EXPRESSIONS = [
    {"price": {"gte": 100, "lt": 120}}, {"kind": "a", "price": {"gt": 990}}, {"or": [{"price": {"lt": 5}}, {"kind": None}]}, {"not": {"price": {"gt": 10}}}, {"price": None}, {"kind": ["a", None]}, {"kind": {"gte": "g"}}, {"seen": True, "price": {"lte": 3}},
    {"tags": "x"}, {"price": {"exists": False}}, {"price": {"eq": 1e9}}, {"and": []}, {"or": []}, {"kind": {"neq": "a", "in": ["a", "b"]}}, {"price": {"in": [1, 2]}}, {"kind": {"lt": "퟿"}},
]


@pytest.mark.parametrize("expr", EXPRESSIONS, ids=map(str, EXPRESSIONS))
def test_bounds_keep_every_file_with_a_row_that_passes(spark, index, stored, expr):
    said = snapshot.manifest(spark, stored, "laid")
    folder = f"{stored}/laid/{said['base']}"
    df = spark.read.parquet(f"{folder}/docs").withColumn("_file", F.col("_metadata.file_name"))
    want = {r[0] for r in index.schema.prepare(df).filter(compile_filter(expr, index.schema.filters)).select("doc._file").distinct().collect()}
    zones = spark.read.parquet(f"{folder}/files")
    got = {r[0] for r in zones.filter(compile_bounds(expr, index.schema.filters, segments._zone(index.schema))).select("file").collect()}
    assert want <= got
    now = DocumentIndex.restore(spark, stored, "laid", index.schema)
    assert rows(now.plan("r", mode="substring", filter=expr, highlight=False)) == rows(index.plan("r", mode="substring", filter=expr, highlight=False))


def test_a_range_on_either_clustered_field_opens_a_fraction(spark, index, stored):
    now = DocumentIndex.restore(spark, stored, "laid", index.schema)
    both = now.plan("r", mode="substring", filter={"price": {"gte": 100, "lt": 150}, "kind": "c"})
    one, other = (now.plan("r", mode="substring", filter=f) for f in ({"price": {"gte": 100, "lt": 150}}, {"kind": "c"}))
    opened = [files_read(s.matched) for s in (both, one, other)]
    assert opened[0] <= 6 and opened[1] <= 24 and opened[2] <= 24
    loose = restored(spark, index, stored).plan("r", mode="substring", filter={"price": {"gte": 100, "lt": 150}, "kind": "c"})
    assert files_read(loose.matched) > 30


# --- checksums ------------------------------------------------------------------------------------------------------------


def test_damage_of_one_file_is_named_when_it_is_met(spark, index, tmp_path):
    root = str(tmp_path)
    index.save(root, "one", files=5)
    (folder,) = glob.glob(f"{root}/one/v-*")
    files = sorted(glob.glob(f"{folder}/docs/part-*"))
    with open(files[2], "r+b") as f:  # a byte of the first page
        f.seek(60)
        old = f.read(1)
        f.seek(60)
        f.write(bytes([old[0] ^ 0x40]))
    os.remove(f"{folder}/docs/.{os.path.basename(files[2])}.crc")
    now = DocumentIndex.restore(spark, root, "one", index.schema)  # the list of files is as it was
    with pytest.raises(Exception, match=os.path.basename(files[2])):
        now.records().collect()
    os.remove(files[1])
    with pytest.raises(IncompatibleIndexError, match="5 files"):
        DocumentIndex.restore(spark, root, "one", index.schema)


def test_rows_that_are_not_those_written_are_named(spark, index, tmp_path):
    root = str(tmp_path)
    index.save(root, "one", files=3)
    (folder,) = glob.glob(f"{root}/one/v-*")
    a, b, _ = sorted(glob.glob(f"{folder}/docs/part-*"))
    for path in glob.glob(f"{folder}/docs/.*.crc"):
        os.remove(path)
    os.rename(a, f"{a}.x")
    os.rename(b, a)
    os.rename(f"{a}.x", b)  # sound files of the same sizes under each other's names
    with pytest.raises(IncompatibleIndexError, match=os.path.basename(a)):
        DocumentIndex.restore(spark, root, "one", index.schema, verify="rows")


def test_restoring_starts_no_job(spark, index, stored):
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("restore", "")
    try:
        restored(spark, index, stored, "laid")
        assert not seen.getJobIdsForGroup("restore")
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_a_batch_upon_an_old_version_lands_or_is_refused(spark, index, tmp_path):
    root = str(tmp_path)

    def batch(*ids):
        return index.docs.filter(F.col("id").isin(*ids)).drop(index.version.version).withColumn("title", F.lit("changed"))

    since = index.save(root, "one")
    snapshot.append(batch(1, 2), root, "one", index.schema, since=since)
    snapshot.append(batch(3), root, "one", index.schema, removed=spark.createDataFrame([(4,)], "id bigint"), since=since)
    for late, gone in ((batch(2, 9), None), (batch(9), spark.createDataFrame([(4,)], "id bigint")), (batch(4), None)):
        with pytest.raises(ConflictError) as e:
            snapshot.append(late, root, "one", index.schema, removed=gone, since=since)
        assert e.value.id in (2, 4) and e.value.now == 3
    snapshot.append(batch(*range(10, 400)), root, "one", index.schema, since=3)  # so large that the whole is written anew
    assert not snapshot.manifest(spark, root, "one")["deltas"]
    snapshot.append(batch(5), root, "one", index.schema, since=3)
    with pytest.raises(ConflictError):
        snapshot.append(batch(200), root, "one", index.schema, since=3)
    index.save(root, "one")
    with pytest.raises(ConflictError):
        snapshot.append(batch(6), root, "one", index.schema, since=3)
    live = DocumentIndex.restore(spark, root, "one", index.schema, version=5).records()
    assert {r.id for r in live.filter("title = 'changed'").collect()} == {1, 2, 3, 5, *range(10, 400)} and live.count() == 1199


def test_a_suggestion_opens_few_files(spark, index, stored):
    now = restored(spark, index, stored, "laid")
    for options in ({}, {"mode": "fuzzy", "fuzzy_distance": 1}, {"field": "title"}):
        got = now.autocomplete("zyxwv1qj", **options)
        assert files_read(got) <= 6
        assert sorted(map(str, got.drop("doc").collect())) == sorted(map(str, index.autocomplete("zyxwv1qj", **options).drop("doc").collect()))
    assert files_read(now.autocomplete("zy")) <= 3  # by the list of its prefix


def test_a_budget_of_a_stored_index_needs_no_job(spark, index, stored):
    now = restored(spark, index, stored, "laid")
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("budget", "")
    try:
        with pytest.raises(CostBudgetExceededError) as e:
            now.search("river", budget=Budget(max_candidates=2399))
        assert e.value.actual == 2400 and not seen.getJobIdsForGroup("budget")
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert now.search("river", budget=Budget(max_candidates=2400), limit=1).total_matches > 0
    with pytest.raises(CostBudgetExceededError):
        now.remove([1]).search("river", budget=Budget(max_candidates=5))


def test_an_empty_index_is_saved_and_searched(spark, index, tmp_path):
    root = str(tmp_path)
    bare = DocumentIndex.create(index.docs.drop(index.version.version).filter(F.lit(False)), [SearchField("title"), SearchField("brand")], filter_fields=FILTERS, validate=False)
    bare.save(root, "none", cluster=["price"])
    now = DocumentIndex.restore(spark, root, "none", bare.schema, verify="rows")
    assert now.search("river", mode="substring", filter={"price": 1}).total_matches == 0 and now.autocomplete("r").collect() == []
    after = now.add(index.docs.drop(index.version.version).filter("id < 20"))
    assert {r["doc_id"] for r in after.autocomplete("r", limit=50).collect()} == {r["doc_id"] for r in bare.add(index.docs.drop(index.version.version).filter("id < 20")).autocomplete("r", limit=50).collect()}
    assert after.search("river", mode="substring", highlight=False).total_matches > 0
