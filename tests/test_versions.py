"""Batches as a log, compaction, snapshots of deltas, damaged and contested snapshots, one pass for page and counts."""

from __future__ import annotations

import glob
import json
import threading

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.errors import DuplicateIdError, IncompatibleIndexError
from siftwell.functions.match import matches, place, query_of
from siftwell.functions.typo import osa, osa_distance
from siftwell.index import DocumentIndex
from siftwell.operators.filters import FilterField
from siftwell.plans.options import PrefixMatch, Typo
from siftwell.plans.schema import SearchField
from siftwell.queries import SQL, Q
from siftwell.sources import snapshot


@pytest.fixture(scope="module")
def index(spark):
    rows = [(k, f"thing {k}", "ab"[k % 2], float(k)) for k in range(40)]
    docs = spark.createDataFrame(rows, "id bigint, title string, kind string, price double")
    return DocumentIndex.create(docs, [SearchField("title")], filter_fields=[FilterField("kind"), FilterField("price", "number")])


def rows_of(spark, *ids, title="new"):
    return spark.createDataFrame([(k, title, "c", 1.0) for k in ids], "id bigint, title string, kind string, price double")


def test_ratio_counts_over_batches(spark, index):
    now = index
    for k in range(4):
        now, out = now.apply_batch(remove=[2 * k, 2 * k + 1])
        assert out.removed == 2 and not out.compacted
        assert now.stats()["tombstones"] == 2 * k + 2
    now, out = now.apply_batch(update=rows_of(spark, 10, 11), add=rows_of(spark, 100))
    assert (out.updated, out.added, out.compacted) == (2, 1, False) and now.version.ratio() == 10 / 43
    now, out = now.apply_batch(remove=[12])
    assert out.compacted and now.version.ratio() == 0 and not now.version.rows
    assert {r.id for r in now.doc_ids().collect()} == {*range(8, 12), *range(13, 40), 100}
    assert index.docs.count() == 40


def test_batches_join_once(spark, index):
    now = index
    for k in range(5):
        now = now.upsert(rows_of(spark, 100 + k))
    plan = now.docs._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join") == 1 and now.docs.count() == 45


def test_repeated_ids_are_refused_whole(spark, index):
    with pytest.raises(DuplicateIdError):
        index.apply_batch(remove=[1], update=rows_of(spark, 2, 2))
    with pytest.raises(DuplicateIdError):
        index.add(rows_of(spark, 200, 200))
    assert index.docs.count() == 40


def test_a_column_named_like_the_version(spark):
    own = spark.createDataFrame([(1, "a thing", 7), (2, "thing", 8)], "id bigint, title string, _version int")
    now = DocumentIndex.create(own, ["title"])
    assert sorted(r["_version"] for r in now.records().collect()) == [7, 8]
    now = now.upsert(spark.createDataFrame([(2, "a second thing", 9)], own.schema))
    assert [(r.id, r.doc["_version"]) for r in now.search("second", mode="substring").results] == [(2, 9)]


def test_deltas_then_a_whole_version(spark, index, tmp_path):
    root = str(tmp_path)
    index.save(root, "live")
    snapshot.append(rows_of(spark, 1, 200), root, "live", index.schema, removed=spark.createDataFrame([(5,)], "id bigint"))
    said = snapshot.manifest(spark, root, "live")
    assert len(said["deltas"]) == 1 and len(glob.glob(f"{root}/live/v-*/docs")) == 1
    now = DocumentIndex.restore(spark, root, "live", index.schema)
    assert {r.id: r.title for r in now.records().collect()} == {k: f"thing {k}" for k in range(40) if k != 5} | {1: "new", 200: "new"}
    assert DocumentIndex.restore(spark, root, "live", index.schema, version=1).docs.count() == 40
    snapshot.append(rows_of(spark, *range(300, 310)), root, "live", index.schema)
    said = snapshot.manifest(spark, root, "live")
    assert not said["deltas"] and said["documents"] == 50 and len(glob.glob(f"{root}/live/v-*/docs")) == 2


def test_two_writers_get_two_versions(spark, index, tmp_path):
    root, failed = str(tmp_path), []

    def write():
        try:
            index.save(root, "both")
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and snapshot.versions(spark, root, "both") == [1, 2, 3]
    assert all(DocumentIndex.restore(spark, root, "both", index.schema, version=k).docs.count() == 40 for k in (1, 2, 3))
    threads = [threading.Thread(target=lambda k=k: snapshot.append(rows_of(spark, 500 + k), root, "both", index.schema)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert {r.id for r in DocumentIndex.restore(spark, root, "both", index.schema).doc_ids().collect()} == {*range(40), 500, 501, 502}


def test_an_older_snapshot_is_read(spark, index, tmp_path):
    root = str(tmp_path)
    index.docs.write.parquet(f"{root}/old/v-1/docs")
    said = {"format": 1, "version": 1, "documents": 40, "decoupled": False, "epoch": 3, "schema": index.schema.manifest()}
    spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.text(f"{root}/old/manifest/1")
    now = DocumentIndex.restore(spark, root, "old", index.schema)
    assert now.docs.count() == 40 and now.epoch == 3
    now.save(root, "old")
    assert snapshot.versions(spark, root, "old") == [1, 2] and DocumentIndex.restore(spark, root, "old", index.schema).docs.count() == 40


def test_damage_is_seen(spark, index, tmp_path):
    root = str(tmp_path)
    index.save(root, "one")
    (path,) = glob.glob(f"{root}/one/manifest/*.json")
    (crc,) = glob.glob(f"{root}/one/manifest/.*.json.crc")
    said = json.loads(open(path).read())
    for change in ({"format": 3}, {"about": {"rows": -1, "crc32_sum": 0}}, {"deltas": {}}, {"base": "../v-1"}, {"epoch": "0"}, {"schema": {}}, {"about": {**said["about"], "crc32_sum": 5}}):
        open(path, "w").write(json.dumps({**said, **change}))
        glob.glob(crc) and __import__("os").remove(crc)
        with pytest.raises(IncompatibleIndexError):
            DocumentIndex.restore(spark, root, "one", index.schema)
    open(path, "w").write("{not json")
    with pytest.raises(IncompatibleIndexError):
        snapshot.manifest(spark, root, "one")
    open(path, "w").write(" " * (snapshot.MAX_MANIFEST + 1))
    with pytest.raises(IncompatibleIndexError):
        snapshot.manifest(spark, root, "one")


def test_a_search_takes_few_jobs(spark, index):
    tracker, group = spark.sparkContext.statusTracker(), "few"
    asked = {"filter": {"kind": "a"}, "facets": {"kind": {}, "price": {"type": "range", "ranges": [{"to": 9}, {"from": 9}]}}, "diagnostics": True, "highlight": False}
    index.search("thing", **asked)
    spark.sparkContext.setJobGroup(group, "")
    found = index.search("thing", **asked)
    spark.sparkContext.setJobGroup("other", "")
    assert len(tracker.getJobIdsForGroup(group)) <= 7  # three actions; each exchange of an adaptive plan is a job of its own
    assert found.total_matches == 20 and [r["count"] for r in found.facets["price"]] == [5, 15] and {r["value"]: r["count"] for r in found.facets["kind"]} == {"a": 20, "b": 20}
    assert found.diagnostics["filter_selectivity"] == 0.5


def test_facets_keep_their_schema_without_matches(index):
    facets = {"kind": {}, "price": {"limit": 3}}
    for query in ("thing", "", "nothing at all"):
        got = index.plan(query, facets=facets).facets
        assert [dict(df.dtypes)["value"] for df in got.values()] == ["string", "double"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcd e", max_size=12), min_size=1, max_size=30), st.text("abcd", min_size=4, max_size=7), st.sampled_from(["substring", "prefix"]), st.integers(1, 2))
def test_native_test_lets_all_typos_pass(spark, texts, term, mode, most):
    q = query_of(mode, term, Typo(enabled=True, max_distance=most, min_for_two=6, prefix_exact_length=0), prefix=PrefixMatch())
    wanted = {t for t in texts if place(t, q) is not None}
    df = spark.createDataFrame([(t,) for t in sorted(set(texts))], "t string")
    assert wanted <= {r.t for r in df.filter(matches(df["t"], q)).collect()}


def test_osa_column(spark):
    words = ["wigdet", "widget", "wgdet", "", None, "wigdetttt", "xigdte"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: r.d for r in df.select("w", osa(df["w"], "wigdet", 2).alias("d")).collect()}
    assert got == {w: None if w is None else osa_distance(w, "wigdet", 2) for w in words}


def test_every_query_of_the_engine_has_sql():
    import siftwell.queries_records  # noqa: F401

    assert set(Q) == set(SQL)
