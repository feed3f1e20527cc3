"""Completions by lists of prefixes are those of a scan, also after batches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siftwell.index import DocumentIndex
from siftwell.plans.schema import SearchField
from siftwell.sources import prefixes, snapshot

WORDS = "red read reed re r rad rod a an and ant b.c b-c éa école zoo-zoom x_y".split()


@pytest.fixture(scope="module", params=["numbers", "strings"])
def index(request, spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(WORDS, k=rng.randint(0, 6))), rng.choice(WORDS)) for k in range(600)]
    docs = spark.createDataFrame(rows, "id bigint, title string, kind string")
    if request.param == "strings":
        docs = docs.withColumn("id", F.concat(F.when(F.col("id") % 2 == 0, "Ａ").otherwise("\U00010400"), F.col("id").cast("string")))
    return DocumentIndex.create(docs, [SearchField("title", 0.5), SearchField("kind", 0.3)], validate=False)


def same(a, b, text, **options):
    got, want = a.autocomplete(text, **options), b.autocomplete(text, **options)
    assert [str(r) for r in got.orderBy("rank").collect()] == [str(r) for r in want.orderBy("rank").collect()], (text, options)
    return got


def files_read(df):
    return len({f for f in df.inputFiles() if "/docs/" in f})


def test_completions_by_lists(spark, index, tmp_path):
    root = str(tmp_path)
    index.save(root, "one", files=40)
    now = DocumentIndex.restore(spark, root, "one", index.schema)
    for text in ("r", "re", "red", "É", "b.c", "o", "zzz", "x_", "n "):
        got = same(now, index, text)
        assert files_read(got) <= 2 * 50 and files_read(got) < 41
    for options in ({"limit": 20}, {"field": "kind"}, {"limit": 60}, {"mode": "fuzzy"}, {"tie_breakers": ("id",)}):
        same(now, index, "re", **options)
    few = now.autocomplete("zoo", limit=1, field="kind")
    assert 0 < files_read(few) < 40
    # a lookup reads the lists of its prefix: rows of one range
    lists = spark.read.parquet(f"{root}/one/{snapshot.manifest(spark, root, 'one')['base']}/prefixes")
    assert lists.groupBy("prefix", "field").count().agg(F.max("count")).first()[0] == prefixes.KEPT


def test_completions_after_batches(spark, index, tmp_path, monkeypatch):
    root = str(tmp_path)
    index.save(root, "one", files=8)
    now = DocumentIndex.restore(spark, root, "one", index.schema)
    plain = index.docs.drop(index.version.version)
    best = [r.doc_id for r in index.autocomplete("re", limit=50).collect()]
    changed = plain.filter(F.col("id").isin(*best[:3])).withColumns({"title": F.lit("nothing"), "kind": F.lit("else")})
    new = plain.filter(F.col("id") == best[4]).withColumns({"id": F.lit("900" if isinstance(best[0], str) else 900).cast(plain.schema["id"].dataType), "title": F.lit("re")})
    a, b = (x.update(changed).add(new).remove([best[5]]) for x in (now, index))
    for text in ("re", "r", "no", "e"):
        same(a, b, text)
    # so many of a list are gone that it cannot fill a page
    gone = best[:48]
    a, b = (x.remove(gone) for x in (now, index))
    assert prefixes.looked_up(spark, a.version, a.schema, "re", a_spec(5), [0, 1]) is None
    same(a, b, "re")


def a_spec(limit):
    from siftwell.plans.options import Autocomplete

    return Autocomplete(limit=limit)
