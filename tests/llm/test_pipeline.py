"""The pipeline's stages against plain versions of what each decides."""

from __future__ import annotations

import collections
import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import plain  # noqa: E402

import corpus_pipeline as P  # noqa: E402
from siftwell.llm import queries  # noqa: E402
from siftwell.llm.tables import keep  # noqa: E402


def test_stages(spark, sf):
    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        before = docs.collect()
        docs = keep(stage(spark, docs, sf), "stage")
        rows = docs.collect()
        seen[name] = len(rows)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "toxicity":
            scores = queries.op1_toxicity(spark, sf).filter("predicted = 0").collect()
            assert {r.doc_id for r in rows} == {r.doc_id for r in scores}
        elif name == "line dedup":
            want = plain.dedup_lines([(r.source, r.text) for r in before], P.LINE_RATIO, P.LINE_MIN)
            assert {r.doc_id: (r.text, r.n_chars) for r in rows} == {r.doc_id: (t, len(t)) for r, t in zip(before, want, strict=True)}
        elif name == "n-gram Jaccard join":
            want = plain.jaccard_components([(r.doc_id, r.text) for r in before], 5, 80)
            assert {r.doc_id for r in rows} == {d for d, (_, c) in want.items() if c == d}
        elif name == "mixing":
            n = collections.Counter(r.doc_id for r in rows)
            assert max(n.values()) <= 3 and set(n) <= {r.doc_id for r in before}
            words = sum(len(plain.words(r.text)) for r in before)
            assert abs(sum(len(plain.words(r.text)) for r in rows) - words) < 0.2 * words
        else:
            assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
            assert {r.doc_id for r in rows} == {r.doc_id for r in before}
    assert seen["toxicity"] > 150


def test_run(spark, sf):
    assert P.run(spark, sf).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "part_bins", "part_bound"]
