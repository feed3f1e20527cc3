"""Resampling, ranked search and sharding against plain versions; hard rows for every operator."""

from __future__ import annotations

import collections
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import plain  # noqa: E402

from siftwell.llm import importance, jpeg, lexical, linededup, mixing, ngramjoin, packing, pii, quality, queries, secrets, sharding, textbatch, tokenio, toxicity  # noqa: E402

LONG = "some words that go on and on, " * 30_000
HARD = [None, "", " \t\n", "...", "one", "One two THREE", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty", "Ünïcode ist hier; und «da» 你好 你好", "a_b-c'd 1.5 x\x00y", LONG, "q" * 200_000]


@pytest.fixture(scope="module")
def hard(spark):
    """Null and repeated ids, ties, repeated rows, null sources, very long texts, columns of clashing names."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = HARD + [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)]
    rows = [(i, t, None if i % 7 == 0 else f"s{i % 3}", i, i, "x", 0) for i, t in enumerate(texts)]
    rows += [(None, "w1 w2 w3 " * 9, None, None, None, None, None), (None, "w1 w2 w3 " * 9, None, None, None, None, None), (20, texts[20], "s1", 9, 9, "x", 9), (900, texts[21], "s1", 9, 9, "x", 9), (20, texts[20], "s1", 9, 9, "x", 9)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, shard bigint, rank bigint, _row string, _at bigint").repartition(3).persist()


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "w1 w2 W2 nothing"), (2, None), (3, ""), (4, "one two three"), (4, "w5 w6 w7 w8 w9"), (5, "unheard"), (None, "w3"), (7, LONG)]
    return spark.createDataFrame(rows, "item_id bigint, text string")


def pairs(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


# --- resampling ------------------------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "Bc", " ", "  ", "-", "é", "你好", "x" * 40, "\n", "_", "7"]), max_size=40), st.integers(1, 4), st.integers(1, 30))
def test_a_ring_of_states_is_the_checksums_of_all_runs(parts, n, piece):
    text = "".join(parts)
    runs, words = plain.hashed_runs(text, n)
    before = importance.PIECE
    importance.PIECE = piece
    try:
        got, m = importance.ring(text.encode(), n)
    finally:
        importance.PIECE = before
    assert m == words
    assert collections.Counter(got) == collections.Counter(zlib.crc32(f.encode()) for f in runs)


def test_resampling_of_hard_rows(hard, items):
    found = importance.resample(hard, items, percent=30, least_words=5)
    want = plain.resampled(pairs(hard, "doc_id", "text"), [t for _, t in pairs(items, "item_id", "text")], percent=30, least=5)
    assert collections.Counter(pairs(found, "doc_id", "n_features", "weight", "score", "rank")) == collections.Counter(want)
    drawn = importance.sample(hard, items, percent=30, least_words=5)
    assert drawn.columns == [*hard.columns, "score"]
    ids = {x[0] for x in want if x[4]}
    assert collections.Counter(r.doc_id for r in drawn.collect()) == collections.Counter(d for d, _ in pairs(hard, "doc_id", "text") if d in ids)


def test_resampling_without_rows(hard, items):
    none = hard.filter(F.lit(False))
    assert importance.resample(none, items).count() == 0
    alone = importance.resample(hard, items.filter(F.lit(False)), percent=100, least_words=0)
    assert sorted(r["rank"] for r in alone.collect()) == list(range(1, hard.count() + 1))


# --- ranked search ----------------------------------------------------------------------------------------------------


def test_ranked_search_of_hard_rows(hard, items, monkeypatch):
    want = collections.Counter(plain.ranked(pairs(hard, "doc_id", "text"), pairs(items, "item_id", "text"), k=5))
    index, corpus = lexical.build(hard)
    assert collections.Counter(pairs(lexical.search(index, corpus, items, k=5), "item_id", "rank", "doc_id", "score")) == want
    monkeypatch.setattr(lexical, "QUERY_TERMS", 3)  # several blocks of queries
    assert collections.Counter(pairs(lexical.search(index, corpus, items, k=5), "item_id", "rank", "doc_id", "score")) == want


def test_ranked_search_without_rows(hard, items):
    index, corpus = lexical.build(hard.filter(F.lit(False)))
    assert lexical.search(index, corpus, items).collect() == []
    index, corpus = lexical.build(hard)
    empty = lexical.search(index, corpus, items.filter(F.lit(False)))
    assert empty.collect() == [] and empty.columns == ["item_id", "rank", "doc_id", "score"]


def _one_block(texts, queries_):
    """The index of texts and a block of queries with weights, without Spark."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    lengths = next(lexical._lengths(iter([pa.RecordBatch.from_arrays([batch.column(1)], ["text"])])))
    corpus = lexical.Corpus(lengths.column(0)[0].as_py(), lengths.column(1)[0].as_py())
    index = [r for r in lexical._indexed(corpus)(iter([batch])) if r.num_rows]
    asked = pa.RecordBatch.from_arrays([pa.array(range(len(queries_)), pa.int64()), pa.array(queries_)], ["item", "text"])

    class Row:
        def __init__(self, item, term, c):
            self.item, self.term, self.c = item, term, c

    rows = [Row(*x.values()) for b in lexical._query_terms(iter([asked])) for x in b.to_pylist()]
    block = lexical.Block.of(rows)
    for b in lexical._frequencies(block.terms)(iter(index)):
        for r in b.to_pylist():
            block.weights[r["term"]] = lexical.weight(corpus.docs, r["df"])
    return index, corpus, block


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), max_size=30), min_size=1, max_size=25), st.lists(st.lists(st.integers(0, 14), min_size=1, max_size=6), min_size=1, max_size=4), st.integers(1, 40), st.integers(1, 60))
def test_bounds_hold_the_exact_score_whatever_the_steps(docs, asked, postings, cells):
    texts, asked = [" ".join(f"t{x}" for x in d) for d in docs], [" ".join(f"t{x}" for x in q) for q in asked]
    before = lexical.STEP_POSTINGS, lexical.STEP_CELLS
    lexical.STEP_POSTINGS, lexical.STEP_CELLS = postings, cells
    try:
        index, corpus, block = _one_block(texts, asked)
        want = {(q, d): s for q, _, d, s in plain.ranked(list(enumerate(texts)), list(enumerate(asked)), k=100)}
        seen = {}
        for row in index:
            for lo, hi, low, high in lexical._bounds(row, 0, block):
                for q in range(lo, hi):
                    for d in range(len(texts)):
                        exact = want.get((block.items[q], d), 0)
                        assert low[q - lo, d] <= exact <= high[q - lo, d]
                        seen[block.items[q], d] = exact
        assert all(k in seen for k in want)
        for k in (1, 3):
            least = np.zeros(len(block.items), np.int64)
            for b in lexical._lowest(block, k)(iter(index)):
                rows = collections.defaultdict(list)
                for r in b.to_pylist():
                    rows[r["query"]].append(r["low"])
                for q, x in rows.items():
                    least[q] = min(x) if len(x) == k else 0
            got = [(block.items[r["query"]], r["doc_id"], r["score"]) for b in lexical._rescored(block, corpus, k, least)(iter(index)) for r in b.to_pylist()]
            assert sorted(got) == sorted((q, d, s) for q, _, d, s in plain.ranked(list(enumerate(texts)), list(enumerate(asked)), k=k))
    finally:
        lexical.STEP_POSTINGS, lexical.STEP_CELLS = before


def test_few_documents_reach_the_threshold(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    asked = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(20).collect()]
    index, corpus, block = _one_block([r.text for r in docs], asked)
    rows = collections.defaultdict(list)
    for b in lexical._lowest(block, 20)(iter(index)):
        for r in b.to_pylist():
            rows[r["query"]].append(r["low"])
    reach = matched = 0
    for row in index:
        for lo, hi, _, high in lexical._bounds(row, 0, block):
            for q in range(lo, hi):
                reach, matched = reach + int((high[q - lo] >= min(rows[q])).sum()), matched + int((high[q - lo] > 0).sum())
    assert reach < matched / 3 and reach < 30 * len(asked)


# --- shards -------------------------------------------------------------------------------------------------------------


def test_every_shard_matches_the_mixture(spark):
    rng = random.Random(8)
    names = ["hot"] * 700 + [None] * 40 + [f"s{i}" for i in range(12) for _ in range(rng.randint(1, 50))]
    rng.shuffle(names)
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "doc_id bigint, source string").repartition(5)
    found = sharding.interleave(rows, shards=7).collect()
    assert collections.Counter(r.doc_id for r in found) == collections.Counter(range(len(names)))
    size = collections.Counter(r.shard for r in found)
    assert max(size.values()) - min(size.values()) <= 1 and set(size) == set(range(7))
    for k in range(7):
        assert sorted(r.slot for r in found if r.shard == k) == list(range(size[k]))
    of = collections.Counter((r.source, r.shard) for r in found)
    for name, n in collections.Counter(names).items():
        for k in range(7):
            assert abs(of[name, k] - n / 7) <= 2
    again = sharding.interleave(rows.repartition(2), shards=7).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    other = sharding.interleave(rows, shards=7, seed=1).collect()
    assert sorted(map(str, found)) != sorted(map(str, other))


def test_shards_of_hard_rows(hard, spark, tmp_path):
    sharding.write_shards(hard, f"{tmp_path}/shards", shards=4)
    got = spark.read.parquet(f"{tmp_path}/shards")
    names = [c for c in hard.columns if c != "shard"]
    assert collections.Counter(map(str, pairs(got, *names))) == collections.Counter(map(str, pairs(hard, *names)))
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for k in by:  # the files of a shard hold its rows by slot
        files = sorted(Path(tmp_path, "shards", f"shard={k}").glob("*.parquet"))
        assert [s for f in files for s in pq.read_table(f, columns=["slot"])["slot"].to_pylist()] == list(range(len(by[k])))
    thin = hard.select("doc_id", "source")
    assert sharding.interleave(thin.filter(F.lit(False))).count() == 0
    few = sharding.interleave(thin.limit(3), shards=16).collect()
    assert len({r.shard for r in few}) == 3 and {r.slot for r in few} == {0}


# --- batches without words, for every operator ----------------------------------------------------------------------------


@pytest.fixture(scope="module", params=["all blank", "a blank partition", "a blank slice"])
def blank(request, spark):
    """Tables whose rows, or a partition or a slice of whose rows, hold no words."""
    rng = random.Random(2)
    some = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(30)) for _ in range(40)]
    if request.param == "all blank":
        rows, parts = [(i, t) for i, t in enumerate([None, "", "  ", "\n\t"])], 1
    elif request.param == "a blank partition":
        rows, parts = [(i, t) for i, t in enumerate(some[:6] + [None, "", " ", None, "  ", "\n"])], 2
    else:
        rows, parts = [(i, t) for i, t in enumerate(["w " * 600_000, None, "", " " * 2_000_000, "x " * 600_000])], 1
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1) if parts == 1 else spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id bigint, text string")
    df = df.withColumns({"source": F.lit("s"), "lang": F.lit("en"), "n_chars": F.length("text").cast("long")})
    assert df.rdd.getNumPartitions() == parts
    return df.persist()


def test_components_without_words(blank):
    found = {r.doc_id: r for r in ngramjoin.jaccard_components(blank).collect()}
    want = plain.jaccard_components(pairs(blank, "doc_id", "text"))
    assert {d: (r.n_shingles, r.component_id) for d, r in found.items()} == want
    assert ngramjoin.representatives(blank, words=4, percent=85).count() == len({c for _, c in want.values()})


def test_other_operators_without_words(blank, spark, items):
    n = blank.count()
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id bigint, toxic int")
    assert toxicity.score(blank, toxicity.fit(blank, labels)).count() == n
    assert mixing.mix(blank).count() == n
    assert quality.judge(blank).count() == n
    assert secrets.find_secrets(blank).count() == n
    assert linededup.dedup_lines(blank, "text", "source", "doc_id").count() == n
    assert pii.find(blank).count() == n
    assert jpeg.media_features(jpeg.media(blank)).count() == n
    assert importance.resample(blank, items).count() == n
    assert sharding.interleave(blank.select("doc_id", "source")).count() == n
    index, corpus = lexical.build(blank)
    assert sorted(pairs(lexical.search(index, corpus, blank, item_id="doc_id", k=3), "item_id", "rank", "doc_id", "score"), key=str) == sorted(plain.ranked(pairs(blank, "doc_id", "text"), pairs(blank, "doc_id", "text"), k=3), key=str)
    assert packing.pack_documents(blank, queries.tokenizer_path(), end_id=0, capacity=2048).select("doc_id").distinct().count() == n


def test_token_files_without_words(blank, spark, tmp_path):
    tokenio.write_ids(blank, f"{tmp_path}/ids", queries.tokenizer_path(), end_id=2)
    assert tokenio.read_index(spark.read.parquet(f"{tmp_path}/ids")).count() == blank.count()


# --- a hash without collisions by rule --------------------------------------------------------------------------------------


def test_exchanged_lanes_stay_apart():
    """Lanes of a word exchanged, or shifted by a difference of their places, as a sum over lanes would not notice."""
    rng = random.Random(1)
    seen = {}
    for _ in range(3000):
        lanes = [bytes(rng.randint(33, 126) for _ in range(8)) for _ in range(4)]
        tail = bytes(rng.randint(33, 126) for _ in range(rng.randint(0, 7)))
        i, j = rng.sample(range(4), 2)
        other = list(lanes)
        other[i], other[j] = lanes[j], lanes[i]
        moved = list(lanes)
        step = rng.randint(1, 9)
        if lanes[i][0] + step < 127 and lanes[j][0] - step > 32:
            moved[i], moved[j] = bytes([lanes[i][0] + step]) + lanes[i][1:], bytes([lanes[j][0] - step]) + lanes[j][1:]
        for w in (lanes, other, moved):
            word = b"".join(w) + tail
            h = int(textbatch.span_hash(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])
            assert seen.setdefault(h, word) == word


def test_short_spans_never_collide_and_place_does_not_matter():
    raw = np.frombuffer(b"abcdefg\x07abcdefg \x00 \x00\x00 " + b"z" * 400 + b" " + b"z" * 400, np.uint8)
    spans = [(0, 8), (0, 7), (8, 15), (16, 17), (18, 20), (21, 421), (422, 822), (21, 420)]
    h = textbatch.span_hash(raw, np.array([a for a, _ in spans]), np.array([b for _, b in spans])).tolist()
    assert h[1] == h[2] and h[5] == h[6]
    assert len(set(h)) == len(spans) - 2


# --- pages of many unclosed openings ------------------------------------------------------------------------------------------


def test_lines_of_html_with_unclosed_openings(spark):
    import time

    mark = ""
    pages = ["a<!-- b", "<!-- x --> y <!-- z", "<script>1</script>2<script>3", "<script a<b>c</script>d<script", "<style>x</STYLE>y<style z", "<!--<script>--></script>x", "<<p>a<p", "<p a", f"{mark}<!--{mark}{mark}-", f"<!{mark}-- a", "<a <b>c<", "x<SCRIPT >a</script ></script>b", "<script></script><!-->--> <!-- --> t", None, ""]
    import re

    hidden, block = re.compile(r"<script(?:\s[^>]*)?>.*?</script>|<style(?:\s[^>]*)?>.*?</style>|<!--.*?-->", re.I | re.S), re.compile(linededup._BLOCK)
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    got = {r.page_id: r.t for r in rows.select("page_id", linededup.lines_of_html("html").alias("t")).collect()}
    slow = {r.page_id: r.t for r in rows.select("page_id", linededup._visible_by_heads(F.coalesce("html", F.lit(""))).alias("t")).collect()}
    assert got == slow
    for i, p in enumerate(pages):
        assert got[i] == re.sub(r"<[^>]*>", "", block.sub("\n", hidden.sub(" ", p or ""))), p
    long = [x * (1_000_000 // len(x)) for x in ("<", "<!--", "<script>", "<script ", "<style x", "<p ", "<!-- </script>", "<script <style> <!--", "<p>")] + ["<!--" * 100_000 + "</script></style>", "<script " * 100_000 + "</script>", "<" * 500_000 + "<p>"]
    rows = spark.createDataFrame([(x,) for x in long], "html string").coalesce(1)
    begun = time.time()
    assert len(rows.select(F.length(linededup.lines_of_html("html"))).collect()) == len(long)
    assert time.time() - begun < 2 * len(long)


def test_ids_of_pretokens_that_share_a_hash(monkeypatch):
    """Where hashes of more than three characters have four values nearly every pre-token meets another's; ids are the library's all the same."""
    from siftwell.llm import bpe

    monkeypatch.setattr(bpe, "span_hash", lambda v, a, b: np.where(b - a > 3, textbatch.span_hash(v, a, b) % np.uint64(4), textbatch.span_hash(v, a, b)))
    coder = bpe.Encoder(queries.tokenizer_path())
    texts = ["a bb ccc dddd eeeee ffffff", "the quick brown fox jumps over the lazy dog; isn't it?", "xyzw xyzv xyzwxyzw xyzwxyzv" * 20]
    for _ in range(2):
        flat, counts = coder.encode(pa.array(texts))
        cuts = np.cumsum(counts)[:-1]
        assert [x.tolist() for x in np.split(flat, cuts)] == [coder.tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_the_pipeline_leaves_its_result_alone(spark, sf, monkeypatch):
    from contextlib import contextmanager

    import corpus_pipeline

    real, every = corpus_pipeline.scratch, []

    @contextmanager
    def noting():
        with real() as made:
            every.append(made)
            yield made

    monkeypatch.setattr(corpus_pipeline, "scratch", noting)
    docs = corpus_pipeline.run(spark, sf)
    folders = [f for made in every for f in made]
    assert docs.count() > 0 and len(folders) > 10
    assert [f for f in folders if Path(f.removeprefix("file:")).exists()] == folders[-1:]
