"""Resampling towards a target distribution by importance weights of hashed n-grams, drawn without replacement.

Features of a text are all runs of 1 to n consecutive words; a feature's bucket is the crc32 of its bytes modulo a number of buckets. Buckets come from a ring of
running checksums: one scan of a document keeps the zlib states of the last n starts, and each next word extends them all by a blank and its bytes, so no
n-gram is ever put together. Counts of buckets over the documents and over the target give each bucket a gain, the smoothed log ratio of its two shares; a
document's weight is the sum of its features' gains. Adding Gumbel noise made from a hash of its id and taking the highest scores draws without replacement in proportion to weights.

Nothing but counts of buckets (their number is a parameter) reaches the driver. Documents are scanned twice: for the counts, and for the weights.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.tables import boxed, drop, keep, numbered, unboxed
from siftwell.llm.textbatch import buffers, lean, slices

#: Words of the longest feature, buckets, words that a document needs to be drawn, documents drawn of a hundred of those.
WORDS, BUCKETS, LEAST_WORDS, PERCENT, SEED = 3, 10_000, 20, 5, 42
#: Bytes of a text scanned at a time; the ring goes on from piece to piece.
PIECE = 1 << 20
#: A-Z lower-cased; digits, letters and all bytes of characters beyond ASCII stay; the rest separates words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def ring(text: bytes, n: int = WORDS) -> tuple[list[int], int]:
    """The crc32 of every run of 1 to n words of a text, and its number of words."""
    out: list[int] = []
    states: list[int] = []
    words, at = 0, 0
    crc = zlib.crc32
    while at < len(text):
        end = at + PIECE
        piece = text[at:end].translate(_WORD_BYTES)
        if end < len(text):  # a word that the cut may split waits for the next piece; one longer than a piece is read on to its end
            cut = piece.rfind(b" ")
            while cut < 0 and end < len(text):
                piece += text[end : end + PIECE].translate(_WORD_BYTES)
                cut, end = piece.rfind(b" ", len(piece) - PIECE), end + PIECE
            piece = piece[: cut + 1] if cut >= 0 else piece
        at += len(piece)
        some = piece.split()
        words += len(some)
        for w in some:
            more = b" " + w
            states = [crc(w), *[crc(more, s) for s in states]]
            out += states
            if len(states) == n:
                states.pop()
    return out, words


def _texts(column: pa.Array) -> Iterator[bytes]:
    raw, off = buffers(column)
    data = raw.tobytes()
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        yield data[a:b]


def _counted(n: int, buckets: int):
    """Rows (bucket, n) of a partition, each bucket once."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for t in _texts(batch.column(0)):
                found, _ = ring(t, n)
                total += np.bincount(np.array(found, np.int64) % buckets, minlength=buckets)
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    return run


def bucket_counts(docs: DataFrame, text: str = "text", n: int = WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all texts: one number a bucket reaches the driver, summed over tasks before."""
    rows = docs.select(F.col(text).alias("text")).mapInArrow(_counted(n, buckets), "bucket int, n bigint")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: the floor of a thousand times the log of target share over source share, both smoothed by one a bucket."""
    s_all, t_all, size = int(source.sum()), int(target.sum()), len(source)
    ratio = ((float(t + 1) * float(s_all + size)) / (float(s + 1) * float(t_all + size)) for s, t in zip(source.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def _weighed(n: int, gain: np.ndarray):
    """Rows (n_words, n_features, weight) beside the columns before the text."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for t in _texts(batch.column(1)):
                found, words = ring(t, n)
                rows.append((words, len(found), int(gain[np.array(found, np.int64) % len(gain)].sum())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in zip(*rows, strict=True))], ["_own", "n_words", "n_features", "weight"])

    return run


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of SHA-256 of seed and id; all null ids have the same."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weigh(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", n: int = WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row of docs, against the texts of target."""
    gain = gains(bucket_counts(docs, text, n, buckets), bucket_counts(target, target_text, n, buckets))
    rows = docs.select(F.col(doc_id).cast("long").alias("_own"), F.col(text).alias("text"))
    found = rows.mapInArrow(_weighed(n, gain), "_own bigint, n_words bigint, n_features bigint, weight bigint")
    return found.select(F.col("_own").alias("doc_id"), "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("_own"), seed)).alias("score"))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, n: int = WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row: rank from 1 for those drawn, highest scores first, equal scores by doc_id, else null.

    Drawn are floor(percent * N / 100) of the N rows with least_words words or more. Null, empty and blank texts have no features, weight 0 and are never drawn with
    least_words above 0. Repeated rows are documents of their own with equal scores; a null doc_id comes before others among equal scores. Texts of any length are scanned whole, in pieces. With an
    empty target every gain compares with a uniform share; an empty docs gives no rows. Other columns are left aside.
    """
    scored = keep(weigh(docs, target, text, doc_id, target_text, n, buckets, seed), "weighed")
    can = F.col("n_words") >= least_words
    k = scored.filter(can).count() * percent // 100
    ranked = numbered(scored.filter(can), [F.col("score").desc(), F.col("doc_id").asc_nulls_first()], "drawn")
    # the rest needs no order
    rest = scored.filter(~can).withColumn("rank", F.lit(None).cast("long"))
    out = ranked.withColumn("rank", F.when(F.col("_at") < k, F.col("_at") + 1)).drop("_at").unionByName(rest)
    out = keep(out, "resampled")
    drop(scored)
    drop(ranked)
    return out


def sample(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """The drawn rows of docs, all their columns, with rank and score (columns so named are replaced). Rows of one doc_id come in as a whole if one of them is drawn, at its best rank."""
    drawn = resample(docs, target, text, doc_id, **how).filter("rank is not null").groupBy("doc_id").agg(F.min("rank").alias("_rank"), F.min_by("score", "rank").alias("_score"))
    rows = boxed(docs, _key=F.col(doc_id).cast("long")).join(drawn, F.col("_key").eqNullSafe(F.col("doc_id")))
    return unboxed(rows, docs.columns, rank=F.col("_rank"), score=F.col("_score"))
