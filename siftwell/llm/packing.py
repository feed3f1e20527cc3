"""Best-fit packing of documents into sequences of a fixed number of tokens, certified by lower bounds.

Documents become pieces of at most `capacity` ids (only longer ones are cut; a first piece may be shorter). Pieces are dealt evenly
to partitions by hash and packed there by best-fit decreasing. Dual feasible functions over a partition's length histogram give
a lower bound on its number of bins: where the bound is met, the packing is certified optimal. Partitions with a gap give up the
pieces of their emptier bins; these are dealt anew, several partitions' to one, and packed again, until no gap is left, nothing is gained or all exchanges are done. The
packing of a round is kept only where it needs fewer bins, so the number of sequences never rises.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import bpe
from siftwell.llm.tables import drop, keep
from siftwell.llm.textbatch import lean, slices

#: Pieces to a partition, on average.
PART_PIECES = 4_000
#: Bins filled to this share at least stay closed when a partition with a gap exchanges documents.
CLOSED = 0.995
ROUNDS = 3

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _cutter(path: str, end_id: int, capacity: int):
    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.encoder(path)
        for batch in slices(batches):
            flat, counts = coder.encode(batch.column(1))
            out: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), bpe.documents(flat, counts, end_id), strict=True):
                data, n = ids.astype("<u4", copy=False), len(ids)
                bounds = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                out += [(doc, k, a, b - a, zlib.crc32(data[a:b].data)) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
            cols = list(zip(*out, strict=True))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The pieces of every document with their crc32 over little-endian 32-bit ids. Null text: empty, one piece of the end id."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_cutter(tokenizer, end_id, capacity), PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound of the dual feasible functions u_a: over capacity - a counts 1, under a counts 0, else its share (a up to capacity / 2)."""
    hist = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    count = np.concatenate([[0], np.cumsum(hist)])  # count[x]: items shorter than x
    total = np.concatenate([[0], np.cumsum(hist * np.arange(capacity + 1))])
    a = np.arange(0, capacity // 2 + 1)
    large = count[-1] - count[capacity - a + 1]
    middle = total[capacity - a + 1] - total[a]
    return int((large + -(-middle // capacity)).max())


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin. Items of full capacity have a bin each."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = int((lengths == capacity).sum())
    bins[order[:full]] = np.arange(full)
    fill: list[int] = [capacity] * full
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin with room r is open
    for i, size in zip(order[full:].tolist(), lengths[order[full:]].tolist(), strict=True):
        fits = rooms >> size
        if fits:
            room = size + ((fits & -fits).bit_length() - 1)
            b = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        left = room - size
        if left:
            open_by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def _packer(capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "start", "ids_crc32"], na_position="first", ignore_index=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        return pdf.assign(bin=bins, offset=offsets, fill=fill[bins], bins=len(fill), bound=lower_bound(lengths, capacity))

    return pack


def pack(rows: DataFrame, capacity: int, part_pieces: int = PART_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """The rows (of PIECES, lengths 1 to capacity; a kept table) with sequence_id, offset, and the certificate of the partition that packed them last:
    part_bins, its number of sequences, and part_bound, below which no packing of its pieces can go (both null for nearly full
    sequences that stayed while the rest of their partition was packed anew, at most `rounds` times). Sequences of a partition of equal numbers are as few as can be.

    Partitions are of a bounded size (part_pieces on average), dealt by hash of the piece and its place in the table, so rows of one id or equal rows
    spread. Repeated rows are placed each on their own; an empty table gives an empty result.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def packed(df: DataFrame, k: int, n: int) -> DataFrame:
        parts = max(1, round(n / part_pieces))
        # a row's place in a table of files is the same whenever a task is run again
        place = F.xxhash64("doc_id", "piece", F.lit(k), F.monotonically_increasing_id())
        dealt = df.select(*columns, F.pmod(place, F.lit(parts)).alias("part"))
        out = dealt.groupBy("part").applyInPandas(_packer(capacity), PIECES + ", part bigint, bin bigint, offset bigint, fill bigint, bins bigint, bound bigint")
        return keep(out, f"packed{k}").withColumn("round", F.lit(k))

    now, done = packed(rows, 0, rows.count()), []
    for k in range(1, rounds + 2):
        # what is nearly full or certified stays; the emptier bins of partitions with a gap exchange their pieces
        again = (F.col("bins") > F.col("bound")) & (F.col("fill") < int(CLOSED * capacity))
        got = now.agg(F.count_if(again).alias("n"), F.sum(F.when(again, F.col("length"))).alias("tokens"), F.count_if(again & (F.col("offset") == 0)).alias("bins")).first()
        if k > rounds or not got.n or got.bins <= -(-got.tokens // capacity):
            break
        new = packed(now.filter(again), k, got.n)
        if new.filter("offset = 0").count() >= got.bins:
            drop(new)
            break
        # bins that stay closed where others are packed anew have no certificate any more: theirs was for both
        gap = F.col("bins") > F.col("bound")
        done.append(now.filter(~again).withColumns({c: F.when(~gap, F.col(c)) for c in ("bins", "bound")}))
        now = new
    for df in done:
        now = now.unionByName(df)
    # a partition has below 2**31 bins, and there are below 2**28 partitions
    sequence = F.shiftleft(F.col("round").cast("long"), 60) + F.shiftleft(F.col("part"), 31) + F.col("bin")
    out = keep(now.select(*columns, sequence.alias("sequence_id"), "offset", F.col("bins").alias("part_bins"), F.col("bound").alias("part_bound")), "sequences")
    drop(now)  # the tables of all rounds
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, **how) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset, part_bins, part_bound.

    Texts of any length are encoded whole. The kept table of pieces is read by the result's plan no more once it is packed, and is dropped.
    """
    cut = keep(pieces(docs, tokenizer, end_id, capacity), "pieces")
    out = pack(cut, capacity, **how)
    drop(cut)
    return out
