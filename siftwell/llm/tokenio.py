"""Token-id output: whole texts to ids, ids to bit-plane files, and back.

File format ("planes"): a Parquet dataset whose rows are chunks. A chunk holds the ids of whole documents in ascending
doc_id order; a chunk is closed when it reaches CHUNK_IDS ids, so a longer document has one to itself. Columns:

  shard, chunk         the chunk's place: shards ascend with doc_id, chunks ascend within a shard
  shard_start, n_ids   ids before it in its shard, ids in it
  doc_ids, doc_tokens  its documents and their numbers of ids
  block_ids            ids in each block but the last; block_ends: the chunk index, (block, plane) -> end in payload
  payload              for each block its planes one after another, each a zstandard frame

A block's ids are transposed: their low bytes make byte plane 0, the next bytes byte plane 1, and each higher bit that any id of the
block uses makes a bit plane (one bit an id). Blocks decode independently.
Parquet carries the chunks because its commit protocol survives lost tasks and any store Spark reads will do; the payload
is stored without further compression.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import bpe
from siftwell.llm.textbatch import slices

#: Ids after which a chunk is closed, and ids in a block.
CHUNK_IDS, BLOCK_IDS = 1 << 18, 1 << 16
LEVEL = 1

SCHEMA = "shard int, chunk int, shard_start bigint, n_ids bigint, doc_ids array<bigint>, doc_tokens array<bigint>, block_ids int, block_ends array<array<bigint>>, payload binary"
_ARROW = pa.schema(
    [("shard", pa.int32()), ("chunk", pa.int32()), ("shard_start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("block_ids", pa.int32()), ("block_ends", pa.list_(pa.list_(pa.int64()))), ("payload", pa.binary())]
)


def pack_planes(ids: np.ndarray, block_ids: int = BLOCK_IDS, level: int = LEVEL) -> tuple[bytes, list[list[int]]]:
    """ids (unsigned 32-bit) as compressed planes, and the end of each plane of each block in the result."""
    press = zstandard.ZstdCompressor(level=level, write_checksum=False)
    out, ends, at = [], [], 0
    for i in range(0, len(ids), block_ids):
        block = np.ascontiguousarray(ids[i : i + block_ids], "<u4")
        low = block.view(np.uint8).reshape(-1, 4)
        planes = [np.ascontiguousarray(low[:, 0]), np.ascontiguousarray(low[:, 1])]
        planes += [np.packbits((block >> np.uint32(b)) & np.uint32(1)) for b in range(16, int(block.max()).bit_length())]
        mine = []
        for plane in planes:
            out.append(press.compress(plane))
            at += len(out[-1])
            mine.append(at)
        ends.append(mine)
    return b"".join(out), ends


def unpack_planes(payload: bytes, ends: list[list[int]], n: int, block_ids: int = BLOCK_IDS) -> np.ndarray:
    """The n ids of pack_planes."""
    open_ = zstandard.ZstdDecompressor()
    ids, at = np.zeros(n, np.uint32), 0
    for i, mine in enumerate(ends):
        block = ids[i * block_ids : min(n, (i + 1) * block_ids)]
        for k, end in enumerate(mine):
            plane = np.frombuffer(open_.decompress(payload[at:end]), np.uint8)
            if k < 2:
                block |= plane.astype(np.uint32) << np.uint32(8 * k)
            else:
                block |= np.unpackbits(plane)[: len(block)].astype(np.uint32) << np.uint32(14 + k)
            at = end
    return ids


def _writer(path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, chunk, start = bpe.encoder(path), TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []

        def close() -> pa.RecordBatch:
            nonlocal chunk, start
            sizes = [len(x) for x in held]
            ids = np.concatenate(held)
            payload, ends = pack_planes(ids)
            row = pa.RecordBatch.from_pydict(dict(zip(_ARROW.names, ([shard], [chunk], [start], [len(ids)], [list(doc_ids)], [sizes], [BLOCK_IDS], [ends], [payload]), strict=True)), _ARROW)
            chunk, start = chunk + 1, start + len(ids)
            held.clear()
            doc_ids.clear()
            return row

        n = 0
        for batch in slices(batches):
            flat, counts = coder.encode(batch.column(1))
            for doc, ids in zip(batch.column(0).to_pylist(), bpe.documents(flat, counts, end_id), strict=True):
                if n and n + len(ids) > CHUNK_IDS:
                    yield close()
                    n = 0
                held.append(ids)
                doc_ids.append(doc)
                n += len(ids)
        if held:
            yield close()

    return write


def write_ids(docs: DataFrame, out: str, tokenizer: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encodes every text (null: empty) with the tokenizers file and writes a planes dataset to the folder out.

    One range shuffle of the texts puts documents in ascending doc_id order (null ids first, equal ids in any order);
    shards are Spark's partitions of it. Extra columns are left aside; an empty table gives a dataset without chunks.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # a range alone doesn't balance bytes, but long texts are spread evenly over ids; AQE joins what is too small
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_writer(tokenizer, end_id), SCHEMA).write.option("compression", "none").parquet(out)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["shard", "doc_id", "at", "n_tokens", "ids_crc32"]
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack_planes(row["payload"], row["block_ends"], row["n_ids"], row["block_ids"])
            sizes = np.array(row["doc_tokens"], np.int64)
            ends = np.cumsum(sizes)
            crcs = [zlib.crc32(ids[a:b].astype("<u4", copy=False).data) for a, b in zip(ends - sizes, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(sizes), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["shard_start"] + ends - sizes, pa.int64()), pa.array(sizes), pa.array(crcs, pa.int64())], names)


def read_index(df: DataFrame) -> DataFrame:
    """From a planes dataset: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, each decoded from the files.

    Only one number a shard (its ids) meets in one place, to find where each shard starts.
    """
    spark = df.sparkSession
    totals = {r.shard: r.n for r in df.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    starts, at = [], 0
    for shard in sorted(totals):
        starts.append((shard, at))
        at += totals[shard]
    docs = df.mapInArrow(_reader, "shard int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    if not starts:
        return docs.select("doc_id", F.col("at").alias("start"), "n_tokens", "ids_crc32")
    first = spark.createDataFrame(starts, "shard int, first bigint")
    return docs.join(F.broadcast(first), "shard").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(df: DataFrame) -> DataFrame:
    """doc_id and ids (array of long) of every document of a planes dataset."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_planes(row["payload"], row["block_ends"], row["n_ids"], row["block_ids"]).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(row["doc_tokens"])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["doc_id", "ids"])

    return df.mapInArrow(read, "doc_id bigint, ids array<bigint>")
