"""Sharding by proportional stratified interleaving: every shard holds the mixture of sources that the whole holds.

Native DataFrame operations only. Rows of a source are shuffled by a seeded hash of their ids and ranked; a row of rank r (from 0) among the n of its source stands
at the fraction (r + 1/2) / n. In the order of these fractions the sources are interleaved in proportion to their sizes at every scale, so cutting that order into equal
pieces gives each shard its share of every source, within about one row, and numbers of rows at most one apart. Ranks and places come from range shuffles with counts
a partition: a source with most of all rows is dealt to many tasks like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.tables import boxed, drop, keep, numbered, unboxed

SHARDS, SEED = 16, 42


def size_of(text: str) -> Column:
    """UTF-8 bytes of a text and one more; null has none but that."""
    return F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + F.lit(1)


def crc_of(text: str) -> Column:
    """Unsigned crc32 of a text's UTF-8 bytes; null is empty."""
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def shuffled(doc_id: str, seed: int) -> Column:
    """A row's key in the seeded shuffle: SHA-256 of seed and id, in hexadecimal."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)


def interleave(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """rows, all their columns, with shard (int, from 0) and slot (long, gapless from 0 in its shard); columns so named are replaced.

    What is shuffled twice is the row as given, so give it without texts (write_shards() brings those). Null sources are one source, rows of a null id stand at one
    place of the shuffle in their source, and repeated rows are rows of their own: equal rows differ in nothing but their slots. Fewer rows
    than shards leave the last ones empty; an empty table gives no rows.
    """
    held = boxed(rows, _name=F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("-")), _key=shuffled(f"`{doc_id}`", seed))
    # a number of its own keeps rows of one id apart, so that many of them spread as well
    held = keep(held.withColumn("_tie", F.monotonically_increasing_id()), "strata")
    ranked = numbered(held, [F.col("_name"), F.col("_key"), F.col("_tie")], "strata-ranked", within="_name")
    sizes = keep(ranked.groupBy("_name").agg(F.count("*").alias("_n")), "strata-sizes")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    small = F.broadcast(sizes) if sizes.count() <= BROADCAST_SOURCES else sizes
    mixed = ranked.join(small, "_name") if total else ranked.withColumn("_n", F.lit(1))
    mixed = mixed.withColumn("_fraction", (2 * F.col("_at") + 1) / (2 * F.col("_n"))).drop("_at", "_n")
    placed = numbered(mixed, [F.col("_fraction"), F.col("_name"), F.col("_key"), F.col("_tie")], "strata-placed")
    out = placed.withColumn("_shard", F.expr(f"cast(_at * {shards} div {max(total, 1)} as int)"))
    first = F.expr(f"(_shard * {total}L + {shards - 1}) div {shards}")
    for df in (held, ranked, sizes):
        drop(df)
    return unboxed(out, rows.columns, shard=F.col("_shard"), slot=(F.col("_at") - first).cast("long"))


#: Sources up to which their sizes (a short row each) are broadcast; beyond, Spark splits the join of a large source.
BROADCAST_SOURCES = 10_000


def write_shards(docs: DataFrame, out: str, shards: int = SHARDS, seed: int = SEED, source: str = "source", doc_id: str = "doc_id") -> None:
    """Writes docs, all their columns, as Parquet to out, a folder shard=K for each shard; the files of a shard, in the order of their names, hold its rows by slot.

    Texts are stored once, and shuffled once to their shards. A column `shard` or `slot` of docs is replaced.
    """
    stored = keep(boxed(docs).withColumn("_own", F.monotonically_increasing_id()), "unsharded")
    thin = stored.select("_own", F.col("_row").getField(source).alias("source"), F.col("_row").getField(doc_id).alias("doc_id"))
    placed = interleave(thin, shards, seed)
    rows = unboxed(stored.join(placed.select("_own", "shard", "slot"), "_own"), docs.columns, shard=F.col("shard"), slot=F.col("slot"))
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(out)
    drop(placed)
    drop(stored)
