"""Reading the tables of a scale folder and keeping intermediate tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Where intermediate tables go if the cluster names no shared folder (tests on one machine).
LOCAL_SHARED = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, read from the session. Where it is unset LOCAL_SHARED will do on one machine; several would not see each other's files."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return named or LOCAL_SHARED


#: Folders that keep() has written within scratch(), in order.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Lists the folders of all tables that are kept meanwhile, so that whoever knows what is still read can delete the rest."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there and any executor can read it."""
    path = f"{shared_dir(df.sparkSession)}/siftwell/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of keep(); one that is gone already is no error."""
    if "/siftwell/" in folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(df: DataFrame) -> None:
    """Deletes a table made by keep(), once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def boxed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The rows of docs as one struct `_row` beside the given columns, so that no name of docs can clash with an operator's own."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *(c.alias(n) for n, c in columns.items()))


def unboxed(df: DataFrame, names: list[str], **new: Column) -> DataFrame:
    """The columns of `_row` with the new ones: one of an old name stands in its place, others follow."""
    cols = [new.pop(c).alias(c) if c in new else F.col("_row").getField(c).alias(c) for c in names]
    return df.select(*cols, *(c.alias(n) for n, c in new.items()))


#: Entries (some 40 bytes each) of a table of partitions up to which it is broadcast; beyond, rows meet it by shuffle.
BROADCAST_PARTS = 250_000


def numbered(df: DataFrame, order: list[Column], name: str, within: str | None = None) -> DataFrame:
    """df as a kept table with `_at`, each row's place from 0 in the given order, or its place among the rows that share `within`, which must lead the order then.

    A range shuffle deals rows by the order and a sort numbers them within their partition; what meets in one place is a count for each partition and value of
    `within` in it. No value of `within`, however frequent, is gathered. Rows equal in all of order are numbered in any way; they may fill one partition.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_own_id", F.monotonically_increasing_id())
    # the id holds the partition above 33 bits and the row in it below
    ranged = ranged.withColumn("_own_part", F.shiftright("_own_id", 33).cast("int")).withColumn("_own_row", F.col("_own_id").bitwiseAND(F.lit((1 << 33) - 1)))
    ranged = keep(ranged.drop("_own_id"), name)
    keys = ["_own_part"] + ([within] if within else [])
    parts = ranged.groupBy(*keys).agg(F.count("*").alias("_own_n"), F.min("_own_row").alias("_own_first"))
    before = Window.partitionBy(*([within] if within else [])).orderBy("_own_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = keep(parts.select(*keys, (F.coalesce(F.sum("_own_n").over(before), F.lit(0)) - F.col("_own_first")).alias("_own_before")), f"{name}-parts")
    met = F.broadcast(parts) if parts.count() <= BROADCAST_PARTS else parts
    out = ranged.join(met, keys).withColumn("_at", F.col("_own_row") + F.col("_own_before")).drop("_own_part", "_own_row", "_own_before")
    out = keep(out, f"{name}-numbered")
    drop(ranged)
    drop(parts)
    return out
