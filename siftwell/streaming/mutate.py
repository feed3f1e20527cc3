"""Batches of changes: remove, then update, then add, all or nothing. Each batch makes a new version; the old one stays as it is.

A version is a base table and a log: rows written since, and ids that a batch touched with the batch's number. A row lives if no later batch
touched its id. However many batches there were, reading a version is one union and one join with the touched ids.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.errors import DocumentNotFoundError, DuplicateIdError, IncompatibleIndexError
from siftwell.sources import shared

#: Share of dead rows, over all batches since the last compaction, from which a version is compacted.
COMPACT = 0.25


@dataclass(frozen=True)
class Batch:
    """add and update: DataFrames with the columns of documents; remove: ids, as a list or a DataFrame of one column."""

    add: DataFrame | None = None
    update: DataFrame | None = None
    remove: DataFrame | list | None = None
    upsert: bool = False


@dataclass(frozen=True)
class Version:
    """base: documents with the column `version`; rows and touched (key, _number): a table a batch; dead of all stored rows are replaced or removed."""

    base: DataFrame
    key: str
    version: str = "_version"
    rows: tuple[DataFrame, ...] = ()
    touched: tuple[DataFrame, ...] = ()
    dead: int = 0
    stored: int | None = field(default=None, compare=False)
    #: What is known of the files of base (Segment), if it is a stored table.
    segment: Any = field(default=None, compare=False)

    def docs(self) -> DataFrame:
        """The live rows."""
        out = reduce(DataFrame.unionByName, self.rows, self.base)
        if not self.touched:
            return out
        last = reduce(DataFrame.unionByName, self.touched).groupBy(self.key).agg(F.max("_number").alias("_number"))
        live = out.join(last, self.key, "left").filter(f"_number is null or `{self.version}` >= _number")
        return live.select(*self.base.columns)

    def ratio(self) -> float:
        return self.dead / self.stored if self.stored else 0.0


@dataclass(frozen=True)
class Outcome:
    version: Version
    added: int
    updated: int
    removed: int
    compacted: bool

    @property
    def docs(self) -> DataFrame:
        return self.version.docs()


def last_of(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row an id: that of the greatest _order if there is such a column, else any."""
    rest = [c for c in columns if c != key]
    by = F.col("_order") if "_order" in rows.columns else F.lit(0)
    return rows.groupBy(key).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in rest)), by).alias("_v")).select(key, "_v.*").select(*columns)


def apply_batch(now: Version, batch: Batch, number: int) -> Outcome:
    """now after a batch. Changed and added rows get the batch's number and so come last. One action checks and counts.

    Removing an unknown id does nothing. Updating an unknown or just removed id, a repeated update, and adding a known id fail before anything changes; with
    upsert, added rows replace known ones and of repeated ones any last (greatest by _order if there, else one of them) stays.
    """
    key, spark = now.key, now.base.sparkSession
    plain = [c for c in now.base.columns if c != now.version]
    for df in (batch.add, batch.update):
        if df is not None and set(df.columns) - {"_order"} != set(plain):
            raise IncompatibleIndexError(sorted(plain), sorted(df.columns))
    ids = now.base.select(key).schema
    gone = None
    if batch.remove is not None:
        gone = (batch.remove if isinstance(batch.remove, DataFrame) else spark.createDataFrame([(x,) for x in batch.remove], ids)).toDF(key).select(F.col(key).cast(ids[0].dataType))
    add = batch.add
    if add is not None and batch.upsert:
        add = last_of(add, key, plain)
    parts = [(gone, "_r"), (batch.update, "_u"), (add, "_a")]
    each = [df.select(key, *(F.lit(1 if n == c else 0).alias(c) for c in ("_r", "_u", "_a"))) for df, n in parts if df is not None]
    if not each:
        return Outcome(now, 0, 0, 0, False)
    asked = reduce(DataFrame.unionByName, each).groupBy(key).agg(*(F.sum(c).alias(c) for c in ("_r", "_u", "_a")))
    # a mark for known ids; documents are read for their ids alone
    known = now.docs().select(key, F.lit(True).alias("_known"))
    met = asked.join(known, key, "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    left = F.col("_known") & (F.col("_r") == 0)
    held = left | (F.col("_u") > 0)
    new = F.lit(not batch.upsert)

    def first(cond):  # noqa: ANN001, ANN202
        return F.min(F.when(cond, F.struct(F.lit(1).alias("x"), F.col(key).alias("id"))))

    got = met.agg(
        first(F.col("_u") > 1).alias("twice"), first((F.col("_u") > 0) & ~left).alias("unknown"), first(new & (F.col("_a") > 1)).alias("repeated"), first(new & (F.col("_a") > 0) & held).alias("there"),
        F.count_if((F.col("_r") > 0) & F.col("_known")).alias("removed"), F.coalesce(F.sum("_u"), F.lit(0)).alias("updated"), F.coalesce(F.sum("_a"), F.lit(0)).alias("added"), F.count_if((F.col("_a") > 0) & held).alias("replaced"),
    ).first()
    for bad, error in ((got.twice, DuplicateIdError), (got.unknown, DocumentNotFoundError), (got.repeated, DuplicateIdError), (got.there, DuplicateIdError)):
        if bad is not None:
            raise error(bad.id)
    update = batch.update
    if update is not None and add is not None and batch.upsert:  # of an update and an added row of one id the added one stays
        update = update.join(add.select(key), key, "left_anti")
    rows = [df.select(*plain).withColumn(now.version, F.lit(number)) for df in (update, add) if df is not None]
    after = replace(now, rows=(*now.rows, *rows), touched=(*now.touched, asked.select(key, F.lit(number).alias("_number"))))
    stored = now.base.count() if now.stored is None else now.stored
    after = replace(after, dead=now.dead + got.removed + got.updated + got.replaced, stored=stored + got.updated + got.added)
    compacted = after.ratio() >= COMPACT
    return Outcome(compact(after) if compacted else after, got.added - got.replaced, got.updated + got.replaced, got.removed, compacted)


def compact(now: Version) -> Version:
    """The live rows alone, written to the shared folder: no log, nothing dead."""
    base = shared.kept(now.docs(), "compacted")
    return Version(base, now.key, now.version, stored=base.count())
