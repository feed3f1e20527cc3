"""What the files of a stored table hold, so that a search opens only those that can match.

Beside a snapshot's table stand two small ones. `files` has a row a file: its rows, bytes, sum of row checksums, and of each filter field the least and greatest value
and the number of nulls. `grams` has, of each file and search field, a bitmap of the trigrams of its normalized texts, in pieces of Spark's bitmap
functions (a row a file, field and piece that holds any). A query says which trigrams a text must hold; files without them cannot match. Both tests leave files in doubt in, never
one that matches out. Tables may be written along a space-filling curve over filter fields, so that a condition on any of them leaves few files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.checksum import row_crc32
from siftwell.functions.match import Query, exact_head, pieces
from siftwell.functions.normalize import STEP_BYTES, runs
from siftwell.operators.filters import compile_bounds
from siftwell.plans.schema import IndexSchema

#: Bits of a file's trigrams in a field, and those of a row (fixed by Spark's bitmap functions).
BITS, PIECE = 1 << 18, 1 << 15
GRAM = 3
#: Characters whose trigrams are found at a time.
STEP_CHARS = 1 << 18
#: Trigrams of one term that are looked up at most: any of them may exclude a file.
LOOKED_UP = 12
#: Above this share of a table's files, or this many, a search reads the table as it is.
DENSE, MOST_FILES = 0.5, 10_000
#: Cells that a clustered field is cut into, by quantiles: 2 ** CELL_BITS.
CELL_BITS = 6

GRAMS = "file string, field int, piece int, bitmap binary"


def _positions(codes: np.ndarray) -> np.ndarray:
    """The bit of each trigram of code points; those with NUL, which separates texts, are left out."""
    if len(codes) < GRAM:
        return np.zeros(0, np.int64)
    a, b, c = (codes[k : len(codes) - GRAM + 1 + k].astype(np.uint64) for k in range(GRAM))
    h = (a << np.uint64(42)) ^ (b << np.uint64(21)) ^ c
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) & np.uint64(BITS - 1)).astype(np.int64)[(a > 0) & (b > 0) & (c > 0)]


def grams_of(term: str) -> list[int]:
    """Bits that a file with the term in some text has set: at most LOOKED_UP, spread over the term; none for a short one."""
    found = _positions(np.frombuffer(term.encode("utf-32-le", "surrogatepass"), np.uint32)).tolist()
    return found if len(found) <= LOOKED_UP else [found[k * len(found) // LOOKED_UP] for k in range(LOOKED_UP)]


def _codes(texts: pa.Array) -> Iterator[np.ndarray]:
    """Code points of texts, NUL between them, in steps that together hold every trigram: a step ends with what the trigrams begun in it need of the next."""
    for lo, hi in runs(texts, STEP_BYTES):
        text = "\0".join(t or "" for t in texts.slice(lo, hi - lo).to_pylist())
        for at in range(0, len(text), STEP_CHARS):
            yield np.frombuffer(text[at : at + STEP_CHARS + GRAM - 1].encode("utf-32-le"), np.uint32)


def _bitmaps(fields: int):
    """From rows (file, a normalized text a field) those of GRAMS, once a run of rows of a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, np.zeros((fields, BITS), bool)

        def close() -> pa.RecordBatch:
            bits = np.packbits(held.reshape(fields * BITS // PIECE, PIECE), axis=1, bitorder="little")
            some = np.flatnonzero(bits.any(axis=1))
            per = BITS // PIECE
            cols = [pa.array([now] * len(some), pa.string()), pa.array(some // per, pa.int32()), pa.array(some % per, pa.int32()), pa.array([bits[i].tobytes() for i in some], pa.binary())]
            held[:] = False
            return pa.RecordBatch.from_arrays(cols, ["file", "field", "piece", "bitmap"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            cuts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]] + [len(names)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if now is not None and names[lo] != now:
                    yield close()
                now = names[lo]
                for k in range(fields):
                    for codes in _codes(batch.column(k + 1).slice(lo, hi - lo)):
                        held[k, _positions(codes)] = True
        if now is not None:
            yield close()

    return run


def needed(q: Query, has: Callable[[int], Column]) -> Column | None:
    """The condition that a file with a match of the query meets, over the bits it has; None: any file may have one."""

    def every(grams: list[int]) -> Column | None:
        return reduce(lambda a, b: a & b, map(has, grams)) if grams else None

    def term(t: str) -> Column | None:
        out = every(grams_of(exact_head(q, t)))
        d, whole = q.typo.allowed(len(t)), grams_of(t)
        if d and len(whole) > 4 * d:  # an edit breaks three trigrams, a swap of neighbours four
            held = sum((F.when(has(p), 1).otherwise(0) for p in whole), F.lit(0)) >= len(whole) - 4 * d
            out = held if out is None else out & held
        some = [every(grams_of(p)) for p in pieces(q, t)]
        if some and all(c is not None for c in some):
            one = reduce(lambda a, b: a | b, some)
            out = one if out is None else out & one
        return out

    if q.mode == "fuzzy" or not q.text:
        return None
    if q.mode != "token":
        return term(q.prefix.head(q.text) if q.mode == "prefix" else q.text)
    each = [term(t) for t in q.terms]
    # of terms in doubt each may be there
    left = q.token.required(len(q.terms)) - sum(c is None for c in each)
    sure = [c for c in each if c is not None]
    return sum((F.when(c, 1).otherwise(0) for c in sure), F.lit(0)) >= left if left > 0 and sure else None


@dataclass(frozen=True)
class Segment:
    """A stored table of so many files, with its two descriptions in the folder above."""

    folder: str
    files: int
    #: Has it the lists of short prefixes (see prefixes)?
    prefixes: bool = False

    def chosen(self, spark: SparkSession, schema: IndexSchema, q: Query | None, places: list[int], expr: Any) -> list[str] | None:
        """Names of the files that may hold a match of q in the fields at places under a filter expression, by one small action; None: more than it is worth naming, or nothing to go by."""
        asked: set[int] = set()

        def note(position: int) -> Column:
            asked.add(position)
            return F.lit(True)

        found = None
        if q is not None and needed(q, note) is not None:
            grams = spark.read.schema(GRAMS).parquet(f"{self.folder}/grams").filter(F.col("piece").isin(*{p // PIECE for p in asked}) & F.col("field").isin(*places))
            bits = {(k, p): F.coalesce(F.max(F.when((F.col("field") == k) & (F.col("piece") == p // PIECE), _bit(p))), F.lit(False)).alias(f"b{k}_{p}") for k in places for p in sorted(asked)}
            tests = [needed(q, lambda p, k=k: F.col(f"b{k}_{p}")) for k in places]
            found = grams.groupBy("file").agg(*bits.values()).filter(reduce(lambda a, b: a | b, tests)).select("file")
        if expr is not None:
            zones = spark.read.parquet(f"{self.folder}/files")
            kept = zones.filter(compile_bounds(expr, schema.filters, _zone(schema))).select("file")
            found = kept if found is None else found.join(kept, "file", "left_semi")
        if found is None:
            return None
        most = min(MOST_FILES, int(DENSE * self.files))
        names = [r.file for r in found.limit(most + 1).collect()]
        return names if len(names) <= most else None

    def read(self, base: DataFrame, names: list[str] | None) -> DataFrame:
        """The table, or of it those files alone."""
        if names is None:
            return base
        if not names:  # Spark drops the scan
            return base.filter(F.lit(False))
        return base.sparkSession.read.schema(base.schema).parquet(*(f"{self.folder}/docs/{n}" for n in names))


def _bit(position: int) -> Column:
    at = position % PIECE
    byte = F.conv(F.hex(F.substring("bitmap", at // 8 + 1, 1)), 16, 10).cast("int")
    return F.shiftright(byte, at % 8).bitwiseAND(1) == 1


def _zone(schema: IndexSchema) -> Callable[[str], tuple[Column, Column, Column]]:
    place = {f.name: k for k, f in enumerate(schema.filter_fields)}
    return lambda name: (F.col(f"lo_{place[name]}"), F.col(f"hi_{place[name]}"), F.col(f"nulls_{place[name]}"))


def describe(spark: SparkSession, folder: str, docs: DataFrame, schema: IndexSchema) -> dict[str, Any]:
    """Writes files and grams of the table folder/docs (its schema is that of docs) beside it; rows and checksum of the whole, combined from the files, and their number and bytes."""
    df = spark.read.schema(docs.schema).parquet(f"{folder}/docs")
    rows = df.select("*", F.col("_metadata.file_name").alias("_stored_file"), F.col("_metadata.file_size").alias("_stored_size"), row_crc32(df).alias("_stored_crc"))
    typed = schema.typed(rows)
    zones = [a.alias(f"{n}_{k}") for k, f in enumerate(schema.filter_fields) if f.kind != "string[]" for n, a in (("lo", F.min(f"_a_{f.name}")), ("hi", F.max(f"_a_{f.name}")))]
    nulls = [F.count_if(F.col(f"_a_{f.name}").isNull()).alias(f"nulls_{k}") for k, f in enumerate(schema.filter_fields)]
    each = rows.select(F.col("_stored_file").alias("file"), "_stored_size", "_stored_crc", *typed).groupBy("file")
    each.agg(F.count("*").alias("rows"), F.max("_stored_size").alias("bytes"), F.sum("_stored_crc").alias("crc32_sum"), *zones, *nulls).coalesce(1).write.mode("overwrite").parquet(f"{folder}/files")
    prepared = schema.prepare(rows)
    texts = prepared.select(F.col("doc._stored_file").alias("file"), *(f"_n_{k}" for k in range(len(schema.fields))))
    grams = texts.mapInArrow(_bitmaps(len(schema.fields)), GRAMS).groupBy("file", "field", "piece").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    # by piece first: a probe reads the row groups of its pieces alone
    grams.repartitionByRange("piece", "field", "file").sortWithinPartitions("piece", "field", "file").write.mode("overwrite").parquet(f"{folder}/grams")
    total = spark.read.parquet(f"{folder}/files").agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("crc32_sum"), F.lit(0))).first()
    # a file without rows is described by nothing and counts all the same
    return dict(zip(("rows", "crc32_sum", "files", "bytes"), (*map(int, total), *sized(spark, folder)), strict=True))


def damaged(spark: SparkSession, folder: str, docs: DataFrame) -> list[str]:
    """Files of folder/docs whose rows are not those that were described, by one pass over the table."""
    now = docs.select(F.col("_metadata.file_name").alias("file"), row_crc32(docs).alias("_stored_crc")).groupBy("file").agg(F.count("*").alias("_n"), F.sum("_stored_crc").alias("_sum"))
    met = spark.read.parquet(f"{folder}/files").join(now, "file", "full")
    bad = met.filter(~(F.col("rows").eqNullSafe(F.col("_n")) & F.col("crc32_sum").eqNullSafe(F.col("_sum"))))
    return sorted(r.file for r in bad.select("file").limit(10).collect())


def clustered(docs: DataFrame, schema: IndexSchema, names: list[str], files: int | None) -> DataFrame:
    """docs in the order of a Z curve over the named filter fields: each is cut into cells of about equal numbers of rows, whose numbers' bits are interleaved.

    Only quantiles (63 a field) reach the driver. Strings are placed by their first six bytes; nulls come first.
    """
    known = schema.filters
    for n in names:
        if n not in known or known[n].kind == "string[]":
            raise ValueError(f"cannot cluster by {n!r}: a filter field that is no list")
    typed = dict(zip((f.name for f in schema.filter_fields), schema.typed(docs), strict=True))
    keys = []
    for n in names:
        c = typed[n]
        keys.append(F.conv(F.hex(F.rpad(F.substring(F.encode(c, "UTF-8"), 1, 6), 6, b"\0")), 16, 10).cast("double") if known[n].kind == "string" else c.cast("double"))
    marked = docs.select("*", *(k.alias(f"_k{i}") for i, k in enumerate(keys)))
    share = [q / (1 << CELL_BITS) for q in range(1, 1 << CELL_BITS)]
    bounds = marked.approxQuantile([f"_k{i}" for i in range(len(names))], share, 0.005)

    def cell(key: Column, cuts: list[float]) -> Column:
        """A number of CELL_BITS bits; fields of few values use its upper bits, too."""
        if not cuts:
            return F.lit(0)
        below = F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda b: b <= key)), F.lit(0))
        return F.floor(below * ((1 << CELL_BITS) - 1) / len(cuts)).cast("int")

    marked = marked.withColumns({f"_c{i}": cell(F.col(f"_k{i}"), sorted(set(own))) for i, own in enumerate(bounds)})
    bits = [F.shiftleft(F.shiftright(F.col(f"_c{i}"), b).bitwiseAND(1).cast("long"), b * len(names) + i) for i in range(len(names)) for b in range(CELL_BITS)]
    order = ["_z", *(f"_k{i}" for i in range(len(names)))]
    marked = marked.withColumn("_z", sum(bits, F.lit(0)))
    dealt = marked.repartitionByRange(files, *order) if files else marked.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order).select(*docs.columns)


def sized(spark: SparkSession, folder: str, table: str = "docs") -> tuple[int, int]:
    """Files and bytes of a table as its file system lists them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    own = [s.getLen() for s in (fs.listStatus(p) if fs.exists(p) else []) if s.getPath().getName().startswith("part-")]
    return len(own), sum(own)
