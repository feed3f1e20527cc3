"""Completions of short prefixes of a stored table without a scan: of each prefix and field the documents that come first.

A query of up to LENGTH characters is the beginning of so many words that no list of files is short. Beside a snapshot's base stands a table with, of each such prefix and
search field, the KEPT documents that rank first for it, in the order of suggestions, with their files; it is dealt by ranges of prefixes, so a lookup reads one or two files. What ranks first for a
prefix does not change with what else is typed, since the query is the prefix itself. Documents that later batches touched are left out of a list, and their rows come from the
batches; a list that has become too short for a page is not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.normalize import runs
from siftwell.functions.windows import STEP_CHARS, Texts
from siftwell.operators import rank
from siftwell.plans.options import TIE_BREAKERS, Autocomplete
from siftwell.plans.schema import IndexSchema
from siftwell.streaming.mutate import Version

#: Characters of the longest prefix, and documents kept of each.
LENGTH, KEPT = 3, 50


def _found(texts: list[str], ids: np.ndarray, weight: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, place, length of prefix, score, exact, length of text) of what ranks among the first KEPT of a prefix within these texts. ids: their places in the order of ids."""
    all_ = Texts.of(texts)
    heads = all_.heads()
    row = all_.row(heads)
    sizes = all_.ends - all_.starts
    for n in range(1, LENGTH + 1):
        own = np.flatnonzero(heads + n <= all_.ends[row])
        at, r = heads[own], row[own]
        key = np.zeros(len(at), np.uint64)
        for k in range(n):
            key = (key << np.uint64(21)) | all_.codes[at + k].astype(np.uint64)
        # places ascend, so of each text and prefix the first comes first
        order = np.argsort(key, kind="stable")
        key, at, r = key[order], at[order], r[order]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (r[1:] != r[:-1])
        key, at, r = key[first], at[first], r[first]
        place = at - all_.starts[r]
        score = 1000 - 10 * place - (sizes[r] - n) + np.where(place == 0, 40, 0)
        score = np.floor(score * weight + 0.5).astype(np.int64)
        exact = (place == 0) & (sizes[r] == n)
        order = np.lexsort((ids[r], sizes[r], ~exact, -score, key))
        new = np.flatnonzero(np.diff(key[order], prepend=key[order][:1] + np.uint64(1))) if len(order) else order
        count = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
        some = order[count < KEPT]
        yield r[some], place[some], np.full(len(some), n), score[some], exact[some], sizes[r[some]]


def _ranked(ids: pa.Array) -> np.ndarray:
    """Each id's place in the order of ids: numbers as such, strings by UTF-16 units."""
    values = ids.to_pylist()
    keys = [v.encode("utf-16-be", "surrogatepass") if isinstance(v, str) else v for v in values]
    out = np.empty(len(values), np.int64)
    out[sorted(range(len(values)), key=keys.__getitem__)] = np.arange(len(values))
    return out


def _lists(weights: list[float], out_schema: pa.Schema):
    """From (file, id, a normalized text a field): candidates of each prefix and field, the first KEPT of a run of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for field, weight in enumerate(weights):
                texts = batch.column(field + 2)
                for lo, hi in runs(texts, STEP_CHARS):
                    part, ids = [t or "" for t in texts.slice(lo, hi - lo).to_pylist()], batch.column(1).slice(lo, hi - lo)
                    for r, place, n, score, exact, size in _found(part, _ranked(ids), weight):
                        if len(r):
                            names = [part[i][a : a + k] for i, a, k in zip(r.tolist(), place.tolist(), n.tolist(), strict=True)]
                            took = pa.array(r)
                            cols = [pa.array(names), pa.array(np.full(len(r), field), pa.int32()), batch.column(0).slice(lo, hi - lo).take(took), ids.take(took), pa.array(score), pa.array(exact), pa.array(size)]
                            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, out_schema, strict=True)], schema=out_schema)

    return run


def describe(prepared: DataFrame, folder: str, schema: IndexSchema) -> bool:
    """Writes the lists of the stored documents (prepared, with their file as doc._stored_file) to folder/prefixes; False for ids of mixed kinds, which have none."""
    kind = prepared.schema["id"].dataType
    if not isinstance(kind, T.IntegralType | T.StringType):
        return False
    out = T.StructType([T.StructField("prefix", T.StringType()), T.StructField("field", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("id", kind), T.StructField("score", T.LongType()), T.StructField("exact_match", T.BooleanType()), T.StructField("matched_length", T.LongType())])
    arrow = pa.schema([(f.name, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "smallint": pa.int16(), "tinyint": pa.int8()}[f.dataType.simpleString()]) for f in out.fields])
    texts = prepared.select(F.col("doc._stored_file").alias("file"), "id", *(f"_n_{k}" for k in range(len(schema.fields))))
    each = texts.mapInArrow(_lists([f.weight for f in schema.fields], arrow), out)
    keys = [F.col("score").desc(), F.col("exact_match").desc(), F.col("matched_length").asc(), *rank.id_keys(kind)]
    first = each.withColumn("place", F.row_number().over(Window.partitionBy("prefix", "field").orderBy(*keys))).filter(F.col("place") <= KEPT)
    first.select("prefix", "field", "place", "file", "id").repartitionByRange("prefix", "field").sortWithinPartitions("prefix", "field", "place").write.mode("overwrite").parquet(f"{folder}/prefixes")
    return True


def looked_up(spark: SparkSession, version: Version, schema: IndexSchema, norm: str, spec: Autocomplete, places: list[int]) -> Version | None:
    """The version cut to the stored documents that can be on the page of suggestions for a short prefix, and all that batches wrote; None where the lists do not tell."""
    segment = version.segment
    if segment is None or not segment.prefixes or not 0 < len(norm) <= LENGTH or spec.mode != "prefix" or spec.fuzzy_distance or spec.limit > KEPT or tuple(spec.tie_breakers) != TIE_BREAKERS:
        return None
    # at most KEPT rows a field
    rows = spark.read.parquet(f"{segment.folder}/prefixes").filter((F.col("prefix") == norm) & F.col("field").isin(*places)).collect()
    ids = {r.id for r in rows}
    dead: set = set()
    if version.touched and ids:
        for df in version.touched:
            dead |= {r[0] for r in df.filter(F.col(version.key).isin(*ids)).select(version.key).collect()}
    for k in places:
        own = [r.id for r in rows if r.field == k]
        if len(own) == KEPT and sum(i not in dead for i in own) < spec.limit:
            return None
    files = sorted({r.file for r in rows if r.id not in dead})
    base = segment.read(version.base, files)
    return replace(version, base=base.filter(F.col(f"`{version.key}`").isin(*ids)) if files else base)

