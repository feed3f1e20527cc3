"""Facet counts over matched documents. A facet leaves out the conjunctive conditions on its own field; counts are always exact."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.jsvalues import number_text
from siftwell.operators import filters
from siftwell.operators.filters import Fields, attribute, utf16_order
from siftwell.plans.options import Range, RangeFacet, TermsFacet

TERMS_SCHEMA = "value {0}, count bigint, rank int"
#: Spark types of values by kind of field; a tag is a string.
VALUES = {"string": "string", "string[]": "string", "number": "double", "boolean": "boolean"}
RANGE_SCHEMA = "key string, from double, to double, count bigint, rank int"


def terms(matched: DataFrame, facet: TermsFacet, kind: str) -> DataFrame:
    """value, count, rank: documents by value, each tag once a document, missing values left out."""
    from pyspark.sql import Window

    col = attribute(facet.field)
    rows = matched.select((F.explode(col) if kind == "string[]" else col).alias("value")).filter("value is not null")
    counts = rows.groupBy("value").agg(F.count("*").alias("count"))
    by_value = F.col("value").asc() if kind == "number" else utf16_order(F.col("value").cast("string")).asc()
    keys = [by_value] if facet.sort_by == "value" else [F.col("count").desc(), by_value]
    first = counts.orderBy(*keys).limit(facet.limit)
    return first.select("value", "count", F.row_number().over(Window.orderBy(*keys)).alias("rank"))


def range_key(start: float | None, end: float | None, key: str | None) -> str:
    return key if key is not None else f"{'*' if start is None else number_text(start)}-{'*' if end is None else number_text(end)}"


def _inside(col: Column, r: Range) -> Column:
    c = col.isNotNull()
    c = c & (col >= F.lit(float(r.start))) if r.start is not None else c
    return c & (col < F.lit(float(r.end))) if r.end is not None else c


def ranges(matched: DataFrame, facet: RangeFacet) -> DataFrame:
    """key, from, to, count, rank: half-open ranges in the order asked for, overlapping ones counted each, zeros kept. One pass."""
    col = attribute(facet.field)
    counts = matched.agg(*(F.count_if(_inside(col, r)).alias(f"c{k}") for k, r in enumerate(facet.ranges)))
    rows = [F.struct(F.lit(range_key(r.start, r.end, r.key)).alias("key"), F.lit(r.start).cast("double").alias("from"), F.lit(r.end).cast("double").alias("to"), F.col(f"c{k}").alias("count"), F.lit(k + 1).alias("rank")) for k, r in enumerate(facet.ranges)]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def facet(matched: DataFrame, spec: TermsFacet | RangeFacet, expr: Any, fields: Fields) -> DataFrame:
    """Counts of one facet over all matches of the query: filtered by the expression without the facet's own field."""
    if expr is not None:
        matched = matched.filter(filters.compile_filter(filters.without_field(expr, spec.field), fields, filtering=True))
    return terms(matched, spec, fields[spec.field].kind) if isinstance(spec, TermsFacet) else ranges(matched, spec)


def empty(spark: SparkSession, spec: TermsFacet | RangeFacet, kind: str) -> DataFrame:
    """The shape without matches, the same as with some: no terms, ranges of zero."""
    if isinstance(spec, TermsFacet):
        return spark.createDataFrame([], TERMS_SCHEMA.format(VALUES[kind]))
    return spark.createDataFrame(zeros(spec), RANGE_SCHEMA)


def zeros(spec: RangeFacet) -> list[tuple]:
    return [(range_key(r.start, r.end, r.key), None if r.start is None else float(r.start), None if r.end is None else float(r.end), 0, k + 1) for k, r in enumerate(spec.ranges)]


def tallies(matched: DataFrame, specs: list[TermsFacet | RangeFacet], expr: Any, fields: Fields) -> tuple[int, dict[str, list[Row]]]:
    """The number of matches under the whole expression, and the rows of every facet, from one pass over the query's matches.

    A match becomes a small row for each facet value it counts for; these are summed before they are shuffled, and of each facet only its first values reach the driver.
    """
    from pyspark.sql import Window

    def passes(e: Any) -> Column:
        return F.lit(True) if e is None else filters.compile_filter(e, fields)

    def one(place: int, bucket: int = 0, **value: Column) -> Column:
        typed = {"text": "string", "number": "double", "flag": "boolean"}
        return F.struct(F.lit(place).alias("place"), F.lit(bucket).alias("bucket"), *(value.get(n, F.lit(None)).cast(t).alias(n) for n, t in typed.items()))

    def tag(place: int):
        return lambda x: one(place, text=x)

    names = {"string": "text", "string[]": "text", "number": "number", "boolean": "flag"}
    lists = [F.array(F.when(passes(expr), one(-1)))]
    for k, spec in enumerate(specs):
        kind, col = fields[spec.field].kind, attribute(spec.field)
        open_ = passes(None if expr is None else filters.without_field(expr, spec.field))
        if isinstance(spec, RangeFacet):
            lists.append(F.array(*(F.when(open_ & _inside(col, r), one(k, j)) for j, r in enumerate(spec.ranges))))
        elif kind == "string[]":
            lists.append(F.when(open_ & col.isNotNull(), F.transform(col, tag(k))).otherwise(F.array()))
        else:
            lists.append(F.array(F.when(open_ & col.isNotNull(), one(k, **{names[kind]: col}))))
    each = matched.select(F.explode(F.array_compact(F.concat(*lists))).alias("v")).select("v.*")
    counts = each.groupBy("place", "bucket", "text", "number", "flag").agg(F.count("*").alias("count"))
    by_count = [k for k, f in enumerate(specs) if isinstance(f, TermsFacet) and f.sort_by == "count"]
    first = F.when(F.col("place").isin(*by_count), -F.col("count")) if by_count else F.lit(0)
    own = Window.partitionBy("place").orderBy(first, "bucket", "number", utf16_order(F.coalesce("text", F.col("flag").cast("string"))))
    most = {k: f.limit if isinstance(f, TermsFacet) else len(f.ranges) for k, f in enumerate(specs)}
    widest = max([1, *most.values()])
    got = counts.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= widest).collect()
    total = next((r["count"] for r in got if r.place == -1), 0)
    out: dict[str, list[Row]] = {}
    for k, spec in enumerate(specs):
        mine = sorted((r for r in got if r.place == k and r.rank <= most[k]), key=lambda r: r.rank)
        if isinstance(spec, TermsFacet):
            name = names[fields[spec.field].kind]
            out[spec.name] = [Row(value=r[name], count=r["count"], rank=r["rank"]) for r in mine]
        else:
            n = {r.bucket: r["count"] for r in mine}
            out[spec.name] = [Row(**dict(zip(("key", "from", "to", "count", "rank"), (*z[:3], n.get(j, 0), z[4]), strict=True))) for j, z in enumerate(zeros(spec))]
    return total, out
