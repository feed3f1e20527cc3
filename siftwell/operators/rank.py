"""Ranking: the best field of a document, the others that matched, and the order of results. No shuffle until the final top rows meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.operators.filters import utf16_order


def best_field(hits: list[tuple[str, float, Column]]) -> Column:
    """From (name, weight, weighted score or null) by falling weight: struct<score, field, weight, place>, null if none matched.

    An array inside the row takes the place of a group by: the highest score, then the earlier field.
    """
    each = [F.when(score.isNotNull(), F.struct(score.alias("score"), F.lit(-k).alias("back"), F.lit(name).alias("field"), F.lit(float(weight)).alias("weight"), F.lit(k).alias("place"))) for k, (name, weight, score) in enumerate(hits)]
    return F.array_max(F.array_compact(F.array(*each)))


def other_fields(hits: list[tuple[str, float, Column]], best: Column) -> Column:
    """The other matched fields (field, score), by falling score, then name; null without any."""
    each = [F.when(score.isNotNull() & (F.lit(k) != best["place"]), F.struct((-score).alias("back"), F.lit(name).alias("field"), score.alias("score"))) for k, (name, _, score) in enumerate(hits)]
    out = F.transform(F.array_sort(F.array_compact(F.array(*each))), lambda x: F.struct(x["field"].alias("field"), x["score"].alias("score")))
    return F.when(F.size(out) > 0, out)


def mixed_id(number: Column, text: Column) -> Column:
    """An id of a table whose ids are numbers in some rows and strings in others: number where it is one, else text."""
    both = F.struct(number.cast("double").alias("number"), text.cast("string").alias("text"))
    return F.when(number.isNotNull() | text.isNotNull(), both)


def id_keys(kind: T.DataType) -> list[Column]:
    """Numbers before strings; strings by UTF-16 units. Ids of both kinds are those of mixed_id."""
    if isinstance(kind, T.StructType):
        return [F.col("id.number").asc_nulls_last(), utf16_order(F.col("id.text")).asc()]
    return [utf16_order(F.col("id")).asc() if isinstance(kind, T.StringType) else F.col("id").asc()]


def order(tie_breakers: tuple[str, ...], id_kind: T.DataType) -> list[Column]:
    """Sort keys over columns score, field_weight, exact_match, matched_length, id, doc_index."""
    keys = {
        "score": [F.col("score").desc()],
        "field_weight": [F.col("field_weight").desc()],
        "exact_match": [F.col("exact_match").desc()],
        "matched_length": [F.col("matched_length").asc()],
        "id": id_keys(id_kind),
    }
    return [k for t in tie_breakers for k in keys[t]] + [F.col("doc_index").asc()]


def top(df: DataFrame, keys: list[Column], limit: int) -> DataFrame:
    """The first rows in order, numbered from 1 in rank. Each task keeps its own first rows; only those meet."""
    from pyspark.sql import Window

    first = df.orderBy(*keys).limit(limit)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*keys)))
