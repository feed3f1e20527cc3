"""Autocomplete and did-you-mean: ranked field rows; a document may come once a field, and attribute filters don't apply."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions import match
from siftwell.functions.highlight import align_highlights
from siftwell.operators import rank
from siftwell.plans.options import Autocomplete
from siftwell.plans.schema import IndexSchema


def suggested(norm: str, spec: Autocomplete) -> match.Query:
    """The query that a suggestion matches."""
    mode = "prefix" if spec.mode == "prefix" else "substring" if spec.fuzzy_distance else "fuzzy"
    return match.query_of(mode, norm, spec.typo)


def suggestions(schema: IndexSchema, prepared: DataFrame, text: str, norm: str, spec: Autocomplete, places: list[int] | None = None) -> DataFrame:
    """rank, text, score, type, matched_ranges, doc_id, doc of the best field rows.

    Each field is a projection of the same scan (an array of structs exploded inside the row); the ranges are found for the first rows alone.
    """
    query = suggested(norm, spec)
    chosen = schema.places([spec.field]) if spec.field is not None else places if places is not None else schema.places(None)
    rows = []
    for k in chosen:
        weight, own = schema.fields[k].weight, F.col(f"_n_{k}")
        hit = match.hit(own, query)
        rows.append(F.when(hit.isNotNull() & (F.length(f"_r_{k}") > 0), F.struct(F.col(f"_r_{k}").alias("text"), match.weighted(hit["score"], weight).alias("score"), F.lit(float(weight)).alias("field_weight"), (own == norm).alias("exact_match"), F.length(own).alias("matched_length"))))
    each = prepared.select("id", "doc", "doc_index", F.explode(F.array_compact(F.array(*rows))).alias("s")).select("id", "doc", "doc_index", "s.*")
    first = rank.top(each, rank.order(spec.tie_breakers, prepared.schema["id"].dataType), spec.limit)
    folded = schema.folded

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def look(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in align_highlights(t, query, folded)] for t in texts], dtype=object)

    kind = "completion" if spec.mode == "prefix" else "did-you-mean"
    return first.select("rank", "text", "score", F.lit(kind).alias("type"), look("text").alias("matched_ranges"), F.col("id").alias("doc_id"), "doc")
