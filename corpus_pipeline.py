"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, mixing to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept; run() writes each result as Parquet in the shared folder, reads it
back as the next stage's documents, and deletes it when that stage is written. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import linededup, mixing, ngramjoin, packing, toxicity
from siftwell.llm.queries import tokenizer_path, training_labels
from siftwell.llm.tables import delete, keep, scratch, table

#: A line is boilerplate of a source if over 2 % of its documents hold it, five at least.
LINE_RATIO, LINE_MIN = 0.02, 5


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.5; the model is fitted on labelled rows outside the held-out fold."""
    model = toxicity.fit(table(spark, sf_dir, "documents").select("doc_id", "text"), training_labels(spark, sf_dir))
    return toxicity.reject(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a share of their source's documents repeat; n_chars follows the text. Documents all stay."""
    out = linededup.dedup_lines(docs, "text", "source", "doc_id", LINE_RATIO, LINE_MIN)
    same = [F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*same)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard similarity of 0.8 or more: that of the least doc_id."""
    return ngramjoin.representatives(docs, "text", "doc_id", words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes; a document with no copy goes."""
    return mixing.sample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 2048 tokens; copies of a document are packed each."""
    return packing.pack_documents(docs, tokenizer_path(), end_id=0, capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", join_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The model, the balance and best-fit packing are beyond SQL; tests/llm/test_pipeline.py holds stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch() as made:
            docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        # the stage's table, written last, is whole: what it was made from is read no more, the table before it included
        for folder in read + made[:-1]:
            delete(spark, folder)
        read = made[-1:]
    return docs
