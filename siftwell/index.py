"""SearchIndex (flat texts) and DocumentIndex (records): the library's front."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Mapping
from dataclasses import replace
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.errors import DuplicateIdError
from siftwell.functions.match import Query
from siftwell.operators.filters import FilterField
from siftwell.operators.suggest import suggested, suggestions
from siftwell.plans.options import Autocomplete, SearchOptions
from siftwell.plans.schema import IndexSchema, SearchField
from siftwell.plans.search import Response, Search, query_text
from siftwell.sources import prefixes
from siftwell.streaming.mutate import Batch, Outcome, Version, apply_batch, compact


class DocumentIndex:
    """Records under a schema. An index is a version: changes give a new one, and searches of the old one go on undisturbed."""

    def __init__(self, schema: IndexSchema, docs: DataFrame | Version, epoch: int = 0, lock: threading.Lock | None = None):
        self.schema, self.epoch = schema, epoch
        if isinstance(docs, Version):
            self.version = docs
        else:
            # a column of the user's own may have any name: the version's differs from all
            name = "_version"
            while name in docs.columns:
                name += "_"
            self.version = Version(docs.withColumn(name, F.lit(0)), schema.id, name)
        self.docs = self.version.docs()
        self.prepared, self._kept = self._prepared(self.docs), False
        #: One for all versions of an index: batches run one after another.
        self._lock = lock or threading.Lock()

    def _prepared(self, docs: DataFrame) -> DataFrame:
        mark = self.version.version
        plain = [c for c in docs.columns if c != mark]
        # the record without the version; the version first in the order of documents
        return self.schema.prepare(docs).withColumn("doc_index", F.struct(F.col(f"doc.{mark}"), F.col("doc_index.place"))).withColumn("doc", F.struct(*(F.col(f"doc.`{c}`") for c in plain)))

    def narrowed(self, query: Query | None, places: list[int], expression: Any) -> DataFrame:
        """The prepared documents, or those of the stored files alone that may match a query in those fields under a filter expression."""
        now, spark = self.version, self.docs.sparkSession
        if now.segment is None or self._kept:
            return self.prepared
        names = now.segment.chosen(spark, self.schema, query, places, expression)
        return self.prepared if names is None else self._prepared(replace(now, base=now.segment.read(now.base, names)).docs())

    @cached_property
    def bytes(self) -> int:
        """The size of the documents by Spark's estimate, made once: it takes a pass of the optimizer."""
        return self.docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()

    def known_documents(self) -> int | None:
        """The number of documents that the manifest of a restored index gives, until a batch changes it."""
        now = self.version
        return now.stored if now.segment is not None and not now.rows and not now.touched else None

    def sampled(self, share: float) -> DataFrame:
        """About a share of the prepared documents: of stored files if there are enough, else of rows before they are normalized."""
        now = self.version
        if self._kept:
            return self.prepared.sample(share, 1)
        if now.segment is not None and now.segment.files * share >= 2:
            names = sorted(f.rsplit("/", 1)[1] for f in now.base.inputFiles())
            return self._prepared(replace(now, base=now.segment.read(now.base, names[:: int(1 / share)])).docs())
        return self._prepared(self.docs.sample(share, 1))

    @classmethod
    def create(cls, docs: DataFrame, fields: list[SearchField | str], id: str = "id", filter_fields: list[FilterField] | tuple = (), case_sensitive: bool = False, hooks: Mapping[str, Callable] | None = None, validate: bool = True, **more: Any) -> DocumentIndex:
        """validate: look for repeated ids, one shuffle of the ids."""
        made = tuple(SearchField(f) if isinstance(f, str) else f for f in fields)
        index = cls(IndexSchema(made, id, tuple(filter_fields), case_sensitive, hooks=hooks or {}, **more), docs)
        if validate and (row := docs.groupBy(id).count().filter("count > 1").first()) is not None:
            raise DuplicateIdError(row[0])
        return index

    def persist(self) -> DocumentIndex:
        """Keeps normalized texts in memory for repeated queries."""
        self.prepared, self._kept = self.prepared.persist(), True
        return self

    def destroy(self) -> None:
        self.prepared.unpersist()
        self._kept = False

    def plan(self, query: str, **options: Any) -> Search:
        """A validated search, not yet run: its results, matched, facets and suggestions are lazy DataFrames."""
        return Search(self.schema, self.prepared, query, SearchOptions(**options), self.narrowed, self.sampled, self.known_documents(), lambda: self.bytes)

    def search(self, query: str, **options: Any) -> Response:
        return self.plan(query, **options).collect()

    def autocomplete(self, query: str, **options: Any) -> DataFrame:
        """Suggestions for a query; see Autocomplete for options."""
        spec = Autocomplete(**options)
        if spec.field is not None:
            self.schema.places([spec.field])
        norm = query_text(query, self.schema)
        places = self.schema.places(None if spec.field is None else [spec.field])
        if not norm:
            source = self.prepared.filter(F.lit(False))
        elif not self._kept and (few := prefixes.looked_up(self.docs.sparkSession, self.version, self.schema, norm, spec, places)) is not None:
            source = self._prepared(few.docs())
        else:  # of a stored index, the files that can hold a suggestion
            source = self.narrowed(suggested(norm, spec), places, None)
        return suggestions(self.schema, source, query, norm, spec)

    def apply_batch(self, add: DataFrame | None = None, update: DataFrame | None = None, remove: DataFrame | list | None = None, upsert: bool = False) -> tuple[DocumentIndex, Outcome]:
        """The next version and what changed. One batch at a time; nothing changes if any part is refused."""
        with self._lock:
            out = apply_batch(self.version, Batch(add, update, remove, upsert), number=self.epoch + 1)
        return DocumentIndex(self.schema, out.version, self.epoch + 1, self._lock), out

    def add(self, docs: DataFrame, upsert: bool = False) -> DocumentIndex:
        return self.apply_batch(add=docs, upsert=upsert)[0]

    def upsert(self, docs: DataFrame) -> DocumentIndex:
        return self.add(docs, upsert=True)

    def update(self, docs: DataFrame) -> DocumentIndex:
        return self.apply_batch(update=docs)[0]

    def remove(self, ids: DataFrame | list) -> DocumentIndex:
        return self.apply_batch(remove=ids)[0]

    def compact(self) -> DocumentIndex:
        """The same documents without the log of past batches, rewritten to the shared folder."""
        return DocumentIndex(self.schema, compact(self.version), self.epoch, self._lock)

    def save(self, root: str, name: str, decoupled: bool = False, files: int | None = None, cluster: list[str] | None = None) -> int:
        from siftwell.sources import snapshot

        return snapshot.save(self, root, name, decoupled, files, cluster)

    @staticmethod
    def restore(spark, root: str, name: str, schema: IndexSchema, version: int | None = None, docs: DataFrame | None = None, verify: bool | str = True) -> DocumentIndex:
        from siftwell.sources import snapshot

        return snapshot.load(spark, root, name, schema, version, docs, verify)

    def records(self) -> DataFrame:
        return self.docs.drop(self.version.version)

    def doc_ids(self) -> DataFrame:
        return self.docs.select(self.schema.id)

    def sorted_fields(self) -> list[SearchField]:
        return list(self.schema.fields)

    def stats(self) -> dict[str, Any]:
        """Counts of documents, rows (a document and a non-empty field) and normalized characters."""
        n = range(len(self.schema.fields))
        row = self.prepared.agg(F.count("*").alias("documents"), sum((F.count_if(F.length(f"_n_{k}") > 0) for k in n), F.lit(0)).alias("rows"), sum((F.coalesce(F.sum(F.length(f"_n_{k}")), F.lit(0)) for k in n), F.lit(0)).alias("tokens")).first()
        return {"documents": row.documents, "rows": row.rows, "tokens": row.tokens, "fields": [f.name for f in self.schema.fields], "filter_fields": sorted(self.schema.filters), "epoch": self.epoch, "tombstones": self.version.dead, "tombstone_ratio": self.version.ratio(), "case_sensitive": self.schema.case_sensitive, "engine": "spark", "at": time.time()}


class SearchIndex:
    """Flat texts by a number: the same plan with one field, ordered by falling score, then index."""

    def __init__(self, items: DataFrame, text: str = "text", index: str = "index", case_sensitive: bool = False, ascii_only: bool = False):
        schema = IndexSchema((SearchField(text),), index, case_sensitive=case_sensitive, ascii_only=ascii_only)
        self.inner = DocumentIndex(schema, items)

    @classmethod
    def create(cls, items: DataFrame, **options: Any) -> SearchIndex:
        return cls(items, **options)

    def plan(self, query: str, **options: Any) -> Search:
        for name in ("filter", "facets", "fields", "hooks", "autocomplete"):
            if options.get(name) is not None:
                raise TypeError(f"flat texts have no {name}")
        return self.inner.plan(query, **{"highlight": False, "tie_breakers": ("score", "id"), **options})

    def search(self, query: str, **options: Any) -> Response:
        return self.plan(query, **options).collect()

    def stats(self) -> dict[str, Any]:
        return self.inner.stats()

    def persist(self) -> SearchIndex:
        self.inner.persist()
        return self

    def destroy(self) -> None:
        self.inner.destroy()
