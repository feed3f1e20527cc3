"""From options and a prepared DataFrame to the plan of a search.

filter -> native match test -> scores of fields inside the row -> best field -> first rows in order -> highlights and hooks on those rows.
The attribute filter and the match test are plain Columns, so Catalyst moves them to the scan ahead of any UDF; only the top rows and facet groups are shuffled.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce
from typing import Any

import pandas as pd
from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.errors import CostBudgetExceededError, IncompatibleHookError, QueryTooLongError, SearchAbortedError
from siftwell.functions import match
from siftwell.functions.highlight import align_highlights, render_highlighted
from siftwell.functions.normalize import normalize_text, shortest
from siftwell.operators import facets as facet_ops
from siftwell.operators import rank
from siftwell.operators.filters import compile_filter, implied, without_field
from siftwell.operators.suggest import suggestions
from siftwell.plans.options import QUERY_MAX, Autocomplete, RangeFacet, SearchOptions, TermsFacet, facets_of, merged_hooks
from siftwell.plans.schema import IndexSchema, once

#: From so many documents and up to so many characters a query is called broad if it matches more than this share.
BROAD_DOCS, BROAD_TOKENS, BROAD_SHARE = 5000, 2, 0.8
#: Share of the documents that a first page is made of, and the size of a table (by Spark's estimate) from which that is done.
SAMPLE, BOUND_BYTES = 0.01, 1 << 28


def query_text(text: str, schema: IndexSchema, long_query: str = "error") -> str:
    """The normalized query. One over QUERY_MAX is refused, or scanned for all the same if long_query is "scan"."""
    if not isinstance(text, str):
        raise TypeError("a query is a string")
    norm = normalize_text(text, schema.folded)
    if len(norm) > QUERY_MAX and long_query == "error":
        raise QueryTooLongError(QUERY_MAX, len(norm), schema.profile)
    return norm


def terms_by_hook(hook: Callable, text: str, schema: IndexSchema) -> list[str]:
    """Terms of a tokenizer hook, each normalized; empty ones go."""
    try:
        got = list(hook(text))
    except Exception as e:
        raise IncompatibleHookError("tokenizer", str(e)) from e
    if not all(isinstance(t, str) for t in got):
        raise IncompatibleHookError("tokenizer", "it gives strings")
    return [t for t in (normalize_text(t, schema.folded) for t in got) if t]


@dataclass
class Search:
    """A validated search over a prepared DataFrame; every property is a lazy DataFrame or one aggregate."""

    schema: IndexSchema
    prepared: DataFrame
    text: str
    options: SearchOptions
    #: Gives, for the query, fields and a filter expression (or None), prepared documents that hold all that match: those of the stored files in question.
    narrowed: Callable[[match.Query, list[int], Any], DataFrame] | None = None
    #: Gives about a share of the prepared documents.
    sampled: Callable[[float], DataFrame] | None = None
    #: Their number, where it is known without counting.
    documents: int | None = None
    #: Gives the table's size by Spark's estimate.
    size: Callable[[], int] | None = None
    started: float = field(default_factory=time.monotonic)
    aborted: threading.Event = field(default_factory=threading.Event)

    def __post_init__(self) -> None:
        o = self.options
        self._sources: dict[str, DataFrame] = {}
        o.check_case(self.schema.case_sensitive)
        self.hooks = merged_hooks(self.schema.hooks, o.hooks or {})
        self.norm = query_text(self.text, self.schema, o.long_query)
        terms = terms_by_hook(self.hooks["tokenizer"], self.text, self.schema) if o.mode == "token" and "tokenizer" in self.hooks else None
        if o.mode == "prefix":
            o.prefix.head(self.norm)
        self.query = match.query_of(o.mode, self.norm, o.typo, o.token, o.prefix, terms)
        self.places = self.schema.places(list(o.fields) if o.fields is not None else None)
        if isinstance(o.highlight_fields, list | tuple):
            self.schema.places(list(o.highlight_fields))
        self.facet_specs = facets_of(o.facets)
        for f in self.facet_specs:
            if f.field not in self.schema.filters:
                raise ValueError(f"facet {f.name!r}: unknown field {f.field!r}")
            if isinstance(f, RangeFacet) and self.schema.filters[f.field].kind != "number":
                raise ValueError(f"facet {f.name!r}: ranges need a number field")
        structured = o.filter is not None and not callable(o.filter) and not isinstance(o.filter, Column)
        self.expression: Any = o.filter if structured else None
        self.condition = compile_filter(o.filter, self.schema.filters, filtering=True) if structured else None
        if isinstance(o.autocomplete, Autocomplete) and o.autocomplete.field is not None:
            self.schema.places([o.autocomplete.field])

    @property
    def nothing(self) -> bool:
        """Known before any scan: an empty query or no field to look in."""
        return not self.norm or not self.places

    def _predicates(self, df: DataFrame) -> DataFrame:
        """Function filters and the filter hook, on the record's columns (as doc.*)."""
        for p in (self.options.filter if self.expression is None else None, self.hooks.get("filter_predicate")):
            if p is not None:
                col = p if isinstance(p, Column) else p(df)
                df = df.filter(F.coalesce(col.cast("boolean"), F.lit(False)))
        return df

    def _source(self, expression: Any = None) -> DataFrame:
        """Prepared documents among which are all that match the query and the expression, which stands before any other work."""
        key = repr(expression)
        if key not in self._sources:
            df = self.prepared if self.narrowed is None or self.nothing else self.narrowed(self.query, self.places, expression)
            if expression:
                df = df.filter(compile_filter(expression, self.schema.filters, filtering=True))
                # typed values of doubles leave out NaN and infinities, which no scan can take over; their own columns can be compared there as well
                names = self.schema.doubles(df)
                if more := implied(expression, set(names)):
                    df = df.filter(compile_filter(more, self.schema.filters, at=lambda n: F.col("doc").getField(names[n]), filtering=True))
            self._sources[key] = df
        return self._sources[key]

    @cached_property
    def scored(self) -> DataFrame:
        """Matches of the query without the attribute filter: score, matched_field, field_weight, exact_match, matched_length, matches."""
        return self._scored(self._source())

    @cached_property
    def matched(self) -> DataFrame:
        """Matches under the attribute filter, which stands before scoring."""
        return self.scored if self.condition is None else self._scored(self._source(self.expression))

    @cached_property
    def best_matched(self) -> DataFrame:
        """Of matched, the rows that can come on the page.

        No score is above a bound that follows from a text's length. A page is made of a sample of the documents first; what scores less than its last row comes on no page of all, so
        texts too long for that are left out by their lengths: as they are stored, before they are normalized, and then as normalized, before they are tested or scored. Where scores
        are not what comes first, or the table is too small to be worth the sample (BOUND_BYTES), all matches are ranked: the page is the same.
        """
        o = self.options
        if self.nothing or self.sampled is None or not o.tie_breakers or o.tie_breakers[0] != "score" or self.size is None or self.size() < BOUND_BYTES:
            return self.matched
        source = self._source(self.expression)
        some = self.sampled(SAMPLE) if self.condition is None else self.sampled(SAMPLE).filter(self.condition)
        found = self._scored(some).select("score").orderBy(F.col("score").desc()).limit(o.limit)
        least = F.coalesce(found.agg(F.when(F.count("*") >= o.limit, F.min("score")).alias("least")).scalar(), F.lit(-(2**31)))

        def reach(size: Callable[[int], Column]) -> Column:
            bounds = [match.weighted(match.most(size(k), self.query), self.schema.fields[k].weight) for k in self.places]
            return (F.greatest(*bounds) if len(bounds) > 1 else bounds[0]) >= least

        return self._scored(source.filter(reach(lambda k: shortest(F.col(f"_r_{k}")))).filter(reach(lambda k: F.length(f"_n_{k}"))))

    @property
    def shared_filter(self) -> Any:
        """What the total and every facet keep of the filter: the expression without the conditions that some facet leaves out."""
        return reduce(lambda e, f: without_field(e, f.field), self.facet_specs, self.expression) if self.expression is not None else None

    def _hits(self, df: DataFrame) -> DataFrame:
        """The rows that match, by the match test alone where that is enough: counting needs no scores."""
        if self.nothing or not self.query.native:
            return self._scored(df)
        return self._predicates(df).filter(self._any())

    def _any(self) -> Column:
        return reduce(lambda a, b: a | b, (match.matches(F.col(f"_n_{k}"), self.query) for k in self.places))

    def _scored(self, df: DataFrame) -> DataFrame:
        if self.nothing:
            df = df.filter(F.lit(False))
        df = self._predicates(df)
        fields = self.schema.fields
        if self.places:
            df = df.filter(self._any())
        if self.places:
            df = once(df, {f"_s_{k}": match.weighted(match.hit(F.col(f"_n_{k}"), self.query)["score"], fields[k].weight) for k in self.places})
        hits = [(fields[k].name, fields[k].weight, F.col(f"_s_{k}")) for k in self.places] or [(fields[0].name, 1.0, F.lit(None).cast("int"))]
        if self.query.native and self.places:  # the match test has let through matches only
            df = df.withColumn("_best", rank.best_field(hits))
        else:
            df = once(df, {"_best": rank.best_field(hits)}).filter("_best is not null")
        own = reduce(lambda a, k: F.when(F.col("_best.field") == fields[k].name, F.col(f"_n_{k}")).otherwise(a), self.places, F.lit(""))
        out = df.withColumn("_own", own).withColumns({"score": F.col("_best.score"), "matched_field": F.col("_best.field"), "field_weight": F.col("_best.weight"), "exact_match": F.col("_own") == self.norm, "matched_length": F.length("_own")})
        return out.withColumn("matches", rank.other_fields(hits, F.col("_best"))) if len(self.places) > 1 else out.withColumn("matches", F.lit(None).cast("array<struct<field:string,score:int>>"))

    @cached_property
    def results(self) -> DataFrame:
        """The page: rank, id, doc, score, matched_field, matches, highlights (and highlighted_text under a tag)."""
        keys = rank.order(tuple(self.options.tie_breakers), self.prepared.schema["id"].dataType)
        page = rank.top(self.best_matched, keys, self.options.limit)
        if self.options.highlight:
            page = self._highlighted(page)
        if "scoring_hook" in self.hooks:
            new = self.hooks["scoring_hook"](page)
            if not isinstance(new, Column):
                raise IncompatibleHookError("scoring_hook", "it gives a Column of whole numbers")
            whole = F.when((new == F.floor(new)) & (F.abs(new) < 2**31), new.cast("int")).otherwise(F.raise_error(F.lit("scoring_hook gave no finite whole number")).cast("int"))
            from pyspark.sql import Window

            page = page.withColumn("score", whole).withColumn("rank", F.row_number().over(Window.orderBy(*keys)))
        columns = ["rank", "id", "doc", "score", "matched_field", "matches", *[c for c in ("highlights", "highlighted_text") if c in page.columns]]
        page = page.select(*columns)
        return page.transform(self.hooks["post_process"]) if "post_process" in self.hooks else page

    def _highlighted(self, page: DataFrame) -> DataFrame:
        """Ranges by field, after the limit: only the page's texts travel to Python."""
        o, query, folded = self.options, self.query, self.schema.folded
        names = [f.name for f in self.schema.fields]
        rule = o.highlight_fields

        @F.pandas_udf("struct<highlights:map<string,array<struct<start:int,end:int>>>,texts:map<string,string>>")
        def look(raw: pd.Series, own: pd.Series, others: pd.Series) -> pd.DataFrame:
            out = []
            for texts, best, more in zip(raw, own, others, strict=True):
                matched = [best, *(more if more is not None else [])]
                chosen = [best] if rule == "matched-field" else matched if rule == "all-matched" else names if rule == "all-fields" else list(rule)
                ranges = {n: align_highlights(texts[names.index(n)], query, folded) for n in chosen}
                if rule not in ("matched-field", "all-matched"):
                    ranges = {n: r for n, r in ranges.items() if r}
                shown = {n: render_highlighted(texts[names.index(n)], r, o.tag, o.escape_html) for n, r in ranges.items()} if o.tag else {}
                out.append(({n: [{"start": a, "end": b} for a, b in r] for n, r in ranges.items()}, shown))
            return pd.DataFrame(out, columns=["highlights", "texts"])

        raw = F.array(*(F.col(f"_r_{k}") for k in range(len(names))))
        page = page.withColumn("_look", look(raw, F.col("matched_field"), F.transform("matches", lambda x: x["field"])))
        page = page.withColumn("highlights", F.col("_look.highlights"))
        return page.withColumn("highlighted_text", F.col("_look.texts")) if o.tag else page

    @cached_property
    def counts(self) -> dict[str, int]:
        """total_matches (documents that match under all filters)."""
        return {"total_matches": 0 if self.nothing else self._hits(self._source(self.expression)).select("id").count()}

    @cached_property
    def filter_is_empty(self) -> bool:
        """Does the attribute filter alone leave no document? A scan that stops at the first one."""
        return self.condition is not None and self.prepared.filter(self.condition).select("id").isEmpty()

    @cached_property
    def facets(self) -> dict[str, DataFrame]:
        """A DataFrame a facet. Matches of the query before the filter are filtered anew for each, without its own field."""
        spark = self.prepared.sparkSession
        if self.nothing or self.facet_specs and self.filter_is_empty:
            return {f.name: facet_ops.empty(spark, f, self.schema.filters[f.field].kind) for f in self.facet_specs}
        return {f.name: facet_ops.facet(self._hits(self._source(None if self.expression is None else without_field(self.expression, f.field))), f, None, self.schema.filters) for f in self.facet_specs}

    @cached_property
    def suggestions(self) -> DataFrame | None:
        """Inline suggestions; none on an empty query or filter."""
        spec = self.options.autocomplete
        if not isinstance(spec, Autocomplete) or self.nothing or self.filter_is_empty:
            return None
        return suggestions(self.schema, self.prepared, self.text, self.norm, spec, self.places)

    def abort(self) -> None:
        """Stops a running collect() of this search; it raises SearchAbortedError there."""
        self.aborted.set()
        self.prepared.sparkSession.sparkContext.cancelJobsWithTag(self._tag)

    @property
    def _tag(self) -> str:
        return f"siftwell-{id(self)}"

    def collect(self) -> Response:
        """Runs the search within its budget."""
        budget, spark = self.options.budget, self.prepared.sparkSession
        tag, timer, late = self._tag, None, threading.Event()
        if self.aborted.is_set():
            raise SearchAbortedError("aborted before it ran")
        if budget.max_candidates is not None:
            documents = self.prepared.select("id").count() if self.documents is None else self.documents
            n = documents * max(1, len(self.places))
            if n > budget.max_candidates:
                raise CostBudgetExceededError("candidates", budget.max_candidates, n)
        if budget.max_execution_time_ms is not None:

            def stop() -> None:
                late.set()
                spark.sparkContext.cancelJobsWithTag(tag)

            timer = threading.Timer(budget.max_execution_time_ms / 1000, stop)
            timer.start()
        spark.sparkContext.addJobTag(tag)
        try:
            t = time.monotonic()
            # the page, and all counts from one more pass, side by side
            steps: dict[str, Callable[[], Any]] = {"counts": self._tallied} if self.nothing else {"rows": self.results.collect, "counts": self._tallied}
            if self.options.diagnostics:
                steps["documents"] = self._documents
            got = at_once(spark, steps)
            rows, (total, facets), counted = got.get("rows", []), got["counts"], time.monotonic()
            suggested = self.suggestions.orderBy("rank").collect() if self.suggestions is not None else None
        except Exception as e:
            if self.aborted.is_set():
                raise SearchAbortedError("aborted while it ran") from e
            if late.is_set():
                raise CostBudgetExceededError("time", budget.max_execution_time_ms or 0, (time.monotonic() - self.started) * 1000) from e
            raise
        finally:
            if timer is not None:
                timer.cancel()
            spark.sparkContext.removeJobTag(tag)
        out = Response(self.norm and self.text, rows, total, facets, suggested)
        if self.options.diagnostics:
            docs, kept = got["documents"]
            share = total / docs if docs else 0.0
            warnings = [f"broad query: {share:.0%} of {docs} documents match"] if docs >= BROAD_DOCS and len(self.norm) <= BROAD_TOKENS and share > BROAD_SHARE else []
            out.diagnostics = {"engine": "spark", "native": self.query.native, "documents": docs, "filter_selectivity": kept / docs if docs and self.condition is not None else 1.0, "scan_ms": (counted - t) * 1000, "total_ms": (time.monotonic() - self.started) * 1000, "warnings": warnings}
        return out

    def _tallied(self) -> tuple[int, dict[str, list]]:
        """total_matches and the rows of all facets. An attribute filter that leaves no document leaves no facets; any match shows that it leaves some."""
        if self.nothing:
            total, facets = 0, None
        else:
            # conditions that all counts keep go down to the scan, the rest is tested for each
            shared = self.shared_filter
            total, facets = facet_ops.tallies(self._hits(self._source(shared)), self.facet_specs, self.expression if shared != self.expression else None, self.schema.filters)
            if total:
                self.__dict__["filter_is_empty"] = False
        if facets is None or not total and self.facet_specs and self.filter_is_empty:
            facets = {k: df.orderBy("rank").collect() for k, df in self.facets.items()}
        return total, facets

    def _documents(self) -> tuple[int, int]:
        """Documents, and those that the attribute filter leaves."""
        kept = F.count("*") if self.condition is None else F.count_if(compile_filter(self.expression, self.schema.filters))
        row = self.prepared.agg(F.count("*").alias("docs"), kept.alias("kept")).first()
        return row.docs, row.kept


def at_once(spark: SparkSession, steps: dict[str, Callable[[], Any]]) -> dict[str, Any]:
    """Runs actions side by side, each in a thread that has this one's job tags; the first failure is raised when all have ended."""
    done: dict[str, Any] = {}
    failed: list[Exception] = []

    def run(name: str, step: Callable[[], Any]) -> None:
        try:
            done[name] = step()
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    first, *more = steps.items()
    threads = [InheritableThread(target=run, args=item, session=spark) for item in more]
    for th in threads:
        th.start()
    run(*first)
    for th in threads:
        th.join()
    if failed:
        raise failed[0]
    return done


@dataclass
class Response:
    query: str
    results: list
    total_matches: int
    facets: dict[str, list]
    suggestions: list | None = None
    is_approximate: bool = False
    diagnostics: dict | None = None

    @property
    def candidate_count(self) -> int:
        return self.total_matches

    @property
    def has_overflow(self) -> bool:
        """Nothing is ever cut before ranking here."""
        return False


class Latest:
    """Runs searches one after another for one caller: a newer one aborts the one before it."""

    def __init__(self) -> None:
        self._lock, self._now = threading.Lock(), None

    def run(self, search: Search) -> Response:
        with self._lock:
            before, self._now = self._now, search
        if before is not None:
            before.abort()
        try:
            return search.collect()
        finally:
            with self._lock:
                if self._now is search:
                    self._now = None


__all__ = ["Latest", "Response", "Search", "TermsFacet"]
