"""Queries over options, records and their changes: what queries.py leaves, with SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.errors import ConflictError, SearchError
from siftwell.functions.normalize import ascii_text
from siftwell.functions.typo import osa
from siftwell.index import DocumentIndex
from siftwell.operators import idsets
from siftwell.operators.filters import FilterField
from siftwell.operators.rank import mixed_id
from siftwell.plans.options import Budget, PrefixMatch, Typo
from siftwell.plans.schema import SearchField
from siftwell.queries import DOC, HAS_THE, PART_FIELDS, add, doc_page, documents, fuzzy_page, lit, multifield, norm, page, part_page, parts, ranked, ranges_sql, read, sql_fuzzy, sql_prefix, sql_substring, sql_token, terms_sql
from siftwell.sources import shared, snapshot
from siftwell.streaming.ingest import ingest

# --- match options ---------------------------------------------------------------------------------------------------

add("prefix_length", lambda s, d: part_page(s, d, "small brush", mode="prefix", prefix=PrefixMatch(prefix_length=3)), multifield(lambda n: sql_prefix(n, "sma"), "small brush"))
add("typo_short_term_is_exact", lambda s, d: doc_page(s, d, "the", mode="substring", typo=Typo(enabled=True), limit=80), ranked("documents", sql_substring(DOC, "the"), DOC, "doc_id", "the", 80))
add("typo_leaves_fuzzy", lambda s, d: doc_page(s, d, "Thing", typo=Typo(enabled=True), limit=30), fuzzy_page("documents", "doc_id", DOC, "thing", 30))
add("empty_query", lambda s, d: doc_page(s, d, " \t ", mode="substring"), "SELECT CAST(0 AS INTEGER) AS rank, doc_id AS id, CAST(0 AS INTEGER) AS score FROM documents WHERE FALSE")


def _osa(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    return words.select("p_partkey", "word", osa(F.col("word"), "wigdet", 2).alias("distance"))


#: Within two edits of this term no word of the table tells the alignment distance from the unrestricted one.
add("osa_distance", _osa, "SELECT p_partkey, word, CAST(least(3, damerau_levenshtein(word, 'wigdet')) AS INTEGER) AS distance FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)")
add("legacy_ascii", lambda s, d: read(s, d, "documents").select("doc_id", ascii_text(F.col("text")).alias("ascii")).filter(r"not ascii rlike '[?]'"), r"SELECT doc_id, strip_accents(text) AS ascii FROM documents WHERE NOT regexp_matches(strip_accents(text), '[^\x00-\x7F]') AND NOT contains(text, '?')")

# --- filters ---------------------------------------------------------------------------------------------------------


def _filtered(name: str, expr: Any, where: str) -> None:
    add(name, lambda s, d: doc_page(s, d, "the", mode="substring", filter=expr, limit=100), ranked("documents", sql_substring(DOC, "the"), DOC, "doc_id", "the", 100, where))


_filtered("filter_empty_and", {"and": []}, "TRUE")
_filtered("filter_empty_or", {"or": [], "lang": "en"}, "FALSE")
_filtered("filter_function", lambda df: (F.col("doc.n_chars") % 7 == 0) & (F.col("doc.lang") != "fr"), "n_chars % 7 = 0 AND lang <> 'fr'")
_filtered("filter_string_order", {"lang": {"gte": "e", "lt": "fr"}, "n_chars": {"neq": 100}}, "lang >= 'e' AND lang < 'fr' AND n_chars <> 100")


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents(spark, sf_dir)

    def found(query: str) -> DataFrame:
        return idsets.of(index.plan(query, mode="substring").matched)

    a, b, every = found("idiot"), found("the"), idsets.of(index.prepared)
    out = {"and": idsets.intersect(a, b), "or": idsets.union(a, b), "and_not": idsets.subtract(b, a), "xor": idsets.either(a, b), "not": idsets.complement(b, every)}
    first, *rest = [df.select(F.lit(k).alias("op"), "id") for k, df in out.items()]
    for df in rest:
        first = first.union(df)
    return first


_A, _B = f"contains({DOC}, 'idiot')", f"contains({DOC}, 'the')"
add("idset_algebra", _sets, "\nUNION ALL ".join(f"SELECT '{k}' AS op, doc_id AS id FROM documents WHERE {w}" for k, w in {"and": f"{_A} AND {_B}", "or": f"{_A} OR {_B}", "and_not": f"{_B} AND NOT {_A}", "xor": f"{_A} <> {_B}", "not": f"NOT {_B}"}.items()))

# --- facets, the whole search ----------------------------------------------------------------------------------------

_FACETS = [{"field": "lang", "name": "languages", "sort_by": "value"}, {"field": "source", "limit": 4}, {"field": "n_chars", "type": "range", "ranges": [{"to": 500}, {"from": 500}]}, {"field": "tags", "limit": 7}]
_FILTER = {"lang": ["de", "en"], "n_chars": {"lt": 5000}}


def _whole(spark: SparkSession, sf_dir: str, query: str, **options: Any) -> DataFrame:
    """Of one search() the total and every facet, as rows (part, value, count, rank)."""
    got = documents(spark, sf_dir).search(query, mode="substring", highlight=False, facets=_FACETS, **options)
    rows = [("total", None, got.total_matches, 0)]
    rows += [(name, str(r["value"] if "value" in r else r["key"]), r["count"], r["rank"]) for name, facet in got.facets.items() for r in facet]
    return spark.createDataFrame(rows, "part string, value string, count bigint, rank int")


def _whole_sql(matched: str, langs: str, sizes: str) -> str:
    """langs, sizes: the filter's conditions on lang and on n_chars."""
    order, both = "count DESC, value", f"{matched} AND {langs} AND {sizes}"
    by_range = ranges_sql(f"{matched} AND {langs}", [("*-500", "NULL", "500", "n_chars < 500"), ("500-*", "500", "NULL", "n_chars >= 500")])
    facets = {"languages": terms_sql("lang", f"{matched} AND {sizes}", "value", 10), "source": terms_sql("source", both, order, 4), "tags": terms_sql("unnest(list_distinct([lang, source]))", both, order, 7)}
    rows = [f"SELECT '{k}' AS part, CAST(value AS VARCHAR) AS value, count, rank FROM ({q})" for k, q in facets.items()]
    return "\nUNION ALL ".join([f"SELECT 'total' AS part, NULL AS value, count(*) AS count, 0 AS rank FROM documents WHERE {both}", f"SELECT 'n_chars' AS part, key AS value, count, rank FROM ({by_range})", *rows])


add("search_at_once", lambda s, d: _whole(s, d, "the", filter=_FILTER), _whole_sql(HAS_THE, "lang IN ('de', 'en')", "n_chars < 5000"))
add("search_facet_mode", lambda s, d: _whole(s, d, "the", facet_mode="approximate"), _whole_sql(HAS_THE, "TRUE", "TRUE"))
add("search_without_matches", lambda s, d: _whole(s, d, "no such words", filter=_FILTER), _whole_sql("FALSE", "TRUE", "TRUE"))
add("search_empty_filter", lambda s, d: _whole(s, d, "the", filter={"lang": "xx"}), _whole_sql("FALSE", "TRUE", "TRUE"))


def _typed_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).plan("a", mode="substring", highlight=False, facets={"f": {"field": "p_size", "limit": 12}}).facets["f"]


_PART_A = " OR ".join(f"contains({norm(f.name)}, 'a')" for f in PART_FIELDS)
add("number_facet", _typed_facet, terms_sql("CAST(p_size AS DOUBLE)", _PART_A, "count DESC, value", 12, "part"))


def _diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents(spark, sf_dir).search("the", mode="substring", highlight=False, filter={"lang": "de"}, diagnostics=True)
    d = found.diagnostics
    return spark.createDataFrame([(d["documents"], float(d["filter_selectivity"]), d["native"], found.candidate_count, found.has_overflow)], "documents bigint, selectivity double, native boolean, candidates bigint, overflow boolean")


add("diagnostics", _diagnostics, f"SELECT count(*) AS documents, count(*) FILTER (WHERE lang = 'de') / count(*) AS selectivity, TRUE AS native, count(*) FILTER (WHERE lang = 'de' AND {HAS_THE}) AS candidates, FALSE AS overflow FROM documents")

# --- highlights, ids -------------------------------------------------------------------------------------------------


def _fuzzy_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parts(spark, sf_dir).plan("wdgt", fields=["p_name"], limit=60)
    return found.results.select("rank", "id", F.explode(F.col("highlights")["p_name"]).alias("r")).select("rank", "id", F.col("r.start").alias("start"), F.col("r.end").alias("end"))


add(
    "highlight_union",
    _fuzzy_ranges,
    f"""WITH {sql_fuzzy("part", "p_partkey", norm("p_name"), "wdgt")}, r AS (SELECT row_number() OVER (ORDER BY floor(score * 2.0 + 0.5) DESC, s = 'wdgt' DESC, length(s), id) AS rank, * FROM fuzzy),
p AS (SELECT rank, id, unnest([p1, p2, p3, p4]) - 1 AS place, unnest([1, 2, 3, 4]) AS k FROM r WHERE rank <= 60), g AS (SELECT rank, id, place, place - k AS run FROM p)
SELECT CAST(rank AS INTEGER) AS rank, id, CAST(min(place) AS INTEGER) AS "start", CAST(max(place) + 1 AS INTEGER) AS "end" FROM g GROUP BY rank, id, run""",
)


def _field_rule(rule: Any) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = parts(spark, sf_dir).plan("a", mode="substring", highlight_fields=rule, limit=100)
        each = found.results.select("rank", "id", F.explode("highlights").alias("field", "ranges"))
        return each.select("rank", "id", "field", F.col("ranges")[0]["start"].alias("start"))

    return run


_RANKED = multifield(lambda n: sql_substring(n, "a"), "a", 100)
_RANKED = _RANKED[: _RANKED.rindex("SELECT CAST")] + "SELECT CAST(r.rank AS INTEGER) AS rank, r.id, b.matched_field AS field, CAST(instr(b.s, 'a') - 1 AS INTEGER) AS \"start\" FROM r JOIN b ON b.id = r.id{0} WHERE r.rank <= 100"
add("highlight_all_matched", _field_rule("all-matched"), _RANKED.format(""))
add("highlight_matched_field", _field_rule("matched-field"), _RANKED.format(" AND b.best = 1"))
add("highlight_named_fields", _field_rule(["p_type"]), _RANKED.format(" AND b.matched_field = 'p_type'"))


def _mixed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    key = mixed_id(F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey").cast("double")), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("k"), F.col("c_custkey").cast("string"))))
    index = DocumentIndex.create(c.withColumn("key", key), ["c_mktsegment"], id="key", validate=False)
    found = index.plan("build", mode="substring", highlight=False, limit=60)
    return found.results.select("rank", F.coalesce(F.col("id.text"), F.col("id.number").cast("bigint").cast("string")).alias("id"), "score")


add("mixed_ids", _mixed_ids, f"SELECT CAST(rank AS INTEGER) AS rank, id, score FROM (SELECT row_number() OVER (ORDER BY score DESC, c_custkey % 3 > 0, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END, 'k' || c_custkey) AS rank, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'k' END || c_custkey AS id, score FROM (SELECT c_custkey, CAST({sql_substring(norm('c_mktsegment'), 'build')} AS INTEGER) AS score FROM customer) WHERE score IS NOT NULL) WHERE rank <= 60")

# --- changes ---------------------------------------------------------------------------------------------------------


def customers(spark: SparkSession, sf_dir: str) -> DocumentIndex:
    return DocumentIndex.create(read(spark, sf_dir, "customer"), ["c_name"], id="c_custkey", validate=False)


def _changed(spark: SparkSession, sf_dir: str) -> DocumentIndex:
    """Three batches: updates, removals, then additions."""
    c = read(spark, sf_dir, "customer")
    index = customers(spark, sf_dir).update(c.filter("c_nationkey = 3").withColumn("c_acctbal", F.lit(0.0)))
    index = index.remove(c.filter("c_custkey % 11 = 0").select("c_custkey"))
    return index.add(c.filter("c_custkey % 11 = 0 and c_nationkey < 9").withColumn("c_mktsegment", F.lit("BACK")))


_CHANGED = """SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey = 3 THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment, CASE WHEN c_nationkey = 3 THEN 1 ELSE 0 END AS batch FROM customer WHERE c_custkey % 11 <> 0
UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal, 'BACK', 3 FROM customer WHERE c_custkey % 11 = 0 AND c_nationkey < 9"""
add("update_batch", lambda s, d: _changed(s, d).records(), f"SELECT * EXCLUDE (batch) FROM ({_CHANGED})")
add(
    "update_placement",
    lambda s, d: page(_changed(s, d).plan("00", mode="substring", highlight=False, tie_breakers=("score",), limit=200)),
    f"SELECT CAST(rank AS INTEGER) AS rank, id, score FROM (SELECT row_number() OVER (ORDER BY score DESC, batch, c_custkey) AS rank, c_custkey AS id, score FROM (SELECT c_custkey, batch, CAST({sql_substring(norm('c_name'), '00')} AS INTEGER) AS score FROM ({_CHANGED})) WHERE score IS NOT NULL) WHERE rank <= 200",
)


def _tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts after each of three removals of a tenth: the third reaches a quarter and compacts."""
    c, index, rows = read(spark, sf_dir, "customer"), customers(spark, sf_dir), []
    for k in range(3):
        index, out = index.apply_batch(remove=c.filter(F.col("c_custkey") % 10 == k).select("c_custkey"))
        said = index.stats()
        rows.append((k, said["documents"], out.removed, said["tombstones"], out.compacted, index.epoch))
    return spark.createDataFrame(rows, "batch int, documents bigint, removed bigint, tombstones bigint, compacted boolean, epoch int")


add(
    "compaction",
    _tombstones,
    "SELECT CAST(k AS INTEGER) AS batch, count(*) FILTER (WHERE c_custkey % 10 > k) AS documents, count(*) FILTER (WHERE c_custkey % 10 = k) AS removed, CASE WHEN k = 2 THEN 0 ELSE count(*) FILTER (WHERE c_custkey % 10 <= k) END AS tombstones, k = 2 AS compacted, CAST(k + 1 AS INTEGER) AS epoch FROM customer, range(3) AS r(k) GROUP BY k",
)


def _place(spark: SparkSession) -> tuple[str, str]:
    return f"{shared.folder(spark)}/siftwell/snapshots", f"q-{uuid.uuid4().hex}"


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved, appended to twice (the second delta is written whole), read back with checksums held."""
    root, name = _place(spark)
    index, c = customers(spark, sf_dir), read(spark, sf_dir, "customer")
    index.save(root, name)
    snapshot.append(c.filter("c_custkey % 20 = 1").withColumn("c_acctbal", F.lit(1.0)), root, name, index.schema, removed=c.filter("c_custkey % 20 = 2").select("c_custkey"))
    snapshot.append(c.filter("c_custkey % 4 = 3").withColumn("c_custkey", F.col("c_custkey") + 10_000_000), root, name, index.schema)
    return DocumentIndex.restore(spark, root, name, index.schema).records()


add("snapshot_deltas", _snapshot, "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 20 = 1 THEN 1.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 20 <> 2 UNION ALL SELECT c_custkey + 10000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 4 = 3")


def _decoupled(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, name = _place(spark)
    index = customers(spark, sf_dir)
    index.save(root, name, decoupled=True)
    back = DocumentIndex.restore(spark, root, name, index.schema, docs=read(spark, sf_dir, "customer"))
    return page(back.plan("0001", mode="substring", highlight=False))


add("snapshot_decoupled", _decoupled, ranked("customer", sql_substring(norm("c_name"), "0001"), norm("c_name"), "c_custkey", "0001"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rare substring over a snapshot of many files, of which only those whose trigrams allow it are opened; the page is kept, the snapshot goes."""
    root, name = _place(spark)
    index = documents(spark, sf_dir)
    index.save(root, name, files=120)
    back = DocumentIndex.restore(spark, root, name, index.schema)
    out = shared.kept(page(back.plan("license", mode="substring", highlight=False)), "page")
    snapshot.delete(spark, root, name)
    return out


add("snapshot_rare_substring", _segments, ranked("documents", sql_substring(DOC, "license"), DOC, "doc_id", "license"))


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions on two attributes over a snapshot laid along their Z curve: files whose bounds exclude them stay closed."""
    root, name = _place(spark)
    index = parts(spark, sf_dir)
    index.save(root, name, files=32, cluster=["p_size", "p_retailprice"])
    back = DocumentIndex.restore(spark, root, name, index.schema)
    found = back.plan("e", mode="substring", filter={"p_size": {"gte": 10, "lt": 14}, "p_retailprice": {"gt": 904, "lte": 940}}, highlight=False, limit=200, fields=["p_name"])
    out = shared.kept(page(found), "page")
    snapshot.delete(spark, root, name)
    return out


add("snapshot_clustered_filter", _clustered, ranked("part", sql_substring(norm("p_name"), "e"), norm("p_name"), "p_partkey", "e", 200, "p_size >= 10 AND p_size < 14 AND p_retailprice > 904 AND p_retailprice <= 940", 2.0))


def _committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches made upon one version: of disjoint ids both land, the second upon the first; a third that touches an id of the first is refused."""
    root, name = _place(spark)
    index, c = customers(spark, sf_dir), read(spark, sf_dir, "customer")
    since = index.save(root, name)
    snapshot.append(c.filter("c_custkey % 30 = 1").withColumn("c_acctbal", F.lit(1.0)), root, name, index.schema, since=since)
    snapshot.append(c.filter("c_custkey % 30 = 2").withColumn("c_acctbal", F.lit(2.0)), root, name, index.schema, since=since)
    try:
        snapshot.append(c.filter("c_custkey % 30 in (1, 3)").withColumn("c_acctbal", F.lit(3.0)), root, name, index.schema, since=since)
    except ConflictError:
        pass
    return DocumentIndex.restore(spark, root, name, index.schema).records()


add("snapshot_conflicts", _committed, "SELECT * REPLACE (CASE c_custkey % 30 WHEN 1 THEN 1.0 WHEN 2 THEN 2.0 ELSE c_acctbal END AS c_acctbal) FROM customer")


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifest of a snapshot says, and the names of snapshots after one of two is deleted."""
    root, name = _place(spark)
    index = parts(spark, sf_dir)
    index.save(root, name)
    index.save(root, name)
    said = snapshot.manifest(spark, root, name)
    rows = [("version", str(said["version"])), ("documents", str(said["documents"])), ("fields", ",".join(f["name"] for f in said["schema"]["fields"])), ("versions", ",".join(map(str, snapshot.versions(spark, root, name))))]
    snapshot.delete(spark, root, name)
    rows.append(("after delete", ",".join(map(str, snapshot.versions(spark, root, name)))))
    return spark.createDataFrame(rows, "key string, value string")


add("snapshot_manifest", _manifest, "SELECT 'version' AS key, '2' AS value UNION ALL SELECT 'documents', CAST(count(*) AS VARCHAR) FROM part UNION ALL SELECT 'fields', 'p_name,p_type,p_brand' UNION ALL SELECT 'versions', '1,2' UNION ALL SELECT 'after delete', ''")


def _ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of all customers with new balances, upserted into an index of those of even keys."""
    root, name = _place(spark)
    c = read(spark, sf_dir, "customer")
    index = DocumentIndex.create(c.filter("c_custkey % 2 = 0"), ["c_name"], id="c_custkey", validate=False)
    stream = spark.readStream.schema(c.schema).option("pathGlobFilter", "customer.parquet").parquet(f"{sf_dir}/customer.parque[t]").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    ingest(stream, index, root, name, f"{root}/{name}-stream").awaitTermination()
    return DocumentIndex.restore(spark, root, name, index.schema).records()


add("ingest_stream", _ingested, "SELECT * REPLACE (c_acctbal + 1 AS c_acctbal) FROM customer")

# --- refusals --------------------------------------------------------------------------------------------------------


def _refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must be refused before anything runs, and the error of each."""
    docs, c = documents(spark, sf_dir), customers(spark, sf_dir)
    good = DocumentIndex.create(read(spark, sf_dir, "labels").withColumn("good", F.lit(True)), [SearchField("quality")], id="doc_id", filter_fields=[FilterField("good", "boolean")], validate=False)
    two = read(spark, sf_dir, "customer").filter("c_custkey = 1")

    def plan(index: DocumentIndex = docs, query: str = "a", **options: Any) -> Callable[[], Any]:
        return lambda: index.plan(query, **options)

    cases: dict[str, Callable[[], Any]] = {
        "range on tags": plan(filter={"tags": {"gt": "a"}}),
        "range on boolean": plan(good, filter={"good": {"lt": True}}),
        "unknown field": plan(filter={"nothing": 1}),
        "unknown operator": plan(filter={"lang": {"like": "a"}}),
        "and without a list": plan(filter={"and": {"lang": "de"}}),
        "no boolean": plan(good, filter={"good": "perhaps"}),
        "no number": plan(filter={"n_chars": {"lt": "many"}}),
        "tie-breakers repeated": plan(tie_breakers=("score", "score")),
        "no tie-breakers": plan(tie_breakers=()),
        "other scorer": plan(scorer="bm25"),
        "other mode": plan(mode="regex"),
        "long query": plan(query="x" * 129),
        "case of another profile": plan(case_sensitive=True),
        "prefix longer than the query": plan(mode="prefix", prefix=PrefixMatch(prefix_length=5)),
        "facet of ranges on text": plan(facets={"lang": {"type": "range", "ranges": [{"to": 1}]}}),
        "too many facets": plan(facets={f"f{k}": {"field": "lang"} for k in range(33)}),
        "range turned round": plan(facets={"n_chars": {"type": "range", "ranges": [{"from": 2, "to": 1}]}}),
        "too many candidates": lambda: docs.search("a", budget=Budget(max_candidates=1)),
        "add a known id": lambda: c.add(two),
        "update an unknown id": lambda: c.update(two.withColumn("c_custkey", F.lit(-1).cast("bigint"))),
        "update a removed id": lambda: c.apply_batch(update=two, remove=[1]),
        "other columns": lambda: c.add(two.drop("c_name")),
    }
    rows = []
    for what, run in cases.items():
        try:
            run()
            rows.append((what, "none"))
        except (SearchError, ValueError, TypeError) as e:
            rows.append((what, type(e).__name__))
    return spark.createDataFrame(rows, "what string, error string")


_REFUSED = {
    "InvalidFilterError": ("range on tags", "range on boolean", "unknown field", "unknown operator", "and without a list", "no boolean", "no number"),
    "IncompatibleOptionError": ("tie-breakers repeated", "no tie-breakers", "other scorer", "other mode", "too many facets", "range turned round"),
    "QueryTooLongError": ("long query",), "ProfileMismatchError": ("case of another profile",), "ValueError": ("prefix longer than the query", "facet of ranges on text"),
    "CostBudgetExceededError": ("too many candidates",), "DuplicateIdError": ("add a known id",), "DocumentNotFoundError": ("update an unknown id", "update a removed id"), "IncompatibleIndexError": ("other columns",),
}
add("refusals", _refusals, "SELECT * FROM (VALUES " + ", ".join(f"({lit(w)}, '{e}')" for e, what in _REFUSED.items() for w in what) + ") AS t(what, error)")
add("long_query_scanned", lambda s, d: doc_page(s, d, "x" * 200, mode="substring", long_query="scan"), ranked("documents", sql_substring(DOC, "x" * 200), DOC, "doc_id", "x" * 200))
_MANY = ["thing", "that", "tion"] * 9
add("long_query_matches", lambda s, d: doc_page(s, d, " ".join(_MANY), mode="token", long_query="scan"), ranked("documents", sql_token(DOC, _MANY, len(_MANY)), DOC, "doc_id", " ".join(_MANY)))
