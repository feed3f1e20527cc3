"""The search engine's queries over a scale folder, and SQL that says the same.

Every ranked result has an explicit rank. SQL texts are put together by the same rules as the plans: a score expression a mode, then an order.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.match import WORD_STARTS
from siftwell.functions.normalize import normalized
from siftwell.functions.tokenizers import code_tokenizer, split_column
from siftwell.index import DocumentIndex, SearchIndex
from siftwell.operators.filters import FilterField
from siftwell.plans.options import TokenMatch, Typo
from siftwell.plans.schema import SearchField
from siftwell.plans.search import Search


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_filters() -> list[FilterField]:
    return [FilterField("lang"), FilterField("source"), FilterField("n_chars", "number"), FilterField("tags", "string[]", F.array("lang", "source"))]


PART_FIELDS = [SearchField("p_name", 2.0), SearchField("p_type", 1.0), SearchField("p_brand", 0.5)]
PART_FILTERS = [FilterField("p_brand"), FilterField("p_type"), FilterField("p_size", "number"), FilterField("p_retailprice", "number")]


def documents(spark: SparkSession, sf_dir: str) -> DocumentIndex:
    return DocumentIndex.create(read(spark, sf_dir, "documents"), ["text"], id="doc_id", filter_fields=doc_filters(), validate=False)


def parts(spark: SparkSession, sf_dir: str) -> DocumentIndex:
    return DocumentIndex.create(read(spark, sf_dir, "part"), PART_FIELDS, id="p_partkey", filter_fields=PART_FILTERS, validate=False)


def flat(spark: SparkSession, sf_dir: str, table: str, index: str, text: str) -> SearchIndex:
    return SearchIndex(read(spark, sf_dir, table).select(F.col(index).alias("index"), F.col(text).alias("text")))


def page(search: Search) -> DataFrame:
    return search.results.select("rank", "id", "score")


def doc_page(spark: SparkSession, sf_dir: str, query: str, **options: Any) -> DataFrame:
    return page(documents(spark, sf_dir).plan(query, highlight=False, **options))


def part_page(spark: SparkSession, sf_dir: str, query: str, **options: Any) -> DataFrame:
    return parts(spark, sf_dir).plan(query, highlight=False, **options).results.select("rank", "id", "score", "matched_field")


# --- SQL -----------------------------------------------------------------------------------------------------------

NORM = "replace(lower(trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), 'ß', 'ss')"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def norm(column: str) -> str:
    return NORM.format(column)


def sql_substring(n: str, q: str) -> str:
    return f"CASE WHEN instr({n}, {lit(q)}) > 0 THEN 1000 - 10 * (instr({n}, {lit(q)}) - 1) - (length({n}) - {len(q)}) END"


def sql_prefix(n: str, q: str) -> str:
    """Places of the query behind a delimiter: found in the text with a blank put before it."""
    d = r"[\t\n\r !-/:-@\[-`{-~]"
    at = f"length(regexp_extract(' ' || {n}, {lit('(?s)^(.*?' + d + ')' + q)}, 1)) - 1"
    return f"CASE WHEN regexp_matches(' ' || {n}, {lit('(?s)' + d + q)}) THEN 1000 - 10 * ({at}) - (length({n}) - {len(q)}) + CASE WHEN ({at}) = 0 THEN 40 ELSE 0 END END"


def sql_token(n: str, terms: list[str], required: int) -> str:
    at = [f"instr({n}, {lit(t)})" for t in terms]
    found = " + ".join(f"(CASE WHEN {a} > 0 THEN 1 ELSE 0 END)" for a in at)
    base = " + ".join(f"(CASE WHEN {a} > 0 THEN 1010 - 10 * {a} ELSE 0 END)" for a in at)
    lens = " + ".join(f"(CASE WHEN {a} > 0 THEN {len(t)} ELSE 0 END)" for a, t in zip(at, terms, strict=True))
    first = "least(" + ", ".join(f"CASE WHEN {a} > 0 THEN {a} END" for a in at) + ")"
    last = "greatest(" + ", ".join(f"CASE WHEN {a} > 0 THEN {a} + {len(t)} END" for a, t in zip(at, terms, strict=True)) + ")"
    return f"CASE WHEN {found} >= {required} THEN ({base}) - (length({n}) - ({lens})) - 2 * greatest(0, {last} - {first} - ({lens})) END"


def sql_fuzzy(source: str, key: str, n: str, q: str, more: str = "") -> str:
    """A chain of steps: each finds the next character behind the one before. Gives key, score (and what more selects)."""
    steps = [f"f0 AS (SELECT {key} AS id, {n} AS s{more}, 0 AS p0, 0 AS first, 0 AS run, 100 AS score FROM {source})"]
    for k, c in enumerate(q, 1):
        at = f"instr(substr(s, p{k - 1} + 1), {lit(c)})"
        steps.append(f"g{k} AS (SELECT *, p{k - 1} + {at} AS p{k} FROM f{k - 1} WHERE {at} > 0)")
        run = "0" if k == 1 else f"CASE WHEN p{k} = p{k - 1} + 1 THEN run + 1 ELSE 0 END"
        word = f"CASE WHEN p{k} > 1 AND contains({lit(WORD_STARTS)}, substr(s, p{k} - 1, 1)) THEN 30 ELSE 0 END"
        first, head = (f"p{k}", f"CASE WHEN p{k} = 1 THEN 40 ELSE 0 END") if k == 1 else ("first", "0")
        steps.append(f"f{k} AS (SELECT * REPLACE ({run} AS run, {first} AS first, score + 15 + 10 * ({run}) + {word} + {head} AS score) FROM g{k})")
    m = len(q)
    steps.append(f"fuzzy AS (SELECT * REPLACE (score - 2 * (p{m} - first + 1 - {m}) - (length(s) - {m}) AS score) FROM f{m})")
    return ",\n".join(steps)


def ranked(source: str, score: str, n: str, key: str, q: str, limit: int = 50, where: str = "TRUE", weight: float = 1.0) -> str:
    """The page of one field under the full order."""
    return f"""WITH m AS (SELECT {key} AS id, CAST(floor(({score}) * {weight} + 0.5) AS INTEGER) AS score, {n} = {lit(q)} AS exact, length({n}) AS len FROM {source} WHERE {where}),
r AS (SELECT row_number() OVER (ORDER BY score DESC, exact DESC, len, id) AS rank, id, score FROM m WHERE score IS NOT NULL)
SELECT CAST(rank AS INTEGER) AS rank, id, score FROM r WHERE rank <= {limit}"""


def fuzzy_page(source: str, key: str, n: str, q: str, limit: int = 50, where: str = "TRUE") -> str:
    return f"""WITH {sql_fuzzy(f"(SELECT * FROM {source} WHERE {where})", key, n, q)},
r AS (SELECT row_number() OVER (ORDER BY score DESC, s = {lit(q)} DESC, length(s), id) AS rank, id, score FROM fuzzy)
SELECT CAST(rank AS INTEGER) AS rank, id, CAST(score AS INTEGER) AS score FROM r WHERE rank <= {limit}"""


DOC = norm("text")
TEXT = ("documents", DOC, "doc_id")


def multifield(score: Callable[[str], str], q: str, limit: int = 50, where: str = "TRUE") -> str:
    fields = [("p_name", 2.0), ("p_type", 1.0), ("p_brand", 0.5)]
    union = "\nUNION ALL ".join(f"SELECT p_partkey AS id, '{f}' AS matched_field, {k} AS place, {w} AS weight, CAST(floor(({score(norm(f))}) * {w} + 0.5) AS INTEGER) AS score, {norm(f)} AS s FROM part WHERE {where}" for k, (f, w) in enumerate(fields))
    return f"""WITH m AS ({union}), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, place) AS best FROM m WHERE score IS NOT NULL),
r AS (SELECT row_number() OVER (ORDER BY score DESC, weight DESC, s = {lit(q)} DESC, length(s), id) AS rank, id, score, matched_field FROM b WHERE best = 1)
SELECT CAST(rank AS INTEGER) AS rank, id, score, matched_field FROM r WHERE rank <= {limit}"""


# --- queries -------------------------------------------------------------------------------------------------------

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    Q[name] = fn
    if sql is not None:
        SQL[name] = sql


add("substring_topk", lambda s, d: doc_page(s, d, "thing", mode="substring"), ranked(*[TEXT[0], sql_substring(DOC, "thing"), DOC, "doc_id", "thing"]))
add("prefix_topk", lambda s, d: doc_page(s, d, "Than", mode="prefix"), ranked("documents", sql_prefix(DOC, "than"), DOC, "doc_id", "than"))
add("token_and_topk", lambda s, d: doc_page(s, d, "the, and-of", mode="token"), ranked("documents", sql_token(DOC, ["the", "and", "of"], 3), DOC, "doc_id", "the, and-of"))
add("token_or_topk", lambda s, d: doc_page(s, d, "idiot moron idiot", mode="token", token=TokenMatch("or")), ranked("documents", sql_token(DOC, ["idiot", "moron", "idiot"], 1), DOC, "doc_id", "idiot moron idiot"))
add("token_quorum_topk", lambda s, d: doc_page(s, d, "der die und", mode="token", token=TokenMatch(min_match_count=2)), ranked("documents", sql_token(DOC, ["der", "die", "und"], 2), DOC, "doc_id", "der die und"))
add("fuzzy_topk", lambda s, d: doc_page(s, d, "Thing", limit=30), fuzzy_page("documents", "doc_id", DOC, "thing", 30))
add("fuzzy_parts", lambda s, d: page(SearchIndex(read(s, d, "part").select(F.col("p_partkey").alias("index"), F.col("p_name").alias("text"))).plan("bwdgt")), f"WITH {sql_fuzzy('part', 'p_partkey', norm('p_name'), 'bwdgt')}, r AS (SELECT row_number() OVER (ORDER BY score DESC, id) AS rank, id, score FROM fuzzy) SELECT CAST(rank AS INTEGER) AS rank, id, CAST(score AS INTEGER) AS score FROM r WHERE rank <= 50")
add("flat_substring", lambda s, d: page(flat(s, d, "customer", "c_custkey", "c_name").plan("0012", mode="substring")), f"SELECT CAST(rank AS INTEGER) AS rank, id, score FROM (SELECT row_number() OVER (ORDER BY score DESC, id) AS rank, * FROM (SELECT c_custkey AS id, CAST({sql_substring(norm('c_name'), '0012')} AS INTEGER) AS score FROM customer) WHERE score IS NOT NULL) WHERE rank <= 50")
add("multifield_best", lambda s, d: part_page(s, d, "ma", mode="substring"), multifield(lambda n: sql_substring(n, "ma"), "ma"))
add("multifield_prefix", lambda s, d: part_page(s, d, "s", mode="prefix", limit=100), multifield(lambda n: sql_prefix(n, "s"), "s", 100))
add("field_restriction", lambda s, d: part_page(s, d, "brand#1", mode="substring", fields=["p_brand"]), multifield(lambda n: sql_substring(n, "brand#1") if "p_brand" in n else "CAST(NULL AS INTEGER)", "brand#1"))


def _filtered(name: str, expr: Any, where: str) -> None:
    add(f"filter_{name}", lambda s, d: doc_page(s, d, "the", mode="substring", filter=expr, limit=100), ranked("documents", sql_substring(DOC, "the"), DOC, "doc_id", "the", 100, where))


_filtered("eq", {"lang": "de"}, "coalesce(lang = 'de', FALSE)")
_filtered("in", {"source": ["src1", "src3", None]}, "coalesce(source IN ('src1', 'src3'), FALSE) OR source IS NULL")
_filtered("range", {"n_chars": {"gte": 500, "lt": 2000}, "lang": {"gt": "de", "lte": "es"}}, "n_chars >= 500 AND n_chars < 2000 AND lang > 'de' AND lang <= 'es'")
_filtered("not", {"not": {"lang": "en"}, "source": {"neq": "src2"}}, "NOT coalesce(lang = 'en', FALSE) AND NOT coalesce(source = 'src2', FALSE)")
_filtered("exists", {"source": {"exists": True}, "lang": {"nin": ["fr", "es"]}}, "source IS NOT NULL AND NOT coalesce(lang IN ('fr', 'es'), FALSE)")
_filtered("nested", {"or": [{"and": [{"lang": "fr"}, {"n_chars": {"lt": 900}}]}, {"not": {"or": [{"lang": ["en", "fr"]}, {"source": "src5"}]}}]}, "(lang = 'fr' AND n_chars < 900) OR NOT (lang IN ('en', 'fr') OR source = 'src5')")
_filtered("tags", {"tags": {"in": ["es", "src7"]}}, "lang = 'es' OR source = 'src7'")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good")), "doc_id", "left")
    index = DocumentIndex.create(docs, ["text"], id="doc_id", filter_fields=[FilterField("good", "boolean")], validate=False)
    return page(index.plan("of", mode="substring", highlight=False, filter={"good": {"neq": True}}))


add("filter_boolean_missing", _labelled, ranked("(SELECT d.*, quality = 1 AS good FROM documents d LEFT JOIN labels USING (doc_id))", sql_substring(DOC, "of"), DOC, "doc_id", "of", 50, "NOT coalesce(good, FALSE)"))


def _facet(query: str, spec: dict, **options: Any) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: documents(s, d).plan(query, facets={"f": spec}, highlight=False, **options).facets["f"]


def terms_sql(value: str, matched: str, order: str, limit: int, source: str = "documents") -> str:
    return f"""WITH g AS (SELECT v AS value, count(*) AS count FROM (SELECT {value} AS v FROM {source} WHERE {matched}) WHERE v IS NOT NULL GROUP BY v),
r AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM g) SELECT value, count, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {limit}"""


HAS_THE = f"contains({DOC}, 'the')"
add("terms_facet", _facet("the", {"field": "source", "limit": 5}, mode="substring"), terms_sql("source", HAS_THE, "count DESC, value", 5))
add("terms_facet_by_value", _facet("the", {"field": "lang", "sort_by": "value"}, mode="substring"), terms_sql("lang", HAS_THE, "value", 10))
add("tags_facet", _facet("the", {"field": "tags", "limit": 30}, mode="substring"), terms_sql("unnest(list_distinct([lang, source]))", HAS_THE, "count DESC, value", 30))
add("disjunctive_facet", _facet("the", {"field": "lang"}, mode="substring", filter={"lang": "de", "n_chars": {"lt": 3000}}), terms_sql("lang", HAS_THE + " AND n_chars < 3000", "count DESC, value", 10))


def ranges_sql(matched: str, rows: list[tuple[str, str, str, str]]) -> str:
    return "\nUNION ALL ".join(f"SELECT {lit(key)} AS key, CAST({a} AS DOUBLE) AS \"from\", CAST({b} AS DOUBLE) AS \"to\", (SELECT count(*) FROM documents WHERE {matched} AND {cond}) AS count, {k} AS rank" for k, (key, a, b, cond) in enumerate(rows, 1))


add(
    "range_facet",
    _facet("the", {"field": "n_chars", "type": "range", "ranges": [{"to": 500}, {"from": 400, "to": 2000, "key": "middle"}, {"from": 1e6}]}, mode="substring"),
    ranges_sql(HAS_THE, [("*-500", "NULL", "500", "n_chars < 500"), ("middle", "400", "2000", "n_chars >= 400 AND n_chars < 2000"), ("1000000-*", "1e6", "NULL", "n_chars >= 1e6")]),
)


def _suggest(query: str, **options: Any) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return parts(spark, sf_dir).autocomplete(query, **options).select("rank", "text", "score", "type", "doc_id")

    return run


def suggest_sql(score: Callable[[str], str], q: str, kind: str, limit: int, fields: tuple[tuple[str, float], ...] = (("p_name", 2.0), ("p_type", 1.0), ("p_brand", 0.5))) -> str:
    union = "\nUNION ALL ".join(f"SELECT p_partkey AS doc_id, {f} AS text, {w} AS weight, CAST(floor(({score(norm(f))}) * {w} + 0.5) AS INTEGER) AS score, {norm(f)} AS s FROM part" for f, w in fields)
    return f"""WITH m AS ({union}), r AS (SELECT row_number() OVER (ORDER BY score DESC, weight DESC, s = {lit(q)} DESC, length(s), doc_id) AS rank, * FROM m WHERE score IS NOT NULL)
SELECT CAST(rank AS INTEGER) AS rank, text, score, '{kind}' AS type, doc_id FROM r WHERE rank <= {limit}"""


add("autocomplete_prefix", _suggest("Wid", limit=20), suggest_sql(lambda n: sql_prefix(n, "wid"), "wid", "completion", 20))
add("autocomplete_field", _suggest("med", limit=10, field="p_type"), suggest_sql(lambda n: sql_prefix(n, "med"), "med", "completion", 10, (("p_type", 1.0),)))


def _fuzzy_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).autocomplete("rdbt", limit=25, mode="fuzzy", field="p_name").select("rank", "text", "score", "type", "doc_id")


add("autocomplete_fuzzy", _fuzzy_suggest, f"WITH {sql_fuzzy('part', 'p_partkey', norm('p_name'), 'rdbt', ', p_name')}, w AS (SELECT * REPLACE (CAST(floor(score * 2.0 + 0.5) AS INTEGER) AS score) FROM fuzzy), r AS (SELECT row_number() OVER (ORDER BY score DESC, s = 'rdbt' DESC, length(s), id) AS rank, * FROM w) SELECT CAST(rank AS INTEGER) AS rank, p_name AS text, score, 'did-you-mean' AS type, id AS doc_id FROM r WHERE rank <= 25")


def sql_window(n: str, term: str, starts: str = "TRUE", head: int = 1) -> str:
    """{w: start, length, distance} of the window of least distance (one edit at most), then earliest, then shortest; null without one. All windows are tried."""
    m = len(term)
    each = f"list_transform(range(0, length({n})), lambda a: list_transform(range({m - 1}, {m + 2}), lambda k: {{'distance': damerau_levenshtein(substr({n}, a + 1, k), {lit(term)}), 'start': a, 'length': k}}))"
    fits = f"x.distance <= 1 AND x.start + x.length <= length({n}) AND substr({n}, x.start + 1, {head}) = {lit(term[:head])} AND ({starts})"
    return f"list_min(list_filter(flatten({each}), lambda x: {fits}))"


_DELIMITER = r"regexp_matches({0}, '^[\t\n\r !-/:-@\[-`{{-~]$')"


def typo_fields(score: Callable[[str], str], fields: tuple[tuple[str, float], ...]) -> str:
    """Rows (id, text, matched_field, place, weight, score, s) of part: the scores of each field."""
    return "\nUNION ALL ".join(f"SELECT p_partkey AS id, {f} AS text, '{f}' AS matched_field, {k} AS place, CAST({w} AS DOUBLE) AS weight, CAST(floor(({score('s')}) * {w} + 0.5) AS INTEGER) AS score, s FROM (SELECT p_partkey, {f}, {norm(f)} AS s FROM part)" for k, (f, w) in enumerate(fields))


_FIELDS = (("p_name", 2.0), ("p_type", 1.0), ("p_brand", 0.5))


def typo_page(score: Callable[[str], str], q: str, limit: int = 100) -> str:
    return f"""WITH m AS ({typo_fields(score, _FIELDS)}), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, place) AS best FROM m WHERE score IS NOT NULL),
r AS (SELECT row_number() OVER (ORDER BY score DESC, weight DESC, s = {lit(q)} DESC, length(s), id) AS rank, id, score, matched_field FROM b WHERE best = 1)
SELECT CAST(rank AS INTEGER) AS rank, id, score, matched_field FROM r WHERE rank <= {limit}"""


def typo_substring_score(n: str, q: str) -> str:
    return f"list_transform([{sql_window(n, q)}], lambda w: 1000 - 10 * w.start - (length({n}) - {len(q)}) - 100 * w.distance)[1]"


def typo_prefix_score(n: str, q: str) -> str:
    before, here = _DELIMITER.format(f"substr({n}, x.start, 1)"), _DELIMITER.format(f"substr({n}, x.start + 1, 1)")
    w = sql_window(n, q, f"(x.start = 0 OR {before}) AND NOT {here}")
    return f"list_transform([{w}], lambda w: 1000 - 10 * w.start - (length({n}) - {len(q)}) + CASE WHEN w.start = 0 THEN 40 ELSE 0 END - 100 * w.distance)[1]"


def typo_token_score(n: str, terms: list[str], required: int) -> str:
    found = f"list_filter([{', '.join(f'{{w: {sql_window(n, t)}, size: {len(t)}}}' for t in terms)}], lambda y: y.w IS NOT NULL)"
    base, lens = "list_sum(list_transform(g, lambda y: 1000 - 10 * y.w.start - 100 * y.w.distance))", "list_sum(list_transform(g, lambda y: y.size))"
    span = "list_max(list_transform(g, lambda y: y.w.start + y.w.length)) - list_min(list_transform(g, lambda y: y.w.start))"
    return f"list_transform([{found}], lambda g: CASE WHEN len(g) >= {required} THEN {base} - (length({n}) - {lens}) - 2 * greatest(0, {span} - {lens}) END)[1]"


add(
    "did_you_mean",
    _suggest("wigdet", limit=15, mode="fuzzy", fuzzy_distance=1),
    f"""WITH m AS ({typo_fields(lambda n: typo_substring_score(n, "wigdet"), _FIELDS)}), r AS (SELECT row_number() OVER (ORDER BY score DESC, weight DESC, s = 'wigdet' DESC, length(s), id) AS rank, * FROM m WHERE score IS NOT NULL)
SELECT CAST(rank AS INTEGER) AS rank, text, score, 'did-you-mean' AS type, id AS doc_id FROM r WHERE rank <= 15""",
)
add("typo_substring", lambda s, d: part_page(s, d, "wigdet", mode="substring", typo=Typo(enabled=True), limit=100), typo_page(lambda n: typo_substring_score(n, "wigdet"), "wigdet"))
add("typo_token", lambda s, d: part_page(s, d, "rde widgte", mode="token", typo=Typo(enabled=True, min_for_one=3), token=TokenMatch("or"), limit=100), typo_page(lambda n: typo_token_score(n, ["rde", "widgte"], 1), "rde widgte"))
add("typo_prefix", lambda s, d: part_page(s, d, "smal", mode="prefix", typo=Typo(enabled=True), limit=100), typo_page(lambda n: typo_prefix_score(n, "smal"), "smal"))


def _normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", normalized(F.col("text")).alias("norm"))


add("normalize", _normalize, f"SELECT doc_id, {DOC} AS norm FROM documents")


def _highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents(spark, sf_dir).plan("thing", mode="substring", tag="em")
    return found.results.select("rank", "id", F.col("highlights")["text"][0]["start"].alias("start"), F.col("highlights")["text"][0]["end"].alias("end"), F.col("highlighted_text")["text"].alias("shown"))


add(
    "highlight_offsets",
    _highlights,
    f"""WITH p AS ({ranked("documents", sql_substring(DOC, "thing"), DOC, "doc_id", "thing")}), h AS (SELECT rank, id, text, length(regexp_extract(text, '(?is)^(.*?)thing', 1)) AS a FROM p JOIN documents ON doc_id = id)
SELECT rank, id, CAST(a AS INTEGER) AS "start", CAST(a + 5 AS INTEGER) AS "end", substr(text, 1, a) || '<em>' || substr(text, a + 1, 5) || '</em>' || substr(text, a + 6) AS shown FROM h""",
)


def _remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = DocumentIndex.create(read(spark, sf_dir, "customer"), ["c_name"], id="c_custkey", validate=False)
    gone = read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_custkey")
    return customers.remove(gone).records()


add("remove_batch", _remove, "SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    customers = DocumentIndex.create(c, ["c_name"], id="c_custkey", validate=False)
    changed = c.filter("c_nationkey < 5").withColumn("c_mktsegment", F.lit("MOVED")).withColumn("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).otherwise(F.col("c_custkey") + 10_000_000))
    return customers.upsert(changed).records()


add(
    "upsert_batch",
    _upsert,
    """WITH n AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey + 10000000 END AS c_custkey, c_name, c_nationkey, c_acctbal, 'MOVED' AS c_mktsegment FROM customer WHERE c_nationkey < 5)
SELECT * FROM n UNION ALL SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n)""",
)


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = documents(spark, sf_dir).stats()
    return spark.createDataFrame([(said["documents"], said["rows"], said["tokens"])], "documents bigint, rows bigint, tokens bigint")


add("index_stats", _stats, f"SELECT count(*) AS documents, count(*) FILTER (WHERE length({DOC}) > 0) AS rows, CAST(sum(length({DOC})) AS BIGINT) AS tokens FROM documents")
add("total_matches", lambda s, d: documents(s, d).plan("the", mode="substring", filter={"lang": "en"}).matched.agg(F.count("*").alias("total")), f"SELECT count(*) AS total FROM documents WHERE lang = 'en' AND {HAS_THE}")


def _hooked(spark: SparkSession, sf_dir: str) -> DataFrame:
    hooks = {
        "tokenizer": code_tokenizer,
        "filter_predicate": lambda df: F.col("doc.n_chars") > 1000,
        "scoring_hook": lambda df: df["score"] + F.when(F.col("doc.lang") == "en", 500).otherwise(0),
        "post_process": lambda df: df.filter("rank <= 20"),
    }
    return page(documents(spark, sf_dir).plan("theAnd", mode="token", limit=40, highlight=False, hooks=hooks))


add(
    "hooks",
    _hooked,
    f"""WITH p AS ({ranked("documents", sql_token(DOC, ["the", "and"], 2), DOC, "doc_id", "theand", 40, "n_chars > 1000")}), n AS (SELECT id, CAST(score + CASE WHEN lang = 'en' THEN 500 ELSE 0 END AS INTEGER) AS score, {DOC} = 'theand' AS exact, length({DOC}) AS len FROM p JOIN documents ON doc_id = id),
r AS (SELECT row_number() OVER (ORDER BY score DESC, exact DESC, len, id) AS rank, id, score FROM n) SELECT CAST(rank AS INTEGER) AS rank, id, score FROM r WHERE rank <= 20""",
)


def _tie_breakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(parts(spark, sf_dir).plan("ring", mode="substring", highlight=False, fields=["p_name"], tie_breakers=("matched_length", "id"), limit=30))


add("tie_breakers", _tie_breakers, f"SELECT CAST(rank AS INTEGER) AS rank, id, score FROM (SELECT row_number() OVER (ORDER BY length(s), id) AS rank, id, CAST(floor(score * 2 + 0.5) AS INTEGER) AS score FROM (SELECT p_partkey AS id, {norm('p_name')} AS s, {sql_substring(norm('p_name'), 'ring')} AS score FROM part) WHERE score IS NOT NULL) WHERE rank <= 30")


def _aux(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parts(spark, sf_dir).plan("a", mode="substring", highlight=False, limit=100)
    return found.results.select("rank", "id", F.explode("matches").alias("m")).select("rank", "id", F.col("m.field").alias("field"), F.col("m.score").alias("score"))


_AUX = multifield(lambda n: sql_substring(n, "a"), "a", 100)
add("auxiliary_matches", _aux, _AUX[: _AUX.rindex("SELECT CAST")] + "SELECT CAST(r.rank AS INTEGER) AS rank, r.id, b.matched_field AS field, b.score FROM r JOIN b ON b.id = r.id AND b.best > 1 WHERE r.rank <= 100")


def _query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of every part name and type by the split that queries undergo, as a table."""
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(split_column(F.concat_ws("-", "p_name", "p_brand"))).alias("term"))


add("token_split", _query_terms, r"SELECT p_partkey, unnest(list_filter(regexp_split_to_array(p_name || '-' || p_brand, '[\t\n\r !-/:-@\[-`{-~]'), lambda x: x <> '')) AS term FROM part")
