"""The queries op1 to op13 over a scale folder and, where SQL can say the same, their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import importance, jpeg, lexical, linededup, mixing, ngramjoin, packing, pii, quality, secrets, sharding, tokenio, toxicity
from siftwell.llm.tables import drop, keep, shared_dir, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out())


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, training_labels(spark, sf_dir))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of visible text of `pages` by host."""
    pages = table(spark, sf_dir, "pages").select("page_id", linededup.host_of("url").alias("host"), linededup.lines_of_html("html").alias("text"))
    return linededup.dedup_lines(pages, "text", "host", "page_id").select("page_id", "host", "n_lines", "n_dropped", "text")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/siftwell/ids-{uuid.uuid4().hex}"
    tokenio.write_ids(table(spark, sf_dir, "documents"), out, tokenizer_path(), end_id=2)
    found = keep(tokenio.read_index(spark.read.parquet(out)), "index")
    drop(spark.read.parquet(out))
    return found


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0, capacity=2048)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *pii.counted(found), F.sha2(pii.joined(pii.is_base()).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("pii")).alias("spans"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = keep(jpeg.media(table(spark, sf_dir, "documents")), "media")
    found = keep(jpeg.media_features(stored), "features")
    drop(stored)
    return found


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, corpus = lexical.build(table(spark, sf_dir, "documents"))
    found = lexical.search(index, corpus, table(spark, sf_dir, "benchmark"), k=20)
    drop(index)
    return found


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", sharding.size_of("text").alias("size"), sharding.crc_of("text").alias("text_crc32"))
    law = F.lit("rows").alias("law")
    return sharding.interleave(rows).select("doc_id", "size", "text_crc32", law, "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op4_secrets, which SQL can say."""
    return op4_secrets(spark, sf_dir).drop("spans")


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op8_pii, which SQL can say."""
    return op8_pii(spark, sf_dir).drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_mixing, op3_quality, op4_secrets, op5_line_dedup, op6_token_files, op7_packing, op8_pii, op9_media, op10_ngram_join, op11_importance, op12_lexical, op13_sharding, secret_base_spans, pii_base_spans)}

def _sql_list(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in dict.fromkeys(words))


_FAILS = " OR ".join(f"{left} * {a} > {right} * {b}" for _, left, a, right, b in quality.RULES)

OP3_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
pos AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
win AS (SELECT doc_id, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c, lead(word, 3) OVER o AS d, lead(word, 4) OVER o AS e FROM pos WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, b, c, d, e) AS n FROM win WHERE e IS NOT NULL) WHERE n > 1),
again AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) GROUP BY doc_id),
q AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
  len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*•‣]'))) AS n_bullet_lines, len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis_lines,
  len(list_filter(words, lambda x: regexp_matches(x, '\pL'))) AS n_alpha_words,
  len(list_filter(regexp_split_to_array(lower(t), '[^\pL\pN]+'), lambda x: x IN ({_sql_list(quality.STOP_WORDS)}))) AS n_stop_words, CASE WHEN len(words) >= 200 THEN len(words) ELSE 0 END AS n_words_if_long
  FROM w LEFT JOIN again USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_FAILS}) AS kept FROM f
"""

OP5_SQL = rf"""
WITH p AS (SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '') AS host,
  regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{linededup._HIDDEN}', ' ', 'g'), '{linededup._BLOCK}', chr(10), 'g'), '<[^>]*>', '', 'g') AS text FROM pages),
l AS (SELECT page_id, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM p),
n AS (SELECT host, trim(line) AS bare, count(DISTINCT page_id) AS n FROM l WHERE trim(line) <> '' GROUP BY ALL),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
bad AS (SELECT n.host, bare FROM n JOIN t ON n.host IS NOT DISTINCT FROM t.host WHERE n >= {linededup.MIN_PAGES} AND n > pages * {linededup.RATIO}),
m AS (SELECT l.*, bad.bare IS NOT NULL AS gone FROM l LEFT JOIN bad ON l.host IS NOT DISTINCT FROM bad.host AND trim(l.line) = bad.bare)
SELECT page_id, any_value(host) AS host, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text FROM m GROUP BY page_id
"""

OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END) AS gram FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared s JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * s.n >= 85 * (x.n + y.n - s.n)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, a AS seen FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.seen)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(min(seen), documents.doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY documents.doc_id, n.n
"""



#: crc32 of a column of text in SQL: a table of 256 entries, then a step a byte.
_CRC_TABLE = "crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i)))"


def _crc_sql(text: str) -> str:
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, crc.t[xor(c, b) % 256 + 1])), 4294967295)"


_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = rf"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, list_filter(string_split_regex({_LOWER_SQL}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
q AS (SELECT list_filter(string_split_regex({_LOWER_SQL}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
f AS (SELECT doc_id, array_to_string(w[i:i + k], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) + 1 - k)) AS i FROM d, range(3) AS r(k))),
fq AS (SELECT array_to_string(w[i:i + k], ' ') AS g FROM (SELECT w, k, unnest(range(1, len(w) + 1 - k)) AS i FROM q, range(3) AS r(k))),
g AS (SELECT g, {_crc_sql("g")} % 10000 AS b FROM (SELECT g FROM f UNION SELECT g FROM fq), crc),
s AS (SELECT b, count(*) AS s FROM f JOIN g USING (g) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM fq JOIN g USING (g) GROUP BY b),
n AS (SELECT (SELECT count(*) FROM f) AS s_all, (SELECT count(*) FROM fq) AS t_all),
gain AS (SELECT b, CAST(floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * (s_all + 10000)) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * (t_all + 10000)))) AS BIGINT) AS gain FROM range(10000) AS r(b) LEFT JOIN s USING (b) LEFT JOIN t USING (b), n),
w AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN g USING (g) JOIN gain USING (b) GROUP BY doc_id),
e AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS can,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || d.doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN w USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY can ORDER BY score DESC, doc_id) AS r, 5 * count(*) OVER (PARTITION BY can) // 100 AS k FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN can AND r <= k THEN r END AS rank FROM o
"""

OP12_SQL = rf"""
WITH dt AS (SELECT doc_id, unnest(list_filter(string_split_regex({_LOWER_SQL}, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM documents),
qt AS (SELECT item_id, unnest(list_filter(string_split_regex({_LOWER_SQL}, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM benchmark),
n AS (SELECT doc_id, count(*) AS n FROM dt GROUP BY doc_id),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
p AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
q AS (SELECT item_id, term, count(*) AS c FROM qt GROUP BY ALL),
s AS (SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN n USING (doc_id), c GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0) WHERE rank <= 20
"""

OP13_SQL = rf"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, coalesce('=' || source, '-') AS name, strlen(coalesce(text, '')) + 1 AS size, {_crc_sql("coalesce(text, '')")} AS text_crc32, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents, crc),
r AS (SELECT *, (2 * row_number() OVER (PARTITION BY name ORDER BY k) - 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY name)) AS f FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY f, name, k) - 1 AS i, count(*) OVER () AS total FROM r),
s AS (SELECT *, i * 16 // total AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, i - (shard * total + 15) // 16 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""


def _spans_sql(kinds: dict[str, tuple[str, str]], order: str) -> str:
    """Base spans of documents: each kind's pattern and test of a match m; places from the lengths of the pieces between matches."""
    parts = []
    for k, (kind, (pattern, test)) in enumerate(kinds.items()):
        parts.append(f"""SELECT doc_id, '{kind}' AS kind, {k} AS rank, start, start + length(m) AS stop, m FROM (SELECT doc_id, m, sum(length(p)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{pattern}')) AS m, unnest(string_split_regex(t, '{pattern}')) AS p, generate_subscripts(string_split_regex(t, '{pattern}'), 1) AS i FROM d) WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE m IS NOT NULL AND {test}""")
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}" for kind in kinds)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({' UNION ALL '.join(parts)})
SELECT doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY {order}), '')) AS base_sha256 FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id"""


_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
SECRETS_SQL = _spans_sql({"assign": (_ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 2)) >= 8"), "access": ("AKIA[A-Z0-9]+", "length(m) >= 16"), "hex": ("[0-9a-f]+", "length(m) >= 32")}, "start, rank")

_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST(substr({_DIGITS}, -k, 1) AS INTEGER) ELSE (2 * CAST(substr({_DIGITS}, -k, 1) AS INTEGER)) // 10 + (2 * CAST(substr({_DIGITS}, -k, 1) AS INTEGER)) % 10 END)) % 10 = 0"
PII_SQL = _spans_sql(
    {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "TRUE"),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(x AS HUGEINT), 999) > 255)) = 0"),
        "card": (r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
    },
    "rank, start",
)

#: The other queries are beyond SQL (models, iterations, codecs, sequential packing) and are held against plain versions in tests/llm.
ORACLE_SQL: dict[str, str] = {"op3_quality": OP3_SQL, "op5_line_dedup": OP5_SQL, "op10_ngram_join": OP10_SQL, "op11_importance": OP11_SQL, "op12_lexical": OP12_SQL, "op13_sharding": OP13_SQL, "secret_base_spans": SECRETS_SQL, "pii_base_spans": PII_SQL}
