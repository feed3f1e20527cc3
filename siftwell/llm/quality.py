"""Quality rules: a threshold table compiled into one Spark projection; no user functions.

measures() adds the counts of a text as columns, each from built-in functions over the word list (found once), and verdict() compiles RULES,
rows of (name, left column, factor, right column, factor, what fails), into one boolean. Rules compare integers, so that verdicts don't depend on rounding.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.tables import boxed, unboxed

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "als", "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "au", "aux", "avec", "ce", "dans", "des", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "par", "pas", "pour", "que", "qui", "un", "une",
    "al", "como", "con", "de", "del", "el", "las", "los", "más", "no", "para", "por", "se", "su", "y",
)

#: A text fails a rule if left * a > right * b. Lines count if they hold a word.
RULES = (
    ("words too short", "n_words", 2, "word_chars", 1),  # mean length under 2
    ("words too long", "word_chars", 1, "n_words", 15),  # mean length over 15
    ("too many symbols", "n_symbols", 10, "n_words", 3),  # over 0.3 a word
    ("too many repeated lines", "n_dup_lines", 2, "n_lines", 1),  # over half
    ("too many bullet lines", "n_bullet_lines", 10, "n_lines", 9),
    ("too many cut lines", "n_ellipsis_lines", 10, "n_lines", 3),
    ("too few words with a letter", "n_words", 1, "n_alpha_words", 2),  # under half
    ("too few stop words", "n_words_if_long", 1, "n_stop_words", 200),  # under 1 in 200, of 200 words or more
)

_GAP = r"[\x20\x09-\x0D]+"


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and the counts of text (null: no words), each in a struct field of the column `quality`.

    Layers only share the word list, its windows and the lines between counts: one stage, no shuffle.
    """
    out = boxed(docs, _t=F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn("_words", F.array_remove(F.split("_t", _GAP), "")).withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("_n", F.size("_words"))

    def window(i: Column) -> Column:
        return F.xxhash64(*(F.get(F.col("_words"), i + k) for k in range(5)))

    out = out.withColumn("_windows", F.when(F.col("_n") >= 5, F.transform(F.sequence(F.lit(0), F.col("_n") - 5), window)).otherwise(F.array().cast("array<bigint>")))
    # windows in order of hash, equal ones side by side; only texts with some equal windows come here
    placed = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), placed))

    def twice(x: Column, k: Column) -> Column:
        beside = [F.get(F.col("_sorted"), k + d)["h"] for d in (-1, 1)]
        return reduce(lambda a, b: a | b, (F.coalesce(b == x["h"], F.lit(False)) for b in beside))

    out = out.withColumn("_again", F.array_sort(F.transform(F.filter("_sorted", twice), lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("at"))
    covered = F.aggregate("_again", start, lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["at"])).alias("n"), i.alias("at")))["n"]
    n = F.col("_n").cast("long")

    def some(x: Column) -> Column:
        return F.size(x).cast("long")

    counts = {
        "n_words": n,
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": some(F.col("_lines")) - some(F.array_distinct("_lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "n_lines": some(F.col("_lines")),
        "n_bullet_lines": some(F.filter("_lines", lambda x: x.rlike(r"^\s*[-*•‣]"))),
        "n_ellipsis_lines": some(F.filter("_lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))),
        "n_alpha_words": some(F.filter("_words", lambda w: w.rlike(r"\p{L}"))),
        "n_stop_words": some(F.filter(F.split(F.lower("_t"), r"[^\p{L}\p{N}]+"), lambda w: w.isin(*dict.fromkeys(STOP_WORDS)))),
        "n_words_if_long": F.when(n >= 200, n).otherwise(F.lit(0)).cast("long"),
    }
    return unboxed(out, docs.columns, quality=F.struct(*(c.alias(k) for k, c in counts.items())))


def verdict(q: str = "quality", rules: tuple = RULES) -> Column:
    """The names of the rules that a text fails."""
    failed = [F.when(F.col(f"{q}.{left}") * a > F.col(f"{q}.{right}") * b, F.lit(name)) for name, left, a, right, b in rules]
    return F.array_compact(F.array(*failed))


def judge(docs: DataFrame, text: str = "text", rules: tuple = RULES) -> DataFrame:
    """docs with quality (counts), base_failed, failed_rules and kept; columns of docs so named are replaced. Null and empty texts have no words and fail the base.

    Texts of any length are counted whole; repeated rows are judged each; an empty table gives no rows.
    """
    out = measures(docs, text)
    base = (F.col("quality.n_words") < 10) | (F.col("quality.n_repeat_words") * 100 > F.col("quality.n_words") * 20)
    return out.withColumns({"base_failed": base, "failed_rules": verdict(rules=rules)}).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
