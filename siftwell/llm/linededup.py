"""Line dedup by site-relative frequency: lines that many pages of their host share are boilerplate.

Native DataFrame operations only. Lines are counted by (host, hash of the line), once a page; what exceeds a ratio of its host's
pages is dropped from all of them. Hosts, however large, are never gathered: counts are partly summed before the shuffle, and the boilerplate of a
host is at most (mean lines of its pages) / ratio lines, so those lists are joined to pages, broadcast while their measured number is small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.tables import boxed, keep, unboxed

#: A line is boilerplate if at least MIN_PAGES pages of its host hold it, and more than RATIO of them.
RATIO, MIN_PAGES = 0.2, 3
#: Boilerplate lines (8 bytes each) up to which the lists are broadcast; beyond, pages meet them by (host, salt).
BROADCAST_LINES, SALTS = 1_000_000, 64

_BLOCK = r"(?i)<(?:/?(?:p|div|li|ul|ol|h[1-6]|tr|td|th|table|section|article|header|footer|nav|main|aside|blockquote|pre|title|body|head|html)|br)(?:\s[^>]*)?/?>"
_HIDDEN = r"(?is)<script(?:\s[^>]*)?>.*?</script>|<style(?:\s[^>]*)?>.*?</style>|<!--.*?-->"


def host_of(url: str) -> Column:
    """The host of a URL in lower case; null where there is none."""
    host = F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return F.lower(F.when(host != "", host))


#: Marks an opening that nothing closes; where a text holds it already it is doubled while the mark is in use.
_MARK = "\ue000"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _tail(text: Column, size: Column) -> Column:
    return F.substr(text, size + 1, F.length(text))


def _upto(text: Column, closer: str, body: Callable[[Column], Column]) -> Column:
    """body of the text through its last closer, and the rest as it is. Whatever opens there finds a closer, so a search that goes from opening to closer reads the text once."""
    return _let(text, lambda t: _let(F.length(t) - F.length(F.substring_index(t, closer, -1)), lambda n: F.concat(body(F.substr(t, F.lit(1), n)), _tail(t, n))))


def _marked(text: Column, head: Callable[[Column], Column], opening: str) -> Column:
    """The text with a mark in each opening behind its head, through which every opening is closed."""
    return _let(text, lambda t: _let(F.length(head(t)), lambda n: F.concat(F.substr(t, F.lit(1), n), F.regexp_replace(_tail(t, n), opening, "$1" + _MARK))))


def _element_head(name: str) -> Callable[[Column], Column]:
    """Through the last `>` before the last closing tag: an opening tag that ends later has no closing tag behind it."""
    return lambda t: F.regexp_extract(t, f"(?is)^.*>(?=[^>]*</{name}>)", 0)


def _comment_head(t: Column) -> Column:
    return F.substr(t, F.lit(1), F.length(t) - F.length(F.substring_index(t, "-->", -1)))


#: Openings times characters of a page up to which the patterns run over it as it is: at worst each opening that nothing closes reads the page to its end.
PLAIN_STEPS = 1 << 24


def _visible(text: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(text, _HIDDEN, " "), _BLOCK, "\n")
    return F.regexp_replace(text, r"<[^>]*>", "")


def _visible_by_heads(text: Column) -> Column:
    """The same in time that grows with the length of the page, however many openings are unclosed: before a search from openings to closers, those behind the last
    closer are set aside or marked."""
    text = F.regexp_replace(text, _MARK, _MARK * 2)
    for name in ("script", "style"):
        text = _marked(text, _element_head(name), f"(?i)(<)(?={name})")
    text = _marked(text, _comment_head, "(<!)(?=--)")
    text = F.regexp_replace(F.regexp_replace(text, _HIDDEN, " "), f"{_MARK}({_MARK}?)", "$1")
    text = _upto(text, ">", lambda t: F.regexp_replace(t, _BLOCK, "\n"))
    return _upto(text, ">", lambda t: F.regexp_replace(t, r"<[^>]*>", ""))


def lines_of_html(html: str) -> Column:
    """Visible text with a line for each block element; scripts, styles, comments and tags go. An opening that nothing closes stays as text.

    Pages of many openings, for which PLAIN_STEPS are too few, take a longer way to the same text, in time that grows with their length alone.
    """
    text = F.coalesce(F.col(html), F.lit(""))
    size = F.octet_length(text).cast("long")
    few = (size - F.octet_length(F.replace(text, F.lit("<"), F.lit("")))) * size <= PLAIN_STEPS
    return F.when(few, _visible(text)).otherwise(_visible_by_heads(text))


def dedup_lines(pages: DataFrame, text: str, host: str, page_id: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages, all their columns, with text without boilerplate lines, and n_lines and n_dropped (columns so named are replaced).

    Lines are split at \\n and compared without blanks around them; blank lines stay and never count. A null text stays null; a null host is one of its own.
    Repeated pages count each; very long pages are split whole, in time that grows with their length. A page may lose all its lines; its text is empty then.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit("-"))
    held = boxed(pages, _host=name, _text=F.col(text), _id=F.col(page_id), _lines=F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    hashes = F.array_distinct(F.filter(F.transform("_lines", _key), lambda h: h.isNotNull()))
    each = held.select("_host", F.explode(hashes).alias("_line"))
    often = each.groupBy("_host", "_line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    totals = pages.groupBy(name.alias("_host")).agg(F.count("*").alias("pages"))
    # both sides are reduced: a few lines a host, and one row a host
    bad = often.join(totals, "_host").filter(F.col("n") > F.col("pages") * F.lit(ratio))
    bad = keep(bad.groupBy("_host").agg(F.collect_list("_line").alias("_bad")), "boilerplate")
    size = bad.agg(F.sum(F.size("_bad"))).first()[0] or 0
    if size <= BROADCAST_LINES:
        met = held.join(F.broadcast(bad), "_host", "left")
    else:
        salted = bad.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = held.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")).join(salted, ["_host", "_salt"], "left")
    # what of the list the page holds is found by hash; lines are then looked up among that alone
    own = F.array_compact(F.transform("_lines", _key))
    met = met.withColumn("_held", F.when(F.col("_bad").isNotNull(), F.array_intersect(own, F.col("_bad"))))
    stay = F.filter("_lines", lambda x: F.coalesce(~F.array_contains(F.col("_held"), _key(x)), F.lit(True)))
    met = met.withColumn("_stay", F.when(F.coalesce(F.size("_held"), F.lit(0)) <= 0, F.col("_lines")).otherwise(stay))
    new = F.when(F.col("_text").isNotNull(), F.when(F.size("_stay") == F.size("_lines"), F.col("_text")).otherwise(F.array_join("_stay", "\n")))
    return unboxed(met, pages.columns, **{text: new, "n_lines": F.size("_lines").cast("long"), "n_dropped": (F.size("_lines") - F.size("_stay")).cast("long")})


def _key(line: Column) -> Column:
    """The hash of a line without blanks around it; null for a blank line. 64 bits within one host: chance equality is out of question."""
    bare = F.trim(line)
    return F.when(bare != "", F.xxhash64(bare))
