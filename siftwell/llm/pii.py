"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust a score.

Native column expressions only. Java's matches of a pattern and the pieces between them come from regexp_extract_all and split over
the same pattern; their lengths in code points give the places. Patterns are written so that no text makes them backtrack: quantifiers are possessive where
nothing that follows could match, and repeated starts inside one run of characters are ruled out by look-behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.tables import boxed, unboxed

_LOCAL = "[A-Za-z0-9._%+-]"
#: Same matches as the plain patterns: see the module text. Cards are of 13 to 19 digits already.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: What a text must hold for a pattern to be tried at all; cheap tests.
_NEEDS = {"email": "@", "phone": "+"}
_TRIES = {"ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "iban": r"[A-Z]{2}[0-9]{2}[\x20]?[A-Z0-9]{4}", "ssn": r"[0-9]-[0-9]{2}-[0-9]"}
#: Words that speak for a kind when they stand within CONTEXT code points before or after.
NEARBY = {
    "email": r"e-?mail|contact|write|courriel|correo|kontakt",
    "ip": r"\bip\b|address|server|host|login",
    "card": r"card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte",
    "phone": r"phone|call|tel|mobile|fax|anruf|llame",
    "iban": r"iban|account|bank|konto|cuenta|compte|transfer",
    "ssn": r"ssn|social|security|tax|identity",
}
CONTEXT = 40
#: Score before context, what a nearby word adds, and the least score of a reported span. Base kinds are always reported.
START = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.4}
ADDS, LEAST = 0.2, 0.6


#: Matches that are placed together: sums run inside a group, then over groups, so that no array is copied once a match.
GROUP = 512
_FOUND = "array<struct<start:int,end:int,match:string,before:string,after:string>>"


def _sums(sizes: Column) -> Column:
    """Sums of an array up to each element (without it), in steps that grow as the array's length times GROUP at most."""
    whole = F.array().cast("array<int>")

    def running(xs: Column) -> Column:
        """Sums before each element, and over all."""
        return F.aggregate(xs, F.struct(F.lit(0).alias("sum"), whole.alias("out")), lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out")))

    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(sizes) - 1) / GROUP), F.lit(0)).cast("int")), lambda g: running(F.slice(sizes, g * GROUP + 1, F.lit(GROUP))))
    starts = running(F.transform(groups, lambda g: g["sum"]))["out"]
    many = F.flatten(F.zip_with(groups, starts, lambda g, s: F.transform(g["out"], lambda x: x + s)))
    return F.when(F.size(sizes) <= GROUP, running(sizes)["out"]).otherwise(many)


def _spans(text: str, kind: str) -> Column:
    """array<struct<start, end, match, before, after>> of the pattern's matches, leftmost first, in code points.

    before and after: up to CONTEXT code points, cut from the pieces between matches (those before the match before are left out).
    """
    pattern = PATTERNS[kind]
    held = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def placed(x: Column) -> Column:
        both = F.zip_with(x["p"], x["m"], lambda p, m: F.length(p) + F.coalesce(F.length(m), F.lit(0)))
        return F.struct(x["p"].alias("p"), x["m"].alias("m"), _sums(both).alias("at"))

    def spans(x: Column) -> Column:
        def one(m: Column, k: Column) -> Column:
            piece, start = F.get(x["p"], k), F.get(x["at"], k) + F.length(F.get(x["p"], k))
            before = F.concat(F.right(F.coalesce(F.get(x["p"], k - 1), F.lit("")), F.lit(CONTEXT)), F.lit(" "), F.right(piece, F.lit(CONTEXT)))
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("match"), F.right(before, F.lit(CONTEXT)).alias("before"), F.left(F.get(x["p"], k + 1), F.lit(CONTEXT)).alias("after"))

        return F.transform(x["m"], one)

    # arrays of one element stand for names, so that each part is computed once
    found = F.flatten(F.transform(F.transform(F.array(held), placed), spans))
    empty = F.array().cast(_FOUND)
    maybe = F.contains(F.col(text), F.lit(_NEEDS[kind])) if kind in _NEEDS else F.col(text).rlike(_TRIES[kind])
    return F.when(maybe, found).otherwise(empty)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Do these digits pass Luhn's check?"""

    def part(c: Column, i: Column) -> Column:
        d = F.ascii(c) - 48
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    parts = F.transform(F.split(F.reverse(digits), ""), part)
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Does this IBAN (blanks allowed) leave 1 modulo 97, its first four characters moved to its end and letters read as 10 to 35?"""
    bare = F.regexp_replace(iban, " ", "")
    moved = F.split(F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4))), "")

    def step(a: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v >= 65, (a * 100 + (v - 55)) % 97).otherwise((a * 10 + (v - 48)) % 97)

    return F.aggregate(moved, F.lit(0), step) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda x: x.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return mod97(m)
    return F.lit(True)


def find(docs: DataFrame, text: str = "text", kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """docs with the column pii (one of docs so named is replaced): array of (kind, start, end, score), by kind as listed, then start.

    Null and empty texts have none. Spans of different kinds may overlap. Repeated rows each have their own; very long texts are searched whole,
    in time that grows with their length and number of matches. One stage, no shuffle.
    """
    out = boxed(docs, _t=F.coalesce(F.col(text), F.lit("")))
    out = out.withColumns({f"_{k}": _spans("_t", k) for k in kinds})

    def scored(kind: str) -> Column:
        def one(x: Column) -> Column:
            near = F.concat(x["before"], F.lit(" "), x["after"]).rlike("(?i)" + NEARBY[kind])
            score = F.lit(START[kind]) + F.when(near, F.lit(ADDS)).otherwise(F.lit(0.0))
            return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.least(score, F.lit(1.0)).alias("score"))

        spans = F.transform(F.filter(f"_{kind}", lambda x: _valid(kind, x["match"])), one)
        return spans if kind in BASE else F.filter(spans, lambda x: x["score"] >= LEAST)

    return unboxed(out, docs.columns, pii=F.concat(*(scored(k) for k in kinds)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; of overlapping spans the first, then longest, is written."""
    out = boxed(find(docs, text, kinds), _t=F.col(text), _p=F.array_sort(F.transform("pii", lambda x: F.struct(x["start"], (-x["end"]).alias("back"), x["kind"].alias("kind")))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        piece = F.concat(a["out"], F.substr(F.col("_t"), a["at"] + 1, x["start"] - a["at"]), F.lit("["), x["kind"], F.lit("]"))
        skip = x["start"] < a["at"]
        return F.struct(F.when(skip, a["at"]).otherwise(-x["back"]).alias("at"), F.when(skip, a["out"]).otherwise(piece).alias("out"))

    done = F.aggregate("_p", start, step)
    whole = F.when(F.size("_p") == 0, F.col("_t")).otherwise(F.concat(done["out"], F.substr(F.col("_t"), done["at"] + 1)))
    return unboxed(out, [c for c in docs.columns if c != "pii"] + ["pii"], **{text: whole})


def counted(found: DataFrame) -> list[Column]:
    """n_ of each base kind."""
    return [F.size(F.filter("pii", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]


def _is(kind: str):
    return lambda x: x["kind"] == kind


def is_base() -> Column:
    return F.filter("pii", lambda x: x["kind"].isin(*BASE))
