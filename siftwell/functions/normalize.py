"""Text normalization: trim, NFC, full case folding, NFC. Queries on the driver, columns in Spark.

Rows of ASCII, western letters and common signs stay in the JVM (trim and lower are the whole of it there, but for ß); only other rows travel to an Arrow UDF.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that trimming removes.
TRIMMED = "\t\n\x0b\x0c\r                  　﻿"
#: Folds of Unicode 16 that older tables of str.casefold lack.
NEWER_FOLDS = {0x1C89: "ᲊ", 0xA7CB: "ɤ", 0xA7CC: "ꟍ", 0xA7DA: "ꟛ", 0xA7DC: "ƛ"} | {c: chr(c + 0x20) for c in range(0x10D50, 0x10D66)}
_ASCII = r"^[\x00-\x7F]*\z"
#: Beside ASCII: characters up to U+017E and signs that are composed already and whose lower case is their fold (ß apart). Left out: no-break space, soft hyphen,
#: micro sign, dotted I, n with apostrophe.
_NATIVE = r"^[\x00-\x7F\u00A1-\u00AC\u00AE-\u00B4\u00B6-\u012F\u0131-\u0148\u014A-\u017E\u2013\u2014\u2018-\u201E\u2026\u20AC]*\z"


_NEWER = re.compile("[" + "".join(map(chr, NEWER_FOLDS)) + "]")


def fold(text: str) -> str:
    """Full, locale-free case folding."""
    # a translation looks at every character in turn; few texts hold any of those
    return (text.translate(NEWER_FOLDS) if _NEWER.search(text) else text).casefold()


def normalize_text(text: str, folded: bool = True) -> str:
    """The form that is matched: its code points are the tokens of all scores."""
    text = text.strip(TRIMMED)
    if text.isascii():
        return text.lower() if folded else text
    text = unicodedata.normalize("NFC", text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))
    return unicodedata.normalize("NFC", fold(text)) if folded else text


#: Bytes of a batch's texts that are out of Arrow at a time.
STEP_BYTES = 1 << 20
#: Characters whose old ASCII form is made at a time.
STEP_CHARS = 1 << 18


def runs(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """(lo, hi) of rows in runs of texts of at most so many bytes; a longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, size + (ends[lo - 1] if lo else 0), "right")))
        yield lo, hi
        lo = hi


def over_texts(texts: pa.Array, of: Callable[[list[str]], list], kind: pa.DataType) -> pa.Array:
    """What a function of lists gives for the texts that are there, run by run; null for the others."""

    def given(some: list[str | None]) -> list:
        got = iter(of([t for t in some if t is not None]))
        return [None if t is None else next(got) for t in some]

    out = [pa.array(given(texts.slice(lo, hi - lo).to_pylist()), kind) for lo, hi in runs(texts, STEP_BYTES)]
    return pa.concat_arrays(out) if out else pa.array([], kind)


def _udf(folded: bool):
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return over_texts(texts, lambda some: normalize_texts(some, folded), pa.string())

    return run


def normalize_texts(texts: list[str], folded: bool = True) -> list[str]:
    """normalize_text of each, in one string: NUL between them neither composes nor folds. Texts that hold it go alone."""
    bare = [t.strip(TRIMMED) for t in texts]
    alone = {i for i, t in enumerate(bare) if "\0" in t}
    whole = unicodedata.normalize("NFC", "\0".join("" if i in alone else t for i, t in enumerate(bare)))
    out = (unicodedata.normalize("NFC", fold(whole)) if folded else whole).split("\0")
    for i in alone:
        out[i] = normalize_text(bare[i], folded)
    return out if texts else []


def ascii_normalized(text: Column, folded: bool = True) -> Column:
    """normalize_text for columns known to be ASCII (or of the characters of _NATIVE): JVM only."""
    bare = F.btrim(text, F.lit("\t\n\x0b\f\r "))
    return F.replace(F.lower(bare), F.lit("ß"), F.lit("ss")) if folded else bare


def normalized(text: Column, folded: bool = True) -> Column:
    """normalize_text of a column; null stays null."""
    plain = text.rlike(_NATIVE)
    return F.when(plain, ascii_normalized(text, folded)).otherwise(_udf(folded)(F.when(~plain, text)))


#: Characters that composition makes one of, at most.
COMPOSED = 4


def shortest(text: Column) -> Column:
    """A length that the normalized form of a text is not below, without making it: of the trimmed text the part that composition could leave. Null: 0."""
    size = F.length(F.btrim(F.coalesce(text, F.lit("")), F.lit(TRIMMED)))
    return F.ceil(size / COMPOSED).cast("int")


def ascii_text(text: Column) -> Column:
    """ascii_bytes of a column, as text; null stays null. ASCII rows stay in the JVM."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return over_texts(texts, ascii_texts, pa.string())

    plain = text.rlike(_ASCII)
    return F.when(plain, text).otherwise(run(F.when(~plain, text)))


def ascii_texts(texts: list[str]) -> list[str]:
    """ascii_bytes of each as text, all in one string; texts that hold the NUL between them, and long ones, go alone."""
    alone = {i for i, t in enumerate(texts) if "\0" in t or len(t) > STEP_CHARS}
    rest = "\0".join("" if i in alone else t for i, t in enumerate(texts))
    out = _ascii(rest).split("\0") if texts else []
    for i in alone:
        out[i] = _ascii(texts[i])
    return out


def _ascii(text: str) -> str:
    """ascii_bytes as text, in steps: each character's form stands for itself, since only marks, which go, change places."""
    out = []
    for at in range(0, len(text), STEP_CHARS):
        codes = np.frombuffer(unicodedata.normalize("NFKD", text[at : at + STEP_CHARS]).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, of = np.unique(codes, return_inverse=True)
        marks = np.array([unicodedata.combining(chr(c)) != 0 for c in kinds.tolist()], bool)
        plain = np.where(kinds < 128, kinds, ord("?")).astype(np.uint8)
        out.append(plain[of[~marks[of]]].tobytes().decode("ascii"))
    return "".join(out)


def ascii_bytes(text: str) -> bytes:
    """The old one-byte form: NFKD without marks, anything else beyond ASCII as '?'."""
    plain = unicodedata.normalize("NFKD", text)
    return "".join(c if c.isascii() else "?" for c in plain if not unicodedata.combining(c)).encode()
