"""How field and filter values read as text and numbers: numbers print without a trailing .0, blanks and non-finite numbers are missing."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.normalize import TRIMMED

_NUMBER = r"^[+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)$"
_RADIX = r"^0(?:[xX][0-9a-fA-F]+|[oO][0-7]+|[bB][01]+)$"


def number_text(x: float | int | bool | None) -> str:
    """A number as text: 50, 0.1, 1e+21, 1e-7."""
    if isinstance(x, bool):
        return "true" if x else "false"
    if x is None:
        return "null"
    x = float(x)
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    mantissa, _, exponent = repr(x).partition("e")
    if not exponent:
        if abs(x) >= 1e-6:
            return mantissa
        exponent = "0"
    if 1e-6 <= abs(x) < 1e21:
        return format(x, f".{max(0, -int(exponent)) + max(0, len(mantissa.partition('.')[2]))}f").rstrip("0").rstrip(".")
    m = mantissa.removesuffix(".0")
    return f"{m}e{'+' if int(exponent) > 0 else '-'}{abs(int(exponent))}"


def text_of(value: object) -> str:
    return value if isinstance(value, str) else number_text(value) if isinstance(value, bool | int | float) or value is None else str(value)


def number_of(value: object) -> float | None:
    """A finite number, or None: numbers, and strings that hold one and are not blank."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, str):
        value = value.strip(TRIMMED)
        try:
            value = int(value, 0) if value[:2].lower() in ("0x", "0o", "0b") else float(value) if value and "_" not in value and value.lower().lstrip("+-") not in ("nan", "inf", "infinity") else math.nan
        except ValueError:
            return None
    try:
        value = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError, OverflowError):
        return None
    return value if math.isfinite(value) else None


def text_column(col: Column, kind: T.DataType) -> Column:
    """A column as text: arrays join their non-null items by blanks; null is the empty string."""
    if isinstance(kind, T.StringType):
        out = col
    elif isinstance(kind, T.BooleanType):
        out = col.cast("string")
    elif isinstance(kind, T.ArrayType):
        item = kind.elementType
        out = F.array_join(col if isinstance(item, T.StringType) else F.transform(F.array_compact(col), lambda x: text_column(x, item)), " ")
    elif isinstance(kind, T.DoubleType | T.FloatType):
        wide = col.cast("double")
        whole = (wide == F.floor(wide)) & (F.abs(wide) < 1e18)
        text = wide.cast("string")
        small = F.regexp_replace(F.regexp_replace(text.try_cast("decimal(38,24)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
        far = F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), r"E(?=[0-9])", "e+")
        out = F.when(whole, wide.cast("bigint").cast("string")).when(text.contains("E") & F.abs(wide).between(1e-6, 1e21), small).otherwise(F.regexp_replace(far, "E-", "e-"))
    else:
        out = col.cast("string")
    return F.coalesce(out, F.lit(""))


def number_column(col: Column, kind: T.DataType) -> Column:
    """A column as finite doubles; everything else is null (missing)."""
    if isinstance(kind, T.IntegralType | T.DecimalType):  # always finite: a bare cast, which a comparison with a number can be taken through to the scan
        return col.cast("double")
    if isinstance(kind, T.NumericType):
        out = col.cast("double")
    elif isinstance(kind, T.StringType):
        bare = F.btrim(col, F.lit(TRIMMED))
        radix = F.conv(F.substring(bare, 3, 64), 16, 10).try_cast("double")
        out = F.when(bare.rlike(_NUMBER), bare.try_cast("double")).when(bare.rlike(r"^0[xX][0-9a-fA-F]+$"), radix)
        out = out.otherwise(F.when(bare.rlike(r"^0[bB][01]+$"), F.conv(F.substring(bare, 3, 64), 2, 10).try_cast("double")).when(bare.rlike(r"^0[oO][0-7]+$"), F.conv(F.substring(bare, 3, 64), 8, 10).try_cast("double")))
    else:
        return F.lit(None).cast("double")
    return F.when(F.isnotnull(out) & ~F.isnan(out) & (F.abs(out) < float("inf")), out)


def boolean_column(col: Column, kind: T.DataType) -> Column:
    """A column as booleans: those, and the strings true and false."""
    if isinstance(kind, T.BooleanType):
        return col
    if isinstance(kind, T.StringType):
        return F.when(col == "true", F.lit(True)).when(col == "false", F.lit(False))
    return F.lit(None).cast("boolean")


def tags_column(col: Column, kind: T.DataType) -> Column:
    """A column as sets of strings: non-empty arrays without nulls; everything else is null (missing)."""
    if not isinstance(kind, T.ArrayType):
        return F.lit(None).cast("array<string>")
    item = kind.elementType
    out = F.array_compact(col)
    out = F.array_distinct(out if isinstance(item, T.StringType) else F.transform(out, lambda x: text_column(x, item)))
    return F.when(F.size(out) > 0, out)
