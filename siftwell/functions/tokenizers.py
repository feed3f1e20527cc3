"""Query tokenizers: they run once a query, on the driver; and the default one over a column."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates terms (white space and all ASCII punctuation).
DELIMITERS = "\t\n\r " + string.punctuation
_SPLIT = str.maketrans(dict.fromkeys(DELIMITERS, " "))


def split_terms(text: str) -> list[str]:
    """Non-empty terms between delimiters, in order, repeats kept."""
    return [t for t in text.translate(_SPLIT).split(" ") if t]


default_tokenizer = split_terms


def split_column(text: Column) -> Column:
    """split_terms of a column, by built-in expressions; null stays null."""
    return F.filter(F.split(text, r"[\t\n\r \p{Punct}]+"), lambda t: t != "")


def _kind(c: str) -> str:
    """upper, lower, digit or other."""
    if "0" <= c <= "9":
        return "digit"
    if c != c.lower() and c == c.upper():
        return "upper"
    return "lower" if c != c.upper() and c == c.lower() else "other"


def code_tokenizer(text: str, split_on_digit_boundaries: bool = True, min_token_length: int = 0) -> list[str]:
    """Terms split further at camelCase, ACRONYMWord and (unless turned off) letter-digit boundaries; case is kept."""
    if not isinstance(split_on_digit_boundaries, bool):
        raise TypeError("split_on_digit_boundaries is a boolean")
    if isinstance(min_token_length, bool) or not isinstance(min_token_length, int) or min_token_length < 0:
        raise ValueError("min_token_length is an integer of 0 or more")
    letters, out = {"upper", "lower"}, []
    for term in split_terms(text):
        kinds = [_kind(c) for c in term]
        cuts = [0]
        for i in range(1, len(term)):
            a, b, after = kinds[i - 1], kinds[i], kinds[i + 1] if i + 1 < len(term) else ""
            if b == "upper" and (a in ("lower", "digit") or a == "upper" and after == "lower"):
                cuts.append(i)
            elif split_on_digit_boundaries and (a == "digit" and b in letters or a in letters and b == "digit") and not (a == b == "upper"):
                cuts.append(i)
        out += [term[i:j] for i, j in zip(cuts, [*cuts[1:], len(term)], strict=True) if j - i >= min_token_length]
    return out
