"""Highlight ranges of matches, in UTF-16 units of the original text, and rendering with tags.

Only rows of a result page come here. The original text is cut into grapheme clusters; each cluster's normalized characters all stand
for the whole cluster, so that no range cuts one.
"""

from __future__ import annotations

import html
import re
import unicodedata
from itertools import pairwise

import regex

from siftwell.functions.match import Query, place
from siftwell.functions.normalize import TRIMMED, fold, normalize_text

Range = tuple[int, int]
_CLUSTERS = regex.compile(r"\X")
#: How an element's name begins a tag, and how an apostrophe is escaped.
_TAG = re.compile(r"[a-zA-Z][a-zA-Z0-9_-]*")
APOSTROPHE = "&#39;"


def _units(text: str) -> int:
    return len(text) + sum(c > "￿" for c in text)


def source_map(text: str, folded: bool) -> tuple[str, list[Range]]:
    """The normalized text, and for each of its characters the range of the original it stands for."""
    bare = text.lstrip(TRIMMED)
    at = _units(text) - _units(bare)
    out, spans = [], []
    for cluster in _CLUSTERS.findall(bare.rstrip(TRIMMED)):
        part = unicodedata.normalize("NFC", cluster)
        if folded:
            part = unicodedata.normalize("NFC", fold(part))
        pieces = [cluster] if cluster != "\r\n" else ["\r", "\n"]
        if len(pieces) == 2:
            part = "\r\n"
        size = _units(cluster)
        for k, c in enumerate(part):
            out.append(c)
            spans.append((at + k, at + k + 1) if len(pieces) == 2 else (at, at + size))
        at += size
    return "".join(out), spans


def merge_ranges(ranges: list[Range]) -> list[Range]:
    """Overlapping and touching ranges joined, in order; inverted ones turned, negative ends cut, empty ones left out."""
    out: list[list[int]] = []
    for a, b in sorted((max(0, min(r)), max(0, max(r))) for r in ranges):
        if a == b:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def align_highlights(text: str | None, query: Query, folded: bool = True) -> list[Range]:
    """Ranges of the query's match in text; none without a match."""
    if not text or not query.text:
        return []
    norm, spans = source_map(text, folded)
    found = place(norm, query)
    if found is None:
        return []
    return merge_ranges([(spans[a][0], spans[a + n - 1][1]) for a, n in found[1] if n])


def _marks(tag: str) -> tuple[str, str]:
    """What opens and closes an element of this tag, whose name attributes may follow."""
    bare = tag.strip()
    if (name := _TAG.match(bare)) is None:
        raise TypeError(f"{tag!r} is no tag of an element")
    return f"<{bare}>", f"</{name[0]}>"


def render_highlighted(text: str | None, ranges: list[Range], tag: str = "mark", escape_html: bool = False) -> str:
    """text with each range in a tag (attributes allowed after its name)."""
    units = (text or "").encode("utf-16-le", "surrogatepass")
    edges = [min(2 * x, len(units)) for r in merge_ranges(ranges) for x in r]
    pieces = [units[a:b].decode("utf-16-le", "surrogatepass") for a, b in pairwise([0, *edges, len(units)])]
    if escape_html:
        pieces = [html.escape(p).replace("&#x27;", APOSTROPHE) for p in pieces]
    # pieces lie outside and inside of ranges by turns
    before, after = _marks(tag) if text and ranges else ("", "")
    return "".join(f"{before}{p}{after}" if k % 2 and p else p for k, p in enumerate(pieces))


def guard_cluster_boundary(text: str, end: int) -> int:
    """The end (UTF-16 units) moved behind the grapheme cluster that it would cut."""
    at = 0
    if end <= 0:
        return 0
    for cluster in _CLUSTERS.findall(text):
        size = _units(cluster)
        if at < end < at + size:
            return at + size
        at += size
    return min(end, at)


def normalized_query(text: str, folded: bool = True) -> str:
    return normalize_text(text, folded)
