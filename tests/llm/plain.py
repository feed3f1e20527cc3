"""Plain versions of the corpus operators, for small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again), "base_failed": len(w) < 10 or 100 * len(again) > 20 * len(w)}


def jaccard_components(rows, size=4, percent=85):
    """rows: (doc_id, text) without null ids. doc_id -> (set size, component)."""
    sets = []
    for _, t in rows:
        w = words((t or "").translate(LOW))
        sets.append(frozenset(zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    first = {}
    for i, (d, _) in enumerate(rows):
        up[find(i)] = find(first.setdefault(d, i))
    inverted = collections.defaultdict(list)
    for i, s in enumerate(sets):
        common = collections.Counter(k for g in s for k in inverted[g])
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                up[find(i)] = find(j)
        for g in s:
            inverted[g].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def dedup_lines(rows, ratio, min_pages):
    """rows: (host, text). New texts."""
    pages, held = collections.Counter(h for h, _ in rows), collections.Counter()
    for h, t in rows:
        held.update({(h, x.strip(" ")) for x in (t or "").split("\n") if x.strip(" ")})
    bad = {k for k, n in held.items() if n >= min_pages and n > pages[k[0]] * ratio}
    return [t if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" ")) not in bad) for h, t in rows]


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii(text):
    """Base spans by kind, then start."""
    t, out = text or "", []
    out += [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return out


def secrets(text):
    """Base spans by start, then kind."""
    t, out = text or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.ASCII):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def grey_jpeg(stream):
    """Blocks (in zig-zag order), width and height of a greyscale baseline JPEG, read bit by bit."""
    at, tables, restart, shape = 2, {}, 0, None
    while True:
        mark, n = stream[at + 1], int.from_bytes(stream[at + 2 : at + 4])
        body, at = stream[at + 4 : at + 2 + n], at + 2 + n
        if mark == 0xC4:
            code, k, codes = 0, 17, {}
            for length in range(1, 17):
                for _ in range(body[length]):
                    codes[format(code, f"0{length}b")] = body[k]
                    code, k = code + 1, k + 1
                code *= 2
            tables[body[0]] = codes
        elif mark == 0xDD:
            restart = int.from_bytes(body)
        elif mark == 0xC0:
            shape = int.from_bytes(body[3:5]), int.from_bytes(body[1:3])
        elif mark == 0xDA:
            break
    blocks = []
    for segment in re.split(rb"\xff[\xd0-\xd7]", stream[at:-2]):
        bits, i, before = "".join(format(b, "08b") for b in segment.replace(b"\xff\x00", b"\xff")), 0, 0
        for _ in range(min(restart, shape[0] * shape[1] // 64 - len(blocks))):
            block, k = [], 0
            while k < 64:
                if k and block[-1] is None:
                    break
                code = ""
                while code not in tables[0x10 if k else 0]:
                    code, i = code + bits[i], i + 1
                size = tables[0x10 if k else 0][code]
                v = int(bits[i : i + size] or "0", 2)
                i, k = i + size, k + 1
                block.append(None if k > 1 and not size else v if not size or bits[i - size] == "1" else v - (1 << size) + 1)
            block = [x for x in block if x is not None] + [0] * (64 - sum(x is not None for x in block))
            before = block[0] = block[0] + before
            blocks.append(block)
    return blocks, *shape


def hashed_runs(text, n=3):
    """Runs of 1 to n words in which A-Z are lower-cased and words are digits, letters and characters beyond ASCII."""
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW)) if x]
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)], len(w)


def resampled(rows, target, percent=5, least=20, buckets=10_000):
    """rows: (doc_id, text). A list of (doc_id, n_features, weight, score, rank), in any order."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    every = [(d, *hashed_runs(t)) for d, t in rows]
    s, t = collections.Counter(bucket(f) for _, fs, _ in every for f in fs), collections.Counter(bucket(f) for x in target for f in hashed_runs(x)[0])
    gain = [math.floor(1000 * math.log((float(t[b] + 1) * (s.total() + buckets)) / (float(s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for d, fs, n in every:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    can = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    for r, x in enumerate(can[: percent * len(can) // 100], 1):
        x[4] = r
    return [tuple(x[:5]) for x in out]


def ranked(rows, items, k=20):
    """rows: (doc_id, text), items: (item_id, text). A list of (item_id, rank, doc_id, score)."""
    terms = lambda t: [x for x in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW)) if x]
    docs = [(d, collections.Counter(terms(t))) for d, t in rows]
    docs = [(d, c) for d, c in docs if c]
    df = collections.Counter(x for _, c in docs for x in c)
    size, total = len(docs), sum(c.total() for _, c in docs)
    out = []
    for item, text in items:
        found = []
        for d, c in docs:
            m = 75 + 25 * c.total() * size // total
            score = sum(math.floor(1000 * math.log((2 * size + 2) / (2 * df[x] + 1))) * (1_000_000_000 * c[x] // (1000 * c[x] + 12 * m)) for x in terms(text) if x in c)
            if score:
                found.append((-score, d is not None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k], 1)]
    return out
