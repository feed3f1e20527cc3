"""Secret scans: base patterns, and strings whose content nothing around them explains.

For each candidate in a sensitive context the marginal cost is measured: the compressed bytes of its surroundings with it, less those without it,
by zstandard primed with a dictionary that is trained on lines of code. A trained dictionary brings its own tables of letter frequencies, and lines of the same
kind lead both frames, so that the compressor codes the letters of either with those tables. What is measured is held against what drawing the characters at
random would take, and against random strings of the candidate's own shape (a small letter for a small letter, a digit for a digit) measured at the same place, so that
the sentence around takes no part: names, slugs and paths, of known words or not, take clearly less. What reaches both is reported as kind `novel`.
"""

from __future__ import annotations

import collections
import functools
import hashlib
import importlib
import inspect
import math
import random
import re
import string
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.textbatch import slices

#: The base patterns and the shortest match (assign: of group 2).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
SHORTEST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "novel")
#: The same as HEX with its shortest length: runs are maximal either way.
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: What may be a secret by its form (signs at its end left out), and what makes a context sensitive, in up to CONTEXT characters before. What stands before
#: an equals sign is context, and the next name of a query string is no part of a value.
CANDIDATE = re.compile(r"(?:[A-Za-z0-9!@#$%^*_.+/~-]|&(?![A-Za-z_]+=)){12,}={0,2}")
TAIL = ".,!?*"
_CLASSES = (string.ascii_lowercase, string.ascii_uppercase, string.digits)
_LONG_RUN = re.compile(r"[A-Za-z0-9!@#$%^&*_.+/=~-]{24,}")
SENSITIVE = re.compile(r"password|passwd|pwd|secret|token|api.?key|credential|auth|bearer|private|access.?key|signature|session|cookie", re.ASCII | re.IGNORECASE)
CONTEXT, AROUND = 48, 160
#: Cost over that of random strings of the same shape from which a candidate is novel, and how many of those are measured; rates over names and keys are in tests/llm/test_secrets.py.
NOVEL, REFERENCES = 0.9, 6
#: What is put before the surroundings in turn: the costs of these differ by parts of a byte.
PADDINGS = ("", "e", "te", "k7")
#: Signs that a candidate with any is taken to draw from.
SIGNS = 8
#: Lines the dictionary is trained on, its bytes, and the compressor's level; lines that lead a frame: with few of them the compressor codes a frame's letters now one way, now another.
SAMPLES, DICTIONARY_BYTES, LEVEL, LEAD = 3000, 1 << 15, 19, 48
#: Where the words of those lines come from: public names and documentation of these modules of Python's standard library.
MODULES = (
    "argparse", "ast", "asyncio", "calendar", "collections", "configparser", "csv", "datetime", "decimal", "email.message", "functools", "gettext", "hashlib", "hmac", "http.client", "inspect", "itertools", "json", "locale", "logging",
    "os", "pathlib", "random", "secrets", "shutil", "socket", "sqlite3", "ssl", "statistics", "string", "struct", "subprocess", "tarfile", "tempfile", "textwrap", "threading", "tokenize", "urllib.request", "zipfile",
)


def code_words(most: int = 4000) -> list[str]:
    """The most frequent words of names and documentation in MODULES, in lower case, frequent ones first."""
    said: set[str] = set()
    for name in MODULES:
        module = importlib.import_module(name)
        # public names alone, and no modules: what else a module holds depends on what has been imported
        for key, thing in vars(module).items():
            if not key.startswith("_") and not inspect.ismodule(thing):
                said.add(key)
                if callable(thing) and isinstance(doc := getattr(thing, "__doc__", None), str):
                    said.add(doc)
                if isinstance(thing, type):
                    said.update(k for k in vars(thing) if not k.startswith("_"))
    counts = collections.Counter(w.lower() for text in sorted(said) for w in re.findall(r"[A-Za-z]{3,}", text))
    return sorted(counts, key=lambda w: (-counts[w], w))[:most]


def code_lines(n: int = SAMPLES, seed: int = 5) -> list[str]:
    """Lines that set a name to a name, a slug or a path made of code_words(); 1 in 32 to signs of any kind, so that the dictionary's tables have a code for each."""
    rng, words = random.Random(seed), code_words()
    out = []
    for _ in range(n):
        some = [rng.choice(words) for _ in range(rng.randint(1, 4))]
        capital = [w.title() for w in some]
        value = rng.choice(["_".join(some), some[0] + "".join(capital[1:]), "-".join(some), "/" + "/".join(some), "".join(capital), "".join(some)])
        value += rng.choice(["", "", "", "_2023", "2024", "-12", "_v2", "01", ".html", "_id"])
        if rng.randrange(32) == 0:
            value = "".join(chr(rng.randint(33, 126)) for _ in range(32))
        key, sign, quote = rng.choice(["token", "secret", "key", "name", "id", "url", "path", "value"]), rng.choice([" = ", ": ", "=", '": ']), rng.choice(['"', "'", ""])
        out.append(f"{key}{sign}{quote}{value}\n")
    return out


@functools.cache
def dictionary() -> tuple[bytes, bytes]:
    """The trained dictionary, and the lines that lead; built once on the driver and sent to the tasks."""
    lines = [x.encode() for x in code_lines(SAMPLES + LEAD)]
    return zstandard.train_dictionary(DICTIONARY_BYTES, lines[:SAMPLES], level=LEVEL).as_bytes(), b"".join(lines[SAMPLES:])


class Novelty:
    """Marginal compressed cost under the primed compressor."""

    def __init__(self, primed: tuple[bytes, bytes]):
        primed, self.lead = primed
        self.press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(primed, dict_type=zstandard.DICT_TYPE_FULLDICT), write_content_size=False, write_dict_id=False)

    def cost(self, before: str, candidates: list[str], after: str) -> list[float]:
        """Bits that each candidate adds to the surroundings; its own repetitions among them make it cheap.

        Frames are whole bytes, so the mean is taken over paddings that shift where the last one ends. Words in capitals say as much in lower case: the cheaper form
        counts. Other long runs of signs around the first are left out: many random ones would have the compressor fit its codes to them.
        """
        after, before = (_LONG_RUN.sub(lambda m: m[0] if candidates[0] in m[0] else " ", x) for x in (after, before))
        around = [self.lead + (pad + after + "\n" + before).encode("utf-8", "replace") for pad in PADDINGS]
        alone = sum(len(self.press.compress(x)) for x in around)

        def one(candidate: str) -> float:
            forms = {candidate, re.sub("[A-Z]{3,}", lambda m: m[0].lower(), candidate)}
            return 8 * (min(sum(len(self.press.compress(x + form.encode("utf-8", "replace"))) for x in around) for form in forms) - alone) / len(PADDINGS)

        return [one(x) for x in candidates]

    def novel(self, before: str, candidate: str, after: str) -> bool:
        """Does it cost what drawing its characters at random from their classes takes, and about as much as random strings of its shape at its place? Deterministic: the strings follow from the candidate."""
        own = self.cost(before, [candidate], after)[0]
        if own < drawn(candidate):
            return False
        rng = random.Random(zlib.crc32(candidate.encode("utf-8", "replace")))
        others = self.cost(before, [alike(candidate, rng) for _ in range(REFERENCES)], after)
        return own * len(others) >= NOVEL * sum(others)


def drawn(candidate: str) -> float:
    """Bits of drawing each character at random from all classes that the candidate's characters are of."""
    known = [kind for kind in _CLASSES if any(c in kind for c in candidate)]
    return len(candidate) * math.log2(sum(map(len, known)) + SIGNS * any(not c.isalnum() for c in candidate))


def alike(candidate: str, rng: random.Random) -> str:
    """A random string of the candidate's shape: small letters, capitals and digits are drawn anew, signs stay."""
    return "".join(rng.choice(next((kind for kind in _CLASSES if c in kind), c)) for c in candidate)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points of the base patterns, by start, then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= SHORTEST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= SHORTEST["access"]]
    found += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def novel_spans(text: str, novelty: Novelty) -> list[tuple[int, int, str]]:
    """Spans of candidates in a sensitive context whose marginal cost is that of random text. The context of a novel line holds for the line right after it."""
    if not SENSITIVE.search(text):
        return []
    out: list[tuple[int, int, str]] = []
    for m in CANDIDATE.finditer(text):
        s = m[0].rstrip(TAIL)
        a, b = m.start(), m.start() + len(s)
        if len(s) < 12 or not (out and out[-1][1] >= a - 2 or SENSITIVE.search(text, max(0, a - CONTEXT), a)):
            continue
        if novelty.novel(text[max(0, a - AROUND) : a], s, text[b : b + AROUND]):
            out.append((a, b, "novel"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(text: str, novelty: Novelty) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans."""
    base = base_spans(text)
    more = novel_spans(text, novelty)
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def find_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans of every row; null texts are empty. One pass, no shuffle.

    Repeated rows each give a row; an empty text has no spans (the hash is that of the empty string). Texts of any length are scanned whole;
    other columns are left aside; an empty table gives no rows.
    """
    primed = dictionary()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(primed)
        for batch in slices(batches):
            out = []
            for t in batch.column(1).to_pylist():
                base, every = scan(t or "", novelty)
                n = {k: 0 for k in KINDS}
                for _, _, kind in every:
                    n[kind] += 1
                out.append((*n.values(), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(look, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_novel bigint, base_sha256 string, spans string")
