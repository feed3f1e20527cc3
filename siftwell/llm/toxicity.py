"""Toxicity scores: a Levenshtein automaton run against a lexicon trie finds terms and misspellings of them; windows of words around
each hit tell quotation from abuse; a logistic model over the hits' kinds makes the score.

The lexicon is a fixed list of general insults and what labelled rows show: terms (words in a fair share of toxic and hardly
any clean training documents) and stems (beginnings of words, whatever the ending, that are many times likelier in toxic ones). Misspellings that clean training documents
use are vetoed. Only text enters a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.tables import drop, keep
from siftwell.llm.textbatch import HashTable, lean, slices, words_of

#: General English insults.
SEED_TERMS = ("asshole", "bastard", "clown", "disgusting", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "scumbag", "stupid", "trash", "worthless")
#: Digits and signs that stand for letters in disguised words.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_LOOKALIKE_TABLE = str.maketrans(LOOKALIKES)
#: Words that report another's words.
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes quoting word words term terms slur insult insults phrase".split())
QUOTES = frozenset("\"'“”„‘’«»`")
#: Words on each side of a hit that make its window.
WINDOW = 4
#: Most labelled rows the model is fitted on, those of the smallest hashes of their ids.
MAX_LABELLED = 20_000
#: A learned term is in this share of distinct toxic training texts, in at most that share of clean ones, and so many times likelier in toxic ones.
TERM_SHARE, CLEAN_SHARE, TERM_LIFT = 0.02, 0.002, 20.0
#: A learned stem has so many letters, is in this share of toxic training documents, and is so many times likelier there.
STEM_LETTERS, STEM_SHARE, STEM_LIFT = (4, 9), 0.01, 8.0
#: Distinct words of toxic training documents that a stem begins: copies of one document repeat words but bring no new ones.
STEM_WORDS = 6
#: Most distinct words whose verdict a worker remembers, some 30 bytes each; beyond, it starts afresh.
MAX_WORDS = 500_000
FEATURES = ("abuse", "misspelt", "quoted", "dense", "stems")
#: Prior means of the model: bias, then FEATURES. Rows pull the weights away from these; without rows these hold.
PRIOR = np.array([-3.0, 5.0, 3.5, 0.5, 1.0, 1.5])

EXACT, FUZZY, STEM = 1, 2, 3

#: Signs around a word that don't count, and what parts the words of one run of characters.
SIGNS = "\t .,;:!?\"'()[]{}<>*_-#%&|/\\`~“”„‘’«»…\u00a0"
PARTS = re.compile(r"[^\w]+|_+")


def fuzz(term: str) -> int:
    """Edits allowed in a term: none up to 3 letters, 1 up to 7, else 2."""
    return 0 if len(term) <= 3 else 1 if len(term) <= 7 else 2


def letters(word: str) -> int:
    """A bitmap of the letters of a word; some letters share a bit."""
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 63)
    return out


@dataclass
class Node:
    """A node of the trie: its branches, the edits allowed in the term that ends here (-1: none ends), and the most allowed in any below."""

    branches: dict[str, Node] = field(default_factory=dict)
    fuzz: int = -1
    most: int = 0


class Lexicon:
    """A trie of terms; match() intersects it with the Levenshtein automaton of a word."""

    def __init__(self, terms: Iterable[str], veto: Iterable[str] = (), stems: Iterable[str] = ()):
        self.terms, self.veto, self.stems = frozenset(terms), frozenset(veto), frozenset(stems)
        self.root = Node()
        for term in sorted(self.terms):
            node = self.root
            for c in term:
                node = node.branches.setdefault(c, Node())
                node.most = max(node.most, fuzz(term))
            node.fuzz = fuzz(term)
        self.longest = max(map(len, self.terms), default=0) + 2
        self.shortest = min(map(len, self.terms), default=0) - 2
        #: By length of a word: letters (as bits) and fuzz of the terms that so long a word can be near.
        self.near = {n: sorted({(letters(t), fuzz(t)) for t in self.terms if abs(len(t) - n) <= fuzz(t)}) for n in range(max(0, self.shortest), self.longest + 1)}

    def match(self, word: str) -> int:
        """EXACT, STEM, FUZZY or 0. The word is in lower case; signs around it don't count, look-alikes inside it count as letters."""
        bare = word.strip(SIGNS)
        if bare in self.terms:
            return EXACT
        for k in range(STEM_LETTERS[0], min(STEM_LETTERS[1], len(bare)) + 1):
            if bare[:k] in self.stems:
                return STEM
        if not self.shortest <= len(bare) <= self.longest or bare in self.veto:
            return 0
        plain = bare.translate(_LOOKALIKE_TABLE)
        if plain in self.terms:
            return FUZZY
        # an edit brings in one letter at most and takes out one: no term is near a word whose letters differ more
        own = letters(plain)
        for t, k in self.near[len(plain)]:
            if (t & ~own).bit_count() <= k and (own & ~t).bit_count() <= k:
                return FUZZY if self.accepts(plain) else 0
        return 0

    def accepts(self, word: str) -> bool:
        """Is a term within its edits of the word (insert, delete, replace, swap of neighbours)?

        The automaton's state is a bitmap for each number of edits up to two: bit j is set if the branch so far can be the word's first j letters.
        """
        at: dict[str, int] = {}
        for j, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << j
        end = 1 << len(word)
        bits = 2 * end - 1
        # node, states of 0, 1, 2 edits, those one letter before (of 0 and 1 edits), places of that letter
        todo = [(self.root, 1, 3 & bits, 7 & bits, 0, 0, 0)]
        while todo:
            node, d0, d1, d2, o0, o1, before = todo.pop()
            for c, child in node.branches.items():
                m = at.get(c, 0)
                swap = m & before >> 1
                n0 = (d0 & m) << 1
                n1 = ((d1 & m) << 1 | d0 | (d0 | n0) << 1 | (o0 & swap) << 2) & bits
                n2 = ((d2 & m) << 1 | d1 | (d1 | n1) << 1 | (o1 & swap) << 2) & bits if child.most > 1 else 0
                if child.fuzz >= 0 and (n0, n1, n2)[child.fuzz] & end:
                    return True
                if (n0, n1, n2)[child.most]:
                    todo.append((child, n0, n1, n2, d0, d1, m))
        return False

    def hits(self, run: str) -> tuple[int, int, int]:
        """Of a run of characters between blanks, in lower case: numbers of exact, misspelt and stem hits.

        The run as a whole counts first (signs inside it may stand for letters); if that is no term, its words between signs do, however many.
        """
        kind = self.match(run)
        kinds = [kind] if kind or run.isalpha() else [self.match(w) for w in parts] if len(parts := [w for w in PARTS.split(run) if w]) > 1 else []
        return kinds.count(EXACT), kinds.count(FUZZY), kinds.count(STEM)


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[0] + x @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Scanner:
    """Hit counts of slices of texts; remembers the verdict on each distinct word."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self._reset()

    def _reset(self) -> None:
        self.table, self.kinds = HashTable(MAX_WORDS), np.zeros((1 << 14, 3), np.uint8)

    def features(self, column: pa.Array) -> np.ndarray:
        """FEATURES of each row; a row without hits (empty, null) has zeros."""
        words = words_of(column)
        number = self.table.find(words.hashes)
        new = number < 0
        if new.any():
            keys, where = np.unique(words.hashes[new], return_index=True)
            where = np.flatnonzero(new)[where]
            if self.table.n + len(keys) > MAX_WORDS and self.table.n:
                self._reset()
                keys, where = np.unique(words.hashes, return_index=True)
            kinds = self._judge(words, where)
            while len(self.kinds) < self.table.n + len(keys):
                self.kinds = np.concatenate([self.kinds, np.zeros_like(self.kinds)])
            self.kinds[self.table.n : self.table.n + len(keys)] = kinds
            self.table.insert(keys)
            number = self.table.find(words.hashes)
        kind = self.kinds[number]
        out = np.zeros((len(words.first) - 1, len(FEATURES)))
        hits = np.flatnonzero(kind.any(axis=1))
        for i, d in zip(hits.tolist(), (np.searchsorted(words.first, hits, "right") - 1).tolist(), strict=True):
            if self._quoted(words, i, int(words.first[d]), int(words.first[d + 1])):
                out[d, 2] += int(kind[i].sum())
            else:
                out[d, [0, 1, 4]] += kind[i]
        size = np.diff(words.first)
        out[:, 3] = np.minimum(1, 20 * out[:, :2].sum(axis=1) / np.maximum(size, 1))
        out[:, :3] = np.minimum(out[:, :3], 3)
        out[:, 4] = np.minimum(out[:, 4], 4)
        return out

    def _judge(self, words, where: np.ndarray) -> np.ndarray:
        length = words.ends[where] - words.starts[where]
        kinds = np.zeros((len(where), 3), np.uint8)
        for k in np.flatnonzero(length >= min(self.lexicon.shortest, STEM_LETTERS[0])).tolist():
            kinds[k] = np.minimum(self.lexicon.hits(words.text(where[k]).decode("utf-8", "replace").lower()), 255)
        return kinds

    def _quoted(self, words, i: int, lo: int, hi: int) -> bool:
        """Is the hit inside quotation marks that open and close within its window, or beside a reporting word?"""
        before = [words.text(k).decode("utf-8", "replace") for k in range(max(lo, i - WINDOW), i)]
        after = [words.text(k).decode("utf-8", "replace") for k in range(i + 1, min(hi, i + 1 + WINDOW))]
        own = words.text(i).decode("utf-8", "replace").rstrip(".,;:!?")
        opened = own[0] in QUOTES or any(w[0] in QUOTES for w in before)
        closed = own[-1] in QUOTES or any(w.rstrip(".,;:!?")[-1:] in QUOTES for w in after if w)
        return opened and closed or any(re.sub(r"\W", "", w) in REPORTING for w in before)


def _rows(docs: DataFrame, text: str, doc_id: str, *more: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *more)


def learn_terms(labelled: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """From a bounded table of (text, toxic): terms that labels show, words of clean documents that look like terms (vetoes), and stems.

    Only words over TERM_SHARE of the toxic documents (at most their mean distinct words / TERM_SHARE), or near a term, reach the driver.
    """
    labelled = labelled.dropDuplicates(["text", "toxic"])  # copies of one text show a word once
    n = labelled.agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean")).first()
    words = labelled.select("toxic", F.explode(F.array_distinct(F.split(F.lower(F.col("text")), r"[^\p{L}\p{N}]+"))).alias("word"))
    counts = words.filter(F.length("word").between(3, 24)).groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c"))
    lift = F.col("t") * max(n.clean, 1) >= F.col("c") * (TERM_LIFT * max(n.toxic, 1))
    shown = counts.filter((F.col("t") >= max(5, TERM_SHARE * n.toxic)) & (F.col("c") <= CLEAN_SHARE * n.clean) & lift & F.col("word").rlike(r"^\p{L}+$"))
    stems = learn_stems(labelled, n.toxic, n.clean)
    # a word that begins with a stem is found by that
    own = {r.word for r in shown.collect()} if n.toxic else set()
    terms = sorted({w for w in own if not any(w.startswith(s) for s in stems)} | set(SEED_TERMS))
    near = Lexicon(terms)

    @lean
    def look_alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([near.match(w) == FUZZY for w in batch.column(0).to_pylist()], pa.bool_()))

    # a word near a term is vetoed if clean documents use it and toxic ones don't use it more often in proportion
    often = F.col("c") * F.lit(max(n.toxic, 1)) >= F.col("t") * F.lit(max(n.clean, 1))
    veto = counts.filter((F.col("c") >= 1) & often).select("word").mapInArrow(look_alike, "word string")
    return terms, sorted(r.word for r in veto.collect()), stems


def learn_stems(labelled: DataFrame, toxic: int, clean: int) -> list[str]:
    """Beginnings of words that are STEM_LIFT times likelier in toxic documents; of nested ones the shortest.

    Only those in STEM_SHARE of the toxic documents reach the driver, at most (mean distinct beginnings of a document) / STEM_SHARE.
    """
    lo, hi = STEM_LETTERS
    words = F.array_distinct(F.split(F.lower(F.col("text")), r"[^\p{L}\p{N}]+"))

    def heads(w: Column) -> Column:
        return F.when(F.length(w) >= lo, F.transform(F.sequence(F.lit(lo), F.least(F.length(w), F.lit(hi))), lambda k: F.substring(w, 1, k))).otherwise(F.array().cast("array<string>"))

    each = labelled.select("toxic", F.explode(F.array_distinct(F.flatten(F.transform(words, heads)))).alias("head"))
    distinct = labelled.filter("toxic = 1").select(F.explode(words).alias("word")).distinct()
    varied = distinct.select(F.explode(heads(F.col("word"))).alias("head")).groupBy("head").agg(F.count("*").alias("w")).filter(F.col("w") >= STEM_WORDS)
    often = each.filter("toxic = 1").groupBy("head").agg(F.count("*").alias("t")).filter(F.col("t") >= max(5, STEM_SHARE * toxic)).join(varied, "head")
    among = each.filter("toxic = 0").join(F.broadcast(often), "head").groupBy("head").agg(F.count("*").alias("c"))
    lift = (F.col("t") / max(toxic, 1)) / ((F.col("c") + 0.5) / max(clean, 1))
    got = often.join(among, "head", "left").fillna(0, ["c"]).filter(lift >= STEM_LIFT).select("head").collect()
    out: set[str] = set()
    for r in sorted(got, key=lambda r: (len(r["head"]), r["head"])):
        if not any(r["head"][:k] in out for k in range(lo, len(r["head"]))):
            out.add(r["head"])
    return sorted(out)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", max_labelled: int = MAX_LABELLED) -> Model:
    """A model from the rows of labels (doc_id, toxic 0/1; nulls are left out), at most max_labelled of them.

    Conflicting or repeated labels all count. Without labels the prior weights hold.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_labelled)  # ids only; their number is the bound
    rows = keep(_rows(docs, text, doc_id).join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "labelled")
    lexicon = Lexicon(*learn_terms(rows))

    @lean
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(lexicon)
        for batch in slices(batches):
            x = scanner.features(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(x[:, k]) for k in range(len(FEATURES)))], ["toxic", *FEATURES])

    got = rows.mapInArrow(look, "toxic int, " + ", ".join(f"{k} double" for k in FEATURES)).toPandas()
    drop(rows)
    return Model(lexicon, newton(got[list(FEATURES)].to_numpy(float), got["toxic"].to_numpy(float)))


def newton(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Logistic weights (bias first) by Newton's method, held to PRIOR by a ridge; rows in any order give the same weights up to rounding."""
    x, w = np.hstack([np.ones((len(x), 1)), x]), PRIOR.copy()

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + ridge / 2 * ((w - PRIOR) ** 2).sum())

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * (w - PRIOR))
        # a whole step may overshoot where classes are far apart: halve it until the convex loss falls
        while (new := loss(w - step)) > now and np.abs(step).max() >= 1e-9:
            step = step / 2
        w, now = w - step, min(new, now)
        if np.abs(step).max() < 1e-9:
            break
    return np.round(w, 6)


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", keep_columns: Iterable[str] = ()) -> DataFrame:
    """doc_id, score (0 to 1), predicted (score >= 0.5) of every row; null texts score as empty ones. One pass, no shuffle.

    Texts of any length are read whole, repeated rows score alike, other columns are left aside; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.lexicon.terms, model.lexicon.veto, model.lexicon.stems, model.weights))

    @lean
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *words, weights = shared.value
        own = Model(Lexicon(*words), weights)
        scanner = Scanner(own.lexicon)
        for batch in slices(batches):
            s = own.score(scanner.features(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return _rows(docs, text, doc_id).mapInArrow(look, "doc_id bigint, score double, predicted int")


def reject(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs, all their columns, without the rows that are predicted toxic. One pass, no shuffle or join."""
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon.terms, model.lexicon.veto, model.lexicon.stems, model.weights))
    at = docs.columns.index(text)

    @lean
    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *words, weights = shared.value
        own = Model(Lexicon(*words), weights)
        scanner = Scanner(own.lexicon)
        for batch in slices(batches, text):
            yield batch.filter(pa.array(own.score(scanner.features(batch.column(at))) < 0.5))

    return docs.mapInArrow(sift, docs.schema)
