"""Exact n-gram Jaccard join: which documents are linked by word shingles, through signature trees.

A document's signature is a bitmap of its hashed shingles. Within a block of documents a tree is built whose nodes hold the OR of the bitmaps
below and ranges of sizes; two trees (or one with itself) are walked together, and a pair of nodes is left when no two documents below could
overlap enough, or all below are known to be connected. Blocks come from keys that together lose no link:

1. Documents of equal shingle sets form a class; one set a class goes on.
2. A first pass links most near copies cheaply: blocks of classes that share a band of min-hashes, each link verified on whole sets.
   It may miss links; it only serves to know components early.
3. The second pass is complete. A set of n shingles and one of Jaccard similarity t or more have one of any n - ceil(t n) + 1 of its shingles in common. So a
   document with that many shingles that occur in its own component only has no partner elsewhere. This is counted exactly over all documents for a sample of
   shingles by hash, the same for every document, which leaves about a tenth of them; of these, those stay whose shared shingles reach ceil(t n), counted over whole sets.
4. What stays is ordered by frequency, rare shingles first; two linked sets share one of their first n - ceil(t n) + 1 and their sizes lie in one band or in
   neighbouring ones, so a block is what shares such a shingle and a band and spans components. Of blocks of the same documents one is kept. Blocks are dealt to
   buckets, a signature goes to a bucket once, and blocks that are large still are cut into pairs of chunks. Pairs that the trees cannot exclude are verified on whole sets.

Shingle hashes have 64 bits; sets are compared by them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.components import connected
from siftwell.llm.tables import boxed, drop, keep, unboxed
from siftwell.llm.textbatch import lean, mix, slices, words_of

#: Least bits of a signature; larger sets have four times as many for each factor of four. Long signatures fold onto short ones.
BITS, BITS_FOR = 2048, 1024
#: Bands of the first pass and min-hashes in each.
BANDS, ROWS = 4, 3
#: Documents of a block (first pass), and of a chunk (second pass).
BLOCK, CHUNK = 128, 1024
#: Sampled shingles of a document, as a multiple of the share of its shingles that a partner may lack.
SAMPLE = 2.0
#: A shingle in this share of all documents, and in LEAST_HEAVY, counts as shared without being sent. The list is at most (mean set size) / HEAVY long.
HEAVY, LEAST_HEAVY = 0.005, 20
#: Rows up to which a list of ids (16 bytes each) is broadcast; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 250_000
#: Members of blocks that meet in a bucket of the second pass, on average.
BUCKET = 8_000
#: Documents of a leaf and children of a node.
LEAF, FAN = 16, 8

_ODD = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(column: pa.Array, words: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows one after another, and where each row's begin (one more entry than rows).

    A-Z are lower-cased. A row of fewer words than a shingle has its whole sequence as one; without words it has none.
    """
    w = words_of(column)
    n = len(w.hashes)
    span = max(0, n - words + 1)
    grams = np.zeros(span, np.uint64)
    for k in range(words):
        grams = mix(grams * _ODD[1] + w.hashes[k : k + span] * _ODD[2 + k])
    grams = grams.view(np.int64)
    out, starts = [], [0]
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= words:
            own = np.sort(grams[a : b - words + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:
            h = np.zeros(1, np.uint64)
            for x in w.hashes[a:b]:
                h = mix(h * _ODD[30 + b - a] + x)
            own = h.view(np.int64)
        else:
            own = grams[:0]
        out.append(own)
        starts.append(starts[-1] + len(own))
    return (np.concatenate(out) if out else grams), np.array(starts)


def prefix_length(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Of a set of n, how many first shingles hold one in common with every set of that similarity."""
    return n - (percent * n + 99) // 100 + 1


class Forest:
    """Union-find over positions of a block."""

    def __init__(self, labels: np.ndarray):
        self.up = np.unique(labels, return_inverse=True)[1].tolist()
        first: dict[int, int] = {}
        for i, x in enumerate(self.up):
            self.up[i] = first.setdefault(x, i)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        self.up[max(a, b)] = min(a, b)


class Tree:
    """A signature tree over documents order[lo:hi]: levels of nodes from leaves to one root."""

    def __init__(self, sigs: np.ndarray, sizes: np.ndarray, labels: np.ndarray, order: np.ndarray):
        self.order = order
        self.cuts = [np.arange(0, len(order), LEAF)]
        sigs, sizes, labels = sigs[order], sizes[order], labels[order]
        extra = sizes - np.bitwise_count(sigs).sum(axis=1, dtype=np.int64)
        at = self.cuts[0]
        level = (np.bitwise_or.reduceat(sigs, at), np.minimum.reduceat(sizes, at), np.maximum.reduceat(sizes, at), np.maximum.reduceat(extra, at), np.minimum.reduceat(labels, at), np.maximum.reduceat(labels, at))
        self.levels = [level]
        while len(self.levels[-1][0]) > 1:
            at = np.arange(0, len(self.levels[-1][0]), FAN)
            ors, lo, hi, ex, l0, l1 = self.levels[-1]
            self.levels.append((np.bitwise_or.reduceat(ors, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(ex, at), np.minimum.reduceat(l0, at), np.maximum.reduceat(l1, at)))

    def members(self, leaf: np.ndarray) -> list[np.ndarray]:
        return [self.order[i * LEAF : (i + 1) * LEAF] for i in leaf]


def _may(u: tuple, i: np.ndarray, v: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Could documents below nodes i of u and j of v be similar, and are they not all of one component?

    The overlap is at most the bits that both ORs have, plus the shingles that share bits within one document; it must reach
    percent / (100 + percent) of the least sizes' sum.
    """
    both = np.bitwise_count(u[0][i] & v[0][j]).sum(axis=1, dtype=np.int64)
    most = np.minimum(np.minimum(u[2][i], v[2][j]), both + np.minimum(u[3][i], v[3][j]))
    lo_u, lo_v = u[1][i], v[1][j]
    # sizes within a factor of each other: the larger of the least sizes bounds the union from below
    fits = (100 * v[2][j] >= percent * lo_u) & (100 * u[2][i] >= percent * lo_v)
    fits &= most * (100 + percent) >= percent * (lo_u + lo_v)
    return fits & ~((u[4][i] == u[5][i]) & (v[4][j] == v[5][j]) & (u[4][i] == v[4][j]))


def tree_pairs(sigs: np.ndarray, sizes: np.ndarray, labels: np.ndarray, left: np.ndarray, right: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs (of left with right, or of left with itself) that the bounds cannot exclude and that differ in label."""
    t = Tree(sigs, sizes, labels, left)
    s = t if right is None else Tree(sigs, sizes, labels, right)
    depth = max(len(t.levels), len(s.levels)) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for d in range(depth, -1, -1):
        u, v = t.levels[min(d, len(t.levels) - 1)], s.levels[min(d, len(s.levels) - 1)]
        ok = _may(u, i, v, j, percent)
        i, j = i[ok], j[ok]
        if d:
            grow_i, grow_j = d < len(t.levels), d < len(s.levels)
            i, j = _children(i, j, grow_i, grow_j, len(t.levels[d - 1][0]) if grow_i else 0, len(s.levels[d - 1][0]) if grow_j else 0)
            if right is None:
                i, j = i[i <= j], j[i <= j]
    # pairs of documents of the leaves that are left, a bounded number at a time
    out_a, out_b = [t.order[:0]], [t.order[:0]]
    extra = sizes - np.bitwise_count(sigs).sum(axis=1, dtype=np.int64)
    for k in range(0, len(i), 512):
        shape = (len(i[k : k + 512]), LEAF, LEAF)
        a = np.broadcast_to((i[k : k + 512, None] * LEAF + np.arange(LEAF))[:, :, None], shape).ravel()
        b = np.broadcast_to((j[k : k + 512, None] * LEAF + np.arange(LEAF))[:, None, :], shape).ravel()
        ok = (a < len(t.order)) & (b < len(s.order))
        if right is None:
            ok &= a < b
        x, y = t.order[a[ok]], s.order[b[ok]]
        ok = labels[x] != labels[y]
        x, y = x[ok], y[ok]
        both = np.bitwise_count(sigs[x] & sigs[y]).sum(axis=1, dtype=np.int64) + np.minimum(extra[x], extra[y])
        ok = np.minimum(both, np.minimum(sizes[x], sizes[y])) * (100 + percent) >= percent * (sizes[x] + sizes[y])
        out_a.append(x[ok])
        out_b.append(y[ok])
    return np.concatenate(out_a), np.concatenate(out_b)


def _children(i: np.ndarray, j: np.ndarray, grow_i: bool, grow_j: bool, n_i: int, n_j: int) -> tuple[np.ndarray, np.ndarray]:
    if grow_i:
        i, j = (i[:, None] * FAN + np.arange(FAN)).ravel(), j.repeat(FAN)
        i, j = i[i < n_i], j[i < n_i]
    if grow_j:
        i, j = i.repeat(FAN), (j[:, None] * FAN + np.arange(FAN)).ravel()
        i, j = i[j < n_j], j[j < n_j]
    return i, j


def signatures(flat: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Bitmaps (64-bit words) of sets one after another, each of the bits that its size asks for."""
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        bits = BITS
        while bits // BITS * BITS_FOR < b - a:
            bits *= 4
        own = np.zeros(bits, bool)
        own[(flat[a:b].view(np.uint64) & np.uint64(bits - 1)).astype(np.int64)] = True
        out.append(np.packbits(own).view(np.uint64))
    return out


def folded(sigs: list[np.ndarray]) -> np.ndarray:
    """Signatures side by side, the longer ones folded to the shortest."""
    least = min(map(len, sigs))
    return np.stack([s if len(s) == least else np.bitwise_or.reduce(s.reshape(-1, least), axis=0) for s in sigs])


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def _lists(flat: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat))


def _profile(words: int):
    """A row a document (n, digests, bands), and rows (h, c) of shingles that are frequent in a partition."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, often = 0, {}
        for batch in slices(batches):
            flat, starts = shingle_sets(batch.column(1), words)
            n = np.diff(starts)
            some = n > 0
            heads = starts[:-1][some]
            x = flat.view(np.uint64)
            digests = np.zeros((2, len(n)), np.int64)
            bands = np.zeros((len(n), BANDS), np.uint64)
            if some.any():
                for k in (0, 1):
                    digests[k, some] = np.add.reduceat(mix(x * _ODD[10 + k]), heads).view(np.int64)
                for b in range(BANDS):
                    key = np.full(int(some.sum()), b, np.uint64)
                    for r in range(ROWS):
                        key = mix(key * _ODD[40] + np.minimum.reduceat(mix(x * _ODD[12 + b * ROWS + r]), heads))
                    bands[some, b] = key
                values, counts = np.unique(flat, return_counts=True)
                for v, c in zip(values[counts > 1].tolist(), counts[counts > 1].tolist(), strict=True):
                    often[v] = often.get(v, 0) + c
            seen += len(n)
            if len(often) > 400_000:  # what is rare so far goes; an order needs no exact counts
                often = {v: c for v, c in often.items() if c >= HEAVY / 4 * seen}
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(digests[0]), pa.array(digests[1]), _lists(bands.view(np.int64).ravel(), np.arange(len(n) + 1) * BANDS), none, none], ["doc_id", "n", "d1", "d2", "bands", "h", "c"])
        heavy = [(v, c) for v, c in often.items() if c >= max(2, HEAVY / 4 * seen)]
        if heavy:
            none = pa.nulls(len(heavy), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(heavy), pa.list_(pa.int64())), pa.array([v for v, _ in heavy], pa.int64()), pa.array([c for _, c in heavy], pa.int64())], ["doc_id", "n", "d1", "d2", "bands", "h", "c"])

    return run


def _sets(words: int, heavy: np.ndarray | None = None):
    """Sets (rep, grams) of documents; with heavy also the rest of the set (light)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat, starts = shingle_sets(batch.column(1), words)
            cols = [batch.column(0), _lists(flat, starts)]
            if heavy is not None:
                light = ~is_in(flat, heavy)
                cols.append(_lists(flat[light], np.concatenate([[0], np.cumsum(light)])[starts]))
            yield pa.RecordBatch.from_arrays(cols, ["rep", "grams", "light"][: len(cols)])

    return run


def _sampled(words: int, percent: int, heavy: np.ndarray):
    """Of every document with shingles: those of the sample that are not heavy, and how many of them may be shared before it needs a closer look."""
    cut = np.uint64(min(1.0, SAMPLE * (100 - percent) / 100) * float((1 << 64) - 2048))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat, starts = shingle_sets(batch.column(1), words)
            n = np.diff(starts)
            some = np.flatnonzero(n)
            inside = (mix(flat.view(np.uint64) * _ODD[60]) < cut) & ~is_in(flat, heavy)
            m = np.add.reduceat(inside, starts[:-1][some], dtype=np.int64) if len(some) else np.zeros(0, np.int64)
            slack = m - prefix_length(n[some], percent)
            rep = batch.column(0).to_numpy(zero_copy_only=False)[some]
            # one without sampled shingles goes on by a number of its own
            none = starts[:-1][some][m == 0]
            flat[none] = mix(rep[m == 0].view(np.uint64) * _ODD[61]).view(np.int64)
            inside[none] = True
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(slack), _lists(flat[inside], np.concatenate([[0], np.cumsum(np.maximum(m, 1))]))], ["rep", "slack", "grams"])

    return run


def is_in(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array `of`."""
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def _heads(percent: int, heavy: np.ndarray):
    """Of every set whose shared shingles are enough for a partner: the first in the common order of which a partner has one, and its signature.

    The order: shingles of no other component, shared ones as listed (rare ones first), heavy ones.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            rep, comp, grams, shared = (batch.column(batch.schema.get_field_index(k)) for k in ("rep", "comp", "grams", "shared"))
            for r, c, own, known in zip(rep.to_pylist(), comp.to_pylist(), grams, shared, strict=True):
                own = own.values.to_numpy()
                ranked = known.values.to_numpy() if known.is_valid else own[:0]
                ranked = ranked[np.sort(np.unique(ranked, return_index=True)[1])]
                # the set of another row of this id may hold some of those
                ranked = np.concatenate([ranked[is_in(ranked, own)], own[is_in(own, heavy)]])
                if 100 * len(ranked) >= percent * len(own):
                    k = prefix_length(len(own), percent) - (len(own) - len(ranked))
                    out.append((r, c, len(own), ranked[:k], signatures(own, np.array([0, len(own)]))[0].tobytes()))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols[:3]), pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.binary())], ["rep", "comp", "n", "prefix", "sig"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Rows of each combination of keys, of input sorted by them."""
    held: list[pa.RecordBatch] = []
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        now = tuple(c[0] for c in cols)
        new[0] = before is not None and now != before
        before = tuple(c[-1] for c in cols)
        at = 0
        for cut in [*np.flatnonzero(new).tolist(), batch.num_rows]:
            if new[at] and held:
                yield _one(held)
                held = []
            if cut > at:
                held.append(batch.slice(at, cut - at))
            at = cut
            if at < batch.num_rows and held:
                yield _one(held)
                held = []
    if held:
        yield _one(held)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _verified(percent: int):
    """First pass: links within blocks (key, chunk), a spanning forest of them, each verified on whole sets."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ("key", "chunk")):
            n = rows.num_rows
            if n < 2:
                continue
            rep = rows.column(rows.schema.get_field_index("rep")).to_numpy()
            grams = rows.column(rows.schema.get_field_index("grams"))
            starts = grams.offsets.to_numpy().astype(np.int64)
            flat = grams.values.to_numpy()[starts[0] : starts[-1]]
            starts = starts - starts[0]
            sizes = np.diff(starts)
            order = np.argsort(sizes, kind="stable")
            a, b = tree_pairs(folded(signatures(flat, starts)), sizes, np.arange(n), order, None, percent)
            forest, out = Forest(np.arange(n)), []
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                if forest.find(i) == forest.find(j):
                    continue
                shared = len(np.intersect1d(flat[starts[i] : starts[i + 1]], flat[starts[j] : starts[j + 1]], assume_unique=True))
                if 100 * shared >= percent * (sizes[i] + sizes[j] - shared):
                    forest.join(i, j)
                    out.append((rep[i], rep[j]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in out], pa.int64()), pa.array([max(x) for x in out], pa.int64())], ["a", "b"])

    return run


def _possible(percent: int):
    """Second pass: pairs of the blocks of a bucket that the trees leave. A row has a signature and its places: block, and chunk on the side of a pair of chunks."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ("bucket",)):
            rep, comp, sizes = (rows.column(rows.schema.get_field_index(k)).to_numpy() for k in ("rep", "comp", "n"))
            sigs = [np.frombuffer(x, np.uint64) for x in rows.column(rows.schema.get_field_index("sig")).to_pylist()]
            places = rows.column(rows.schema.get_field_index("places"))
            of = np.repeat(np.arange(rows.num_rows), np.diff(places.offsets.to_numpy()))
            flat = places.flatten()
            block, chunk = (flat.field(k).to_numpy() for k in ("block", "chunk"))
            order = np.lexsort((comp[of], sizes[of], chunk, block))
            of, block, chunk = of[order], block[order], chunk[order]
            cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(block) else []
            found: set[tuple[int, int]] = set()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                own = of[lo:hi]
                c = comp[own]
                if hi - lo < 2 or c.min() == c.max():
                    continue
                side = chunk[lo:hi] != chunk[lo]
                at = np.arange(hi - lo)
                a, b = tree_pairs(folded([sigs[i] for i in own]), sizes[own], c, at[~side], at[side] if side.any() else None, percent)
                x, y = rep[own[a]], rep[own[b]]
                found.update(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), strict=True))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    return run


def _semi(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is in the kept table ids (rep)."""
    return docs.join(_hinted(ids.withColumnRenamed("rep", "doc_id")), "doc_id", "left_semi")


def _hinted(keys: DataFrame) -> DataFrame:
    """A kept table of ids, to be broadcast while its counted rows are few; beyond that Spark shuffles both sides."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def _shared(each: DataFrame) -> DataFrame:
    """Rows (g, rep, comp, ...) with lo and hi, the least and the greatest component that g occurs in, and df, in how many rows."""
    own = Window.partitionBy("g")
    return each.withColumns({"lo": F.min("comp").over(own), "hi": F.max("comp").over(own), "df": F.count("*").over(own)})


def first_pass(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between representatives of classes, each verified: most of those among near copies. docs: doc_id, text."""
    banded = classes.select("rep", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    blocks = keep(banded.join(shared, "key").select("key", "rep", F.pmod(F.xxhash64("rep", "key"), F.ceil(F.col("c") / BLOCK).cast("int")).cast("int").alias("chunk")), "bands")
    reps = keep(blocks.select("rep").distinct(), "reps")
    sets = keep(_semi(docs, reps).mapInArrow(_sets(words), "rep bigint, grams array<bigint>"), "sets")
    rows = blocks.join(sets, "rep").repartition("key", "chunk").sortWithinPartitions("key", "chunk", "rep")
    first = keep(rows.mapInArrow(_verified(percent), "a bigint, b bigint").distinct(), "first")
    for df in (sets, reps, blocks):
        drop(df)
    return first


def open_documents(docs: DataFrame, moved: DataFrame, heavy: np.ndarray, words: int, percent: int) -> DataFrame:
    """rep, comp of documents that may have a partner in another component, by the sample of shingles (kept).

    moved: rep, comp of representatives whose component has another name; comp is null for documents that represent no class.
    """
    rows = docs.mapInArrow(_sampled(words, percent, heavy), "rep bigint, slack bigint, grams array<bigint>")
    known = rows.join(_hinted(moved.withColumn("known", F.lit(True))), "rep", "left").filter("known is null or comp is not null")
    each = _shared(known.select("rep", F.coalesce("comp", "rep").alias("comp"), "slack", F.explode("grams").alias("g")))
    # of rows that share an id the sums and the least slack count: more are looked at, none less
    found = each.filter("lo < hi or slack < 0").groupBy("rep", "comp").agg(F.count("*").alias("c"), F.min("slack").alias("slack"))
    return keep(found.filter("c > slack").select("rep", "comp"), "open")


def second_pass(docs: DataFrame, alive: DataFrame, heavy: np.ndarray, words: int, percent: int) -> DataFrame:
    """Links (a, b) between documents of alive (rep, comp; kept) of different components: enough of them to connect all that is similar."""
    sets = keep(_semi(docs, alive.select("rep")).mapInArrow(_sets(words, heavy), "rep bigint, grams array<bigint>, light array<bigint>"), "sets")
    known = sets.join(_hinted(alive), "rep")
    each = _shared(known.select("rep", "comp", F.explode("light").alias("g"))).filter("lo < hi")
    shared = each.groupBy("rep").agg(F.collect_list(F.struct("df", "g")).alias("shared")).select("rep", F.transform(F.array_sort("shared"), lambda x: x["g"]).alias("shared"))
    heads = known.select("rep", "comp", "grams").join(shared, "rep", "left")
    heads = keep(heads.mapInArrow(_heads(percent, heavy), "rep bigint, comp bigint, n bigint, prefix array<bigint>, sig binary"), "heads")
    # blocks: what shares a shingle and a band of sizes and spans components; one number for both
    band = F.floor(F.log("n") / (float(np.log(100 / percent)) * 1.001)).cast("int")
    members = heads.select("rep", "comp", "prefix", F.explode(F.array(band, band + 1)).alias("band")).select("rep", "comp", "band", F.explode("prefix").alias("g"))
    members = keep(members.select(F.xxhash64("g", "band").alias("k"), "rep", "comp"), "members")
    within = members.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("who"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("and"))
    within = keep(within.filter("lo < hi").groupBy("c", "who", "and", "lo", "hi").agg(F.min("k").alias("k")).select("k", "c"), "within")
    buckets = max(1, -(-(within.agg(F.sum("c")).first()[0] or 0) // BUCKET))
    rows = members.join(within, "k")
    m = F.ceil(F.col("c") / CHUNK).cast("int")
    rows = rows.withColumn("m", m).withColumn("chunk", F.pmod(F.xxhash64("rep", "k"), F.col("m")).cast("int"))
    # a chunk meets every chunk, itself included: blocks are unordered pairs of chunks
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda k: F.least(k, F.col("chunk")) * F.col("m") + F.greatest(k, F.col("chunk"))))
    rows = rows.select("rep", "k", "chunk", meets.alias("pair")).select("rep", F.xxhash64("k", "pair").alias("block"), "chunk")
    placed = rows.groupBy(F.pmod("block", F.lit(buckets)).alias("bucket"), "rep").agg(F.collect_list(F.struct("block", "chunk")).alias("places"))
    rows = placed.join(heads.select("rep", "comp", "n", "sig"), "rep").repartition("bucket").sortWithinPartitions("bucket")
    pairs = keep(rows.mapInArrow(_possible(percent), "a bigint, b bigint").distinct(), "pairs")
    for df in (heads, members, within):
        drop(df)
    sets = sets.select("rep", "grams")
    # verification on whole sets
    met = pairs.join(sets.select(F.col("rep").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("rep").alias("b"), F.col("grams").alias("gb")), "b")
    common = F.size(F.array_intersect("ga", "gb"))
    second = keep(met.filter(100 * common >= percent * (F.size("ga") + F.size("gb") - common)).select("a", "b").distinct(), "second")
    drop(pairs)
    drop(sets)
    return second


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the least doc_id reachable over links of Jaccard similarity percent / 100 or more.

    Null, empty and blank texts have no shingles and are linked with nothing. Repeated rows are equal documents and share a component. Rows of
    one doc_id with different texts count as one document that has the links of all. A null doc_id is linked with nothing and its component is null.
    Very long texts are whole sets like any other; other columns are left aside. An empty table gives no rows.
    """
    rows = _rows(docs, text, doc_id)
    found = keep(rows.mapInArrow(_profile(words), "doc_id bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>, h bigint, c bigint"), "profiles")
    profiles = found.filter("h is null")
    total = profiles.count()
    # at most (mean set size) / HEAVY rows reach the driver
    often = found.filter("h is not null").groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= max(LEAST_HEAVY, HEAVY * total))
    heavy = np.array(sorted(r.h for r in often.select("h").collect()), np.int64)
    live = profiles.filter("n > 0 and doc_id is not null")
    classes = keep(live.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.min("bands").alias("bands")), "classes")
    rows = rows.filter("doc_id is not null")
    first = first_pass(rows, classes, words, percent)
    # rows of one id with different sets: their classes are linked
    several = keep(live.groupBy("doc_id").agg(F.min("d1").alias("x"), F.max("d1").alias("y")).filter("x <> y").select("doc_id"), "several")
    same = live.join(_hinted(several), "doc_id", "left_semi").join(classes, ["n", "d1", "d2"]).select("doc_id", "rep")
    early = connected(first.union(same.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    reps = classes.select("rep").distinct()
    gone = live.select(F.col("doc_id").alias("rep")).distinct().join(reps, "rep", "left_anti")
    others = early.filter("node <> label").select(F.col("node").alias("rep"), F.col("label").alias("comp")).join(reps, "rep", "left_semi")
    moved = keep(gone.select("rep", F.lit(None).cast("long").alias("comp")).union(others), "moved")
    alive = open_documents(rows, moved, heavy, words, percent)
    second = second_pass(rows, alive, heavy, words, percent)
    # links of the second pass join components of the first
    to = [early.select(F.col("node").alias(k), F.col("label").alias(f"to_{k}")) for k in ("a", "b")]
    late = connected(second.join(to[0], "a", "left").join(to[1], "b", "left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b")))
    known = classes.join(early.withColumnRenamed("node", "rep"), "rep", "left").select("n", "d1", "d2", F.coalesce("label", "rep").alias("part"))
    known = known.join(late.select(F.col("node").alias("part"), F.col("label").alias("root")), "part", "left").select("n", "d1", "d2", F.coalesce("root", "part").alias("comp"))
    for df in (first, several, moved, alive, second):
        drop(df)
    # equal sets share a key; Spark splits the partition of a large class
    out = profiles.join(known, ["n", "d1", "d2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))
    out = keep(out, "components")
    for df in (found, classes, early, late):
        drop(df)
    return out


def representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """docs, all their columns, with one document of each component: that of the least doc_id; rows of a null doc_id all stay."""
    found = jaccard_components(docs, text, doc_id, words, percent)
    gone = _hinted(keep(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone"))
    drop(found)
    return unboxed(boxed(docs, _key=F.col(doc_id).cast("long")).join(gone, F.col("_key") == F.col("_gone"), "left_anti"), docs.columns)
