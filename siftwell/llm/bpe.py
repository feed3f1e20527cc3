"""Byte-pair ids of whole texts by the tokenizers library, each distinct pre-token encoded once per worker.

A byte-level BPE encodes every pre-token by itself, so the ids of a text are those of its pre-tokens in a row. The
split into pre-tokens is computed in numpy from character classes, and what is remembered is found by hash and compared by its characters; a text with a character outside the alphabet whose
classes are certain here, or with the text of a special token, goes to the library whole. Results are the library's own in
both cases (tests/llm/test_operators.py).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from siftwell.llm.textbatch import LANE, HashTable, buffers, span_hash

#: Code points whose classes (letter, number, space, other) are taken from unicodedata; other texts go to the library whole.
_KNOWN = 0x250
_SPACE, _LETTER, _NUMBER, _OTHER, _UNKNOWN = range(5)
#: The white space of the pattern below _KNOWN.
_SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0)
_CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")


def _classes() -> np.ndarray:
    out = np.full(_KNOWN + 1, _UNKNOWN, np.uint8)
    for c in range(_KNOWN):
        kind = unicodedata.category(chr(c))[0]
        out[c] = _SPACE if c in _SPACES else _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER
    return out


_CLASS = _classes()


def pretoken_starts(chars: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where the pattern 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ begins a match.

    chars: code points below _KNOWN of non-empty texts one after another; doc_starts: where each text begins.
    """
    n = len(chars)
    kind = _CLASS[chars]
    first = np.zeros(n, bool)
    first[doc_starts] = True
    last = np.ones(n, bool)
    last[:-1] = first[1:]
    run = first.copy()  # first character of a run of one class
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    # the last space of a run before other text stands apart from the run; a plain blank joins what follows
    ends_run = space & ~last
    ends_run[:-1] &= kind[1:] != _SPACE
    cut = run | ends_run
    joined = np.zeros(n, bool)
    joined[1:] = ends_run[:-1] & (chars[:-1] == 0x20)
    cut &= ~joined
    # contractions: an apostrophe that begins a match, and the letters after it
    for i in np.flatnonzero((chars == 0x27) & cut & run):
        if i + 1 < n and not last[i]:
            for tail in _CONTRACTIONS:
                to = i + 1 + len(tail)
                if to <= n and not first[i + 1 : to].any() and all(chars[i + 1 + k] == ord(c) for k, c in enumerate(tail)):
                    cut[i + 1 : to] = False
                    if to < n:
                        cut[to] = True if not (kind[to] == _SPACE) else cut[to]
                    break
    return np.flatnonzero(cut)


def _lanes(chars: np.ndarray) -> np.ndarray:
    """The four characters from each place on, as one number."""
    return np.ndarray((len(chars) - 3,), "<u8", np.ascontiguousarray(chars).data, strides=(2,))


class Encoder:
    """Encodes Arrow string columns; holds at most max_words distinct pre-tokens, then starts afresh."""

    def __init__(self, path: str, max_words: int = 500_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = False
        self.tok.model._resize_cache(0)  # pre-tokens come here once only
        self.blank = np.zeros(self.tok.get_vocab_size(), bool)
        self.blank[[i for token, i in self.tok.get_vocab().items() if token[0] == "\u0120"]] = True
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.max_words = max_words
        self._reset()

    def _reset(self) -> None:
        self.table = HashTable(self.max_words)
        self.at = np.zeros(1024, np.int64)
        self.size = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.uint32)
        self.n_ids = 0
        self.chars_at = np.zeros(1024, np.int64)
        self.length = np.zeros(1024, np.int64)
        self.chars = np.zeros(4096, np.uint16)
        self.n_chars = 0

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encode_words(self, chars: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens chars[start:stop] one after another, and how many each has.

        Pre-tokens of a blank and letters go to the library in one string: the split puts them apart again, and in
        each exactly the first id is of a token that begins with a blank.
        """
        length = stops - starts
        blank = (length > 1) & (chars[starts] == 0x20) & (_CLASS[chars[np.minimum(starts + 1, len(chars) - 1)]] == _LETTER)
        size = np.zeros(len(starts), np.int64)
        each = length[blank]
        done = np.cumsum(each)
        flat = np.zeros(0, np.uint32)
        if len(each):
            index = np.arange(int(done[-1])) + np.repeat(starts[blank] - (done - each), each)
            joined = chars[index].tobytes().decode("utf-16-le")
            cuts = [0, *done[1999::2000].tolist(), len(joined)]
            got = self.tok.encode_batch_fast([joined[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b], add_special_tokens=False)
            flat = np.concatenate([np.array(x.ids, np.uint32) for x in got])
            size[blank] = np.diff(np.append(np.flatnonzero(self.blank[flat]), len(flat)))
        rest = [chars[a:b].tobytes().decode("utf-16-le") for a, b in zip(starts[~blank], stops[~blank], strict=True)]
        got = [x.ids for x in self.tok.encode_batch_fast(rest, add_special_tokens=False)]
        size[~blank] = np.fromiter(map(len, got), np.int64, len(got))
        out = np.empty(int(size.sum()), np.uint32)
        of_blank = np.repeat(blank, size)
        out[of_blank] = flat
        out[~of_blank] = np.fromiter((i for x in got for i in x), np.uint32)
        return out, size

    def _learn(self, keys: np.ndarray, chars: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
        flat, size = self._encode_words(chars, starts, stops)
        n, m = self.table.n, len(keys)
        while len(self.ids) < self.n_ids + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.at) < n + m:
            self.at, self.size, self.chars_at, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size, self.chars_at, self.length))
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.at[n : n + m] = self.n_ids + np.cumsum(size) - size
        self.size[n : n + m] = size
        self.n_ids += len(flat)
        length = stops - starts
        done = np.cumsum(length)
        own = chars[np.arange(int(done[-1])) + np.repeat(starts - (done - length), length)]
        while len(self.chars) < self.n_chars + len(own) + 4:
            self.chars = np.concatenate([self.chars, np.zeros_like(self.chars)])
        self.chars[self.n_chars : self.n_chars + len(own)] = own
        self.chars_at[n : n + m] = self.n_chars + done - length
        self.length[n : n + m] = length
        self.n_chars += len(own)
        self.table.insert(keys)

    def _others(self, chars: np.ndarray, starts: np.ndarray, stops: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Pre-tokens that are not the remembered ones of their hashes. Up to three characters are told apart by the hash itself."""
        length = stops - starts
        other = self.length[slot] != length
        some = np.flatnonzero((length > 3) & ~other)
        if len(some):
            here = _lanes(np.concatenate([chars, np.zeros(4, np.uint16)]))
            there = _lanes(self.chars)
            count = (length[some] + 3) >> 2
            done = np.cumsum(count)
            k = 4 * (np.arange(int(done[-1])) - np.repeat(done - count, count))
            left = np.minimum(np.repeat(length[some], count) - k, 4)
            differ = ((here[np.repeat(starts[some], count) + k] ^ there[np.repeat(self.chars_at[slot[some]], count) + k]) & LANE[2 * left]) != 0
            other[some] = np.logical_or.reduceat(differ, done - count)
        return np.flatnonzero(other)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another (uint32), and the number of ids of each row."""
        raw, off = buffers(column)
        plain, texts = self._plain(column, raw, off)
        counts = np.zeros(len(off) - 1, np.int64)
        flat, per_doc = self._encode_plain(raw, off, plain) if plain.any() else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        counts[plain] = per_doc
        if texts:
            whole = {i: self._whole(t) for i, t in texts.items()}
            for i, x in whole.items():
                counts[i] = len(x)
            ends = np.cumsum(counts)
            out = np.empty(int(ends[-1]), np.uint32)
            keep = np.ones(len(out), bool)
            for i, x in whole.items():
                out[ends[i] - len(x) : ends[i]] = x
                keep[ends[i] - len(x) : ends[i]] = False
            out[keep] = flat
            flat = out
        return flat, counts

    def _plain(self, column: pa.Array, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, dict[int, str]]:
        """Which rows take the fast way (empty rows do not count), and the texts of those that cannot."""
        n = len(off) - 1
        plain = off[1:] > off[:-1]
        odd = np.flatnonzero(raw >= 0xCA)  # lead bytes of code points from U+0280 on; 0xC9 with a later tail is below
        late = np.flatnonzero((raw[:-1] == 0xC9) & (raw[1:] >= 0x90)) if len(raw) else odd
        bad = np.unique(np.searchsorted(off, np.concatenate([odd, late]), "right") - 1)
        data = raw.tobytes()
        for mark in self.special:
            at = data.find(mark)
            while at >= 0:
                bad = np.append(bad, np.searchsorted(off, at, "right") - 1)
                at = data.find(mark, at + 1)
        bad = np.unique(bad).astype(int)
        plain[bad[bad < n]] = False
        return plain, {int(i): data[off[i] : off[i + 1]].decode() for i in bad if i < n}

    def _encode_plain(self, raw: np.ndarray, off: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if plain.all():
            size, some = np.diff(off), raw
        else:
            size = np.diff(off)[plain]
            some = raw[np.repeat(plain, np.diff(off))]
        ends = np.cumsum(size)
        # UTF-8 of one or two bytes a character, to code points
        lead = (some & 0xC0) != 0x80
        if lead.all():
            chars, doc_starts = some.astype(np.uint16), ends - size
        else:
            at = np.flatnonzero(lead)
            first = some[at].astype(np.uint16)
            two = first >= 0xC0
            chars = first
            chars[two] = ((first[two] & 0x1F) << 6) | (some[at[two] + 1] & 0x3F)
            doc_starts = np.searchsorted(at, ends - size)
        starts = pretoken_starts(chars, doc_starts)
        stops = np.append(starts[1:], len(chars))
        hashes = span_hash(chars, starts, stops)
        slot = self.table.find(hashes)
        if (slot < 0).any():
            keys, where = np.unique(hashes[slot < 0], return_index=True)
            if self.table.n + len(keys) > self.max_words and self.table.n:
                self._reset()
                keys, where = np.unique(hashes, return_index=True)
            else:
                where = np.flatnonzero(slot < 0)[where]
            self._learn(keys, chars, starts[where], stops[where])
            slot = self.table.find(hashes)
        each, src, ids = self.size[slot], self.at[slot], self.ids
        other = self._others(chars, starts, stops, slot)
        if len(other):  # a hash that two share: the second is encoded wherever it stands
            more, size = self._encode_words(chars, starts[other], stops[other])
            each[other], src[other] = size, len(ids) + np.cumsum(size) - size
            ids = np.concatenate([ids, more])
        done = np.cumsum(each)
        index = np.arange(int(done[-1])) + np.repeat(src - (done - each), each)
        bounds = np.searchsorted(starts, np.append(doc_starts, len(chars)))
        before = np.concatenate([[0], done])
        return ids[index], np.diff(before[bounds])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def documents(flat: np.ndarray, counts: np.ndarray, end_id: int) -> Iterator[np.ndarray]:
    """The ids of each row with end_id behind them."""
    at = 0
    for n in counts:
        out = np.empty(n + 1, np.uint32)
        out[:n] = flat[at : at + n]
        out[n] = end_id
        at += n
        yield out
