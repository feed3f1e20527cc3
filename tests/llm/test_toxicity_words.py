"""Words that the lexicon must know in disguise."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from siftwell.llm import toxicity


def distance(a, b):
    """Edits between words: a letter replaced, put in or left out, or neighbours swapped."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        rows.append([i])
        for j, y in enumerate(b, 1):
            d = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, rows[i - 2][j - 2] + 1)
            rows[i].append(d)
    return rows[-1][-1]


@pytest.mark.parametrize("word", ["noron", "oron", "ztupid", "#tupid", "xathetic", "*oron", "diot", "mmoron", "omron", "athetic"])
def test_first_letter_may_be_wrong(word):
    assert toxicity.Lexicon(toxicity.SEED_TERMS).match(word) == toxicity.FUZZY
    assert toxicity.Lexicon(toxicity.SEED_TERMS, veto=[word.strip("#*")]).match(word) == 0


def test_runs_of_signs_and_words():
    lex = toxicity.Lexicon(toxicity.SEED_TERMS, stems=["vile"])
    assert lex.hits("idiot" + "!" * 200) == (1, 0, 0) and lex.hits("*" * 300 + "oron") == (0, 1, 0)
    assert lex.hits("idiot/moron,vilest...you") == (2, 0, 1) and lex.hits("a\u00a0stupid\u00a0text\u00a0set\u00a0with\u00a0hard\u00a0blanks") == (1, 0, 0)
    assert lex.hits("id!ot") == (0, 1, 0) and lex.hits("e-mail") == lex.hits("") == lex.hits("---") == (0, 0, 0)
    column = pa.array(["you " + "x" * 500 + "-idiot", "so st\u00fcpid\u2014scum", None, ""])
    assert toxicity.Scanner(lex).features(column)[:, [0, 1, 4]].tolist() == [[1, 0, 0], [1, 1, 0], [0, 0, 0], [0, 0, 0]]


def test_walk_finds_all_that_is_near():
    rng, lex = random.Random(7), toxicity.Lexicon([*toxicity.SEED_TERMS, "ass"])
    for _ in range(4000):
        w = list(rng.choice(sorted(lex.terms)))
        for _ in range(rng.randrange(4)):
            i, kind = rng.randrange(len(w)), rng.randrange(4)
            w[i : i + 1 + (kind == 3)] = [[rng.choice("abcmost")], [], [rng.choice("abcmost"), w[i]], w[i : i + 2][::-1]][kind]
            w = w or ["x"]
        w = "".join(w)
        want = toxicity.EXACT if w in lex.terms else toxicity.FUZZY if any(distance(w, t) <= toxicity.fuzz(t) for t in lex.terms) else 0
        assert lex.match(w) == want, w
