"""Novelty tells random keys from names, slugs and paths of words that its dictionary does not hold."""

from __future__ import annotations

import random
import string

import pytest

from siftwell.llm import secrets

#: Words that the dictionary's lines are not made of.
HELD_OUT = "breakfast favourite garden holiday kitchen teacher hospital doctor river mountain customer chicken lemon castle forest dragon pirate violin cactus rocket planet walnut saffron orchid bicycle umbrella lantern blanket pepper tomato harbor valley meadow whisper velvet marble".split()
#: Sentences around a candidate: alone, first, in the middle, last; prose, settings, JSON, headers, code; short and long. All are sensitive contexts but for the first.
SHAPES = [
    "token {} here", "auth {}", "secret: {} ok", "my password is {}", '{"token": "{}", "ttl": 3600}', "please keep the session token safe. It is {} and nobody else may know it, ever, or we all get in trouble",
    "export SECRET_KEY={}\nexport PATH=/usr/bin:/bin\n", "private key {}.", "cookie={}; path=/", "Bearer {}", "Authorization: Bearer {}\nHost: example.org\nAccept: */*\n", "the credential\n{}\n",
    "In this long text about gardens, rivers and mountains, where nobody expects anything, the auth code was written down as {} by mistake. Then it went on and on about teachers, hospitals and kitchens.",
    "password = '{}'\n", "session_id:{},user:bob", '  "api_key" : "{}"\n}\n', "signature={}&expires=12", "pwd {} pwd", "token\t{}\tEND", 'def f(token="{}"):\n    return token.upper()\n', '<input type="hidden" name="secret" value="{}"/>',
    "{\n  \"user\": \"bob\",\n  \"auth\": [\"{}\"],\n  \"debug\": false\n}", "secret {}",
]
ALPHABETS = {"letters": string.ascii_letters, "capitals": string.ascii_uppercase, "small letters": string.ascii_lowercase, "digits": string.digits, "hex": "0123456789abcdef", "base64": string.ascii_letters + string.digits + "+/", "letters and digits": string.ascii_letters + string.digits}


@pytest.fixture(scope="module")
def novelty():
    return secrets.Novelty(secrets.dictionary())


def names(n, rng):
    out = []
    while len(out) < n:
        some = [rng.choice(HELD_OUT) for _ in range(rng.randint(2, 4))]
        capital = [w.title() for w in some]
        text = rng.choice(["_".join(some), some[0] + "".join(capital[1:]), "-".join(some), "/" + "/".join(some), "".join(capital), "_".join(some).upper(), "-".join(capital)]) + rng.choice(["", "", "_2023", "2024", "-12", "_v2", "/page3", ".html"])
        if 16 <= len(text) <= 48:
            out.append(text)
    return out


def test_words_are_held_out():
    assert not set(HELD_OUT) & set(secrets.code_words())
    assert secrets.dictionary() == secrets.dictionary.__wrapped__()


def reported(shape, some, novelty):
    """The share of candidates that a text of that shape gives as a novel span, whole."""
    a, b = shape[: shape.index("{}")], shape[shape.index("{}") + 2 :]
    return sum((len(a), len(a) + len(x), "novel") in secrets.novel_spans(a + x + b, novelty) for x in some) / len(some)


def test_rates_over_all_sentence_shapes(novelty):
    """Keys of 20 characters on are found whatever the sentence; of names some are reported, more in the shortest sentences."""
    rows = []
    for shape in SHAPES:
        rng = random.Random(3)
        right = [reported(shape, ["".join(rng.choice(alphabet) for _ in range(rng.randint(20, 40))) for _ in range(15)], novelty) for alphabet in ALPHABETS.values()]
        short = [reported(shape, ["".join(rng.choice(alphabet) for _ in range(rng.randint(16, 19))) for _ in range(8)], novelty) for alphabet in ALPHABETS.values()]
        rows.append((sum(right) / len(right), sum(short) / len(short), reported(shape, names(100, rng), novelty)))
        print(f"{shape[:40]!r}: keys {rows[-1][0]:.3f}, of 16 to 19 characters {rows[-1][1]:.2f}, names {rows[-1][2]:.3f}")
    keys_, short_, names_ = (sum(x) / len(x) for x in zip(*rows, strict=True))
    print(f"mean {keys_:.3f} {short_:.3f} {names_:.3f}")
    assert min(x for x, _, _ in rows) >= 0.92 and keys_ >= 0.96
    assert short_ >= 0.85
    assert max(x for _, _, x in rows) <= 0.12 and names_ <= 0.05


@pytest.mark.parametrize("name", ["customer_order_number_2023", "myFavouriteBreakfast2024", "user-guide-chapter-12-final", "/docs/reference/section12/page", "get_value_set_value_01"])
def test_names_of_the_kind_that_code_holds(novelty, name):
    assert secrets.novel_spans(f"the token {name} is no secret", novelty) == []


def test_spans(novelty):
    key = "Zx8Qp2LmT7vKc9RwYb4N"
    assert secrets.novel_spans(f"Authorization: Bearer {key} and token name get_value_set_value_01", novelty) == [(22, 42, "novel")]
    assert secrets.novel_spans(f"a text about {key} alone", novelty) == []
    assert secrets.novel_spans(f"token {key} {key}", novelty) == []  # explained by its repetition
    assert secrets.novel_spans("my password is kT9!xq#Zw2@p.", novelty) == [(15, 27, "novel")]
    assert secrets.novel_spans("token QzXvKpWmJtLbYrGhNc here", novelty) == [(6, 24, "novel")]


def test_lines_after_a_novel_line_are_in_its_context(novelty):
    rng = random.Random(1)
    lines = ["".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(64)) for _ in range(6)]
    text = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(lines) + "\n-----END RSA PRIVATE KEY-----\n" + "plain words and no more " * 3 + lines[0][::-1]
    found = secrets.novel_spans(text, novelty)
    assert [text[a:b] for a, b, _ in found] == lines
