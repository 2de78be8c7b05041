"""Cuts of edit-aware token counts: leaves add up to the whole, and an edit touches little in any kind of text."""

import random

import pytest
import regex

from spanweave.llm import token_counts
from spanweave.llm.storage import tokenizer_path

ALPHABETS = [
    "abcdefghijklmnopqrstuvwxyz", "ABCxyz019", "aé üß", "中文字符测试，。的一是", "テスト日本語の", "\n\t \r", "'strevmld ", "-=*#{}[]();:,.", "0123456789.", "\x1c\x1d\x85\xa0 　", "👍🏽😀é́", "٠١٢३४", "Ⅷ½²",
]


@pytest.fixture(scope="module")
def parts():
    with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        return token_counts.counter(f.read())


@pytest.mark.parametrize("size", [1, 3, 20, 96])
def test_leaves_add_up(parts, size):
    count, joined = parts
    draw = random.Random(size)
    for _ in range(1500):
        kinds = draw.sample(ALPHABETS, draw.randint(1, 4))
        text = "".join(draw.choice(draw.choice(kinds)) for _ in range(draw.randint(0, 150)))
        leaves = token_counts.leaves_of(text, size, joined)
        assert "".join(leaves) == text and sum(count(leaves)) == count([text])[0], (text, leaves)


def test_borders_are_borders_of_the_pattern():
    draw = random.Random(6)
    pattern = regex.compile(token_counts.PATTERN)
    for _ in range(2000):
        kinds = draw.sample([a for a in ALPHABETS if "\x1c" not in a], draw.randint(1, 4))
        text = "".join(draw.choice(draw.choice(kinds)) for _ in range(draw.randint(0, 80)))
        ends = {m.end() for m in pattern.finditer(text)} | {0, len(text)}
        assert {m.start() for m in token_counts._BORDER.finditer(text)} <= ends, text


def test_edits_of_any_text_count_like_a_full_encoding(parts):
    count, joined = parts
    draw = random.Random(5)
    for _ in range(40):
        kinds = draw.sample(ALPHABETS, draw.randint(1, 4))
        some = lambda n: "".join(draw.choice(draw.choice(kinds)) for _ in range(n))  # noqa: B023, E731
        text = some(draw.randint(0, 3000))
        tree = token_counts.SegmentTree(text, count, 24, joined)
        for _ in range(20):
            pos, removed, added = draw.randint(-2, len(text) + 2), draw.choice([0, 1, 3, 90]), some(draw.choice([0, 1, 4, 150]))
            tree.edit(pos, removed, added)
            at = min(max(pos, 0), len(text))
            text = text[:at] + added + text[at + min(removed, len(text) - at) :]
            assert tree.text == text and tree.total == count([text])[0]


def kinds_of_text():
    draw = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    return {
        "chinese": "".join(chr(draw.randint(0x4E00, 0x9FA5)) for _ in range(30_000)),
        "japanese": "".join(draw.choice("日本語の文章を書くテスト。、") for _ in range(30_000)),
        "identifier": "".join(draw.choice(letters) for _ in range(30_000)),
        "log lines": "\n".join(f"2024-01-{draw.randint(10, 28)}T{draw.randint(10, 23)}:00:00Z;error;code={draw.randint(0, 9999)}" for _ in range(800)),
        "csv": "\n".join(",".join(str(draw.randint(0, 10**6)) for _ in range(12)) for _ in range(400)),
        "code": "\n".join(f"\t\tself.values[{k}]=other.take(key={k},default=None)" for k in range(700)),
        "one word a line": "\n".join("".join(draw.choice(letters) for _ in range(6)) for _ in range(4000)),
        "digits": "".join(draw.choice("0123456789") for _ in range(20_000)) + " " + "7f" * 5000,
    }


@pytest.mark.parametrize("kind", kinds_of_text())
def test_an_edit_touches_little_in(parts, kind):
    count, joined = parts
    text = kinds_of_text()[kind]
    if kind == "digits":
        # Every pair of digits is in some token: there is no sure cut inside a number, but beside it.
        text = text[20_000:]
    draw = random.Random(3)
    tree = token_counts.SegmentTree(text, count, joined=joined)
    for _ in range(60):
        before = tree.encoded
        tree.edit(draw.randrange(tree.chars[1]), 1, draw.choice(["x", "中", " ", "", "1"]))
        assert tree.encoded - before < 1500, kind
    assert tree.encoded < 60 * 700 + len(text) and tree.total == count([tree.text])[0]
