"""Long pre-tokens, which are merged by rank, against the library."""

import random
from pathlib import Path

import public_tokenizers
import pytest
import tokenizers

from tarmac.llm.tokens import LONG, Counter, Vocabulary

PATH = Path(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def both():
    library = tokenizers.Tokenizer.from_file(str(PATH))
    counter = Counter(Vocabulary(PATH.read_text(encoding="utf-8")))
    return counter, lambda t: len(library.encode(t, add_special_tokens=False).ids)


def words():
    rng = random.Random(3)
    yield from ("a" * n for n in (LONG - 1, LONG, LONG + 1, 4999))
    yield from ("ab" * 700 + "c", "the" * 2000, "我们" * 300, "é" * 128, "é" * 129, "!" * 999, "\n" * 700, " " * 600)
    for letters in ("ab", "abn", "etaoinshr", "aé我"):
        for _ in range(40):
            yield "".join(rng.choice(letters) for _ in range(rng.randrange(LONG - 9, 3 * LONG)))


def test_long_words_alone_and_next_to_short_ones(both):
    counter, library = both
    for word in words():
        assert counter.count([word]) == [library(word)]
    texts = [f"one {w} two three {w[:50]} don't" for w in words()]
    assert counter.count(texts) == [library(t) for t in texts]


def test_a_megabyte_of_letters(both):
    counter, library = both
    rng = random.Random(4)
    word = "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))
    assert counter.count([word]) == [library(word)]
