"""Only what anchors and equal pieces leave open is sorted, and nothing is lost by that."""

import random

import brute
import pytest
from test_text_operators import frame

from tarmac.llm import suffix_dedup


def near_copies(seed, n):
    rng = random.Random(seed)
    some = ["".join(rng.choice("abcdefgh ") for _ in range(3000)) for _ in range(2)]
    rows = []
    for i in range(n):
        text = list(some[i % 2])
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = "x"
        at = rng.randrange(len(text) - 600)
        rows.append((i, "".join(text) if i % 3 else f"{i} " + "".join(text[at : at + rng.randrange(395, 600)]) + f" {i}"))
    return [*rows, (n, "ab" * 900), (n + 1, "x" + "ab" * 700), (n + 2, "é" * 399), (n + 3, None), (n + 4, some[0] + some[0])]


@pytest.mark.parametrize("base", [1 << 20, 300, 60], ids=["one task", "many runs", "levels"])
def test_near_copies(spark, base):
    rows = near_copies(5, 30)
    got = suffix_dedup.remove_repeats(frame(spark, rows), base).drop("kept").collect()
    assert sorted(map(tuple, got)) == sorted(brute.repeats(rows))


def test_far_fewer_symbols_than_bytes_are_sorted(spark, monkeypatch):
    sorted_ = []
    ranks = suffix_dedup.suffix_ranks

    def counted(string, n, *args, **named):
        sorted_.append(n)
        return ranks(string, n, *args, **named)

    monkeypatch.setattr(suffix_dedup, "suffix_ranks", counted)
    rows = near_copies(7, 20)
    got = suffix_dedup.remove_repeats(frame(spark, rows), 60).drop("kept").collect()
    expected = brute.repeats(rows)
    assert sorted(map(tuple, got)) == sorted(expected)
    assert 0 < max(sorted_) < sum(r[2] for r in expected) / 3
