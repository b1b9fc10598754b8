"""A large group of texts that are nearly alike enough forms few pairs, and loses no link."""

import random

import brute
import numpy as np
import pytest
from test_text_operators import frame

from tarmac.llm import near_dups


def group(rng):
    base, texts = [f"w{k}" for k in range(150)], []
    for _ in range(90):
        text = list(base)
        for k in rng.sample(range(150), rng.choice((2, 2, 2, 3))):
            text[k] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(text))
    return [*texts, None, "", "one two", "one two"]


def test_a_group_forms_few_pairs(spark, monkeypatch):
    counts = []
    stored = near_dups.stored

    def counted(df, name):
        out = stored(df, name)
        if name == "candidates":
            counts.append(out.count())
        return out

    monkeypatch.setattr(near_dups, "stored", counted)
    rows = list(enumerate(group(random.Random(4))))
    got = near_dups.near_duplicates(frame(spark, rows)).drop("dk").collect()
    assert sorted(map(tuple, got)) == brute.near_duplicates(rows)
    assert len(counts) == 1 and counts[0] < 700


@pytest.mark.parametrize("at_once", [3, 1 << 10])
def test_bitmaps(monkeypatch, at_once):
    monkeypatch.setattr(near_dups, "AT_ONCE", at_once)
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (0, 1, 2000, 0, 7, 40, 3, 0)]
    got = near_dups._bitmaps(np.concatenate(sets), np.cumsum([0, *map(len, sets)])).to_pylist()
    ones = [sum((k % 2**64).bit_count() for k in row) for row in got]
    odd = [(np.bincount((s % 1024).astype(int), minlength=1024) % 2).sum() for s in sets]
    assert ones == odd and all(len(row) == near_dups.BITMAP for row in got)
