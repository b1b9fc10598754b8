"""Operator 13 against a plain version: groups, links and corpus-wide counts."""

import hashlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from tarmac.llm import alignment

A = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
B = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
ODD = [
    None, "", "a", "two words", "two words", "日本語のテキスト", "😀😃🏳️‍🌈 x", "<|endoftext|> <s> hi", "a ▁▁ b", "  two  spaces\n\n\ttab ",
    "\x00\x1c\x85 é ñ", "a" * 3000, " lead", "trail ", "‘q’ “d” — … €", "𝒳𝒴 z", "ﬁ ﬂ Å ①", "don't we'll 12 34abc", "\n", " ",
]


def plain(texts):
    tokenizer = tokenizers.Tokenizer.from_str(A)
    tokenizer.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_proto=B)
    a_bytes, b_bytes = alignment.ByteTokens(A).bytes, alignment.PieceTokens(B).bytes
    rows, counts = [], Counter()
    for text in texts:
        data = f" {text or ''}".encode()
        a = tokenizer.encode(f" {text or ''}", add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        if not b"".join(a_bytes[i] for i in a) == data == b"".join(b_bytes[i] for i in b):
            a, b = [], []
        owner = [[k for k, i in enumerate(ids) for _ in table[i]] for ids, table in ((a, a_bytes), (b, b_bytes))]
        links = Counter((a[x], b[y]) for x, y in set(zip(*owner, strict=True)))
        ends = [set(np.cumsum([len(t[i]) for i in ids]).tolist()) for ids, t in ((a, a_bytes), (b, b_bytes))]
        groups, last = [], 0
        for cut in sorted(ends[0] & ends[1]):
            parts = [dict.fromkeys(o[last:cut]) for o in owner]
            groups.append("|".join(",".join(str(ids[k]) for k in p) for ids, p in zip((a, b), parts, strict=True)))
            last = cut
        counts.update(links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        rows.append((len(a), len(b), len(groups), links, digest))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [
        (
            a, b, g, sum(links.values()),
            sum(n for (x, y), n in links.items() if counts[x, y] == most[y]),
            sum(n * counts[p] for p, n in links.items()), d,
        )
        for a, b, g, links, d in rows
    ]


@pytest.mark.parametrize("common", [1 << 20, 40, 0], ids=["all held", "some held", "none held"])
def test_alignment(spark, common):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()
    texts = ODD + [r.text for r in docs]
    rows = [(i % 70, t, "x", 1) for i, t in enumerate(texts)]  # ids may repeat
    df = spark.createDataFrame(rows, "doc_id int, text string, pairs string, n_a int")
    got = alignment.align_tokens(df, A, B, common)
    assert got.schema["doc_id"].dataType.simpleString() == "int"
    expected = [(r[0], *x) for r, x in zip(rows, plain(texts), strict=True)]
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_no_rows(spark):
    assert alignment.align_tokens(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_groups_of_random_cuts():
    rng = np.random.default_rng(4)
    for _ in range(300):
        sizes = rng.integers(1, 40, size=rng.integers(1, 5))
        limits = np.concatenate([[0], np.cumsum(sizes)])
        p = rng.choice([0.05, 0.3, 0.9])
        a, b = (np.union1d(np.flatnonzero(rng.random(limits[-1] + 1) < p)[1:], limits[1:]) for _ in range(2))
        a, b = a[a > 0], b[b > 0]
        got = alignment.group_ends(a, b, limits[:-1], limits[1:])
        assert got.tolist() == np.intersect1d(a, b).tolist()
