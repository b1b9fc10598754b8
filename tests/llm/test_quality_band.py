"""The perplexity band of the quality rules: junk made of the language's own words, and the ranges of the word table."""

import random

import pytest

from tarmac.llm import quality

DOCS = "doc_id long, text string, lang string"


def prose(rng, vocabulary, n):
    """Words as in a language: a few are frequent, most are rare."""
    return [vocabulary[min(int(rng.paretovariate(0.7)), len(vocabulary)) - 1] for _ in range(n)]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    syllables = "an er ti on re th in ed st ou ha ly".split()
    vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    rows = [(i, " ".join(prose(rng, vocabulary, 200)), "en") for i in range(120)]
    signs = [" ".join(w + rng.choice(["%%%", "***", "###"]) for w in prose(rng, vocabulary, 150)) for _ in range(4)]
    table = [" | ".join(rng.choice(vocabulary) for _ in range(150)) for _ in range(4)]
    shuffled = ["".join(rng.sample(t, len(t))) for t in (" ".join(prose(rng, vocabulary, 150)) for _ in range(4))]
    rows += [(1000 + k, t, "en") for k, t in enumerate([*signs, *table, *shuffled])]
    return [*rows, (2000, " ".join(["|", "--", "*", "..."][k * k % 4] + "!" * (k % 29) for k in range(60)), "en")]


def judged(spark, docs):
    return {r.doc_id: r for r in quality.judged(spark.createDataFrame(docs, DOCS)).collect()}


def test_junk_of_the_languages_own_words_is_rejected(spark, docs):
    got = judged(spark, docs)
    assert all(got[i].kept for i in range(120))
    assert not [i for i in got if 1000 <= i < 2000 and (got[i].base_failed or got[i].kept)]


def test_no_word_with_a_letter(spark, docs):
    got = judged(spark, docs)[2000]
    assert not got.base_failed and got.perplexity is None and not got.kept


def test_ranges_of_the_table_add_up(spark, docs, monkeypatch):
    docs = [*docs, docs[3], (3000, "日本語の文章です。" * 9 + " 日本 " * 30, "ja"), (3001, None, None)]
    whole = judged(spark, docs)
    monkeypatch.setattr(quality, "TABLE_WORDS", 300)
    for i, r in judged(spark, docs).items():
        assert r.perplexity == pytest.approx(whole[i].perplexity) and r.kept == whole[i].kept
