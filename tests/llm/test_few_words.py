"""Texts of few words, alone in a partition and as the tail of a large batch."""

import brute
import pytest
from pyspark.sql import functions as F

from tarmac.llm import grams, main_text, near_dups, quality

WORDS = "a b c d e f g h i".split()


def test_alone(spark):
    """Each word count from 0 to 9 in a partition of its own."""
    texts = [" ".join(f"{w}{n}" for w in WORDS[:n]) for n in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartitionByRange(10, "doc_id")
    assert {len(p) for p in docs.rdd.glom().collect()} == {1}
    for row in quality.judged(docs.withColumn("lang", F.lit("en"))).collect():
        counts = (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words)
        assert counts == brute.rules(texts[row.doc_id])
        assert row.base_failed and not row.kept
    got = near_dups.near_duplicates(docs).drop("dk").collect()
    assert sorted(map(tuple, got)) == brute.near_duplicates(list(enumerate(texts)))


@pytest.mark.parametrize("n", range(10))
@pytest.mark.parametrize("size", [5, 8])
def test_grams_of_a_run(n, size):
    import pyarrow as pa

    ((_, run),) = grams.texts(pa.array([" ".join(WORDS[:n])]))
    for whole in (False, True):
        hashes, text, at = grams.word_grams(run, size, whole)
        expected = max(n - size + 1, 0) or int(whole and n > 0)
        assert len(hashes) == len(text) == len(at) == expected


def test_tail_of_a_large_batch(spark):
    texts = [" ".join(f"{w}{i % 50}" for w in WORDS) for i in range(10_000)] + ["two words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = {r.doc_id: r for r in near_dups.near_duplicates(docs).collect()}
    assert (rows[10_000].n_shingles, rows[10_000].component_id) == (1, 10_000)
    assert all(rows[i].component_id == i % 50 for i in range(10_000))


def test_deep_pages_take_linear_time():
    page = "<div>" * 200_000 + "text" + "</div>" * 200_000
    assert main_text.main_text(page) == "text"


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p title='a > b'>yes</p>", "yes"),
        ('<p data-x="5\'>"y>yes</p>', "yes"),
        ("<p it's>yes</p><p>no 'quotes' here</p>", "yes no 'quotes' here"),
        ("<p>yes</p><a b='<p>x", "yes"),
    ],
)
def test_quotes_in_tags(page, text):
    assert main_text.main_text(page) == text
