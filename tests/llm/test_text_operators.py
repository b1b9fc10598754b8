"""Operators on documents and pages against plain versions, with nulls, empty and long texts, ties and repeated rows."""

import random
from pathlib import Path

import brute
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from tarmac.llm import line_dedup, main_text, near_dups, quality, suffix_dedup, tokens, url_rules

DATA = "/root/testdata/sf0.001/documents.parquet"
DOCS = "doc_id long, text string, lang string, source string, `row` string, size long"


def documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(DATA).orderBy("doc_id").collect()]
    return [(i, t) for i, t in rows if len(t) < 6000][:110]


def odd(rng):
    """Texts at the edges: null, empty, white space, few words, repeated, very long, in chains of small changes."""
    word = lambda: rng.choice("ab cd efg hij klm nop qrs tuv wxyz é 日本".split())
    base = [word() + str(rng.randint(0, 99)) for _ in range(60)]
    out = [None, "", " \n\t ", "one", "One", "one two three four", "a b c d e", " ".join(base), " ".join(base).upper()]
    for k in range(12):
        base = [*base]
        base[rng.randrange(60)] = f"new{k}"
        out += [" ".join(base), "\n".join([*base[:7], " ".join(base[7:])])]
    return [*out, " ".join(word() for _ in range(20_000)), "ha " * 500, "x" * 3000]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", "r", 1) for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def texts(spark):
    rows = documents(spark)
    return rows + [(1000 + k, t) for k, t in enumerate(odd(random.Random(5)))]


def test_rules_and_bands(spark, texts):
    df = frame(spark, texts)
    got = {r.doc_id: r for r in quality.judged(df).collect()}
    for i, t in texts:
        r = got[i]
        counts = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert counts == brute.rules(t), i
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        assert r.base_failed == failed and not (failed and r.kept)
        if not failed:
            assert r.kept == (r.lowest <= r.perplexity <= r.highest)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in got if got[i].kept}


def test_unlike_texts_are_rejected(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("aeioutnrs") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    clean = [(i, " ".join(rng.choice(vocabulary) for _ in range(80))) for i in range(60)]
    noise = [(100, " ".join("".join(rng.choice("QXZJKVW0123456789~^") for _ in range(6)) for _ in range(80)))]
    kept = {r.doc_id: r.kept for r in quality.judged(frame(spark, clean + noise)).collect()}
    assert not kept[100] and all(kept[i] for i, _ in clean)


def test_probabilities_sum_to_one(spark):
    """After any context the model's characters, with what it keeps for unseen ones, share a probability of one."""
    docs = frame(spark, [(1, "abracadabra abba cab"), (2, "banana cabana")])
    model = quality.language_model(docs)
    code, chars = quality._lang_code("en"), sorted({*"abracadabra abba cab", *"banana cabana"})
    keys = []
    for c in chars:
        key = code << (64 - quality.LANG_BITS)
        for k, x in enumerate([c, "b", "a"]):
            key |= (ord(x) + 1) << (quality.CHAR_BITS * k)
        keys.append(key)
    p = 2.0 ** quality._log_probabilities(model, quality.np.array(keys, dtype=quality.np.uint64))
    assert 0.9 < p.sum() <= 1.001


@pytest.mark.parametrize("base", [1 << 20, 700], ids=["one task", "levels"])
def test_suffix_dedup(spark, base):
    rng = random.Random(3)
    some = [" ".join(rng.choice("ab cd efg hij klmn opq".split()) for _ in range(150)) for _ in range(4)]
    rows = [
        some[0] + "x" + some[1], "zz" + some[1][30:] + "é" + some[0][:430], some[2] + some[2], "a" * 1500, None, "",
        some[3][:399], some[3][:399], some[3][:400], some[3][:400], "q" + some[3][:450], some[0][:420] + some[1][5:440],
    ]
    rows = [(i, t) for i, t in enumerate(rows)] + [(9, some[3][:400])]
    got = suffix_dedup.remove_repeats(frame(spark, rows), base).drop("kept").collect()
    assert sorted(map(tuple, got)) == sorted(brute.repeats(rows))


def test_suffix_dedup_of_documents(spark, texts):
    got = suffix_dedup.remove_repeats(frame(spark, texts)).drop("kept").collect()
    assert sorted(map(tuple, got)) == sorted(brute.repeats(texts))


def test_near_duplicates(spark, texts):
    df = frame(spark, texts)
    got = near_dups.near_duplicates(df).drop("dk").collect()
    expected = brute.near_duplicates(texts)
    assert sorted(map(tuple, got)) == sorted(expected)
    stay = near_dups.first_of_each(df)
    assert stay.columns == df.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(i for i, n, c in expected if i == c)


def test_repeated_rows_and_null_ids_leave_one(spark):
    text = "a b c d e f g h"
    rows = [(3, text), (3, text), (None, text), (7, text), (None, ""), (None, "")]
    stay = near_dups.first_of_each(frame(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in stay) == [(False, 3, text), (True, None, ""), (True, None, "")]


def test_line_dedup(spark, texts):
    rows = [(i, t) for i, t in texts if t is not None]
    df = frame(spark, [*rows, (5000, None)])
    got = line_dedup.dedup_lines(df)
    assert got.columns == df.columns
    found = {r.doc_id: r.text for r in got.collect()}
    assert found.pop(5000) is None
    assert [found[i] for i, _ in rows] == brute.line_dedup(rows)


def test_token_counts(spark, texts):
    path = Path(public_tokenizers.path("byte_bpe_50k.json"))
    library = tokenizers.Tokenizer.from_file(str(path))
    more = ["hi<|endoftext|><|endoftext|> you", "aaaaaaaaaa" * 7, "!!!!!", "I'll don't", "😀😀 👍🏽", " " * 99 + "z"]
    rows = texts + [(2000 + k, t) for k, t in enumerate(more)]
    got = {r.doc_id: r for r in tokens.token_counts(frame(spark, rows), path.read_text(encoding="utf-8")).collect()}
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 1024)


def test_url_rules(spark):
    rng = random.Random(1)
    labels = ["com", "net", "example", "www", "a", "b", ""]
    urls = [None, "", "nope", "http://", "HTTP://COM/x", "x://y://z/", "http://example.com?x/en/", "http://notexample.com/en/"]
    for _ in range(400):
        host = ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
        urls.append(f"http://{host}" + rng.choice(["", "/", "/en/", "/en", "/es/1", "/fr/x"]) + rng.choice(["", "?q", "#f"]))
    urls += ["https://www.example.com/en/1"] * 3
    more = [("block", "a.example.com", "/"), ("allow", "b.com", "/en"), ("block", "www.example.com", "/en/x"), ("allow", "com", "/e")]
    rules = [*url_rules.RULES, *more]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(df, table).collect()}
    assert [got[i] for i in range(len(urls))] == [brute.judge(u, rules) for u in urls]


PAGES = {
    "": "",
    "plain text": "plain text",
    "<p>a<p>b<br>c": "a b c",
    "<p>a&amp;b &lt;c&gt;&nbsp;d</p><script>var x='<p>no</p>'</script": "a&b <c> d",
    "<body><nav><a>Menu</a></nav><article><h1>Ti<b>t</b>le</h1><p>One <i>t</i>wo.</p></article><footer>End</footer>": "Title One two.",
    "<div class=sidebar><p>Long long long sidebar text here</p></div><div><p>Main text of some length.</p><p>More.</p></div>": "Main text of some length. More.",
    "<article><p>Text.</p><section id=comments><p>Reader says</p></section><form>x<input></form></article>": "Text.",
    "<!-- <p>no</p> --><p>yes</p><a b='<p>x": "yes",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert main_text.main_text(page) == PAGES[page]


def test_deep_and_broken_pages():
    assert main_text.main_text("<div>" * 3000 + "<p>deep words</p>") == "deep words"
    assert main_text.main_text("<" * 2000 + "</b></i>" * 50) is not None


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", "<p>é</p>", "x"), (2, None, None, "x"), (1, "u", "<p>é</p>", "x")],
                               "page_id long, url string, html string, text string")
    assert sorted(map(tuple, main_text.extract(df).collect())) == [(1, "u", "é", 1), (1, "u", "é", 1), (2, None, "", 0)]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert quality.judged(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert near_dups.near_duplicates(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert tokens.token_counts(none, Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()).count() == 0
    urls = none.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"))
    assert url_rules.judge_urls(urls, spark.createDataFrame(list(url_rules.RULES), "verdict string, host string, path string")).count() == 0
