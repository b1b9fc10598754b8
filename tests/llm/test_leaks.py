"""Operator 11 against a plain version: windows, short items, shards, texts cut in runs."""

import random
import re

import pytest

from tarmac.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(text, items, window):
    own, hit, names, longest = words(text), set(), set(), 0
    for name, item in items:
        item = words(item)
        size = min(window, len(item))
        windows = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)} if item else set()
        for i in range(len(own) - size + 1):
            if tuple(own[i : i + size]) in windows:
                hit.update(range(i, i + size))
                names.add("" if name is None else str(name))
        for i in range(len(own)):
            for k in range(len(item)):
                n = 0
                while i + n < len(own) and k + n < len(item) and own[i + n] == item[k + n]:
                    n += 1
                longest = max(longest, n)
    return len(own), hit, sorted(names), longest


def searched(automaton, text):
    n, spans, names, longest = automaton.search(text.encode())
    assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))
    return n, {i for a, b in spans for i in range(a, b)}, sorted(names), longest


@pytest.mark.parametrize("run", [dc.RUN_BYTES, 7])
def test_automaton(monkeypatch, run):
    monkeypatch.setattr(dc, "RUN_BYTES", run)
    rng = random.Random(2)
    for _ in range(200):
        line = lambda n, letters: " ".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
        items = [(str(k), line(9, "abc")) for k in range(rng.randint(0, 5))]
        text, window = line(25, "abcX"), rng.randint(1, 6)
        automaton = dc.Automaton([(k, t.encode().split()) for k, t in items], window)
        assert searched(automaton, text) == plain(text, items, window)


ITEMS = [
    (1, "One two three four five six seven eight nine ten eleven twelve"),
    (2, "three four five six seven eight nine ten eleven twelve"),
    (3, "Short item, é ñ"),
    (4, "short item é"),
    (5, None),
    (6, " .,- "),
    (None, "an item without an id of more than ten words stands here too"),
    (3, "one more of the same id with quite enough words to be a window"),
    (7, " ".join(f"w{i % 97}" for i in range(3000))),
]


def texts():
    rng = random.Random(3)
    pool = [t for _, t in ITEMS if t]
    out = [None, "", "...", "Nothing here", "SHORT ITEM é!", "short item, é Ñ", "short-item é ñ " * 50, pool[0], pool[0][4:]]
    for _ in range(40):
        cut = [" ".join(words(rng.choice(pool))[rng.randint(0, 6) :][: rng.randint(1, 40)]) for _ in range(4)]
        out.append(" x ".join(cut) + rng.choice(["", "\n\n!", " y"]))
    return [*out, out[5], "x " * 5000 + pool[0] + " y" * 5000]


@pytest.mark.parametrize("shard, piece", [(1 << 21, 1 << 17), (300, 90)], ids=["one shard", "many shards"])
def test_leaks(spark, monkeypatch, shard, piece):
    monkeypatch.setattr(dc, "SHARD_BYTES", shard)
    monkeypatch.setattr(dc, "PIECE_BYTES", piece)
    items = ITEMS if piece > 1000 else ITEMS[:-1] + [(7, " ".join(f"w{i % 97}" for i in range(130)))]
    rows = [(i % 40, t, "s", "l") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id int, text string, spans string, items string")
    table = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, shard int")
    expected = []
    for i, t, *_ in rows:
        n, hit, names, longest = plain(t, items, 10)
        expected.append((i, n, len(hit), names, longest if piece > 1000 else None))
    found = dc.find_leaks(docs, table).withColumn("n_hit", dc.hit_words(dc.F.col("spans"))).collect()
    got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.longest if piece > 1000 else None) for r in found]
    key = repr
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_texts_without_spans(spark):
    docs = spark.createDataFrame(
        [(1, "Before: " + ITEMS[0][1] + "! After that, more words stay in this text, é, than go."), (2, ITEMS[1][1]), (3, None)],
        "doc_id long, text string",
    )
    table = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = {r.doc_id: r for r in dc.decontaminate(docs, table).collect()}
    assert rows[1].text == "Before: ! After that, more words stay in this text, é, than go." and not rows[1].dropped
    assert rows[2].text == "" and rows[2].dropped
    assert rows[3].text is None and not rows[3].dropped


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame([], f"{c} long, text string") for c in ("doc_id", "item_id"))
    assert dc.find_leaks(docs, items).collect() == []
    one = spark.createDataFrame([(1, "two words")], "doc_id long, text string")
    (row,) = dc.find_leaks(one, items).collect()
    assert (row.n_words, row.spans, row["items"], row.longest) == (2, [], [], 0)
