"""Long lines that have some words in common are told apart by their bitmaps, before they are read again."""

import random

import brute
from test_text_operators import frame

from tarmac.llm import line_dedup


def test_long_lines_form_few_pairs(spark, monkeypatch):
    counts = []
    stored = line_dedup.stored

    def counted(df, name):
        out = stored(df, name)
        if name == "pairs":
            counts.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "stored", counted)
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(3000)]
    lines = [rng.sample(vocabulary, rng.randrange(150, 260)) for _ in range(120)]
    for line in lines[:10]:  # near copies, just alike enough and just not
        for drop in (len(line) // 5 - 1, len(line) // 5, len(line) // 5 + 1, 3):
            lines.append(line[drop:])
            lines.append([*line[drop // 2 :], *(f"x{k}" for k in range(drop // 2))])
    rng.shuffle(lines)
    rows = [(i, "\n".join(" ".join(x) for x in lines[i : i + 4])) for i in range(0, len(lines), 4)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert [got[i] for i, _ in rows] == brute.line_dedup(rows)
    assert counts and counts[0] < 400
