"""The prefix join of op7: words are dealt once for both sides, and lines match whatever their sizes and white space."""

import random

import brute
from test_text_operators import frame

from tarmac.llm import line_dedup


def test_prefix_words_are_dealt_once(spark, monkeypatch):
    plans, stored = {}, line_dedup.stored

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name)

    monkeypatch.setattr(line_dedup, "stored", kept)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        line_dedup.dedup_lines(frame(spark, [(1, "a b c d e f"), (2, "a b c d e g\nh i j k")])).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    dealt = [line for line in plans["pairs"].split("\n") if "REPARTITION_BY_COL" in line]
    assert len([line for line in dealt if "ReusedExchange" not in line]) == 1


def test_lines_of_unlike_sizes_and_white_space(spark):
    draw = random.Random(7)
    bases = [[f"w{draw.randrange(400)}" for _ in range(draw.choice((4, 9, 19, 45, 130, 200)))] for _ in range(12)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(4):
            line = list(draw.choice(bases))
            for _ in range(draw.randrange(1 + len(line) // 4)):
                at = draw.randrange(len(line))
                line[at : at + 1] = draw.choice(([], [f"v{draw.randrange(60)}"], [line[at], f"u{draw.randrange(60)}"]))
            gaps = draw.choice((" ", "  ", "\t", " \x0b", "\x0c ", "\r"))
            lines.append(draw.choice(("", " ", "\t")) + gaps.join(line) + draw.choice(("", " ", "\r")))
        rows.append((i, "\n".join(lines)))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert [got[i] for i, _ in rows] == brute.line_dedup(rows)
