"""Operator 12 against a plain version."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tarmac.llm import merkle

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, place int, tree string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = [row[0], row[3], row[2], row[4], text]
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields])


def path(nodes, place):
    """The siblings of a place's path by level, as (left, right), and the top."""
    sides = []
    while len(nodes) > 1:
        start = place // 3 * 3
        sides.append((nodes[start:place], nodes[place + 1 : start + 3]))
        nodes, place = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], place // 3
    return sides, nodes[0]


def plain(rows, change):
    sources = defaultdict(list)
    for r in rows:
        sources[r[3]].append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = {s: [leaf(r, r[1]) for r in sources[s]] for s in names}
    subroots = [path(trees[s], 0)[1] for s in names]
    out = []
    for k, s in enumerate(names):
        above, root = path(subroots, k)
        for i, r in enumerate(sources[s]):
            sides = path(trees[s], i)[0] + above
            node = leaf(r, change(r))
            for left, right in sides:
                node = h(*left, node, *right)
            proof = h(*[x for left, right in sides for x in left + right])
            out.append((r[0], trees[s][i], subroots[k], root, proof, node))
    return out


def rows_of(sizes):
    out = []
    for s, n in sizes.items():
        out += [(i * 7 % 1000, f"text {i}\nof {s}", "en", s, i, 1, "x") for i in range(n)]
    return out


CASES = {
    "edges": [
        (3, None, None, None, None, 1, "x"), (None, "a\nb", "en", "s", 3, 1, "x"), (None, "a\nb", "en", "s", 3, 1, "x"),
        (1, "", "", "", 0, 1, "x"), (1, "é\n", "fr", "", 2, 1, "x"), (-5, "\n" * 3, "en", "s", 3, 1, "x"),
        (2, "long " * 50_000, "en", "日本", 9, 1, "x"), (2, "dup\n", "en", "s", 4, 1, "x"), (2, "dup\n", "en", "s", 4, 1, "x"),
    ],
    "one row": [(1, "a\n", "en", "s", 2, 1, "x")],
    "blocks": rows_of({"a": 40, "b": 9, "c": 10, "d": 27, "e": 28, "f": 1, None: 4, "g": 3}),
}


@pytest.mark.parametrize("depth", [1, 2, 5])
@pytest.mark.parametrize("case", CASES)
def test_manifest(spark, case, depth):
    rows = CASES[case]
    docs = spark.createDataFrame(rows, COLUMNS)
    even = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True))
    now = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = merkle.manifest(docs, now, depth)

    def change(r):
        return r[1].replace("\n", "") if r[1] is not None and (r[0] is None or r[0] % 2 == 0) else r[1]

    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain(rows, change)))


def test_untouched_rows_fold_to_the_root(spark):
    rows = merkle.manifest(spark.createDataFrame(CASES["edges"], COLUMNS)).collect()
    assert {r.folded_root for r in rows} == {rows[0].root}


def test_no_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], COLUMNS)).collect() == []


def test_a_version_shares_what_it_does_not_copy():
    levels = merkle.levels_of([merkle.digest([bytes([65 + i])]) for i in range(11)], 11, 5)
    path = merkle.version(levels, 10, merkle.digest([b"new"]))
    assert len(path) == len(levels) == 4
    changed = merkle.levels_of([*levels[0][:10], path[0]], 11, 5)
    assert [level[-1] for level in changed] == path
    assert all(a[:-1] == b[:-1] for a, b in zip(levels, changed, strict=True))
