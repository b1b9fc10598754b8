"""Mixing, packing, vectors and the pipeline against plain versions."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarmac.llm import lattice, mixing, packing
from tarmac.llm.text import word_count

SF = "/root/testdata/sf0.001"


def targets(words):
    """words: by source. Targets by filling up: who is above three times its size is set there, the rest share again."""
    names = sorted((s for s in words if s is not None)) + [None] * (None in words)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped, total = set(), sum(words.values())
    while True:
        rest = total - sum(3 * words[s] for s in capped)
        shared = sum(w for s, w in weight.items() if s not in capped)
        out = {s: 3 * words[s] if s in capped else rest * weight[s] / shared for s in names}
        above = {s for s in names if s not in capped and out[s] > 3 * words[s]}
        if not above:
            return out
        capped |= above


@pytest.mark.parametrize("sizes", [{"a": [5, 7, 0], "b": [100, 1, 30], None: [2]}, {"x": [0, 0]}, {"é": [3], "z": [4] * 40, "A": [1]}])
def test_mix(spark, sizes):
    rows = [(i, s, n) for i, (s, n) in enumerate((s, n) for s, all_ in sizes.items() for n in all_)]
    rows.append((None, next(iter(sizes)), None))
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("text", F.lit("t"))
    df = df.withColumns({"key": mixing.hash_key(), "target": F.lit("old")})
    got = mixing.mix(df).collect()
    expected = targets({s: sum(n) for s, n in sizes.items()})
    assert len(got) == len(rows)
    for source, words in sizes.items():
        mine = [r for r in got if r.source == source]
        assert all(r.target == pytest.approx(expected[source]) and r.source_size == sum(words) for r in mine)
        assert sum(r.taken for r in mine) == int(expected[source] + 1e-9)
        order = sorted((r for r in mine if r.size), key=lambda r: r.key)
        times = [r.taken / r.size for r in order]
        assert times == sorted(times, reverse=True) and all(t <= 3 for t in times)
    assert sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, got))


@pytest.mark.parametrize("words", [6 * 10**8, 3 * 10**9, 10**15])
def test_mix_of_many_words(spark, words):
    sizes = {"a": [words], "b": [words - 7, 7], "c": [words // 2, words // 3]}
    rows = [(i, s, n) for i, (s, n) in enumerate((s, n) for s, all_ in sizes.items() for n in all_)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("text", F.lit("t"))
    got = mixing.mix(df.withColumn("key", mixing.hash_key())).collect()
    expected = targets({s: sum(n) for s, n in sizes.items()})
    for source in sizes:
        mine = [r for r in got if r.source == source]
        assert all(r.target == pytest.approx(expected[source], rel=1e-14) for r in mine)
        assert sum(r.taken for r in mine) == int(mine[0].target)


def test_pack(spark):
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in np.concatenate([rng.integers(0, 60, 300), [999, 64, 64, 128, 129, -1]])]
    rows = [(i % 250, n) for i, n in enumerate(sizes)] + [(None, 10), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, size long")
    got = packing.pack(df, capacities=(32, 64, 128)).toPandas()
    assert got.length.sum() == sum(n for _, n in rows if n and n > 0)
    assert (got.groupby(["doc_id", "piece", "start"], dropna=False).length.max() <= 128).all()
    for _, bin_ in got.groupby("bin_id"):
        bin_ = bin_.sort_values("bin_start")
        ends = (bin_.bin_start + bin_.length).tolist()
        assert bin_.bin_start.tolist() == [0, *ends[:-1]]
        capacity = bin_.capacity.iloc[0]
        assert ends[-1] <= capacity and capacity == min(c for c in (32, 64, 128) if c >= ends[-1])
    # One pass of best fit over the pieces, one by one, needs as many bins of each size.
    pieces = sorted(got.length.tolist(), reverse=True)
    costs = []
    for floor in (32, 64, 128):
        free, used = [], []
        for n in pieces:
            fits = [(f, k) for k, f in enumerate(free) if f >= n]
            if fits:
                k = min(fits)[1]
            else:
                k = len(free)
                free.append(min(c for c in (32, 64, 128) if c >= max(n, floor)))
                used.append(0)
            free[k] -= n
            used[k] += n
        costs.append(sum(min(c for c in (32, 64, 128) if c >= u) + packing.BIN_COST for u in used))
    assert (got.groupby("bin_id").capacity.first() + packing.BIN_COST).sum() == min(costs)


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 64))
    near = base[:150] + rng.standard_normal((150, 64)) * 0.28
    rows = [[float(np.float32(x)) for x in v] for v in [*base, *near, base[0], base[0] * 2, -base[1]]]
    rows += [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [1.0, 2.0], [2.0, 4.0]]
    n, links = len(rows), []
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    for i in unit:
        links += [(i, j) for j in unit if j < i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in lattice.near_vectors(df).collect()}
    degree = np.bincount([x for pair in links for x in pair], minlength=n)
    found = sum(r.n_links for r in got.values())
    assert len(got) == n and found >= 0.9 * degree.sum() and all(got[i].n_links <= degree[i] for i in range(n))
    part = brute.groups(n, links)
    assert sum(got[i].component_id == part[i] for i in range(n)) >= 0.95 * n
    assert all(got[i].kept == (got[i].component_id == i) for i in range(n))


def test_vectors_in_several_blocks(spark, monkeypatch):
    """A cell's members in several blocks count each link once."""
    rows = [(i, [1.0 + i * 1e-4, *[1.0] * 63]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(lattice, "BLOCK", 16)
    got = lattice.near_vectors(df).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(59, 0)}


def test_vectors_empty(spark):
    assert lattice.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_lattice_points_are_nearest():
    x = np.random.default_rng(1).uniform(-2, 2, (500, 8))
    near = lattice.nearest_e8(x)
    own = ((x - near) ** 2).sum(axis=1)
    others = ((x[:, None] - (near[:, None] + lattice.NEIGHBOURS)) ** 2).sum(axis=2)
    assert (own <= others.min(axis=1) + 1e-12).all()


def test_mix_and_pack_empty(spark):
    none = spark.createDataFrame([], "doc_id long, source string, size long, key string")
    assert mixing.mix(none).count() == 0
    assert packing.pack(none).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = corpus_pipeline.stored(stage(spark, docs, SF), "stage")
        assert new.columns == docs.columns
        if name == "n-gram jaccard join":
            rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
            expected = sorted(i for i, _, c in brute.near_duplicates(rows) if i == c)
            assert sorted(r.doc_id for r in new.collect()) == expected
        if name == "line dedup":
            rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
            assert [r.text for r in new.orderBy("doc_id").collect()] == brute.line_dedup(rows)
        docs = new
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    total = docs.agg(F.sum(word_count(F.col("text")))).first()[0]
    assert packed.agg(F.sum("length")).first()[0] == total
