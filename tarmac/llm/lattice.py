"""Operator 9: near-duplicate vectors by lattice hashing, verified by cosine.

Each of several tables projects the unit vectors to eight dimensions at random and rounds the result to the nearest
point of the E8 lattice. A vector is at home in its point's cell and visits the cells of the neighbouring points that
come next. Vectors that meet in a cell, one of them at home, are verified in double precision.

Equal vectors are one class. A cell's members are dealt to blocks of bounded size and each pair of blocks is one unit of
work, so that a cell of any size is no task of its own. No pairs leave a unit: it returns, for each vector, how many
links it counted and one edge to its component. A pair that meets in several cells is counted in the first of them only;
each vector carries all its cells, so that every unit can tell.
"""

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.components import components
from tarmac.llm.grams import U, mix
from tarmac.sources.work import stored

COSINE = 0.95
TABLES = 4
PROBES = 4
# The lattice's unit for vectors of 64 components; others' projections are longer or shorter by the root of their ratio.
UNIT = 0.2
SEED = 20
# Members of a block: two blocks and their products are held at once.
BLOCK = 1024
CELLS = TABLES * (1 + PROBES)


def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [
        [a if k == i else b if k == j else 0.0 for k in range(8)]
        for i, j in combinations(range(8), 2)
        for a in (1.0, -1.0)
        for b in (1.0, -1.0)
    ]
    half = [s for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array([*whole, *half])


NEIGHBOURS = _neighbours()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest whole points of even sum: where the sum is odd, the worst coordinate is rounded the other way."""
    near = np.round(x)
    off = x - near
    rows = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(off[rows]).argmax(axis=1)
    near[rows, worst] += np.where(off[rows, worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: of D8 or of D8 moved by a half in every coordinate."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def cells(unit: np.ndarray) -> np.ndarray:
    """For each unit vector its home cell and the cells it visits, table by table, as hashes."""
    n, dims = unit.shape
    random = np.random.default_rng([SEED, dims])
    out = np.zeros((n, TABLES, 1 + PROBES), dtype=np.uint64)
    for t in range(TABLES):
        axes = np.linalg.qr(random.standard_normal((max(dims, 8), 8)))[0][:dims]
        x = unit @ axes / (UNIT * np.sqrt(64 / max(dims, 8))) + random.uniform(0.0, 1.0, 8)
        home = nearest_e8(x)
        next_ones = np.argsort(-((x - home) @ NEIGHBOURS.T), axis=1, kind="stable")[:, :PROBES]
        points = np.concatenate([home[:, None], home[:, None] + NEIGHBOURS[next_ones]], axis=1)
        hashed = np.full((n, 1 + PROBES), mix(np.array([t * 1_000_003 + dims], dtype=np.uint64))[0])
        for k in range(8):
            hashed = mix(hashed * U(31) + (2 * points[:, :, k]).astype(np.int64).view(np.uint64))
        out[:, t] = hashed
    return out


def _units(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and unit vectors, for each number of components that occurs."""
    lengths = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy().astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    for dims in np.unique(lengths):
        rows = np.flatnonzero(lengths == dims)
        vectors = flat[starts[rows][:, None] + np.arange(dims)]
        vectors /= np.abs(vectors).max(axis=1, keepdims=True)  # no square overflows
        yield rows, vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))


def _deal(with_vectors: bool):
    """A row for each cell of each vector; with the vector and all its cells if they are asked for."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, unit in _units(batch.column("embedding")):
                found = cells(unit).reshape(len(at), CELLS)
                taken = batch.take(pa.array(np.repeat(at, CELLS)))
                home = np.tile(np.arange(CELLS) % (1 + PROBES) == 0, len(at))
                arrays = [pa.array(found.reshape(-1).view(np.int64)), pa.array(home), taken.column("id")]
                names = ["cell", "home", "id"]
                if with_vectors:
                    own = pa.array([row.tobytes() for row in found], pa.binary())
                    vector = pa.array([row.tobytes() for row in unit], pa.binary())
                    repeat = pa.array(np.repeat(np.arange(len(at)), CELLS))
                    arrays += [taken.column("n"), own.take(repeat), vector.take(repeat)]
                    names += ["n", "cells", "vector"]
                for i in range(0, len(home), 4096):
                    yield pa.RecordBatch.from_arrays([a[i : i + 4096] for a in arrays], names=names)

    return rows


def _verify(group: dict[str, np.ndarray], cell: int, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """For each member: the links counted here, and the least member that links here lead to."""
    vectors, own, home = group["vector"], group["cells"], group["home"]
    n = len(home)
    a = np.flatnonzero(group["part"] == i)
    b = np.flatnonzero(group["part"] == j)
    close = vectors[a] @ vectors[b].T >= COSINE
    close &= home[a][:, None] | home[b][None, :]
    x, y = (k.astype(np.int64) for k in np.nonzero(close))
    x, y = a[x], b[y]
    once = x < y if i == j else np.ones(len(x), dtype=bool)
    x, y = x[once], y[once]
    # The cells of x and y in order; the first in which they meet, one of them at home, is the one that counts.
    earlier = np.zeros(len(x), dtype=bool)
    at = np.argmax(own == cell, axis=1) // (1 + PROBES)  # the table, the same for all members
    for t in range(TABLES):
        hx, hy = own[x, t * (1 + PROBES)], own[y, t * (1 + PROBES)]
        px, py = (own[k, t * (1 + PROBES) : (t + 1) * (1 + PROBES)] for k in (x, y))
        before = at[x] > t
        # In one table a pair can meet in the home of either: the smaller hash counts.
        meets_x, meets_y = (py == hx[:, None]).any(axis=1), (px == hy[:, None]).any(axis=1)
        earlier |= before & (meets_x | meets_y)
        same = at[x] == t
        smaller = np.where(meets_x & meets_y, np.minimum(hx, hy), np.where(meets_x, hx, hy))
        earlier |= same & (smaller != cell)
    links = np.bincount(x[~earlier], weights=group["n"][y[~earlier]], minlength=n)
    links += np.bincount(y[~earlier], weights=group["n"][x[~earlier]], minlength=n)
    least = group["id"].copy()
    while len(x):
        low = np.minimum(least[x], least[y])
        new = least.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        if (new == least).all():
            break
        least = new
    return links.astype(np.int64), least


def _units_of_work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cell, i, j), one such unit after the other."""

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(held)
        columns = {c: table.column(c).to_numpy() for c in ("home", "id", "n", "part")}
        if len(columns["id"]) < 2 or not columns["home"].any():
            return None
        cell, i, j = (table.column(c)[0].as_py() for c in ("cell", "i", "j"))
        out = []
        widths = np.array([len(v) for v in table.column("vector").to_pylist()])
        for width in np.unique(widths):  # a hash of another number of components: never compared
            at = np.flatnonzero(widths == width)
            part = {k: v[at] for k, v in columns.items()}
            for name, kind in (("vector", np.float64), ("cells", np.uint64)):
                taken = table.column(name).take(pa.array(at)).to_pylist()
                part[name] = np.frombuffer(b"".join(taken), dtype=kind).reshape(len(at), -1)
            links, least = _verify(part, np.int64(cell).view(np.uint64), i, j)
            some = np.flatnonzero((links > 0) | (least != part["id"]))
            out.append((part["id"][some], links[some], least[some]))
        ids, links, least = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(least)], names=["id", "links", "y"])

    held, key = [], None
    for batch in batches:
        marks = [batch.column(c).to_numpy() for c in ("cell", "i", "j")]
        change = np.ones(batch.num_rows, dtype=bool)
        change[1:] = np.any([m[1:] != m[:-1] for m in marks], axis=0)
        starts = [*np.flatnonzero(change).tolist(), batch.num_rows]
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            own = tuple(m[s] for m in marks)
            if own != key and held:
                if (out := done(held)) is not None:
                    yield out
                held = []
            key = own
            held.append(batch.slice(s, e - s))
    if held and (out := done(held)) is not None:
        yield out


def near_vectors(vectors: DataFrame) -> DataFrame:
    """For each row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id and kept.

    ``n_links`` counts the other rows found with a cosine of at least 0.95, ``component_id`` is the least vec_id that
    links lead to, the row's own included, ``kept`` whether that is the row's own. Vectors that are null, empty or zero
    or hold null or non-finite components have no links. Rows with equal vectors are linked with each other; vectors of
    different lengths never. Null ids are passed on and never chosen where there is another, and their rows are not
    kept. An empty table gives no rows; other columns, labels included, are not read.
    """
    rows = vectors.select("vec_id", "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("valid", F.coalesce(valid, F.lit(False)))
    classes = rows.where("valid").groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    source = classes.select("id", "n", "embedding")

    counts = source.mapInArrow(_deal(False), "cell long, home boolean, id long").groupBy("cell")
    counts = counts.agg(F.count("*").alias("members"))
    parts = counts.where(F.col("members") > BLOCK).select(
        "cell", F.ceil(F.col("members") / BLOCK).cast("int").alias("parts")
    )
    dealt = source.mapInArrow(
        _deal(True), "cell long, home boolean, id long, n long, cells binary, vector binary"
    )
    dealt = dealt.join(stored(parts, "parts"), "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = dealt.withColumn("other", other).withColumns(
        {"i": F.least("part", "other"), "j": F.greatest("part", "other")}
    )
    dealt = dealt.drop("parts", "other").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    found = stored(dealt.mapInArrow(_units_of_work, "id long, links long, y long"), "found")

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    part = components(found.select(F.col("id").alias("x"), "y"))
    firsts = classes.select("id", "first", "n").join(part.withColumnRenamed("node", "id"), "id", "left")
    firsts = firsts.withColumn("component", F.coalesce("component", "id"))
    least = firsts.groupBy("component").agg(F.min("first").alias("component_id"))
    known = firsts.join(least, "component").join(links, "id", "left")
    known = known.select(
        "id", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    ).join(classes.select("id", "embedding"), "id")
    joined = rows.join(known.withColumn("valid", F.lit(True)), ["embedding", "valid"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
