"""Operator 5: exact join of documents on the Jaccard similarity of their word 5-grams, by prefixes in several orders.

A document is the set of its shingles (five words in a row, A-Z lower-cased). Two documents link when the similarity of
their sets is at least 0.8. Documents of equal sets are one class and links are looked for between classes.

1. One pass gives for each document the size, hash and bitmap of its set and the least shingle in a few random orders,
   and counts all shingles in a table of fixed length.
2. A global order of shingles is: count in the table, then a hash that differs from order to order. In each order, two
   sets of n and m shingles that link share one of the first n - a + 1 and m - a + 1, with a = ceil(0.8/1.8 * (n + m)).
   This holds for any order, so a table place that several shingles share costs nothing but speed.
3. Classes with the same least shingle are held against the earliest of them, first those that agree in most orders.
   What is verified joins most members of a group of near copies into one component, whatever the group's size.
4. The prefixes in the first order are dealt out by shingle. Classes that share a shingle with many are first held
   against one of them, another one for each shingle. A group whose members are linked here and there only becomes one
   component by that, with as many pairs as it has prefix shingles.
5. Shingles of a single component are dropped: more links inside it change nothing. On the others, members outside the
   largest component present are held against all of other components. A pair must share as many prefix shingles as its
   lengths require, and one in each further order.
6. Sets of n and m shingles that link differ in at most n + m - 2a, and their parity bitmaps in no more bits. Pairs of
   shingles that many share must pass that before they leave the join.
7. Pairs that pass are verified on their whole sets, read again from the documents; a bitmap of fixed length tells which
   documents are asked for.

Shingles are compared by 64-bit hashes.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.components import components
from tarmac.llm.grams import U, distinct, mix, texts, word_grams
from tarmac.sources.work import stored

WORDS = 5
PART, WHOLE = 4, 5
SIZES = PART + WHOLE
# Places of the count table and of the bitmap of documents that are read again.
COUNT_BITS = 22
ASKED_BITS = 22
BLOCK = 1 << 14
# Random orders by whose least shingle classes are first held together.
LOWS = 4
# Numbers of 64 bits in the bitmap of a set, and documents whose bitmaps are made at once.
BITMAP = 16
AT_ONCE = 1 << 10
# Documents that share a prefix shingle from which on bitmaps are compared there.
MANY = 8
# Hash seeds of the global orders of shingles.
ORDERS = (0, 0xA24BAED4963EE407, 0x9FB21C651E98DF25)
# Counted shingles held before they are added up.
HELD = 1 << 21


def _sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: first row, number of rows, shingle hashes sorted inside a text, text of each, set bounds."""
    for row, t in texts(column, lower=True):
        hashes, text, _ = word_grams(t, WORDS, whole=True)
        hashes, text = distinct(hashes, text)
        yield row, t.n, hashes, text, np.searchsorted(text, np.arange(t.n + 1))


def _signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set, as int64."""
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(mix(hashes), out=sums[1:])
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def _bitmaps(hashes: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A bitmap of each set: the bits on which an odd number of its shingles falls."""
    n, width = len(bounds) - 1, 64 * BITMAP
    bits = np.zeros((n, 8 * BITMAP), dtype=np.uint8)
    for i in range(0, n, AT_ONCE):
        ends = bounds[i : min(i + AT_ONCE, n) + 1]
        place = (hashes[ends[0] : ends[-1]] & U(width - 1)).astype(np.int64)
        place += np.repeat(np.arange(len(ends) - 1), np.diff(ends)) * width
        odd = np.bincount(place, minlength=(len(ends) - 1) * width) & 1
        bits[i : i + AT_ONCE] = np.packbits(odd.astype(bool).reshape(-1, width), axis=1)
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * BITMAP, bits.reshape(-1).view(np.int64))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents, and at the end rows of counts: a block's number and its compressed counts."""
    counts, held, n_held = np.zeros(1 << COUNT_BITS, dtype=np.uint32), [], 0

    def add() -> None:
        if held:
            counts[:] += np.bincount(np.concatenate(held), minlength=len(counts)).astype(np.uint32)
            held.clear()

    for batch in batches:
        n_rows = batch.num_rows
        size, sig = np.zeros(n_rows, dtype=np.int64), np.zeros(n_rows, dtype=np.int64)
        lows = np.zeros((LOWS, n_rows), dtype=np.int64)
        bitmaps = [pa.array([], pa.list_(pa.int64()))]
        for row, n, hashes, _, bounds in _sets(batch.column("text")):
            bitmaps.append(_bitmaps(hashes, bounds))
            some = np.flatnonzero(np.diff(bounds))
            size[row : row + n] = np.diff(bounds)
            sig[row : row + n] = _signatures(hashes, bounds)
            for j in range(LOWS if len(some) else 0):
                turned = mix(hashes + U((j + 1) * 0xD6E8FEB86659FD93 % 2**64))
                lows[j, row + some] = np.minimum.reduceat(turned, bounds[some]).view(np.int64)
            held.append((hashes >> U(64 - COUNT_BITS)).astype(np.int64))
            n_held += len(hashes)
            if n_held > HELD:
                add()
                n_held = 0
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("dk"),
                pa.array(size),
                pa.array(sig),
                *map(pa.array, lows),
                pa.concat_arrays(bitmaps),
                pa.nulls(n_rows, pa.int32()),
                pa.nulls(n_rows, pa.binary()),
            ],
            names=["doc_id", "dk", "n", "sig", *[f"low{j}" for j in range(LOWS)], "bits", "block", "counts"],
        )
    add()
    blocks = [(b, counts[b * BLOCK : (b + 1) * BLOCK]) for b in range(len(counts) // BLOCK)]
    blocks = [(b, zlib.compress(c.tobytes(), 1)) for b, c in blocks if c.any()]
    if blocks:
        empty = [pa.nulls(len(blocks), pa.int64()) for _ in range(4 + LOWS)]
        yield pa.RecordBatch.from_arrays(
            [
                *empty,
                pa.nulls(len(blocks), pa.list_(pa.int64())),
                pa.array([b for b, _ in blocks], pa.int32()),
                pa.array([c for _, c in blocks], pa.binary()),
            ],
            names=["doc_id", "dk", "n", "sig", *[f"low{j}" for j in range(LOWS)], "bits", "block", "counts"],
        )


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The codes of a partition's blocks from the counts of all tasks: four steps for each doubling."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, c in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            more = np.frombuffer(zlib.decompress(c), dtype=np.uint32)
            sums[b] = sums[b] + more if b in sums else more.astype(np.uint64)
    codes = {b: np.minimum(255, 4 * np.log2(1.0 + s)).astype(np.uint8).tobytes() for b, s in sums.items()}
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(codes), pa.int32()), pa.array(list(codes.values()), pa.binary())], names=["block", "codes"]
    )


def _keys(hashes: np.ndarray, codes: np.ndarray, seed: int) -> np.ndarray:
    """The places of shingles in a global order."""
    code = codes[(hashes >> U(64 - COUNT_BITS)).astype(np.int64)].astype(np.uint64)
    turned = mix(hashes ^ U(seed)) if seed else hashes
    return (code << U(56)) | (turned & U((1 << 56) - 1))


def _prefix(n: np.ndarray | int) -> np.ndarray | int:
    """The number of first shingles of which one is shared with any set that links."""
    return n - -(-PART * n // WHOLE) + 1


def _prefix_rows(codes):
    """A task's prefixes in the first order; of documents with equal sets only the first one's."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, hashes, text, bounds in _sets(batch.column("text")):
                sig, n = _signatures(hashes, bounds), np.diff(bounds)
                new = np.array([k > 0 and s not in seen and not seen.add(s) for s, k in zip(sig.tolist(), n, strict=True)])
                if not new.any():
                    continue
                keys = _keys(hashes, codes.value, ORDERS[0])
                order = np.lexsort((keys, text))
                place = np.arange(len(keys)) - bounds[:-1][text]
                take = new[text] & (place < _prefix(n)[text])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[order][take].view(np.int64)),
                        pa.array(sig[text][take]),
                        pa.array(n[text][take].astype(np.int32)),
                    ],
                    names=["key", "sig", "n"],
                )

    return rows


def _asked_sets(asked):
    """The sets of a task's documents whose signature is in the bitmap, once each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, n_rows, hashes, _, bounds in _sets(batch.column("text")):
                sig, n = _signatures(hashes, bounds), np.diff(bounds)
                hit = asked.value[sig & ((1 << ASKED_BITS) - 1)] & (n > 0)
                out = [i for i in np.flatnonzero(hit) if int(sig[i]) not in seen and not seen.add(int(sig[i]))]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(sig[out]),
                            pa.array([hashes[bounds[i] : bounds[i + 1]].tobytes() for i in out], pa.binary()),
                        ],
                        names=["sig", "set"],
                    )

    return rows


def _links(codes):
    """The pairs that share a prefix shingle in every order and whose sets are similar enough."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("xs"), batch.column("ys"), strict=True):
                a, b = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (a, b))
                least = -(-PART * (len(a) + len(b)) // SIZES)
                keep.append(
                    all(
                        np.isin(
                            np.sort(_keys(a, codes.value, seed))[: len(a) - least + 1],
                            np.sort(_keys(b, codes.value, seed))[: len(b) - least + 1],
                        ).any()
                        for seed in ORDERS
                    )
                    and len(np.intersect1d(a, b, assume_unique=True)) >= least
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column("x").filter(pa.array(keep)), batch.column("y").filter(pa.array(keep))], names=["x", "y"]
            )

    return rows


def _verified(pairs: DataFrame, docs: DataFrame, codes) -> DataFrame:
    """The pairs (x, y) of signatures that link."""
    pairs = stored(pairs.where("x != y").distinct(), "pairs")
    places = pairs.select(F.explode(F.array("x", "y")).alias("sig"))
    places = places.select(F.col("sig").bitwiseAND(F.lit((1 << ASKED_BITS) - 1)).cast("int").alias("at")).distinct()
    asked = np.zeros(1 << ASKED_BITS, dtype=bool)
    asked[places.toArrow().column("at").to_numpy()] = True  # one number for each place of the bitmap at most
    asked = docs.sparkSession.sparkContext.broadcast(asked)
    sets = docs.select("text").mapInArrow(_asked_sets(asked), "sig long, set binary")
    sets = stored(sets.groupBy("sig").agg(F.first("set").alias("set")), "sets")
    both = pairs.join(sets.select(F.col("sig").alias("x"), F.col("set").alias("xs")), "x")
    both = both.join(sets.select(F.col("sig").alias("y"), F.col("set").alias("ys")), "y")
    return stored(both.select("x", "y", "xs", "ys").mapInArrow(_links(codes), "x long, y long"), "links")


def _first_pairs(classes: DataFrame) -> DataFrame:
    """Classes (x) with the earliest class (y) of each least shingle, where the sizes allow a link, and how often."""
    lows = classes.select(
        "sig", "n", F.posexplode(F.array(*[f"low{j}" for j in range(LOWS)])).alias("turn", "low")
    )
    leads = lows.groupBy("turn", "low").agg(F.min(F.struct("sig", "n")).alias("lead"), F.count("*").alias("members"))
    leads = leads.where("members > 1").select(
        "turn", "low", F.col("lead.sig").alias("y"), F.col("lead.n").alias("m")
    )
    pairs = lows.join(leads, ["turn", "low"]).where(
        (F.col("sig") != F.col("y"))
        & (WHOLE * F.least("n", "m") >= PART * F.greatest("n", "m"))
    )
    return stored(pairs.groupBy(F.col("sig").alias("x"), "y").agg(F.count("*").alias("times")), "first")


def _apart(pairs: DataFrame, part: DataFrame) -> DataFrame:
    """The pairs whose classes are in different components."""
    for c in ("x", "y"):
        pairs = pairs.join(part.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part")), c, "left")
    return pairs.where(F.coalesce("x_part", "x") != F.coalesce("y_part", "y")).select("x", "y")


def _sizes_fit(n: str, m: str) -> Column:
    return WHOLE * F.least(n, m) >= PART * F.greatest(n, m)


def _bits_fit(a: str, b: str, n: str, m: str) -> Column:
    """Whether sets of these bitmaps and sizes could link; true where a bitmap is missing."""
    differ = sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(BITMAP)), F.lit(0))
    least = F.ceil(PART * (F.col(n) + F.col(m)) / F.lit(SIZES))
    return F.coalesce(differ <= F.col(n) + F.col(m) - 2 * least, F.lit(True))


def _mixed(rows: DataFrame, part: DataFrame) -> DataFrame:
    """The ``rows`` (key, sig, n, many) of keys with several components, and whether outside the largest one present."""
    part = part.select(F.col("node").alias("sig"), "component")
    rows = rows.join(part, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    rows = stored(rows, "prefixes")
    present = rows.groupBy("key", "component").agg(F.count("*").alias("members"))
    present = present.groupBy("key").agg(
        F.count("*").alias("kinds"), F.max_by("component", F.struct("members", "component")).alias("largest")
    )
    mixed = rows.join(present.where("kinds > 1").drop("kinds"), "key")
    return stored(mixed.withColumn("outside", F.col("component") != F.col("largest")).drop("largest"), "mixed")


def _lead_pairs(rows: DataFrame, part: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs of classes of different components: each of a shingle that many share, and the one chosen for the shingle."""
    mixed = _mixed(rows.where("many"), part)
    turn = F.xxhash64("key", "sig")
    leads = mixed.groupBy("key").agg(F.min_by(F.struct("sig", "n", "component"), turn).alias("lead"))
    pairs = mixed.join(leads, "key").where((F.col("component") != F.col("lead.component")) & _sizes_fit("n", "lead.n"))
    pairs = pairs.select(
        F.least("sig", "lead.sig").alias("x"), F.greatest("sig", "lead.sig").alias("y")
    ).distinct()
    for c in ("x", "y"):
        pairs = pairs.join(bits.select(F.col("sig").alias(c), F.col("n").alias(f"{c}_n"), F.col("bits").alias(f"{c}_bits")), c)
    return pairs.where(_bits_fit("x_bits", "y_bits", "x_n", "y_n")).select("x", "y")


def _other_pairs(rows: DataFrame, part: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs of classes of different components that share enough prefix shingles of the first order."""
    mixed = _mixed(rows, part)
    dense = mixed.where("many").join(bits.select("sig", "bits"), "sig")
    mixed = dense.unionByName(mixed.where("not many").withColumn("bits", F.lit(None).cast("array<long>")))
    names = ("sig", "n", "component", "outside", "bits")
    left = mixed.where("outside").select("key", *[F.col(c).alias(f"x_{c}") for c in names])
    right = mixed.select("key", *[F.col(c).alias(f"y_{c}") for c in names])
    met = left.join(right, "key").where(
        (F.col("x_component") != F.col("y_component"))
        & (~F.col("y_outside") | (F.col("x_sig") < F.col("y_sig")))
        & _sizes_fit("x_n", "y_n")
        & _bits_fit("x_bits", "y_bits", "x_n", "y_n")
    )
    # Which of a pair is outside differs from shingle to shingle, so the pair is counted without regard to that. Pairs
    # that bitmaps part are missing on some shingles only, but need not be found.
    shared = met.groupBy(F.least("x_sig", "y_sig").alias("x_sig"), F.greatest("x_sig", "y_sig").alias("y_sig")).agg(
        F.count("*").alias("shared"), F.max(F.least("x_n", "y_n")).alias("n"), F.max(F.greatest("x_n", "y_n")).alias("m")
    )

    def behind(n: str):  # shingles that are not in the prefix
        return F.ceil(PART * F.col(n) / F.lit(WHOLE)) - 1

    least = F.ceil(PART * (F.col("n") + F.col("m")) / F.lit(SIZES))
    enough = F.col("shared") + F.greatest(behind("n"), behind("m")) >= least
    return stored(shared.where(enough).select(F.col("x_sig").alias("x"), F.col("y_sig").alias("y")), "candidates")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, dk (hash of both), n_shingles and component_id.

    ``component_id`` is the least doc_id that links lead to, the document's own included. Null and empty texts and texts
    without words have no shingles and are linked with nothing; a text of fewer than five words is one shingle. Rows
    that repeat are copies like any others. Null ids are passed on and never chosen, unless a component has no other.
    An empty table gives no rows. Other columns are not read.
    """
    return _grouped(docs).drop("component")


def _grouped(docs: DataFrame) -> DataFrame:
    """The columns of ``near_duplicates`` and the component's own key, which rows of null ids have too; null where a
    document has no shingles."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("dk"))
    lows = ", ".join(f"low{j} long" for j in range(LOWS))
    profile = docs.mapInArrow(
        _profile, f"doc_id long, dk long, n long, sig long, {lows}, bits array<long>, block int, counts binary"
    )
    profile = stored(profile, "profile")
    blocks = profile.where("block is not null").select("block", "counts").repartition("block")
    codes = np.zeros(1 << COUNT_BITS, dtype=np.uint8)
    for b, c in blocks.mapInArrow(_add_blocks, "block int, codes binary").collect():  # the table: a fixed size
        codes[b * BLOCK : (b + 1) * BLOCK] = np.frombuffer(c, dtype=np.uint8)
    codes = spark.sparkContext.broadcast(codes)

    base = profile.where("block is null").drop("block", "counts")
    classes = base.where("n > 0").groupBy("sig").agg(
        F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", *[f"low{j}" for j in range(LOWS)], "bits")]
    )
    classes = stored(classes, "classes")
    # The lead that a class meets most often is its likeliest link; the others come next, where they would be news.
    first = _first_pairs(classes)
    likeliest = first.groupBy("x").agg(F.max_by("y", F.struct("times", "y")).alias("y"))
    links = _verified(likeliest, docs, codes)
    part = stored(components(links), "part")
    links = links.unionByName(_verified(_apart(first.select("x", "y"), part), docs, codes))
    part = stored(components(links), "part")

    rows = docs.select("text").mapInArrow(_prefix_rows(codes), "key long, sig long, n int")
    one = Window.partitionBy("key")
    met = {"low": F.min("sig").over(one), "high": F.max("sig").over(one), "many": F.count("*").over(one) >= MANY}
    rows = rows.withColumns(met).where("low < high")
    rows = stored(rows.select("key", "sig", "n", "many").distinct(), "shared")
    # One pair for each row of the shingles that many share; then all pairs that this has not put into one component.
    links = links.unionByName(_verified(_lead_pairs(rows, part, classes), docs, codes))
    part = stored(components(links), "part")
    links = links.unionByName(_verified(_other_pairs(rows, part, classes), docs, codes))
    part = stored(components(links), "part")

    part = part.join(classes.select(F.col("sig").alias("node"), "doc_id"), "node")
    ids = part.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = part.join(ids, "component").select(F.col("node").alias("sig"), "component", "component_id")
    ids = classes.select("sig", "doc_id").join(ids, "sig", "left")
    ids = ids.select(
        "sig",
        F.coalesce("component", "sig").alias("component"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )
    found = base.join(ids, "sig", "left")
    return found.select(
        "doc_id",
        "dk",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("component")).alias("component"),
    )


def first_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the least (doc_id, hash of id and text), null ids last.

    Of rows that repeat in both columns one stays. Rows without words are linked with nothing and stay, all of them.
    Other columns are passed on, whatever their names.
    """
    groups = _grouped(docs)
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "dk")
    some = groups.where("n_shingles > 0")
    least = some.groupBy("component").agg(F.min(rank).alias("first"))
    stay = least.select(F.col("first.dk").alias("dk")).withColumn("words", F.lit(True))
    empty = groups.where("n_shingles = 0").select("dk").distinct().withColumn("words", F.lit(False))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("dk", F.xxhash64("row.doc_id", "row.text")).join(stay.unionByName(empty), "dk")
    turn = F.row_number().over(Window.partitionBy("dk").orderBy("dk"))
    return rows.withColumn("turn", turn).where("turn = 1 or not words").select("row.*")
