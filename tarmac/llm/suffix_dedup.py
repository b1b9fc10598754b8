"""Operator 2: remove byte strings of 400 bytes or more that occur twice, with a distributed difference-cover suffix sort.

1. Rows of equal texts are one class; a class of several rows and at least 400 bytes is removed whole and still matches
   others. The rest goes on with one text for each class.
2. The least, by hash, of the 32-byte grams of a 400-byte window is its anchor, the first one if there are several: equal
   windows have equal anchors at equal offsets. Windows in a row that have one anchor and offsets of one cell are a
   piece; the bytes that all windows of the cell have are its core. In wide cells (``WIDE`` offsets), only windows whose
   core occurs twice can occur twice.
3. These are cut into narrow cells (``WIDTH`` offsets). The core becomes one symbol, so a piece is a string of at most
   2 * WIDTH - 1 symbols, and a window one of WIDTH. Equal pieces are one class, whose windows occur twice if it has two
   places. Only classes that share their core with another one, a bucket, can have single windows in common: their
   suffixes are sorted.
4. A bucket short enough for one task is sorted there, many buckets to a task. The pieces of longer ones are laid end to
   end: suffixes at places 1 and 2 modulo 3 are sorted by their first three symbols and named by their order. While names
   are shared and say less than a window, the string of names is sorted by the same steps. The other suffixes are ordered
   by a symbol and the rank of the sampled suffix behind it; counts of smaller suffixes in the lists of two classes each
   give every suffix its rank. A string short enough for one task is sorted there.
5. In the order of ranks, equal windows are neighbours. A window that equals the one before or behind it marks its bytes
   at all places of its class.

Sums over the order come from ranges (``running``), symbols behind a place from blocks with a margin, so no step
needs all rows in one task. Cores, and windows of long buckets, are compared by 64-bit hashes.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.grams import U, mix, span_hashes, texts
from tarmac.plans.running import running
from tarmac.sources.work import stored

LENGTH = 400
GRAM = 32
# Bits of the bitmap of wide cores that occur twice.
CORE_BITS = 24
# Symbols that one task sorts by itself, and rows of a block whose neighbours are looked up together.
BASE = 1 << 20
BLOCK = 1 << 16
# Offsets of a window from its anchor that make one narrow cell, also the symbols of a window
# whose core is one symbol; and those of a wide cell.
WIDTH = 24
WIDE = 4 * WIDTH
# Rows that a task holds before it passes them on.
HELD = 1 << 15


def _all_spans(data: np.ndarray, length: int) -> np.ndarray:
    """The hash of ``length`` bytes from every place where so many are left."""
    starts = np.arange(max(len(data) - length + 1, 0))
    return span_hashes(data, starts, starts + length)


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's grams, and for each window the least of its grams."""
    grams = _all_spans(data, GRAM)
    width = LENGTH - GRAM + 1
    n = len(grams)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = grams
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return grams, np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for row, t in texts(batch.column("text")):
        for i in range(t.n):
            yield row + i, t.raw[t.offsets[i] : t.offsets[i + 1]]


def _batches(names: list[str], rows: Iterator[list]) -> Iterator[pa.RecordBatch]:
    """The rows of many texts, a list of equally long numpy arrays or binary arrays for each, in batches of some size."""
    held, n = [], 0

    def joined(k: int) -> pa.Array:
        parts = [row[k] for row in held]
        return pa.array(np.concatenate(parts)) if isinstance(parts[0], np.ndarray) else pa.concat_arrays(parts)

    for row in rows:
        held.append(row)
        n += len(row[0])
        if n >= HELD:
            yield pa.RecordBatch.from_arrays([joined(k) for k in range(len(names))], names=names)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([joined(k) for k in range(len(names))], names=names)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """The keys and bytes of a task's texts that have a window, of equal texts once."""
    seen: set[int] = set()
    for batch in batches:
        keys = batch.column("tk").to_pylist()
        for i, data in _documents(batch):
            if len(data) >= LENGTH and keys[i] not in seen:
                seen.add(keys[i])
                yield keys[i], data


def _each(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each first to its last, and the place of the pair that each comes from."""
    n = last - first + 1
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - (np.cumsum(n) - n)[of] + first[of], of


def _anchored(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of a text's windows: places, and the first and last window of each."""
    grams, least = _grams(data)
    start = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
    end = np.append(start[1:], len(least)) - 1
    hashes, code = np.unique(least[start], return_inverse=True)
    near = np.minimum(np.searchsorted(hashes, grams), len(hashes) - 1)
    places = np.flatnonzero(hashes[near] == grams)
    n = len(data) + 1
    places = np.sort(near[places] * n + places)
    first, last = (np.searchsorted(places, code * n + x) for x in (start, end))
    which, run = _each(first, last)
    anchor = places[which] - code[run] * n
    start = np.where(which > first[run], np.append(0, anchor[:-1]) + 1, start[run])
    return anchor, start, np.minimum(anchor, end[run])


def _split(anchor: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> tuple:
    """The pieces of these windows in cells of so many offsets: anchor, first and last window, start of the core."""
    cell, of = _each((anchor - end) // width, (anchor - start) // width)
    anchor, core = anchor[of], anchor[of] - cell * width
    return anchor, np.maximum(start[of], core - width + 1), np.minimum(end[of], core), core


def _core_keys(data: np.ndarray, anchor: np.ndarray, core: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the cores and cells of pieces."""
    return mix(span_hashes(data, core, core + LENGTH - width + 1) + (anchor - core).astype(np.uint64))


def _core_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wide cores of a task's texts, of equal texts once, and whether the core occurs again in the text."""

    def rows() -> Iterator[list]:
        for tk, data in _once(batches):
            anchor, _, _, core = _split(*_anchored(data), WIDE)
            hashes, counts = np.unique(_core_keys(data, anchor, core, WIDE), return_counts=True)
            yield [np.full(len(hashes), tk), hashes.view(np.int64), counts > 1]

    return _batches(["tk", "hash", "again"], rows())


def _pieces_of(data: np.ndarray, twice: np.ndarray) -> list | None:
    """The narrow pieces of a text whose wide core may occur twice: key (of core and cell, more than any byte), edge (the
    bytes around the core), left (how many of them are before it) and at (the start of the first window)."""
    anchor, start, end, core = _split(*_anchored(data), WIDE)
    maybe = twice[(_core_keys(data, anchor, core, WIDE) >> U(64 - CORE_BITS)).astype(np.int64)]
    if not maybe.any():
        return None
    anchor, at, end, core = _split(anchor[maybe], start[maybe], end[maybe], WIDTH)
    key = (_core_keys(data, anchor, core, WIDTH) >> U(1)) | U(1 << 62)
    length = LENGTH - WIDTH + 1
    left = core - at
    size = end + LENGTH - at - length
    inside, of = _each(np.zeros(len(size), dtype=np.int64), size - 1)
    source = at[of] + inside + np.where(inside >= left[of], length, 0)
    bounds = np.append(0, np.cumsum(size)).astype(np.int32)
    edge = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data[source])])
    return [key.view(np.int64), edge, left.astype(np.int32), at.astype(np.int64)]


def _pieces(twice):
    """The pieces of a task's texts whose windows can occur twice, of equal texts once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((tk, _pieces_of(data, twice.value)) for tk, data in _once(batches))
        return _batches(
            ["tk", "key", "edge", "left", "at"], ([np.full(len(p[0]), tk), *p] for tk, p in found if p is not None)
        )

    return rows


def _ranks(s: np.ndarray, cover: int) -> np.ndarray:
    """Ranks, from 1, of the suffixes of a string by doubling the number of symbols that are compared."""
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64) + 1
    known = 1
    while known * cover < WIDTH and known < len(rank):
        next_rank = np.zeros(len(rank), dtype=np.int64)
        next_rank[:-known] = rank[known:]
        rank = np.unique(rank * (len(rank) + 2) + next_rank, return_inverse=True)[1].astype(np.int64) + 1
        known *= 2
    return rank


def _shared(key: np.ndarray, edge: pa.Array, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that another class has as well: the class's place in the arrays, first and last window."""
    bounds = np.frombuffer(edge.buffers()[1], dtype=np.int32)[edge.offset : edge.offset + len(edge) + 1].astype(np.int64)
    content = np.frombuffer(edge.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]]
    size = np.diff(bounds)
    starts = bounds[:-1] - bounds[0] + np.arange(len(size))
    inside = np.arange(len(content)) - np.repeat(bounds[:-1] - bounds[0], size)
    s = np.zeros(len(content) + len(size), dtype=np.int64)
    s[starts + left] = key
    s[np.repeat(starts, size) + inside + (inside >= np.repeat(left, size))] = content.astype(np.int64) + 1
    rank = _ranks(s, 1)
    windows = size - WIDTH + 2
    first = np.cumsum(windows) - windows
    of = np.repeat(np.arange(len(size)), windows)
    pos = starts[of] + np.arange(len(of)) - first[of]
    order = np.argsort(rank[pos], kind="stable")
    a, b = order[:-1], order[1:]
    same = np.ones(len(a), dtype=bool)
    for k in range(WIDTH):
        same &= s[pos[a] + k] == s[pos[b] + k]
    again = np.zeros(len(of) + 1, dtype=bool)
    again[a[same]] = True
    again[b[same]] = True
    again = again[:-1]
    cut = np.ones(len(of), dtype=bool)
    cut[1:] = of[1:] != of[:-1]
    begins = np.flatnonzero(again & (cut | ~np.append(False, again[:-1])))
    ends = np.flatnonzero(again & np.append(cut[1:] | ~again[1:], True))
    return of[begins], begins - first[of[begins]], ends - first[of[begins]]


def _sort_buckets(base: int):
    """The shared windows of a task's buckets, which follow each other by key; about ``base`` symbols are sorted at once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def found() -> pa.RecordBatch:
            all_ = pa.Table.from_batches(held).combine_chunks()
            key, left = (all_.column(c).to_numpy() for c in ("key", "left"))
            edge = all_.column("edge").combine_chunks()
            of, first, last = _shared(key, edge, left.astype(np.int64))
            return pa.RecordBatch.from_arrays(
                [pa.array(key[of]), pa.array(all_.column("form").to_numpy()[of]), pa.array(first), pa.array(last)],
                names=["key", "form", "first", "last"],
            )

        for batch in batches:
            key = batch.column("key").to_numpy()
            ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, batch.num_rows)
            if held and key[0] != held[-1].column("key")[-1].as_py() and n >= base:
                yield found()
                held, n = [], 0
            sums = np.cumsum(pc.binary_length(batch.column("edge")).to_numpy().astype(np.int64) + 1)
            done = 0
            for end in ends[:-1]:
                if n + sums[end - 1] - (sums[done - 1] if done else 0) >= base:
                    held.append(batch.slice(done, end - done))
                    yield found()
                    held, n, done = [], 0, int(end)
            held.append(batch.slice(done))
            n += int(sums[-1] - (sums[done - 1] if done else 0))
        if held:
            yield found()

    return rows


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each symbol of the classes: its place in all, itself, and its window's number and hash if it starts one."""

    def rows() -> Iterator[list]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("first", "key", "form", "edge", "left"))
            for first, key, form, edge, left in zip(*columns, strict=True):
                data = np.frombuffer(edge, dtype=np.uint8)
                n = len(data) + 1
                window = np.zeros(n, dtype=np.int64)
                number = np.arange(n)
                hashes = _all_spans(data, WIDTH - 1)
                # The core's place in the window and the key tell the rest of it.
                hashes = mix(hashes + mix(np.uint64(key) + (left - number[: len(hashes)]).astype(np.uint64)))
                window[: len(hashes)] = hashes.view(np.int64)
                s = np.insert(data.astype(np.int64) + 1, left, key)
                yield [first + number, s, np.full(n, key), np.full(n, form), np.where(number < len(hashes), number, -1), window]

    return _batches(["pos", "s", "key", "form", "number", "window"], rows())


def _behind(rows: DataFrame, columns: dict[str, tuple[str, int]], pos: str = "pos") -> DataFrame:
    """``rows`` with, for each of ``columns``, the value of a column so many places further on (0 behind the end)."""
    margin = max(abs(k) for _, k in columns.values())
    block = F.floor(F.col(pos) / BLOCK)
    near = F.array(block, F.when(F.col(pos) % BLOCK < margin, block - 1).otherwise(
        F.when(F.col(pos) % BLOCK >= BLOCK - margin, block + 1)
    ))
    dealt = rows.withColumn("block", F.explode(F.array_compact(near)))
    order = Window.partitionBy("block").orderBy(pos)
    found = dealt.withColumns({
        name: F.coalesce(F.lead(c, k).over(order) if k > 0 else F.lag(c, -k).over(order), F.lit(0).cast("long"))
        for name, (c, k) in columns.items()
    })
    return found.where(F.col("block") == block).drop("block")


def _smaller(rows: DataFrame, keys: list[str], counts: dict[str, Column]) -> DataFrame:
    """``rows`` with, for each of ``counts``, how many rows of smaller ``keys`` it is true for."""
    groups = rows.groupBy(*keys).agg(*[F.sum(c.cast("long")).alias(name) for name, c in counts.items()])
    return rows.join(running(groups, [F.col(k).asc() for k in keys], {name: name for name in counts}), keys)


def _sort_here(cover: int):
    """Ranks of a string that one task holds."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None:
            return
        pos, s = (table.column(c).to_numpy() for c in ("pos", "s"))
        order = np.argsort(pos, kind="stable")
        yield pa.RecordBatch.from_arrays([pa.array(pos[order]), pa.array(_ranks(s[order], cover))], names=["pos", "r"])

    return rows


def suffix_ranks(string: DataFrame, n: int, cover: int = 1, base: int = BASE) -> DataFrame:
    """(pos, r) for each row of ``string`` (pos from 0 to n - 1, s > 0): the order of the suffixes that start there.

    A symbol says ``cover`` symbols of the first string. Suffixes that agree in a window's symbols may come in any order
    or tie; others are in the order of their symbols.
    """
    if n <= base:
        return string.select("pos", "s").coalesce(1).mapInArrow(_sort_here(cover), "pos long, r long")
    string = stored(string.select("pos", "s"), "string")
    mod = F.col("pos") % 3
    sample = _behind(string, {"s1": ("s", 1), "s2": ("s", 2)}).where(mod != 0)
    named = stored(_smaller(sample, ["s", "s1", "s2"], {"name": F.lit(1)}).select("pos", "name"), "named")
    n_sample, n_names = named.agg(F.count("*"), F.approx_count_distinct("name", 0.01)).first()
    named = named.withColumn("name", F.col("name") + 1)
    if 3 * cover < WIDTH and n_names < 2 * n_sample:
        first = (n + 1) // 3  # places that are 1 modulo 3
        place = F.when(mod == 1, F.floor(F.col("pos") / 3)).otherwise(F.floor(F.col("pos") / 3) + first)
        names = named.select(place.cast("long").alias("pos"), F.col("name").alias("s"))
        ranks = suffix_ranks(names, n_sample, 3 * cover, base)
        back = F.when(F.col("pos") < first, F.col("pos") * 3 + 1).otherwise((F.col("pos") - first) * 3 + 2)
        named = stored(ranks.select(back.alias("pos"), F.col("r").alias("name")), "ranked")
    all_ = string.join(named, "pos", "left").withColumn("name", F.coalesce("name", F.lit(0)))
    all_ = stored(_behind(all_, {"s1": ("s", 1), "r1": ("name", 1), "r2": ("name", 2)}), "all")
    is_ = {k: mod == k for k in (0, 1, 2)}
    with_1 = _smaller(all_.where(mod != 2).select("pos", "s", "r1"), ["s", "r1"], {"a0": is_[0], "a1": is_[1]})
    with_2 = _smaller(
        all_.where(mod != 1).select("pos", "s", "s1", "r2"), ["s", "s1", "r2"], {"b0": is_[0], "b2": is_[2]}
    )
    sampled = _smaller(all_.where(mod != 0).select("pos", "name"), ["name"], {"c1": is_[1], "c2": is_[2]})
    ranks = (
        with_1.select("pos", "a0", "a1")
        .join(with_2.select("pos", "b0", "b2"), "pos", "full")
        .join(sampled.select("pos", "c1", "c2"), "pos", "full")
    )
    rank = (
        F.when(mod == 0, F.col("a0") + F.col("a1") + F.col("b2"))
        .when(mod == 1, F.col("a0") + F.col("a1") + F.col("c2"))
        .otherwise(F.col("b0") + F.col("b2") + F.col("c1"))
    )
    return stored(ranks.select("pos", (rank + 1).alias("r")), "ranks")


def _long_buckets(classes: DataFrame, n: int, base: int) -> DataFrame:
    """(key, form, first, last): the windows that classes share, found by sorting all ``n`` symbols of them."""
    sized = classes.select("key", "form", "symbols")
    firsts = running(sized, [F.col("key").asc(), F.col("form").asc()], {"first": "symbols"})
    places = classes.join(firsts, ["key", "form"]).select("first", "key", "form", "edge", "left")
    places = places.mapInArrow(_places, "pos long, s long, key long, form long, number long, window long")
    places = stored(places, "places")
    ranks = suffix_ranks(places, n, base=base)
    windows = places.where("number >= 0").select("pos", "key", "form", "number", "window").join(ranks, "pos")
    order = [F.col("r").asc(), F.col("window").asc(), F.col("pos").asc()]
    ordered = running(windows.withColumn("one", F.lit(1)), order, {"place": "one"})
    compared = _behind(ordered, {"next": ("window", 1), "last": ("window", -1)}, "place")
    # The hash 0 stands for no neighbour; a window whose own hash is 0 counts as equal to it.
    same = compared.where((F.col("window") == F.col("next")) | (F.col("window") == F.col("last")))
    return same.select("key", "form", F.col("number").alias("first"), F.col("number").alias("last"))


def repeated_windows(docs: DataFrame, base: int = BASE) -> DataFrame:
    """(tk, from, to): strings of windows that start anywhere else, of the texts in ``docs`` (tk, text), a text for a tk.

    Together they are all such windows; they may overlap and repeat.
    """
    spark = docs.sparkSession
    cores = docs.mapInArrow(_core_rows, "tk long, hash long, again boolean")
    twice = cores.groupBy("hash").agg(
        (F.min("tk") < F.max("tk")).alias("two"), F.max("again").alias("again")
    ).where("two or again")
    at = twice.select(F.shiftrightunsigned("hash", 64 - CORE_BITS).cast("int").alias("at")).distinct()
    bitmap = np.zeros(1 << CORE_BITS, dtype=bool)
    for batch in at.toArrow().to_batches():  # one number for each place of the bitmap at most
        bitmap[batch.column("at").to_numpy()] = True
    pieces = docs.mapInArrow(
        _pieces(spark.sparkContext.broadcast(bitmap)), "tk long, key long, edge binary, left int, at long"
    )
    pieces = stored(pieces.withColumn("form", F.xxhash64("edge", "left")), "pieces")

    # Tasks may have found a text twice, so places are told apart, not counted.
    place = F.xxhash64("tk", "at")
    classes = pieces.groupBy("key", "form", "edge", "left").agg((F.min(place) < F.max(place)).alias("again"))
    classes = stored(classes.withColumn("symbols", F.octet_length("edge").cast("long") + 1), "piece-classes")
    buckets = classes.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("symbols").alias("bucket")).where("kinds > 1")
    open_ = stored(classes.join(buckets.select("key", "bucket"), "key"), "open")
    whole = classes.where("again").select(
        "key", "form", F.lit(0).cast("long").alias("first"), (F.col("symbols") - WIDTH).alias("last")
    )
    short = open_.where(F.col("bucket") <= base).select("key", "form", "edge", "left")
    short = short.repartition("key").sortWithinPartitions("key")
    found = whole.unionByName(short.mapInArrow(_sort_buckets(base), "key long, form long, first long, last long"))
    long = open_.where(F.col("bucket") > base)
    n = long.agg(F.sum("symbols")).first()[0]
    if n:
        found = found.unionByName(_long_buckets(long.drop("bucket", "again"), n, base))
    spans = pieces.select("tk", "key", "form", "at").join(found, ["key", "form"])
    return spans.select(
        "tk", (F.col("at") + F.col("first")).alias("from"), (F.col("at") + F.col("last") + LENGTH).alias("to")
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data, spans = (text or "").encode(), spans or []
            edges = [0, *[x for s in spans for x in (s["from"], s["to"])], len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
        arrays = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *arrays, pa.array([r[3] for r in rows], pa.string()), pa.array([r[4] for r in rows], pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame, base: int = BASE) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes).

    Every byte goes that a 400-byte string covers which also starts anywhere else, in the same text or another. Null is
    an empty text. Rows that repeat are copies of each other. Ids are passed on as they are; an empty table gives no
    rows; other columns are not read.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tk"))
    classes = rows.groupBy("tk").agg(F.count("*").alias("rows"), F.first(F.octet_length("text")).alias("n"))
    windows = repeated_windows(rows.select("tk", "text"), base)
    order = Window.partitionBy("tk").orderBy("from", "to")
    before = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = before.isNull() | (F.col("from") > before)
    islands = windows.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(order))
    spans = islands.groupBy("tk", "island").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    spans = spans.groupBy("tk").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("found"))
    copied = (F.col("rows") > 1) & (F.col("n") >= LENGTH)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("n").cast("long").alias("to")))
    chosen = classes.join(spans, "tk", "left").select("tk", F.when(copied, whole).otherwise(F.col("found")).alias("spans"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.join(chosen.where("spans is not null"), "tk", "left").select("doc_id", "text", "spans").mapInArrow(
        _cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
