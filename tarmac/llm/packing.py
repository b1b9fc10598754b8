"""Operator 4: variable-capacity best-fit packing of token sequences into several permitted lengths."""

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.plans.running import running
from tarmac.sources.work import stored

CAPACITIES = (512, 1024, 2048, 4096, 8192)
# What a bin costs besides its places, in places: the fixed cost of one more sequence.
BIN_COST = 32


class Bins:
    """Bins that are alike: ids ``first`` to ``first + n - 1``, with the same free places and contents.

    ``contents`` has for each size: (size, pieces in a bin, place of the first one, slot of the first bin's first one).
    """

    def __init__(self, first: int, n: int, used: int, free: int, contents: tuple):
        self.first, self.n, self.used, self.free, self.contents = first, n, used, free, contents

    def split(self, n: int) -> tuple["Bins", "Bins"]:
        later = tuple((s, k, at, slot + n * k) for s, k, at, slot in self.contents)
        return (
            Bins(self.first, n, self.used, self.free, self.contents),
            Bins(self.first + n, self.n - n, self.used, self.free, later),
        )

    def put(self, size: int, k: int, slot: int) -> "Bins":
        more = (*self.contents, (size, k, self.used, slot))
        return Bins(self.first, self.n, self.used + size * k, self.free - size * k, more)


def best_fit(sizes: Sequence[tuple[int, int]], opens: Callable[[int], int]) -> list[Bins]:
    """Best-fit decreasing of ``sizes`` (size, number of pieces): bins, before they are downsized.

    Each piece goes to the open bin with the fewest free places that holds it, else to a new bin of ``opens(size)``
    places. Bins that are alike are kept as one entry and filled together, so the work depends on the number of
    different sizes alone, whatever the number of pieces.
    """
    by_free: dict[int, list[Bins]] = {}
    frees: list[int] = []
    done: list[Bins] = []
    next_bin = 0

    def keep(bins: Bins) -> None:
        if bins.n == 0:
            return
        if bins.free == 0:
            done.append(bins)
        elif bins.free in by_free:
            by_free[bins.free].append(bins)
        else:
            by_free[bins.free] = [bins]
            insort(frees, bins.free)

    for size, left in sorted(sizes, reverse=True):
        slot = 0
        while left:
            at = bisect_left(frees, size)
            if at < len(frees):
                bins = by_free[frees[at]].pop()
                if not by_free[bins.free]:
                    del by_free[bins.free]
                    frees.pop(at)
            else:
                capacity = opens(size)
                n = -(-left // (capacity // size))
                bins = Bins(next_bin, n, 0, capacity, ())
                next_bin += n
            fits = bins.free // size
            n = min(bins.n, left // fits)
            full, rest = bins.split(n)
            if n:
                keep(full.put(size, fits, slot))
                slot, left = slot + n * fits, left - n * fits
            if rest.n and left:  # fewer are left than one more bin would hold
                one, rest = rest.split(1)
                keep(one.put(size, left, slot))
                slot, left = slot + left, 0
            keep(rest)
    return done + [b for group in by_free.values() for b in group]


def plan(
    sizes: Sequence[tuple[int, int]], capacities: Sequence[int], cost: Callable[[int], float]
) -> list[tuple[Bins, int]]:
    """The cheapest packing found and each entry's capacity.

    One packing opens the bin size that costs least for a place; the others prefer one permitted size each. All are
    packed, every bin is downsized to the smallest permitted size that holds its contents, and the cheapest stays.
    """
    capacities = sorted(capacities)

    def downsized(bins: list[Bins]) -> list[tuple[Bins, int]]:
        return [(b, capacities[bisect_left(capacities, b.used)]) for b in bins]

    def at_least(floor: int) -> Callable[[int], int]:
        return lambda size: capacities[bisect_left(capacities, max(size, floor))]

    def least(size: int) -> int:
        return min((c for c in capacities if c >= size), key=lambda c: (cost(c) / c, c))

    packings = [downsized(best_fit(sizes, opens)) for opens in (least, *map(at_least, capacities))]
    return min(packings, key=lambda bins: sum(b.n * cost(c) for b, c in bins))


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    size: str = "size",
    capacities: Sequence[int] = CAPACITIES,
    cost: Callable[[int], float] = lambda capacity: capacity + BIN_COST,
) -> DataFrame:
    """Pieces of ``docs`` placed in bins: doc_id, piece, start, length, bin_id, capacity, bin_start.

    A row longer than the largest capacity is cut into pieces of that length and a rest; other rows are one piece. Rows
    of null, zero or negative size have no piece. ``start`` is the piece's first token in its row, ``bin_start`` its
    first place in the bin. Ids may be null or repeat: each row is packed on its own. An empty table gives no rows;
    other columns are not read.

    The packing is worked out from the number of pieces of each size, at most one entry for each place of the largest
    capacity. Pieces are numbered by size and id over the whole table, and each finds its bin by its number.
    """
    spark, most = docs.sparkSession, max(capacities)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(size).cast("long").alias("size")).where("size > 0")
    n_pieces = F.ceil(F.col("size") / most).cast("long")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), n_pieces - 1)))
    pieces = pieces.select(
        "doc_id",
        "piece",
        (F.col("piece") * most).alias("start"),
        F.least(F.lit(most).cast("long"), F.col("size") - F.col("piece") * most).alias("length"),
        F.lit(1).cast("long").alias("__one"),
    )
    order = [F.col("length").asc(), F.col("doc_id").asc(), F.col("piece").asc()]
    numbered = stored(running(pieces, order, {"number": "__one"}), "pieces")
    sizes = [(r[0], r[1]) for r in numbered.groupBy("length").count().collect()]  # at most ``most`` rows
    before, total = {}, 0
    for s, n in sorted(sizes):
        before[s], total = total, total + n
    slots = sorted(
        (before[s] + slot, b.first, k, at, capacity)
        for b, capacity in (plan(sizes, capacities, cost) if sizes else [])
        for s, k, at, slot in b.contents
    )
    table = spark.sparkContext.broadcast(np.array(slots, dtype=np.int64).reshape(-1, 5))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, bin_first, per_bin, at, capacity = table.value.T
        for batch in batches:
            number = batch.column("number").to_numpy()
            length = batch.column("length").to_numpy()
            i = np.searchsorted(first, number, side="right") - 1
            turn = number - first[i]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("doc_id", "piece", "start", "length")],
                    pa.array(bin_first[i] + turn // per_bin[i]),
                    pa.array(capacity[i]),
                    pa.array(at[i] + turn % per_bin[i] * length),
                ],
                names=["doc_id", "piece", "start", "length", "bin_id", "capacity", "bin_start"],
            )

    kind = numbered.schema["doc_id"].dataType.simpleString()
    return numbered.select("doc_id", "piece", "start", "length", "number").mapInArrow(
        place,
        f"doc_id {kind}, piece long, start long, length long, bin_id long, capacity long, bin_start long",
    )
