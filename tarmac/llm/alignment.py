"""Operator 13: alignment of two tokenizers' tokens by divide and conquer at shared cuts.

A text's tokens of both vocabularies are laid out by their last byte. A cut is a byte where a token of each ends. An
interval between two cuts is divided at the cut nearest to its middle: from the middle token's end the other side's next
end is found by bisection, from there this side's next one, and so on until two ends meet or the interval is left; the
same to the left. Both halves are divided in turn; an interval in which no ends meet is a leaf group. Many texts are
divided at once: all open intervals of a run of texts are arrays, and every round of bisections serves all of them.

Within a group tokens of both sides overlap along a staircase: those links are counted for each pair of ids over the
whole corpus. What a document holds is stored once, as its different pairs with their numbers, and meets the counts of
all documents in two ways that give the same sums: at most ``COMMON`` pairs, the most frequent, are held by every task,
and whatever pairs are left are joined by their key. A pair that many documents share is always among the former.
"""

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.tokens import PATTERN
from tarmac.sources.work import stored

# Pairs whose counts every task holds, at most: 17 bytes each.
COMMON = 1 << 20
# Bytes of text aligned at once, and pre-tokens a task remembers.
RUN = 1 << 20
REMEMBERED = 1 << 19
SHIFT = 1 << 32
# Characters whose classes no version of Unicode changes: ASCII, Latin, and common punctuation. The pre-tokens of texts
# of these are looked up; other texts go through the library whole.
_SETTLED = re.compile("[\t\n\r\x20-\x7e¡-ɏ‐-‧€]*")


class ByteTokens:
    """Token ids and byte lengths of a byte-level BPE vocabulary of the tokenizers library (the content of its file)."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work
        self.tokenizer = tokenizers.Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.words = regex.compile(PATTERN)
        self.known: dict[str, list[int] | None] = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        ids = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.lengths = np.array([len(x) for x in self.bytes], dtype=np.int64)

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def joins_to(self, ids: list[int], data: bytes) -> bool:
        return b"".join([self.bytes[i] for i in ids]) == data

    def _learn(self, words: set[str]) -> None:
        """Encode pre-tokens, a line each of one text; where a line feed may join them, each by itself.

        One whose tokens do not join to its bytes is known by None.
        """
        apart = [w for w in words if w.isspace()]
        lines = list(words.difference(apart))
        encoded = self._encoded([*apart, "\n".join(lines)])
        ids = encoded.pop()
        ends = np.cumsum(self.lengths[ids])
        last = np.searchsorted(ends, np.cumsum([len(w.encode()) + 1 for w in lines]) - 1).tolist()
        encoded += [tuple(ids[i : j + 1]) for i, j in zip([0, *(j + 2 for j in last)], last, strict=False)]
        for word, own in zip(chain(apart, lines), encoded, strict=True):
            self.known[word] = own if self.joins_to(own, word.encode()) else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text; an empty list if they do not join to its bytes."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out: list[list[int]] = [[]] * len(texts)
        pieces, unsettled = {}, []
        known = self.known.__getitem__
        for i, text in enumerate(texts):
            if not _SETTLED.fullmatch(text):
                unsettled.append(i)
                continue
            words = self.words.findall(text)
            try:
                out[i] = list(chain.from_iterable(map(known, words)))
            except (KeyError, TypeError):  # a new pre-token, or one known by None
                pieces[i] = words
        if pieces:
            self._learn(set(chain.from_iterable(pieces.values())).difference(self.known))
        for i, words in pieces.items():
            found = list(map(known, words))
            if all(found):
                out[i] = list(chain.from_iterable(found))
        for i, ids in zip(unsettled, self._encoded([texts[i] for i in unsettled]), strict=True):
            out[i] = ids if self.joins_to(ids, texts[i].encode()) else []
        return out


class PieceTokens:
    """Token ids and bytes of a sentencepiece vocabulary (the content of its file)."""

    def __init__(self, vocabulary: bytes):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=vocabulary)
        self.bytes = []
        for i in range(self.processor.get_piece_size()):
            piece = self.processor.id_to_piece(i)
            if self.processor.is_byte(i):
                self.bytes.append(bytes([int(piece[3:-1], 16)]))
            else:
                self.bytes.append(piece.replace("▁", " ").encode())
        self.lengths = np.array([len(x) for x in self.bytes], dtype=np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1)


def _meet(x: np.ndarray, low: np.ndarray, high: np.ndarray, ends: list[np.ndarray], step: int) -> np.ndarray:
    """From ends ``x`` of the first side to the right (``step`` 1) or left (-1), the next end of both sides; -1 if none.

    Ends meet strictly between ``low`` and ``high``. Every round bisects the other side's ends for each of ``x``.
    """
    out = np.full(len(x), -1)
    at, turn = np.flatnonzero((x > low) & (x < high)), 1
    x = x[at]
    while len(at):
        other = ends[turn]
        if step > 0:
            k = np.searchsorted(other, x)
            y = other[np.minimum(k, len(other) - 1)]
            inside = (k < len(other)) & (y < high[at])
        else:
            k = np.searchsorted(other, x, side="right") - 1
            y = other[np.maximum(k, 0)]
            inside = (k >= 0) & (y > low[at])
        met = inside & (y == x)
        out[at[met]] = y[met]
        on = inside & ~met
        at, x, turn = at[on], y[on], 1 - turn
    return out


def _halves(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The intervals' two halves next to each other, so that they stay in order and bisections find their way near."""
    return np.stack([left, right], axis=1).ravel()


def group_ends(a: np.ndarray, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of the groups, in order: ``a`` and ``b`` are the two sides' token ends in bytes, over texts that reach from
    ``starts`` to ``ends``, which are cuts."""
    cuts = [ends]
    low, high = starts, ends
    # Intervals are known by the first and the last of a's tokens in them.
    last = np.searchsorted(a, high)
    first = np.concatenate([[0], last[:-1] + 1])
    while len(low):
        # The middle one of the tokens that end inside; none in intervals of one token.
        many = last > first
        low, high, first, last = low[many], high[many], first[many], last[many]
        middle = a[(first + last - 1) // 2]
        cut = _meet(middle, low, high, [a, b], 1)
        open_left = np.flatnonzero(cut != middle)
        left = _meet(middle[open_left], low[open_left], high[open_left], [a, b], -1)
        right = cut[open_left]
        nearer = (left >= 0) & ((right < 0) | (middle[open_left] - left < right - middle[open_left]))
        cut[open_left] = np.where(nearer, left, right)
        found = cut >= 0
        low, high, first, last, cut = low[found], high[found], first[found], last[found], cut[found]
        cuts.append(cut)
        at = np.searchsorted(a, cut)
        low, high = _halves(low, cut), _halves(cut, high)
        first, last = _halves(first, at + 1), _halves(at, last)
    return np.sort(np.concatenate(cuts))


def _laid_out(lists: list[list[int]], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids one after the other, their ends in bytes, and the number of ids before each text."""
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    ids = np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=int(first[-1]))
    return ids, np.cumsum(lengths[ids]), first


def _strings(n: int, marks: str) -> np.ndarray:
    return np.array([f"{i}{mark}" for mark in marks for i in range(n)], dtype=object)


def _before(ends: np.ndarray, size: int) -> np.ndarray:
    """For each byte place up to ``size``, how many of ``ends`` come before it."""
    out = np.zeros(size + 2, dtype=np.int64)
    out[ends + 1] = 1
    return np.cumsum(out, out=out)


class Aligner:
    """Aligns runs of texts."""

    def __init__(self, vocabulary_a: str, vocabulary_b: bytes):
        self.a, self.b = ByteTokens(vocabulary_a), PieceTokens(vocabulary_b)
        self.lengths = [self.a.lengths, self.b.lengths]
        # Ids as texts, inside a group's part and at its end.
        self.text = [_strings(len(n), marks) for n, marks in zip(self.lengths, (",|", ",;"), strict=True)]
        self.bits = [(len(n) - 1).bit_length() for n in self.lengths]

    def align(self, texts: list[str]) -> list[tuple]:
        """For each text: tokens of both sides, groups, links, the groups' digest, its different pairs and their numbers."""
        given = [i for i, t in enumerate(texts) if t]
        spaced = [" " + texts[i] for i in given]
        lists = [self.a.encode(spaced), self.b.encode([texts[i] for i in given])]
        bytes_b, kept, sizes = self.b.bytes, [], []
        for k, text in enumerate(spaced):
            data = text.encode()
            if lists[0][k] and b"".join([bytes_b[i] for i in lists[1][k]]) == data:
                kept.append(k)
                sizes.append(len(data))
        none = (0, 0, 0, 0, "", np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        out = [none] * len(texts)
        if kept:
            for k, row in zip(kept, self._aligned([[side[k] for k in kept] for side in lists], sizes), strict=True):
                out[given[k]] = row
        return out

    def _aligned(self, lists: list[list[list[int]]], sizes: list[int]) -> Iterator[tuple]:
        limits = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        (a, a_ends, a_first), (b, b_ends, b_first) = (
            _laid_out(x, n) for x, n in zip(lists, self.lengths, strict=True)
        )
        cuts = group_ends(a_ends, b_ends, limits[:-1], limits[1:])
        groups = np.diff(np.searchsorted(cuts, limits, side="right"))
        a_before, b_before = _before(a_ends, limits[-1]), _before(b_ends, limits[-1])
        # A link ends where a token of either side does; a group's cut is the end of its last link.
        is_end = np.zeros(limits[-1] + 1, dtype=bool)
        is_end[a_ends] = is_end[b_ends] = True
        ends = np.flatnonzero(is_end)
        links = np.diff(np.searchsorted(ends, limits, side="right"))
        text = np.repeat(np.arange(len(sizes)), links)
        (a_bits, b_bits), mask = self.bits, np.int64((1 << self.bits[1]) - 1)
        keys = (text << a_bits | a[a_before[ends]]) << b_bits | b[b_before[ends]]
        keys.sort()
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        times = np.diff(np.concatenate([new, [len(keys)]]))
        keys = keys[new]
        first = np.searchsorted(keys, np.arange(len(sizes) + 1) << (a_bits + b_bits))
        pairs = (keys >> b_bits & np.int64((1 << a_bits) - 1)) << 32 | keys & mask
        written = self._written((a, a_ends, a_before), (b, b_ends, b_before), cuts)
        for i in range(len(sizes)):
            start, end = a_first[i] + b_first[i], a_first[i + 1] + b_first[i + 1]
            groups_text = "".join(written[start:end].tolist())[:-1]
            yield (
                int(a_first[i + 1] - a_first[i]),
                int(b_first[i + 1] - b_first[i]),
                int(groups[i]),
                int(links[i]),
                sha256(groups_text.encode()).hexdigest(),
                pairs[first[i] : first[i + 1]],
                times[first[i] : first[i + 1]],
            )

    def _written(self, side_a: tuple, side_b: tuple, cuts: np.ndarray) -> np.ndarray:
        """The ids of all groups as texts with what follows each: first a group's ids of one side, then of the other."""
        (a, a_ends, a_before), (b, b_ends, b_before) = side_a, side_b
        n_a, n_b = (len(x) for x in self.lengths)
        is_cut = np.zeros(cuts[-1] + 1, dtype=bool)
        is_cut[cuts] = True
        group = _before(cuts, cuts[-1])
        out = np.empty(len(a) + len(b), dtype=object)
        # Before an id stand its own side's ids, and the other's of all earlier groups (of its own group as well for b).
        b_earlier = b_before[np.concatenate([[0], cuts[:-1]]) + 1]
        a_so_far = a_before[cuts + 1]
        out[np.arange(len(a)) + b_earlier[group[a_ends]]] = self.text[0][a + n_a * is_cut[a_ends]]
        out[np.arange(len(b)) + a_so_far[group[b_ends]]] = self.text[1][b + n_b * is_cut[b_ends]]
        return out


@lru_cache(maxsize=1)
def _aligner(vocabulary_a: str, vocabulary_b: bytes) -> Aligner:
    """A worker that serves several tasks keeps its vocabularies and the pre-tokens it remembers."""
    return Aligner(vocabulary_a, vocabulary_b)


ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
_NAMES = [c.split(" ")[0] for c in ALIGNED.split(", ")]


def _runs(texts: list[str]) -> Iterator[list[str]]:
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size > RUN:
            yield run
            run, size = [], 0
    if run:
        yield run


def aligned(docs: DataFrame, vocabulary_a: str, vocabulary_b: bytes) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id and its alignment; a pair is a's id times 2^32 plus b's."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary_a, vocabulary_b))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*shared.value)
        for batch in batches:
            at = 0
            for run in _runs([t or "" for t in batch.column("text").to_pylist()]):
                columns = list(zip(*aligner.align(run), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(run)),
                        *(pa.array(c, pa.int64()) for c in columns[:4]),
                        pa.array(columns[4], pa.string()),
                        pa.array(columns[5], pa.list_(pa.int64())),
                        pa.array([c.astype(np.int32) for c in columns[6]], pa.list_(pa.int32())),
                    ],
                    names=["doc_id", *_NAMES],
                )
                at += len(run)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, {ALIGNED}")


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each pair, summed over a batch."""
    for batch in batches:
        pairs = batch.column("pairs").flatten().to_numpy()
        times = batch.column("times").flatten().to_numpy().astype(np.int64)
        order = np.argsort(pairs, kind="stable")
        pairs = pairs[order]
        first = np.flatnonzero(np.concatenate([[len(pairs) > 0], pairs[1:] != pairs[:-1]])) if len(pairs) else order
        links = np.add.reduceat(times[order], first) if len(pairs) else times
        yield pa.RecordBatch.from_arrays([pa.array(pairs[first]), pa.array(links)], names=["pair", "links"])


def pair_counts(alignments: DataFrame) -> DataFrame:
    """(pair, count, best): each pair's links over all rows, and whether no pair of its b id has more."""
    counts = alignments.select("pairs", "times").mapInArrow(_added, "pair long, links long")
    counts = stored(counts.groupBy("pair").agg(F.sum("links").alias("count")), "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit(SHIFT - 1)).alias("b")
    most = counts.groupBy(b).agg(F.max("count").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _least_common(counts: DataFrame, limit: int) -> int:
    """The least power of two that at most ``limit`` pairs' counts reach."""
    size = F.floor(F.log2("count")).cast("int")
    sizes = counts.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()  # 63 rows at most
    total, least = 0, (1 << 63) - 1
    for row in sorted(sizes, key=lambda r: -r.size):
        total += row.n
        if total > limit:
            break
        least = 1 << row.size
    return least


def align_tokens(docs: DataFrame, vocabulary_a: str, vocabulary_b: bytes, common: int = COMMON) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``vocabulary_a`` is the content of a byte-level BPE file, applied to a space and the text, ``vocabulary_b`` that of a
    sentencepiece file which puts the space itself. n_best are the links whose pair no other pair of the b id exceeds,
    ties included; count_sum adds the counts of all links; the digest is of ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts, and those whose tokens do not join to their bytes, have no tokens: zeros and an empty digest.
    Special strings are plain text. Texts are aligned whole; ids are passed on as they are; rows that repeat count each;
    an empty table gives no rows; other columns are not read. At most ``common`` pairs are held by a task.
    """
    alignments = stored(aligned(docs, vocabulary_a, vocabulary_b), "alignments")
    counts = stored(pair_counts(alignments), "counts")
    least = _least_common(counts, common)
    held = counts.where(F.col("count") >= least).toArrow()
    order = np.argsort(held["pair"].to_numpy(), kind="stable")
    table = [held[c].to_numpy(zero_copy_only=False)[order] for c in ("pair", "count", "best")]
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = shared.value
        known = np.concatenate([known, [-1]])  # no pair; never reached by the bisection before it
        for batch in batches:
            lists = batch.column("pairs")
            pairs, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            ends = np.cumsum(pa.compute.list_value_length(lists).to_numpy())
            at = np.searchsorted(known[:-1], pairs)
            found = known[at] == pairs
            at = at[found]
            weights = np.zeros((2, len(pairs) + 1), dtype=np.int64)
            weights[0, 1:][found] = times[found] * best[at]
            weights[1, 1:][found] = times[found] * count[at]
            totals = np.cumsum(weights, axis=1)
            totals = np.diff(totals[:, np.concatenate([[0], ends]).astype(np.int64)], axis=1)
            starts = np.concatenate([[0], ends])
            rare = np.flatnonzero(~found)
            offsets = np.searchsorted(rare, starts).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", *_NAMES[:5])),
                    pa.array(totals[0]),
                    pa.array(totals[1]),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(pairs[rare])),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(times[rare])),
                ],
                names=["doc_id", *_NAMES[:5], "n_best", "count_sum", "rare", "rare_times"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ", ".join(ALIGNED.split(", ")[:5])
    rows = alignments.mapInArrow(
        sums, f"doc_id {kind}, {columns}, n_best long, count_sum long, rare array<long>, rare_times array<long>"
    )
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if least == 1:  # every pair is held
        return rows.select(out)
    # Rows of the same groups have the same pairs: one of them stands for all.
    rows = stored(rows, "partly-counted")
    open_rows = rows.where(F.size("rare") > 0).groupBy("groups_sha256")
    open_rows = open_rows.agg(F.first(F.arrays_zip("rare", "rare_times")).alias("rare"))
    links = open_rows.select("groups_sha256", F.inline("rare").alias("pair", "times"))
    rare = links.join(counts.where(F.col("count") < least), "pair").groupBy("groups_sha256")
    rare = rare.agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("times") * F.col("count")).alias("more_count"),
    )
    rows = rows.join(rare, "groups_sha256", "left")
    for name, more in (("n_best", "more_best"), ("count_sum", "more_count")):
        rows = rows.withColumn(name, F.col(name) + F.coalesce(more, F.lit(0)))
    return rows.select(out)
