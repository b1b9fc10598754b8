"""Operator 11: benchmark decontamination with a generalised suffix automaton of the test items.

Words are runs of ASCII letters, lower-cased, digits and all characters beyond ASCII. The automaton holds every run of
words of every item. A text streams through it word by word: the state and the longest matching length follow the text,
a word that leads nowhere moves to ever shorter suffixes. Where the length reaches the window, the window's state names
the items it stands in; items of fewer words are windows of their own, found along the suffix links.

An automaton is built from at most ``SHARD_BYTES`` of items, whatever the size of the benchmark: longer items are cut
into pieces that overlap by a window less one word, pieces are numbered by running sums of their bytes, and each shard of
pieces takes its turn over the documents. What a shard finds is merged with what the ones before have found, so no key of
a document is needed and nothing is shuffled but the items.
"""

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.plans.running import running
from tarmac.sources.work import stored

WINDOW = 10
# A document whose words lie in windows to more than this share goes whole.
MOST_SHARE = 0.5
# Bytes of items in one automaton, of an item's piece, and of a text's words at hand at once.
SHARD_BYTES = 1 << 21
PIECE_BYTES = 1 << 17
RUN_BYTES = 1 << 20
# Shards that follow each other without storing what was found; each has a worker with its automaton.
CHAINED = 4

# Separators become spaces, capital letters small ones.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
FOUND = "n_words long, spans array<struct<start: long, end: long>>, items array<string>, longest long"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a run of about ``RUN_BYTES`` at a time."""
    text, at = text.translate(_PLAIN), 0
    while at < len(text):
        end = text.find(b" ", at + RUN_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


class Automaton:
    """The suffix automaton of items given as (name, words), and where in it their windows end."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(name, words) for name, words in items if words]
        for _, words in items:
            state = 0
            for word in words:
                state = self._grown(state, word)
        self._mark_windows(items)

    def _state(self, length: int, step: dict[bytes, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _grown(self, state: int, word: bytes) -> int:
        """The state of an item's words so far, after one more."""
        known = self.step[state].get(word)
        if known is not None:
            return self._ending_at(state, word, known)
        new, at = self._state(self.length[state] + 1, {}, 0), state
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._ending_at(at, word, self.step[at][word])
        return new

    def _ending_at(self, state: int, word: bytes, known: int) -> int:
        """The state whose longest run is ``state``'s and ``word``: the known one, or one split off from it."""
        if self.length[known] == self.length[state] + 1:
            return known
        part = self._state(self.length[state] + 1, dict(self.step[known]), self.link[known])
        self.link[known] = part
        while state >= 0 and self.step[state].get(word) == known:
            self.step[state][word] = part
            state = self.link[state]
        return part

    def _mark_windows(self, items: list[tuple[str, list[bytes]]]) -> None:
        n, window = len(self.length), self.window
        by_length = sorted(range(1, n), key=self.length.__getitem__)
        # The state of a state's last ``window`` words.
        self.window_state = [-1] * n
        for s in by_length:
            if self.length[s] >= window:
                above = self.link[s]
                self.window_state[s] = s if self.length[above] < window else self.window_state[above]
        self.names: dict[int, set[str]] = {}
        self.short: dict[int, int] = {}  # the states of whole items of fewer words, with their lengths
        for name, words in items:
            if len(words) < window:
                state = 0
                for word in words:
                    state = self.step[state][word]
                self.short[state] = len(words)
                self.names.setdefault(state, set()).add(name)
                continue
            for state, length in self.walk(words):
                if length >= window:
                    self.names.setdefault(self.window_state[state], set()).add(name)
        # The nearest state up the links, itself included, that is a whole short item.
        self.short_state = [-1] * n
        for s in by_length:
            self.short_state[s] = s if s in self.short else self.short_state[self.link[s]]

    def walk(self, words: list[bytes], state: int = 0, length: int = 0) -> Iterator[tuple[int, int]]:
        """State and longest matching length after each word."""
        step, link, lengths = self.step, self.link, self.length
        for word in words:
            following = step[state].get(word)
            while following is None and state:
                state = link[state]
                length = lengths[state]
                following = step[state].get(word)
            if following is None:
                yield 0, 0
            else:
                state, length = following, length + 1
                yield state, length

    def search(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str], int]:
        """Of a text: the number of words, (first, last + 1) of the word runs in windows, items' names, longest match."""
        window, window_state, short_state = self.window, self.window_state, self.short_state
        ends, sizes, states = [], [], set()
        n = longest = state = length = 0
        for words in words_of(text):
            for at, (state, length) in enumerate(self.walk(words, state, length), n + 1):  # noqa: B020
                if length > longest:
                    longest = length
                whole = length >= window
                if whole:
                    states.add(window_state[state])
                    ends.append(at)
                    sizes.append(window)
                short = short_state[state]
                while short > 0:
                    size = self.short[short]
                    if size <= length:
                        states.add(short)
                        if not whole:
                            ends.append(at)
                            sizes.append(size)
                            whole = True  # shorter ones lie inside
                    short = short_state[self.link[short]]
            n += len(words)
        return n, _runs(np.array(ends, dtype=np.int64), np.array(sizes, dtype=np.int64)), self._named(states), longest

    def _named(self, states: set[int]) -> set[str]:
        return set().union(*(self.names[s] for s in states))


def _runs(ends: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """The union of the intervals of ``sizes`` words before each of ``ends``, as maximal runs; touching ones are one."""
    if not len(ends):
        return []
    starts = ends - sizes
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(ends) - 1]])
    return list(zip(starts[new].tolist(), reach[last].tolist(), strict=True))


def _merged(spans: list[tuple[int, int]], others: list[dict]) -> list[tuple[int, int]]:
    pairs = np.array(spans + [(o["start"], o["end"]) for o in others], dtype=np.int64).reshape(-1, 2)
    return _runs(pairs[:, 1], pairs[:, 1] - pairs[:, 0])


def _pieces(window: int):
    """Items as pieces: of ``PIECE_BYTES`` or a little more, each but the first with the ``window`` - 1 words before."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, numbers, pieces = [], [], []
            for name, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = [w for run in words_of(text or b"") for w in run]
                sizes = np.cumsum([len(w) + 1 for w in words], dtype=np.int64)
                start = number = 0
                while start < len(words):
                    before = sizes[start - 1] if start else 0
                    end = int(np.searchsorted(sizes, before + PIECE_BYTES)) + 1
                    end = min(max(end, start + 2 * window), len(words))
                    names.append(name)
                    numbers.append(number)
                    pieces.append(b" ".join(words[start:end]))
                    if end == len(words):
                        break
                    start, number = end - window + 1, number + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(numbers, pa.int64()), pa.array(pieces, pa.binary())],
                names=["item", "number", "piece"],
            )

    return cut


def _shards(items: DataFrame, window: int) -> tuple[DataFrame, int]:
    """The pieces of the items with their shards, numbered from 0, and the number of shards."""
    named = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.encode("text", "utf-8").alias("text")
    )
    pieces = named.mapInArrow(_pieces(window), "item string, number long, piece binary")
    pieces = stored(pieces.withColumn("size", F.octet_length("piece").cast("long") + 1), "pieces")
    placed = running(pieces, [F.col("item"), F.col("number"), F.xxhash64("piece")], {"before": "size"})
    shards = stored(placed.withColumn("shard", F.floor(F.col("before") / SHARD_BYTES)), "shards")
    last = shards.agg(F.max("shard")).first()[0]
    return shards, 0 if last is None else last + 1


def _searched(docs: DataFrame, pieces: list[tuple[str, bytes]], window: int) -> DataFrame:
    """``docs`` (doc_id, text as bytes, what was found before) after one shard."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(((name, piece.split()) for name, piece in shared.value), window)
        for batch in batches:
            n_words, spans, items, longest = [], [], [], []
            before = [batch.column(c).to_pylist() for c in ("spans", "items", "longest")]
            for text, old_spans, old_items, old_longest in zip(batch.column("text").to_pylist(), *before, strict=True):
                n, own, names, length = automaton.search(text or b"")
                n_words.append(n)
                spans.append([{"start": a, "end": b} for a, b in (_merged(own, old_spans) if old_spans else own)])
                items.append(sorted(names.union(old_items)))
                longest.append(max(length, old_longest))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text"),
                    pa.array(n_words, pa.int64()),
                    pa.array(spans, _SPANS),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array(longest, pa.int64()),
                ],
                names=["doc_id", "text", "n_words", "spans", "items", "longest"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(rows, f"doc_id {kind}, text binary, {FOUND}")


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, text (its UTF-8 bytes) and what stands in ``items`` (item_id, text).

    n_words; spans, the runs of words inside a window as (start, end) of their numbers from 0, end not included; items,
    the ids of the items of these windows as sorted texts; longest, the longest run of words that stands in an item (or in
    a piece of one that was cut).

    A window is ``window`` words in a row of an item; a shorter item is one window, one without words none. Null is a text
    without words, a null item id an empty text; items of the same id are one. Rows that repeat are judged each; empty
    tables give no rows or no finds. Texts are read whole, in runs of ``RUN_BYTES``. Other columns are not read.
    """
    shards, n = _shards(items, window)
    none = [F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start: long, end: long>>").alias("spans")]
    none += [F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("longest")]
    found = docs.select("doc_id", F.encode("text", "utf-8").alias("text"), *none)
    for shard in range(max(n, 1)):
        # At most SHARD_BYTES and a piece.
        pieces = [(r.item, bytes(r.piece)) for r in shards.where(F.col("shard") == shard).collect()]
        if shard and shard % CHAINED == 0:
            found = stored(found, "leaks")
        found = _searched(found, pieces, window)
    return found


def hit_words(spans: Column) -> Column:
    """The number of words in the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words of their spans and what stands between these."""
    for batch in batches:
        kept = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            if spans:
                places = [m.span() for m in _WORD.finditer(text.translate(_PLAIN))]
                cuts = [(places[s["start"]][0], places[s["end"] - 1][1]) for s in spans]
                starts = [0, *(b for _, b in cuts)]
                text = b"".join(text[a:b] for a, b in zip(starts, [*(a for a, _ in cuts), len(text)], strict=True))
            kept.append(None if text is None else text.decode())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(kept, pa.string())],
            names=[*(c for c in batch.schema.names if c != "text"), "text"],
        )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_share: float = MOST_SHARE) -> DataFrame:
    """(doc_id, text, n_words, spans, items, longest, dropped): texts without what they share with ``items``.

    Spans of ``window`` words or more (or of whole shorter items) are cut out of the text, from the first word's start to
    the last word's end. ``dropped`` documents have more than ``most_share`` of their words in spans. A null text stays null. Otherwise as ``find_leaks``.
    """
    found = find_leaks(docs, items, window)
    dropped = hit_words(F.col("spans")) > F.lit(most_share) * F.col("n_words")
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = found.mapInArrow(_without, f"doc_id {kind}, {FOUND}, text string")
    return cut.select("doc_id", "text", "n_words", "spans", "items", "longest", dropped.alias("dropped"))
