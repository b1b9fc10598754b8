"""Operator 8: token counts of a byte-level BPE vocabulary, by merging many pre-tokens at once in numpy arrays.

A text is cut at the special strings of the vocabulary (a token each) and then by the pattern of the pre-tokenizer. The
pre-tokens that a task has not met yet are laid end to end as symbols. In each round every sequence looks up the ranks
of its neighbouring pairs, takes its lowest, and merges all places where that pair stands, from the left where they
overlap. A pair formed by a merge has a higher rank than the pair merged, so the rounds give what merging one place at a
time gives. Sequences without a pair are done; the symbols that are left are their tokens.

A long sequence would need many rounds over all of its symbols. Its places are held by rank instead: a round takes the
places of the lowest rank, merges them at once and looks again only at the places next to them.
"""

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1024
# Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Pre-tokens a task remembers; beyond that it forgets all and goes on.
REMEMBERED = 1 << 20
# Bytes from which on a pre-token is merged by itself. Both ways give the same counts.
LONG = 256
# Characters of text whose pre-tokens are held together.
RUN = 1 << 21


def _byte_symbols() -> dict[str, int]:
    """The character that stands for each byte: itself if it is printable, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """The merges of a vocabulary file: pairs of symbols, sorted, with their ranks and results."""

    def __init__(self, text: str):
        file = json.loads(text)
        self.special = [t["content"] for t in file["added_tokens"]]
        symbols = _byte_symbols()
        ids = file["model"]["vocab"]
        self.byte_ids = np.zeros(256, dtype=np.int64)
        for char, byte in symbols.items():
            self.byte_ids[byte] = ids[char]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        pairs = np.array([ids[a] << 32 | ids[b] for a, b in merges], dtype=np.int64)
        results = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks, self.results = pairs[order], order.astype(np.int64), results[order]

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The number of tokens of each pre-token."""
        long = np.array([len(w) >= LONG for w in words], dtype=bool)
        found = np.zeros(len(words), dtype=np.int64)
        found[long] = [self._long_count(w) for w, is_long in zip(words, long, strict=True) if is_long]
        if not long.all():
            found[~long] = self._short_counts([w for w, is_long in zip(words, long, strict=True) if not is_long])
        return found

    def _ranked(self, symbols: np.ndarray, after: np.ndarray, places: np.ndarray) -> dict[int, np.ndarray]:
        """Those of the ``places`` where a pair stands that can be merged, by its index."""
        places = places[after[places] < len(symbols)]
        pair = symbols[places] << 32 | symbols[after[places]]
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        known = self.pairs[at] == pair
        places, at = places[known], at[known]
        order = np.argsort(at, kind="stable")
        places, at = places[order], at[order]
        firsts = np.flatnonzero(np.diff(at, prepend=-1))
        return dict(zip(at[firsts].tolist(), np.split(places, firsts[1:]), strict=True)) if len(at) else {}

    def _long_count(self, word: bytes) -> int:
        """The number of tokens of one pre-token, in work that follows its merges and not its length in every round."""
        symbols = self.byte_ids[np.frombuffer(word, dtype=np.uint8)]
        size = len(symbols)
        after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
        there = np.ones(size, dtype=bool)
        waiting, queue = {}, []

        def hold(found: dict[int, np.ndarray]) -> None:
            for pair, places in found.items():
                if pair not in waiting:
                    waiting[pair] = []
                    heapq.heappush(queue, (int(self.ranks[pair]), pair))
                waiting[pair].append(places)

        hold(self._ranked(symbols, after, np.arange(size)))
        left = size
        while queue:
            _, pair = heapq.heappop(queue)
            places = np.unique(np.concatenate(waiting.pop(pair)))
            # Some places were merged away or hold another pair by now.
            places = places[there[places] & (after[places] < size)]
            places = places[symbols[places] << 32 | symbols[after[places]] == self.pairs[pair]]
            if not len(places):
                continue
            # In a run of overlapping places every second one stays, from the left.
            number = np.arange(len(places))
            run_start = np.concatenate([[True], after[places[:-1]] != places[1:]])
            places = places[(number - np.maximum.accumulate(np.where(run_start, number, 0))) % 2 == 0]
            gone = after[places]
            symbols[places], there[gone] = self.results[pair], False
            behind = after[gone]
            after[places] = behind
            inside = behind < size
            before[behind[inside]] = places[inside]
            left -= len(places)
            ahead = before[places]
            hold(self._ranked(symbols, after, np.unique(np.concatenate([places, ahead[ahead >= 0]]))))
        return left

    def _short_counts(self, words: list[bytes]) -> np.ndarray:
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        left = lengths.copy()
        none = np.int64(len(self.pairs))
        while len(symbols) > 1:
            pair = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            known = (self.pairs[at] == pair) & (owner[:-1] == owner[1:])
            rank = np.where(known, self.ranks[at], none)
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            # The last symbol of all starts no pair.
            lowest = np.minimum.reduceat(np.concatenate([rank, [none]]), starts)
            sizes = np.diff(np.concatenate([starts, [len(symbols)]]))
            lowest = np.repeat(lowest, sizes)
            chosen = known & (rank == lowest[:-1])
            # In a run of overlapping places every second one stays, from the left.
            run_start = chosen & ~np.concatenate([[False], chosen[:-1]])
            first = np.maximum.accumulate(np.where(run_start, np.arange(len(chosen)), 0))
            chosen &= (np.arange(len(chosen)) - first) % 2 == 0
            places = np.flatnonzero(chosen)
            symbols[places] = self.results[at[places]]
            np.subtract.at(left, owner[places], 1)
            # What was merged into its neighbour goes, and so do sequences in which nothing more can be merged.
            stays = lowest < none
            stays[places + 1] = False
            symbols, owner = symbols[stays], owner[stays]
        return left


class Counter:
    """Token counts of texts, with a memory of pre-tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, {}
        self.words = regex.compile(PATTERN)
        special = "|".join(regex.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True))
        self.special = regex.compile(special) if special else None

    def count(self, texts: list[str]) -> list[int]:
        totals, pieces = [0] * len(texts), []
        for i, text in enumerate(texts):
            parts = self.special.split(text) if self.special else [text]
            totals[i] = len(parts) - 1
            pieces += [(i, self.words.findall(part)) for part in parts if part]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*[words for _, words in pieces]).difference(self.known))
        if new:
            counts = self.vocabulary.counts([w.encode() for w in new])
            self.known.update(zip(new, counts.tolist(), strict=True))
        for i, words in pieces:
            totals[i] += sum(map(self.known.__getitem__, words))
        return totals


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """The texts in runs of about ``RUN`` characters."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size > RUN:
            yield run
            run, size = [], 0
    if run:
        yield run


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens and over_limit (more tokens than ``limit``).

    ``vocabulary`` is the content of a byte-level BPE file. Null is an empty text: no bytes and no tokens. Special
    strings in a text are a token each. Texts are counted whole, ids are passed on as they are, rows that repeat are
    counted each; an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(Vocabulary(shared.value))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts = [n for run in _groups(texts) for n in counter.count(run)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    sized = docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text"
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = sized.mapInArrow(rows, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
