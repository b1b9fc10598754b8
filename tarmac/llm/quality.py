"""Operator 1: quality rules on words, and a perplexity band for each language under an n-gram model of the corpus.

Perplexity is that of words, under a model for each language of its own: a word's discounted share of the language's
words (modified Kneser-Ney discounts), and what the discounts leave times the probability of its spelling. Words without
a letter or digit are no events, as a separator between all words would be the likeliest word. In scripts without spaces
a character is an event, with the probability of its spelling. Words are counted in the tasks and added up by key; a
word that the model's table lacks has been counted once, as the table holds all others of the corpus that is judged.
Tables beyond ``TABLE_WORDS`` are cut into ranges of keys, and the documents are read once for each range.

Spelling is a modified Kneser-Ney model of characters. Its counts are made by Spark over all documents: n-grams of the highest order are counted in the tasks and added up by key; the lower orders' counts are
those of the different characters that precede an n-gram, taken from the table above. Interpolated probabilities and
back-off weights come from joins of these tables. For scoring they are laid out as sorted arrays of hashes with an array
of values each. A hash has 24 bits, so an array has at most 2^24 entries whatever the corpus; n-grams that share a hash
share the most probable one's value.

The perplexities of all documents that pass the rules give, for each language, a median and a median distance from it;
documents too far below (repetitive) or above (unlike the language) are rejected. The order of words is not judged.
"""

import math
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.grams import U, Texts, mix, span_hashes, texts, word_grams
from tarmac.sources.work import stored

# Fixed values of the rules.
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"

# Characters in an n-gram of the highest order, and bits of a key for each of them and for the language.
ORDER = 4
CHAR_BITS = 13
LANG_BITS = 12
# Bits of a hash in the model's arrays: the bound of their length.
HASH_BITS = 24
# Different n-grams a task holds before it passes its counts on.
HELD = 1 << 21
# Entries of the table of words that a task holds; of larger ones it holds a range of keys at a time.
TABLE_WORDS = 1 << 24
# A band reaches so many median distances of the log2 perplexity of words up and down from its median, and at least so
# far. By the labelled rows of sf0.1: 8 is where the good rows end and the bad ones begin, while below the median no
# bound rejects a larger share of the bad rows than of the good ones, so that it lies beyond all good ones.
ABOVE = 8.0
BELOW = 13.0
LEAST_ABOVE = 1.5
LEAST_BELOW = 2.5
# Scripts written without spaces: from South-East Asia, Han and kana.
UNSPACED = ((0xE00, 0xF00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3040, 0x3100), (0x3400, 0xA000), (0xF900, 0xFB00),
            (0x20000, 0x40000))

_MULTIPLIER = U(0x9E3779B97F4A7C15)
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_PLAIN = (1 << CHAR_BITS) - 256


def _mask(n: int) -> int:
    return (1 << CHAR_BITS * n) - 1


def _lang_code(lang: str | None) -> int:
    """Languages are told apart by a hash of their name; null is one of its own."""
    return crc32((lang or "").encode()) % ((1 << LANG_BITS) - 1) + 1 if lang is not None else 0


def _points(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, and the number of those before each byte."""
    points = np.frombuffer(t.raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    heads = np.zeros(len(t.raw) + 1, dtype=np.int64)
    np.cumsum((t.raw & 0xC0) != 0x80, out=heads[1:])
    return points, heads


def _events(t: Texts, langs: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The key of the highest order that ends at each character, and the text of each character."""
    points, heads = _points(t)
    first = heads[t.offsets]
    text = np.repeat(np.arange(t.n), np.diff(first))
    symbol = (np.where(points < _PLAIN - 1, points + 1, _PLAIN + points % 256)).astype(np.uint64)
    place = np.arange(len(points)) - first[:-1][text]
    codes = np.array([_lang_code(x) for x in langs], dtype=np.uint64)
    keys = codes[text] << U(64 - LANG_BITS)
    for k in range(ORDER):
        before = np.zeros(len(points), dtype=np.uint64)
        before[k:] = symbol[: max(len(points) - k, 0)]
        keys |= np.where(place >= k, before, U(0)) << U(CHAR_BITS * k)
    return keys, text


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's n-grams of the highest order with their counts, each once or, if they are many, a few times."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def add() -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[starts], np.add.reduceat(counts[order], starts)

    def rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "c"])

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for row, t in texts(batch.column("text")):
            keys, counts = np.unique(_events(t, langs[row : row + t.n])[0], return_counts=True)
            if not len(keys):
                continue
            held.append((keys, counts.astype(np.int64)))
            if sum(len(k) for k, _ in held) > HELD:
                held[:] = [add()]
                if len(held[0][0]) > HELD // 2:
                    yield rows(*held.pop())
    if held:
        yield rows(*add())


def _lang(key: str = "key") -> Column:
    return F.shiftrightunsigned(key, 64 - LANG_BITS)


def _suffix(n: int) -> Column:
    """A key's last n characters, with the language."""
    top = F.col("key").bitwiseAND(F.lit(-1 << (64 - LANG_BITS)))
    return top.bitwiseOR(F.col("key").bitwiseAND(F.lit(_mask(n))))


def _context(n: int) -> Column:
    """A key of n characters without the last one, with the language."""
    top = F.col("key").bitwiseAND(F.lit(-1 << (64 - LANG_BITS)))
    chars = F.shiftrightunsigned(F.col("key").bitwiseAND(F.lit(_mask(n))), CHAR_BITS)
    return top.bitwiseOR(chars)


def _order(counts: DataFrame, n: int, lower: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(key, p) of the n-grams of one order, and (key, weight) of their contexts' back-off weights."""
    classes = [F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    stats = counts.groupBy(_lang().alias("lang")).agg(*classes, F.count("*").alias("types"))  # a row for a language
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5))

    def discount(k: int) -> Column:
        share = F.when(F.col(f"n{k}") > 0, F.col(f"n{k + 1}") / F.col(f"n{k}")).otherwise(F.lit(0.0))
        return F.least(F.lit(k - 0.1), F.greatest(F.lit(0.1), k - (k + 1) * y * share))

    stats = stats.select("lang", "types", *[discount(k).alias(f"d{k}") for k in (1, 2, 3)])
    taken = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    # At most 2^LANG_BITS rows.
    grams = counts.withColumns({"lang": _lang(), "context": _context(n)}).join(F.broadcast(stats), "lang")
    grams = grams.withColumn("taken", F.least(taken, F.col("c").cast("double")))
    contexts = grams.groupBy("context").agg(
        (F.sum("taken") / F.sum("c")).alias("weight"), F.sum("c").alias("total"), F.first("types").alias("types")
    )
    grams = grams.select("key", "c", "taken", "context").join(contexts, "context")
    if lower is None:
        below = F.lit(1.0) / (F.col("types") + 1)
    else:
        grams = grams.withColumn("lower", _suffix(n - 1)).join(
            lower.select(F.col("key").alias("lower"), F.col("p").alias("below")), "lower"
        )
        below = F.col("below")
    p = (F.col("c") - F.col("taken")) / F.col("total") + F.col("weight") * below
    base = F.col("weight") if lower is not None else F.col("weight") / (F.col("types") + 1)
    return (
        stored(grams.select("key", p.alias("p")), f"grams{n}"),
        contexts.select(F.col("context").alias("key"), base.alias("p")),
    )


def _slots(keys: np.ndarray) -> np.ndarray:
    return ((keys * _MULTIPLIER) >> U(64 - HASH_BITS)).astype(np.uint32)


def _slot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = _slots(batch.column("key").to_numpy().view(np.uint64)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("part"), pa.array(slots), batch.column("p")], names=["part", "slot", "p"]
        )


def language_model(docs: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The model of ``docs`` (text, lang): for each part, sorted hashes and the log2 of their values.

    Part ``p1`` to ``p4`` has the n-grams' probabilities, ``w1`` to ``w4`` the weights of their contexts; ``w1`` has, for
    each language, the probability of a character it has not seen.
    """
    counts = docs.select("text", "lang").mapInArrow(_count, "key long, c long")
    tables = {ORDER: stored(counts.groupBy("key").agg(F.sum("c").alias("c")), "counts")}
    for n in range(ORDER - 1, 0, -1):
        lower = tables[n + 1].groupBy(_suffix(n).alias("key")).agg(F.count("*").alias("c"))
        tables[n] = stored(lower, f"counts{n}")
    parts, lower = [], None
    for n in range(1, ORDER + 1):
        lower, contexts = _order(tables[n], n, lower)
        parts += [lower.select(F.lit(f"p{n}").alias("part"), "key", "p")]
        parts += [contexts.select(F.lit(f"w{n}").alias("part"), "key", "p")]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    rows = rows.mapInArrow(_slot_rows, "part string, slot int, p double").groupBy("part", "slot").agg(
        F.max(F.log2("p")).cast("float").alias("p")
    )
    table = rows.toArrow()  # at most 2^HASH_BITS rows of a few bytes for each part
    part, slot, p = table.column("part").to_numpy(), table.column("slot").to_numpy(), table.column("p").to_numpy()
    model = {}
    for name in [f"{kind}{n}" for n in range(1, ORDER + 1) for kind in "pw"]:
        at = np.flatnonzero(part == name)
        at = at[np.argsort(slot[at])]
        model[name] = (slot[at].astype(np.uint32), p[at])
    return model


def _find(model: dict, part: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys the part has, and their values (0 where it has none)."""
    slots, values = model[part]
    if not len(slots):
        return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.float32)
    wanted = _slots(keys)
    at = np.minimum(np.searchsorted(slots, wanted), len(slots) - 1)
    hit = slots[at] == wanted
    return hit, np.where(hit, values[at], np.float32(0))


def _log_probabilities(model: dict, keys: np.ndarray) -> np.ndarray:
    """The log2 probability of each event: the longest known n-gram's, with the weights of the longer contexts."""
    out, rest = np.zeros(len(keys), dtype=np.float32), np.arange(len(keys))
    top = U(((1 << LANG_BITS) - 1) << (64 - LANG_BITS))
    for n in range(ORDER, 0, -1):
        own = keys[rest] & (top | U(_mask(n)))
        hit, value = _find(model, f"p{n}", own)
        out[rest[hit]] += value[hit]
        rest, own = rest[~hit], own[~hit]
        if not len(rest):
            break
        # The language stays in its place; the last character goes.
        context = (own & top) | ((own & U(_mask(n))) >> U(CHAR_BITS))
        out[rest] += _find(model, f"w{n}", context)[1]
    return out


@cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, whether it is a letter or digit, and whether its script has no spaces."""
    letter = np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)
    unspaced = np.zeros(0x110000, dtype=bool)
    for start, end in UNSPACED:
        unspaced[start:end] = True
    return letter, unspaced


def _word_lang(lang: str | None) -> int:
    """The languages of words are told apart by 63 bits of a hash; null is one of its own."""
    return 0 if lang is None else int.from_bytes(blake2b(lang.encode(), digest_size=8).digest()) >> 1 | 1


def _words(t: Texts, langs: list[str | None]) -> dict[str, np.ndarray]:
    """The words with a letter or digit: key, language, text, first character, that behind the last, and if unspaced."""
    points, heads = _points(t)
    letter, unspaced = _kinds()

    def some(kind: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(points) + 1, dtype=np.int64)
        np.cumsum(kind[points], out=sums[1:])
        return sums[heads[t.ends]] > sums[heads[t.starts]]

    at = np.flatnonzero(some(letter))
    text = t.text_of_words()[at]
    lang = np.array([_word_lang(x) for x in langs], dtype=np.uint64)[text]
    return {
        "key": mix(t.words()[at] + mix(lang)),
        "lang": lang,
        "text": text,
        "start": heads[t.starts[at]],
        "end": heads[t.ends[at]],
        "unspaced": some(unspaced)[at],
    }


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's words with their counts, each once or, if they are many, a few times."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, langs, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[starts], langs[order][starts], np.add.reduceat(counts[order], starts)

    def rows(keys: np.ndarray, langs: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(langs.view(np.int64)), pa.array(keys.view(np.int64)), pa.array(counts)]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "key", "c"])

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for row, t in texts(batch.column("text")):
            w = _words(t, langs[row : row + t.n])
            spaced = ~w["unspaced"]
            keys, at, counts = np.unique(w["key"][spaced], return_index=True, return_counts=True)
            if len(keys):
                held.append((keys, w["lang"][spaced][at], counts.astype(np.int64)))
            if sum(len(k) for k, _, _ in held) > HELD:
                held[:] = [add()]
                if len(held[0][0]) > HELD // 2:
                    yield rows(*held.pop())
    if held:
        yield rows(*add())


def word_model(docs: DataFrame) -> tuple[dict[int, tuple[float, float]], DataFrame, int]:
    """The words of ``docs`` (text, lang), their number that sets the ranges, and what holds for a whole language.

    For each language: the share of a word counted once, and what the discounts leave for spelling. The table (key, p)
    has the discounted shares of the words counted more often, and their number is returned with it.
    """
    counts = docs.select("text", "lang").mapInArrow(_count_words, "lang long, key long, c long")
    counts = stored(counts.groupBy("lang", "key").agg(F.sum("c").alias("c")), "words")
    classes = [F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    more = F.sum((F.col("c") > 2).cast("long")).alias("more")
    discounts, shares, rest = {}, {}, 0
    for r in counts.groupBy("lang").agg(*classes, more, F.sum("c").alias("total")).collect():  # a row for a language
        n = [r.n1, r.n2, r.n3, r.n4]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [min(k - 0.1, max(0.1, k - (k + 1) * y * (n[k] / n[k - 1] if n[k - 1] else 0.0))) for k in (1, 2, 3)]
        left = (d[0] * r.n1 + d[1] * r.n2 + d[2] * r.more) / r.total
        discounts[r.lang] = (r.lang, float(d[1]), float(d[2]), r.total)
        shares[r.lang] = ((1 - d[0]) / r.total, left)
        rest += r.n2 + r.more
    stats = docs.sparkSession.createDataFrame(list(discounts.values()), "lang long, d2 double, d3 double, total long")
    taken = F.when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    table = counts.where("c > 1").join(F.broadcast(stats), "lang")
    return shares, table.select("key", ((F.col("c") - taken) / F.col("total")).cast("float").alias("p")), rest


def _word_range(table: DataFrame, part: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys that begin with the bits of ``part``, and their shares."""
    if bits:
        table = table.where(F.shiftrightunsigned("key", 64 - bits) == part)
    rows = table.toArrow()  # about TABLE_WORDS rows of 12 bytes
    keys, p = rows.column("key").to_numpy().view(np.uint64), rows.column("p").to_numpy()
    order = np.argsort(keys)
    return keys[order], p[order]


def _word_bits(w: dict, events: np.ndarray, text: np.ndarray, table: tuple, part: int, bits: int) -> np.ndarray:
    """For each word the bits that it takes, 0 if another range of keys has it; ``events`` are those of its spelling."""
    shares, keys, p = table
    sums = np.zeros(len(events) + 1)
    np.cumsum(-events.astype(np.float64), out=sums[1:])
    # A word ends with the character behind it, if its text goes on.
    behind = np.append(text, -1)[np.minimum(w["end"], len(text))] == w["text"]
    spelled = sums[np.where(w["unspaced"], w["end"], w["end"] + behind)] - sums[w["start"]]
    langs, of = np.unique(w["lang"], return_inverse=True)
    once, left = np.array([shares.get(int(x), (0.0, 1.0)) for x in langs], dtype=np.float64).reshape(-1, 2).T
    share = once[of]
    if len(keys):
        at = np.minimum(np.searchsorted(keys, w["key"]), len(keys) - 1)
        share = np.where(keys[at] == w["key"], p[at].astype(np.float64), share)
    # Spelling of a word that takes more bits than a double has adds nothing to the share of the word.
    out = -np.log2(share + left[of] * np.exp2(-np.minimum(spelled, 1000.0)), where=~w["unspaced"], out=spelled.copy())
    mine = (w["key"] >> U(64 - bits) == U(part)) if bits else np.ones(len(out), dtype=bool)
    return np.where(w["unspaced"], spelled if part == 0 else 0.0, np.where(mine, out, 0.0))


def _rules(t: Texts) -> dict[str, np.ndarray]:
    """The counts of the rules for each text."""
    def by_text(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[t.offsets[1:]] - sums[t.offsets[:-1]]

    # Lines: cut at line ends and at the ends of texts.
    cut = np.zeros(len(t.raw) + 1, dtype=bool)
    cut[t.offsets] = True
    breaks = np.flatnonzero(t.raw == 10)
    starts = np.unique(np.concatenate([t.offsets[:-1][np.diff(t.offsets) > 0], breaks + 1]))
    starts = starts[starts < len(t.raw)]
    ends = np.concatenate([starts[1:], [len(t.raw)]]) if len(starts) else starts
    ends = ends - ((ends > starts) & (t.raw[ends - 1] == 10) & ~(cut[ends] & (t.raw[ends - 1] != 10)))
    worded = np.searchsorted(t.starts, ends) > np.searchsorted(t.starts, starts)
    starts, ends = starts[worded], ends[worded]
    line, text = span_hashes(t.raw, starts, ends), np.searchsorted(t.offsets, starts, side="right") - 1
    order = np.lexsort((line, text))
    same = (line[order][1:] == line[order][:-1]) & (text[order][1:] == text[order][:-1])
    dup_lines = np.bincount(text[order][1:][same], minlength=t.n) if len(line) else np.zeros(t.n, dtype=np.int64)

    hashes, text, place = word_grams(t, REPEAT_WINDOW, whole=False)
    order = np.lexsort((hashes, text))
    same = (hashes[order][1:] == hashes[order][:-1]) & (text[order][1:] == text[order][:-1])
    again = np.zeros(len(hashes), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(t.starts) + 1, dtype=np.int64)
    np.add.at(cover, place[again], 1)
    np.add.at(cover, place[again] + REPEAT_WINDOW, -1)
    covered = np.zeros(len(t.starts) + 1, dtype=np.int64)
    np.cumsum(np.cumsum(cover)[:-1] > 0, out=covered[1:])
    return {
        "n_words": t.counts.astype(np.int64),
        "word_chars": by_text(t.inside & ((t.raw & 0xC0) != 0x80)),
        "n_symbols": by_text(_IS_SYMBOL[t.raw]),
        "n_dup_lines": dup_lines.astype(np.int64),
        "n_repeat_words": covered[t.first[1:]] - covered[t.first[:-1]],
    }


RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _bits(t: Texts, langs: list[str | None], model, table, part: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text the bits of its words in a range of keys, and how many events it has."""
    keys, text = _events(t, langs)
    w = _words(t, langs)
    own = _word_bits(w, _log_probabilities(model.value, keys), text, table.value, part, bits)
    sizes = np.where(w["unspaced"], w["end"] - w["start"], 1)
    return np.bincount(w["text"], weights=own, minlength=t.n), np.bincount(w["text"], weights=sizes, minlength=t.n)


def _scores(model, table, bits: int):
    """The rules' counts of each document, its number of events and their bits for the first range of keys."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            found = {name: [] for name in (*RULES, "bits", "events")}
            for row, t in texts(batch.column("text")):
                for name, counts in _rules(t).items():
                    found[name].append(counts)
                own, events = _bits(t, langs[row : row + t.n], model, table, 0, bits)
                found["bits"].append(own)
                found["events"].append(events)
            joined = {k: np.concatenate(v) if v else np.zeros(0) for k, v in found.items()}
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("dk"),
                    batch.column("lang"),
                    *[pa.array(joined[k].astype(np.int64)) for k in RULES],
                    *[pa.array(joined[k].astype(np.float64)) for k in ("bits", "events")],
                ],
                names=["doc_id", "dk", "lang", *RULES, "bits", "events"],
            )

    return rows


def _more_bits(model, table, part: int, bits: int):
    """The bits of each document's words in a further range of keys."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            found = [_bits(t, langs[r : r + t.n], model, table, part, bits)[0] for r, t in texts(batch.column("text"))]
            more = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("dk"), pa.array(more)], names=["dk", "more"])

    return rows


def _scored(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang, dk) as doc_id, dk, lang, the rules' counts and the log2 perplexity, null without
    events."""
    context = docs.sparkSession.sparkContext
    model = context.broadcast(language_model(docs))
    shares, words, n = word_model(docs)
    bits = max(0, math.ceil(math.log2(max(n, 1) / TABLE_WORDS)))
    table = context.broadcast((shares, *_word_range(words, 0, bits)))
    counts = ", ".join(f"{c} long" for c in RULES)
    schema = f"doc_id long, dk long, lang string, {counts}, bits double, events double"
    scores = docs.mapInArrow(_scores(model, table, bits), schema)
    rest = None
    for part in range(1, 1 << bits):
        table = context.broadcast((shares, *_word_range(words, part, bits)))
        more = docs.select("text", "lang", "dk").mapInArrow(_more_bits(model, table, part, bits), "dk long, more double")
        more = stored(more.groupBy("dk").agg(F.max("more").alias("more")), "bits")  # rows that repeat have the same
        table.unpersist()
        rest = more if rest is None else rest.unionByName(more)
    if rest is not None:
        scores = scores.join(rest.groupBy("dk").agg(F.sum("more").alias("more")), "dk")
        scores = scores.withColumn("bits", F.col("bits") + F.col("more"))
    mean = F.when(F.col("events") > 0, F.col("bits") / F.col("events"))
    return scores.select("doc_id", "dk", "lang", *RULES, mean.alias("bits"))


def judged(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, lang): its counts, perplexity, its language's band and the verdict.

    Columns: doc_id, dk (hash of id, text and language), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, perplexity, lowest, highest, kept. Null and empty texts have no words, no perplexity and fail. A null
    language is a language. Texts that have words but none with a letter or digit have no perplexity and fail. Rows that
    repeat are judged alike; an empty table gives no rows; other columns are not read.
    """
    docs = docs.select("doc_id", "text", "lang", F.xxhash64("doc_id", "text", "lang").alias("dk"))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    scores = stored(_scored(docs).withColumn("base_failed", failed), "scores")
    name = F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("n")).alias("name")
    passed = scores.where(~F.col("base_failed") & F.col("bits").isNotNull()).select(name, "bits")
    middle = passed.groupBy("name").agg(F.percentile_approx("bits", 0.5, 10_000).alias("middle"))
    middle = stored(middle, "middle")
    # Languages, however many, are joined by their names; Spark broadcasts them while they are few.
    away = passed.join(middle, "name").groupBy("name").agg(
        F.percentile_approx(F.abs(F.col("bits") - F.col("middle")), 0.5, 10_000).alias("away")
    )
    bands = middle.join(away, "name").select(
        "name",
        (F.col("middle") - F.greatest(F.lit(LEAST_BELOW), BELOW * F.col("away"))).alias("low"),
        (F.col("middle") + F.greatest(F.lit(LEAST_ABOVE), ABOVE * F.col("away"))).alias("high"),
    )
    rows = scores.withColumn("name", name).join(stored(bands, "bands"), "name", "left")
    inside = F.col("bits").between(F.col("low"), F.col("high"))
    return rows.select(
        "doc_id",
        "dk",
        *RULES,
        "base_failed",
        F.pow(F.lit(2.0), "bits").alias("perplexity"),
        F.pow(F.lit(2.0), "low").alias("lowest"),
        F.pow(F.lit(2.0), "high").alias("highest"),
        (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``judged`` rejects. All columns are passed on, whatever their names."""
    bad = judged(docs).where(~F.col("kept")).select("dk").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("dk", F.xxhash64("row.doc_id", "row.text", "row.lang"))
    return rows.join(bad, "dk", "left_anti").select("row.*")
