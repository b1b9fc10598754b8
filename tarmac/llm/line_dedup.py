"""Operator 7: exact set-similarity join of text lines by rarity prefixes; later matches are removed.

A line is the set of its words. Two lines match when their Jaccard similarity is at least 0.8. A line with a word goes
if an earlier line, by (doc_id, text's hash, line number), matches it, whether or not that one goes too.

1. Lines of equal sets make one class, reduced before the shuffle to its earliest line.
2. Words are ordered by rarity: their count over all texts in a table of fixed length, then their hash. Words that share
   a place in the table share a count, which changes the order but nothing in the result: prefix filtering is exact for
   any order of all words.
3. Classes that share the least word in one of a few random orders, if more than a few, are held against the earliest of
   them first. In a
   large group of near copies nearly every line is settled so, and only pairs with an unsettled line, which a settled one of a later document
   cannot change, are looked for afterwards.
4. Two sets of n and m words that match share at least a = ceil(0.8 / 1.8 * (n + m)) words, and so have a first common
   word at place n - a or before in the one and m - a or before in the other. The smaller set's place is then among
   its first n - ceil(8 / 9 n) + 1 words, so the smaller one meets with these only. Pairs that meet on a word are kept if
   their lengths and both places allow that, and if at most n + m - 2a bits differ between parity bitmaps of the sets.
   64 bits tell nothing about sets of a hundred words, which differ in half of them whatever they hold, so that of long
   lines is kept in two parts, each of 64 bits for its own half of the words.
5. Pairs that remain are verified on their whole sets, read again from the documents.

Sets are compared by 56-bit hashes of their words.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.tables import fixed_table, look_up, place
from tarmac.llm.text import SPACE, SPACES, words
from tarmac.sources.work import stored

# Places of the table of word counts, and of the table that marks lines to be read again.
COUNT_BITS = 20
MARK_BITS = 21
# Jaccard similarity as a fraction.
PART, WHOLE = 4, 5
SHARE, SIZES = PART, PART + WHOLE
# The bitmap of a line of more words than this is in two parts.
TWO_PARTS = 128
# Classes that share the word of an order are held against the earliest of them if there are more than this.
FEW = 8
BITS = ("bits", "half")


def _split(text: Column, plain: Column) -> Column:
    """The words of ``text`` and empty strings between them.

    ``plain`` is the text with blanks for line feeds. Without rarer white space it is split at blanks, which needs no
    regular expression.
    """
    rare = reduce(Column.__or__, [F.contains(text, F.lit(space)) for space in SPACES if space not in " \n"])
    return F.when(rare, F.split(text, SPACE, -1)).otherwise(F.split(plain, " ", -1))


def _lines(docs: DataFrame) -> DataFrame:
    """Lines with a word: pos (doc_id, dk, line), the distinct hashes of their words, and the least and greatest of
    these, hashed."""
    split = docs.select("doc_id", "dk", F.posexplode(F.split("text", "\n", -1)).alias("line", "value"))
    hashes = F.transform(_split(F.col("value"), F.col("value")), lambda w: F.xxhash64(w))
    lines = split.where(F.btrim("value", F.lit(SPACES)) != "").select(
        F.struct("doc_id", "dk", "line").alias("pos"),
        F.array_remove(F.array_distinct(hashes), F.xxhash64(F.lit(""))).alias("tokens"),
    )
    return lines.select(
        "pos", "tokens", F.hash(F.array_min("tokens")).alias("least"), F.hash(F.array_max("tokens")).alias("most")
    )


def _code(n: Column) -> Column:
    """Count as a byte: 1 for a word that occurs once, else four steps for each doubling."""
    return F.when(n <= 1, 1).otherwise(F.least(F.lit(127), F.floor(F.log2(n.cast("double")) * 4) - 2))


def _enough(common: Column, n: Column, m: Column) -> Column:
    """Whether sets of ``n`` and ``m`` words with ``common`` words in common match, or could with at most so many."""
    return SIZES * common >= SHARE * (n + m)


def _could_match(a: str, b: str) -> Column:
    """The length and bitmap filters for two classes in columns with the prefixes ``a`` and ``b``."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    bits, half = (F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}")) for c in BITS)
    # The half counts if both have it; the bitmap of all words without it is that of the others.
    half = F.coalesce(half, F.lit(0).cast("long"))
    differ = F.bit_count(bits.bitwiseXOR(half)) + F.bit_count(half)
    return (
        # Sets with c words in common differ in n + m - 2 c words.
        (WHOLE * F.least(n, m) >= PART * F.greatest(n, m)) & (SIZES * differ <= (SIZES - 2 * SHARE) * (n + m)) & (
            F.col(f"{a}id") != F.col(f"{b}id")
        )
    )


def _parity(keys: Column) -> Column:
    """A bitmap of 64 places: set where an odd number of the keys falls. A shift takes the last six bits of a key."""
    return F.aggregate(
        keys,
        F.lit(0).cast("long"),
        lambda bits, k: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)),
    )


def _classes(docs: DataFrame) -> DataFrame:
    """One row for each set of words: id, pos of the earliest line, n, bits, half, lows, skip and prefix.

    ``bits`` is the bitmap of all words, ``half`` that of the words of one half by hash; null for lines of few words.

    ``lows`` holds the least word of four random orders: least and greatest by two hashes. ``prefix`` holds the rarest n - ceil(0.8 n) + 1 words but for the first ``skip``, which no other line has.
    """
    lines = _lines(docs)
    plain = F.replace("text", F.lit("\n"), F.lit(" "))
    word = docs.select(F.explode(_split(F.col("text"), plain)).alias("w")).where("w != ''")
    word = word.select(F.xxhash64("w").alias("t"))
    counts = word.groupBy(place(F.col("t"), COUNT_BITS).alias("bucket"))
    table = fixed_table(counts.agg(_code(F.count("*")).alias("code")), COUNT_BITS)
    # A column of its own first: a subquery may not be written inside a lambda. The optimizer moves it there, so that
    # the table is not copied into any row; it would not if ``tokens`` were used twice in the same step. Without nulls,
    # the array is sorted as one of plain numbers.
    code = lambda t: F.coalesce(look_up(F.col("codes"), t, COUNT_BITS), F.lit(0).cast("byte"))
    rarity = F.transform(
        "tokens", lambda t: F.shiftleft(code(t).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(t, 8))
    )
    ordered = lines.withColumn("codes", table.scalar()).select(
        "pos", F.sort_array(rarity).alias("keys"), "least", "most"
    )
    n = F.size("keys")
    length = n - F.ceil(PART * n / F.lit(WHOLE)).cast("int") + 1
    rows = ordered.select(
        "pos",
        n.alias("n"),
        F.xxhash64("keys").alias("sig"),
        F.size(F.filter(F.slice("keys", F.lit(1), length), lambda k: F.shiftrightunsigned(k, 56) == 1)).alias("skip"),
        length.alias("length"),
        F.transform("keys", lambda k: F.hash(k)).alias("short"),
        "least",
        "most",
    )
    rows = rows.select(
        "pos", "n", "sig", "skip",
        _parity(F.col("short")).alias("bits"),
        F.when(F.col("n") > TWO_PARTS, _parity(F.filter("short", lambda k: k.bitwiseAND(F.lit(64)) != 0))).alias("half"),
        F.array("least", "most", F.array_min("short"), F.array_max("short")).alias("lows"),
        F.slice("short", F.col("skip") + 1, F.greatest(F.col("length") - F.col("skip"), F.lit(0))).alias("prefix"),
    )
    classes = rows.groupBy("sig").agg(
        F.min("pos").alias("pos"), *[F.first(c).alias(c) for c in ("n", "lows", *BITS, "skip", "prefix")]
    )
    return stored(classes.drop("sig").withColumn("id", F.monotonically_increasing_id()), "classes")


def _n() -> Column:
    return F.shiftright("packed", 32)


def _i() -> Column:
    return F.shiftright(F.col("packed").bitwiseAND(F.lit(2**32 - 1)), 1)


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (x, y) of class ids that match, as the id of the later one.

    The words of the classes in question are read again from their earliest lines. A table of fixed length marks these
    lines, so that few others are tokenised and sent.
    """
    asked = pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    asked = stored(asked.join(classes.select("id", "pos"), "id").withColumn("at", F.xxhash64("pos")), "asked")
    # Marks are bits of 64 to a number.
    high, bit = F.shiftrightunsigned("at", 6), F.call_function("shiftleft", F.lit(1).cast("long"), place(F.col("at"), 6).cast("int"))
    # The documents of these lines are marked as well, so that no other one is split.
    marks = asked.select("at").unionByName(asked.select(F.col("pos.dk").alias("at")))
    marks = marks.groupBy(place(high, MARK_BITS - 6).alias("bucket")).agg(F.bit_or(bit).alias("code"))
    marks = fixed_table(marks, MARK_BITS - 6, "long")
    marked = look_up(marks.scalar(), high, MARK_BITS - 6).bitwiseAND(bit) != 0
    lines = docs.withColumn("at", F.col("dk")).where(marked).drop("at")
    lines = lines.select("doc_id", "dk", F.posexplode(F.split("text", "\n", -1)).alias("line", "value"))
    lines = lines.select(F.xxhash64(F.struct("doc_id", "dk", "line")).alias("at"), "value").where(marked)
    tokens = F.array_distinct(F.transform(words(F.col("value")), lambda w: F.shiftrightunsigned(F.xxhash64(w), 8)))
    found = asked.join(lines, "at").select("id", "pos", tokens.alias("tokens")).dropDuplicates(["id"])
    found = stored(found, "found")
    both = pairs.join(found.select(F.col("id").alias("x"), F.col("pos").alias("x_pos"), F.col("tokens").alias("xt")), "x")
    both = both.join(found.select(F.col("id").alias("y"), F.col("pos").alias("y_pos"), F.col("tokens").alias("yt")), "y")
    common = F.size(F.array_intersect("xt", "yt"))
    # 5 c >= 4 (n + m - c), with the intersection computed once.
    match = _enough(common, F.size("xt"), F.size("yt"))
    later = F.when(F.col("x_pos") < F.col("y_pos"), F.col("y")).otherwise(F.col("x"))
    return both.where(match).select(later.alias("id")).distinct()


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and dk, a hash of both that stands for the document."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("dk"))


def kept_lines(docs: DataFrame) -> DataFrame:
    """For each document with a word line that stays: dk and ``kept``, the sorted numbers (from 0) of these lines.

    ``docs`` needs doc_id and text. Rows with the same doc_id and text are one document: their lines stay or go
    together. Null ids come first in the order. Null and empty texts have no line with a word.
    """
    docs = _keyed(docs)
    classes = _classes(docs)
    members = classes.select(
        "id", "n", *BITS, F.struct("pos.doc_id", "pos.line").alias("place"), F.posexplode("lows").alias("turn", "low")
    )
    # One number for word and order: sorted by itself, without comparing columns.
    members = members.withColumn("meet", F.col("low").cast("long") * 4 + F.col("turn")).drop("turn", "low")
    crowds = stored(members.groupBy("meet").agg(F.count("*").alias("size")).where(F.col("size") > FEW), "crowds")
    members = members.join(crowds, "meet", "left_semi")
    lead = F.min_by(F.struct("id", "n", *BITS), "place").over(Window.partitionBy("meet"))
    first = members.select(*[F.col(c).alias(f"x_{c}") for c in ("id", "n", *BITS)], lead.alias("lead"))
    first = first.select("*", *[F.col(f"lead.{c}").alias(f"y_{c}") for c in ("id", "n", *BITS)])
    first = first.where(_could_match("x_", "y_"))
    first = stored(first.select(F.col("x_id").alias("x"), F.col("y_id").alias("y")).distinct(), "first")
    settled = stored(_verified(first, classes, docs), "settled")

    flagged = classes.join(settled.withColumn("settled", F.lit(True)), "id", "left")
    # Words in the set, place and whether the line is open share a column: this is the widest exchange.
    open_, place = F.col("settled").isNull().cast("long"), (F.col("i") + F.col("skip")).cast("long")
    words_of = flagged.select("id", *BITS, "n", "skip", "settled", "pos.doc_id", F.posexplode("prefix").alias("i", "word"))
    packed = F.col("n").cast("long") * 2**32 + place * 2 + open_
    # Nothing but doc_id and half can be null: a filter for nulls would be put below one side's exchange only.
    words_of = words_of.select(
        F.coalesce("word", F.lit(0)).alias("word"),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(n) for n, c in (("id", "id"), ("bits", "bits"), ("packed", packed))],
        "half",
        "doc_id",
    )
    dealt = words_of.repartition("word")
    side = ("id", *BITS, "doc_id")
    left, right = (
        dealt.select(
            "word",
            *[F.col(c).alias(f"{s}{c}") for c in side],
            _n().alias(f"{s}n"),
            _i().alias(f"{s}i"),
            (F.col("packed").bitwiseAND(F.lit(1)) == 1).alias(f"{s}open"),
        )
        for s in ("x_", "y_")
    )
    # The smaller set of a pair meets the larger one within the first n - ceil(8 / 9 n) + 1 words of its own.
    # Not pushed below the exchange, which both sides share: a filter that is not deterministic stays where it is.
    rest = {s: F.col(f"{s}n") - F.col(f"{s}i") for s in ("x_", "y_")}
    near = _enough(rest["y_"], F.col("y_n"), F.col("y_n"))
    right = right.where(near | (F.spark_partition_id() < 0))
    met = left.hint("merge").join(
        right,
        (left["word"] == right["word"])
        # Two lines meet once, the larger one on the left.
        & ((F.col("y_n") < F.col("x_n")) | ((F.col("y_n") == F.col("x_n")) & (F.col("y_id") < F.col("x_id"))))
        & _enough(rest["x_"], F.col("x_n"), F.col("y_n"))
        & _enough(rest["y_"], F.col("x_n"), F.col("y_n"))
        & _could_match("x_", "y_")
        # A settled line matters to an open one only if it is earlier.
        & (F.col("x_open") | F.col("y_open"))
        & (F.col("y_open") | F.coalesce(F.col("y_doc_id") <= F.col("x_doc_id"), F.lit(True)))
        & (F.col("x_open") | F.coalesce(F.col("x_doc_id") <= F.col("y_doc_id"), F.lit(True))),
    )
    pairs = stored(met.select(F.col("x_id").alias("x"), F.col("y_id").alias("y")).distinct(), "pairs")
    gone = settled.unionByName(_verified(pairs, classes, docs)).distinct()
    stay = classes.join(gone, "id", "left_anti")
    return stay.groupBy(F.col("pos.dk").alias("dk")).agg(
        F.sort_array(F.collect_list("pos.line")).alias("kept")
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines that match an earlier line taken out of ``text``; ``n_chars``, if there, follows.

    Lines without a word stay, and so does every row, be its text empty afterwards. Null texts stay null. Columns other
    than these are passed on, whatever their names.
    """
    kept = kept_lines(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("dk", F.xxhash64("row.doc_id", "row.text"))
    joined = rows.join(kept, "dk", "left").withColumn("lines", F.split("row.text", "\n", -1))
    gap = lambda k, i: k - F.when(i > 0, F.element_at("kept", F.greatest(i, F.lit(1)))).otherwise(-1) - 1
    marks = F.array_join(
        F.transform("kept", lambda k, i: F.concat(F.call_function("repeat", F.lit("0"), gap(k, i)), F.lit("1"))), ""
    )
    marked = joined.withColumn("marks", F.coalesce(marks, F.lit("")).cast("binary"))
    one = F.lit("1").cast("binary")
    stays = F.filter(
        "lines",
        lambda line, i: (F.btrim(line, F.lit(SPACES)) == "")
        | (F.call_function("substring", F.col("marks"), i + 1, F.lit(1)) == one),
    )
    text = F.when(F.col("row.text").isNotNull(), F.array_join(stays, "\n"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return marked.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])
