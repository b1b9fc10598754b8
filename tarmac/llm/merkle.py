"""Operator 12: a Merkle manifest of a dataset, and versions of it by copying the path of a changed leaf.

Every source has a tree over its documents and one tree stands over the sources. A tree is built in tiers: blocks of
3^``depth`` consecutive nodes are aligned, so each block is a whole subtree of ``depth`` levels, which one row
holds and one task computes; the blocks' top nodes are the nodes of the next tier, until a tree has a single block. A
block holds at most that many nodes, however many documents a source has.

The tree is persistent: a changed leaf makes a version that copies its ancestors and shares all other nodes. Inside a
block the copies are made from the block's own levels. Above it a version goes on over the nodes next to its path, which
are the same for all leaves of the block, so the block's path comes down once and serves all of its versions.

Digests travel as 32 bytes; what is hashed are their hexadecimal texts.
"""

from binascii import hexlify, unhexlify
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.plans.running import running
from tarmac.sources.work import stored

ARITY = 3
DEPTH = 5

# A path: for each level a byte (siblings on the left, times ARITY, plus siblings on the right) and the siblings.
Level = list[bytes]


def digest(parts: list[bytes]) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


def levels_of(nodes: Level, n: int, depth: int) -> list[Level]:
    """A block's levels from its nodes up, in a tree of ``n``: ``depth`` of them if it goes on, else until one remains."""
    levels = [nodes]
    while len(levels) <= depth if n > ARITY**depth else len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return levels


def version(levels: list[Level], place: int, leaf: bytes) -> list[bytes]:
    """The nodes of a version in which ``leaf`` stands at ``place``: the copied path; all others are those of ``levels``."""
    path = [leaf]
    for level in levels[:-1]:
        start = place - place % ARITY
        run = level[start : start + ARITY]
        run[place - start] = path[-1]
        path.append(digest(run))
        place //= ARITY
    return path


def siblings(levels: list[Level], place: int) -> Iterator[tuple[Level, Level]]:
    """The nodes left and right of a place's path in their runs, from the leaves up."""
    for level in levels[:-1]:
        start = place - place % ARITY
        yield level[start:place], level[place + 1 : start + ARITY]
        place //= ARITY


def packed(path: Iterator[tuple[Level, Level]]) -> bytes:
    return b"".join(bytes([ARITY * len(a) + len(b)]) + unhexlify(b"".join([*a, *b])) for a, b in path)


def unpacked(path: bytes) -> list[tuple[Level, Level]]:
    levels, at = [], 0
    while at < len(path):
        left, right = divmod(path[at], ARITY)
        nodes = [hexlify(path[k : k + 32]) for k in range(at + 1, at + 1 + 32 * (left + right), 32)]
        levels.append((nodes[:left], nodes[left:]))
        at += 1 + 32 * (left + right)
    return levels


def _digests(column: pa.Array) -> list[Level]:
    return [[hexlify(x) for x in row] for row in column.to_pylist()]


def _tops(depth: int):
    """Blocks with their top nodes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_pylist()
            tops = [levels_of(d, x, depth)[-1][0] for d, x in zip(_digests(batch.column("digests")), n, strict=True)]
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([unhexlify(x) for x in tops], pa.binary())], names=[*names, "top"]
            )

    return rows


def _blocks(nodes: DataFrame, depth: int, *payload: str) -> DataFrame:
    """The blocks of nodes (tree, n, place, digest and ``payload``), n being the number of the tree's nodes.

    One row for a block: tree, block, n, digests, a list for each payload column, top.
    """
    columns = ["digest", *payload]
    members = F.sort_array(F.collect_list(F.struct("place", *columns)))
    block = F.floor(F.col("place") / ARITY**depth)
    grouped = nodes.groupBy("tree", block.alias("block")).agg(F.first("n").alias("n"), members.alias("members"))
    rows = grouped.select("tree", "block", "n", *[F.col("members")[c].alias(f"{c}s") for c in columns])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return stored(rows.mapInArrow(_tops(depth), f"{schema}, top binary"), "blocks")


def _down(depth: int):
    """The nodes of upper blocks with their paths to the top of the tree."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees, blocks, paths = [], [], []
            n, above, peaks = (batch.column(c).to_pylist() for c in ("n", "above", "peak"))
            for i, nodes in enumerate(_digests(batch.column("digests"))):
                levels = levels_of(nodes, n[i], depth)
                first = batch.column("block")[i].as_py() * ARITY**depth
                for place in range(len(nodes)):
                    trees.append(i)
                    blocks.append(first + place)
                    paths.append(packed(siblings(levels, place)) + above[i])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("tree").take(pa.array(trees, pa.int64())),
                    pa.array(blocks, pa.int64()),
                    pa.array(paths, pa.binary()),
                    pa.array([peaks[i] for i in trees], pa.binary()),
                ],
                names=["tree", "block", "above", "peak"],
            )

    return rows


def _climb(blocks: DataFrame, depth: int) -> DataFrame:
    """(tree, block, above, peak) for each block: the path from its top node to that of its tree, and the latter."""
    span = ARITY**depth
    alone = blocks.where(F.col("n") <= span)
    alone = alone.select("tree", "block", F.lit(b"").alias("above"), F.col("top").alias("peak"))
    higher = blocks.where(F.col("n") > span)
    if higher.isEmpty():
        return alone
    n = F.ceil(F.col("n") / span).alias("n")
    upper = _blocks(higher.select("tree", n, F.col("block").alias("place"), F.col("top").alias("digest")), depth)
    down = upper.join(_climb(upper, depth), ["tree", "block"]).select("tree", "block", "n", "digests", "above", "peak")
    return alone.unionByName(down.mapInArrow(_down(depth), "tree string, block long, above binary, peak binary"))


def _placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with tree as nodes: place inside the tree by ``order``, and n."""
    counted = running(rows.withColumn("one", F.lit(1).cast("long")), [F.col("tree"), *order], {"place": "one"})
    counted = stored(counted, "places")
    trees = counted.groupBy("tree").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    return counted.join(stored(trees, "trees"), "tree").withColumn("place", F.col("place") - F.col("first")).drop("first")


def _proofs(depth: int):
    """The documents of blocks with their digests, proofs and what their versions fold to."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, leaves, proofs, folded = [], [], [], []
            columns = ("n", "changeds", "above", "rest")
            for i, (nodes, n, changed, *paths) in enumerate(
                zip(_digests(batch.column("digests")), *(batch.column(c).to_pylist() for c in columns), strict=True)
            ):
                levels = levels_of(nodes, n, depth)
                upper = [level for path in paths for level in unpacked(path)]
                tail = b"".join(x for left, right in upper for x in [*left, *right])
                for place, leaf in enumerate(nodes):
                    own = b"".join(x for left, right in siblings(levels, place) for x in [*left, *right])
                    node = version(levels, place, leaf if changed[place] is None else hexlify(changed[place]))[-1]
                    for left, right in upper:
                        node = digest([*left, node, *right])
                    rows.append(i)
                    leaves.append(leaf.decode())
                    proofs.append(sha256(own + tail).hexdigest())
                    folded.append(node.decode())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("ids").flatten(),
                    pa.array(leaves, pa.string()),
                    batch.column("subroot").take(at),
                    batch.column("root").take(at),
                    pa.array(proofs, pa.string()),
                    pa.array(folded, pa.string()),
                ],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"],
            )

    return rows


def _rest(depth: int):
    """The sources with their paths to the root, and the root."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, roots = [], []
            n, above, peaks = (batch.column(c).to_pylist() for c in ("n", "above", "peak"))
            for i, nodes in enumerate(_digests(batch.column("digests"))):
                levels = levels_of(nodes, n[i], depth)
                paths += [packed(siblings(levels, place)) + above[i] for place in range(len(nodes))]
                roots += [hexlify(peaks[i]).decode()] * len(nodes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("sources").flatten(), pa.array(paths, pa.binary()), pa.array(roots, pa.string())],
                names=["tree", "rest", "root"],
            )

    return rows


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """The digest of a document (doc_id, source, lang, n_chars) with this text."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    return F.unhex(F.sha2(F.concat(*map(_field, [*fields, text])), 256))


def manifest(docs: DataFrame, text_now: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, lang, source, n_chars): its digests in the tree of all rows.

    doc_id, leaf, subroot (of its source), root, proof_sha256 (of the siblings from the leaf to the root), folded_root (the
    root of the version in which the row has the text ``text_now``, by default its own, and all others have theirs).

    Leaves follow each other by doc_id, null first, rows of one id by their digests, so rows that repeat stand side by
    side; sources by the bytes of their names, null first. A null field is told from an empty one. An empty table gives
    no rows. Texts are hashed whole; other columns are not read. A block has ``depth`` levels.
    """
    now = F.col("text") if text_now is None else text_now
    leaves = docs.select(
        F.col("doc_id").alias("id"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree"),
        leaf(F.col("text")).alias("digest"),
        F.when(~now.eqNullSafe(F.col("text")), leaf(now)).alias("changed"),
    )
    blocks = _blocks(_placed(leaves, [F.col("id").asc_nulls_first(), F.col("digest")]), depth, "id", "changed")
    climbed = stored(_climb(blocks, depth), "paths")
    sources = climbed.where("block = 0").select(F.col("tree").alias("source"), F.col("peak").alias("digest"))
    sources = sources.withColumn("tree", F.lit(""))
    tops = _blocks(_placed(sources, [F.col("source")]), depth, "source")
    over = tops.join(_climb(tops, depth), ["tree", "block"]).select("block", "n", "digests", "above", "peak", F.col("sources"))
    over = over.mapInArrow(_rest(depth), "tree string, rest binary, root string")
    rows = blocks.drop("top").join(climbed, ["tree", "block"]).join(stored(over, "rest"), "tree")
    rows = rows.withColumn("subroot", F.lower(F.hex("peak"))).drop("tree", "block", "peak")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = "leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    return rows.mapInArrow(_proofs(depth), f"doc_id {kind}, {names}")
