"""A Merkle manifest of a table: leaves, roots by language, one root of all, and each row's proof.

A node is the lower-case hex sha256 of the concatenated hex texts of two consecutive nodes, or of one that is left
over. Rows are numbered within their language, and every aligned block of ``2**BLOCK_BITS`` of them keeps a level as
one hex string: fixed-width substrings of it are hashed to the level above, and the substring that flanks a node is
its sibling. What remains of the blocks, one digest each, is cut into blocks again, until each language has one; the
digests of the languages go the same way. All of it is DataFrame functions. A group holds one block at most, so that a
language with any share of the rows is spread over tasks, and a tier has a 1024th of the rows of the one below.

Defined results: a null column is ``-`` in its leaf and any other value is its length in UTF-8 bytes, a colon and the
value, so that no two rows of different values give the same text; a null language is a language of its own and comes
first; a null doc_id comes first within its language; rows with the same doc_id are ordered by their leaves, and equal
rows share a leaf and take consecutive places in any order; texts are hashed whole, however long; an empty table has
an empty manifest; further columns are not read. A null n_chars can't be tampered with; no doc_id is divisible by 7
if it is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import gapless, materialise

#: Leaves of an aligned block: 2 to this power.
BLOCK_BITS = 10
#: Hex digits of a digest.
WIDTH = 64


def leaf(*values: Column) -> Column:
    """The digest of a row's values."""
    one = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*[one(v.cast("string")) for v in values]), 256)


def _last(items: Column) -> Column:
    return F.element_at(items, -1)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _above(level: Column) -> Column:
    """The level over a level, both hex text as bytes."""
    pairs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / (2 * WIDTH)).cast("int"))
    return F.array_join(F.transform(pairs, lambda j: F.sha2(F.substring(level, j * (2 * WIDTH) + 1, F.lit(2 * WIDTH)), 256)), "").cast("binary")


def _levels(nodes: Column, alone: Column, bits: int) -> Column:
    """All levels of a block from its nodes up. A block that is alone ends where one node is left, any other after ``bits`` levels."""
    start = F.array(F.array_join(nodes, "").cast("binary"))
    more = lambda all_, _: F.when(alone & (F.length(_last(all_)) <= WIDTH), all_).otherwise(F.concat(all_, F.array(_above(_last(all_)))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(bits)), start, more)


def _siblings(levels: Column, place: Column) -> Column:
    """The siblings of the node at a place, from its level to the last but one; empty texts where there is none."""
    beside = lambda level, i: F.substring(level, F.call_function("shiftright", place, i).bitwiseXOR(F.lit(1)) * WIDTH + 1, F.lit(WIDTH)).cast("string")
    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), beside)


def fold(digest: Column, place: Column, siblings: Column) -> Column:
    """The digest that remains when the node at a place is hashed with its siblings, level by level."""
    def up(at: Column, sibling: Column) -> Column:
        pair = F.when(at["place"] % 2 == 0, F.concat(at["digest"], sibling)).otherwise(F.concat(sibling, at["digest"]))
        return F.struct(F.sha2(pair, 256).alias("digest"), F.shiftright(at["place"], 1).alias("place"))

    return F.aggregate(siblings, F.struct(digest.alias("digest"), place.cast("long").alias("place")), up, lambda at: at["digest"])


def build(nodes: DataFrame, bits: int = BLOCK_BITS) -> list[DataFrame]:
    """The tiers of blocks, written: (tree, block, nodes, size, digest), from the nodes (tree, place, digest, kept) up.

    Places run from 0 without gaps in each tree; ``kept`` is any column that stays with a node. In the last tier, each
    tree is one block, whose digest is its root.
    """
    tiers: list[DataFrame] = []
    while True:
        sizes = nodes.groupBy("tree").agg(F.count("*").alias("size"))
        blocks = nodes.groupBy("tree", F.shiftright("place", bits).alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "digest", "kept"))).alias("nodes"))
        tier = blocks.join(sizes, "tree").withColumn("digest", _last(_block_levels(bits)).cast("string"))
        tiers.append(tier := materialise(tier, "merkle"))
        if (tier.agg(F.max("size")).head()[0] or 0) <= 1 << bits:
            return tiers
        nodes = tier.select("tree", F.col("block").alias("place"), "digest", F.lit(None).cast("int").alias("kept"))


def _block_levels(bits: int) -> Column:
    return _levels(F.transform("nodes", lambda n: n["digest"]), F.col("size") <= 1 << bits, bits)


def descend(tiers: list[DataFrame], above: DataFrame | None = None, bits: int = BLOCK_BITS) -> DataFrame:
    """(tree, place, digest, kept, siblings, root, above) of the lowest nodes of ``build``.

    ``above`` has a column of that name for each tree. It and the siblings are handed down from blocks to their nodes,
    block by block, so that no join is by tree alone but that of one row for each tree.
    """
    top = tiers[-1].select("tree", "block", F.array().cast("array<string>").alias("path"), F.col("digest").alias("root"))
    paths = top.withColumn("above", F.lit(None).cast("int")) if above is None else top.join(above, "tree")

    def each(levels: Column) -> Column:
        siblings = lambda n: F.concat(_siblings(levels, (n["place"] % (1 << bits)).cast("int")), F.col("path"))
        return F.transform("nodes", lambda n: F.struct(n["place"].alias("place"), n["digest"].alias("digest"), n["kept"].alias("kept"), siblings(n).alias("siblings")))

    for tier in reversed(tiers):
        blocks = tier.drop("digest").join(paths, ["tree", "block"])
        found = blocks.select("tree", "root", "above", F.explode(_let(_block_levels(bits), each)).alias("n"))
        out = found.select("tree", "n.place", "n.digest", "n.kept", "n.siblings", "root", "above")
        paths = out.select("tree", F.col("place").alias("block"), F.col("siblings").alias("path"), "root", "above")
    return out


def in_order(rows: DataFrame, by: list[str], tag: str) -> DataFrame:
    """``rows`` with a place from 0 without gaps in each ``tree``, ascending by columns; equal rows in any order."""
    alike = F.monotonically_increasing_id()  # rows that are equal otherwise may still part
    dealt = rows.withColumn("alike", alike).repartitionByRange("tree", *by, "alike").sortWithinPartitions("tree", *by)
    return gapless(materialise(dealt.drop("alike").withColumn("rid", F.monotonically_increasing_id()), tag), "tree", "place")


def manifest(docs: DataFrame, columns: list[str], group: str = "lang", key: str = "doc_id", kept: Column | None = None, bits: int = BLOCK_BITS) -> DataFrame:
    """A row for each of ``docs``: (key, leaf, place, siblings, subroot, tree_place, tree_siblings, root, kept).

    ``columns`` are what a leaf covers. ``siblings`` lead from a leaf to its group's root, ``tree_siblings`` on to the
    root of all; ``fold`` follows them. ``kept`` is a column of ``docs`` that stays with its row.
    """
    tree = F.coalesce(F.concat(F.lit("="), docs[group].cast("string")), F.lit(""))  # null before all, then by bytes
    stays = F.lit(None).cast("int") if kept is None else kept
    rows = docs.select(tree.alias("tree"), docs[key].alias("key"), leaf(*[docs[c] for c in columns]).alias("digest"), stays.alias("stays"))
    leaves = in_order(rows, ["key", "digest"], "leaves").select("tree", "place", "digest", F.struct("key", "stays").alias("kept"))
    tiers = build(leaves, bits)
    tops = in_order(tiers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("kept"), "digest"), ["kept"], "roots")
    over = descend(build(tops.select("tree", "place", "digest", "kept"), bits), bits=bits)
    above = over.select(F.col("kept").alias("tree"), F.struct("place", "siblings", "root").alias("above"))
    found = descend(tiers, above, bits)
    return found.select(F.col("kept.key").alias("key"), F.col("digest").alias("leaf"), "place", "siblings", F.col("root").alias("subroot"), F.col("above.place").alias("tree_place"), F.col("above.siblings").alias("tree_siblings"), F.col("above.root").alias("root"), F.col("kept.stays").alias("kept"))


def proof(rows: DataFrame) -> Column:
    """The digest of all siblings of a row of ``manifest``, in order."""
    return F.sha2(F.array_join(F.concat(rows["siblings"], rows["tree_siblings"]), ""), 256)


def folded(rows: DataFrame, digest: Column) -> Column:
    """The root of all that follows if a row of ``manifest`` has this digest for its leaf."""
    return fold(fold(digest, rows["place"], rows["siblings"]), rows["tree_place"], rows["tree_siblings"])


def audit(docs: DataFrame, columns: list[str], group: str = "lang", key: str = "doc_id", altered: Column | None = None, bits: int = BLOCK_BITS) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified): every row held against the manifest of ``docs``.

    ``altered`` is the leaf that a row is found with now, null where it is as it was.
    """
    rows = manifest(docs, columns, group, key, altered, bits)
    found = rows.select("key", "leaf", "subroot", "root", proof(rows).alias("proof_sha256"), folded(rows, F.coalesce(rows["kept"].cast("string"), rows["leaf"])).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
