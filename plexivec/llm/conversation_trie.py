"""The prefix trie of conversations, and sums over its subtrees by heavy-path decomposition.

A node is a distinct sequence of first turns.  Its key is the exclusive or of one pair of hashes for each turn,
which depend on the turn's place, so keys of all prefixes are a running aggregate over a conversation.  Every
node's child with the most conversations is heavy; a walk down from the root leaves heavy edges at most log2 of
the conversations times, as each time at least half of them stay behind.  A path of heavy edges ends in a childless
node and is the lower part of one conversation's walk, so paths are found by an aggregate over walks.  Paths are
then summed from their lower end, level by level from the deepest one: a path's total goes to the parent of its top.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plexivec.functions.text import hash_pair, word_count
from plexivec.plans.skew import lookup
from plexivec.plans.staging import staged

#: Turns of a conversation, or nodes of a path, that one window holds; longer ones are summed block by block.
BLOCK = 4096
#: Characters of joined ids in one row.
CHUNK = 1 << 16
KEY = ["k1", "k2", "d"]


def _until_here(rows: DataFrame, group: str, order: str, backwards: bool, run: dict[str, tuple], total_of: dict[str, Column]) -> DataFrame:
    """``rows`` with running aggregates of each group along the long column ``order``, this row included.

    ``run`` names, for each new column, its aggregate and how two results join.  Windows hold ``BLOCK`` places of a group;
    what the blocks before add up to is a row a block, joined where the rows of the block are.
    """
    rows = rows.withColumn("_block", F.floor(F.col(order) / BLOCK).cast("long"))
    way = F.desc if backwards else F.asc
    inner = W.partitionBy(group, "_block").orderBy(way(order)).rowsBetween(W.unboundedPreceding, 0)
    out = rows.select("*", *[agg(total_of[c]).over(inner).alias(c) for c, (agg, _) in run.items()])
    blocks = rows.groupBy(group, "_block").agg(*[agg(total_of[c]).alias(f"_all_{c}") for c, (agg, _) in run.items()])
    before = W.partitionBy(group).orderBy(way("_block")).rowsBetween(W.unboundedPreceding, -1)
    ahead = blocks.select(group, "_block", *[agg(F.col(f"_all_{c}")).over(before).alias(f"_before_{c}") for c, (agg, _) in run.items()])
    ahead = ahead.filter(" or ".join(f"_before_{c} is not null" for c in run))
    out = out.join(ahead, [group, "_block"], "left")
    joined = [join(F.col(c), F.coalesce(F.col(f"_before_{c}"), F.lit(0).cast("long"))).alias(c) for c, (_, join) in run.items()]
    return out.select(*[c for c in rows.columns if c != "_block"], *joined)


def _turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, pos, h1, h2, words`` of every turn in order, and for each conversation how many are taken from where.

    Turns are numbered over a range sort, so a conversation of any length is spread; equal turns get different numbers
    by their place in the input.
    """
    spark = conversations.sparkSession
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    said = F.struct(role, text)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[h.alias(n) for h, n in zip(hash_pair(said), ("h1", "h2"))], word_count(text).alias("words"), F.monotonically_increasing_id().alias("_place"))
    rows = rows.filter("conv_id is not null")
    order = [F.asc_nulls_first("turn"), F.col("h1"), F.col("h2"), F.col("_place")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(rows.repartitionByRange(parts, "conv_id", *order).withColumn("_part", F.spark_partition_id()), "turns")
    here = ranged.withColumn("_nth", F.row_number().over(W.partitionBy("conv_id", "_part").orderBy(*order)))
    per_part = ranged.groupBy("conv_id", "_part").agg(F.count("*").alias("_k"))
    convs = per_part.groupBy("conv_id").agg(F.sum("_k").alias("n"))
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % 4)
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(bases, "base", "left").withColumn("lead", F.least("h", F.coalesce("n_base", F.lit(0).cast("long"))))
    convs = staged(convs.select("conv_id", "base", "n", "h", "lead", (F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "convs")
    before = W.partitionBy("conv_id").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    ahead = per_part.select("conv_id", "_part", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_ahead")).join(convs, "conv_id")
    numbered = here.join(ahead, ["conv_id", "_part"])
    return numbered.select("conv_id", (F.col("_ahead") + F.col("_nth")).alias("pos"), "h1", "h2", "words", "n", "h", "lead", "len"), convs


def rebuilt_walks(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The walks of rebuilt conversations down the trie, a row a turn, and the conversations with their lengths.

    A conversation c has the first h turns of conversation ``c - c % 20``, h being the CRC-32 of its decimal id modulo 4,
    then its own turns after its first h.
    """
    turns, convs = _turns(conversations)
    turns = staged(turns, "numbered")
    own = turns.filter("pos > h").select(F.col("conv_id").alias("conv"), (F.col("lead") + F.col("pos") - F.col("h")).alias("d"), "h1", "h2", "words", "len")
    first = turns.filter("conv_id % 20 = 0 and pos <= 3").select(F.col("conv_id").alias("base"), "pos", "h1", "h2", "words")
    led = first.join(convs.filter("lead > 0"), "base").filter("pos <= lead")
    walks = own.unionByName(led.select(F.col("conv_id").alias("conv"), F.col("pos").alias("d"), "h1", "h2", "words", "len"))
    walks = walks.withColumn("e1", F.xxhash64("d", "h1", "h2")).withColumn("e2", F.xxhash64("h2", "d", "h1")).drop("h1", "h2")
    xor = (F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    keyed = _until_here(walks, "conv", "d", False, {"k1": xor, "k2": xor}, {"k1": F.col("e1"), "k2": F.col("e2")})
    parent = [F.col(k).bitwiseXOR(F.col(e)).alias(p) for k, e, p in (("k1", "e1", "pk1"), ("k2", "e2", "pk2"))]
    return staged(keyed.select("conv", "d", "len", "k1", "k2", *parent, "words"), "walks"), convs


def _ends(walks: DataFrame, convs: DataFrame) -> DataFrame:
    """``k1, k2, d, ends_sha256`` of the nodes where conversations end.

    Ids are range-sorted and joined to long strings in parallel; a node's strings are then hashed one after the other,
    without holding them together.
    """
    zero = F.lit(0).cast("long")
    ends = walks.filter("d = len").select(*KEY, "conv").unionByName(convs.filter("len = 0").select(zero.alias("k1"), zero.alias("k2"), zero.alias("d"), F.col("conv_id").alias("conv")))
    parts = int(walks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ends.repartitionByRange(parts, *KEY, "conv").sortWithinPartitions(*KEY, "conv")
    kinds = [pa.int64()] * 4 + [pa.string()]
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [*KEY, "first", "ids"][: len(rows[0])])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size = None, None, [], 0
        for batch in batches:
            out = []
            for *now, conv in zip(*[batch.column(c).to_pylist() for c in (*KEY, "conv")]):
                if key is not None and (now != key or size >= CHUNK):
                    out.append((*key, first, ",".join(ids)))
                    ids, size = [], 0
                if not ids:
                    key, first = now, conv
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if out:
                yield table(out)
        if ids:
            yield table([(*key, first, ",".join(ids))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        done = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [*kinds[:3], pa.string()])], [*KEY, "ends_sha256"])
        for batch in batches:
            out = []
            for *now, ids in zip(*[batch.column(c).to_pylist() for c in (*KEY, "ids")]):
                if now == key:
                    digest.update(b"," + ids.encode())
                else:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = now, hashlib.sha256(ids.encode())
            if out:
                yield done(out)
        if key is not None:
            yield done([(*key, digest.hexdigest())])

    strings = ranged.mapInArrow(joined, "k1 bigint, k2 bigint, d bigint, first bigint, ids string")
    return strings.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(hashed, "k1 bigint, k2 bigint, d bigint, ends_sha256 string")


def _tree(walks: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node: key, parent's key, conversations, smallest of them, children, parent's smallest, and whether its edge is light."""
    zero = F.lit(0).cast("long")
    nodes = walks.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.first("words").alias("words"), F.first("pk1").alias("pk1"), F.first("pk2").alias("pk2"))
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    root = root.select(zero.alias("k1"), zero.alias("k2"), zero.alias("d"), "n_convs", "conv_id", zero.alias("words"), zero.alias("pk1"), zero.alias("pk2"))
    nodes = staged(nodes.unionByName(root), "nodes")
    # siblings have different smallest conversations: the heavy one has the most conversations, then the smaller id
    kids = nodes.filter("d > 0").groupBy(F.col("pk1").alias("k1"), F.col("pk2").alias("k2"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("n_children"), F.max_by("conv_id", F.struct("n_convs", F.bitwise_not("conv_id"))).alias("heavy"))
    nodes = staged(nodes.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero)), "nodes")
    parents = nodes.filter("n_children > 0").select(F.col("k1").alias("pk1"), F.col("k2").alias("pk2"), F.col("d").alias("pd"), F.col("conv_id").alias("parent_conv_id"), "heavy", F.col("n_children").alias("siblings"))
    own = nodes.drop("heavy").withColumn("pd", F.col("d") - 1)
    met = lookup(own, parents, ["pk1", "pk2", "pd"], "siblings", nodes.count(), F.xxhash64(*KEY))
    return staged(met.select(*KEY, "pk1", "pk2", "n_convs", "conv_id", "words", "n_children", "parent_conv_id", (F.col("heavy") != F.col("conv_id")).alias("light")), "tree")


def _paths(walks: DataFrame, tree: DataFrame) -> DataFrame:
    """The tree's nodes with the path each is on, the depth of the path's top and its level: the light edges from the root to it."""
    leaves = tree.filter("n_children = 0 and d > 0").select(F.col("conv_id").alias("conv"), F.col("d").alias("steps"))
    n_rows = walks.count()
    to_leaf = lookup(walks.select("conv", *KEY), leaves, ["conv"], "steps", n_rows, F.xxhash64("conv", "d"), "inner")
    met = staged(lookup(to_leaf, tree.filter("d > 0"), KEY, "n_convs", n_rows, F.xxhash64("conv", "d"), "inner"), "to_leaf")
    tops = met.groupBy("conv").agg(F.max(F.when(F.col("light"), F.col("d"))).alias("top"), F.count_if("light").alias("level"), F.max("steps").alias("steps"))
    tops = staged(tops.withColumn("top", F.coalesce("top", F.lit(0).cast("long"))), "tops")
    down = lookup(met.drop("steps"), tops, ["conv"], "steps", met.count(), F.xxhash64("conv", "d"), "inner").filter("d >= top").drop("steps")
    # the root is on the one path without a light edge, alone if there is none
    first = tops.filter("level = 0").select("conv", F.lit(0).cast("long").alias("d"))
    root = tree.filter("d = 0").join(first, "d", "left").withColumn("conv", F.coalesce("conv", "conv_id")).withColumn("top", F.lit(0).cast("long")).withColumn("level", F.lit(0).cast("long"))
    return staged(down.unionByName(root.select(down.columns)).withColumnRenamed("conv", "path").sortWithinPartitions("level"), "paths")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the prefix trie of the rebuilt conversations (``rebuilt_walks``).

    ``conv_id`` is the smallest conversation that starts with the node's turns, ``depth`` their number,
    ``parent_conv_id`` the smallest one of the node without the last turn (null at the root), ``n_convs`` and
    ``n_children`` count conversations and children, ``n_leaves`` childless nodes at or below the node, and
    ``saved_tokens`` the words that need not be read again there: ``n_convs - 1`` times the words of the last text, summed
    over the subtree.  ``ends_sha256`` is the digest of the ids of conversations that end here, ascending and joined by commas.

    Null roles and texts are empty.  Null turns come first; equal turns are in an order of hashes of role and
    text, repeated rows are turns of their own.  Rows without ``conv_id`` belong to no conversation and take no
    part.  A table without conversations has no nodes, not even a root.  Other columns are ignored, whatever
    their names.  A conversation, a node, a path or a text of any size is spread or summed in blocks.
    """
    walks, convs = rebuilt_walks(conversations)
    tree = _tree(walks, convs)
    paths = _paths(walks, tree)
    below, done = None, []
    plus = (F.sum, lambda a, b: a + b)
    for level in range(paths.agg(F.max("level")).first()[0] or 0, -1, -1):
        rows = paths.filter(F.col("level") == level)
        leaves, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("words")
        if below is not None:
            rows = rows.join(below, KEY, "left")
            leaves, saved = leaves + F.coalesce("_leaves", F.lit(0)), saved + F.coalesce("_saved", F.lit(0))
        rows = rows.withColumn("_own_leaves", leaves).withColumn("_own_saved", saved).drop("_leaves", "_saved")
        total = {"n_leaves": F.col("_own_leaves"), "saved_tokens": F.col("_own_saved")}
        summed = staged(_until_here(rows, "path", "d", True, {"n_leaves": plus, "saved_tokens": plus}, total), "summed")
        done.append(summed)
        tops = summed.filter("d = top and d > 0")
        below = tops.groupBy(F.col("pk1").alias("k1"), F.col("pk2").alias("k2"), (F.col("d") - 1).alias("d")).agg(F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = out.join(_ends(walks, convs), KEY, "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
