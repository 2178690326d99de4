"""Mixing sources to target weights by weighted fair queueing, DataFrame functions only.

Every source is a queue of its documents in a fixed shuffled order, repeated as often as the mix may
repeat it.  A document leaves its queue at the virtual time "words of its source up to and with this
document, divided by the source's target": all queues are served at rates in proportion to their
targets.  All copies are range-sorted by virtual finish time over the cluster, their words are summed up
in that order, and the mix ends where the sum reaches the budget, the words of all targets.  A source's
document that is in service at virtual time 1 is two pieces, so that service can change hands there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plexivec.functions.stats import running_sums
from plexivec.functions.text import WORD, word_count
from plexivec.plans.skew import lookup
from plexivec.plans.staging import staged

#: Hexadecimal digits of the shuffled order that make a bucket: 4,096 buckets of every source.
BUCKET_DIGITS = 3
#: One row a source is broadcast up to this many sources.
BROADCAST_SOURCES = 100_000


def _by_name() -> list[Column]:
    return [F.col("source").isNull(), F.col("source")]


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, repeats: int) -> DataFrame:
    """Targets of the sources of ``sizes`` (``source, source_size``), one row each.

    Sources in code-point order, null last, get the weights in turn.  ``share`` times all words are
    dealt out by weight; a target stops at ``repeats`` times its source's size, and what is over goes
    to the others by weight.  That is one water level: sources are filled in the order of the level at
    which they stop, so sums over the sources with a lower one give it.  Ranks and sums come from range
    sorts, so that sources may be as many as hosts.  No sources give no targets.
    """
    named = running_sums(sizes.withColumn("one", F.lit(1)), _by_name(), ["one"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("one_upto") - 1) % len(weights) + 1).cast("int"))
    s = named.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(repeats))).alias("most"))
    s = running_sums(s.withColumn("stops", F.col("most") / F.col("weight")), [F.col("stops"), *_by_name()], ["most", "weight"])
    s = staged(s, "sources")
    words, heavy = s.agg(F.sum("source_size"), F.sum("weight")).first()
    room = F.lit(float(words or 0)) * F.lit(float(share)) - (F.col("most_upto") - F.col("most"))
    level = room / (F.lit(heavy or 1.0) - (F.col("weight_upto") - F.col("weight")))
    water = s.agg(F.max(F.when(F.col("stops") > level, level))).first()[0]
    full = F.lit(True) if water is None else F.col("stops") <= F.lit(water)
    return s.select("source", "source_size", F.when(full, F.col("most")).otherwise(F.col("weight") * F.lit(water)).alias("target"))


def _shuffled(id_: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))))


def fair_schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: str = "mix") -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, before, shuffled, seq``.

    ``before`` is the number of words of its source ahead of the document in the shuffled order, which
    depends on the id and the seed only.  The running sums have two levels, sums of buckets of the order
    and sums within a bucket, so that a source with a third of all rows is never in one task.  Texts are
    read once, for their sizes.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _shuffled(F.col(id_col), seed).alias("shuffled"))
    d = staged(d.withColumn("bucket", F.substring("shuffled", 1, BUCKET_DIGITS)), "sizes")
    sums = staged(d.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, repeats)
    ahead = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = sums.select("source", "bucket", ahead.alias("ahead")).join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    cells = cells.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "ahead", "source_size", "target")
    within = W.partitionBy("source", "bucket").orderBy("shuffled", "doc_id", "size")
    d = d.withColumn("here", F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).withColumn("seq", F.row_number().over(within))
    d = d.join(cells, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    return d.select("doc_id", "source", "size", "source_size", "target", (F.col("ahead") + F.col("here")).alias("before"), "shuffled", F.concat_ws("-", "bucket", F.col("seq").cast("string")).alias("seq"))


def _order() -> list[Column]:
    return [F.col("finish"), F.col("over"), *_by_name(), F.col("epoch"), F.col("before"), F.col("seq")]


def served(docs: DataFrame, repeats: int = 2, **kwargs) -> DataFrame:
    """The copies of all documents in pieces, in the order of their virtual finish times, each with the words ``taken`` of it.

    Adds to ``fair_schedule`` the columns ``epoch`` (0 to ``repeats`` - 1), ``words`` (of the piece), ``finish``
    and ``taken``: pieces are range-sorted by ``finish``, ``words`` is summed up in that order, and what is
    beyond the budget is cut off.  A copy is one piece, or two if it is in service at virtual time 1, where
    the budget of whole words ends.  Copies of a source without a target come last.
    """
    s = fair_schedule(docs, repeats=repeats, **kwargs).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    start, whole, size = F.col("epoch") * F.col("source_size") + F.col("before"), F.floor("target"), F.col("size")
    ends = lambda words: F.when(F.col("target") > 0, (start + words) / F.col("target")).otherwise(F.lit(float("inf")))
    piece = lambda words, until, over: F.struct(words.cast("long").alias("words"), ends(until).alias("finish"), over.alias("over"))
    cut = F.array(piece(whole - start, whole - start, F.lit(False)), piece(size - (whole - start), size, F.lit(True)))
    pieces = F.when((start < whole) & (start + size > whole), cut).otherwise(F.array(piece(size, size, start + size > whole)))
    rows = s.withColumn("piece", F.explode(pieces)).select(*s.columns, "piece.*")
    sums = staged(running_sums(rows, _order(), ["words"]), "served")
    budget = sums.select("source", "target").distinct().agg(F.coalesce(F.sum(F.floor("target")), F.lit(0))).first()[0]
    room = F.greatest(F.lit(budget) - (F.col("words_upto") - F.col("words")), F.lit(0))
    return sums.withColumn("taken", F.least("words", room).cast("long")).drop("words_upto")


def mix_sources(docs: DataFrame, repeats: int = 2, **kwargs) -> DataFrame:
    """The mix in training order: every copy of every document with the words taken of it.

    Adds to ``fair_schedule`` the columns ``epoch``, ``finish`` (virtual time) and ``taken``.  Rows are
    range-sorted by virtual finish time over the whole cluster; copies after the budget is used up have
    ``taken`` 0 and come last.  The budget is counted in words: the one document of a source that is in
    service when it ends gives the words up to there.  Null texts and texts without words have size 0 and
    take nothing; a table without words has the targets 0.  Null sources are one source.  Rows that repeat
    an id are documents of their own.  Other columns are ignored, whatever their names.
    """
    pieces = served(docs, repeats, **kwargs)
    keys = ["source", "seq", "epoch"]
    first = [F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target", "before", "shuffled")]
    copies = pieces.groupBy(*keys).agg(*first, F.max("finish").alias("finish"), F.max("over").alias("over"), F.sum("taken").alias("taken"))
    return copies.orderBy(*_order()).drop("over")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **kwargs) -> DataFrame:
    """The documents of the mix, whole, as often as they are taken, with the columns of ``docs``.

    Only ids and sizes are sorted.  What a source gives in an epoch is a beginning of its shuffled order, so
    one row a source with the last document of every epoch decides on its texts, which need not move:
    that table is broadcast up to ``BROADCAST_SOURCES`` rows; beyond, the few sources with many rows are
    broadcast and the others joined by a shuffle.  A copy that the end of the budget cuts in two is taken
    if more than half of its words are within.  Texts without words are not taken; rows that repeat an id
    are taken alike.  Copies of a row follow each other; the order of training is that of ``mix_sources``.
    """
    pieces = served(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **kwargs)
    taken = pieces.filter("taken > 0 and taken * 2 > size").groupBy("source", "epoch").agg(F.max(F.struct("shuffled", "doc_id")).alias("last"))
    cuts = taken.groupBy("source").agg(F.collect_list("last").alias("_lasts"))
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("_rows"))
    cuts = cuts.join(sizes.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    cuts = staged(cuts.select(F.xxhash64("source").alias("_source_hash"), F.col("source").alias("_source"), "_lasts", "_rows"), "cuts")
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(source_col).alias("_source_hash"), F.col(source_col).alias("_source"), F.struct(_shuffled(F.col(id_col), seed).alias("shuffled"), F.col(id_col).alias("doc_id")).alias("_at"), F.regexp_like(F.col(text_col), F.lit(WORD)).alias("_words"))
    n, total = cuts.agg(F.count("*"), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    if n <= BROADCAST_SOURCES:
        small = cuts.drop("_source_hash").withColumnRenamed("_source", "_name")
        found = row.join(F.broadcast(small), F.col("_source").eqNullSafe(F.col("_name")))
    else:
        found = lookup(row, cuts, ["_source_hash", "_source"], "_rows", total, F.xxhash64("_at"), "inner")
    copies = F.filter("_lasts", lambda last: F.col("_at") <= last)
    return found.filter("_words").select("_row", F.explode(copies)).select("_row.*")
