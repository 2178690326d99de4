"""Near-duplicate groups by bottom-k sketches, exact in the end.

1. Every whole text becomes the set of its word shingles, hashed by one hash function; a bottom-k
   sketch keeps the k smallest values.  Texts with equal sets form a class; only classes go on.
2. Inverted lists: the key of a list is two values next to each other in a sketch.  Two sets with
   Jaccard similarity s share about s*s of them, where single values would gather every text with a
   common phrase.  ``least_shared`` bounds the number of keys two similar sets share from below.
3. Lists of up to ``long_list`` classes give pairs with the number of lists they share.  A class with so
   few long lists that a similar class must meet it in short ones leaves the long lists.  In those, each
   class is paired with the list's most listed class only.  Where that leaves a group in several
   components, the classes outside the largest are compared with all of the group of about their size, block by block.
4. Pairs are filtered by the estimate from the sketch of the union, then verified on the full sets,
   the best pair of each class first; pairs within a component need not be verified any more.

Large groups of near copies cost a comparison with one class each, as long as most are linked to it.  A
large group of texts of about one size that are all just too different costs the square of its size, in tasks of
two blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexivec.llm.wordhash import blocks, shingles, text_bytes, words
from plexivec.plans.batches import small_batches
from plexivec.plans.components import components
from plexivec.plans.skew import lookup
from plexivec.plans.staging import staged

#: Values in a sketch.
K = 64
#: Chance that two sets at the threshold share fewer keys than ``least_shared`` says.
MISS = 1e-9
#: Classes in a list up to which it gives pairs.
LONG_LIST = 16
#: Classes in a block of the comparison within groups.
BLOCK_CLASSES = 1024
#: Rows of a class that share one copy of its text.
TEXT_ROWS = 256
#: Of these, classes compared at once.
CHUNK_CLASSES = 128
#: Multiplications in a product of matrices that take about as long as to intersect two sets, and values in a product.
PAIR_PRODUCTS = 150_000
PRODUCT_VALUES = 4096
HALF = np.uint64(2**63 - 1)


def least_shared(similarity: float, k: int = K, miss: float = MISS) -> int:
    """Keys (neighbouring values in both sketches) that two sets at this similarity share, but for the chance ``miss``."""
    p = similarity
    now = np.array([[1 - p] + [0.0] * (k - 1), [p] + [0.0] * (k - 1)])
    for _ in range(k - 1):
        now = np.array([now.sum(0) * (1 - p), now[0] * p + np.concatenate([[0.0], now[1, :-1] * p])])
    return int(np.searchsorted(np.cumsum(now.sum(0)), miss, "right"))


def shingle_sets(texts: pa.Array, n_words: int) -> Iterator[np.ndarray]:
    """The sorted set of hashed shingles of every text, as 63-bit numbers."""
    with np.errstate(over="ignore"):
        raw, offsets = text_bytes(texts)
        for i, j in blocks(offsets):
            h, _, _, first = words(raw, offsets[i : j + 1])
            for a, b in zip(first[:-1], first[1:]):
                yield np.unique(shingles(h[a:b], n_words) & HALF)


def sketches(docs: DataFrame, n_words: int, k: int = K) -> DataFrame:
    """``doc_id, text_hash, n, d1, d2, sketch`` of ``docs`` (``doc_id, text``): set size, digest, smallest values."""
    schema = "doc_id bigint, text_hash bigint, n bigint, d1 bigint, d2 bigint, sketch array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ones, twos, parts = [], [], [], []
            for s in shingle_sets(batch.column("text"), n_words):
                one, two = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                sizes.append(len(s)), ones.append(one), twos.append(two), parts.append(s[:k].astype(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int64()))
            cols = [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "n", "d1", "d2", "sketch"])

    return small_batches(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")).mapInArrow(run, schema)


def _texts(wanted: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, text`` of the wanted classes: the text of the class's row with the largest id."""
    who = nodes.join(wanted.distinct(), "node", "left_semi").select("node", F.col("rep.doc_id").alias("_id"), F.col("rep.text_hash").alias("_hash"))
    found = docs.withColumn("_text_hash", F.xxhash64("text")).join(who, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")))
    return found.groupBy("node").agg(F.first("text").alias("text"))  # rows may repeat an id and a text


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, n_words: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` of classes whose full sets have the similarity.

    The texts of the classes in question are read again and written once; each pair then meets both.
    Without pairs no text is read.
    """
    if not pairs.take(1):
        return pairs.select("a", "b")
    t = staged(_texts(pairs.select(F.explode(F.array("a", "b")).alias("node")), docs, nodes), "texts")
    both = _with_texts(pairs.select("a", "b"), t, ["b", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch.column("a").to_numpy()
            new = np.concatenate([[True], a[1:] != a[:-1]])[: len(a)]  # pairs come by "a", so its set serves many
            sets, x, keep = shingle_sets(batch.column("text_a").filter(pa.array(new)), n_words), None, []
            for other, y in zip(new, shingle_sets(batch.column("text_b"), n_words)):
                x = next(sets) if other else x
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return small_batches(both).mapInArrow(run, "a bigint, b bigint")


def _with_texts(rows: DataFrame, texts: DataFrame, of: list[str]) -> DataFrame:
    """``rows`` with ``text_<x>`` for each column ``x`` of classes.

    Texts are never broadcast: the rows of a class are dealt to parts of about ``TEXT_ROWS``, and its text is
    copied once for each part, so a class in a third of all rows goes to many tasks.  Parts are told before any
    text is joined, from the columns of ``rows`` alone.
    """
    dealt, copies = rows, {}
    for x in of:
        sizes = staged(rows.groupBy(x).agg(F.count("*").alias("_rows")).withColumn("_last", F.expr(f"(_rows - 1) div {TEXT_ROWS}")), "parts")
        total, largest = _sizes(sizes, "_rows")
        copies[x] = sizes.select(F.col(x).alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), "_last")).alias("_part"))
        spread = F.xxhash64(F.lit(x), *rows.columns)
        dealt = lookup(dealt, sizes, [x], "_rows", total, spread, "inner", largest).withColumn(f"_part_{x}", F.pmod(spread, F.col("_last") + 1)).drop("_rows", "_last")
    for x in of:
        own = copies[x].join(texts, "node").select(F.col("node").alias(x), F.col("_part").alias(f"_part_{x}"), F.col("text").alias(f"text_{x}"))
        dealt = dealt.join(own, [x, f"_part_{x}"]).drop(f"_part_{x}")
    return dealt.select(*rows.columns, *[f"text_{x}" for x in of])


def _with_class(rows: DataFrame, pairs: DataFrame, of: DataFrame, x: str) -> DataFrame:
    """``rows``, one for each of ``pairs``, with the columns of the class ``x``; classes in many pairs are looked up apart."""
    sizes = staged(pairs.groupBy(x).agg(F.count("*").alias("_pairs")), "in_pairs")
    total, largest = _sizes(sizes, "_pairs")
    return lookup(rows, of.join(sizes, x), [x], "_pairs", total, F.xxhash64(*pairs.columns), "inner", largest).drop("_pairs")


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that can reach the similarity, with ``sure`` and the ``shared`` sketch values; ``sure`` where the sketches hold the whole sets and it is reached."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    p = _with_class(_with_class(pairs, pairs, side("a"), "a"), pairs, side("b"), "b")
    p = p.filter((F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent))
    p = p.withColumn("both", F.array_intersect("s_a", "s_b")).withColumn("all", F.array_union("s_a", "s_b"))
    whole = (F.col("n_a") <= K) & (F.col("n_b") <= K)
    union = F.slice(F.array_sort("all"), 1, K)
    enough = F.when(whole, F.size("both") * 100 >= F.size("all") * percent).otherwise(F.size(F.array_intersect("both", union)) * 200 >= F.size(union) * percent)
    return p.filter(enough).select(*pairs.columns, whole.alias("sure"), F.size("both").alias("shared"))


def _keys(sketch: Column) -> Column:
    """A hash of each two neighbouring values."""
    tail = F.slice(sketch, 2, K)
    return F.zip_with(F.slice(sketch, 1, F.size(sketch) - 1), tail, lambda x, y: F.xxhash64(x, y))


def links(docs: DataFrame, nodes: DataFrame, n_words: int, percent: int, long_list: int) -> DataFrame:
    """Verified links ``a, b`` between classes that give all components."""
    keyed = nodes.filter("n > 1").select("node", "n", F.explode(_keys(F.col("sketch"))).alias("key"))
    lists = staged(keyed.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "lists")
    total, largest = _sizes(lists, "m")
    listed = staged(lookup(keyed, lists, ["key"], "m", total, F.xxhash64("node", "key"), "inner", largest), "listed")

    # n - 1 keys, two lost with each of n * (100 - percent) / 100 values; rounded up in integers, as floats give one more at 5, 10, 15
    sure = F.expr(f"(n * {2 * percent - 100} - 1) div 100")
    allowed = F.least(F.lit(least_shared(percent / 100)).cast("long"), sure) - 2
    # a class has fewer keys than its sketch has values, so its lists fit in a row
    held = listed.groupBy("node").agg(F.first("n").alias("n"), F.collect_list(F.struct("key", "m")).alias("keys"))
    held = held.withColumn("longs", F.filter("keys", lambda k: k["m"] > long_list)).filter(F.size("longs") > allowed)
    met_in = F.aggregate("keys", F.lit(0).cast("long"), lambda total, k: total + k["m"])
    long = staged(held.select("node", "n", met_in.alias("met"), F.explode("longs").alias("k")).select("k.key", "node", "n", "met"), "long")
    short = listed.filter(F.col("m") <= long_list).select("key", "node", "n")

    near = lambda x, y: (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)
    other = short.select("key", F.col("node").alias("b"), F.col("n").alias("n_b"))
    met = short.join(other, "key").filter((F.col("node") < F.col("b")) & near("n", "n_b")).groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("k")).filter("k > 1").select("a", "b")
    leaders = staged(long.groupBy("key").agg(F.max(F.struct("met", "node")).alias("top"), F.count("*").alias("m")), "leaders")
    total, largest = _sizes(leaders, "m")
    topped = lookup(long, leaders, ["key"], "m", total, F.xxhash64("node", "key"), "inner", largest)
    led = topped.withColumn("lead", F.col("top.node")).filter(F.col("lead") != F.col("node"))
    pairs = met.withColumn("short", F.lit(1)).unionByName(led.select(F.col("lead").alias("a"), F.col("node").alias("b"), F.lit(0).alias("short")))
    cand = staged(_estimated(staged(pairs.groupBy("a", "b").agg(F.max("short").alias("short")), "met"), nodes, percent), "pairs")

    best = staged(cand.filter("not sure").groupBy("b").agg(F.max(F.struct("shared", "a")).alias("top")).select(F.col("top.a").alias("a"), "b"), "best")
    first = staged(cand.filter("sure").select("a", "b").unionByName(verified(best, docs, nodes, n_words, percent)), "links")
    comp = components(first)
    label = lambda df, x: df.join(comp.select(F.col("node").alias(x), F.col("comp").alias(f"_{x}")), x, "left").withColumn(f"_{x}", F.coalesce(F.col(f"_{x}"), F.col(x)))
    apart = F.col("_a") != F.col("_b")
    rest = staged(label(label(cand.filter("short = 1 and not sure").select("a", "b"), "a"), "b").filter(apart).select("a", "b"), "rest")

    # each written by itself: Spark plans a query anew on the driver after every shuffle in it
    last = staged(verified(rest, docs, nodes, n_words, percent), "last")
    return first.unionByName(last).unionByName(staged(_within_groups(topped, comp, docs, nodes, n_words, percent), "within"))


def _hubs(met: DataFrame) -> DataFrame:
    """Edges ``a, b`` that connect the same classes as each class (``node``) with the ``top.node`` of all its lists.

    A class is an edge once, with the top class that most others meet; its other top classes are edges of that
    one.  Classes of a group have these in common, so there is about one edge a class, and not one a list.
    """
    # as many lists as a class has keys, so they fit in a row
    own = met.groupBy("node").agg(F.max("top").alias("hub"), F.collect_set("top.node").alias("tops"))
    return own.select(F.col("hub.node").alias("a"), F.explode(F.array_union(F.array("node"), "tops")).alias("b")).distinct()


def _span(percent: int) -> Column:
    """The span of the set size ``n``: sizes of similar sets are in one span or in two that are neighbours.

    A span is wider than the ratio of two such sizes by a hair, so that rounding cannot put them two apart.
    """
    return F.floor(F.log("n") / F.lit(max(np.log(100 / percent), 0.01) * (1 + 1e-6))).cast("int")


def _blocks(open_: DataFrame, percent: int) -> DataFrame:
    """The classes ``g, comp, largest, node, n, sketch`` of groups, once for each pair of blocks ``g, p, q, i, j`` that they are compared in.

    Left (``outside`` the largest component) are the classes of block ``i`` of a span ``p`` of sizes, right all classes of block
    ``j`` of the same span or a neighbour, ``q``: elsewhere no set is similar.
    """
    open_ = open_.withColumn("span", _span(percent))
    counts = open_.groupBy("g", "span").agg(F.count("*").alias("all"), F.count_if(F.col("comp") != F.col("largest")).alias("out"))
    blocks_of = lambda c: F.map_from_entries(F.collect_list(F.struct("span", F.ceil(F.col(c) / BLOCK_CLASSES).alias("n"))))
    # a group has few spans, so they fit in a row
    spans = staged(counts.groupBy("g").agg(F.sum("all").alias("m"), blocks_of("out").alias("n_out"), blocks_of("all").alias("n_all")), "spans")
    total, largest = _sizes(spans, "m")
    kept = ["node", "comp", "n", "sketch"]
    met = lookup(open_.select("g", "span", "largest", *kept), spans, ["g"], "m", total, F.xxhash64("node"), "inner", largest)
    around = F.explode(F.sequence(F.col("span") - 1, F.col("span") + 1))
    of = lambda n: F.pmod(F.xxhash64("node"), n)
    each = lambda df, n, x: df.filter(n > 0).withColumn(x, F.explode(F.sequence(F.lit(0), n - 1)))
    n_out, n_all = (F.try_element_at(c, F.col(k)) for c, k in (("n_out", "p"), ("n_all", "q")))
    left = each(met.filter(F.col("comp") != F.col("largest")).withColumn("p", F.col("span")).withColumn("q", around), n_all, "j")
    right = each(met.withColumn("q", F.col("span")).withColumn("p", around), n_out, "i")
    side = lambda df, i, j, outside: df.select("g", "p", "q", i.alias("i"), j.alias("j"), *kept, F.lit(outside).alias("outside"))
    return side(left, of(n_out), F.col("j"), True).unionByName(side(right, F.col("i"), of(n_all), False))


def _within_groups(met: DataFrame, comp: DataFrame, docs: DataFrame, nodes: DataFrame, n_words: int, percent: int) -> DataFrame:
    """Links that are left among classes which meet in long lists only, as a forest for each pair of blocks.

    Classes that meet in long lists (``met``, with the list's ``top``) form groups.  A group of one component is done.  In the others the
    classes outside the largest component are compared with all of the group that have about their size, in blocks of
    about ``BLOCK_CLASSES``, first by their sketches: a task has two blocks and returns the classes, not the
    pairs, that are close to one of the other block.  Only those are compared by their texts; a task skips
    pairs that are connected and returns only the links that connect something.
    """
    groups = components(_hubs(met)).withColumnRenamed("comp", "g")
    placed = staged(groups.join(comp, "node", "left").select("node", "g", F.coalesce("comp", "node").alias("comp")), "groups")
    split = placed.groupBy("g", "comp").agg(F.count("*").alias("c")).groupBy("g").agg(F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("parts"), F.sum("c").alias("m")).filter("parts > 1")
    split = staged(split.select("g", F.col("top.comp").alias("largest"), "m"), "split")
    total, largest = _sizes(split, "m")
    if not total:
        return met.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    open_ = lookup(placed, split, ["g"], "m", total, F.xxhash64("node"), "inner", largest)
    open_ = staged(open_.join(nodes.select("node", "n", "sketch"), "node"), "open")
    blocks_ = _blocks(open_, percent)

    def near(x: pd.DataFrame) -> pd.DataFrame:
        """The rows of two blocks whose sketch is close to one of the other block and another component."""
        left, right = x[x["outside"]], x[~x["outside"]]
        can = (_common(left, right, percent) > 0) & (left["comp"].to_numpy()[:, None] != right["comp"].to_numpy()[None, :])
        return pd.concat([left[can.any(1)], right[can.any(0)]])

    # sketches decide which classes' texts are read at all, and by which pairs of blocks
    pair = ["g", "p", "q", "i", "j"]
    close = staged(blocks_.groupBy(*pair).applyInPandas(near, blocks_.schema), "close")
    texts = staged(_texts(close.select("node"), docs, nodes), "close_texts")
    rows = _with_texts(close, texts, ["node"]).withColumnRenamed("text_node", "text")

    def run(x: pd.DataFrame) -> pd.DataFrame:
        return _forest(x[x["outside"]], x[~x["outside"]], n_words, percent)

    return rows.groupBy(*pair).applyInPandas(run, "a bigint, b bigint")


def _common(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> np.ndarray:
    """Sketch values that pairs of two blocks have in common, 0 for pairs that cannot reach the similarity."""
    common = np.zeros((len(left), len(right)), np.float32)
    if not len(left) or not len(right):
        return common
    n, m = left["n"].to_numpy()[:, None], right["n"].to_numpy()[None, :]
    flat, owner = np.concatenate(left["sketch"].to_list()), np.repeat(np.arange(len(left)), left["sketch"].map(len))
    for at in range(0, len(right), CHUNK_CLASSES):
        chunk = right["sketch"].iloc[at : at + CHUNK_CLASSES]
        values, where = np.unique(np.concatenate(chunk.to_list()), return_inverse=True)
        b = np.zeros((len(chunk), len(values)), np.float32)
        b[np.repeat(np.arange(len(chunk)), chunk.map(len)), where] = 1
        found = np.minimum(np.searchsorted(values, flat), len(values) - 1)
        hit = values[found] == flat
        a = np.zeros((len(left), len(values)), np.float32)
        a[owner[hit], found[hit]] = 1
        common[:, at : at + CHUNK_CLASSES] = a @ b.T
    can = (100 * n >= percent * m) & (100 * m >= percent * n) & (200 * common >= percent * np.minimum(np.minimum(n, m), K))
    return np.where(can, common, 0)


def _shared(left: list[np.ndarray], right: list[np.ndarray], most: int) -> np.ndarray | None:
    """How many values all pairs of two lists of sets share, by products of matrices; None if that takes more than ``most`` multiplications."""
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    if len(left) * len(right) * len(both) > most:
        return None
    sides = []
    for sets in (left, right):
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(both, flat), max(len(both) - 1, 0))
        hit = np.flatnonzero(both[at] == flat) if len(both) else np.zeros(0, int)
        hit = hit[np.argsort(at[hit], kind="stable")]
        sides.append((len(sets), at[hit], owner[hit]))
    out = np.zeros((len(left), len(right)), np.int64)
    for k in range(0, len(both), PRODUCT_VALUES):  # a product's sums stay far below what single precision counts
        parts = []
        for n, at, owner in sides:
            own = slice(*np.searchsorted(at, [k, k + PRODUCT_VALUES]))
            part = np.zeros((n, PRODUCT_VALUES), np.float32)
            part[owner[own], at[own] - k] = 1
            parts.append(part)
        out += (parts[0] @ parts[1].T).astype(np.int64)
    return out


def _forest(left: pd.DataFrame, right: pd.DataFrame, n_words: int, percent: int) -> pd.DataFrame:
    """Links between two blocks of classes that connect different components, most similar sketches first."""
    if not len(left) or not len(right):
        return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
    common = _common(left, right, percent)
    a, b = np.nonzero(common)
    sets = [list(shingle_sets(pa.array(x["text"], pa.string()), n_words)) for x in (left, right)]
    known = _shared(*sets, len(a) * PAIR_PRODUCTS)
    if known is not None:
        n, m = (np.array([len(s) for s in x]) for x in sets)
        similar = 100 * known[a, b] >= percent * (n[a] + m[b] - known[a, b])
        a, b = a[similar], b[similar]
    order = np.argsort(-common[a, b], kind="stable")
    comps, nodes = [x["comp"].to_numpy() for x in (left, right)], [x["node"].to_numpy() for x in (left, right)]
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    links = []
    for i, j in zip(a[order].tolist(), b[order].tolist()):
        x, y = top(int(comps[0][i])), top(int(comps[1][j]))
        if x != y:
            s, t = sets[0][i], sets[1][j]
            both = len(np.intersect1d(s, t, assume_unique=True)) if known is None else known[i, j]
            if 100 * both >= percent * (len(s) + len(t) - both):
                parent[x] = y
                links.append((int(nodes[0][i]), int(nodes[1][j])))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _sizes(df: DataFrame, column: str) -> tuple[int, int]:
    """The sum of a column of sizes and the largest of them."""
    total, largest = df.agg(F.sum(column), F.max(column)).first()
    return total or 0, largest or 0


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, percent: int = 80, long_list: int = LONG_LIST) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept, text_hash``.

    Two documents are linked if 100 * common >= ``percent`` * united shingles of ``n_words`` words (runs
    other than space and \\x09 to \\x0D, A-Z in lower case).  With fewer words the whole sequence is the
    one shingle; a null or blank text has none and is linked with nothing.  ``component_id`` is the
    smallest id reachable by links, and the row with that id is ``kept``.  Rows that repeat an id and a
    text are all kept or none; a null id takes part but names no component unless all ids of it are
    null.  Other columns are ignored, whatever their names.  An empty table gives an empty result.
    ``percent`` below 70 raises ValueError: neighbouring sketch values are then shared too rarely.
    """
    if not 70 <= percent <= 100:
        raise ValueError("percent must be between 70 and 100")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = staged(sketches(base, n_words), "sketches")
    classes = rows.filter("n > 0").groupBy("d1", "d2", "n").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.max(F.struct("doc_id", "text_hash")).alias("rep"), F.first("sketch").alias("sketch"))
    nodes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    comp = components(links(base, nodes, n_words, percent, long_list))
    named = staged(comp.join(nodes.select("node", "first_id"), "node"), "components")
    least = staged(named.groupBy("comp").agg(F.min("first_id").alias("component_id"), F.count("*").alias("m")), "names")
    total, largest = _sizes(least, "m")
    names = lookup(named, least, ["comp"], "m", total, F.xxhash64("node"), "left", largest).select(F.col("node").alias("_node"), "component_id")
    labelled = nodes.join(names, F.col("node") == F.col("_node"), "left").select("d1", "d2", "n", "copies", F.coalesce("component_id", "first_id").alias("component_id"))
    labelled = staged(labelled, "labelled")
    total, largest = _sizes(labelled, "copies")
    out = lookup(rows.drop("sketch"), labelled, ["d1", "d2", "n"], "copies", total, F.xxhash64("doc_id", "text_hash"), "left", largest)
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns."""
    found = near_duplicates(docs, id_col, text_col, **kwargs).filter("not kept").select(F.col("doc_id").alias("_near_id"), F.col("text_hash").alias("_near_hash")).distinct()
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_near_id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("_near_hash"))
    return docs.join(found, same, "left_anti")
