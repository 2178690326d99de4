"""Embedding records as their distances to a fixed, ordered set of prototypes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexivec.functions.names import allele_to_major, allele_with_default, strip_allele
from plexivec.functions.vectors import as_metric, l2sq, require_columns

#: Prototypes are a parameter of the coordinate system: no more than this many, so they may be broadcast.
MAX_PROTOTYPES = 10_000
#: Alleles of one component of a species: no more than this many, so names and distances may be broadcast.
MAX_ALLELES = 5_000
RESIDUES = "ARNDCQEGHILKMFPSTWYV"
GAP_POSITIONS = (3, 4, -4, -3)
# BLOSUM62 (Henikoff and Henikoff, 1992), lower triangle in the order of RESIDUES.
BLOSUM62 = """
 4
-1  5
-2  0  6
-2 -2  1  6
 0 -3 -3 -3  9
-1  1  0  0 -3  5
-1  0  0  2 -4  2  5
 0 -2  0 -1 -3 -2 -2  6
-2  0  1 -1 -3  0  0 -2  8
-1 -3 -3 -3 -1 -3 -3 -4 -3  4
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""


def substitution(matrix: np.ndarray | None = None) -> np.ndarray:
    """A symmetric 20 x 20 similarity in the order of RESIDUES; BLOSUM62 unless one is given."""
    if matrix is not None:
        return np.asarray(matrix, float)
    rows = [list(map(float, line.split())) for line in BLOSUM62.strip().splitlines()]
    out = np.zeros((20, 20))
    for i, row in enumerate(rows):
        out[i, : i + 1] = out[: i + 1, i] = row
    return out


def gram(similarity: np.ndarray) -> np.ndarray:
    """``s[x, x] + s[y, y] - 2 s[x, y]``: the squared distance that belongs to a similarity."""
    d = np.diag(similarity)
    return d[:, None] + d[None, :] - 2 * similarity


def _codes(sequences: Sequence[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sequences by length: their places and letters as numbers; letters that are no residue count as the last."""
    table = np.full(0x110000, 19, np.int8)
    table[[ord(c) for c in RESIDUES]] = np.arange(20)
    groups: dict[int, list[int]] = {}
    for i, s in enumerate(sequences):
        groups.setdefault(len(s or ""), []).append(i)
    letters = lambda at: np.frombuffer("".join(sequences[i] or "" for i in at).encode("utf-32-le", "surrogatepass"), np.uint32)
    return {n: (np.array(at), table[letters(at)].reshape(len(at), n)) for n, at in groups.items()}


def gapblock(queries: Sequence[str], refs: Sequence[str], cost: np.ndarray, positions: Sequence[int] = GAP_POSITIONS, gap_open: float = 8.0, gap_extend: float = 1.0) -> np.ndarray:
    """Costs of the best alignment with one block of gaps in the shorter sequence.

    Equal lengths: the sum of ``cost``.  Else the shorter (length m) gets one block at one of
    ``positions`` (negative ones from its end, all kept within 0 .. m), for ``gap_open`` and
    ``gap_extend`` for every gap but the first; the cheapest counts.  A letter costs the same wherever it
    stands before the block or after it, so a sum over letters is a product of a matrix of costs by letter
    and place with codes of the other side, and places that two blocks have in common are summed once.
    """
    cost = np.asarray(cost, np.float32)
    out = np.zeros((len(queries), len(refs)), np.float32)
    right = [(to, r, _one_hot(r)) for to, r in _codes(refs).values()]
    for at, q in _codes(queries).values():
        for to, r, hot in right:
            n, m = q.shape[1], r.shape[1]
            if n == m:
                best = _sums(cost, q, hot, 0, 0, n)
            else:
                gap, short = abs(n - m), min(n, m)
                cuts = sorted({min(max(p if p >= 0 else short + p, 0), short) for p in positions})
                shift = (gap, 0) if n > m else (0, gap)  # the longer side's letters after the block are further on
                heads = [_sums(cost, q, hot, a, a, b - a) for a, b in zip([0, *cuts], cuts)]
                tails = [_sums(cost, q, hot, a + shift[0], a + shift[1], b - a) for a, b in zip(cuts, [*cuts[1:], short])]
                total = heads[0] + sum(tails)
                best = total
                for k in range(1, len(cuts)):
                    total = total + heads[k] - tails[k - 1]
                    best = np.minimum(best, total)
                best = best + np.float32(gap_open + (gap - 1) * gap_extend)
            out[np.ix_(at, to)] = best
    return out


def _one_hot(codes: np.ndarray) -> np.ndarray:
    """For each sequence 20 numbers a place, a single 1 among them."""
    return np.eye(20, dtype=np.float32)[codes.reshape(-1)].reshape(len(codes), -1)


def _sums(cost: np.ndarray, q: np.ndarray, hot: np.ndarray, i: int, j: int, n: int) -> np.ndarray:
    """Sums of the costs of ``n`` letters from place ``i`` of every query with those from place ``j`` of every reference."""
    if n <= 0:
        return np.zeros((len(q), len(hot)), np.float32)
    return cost[q[:, i : i + n]].reshape(len(q), -1) @ hot[:, 20 * j : 20 * (j + n)].T


def _pairs_by_length(a: Sequence[str], b: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of sequences by their two lengths: their places in the lists and their letters as numbers."""
    left, right = _codes(a), _codes(b)
    out = []
    for at, x in left.values():
        for to, y in right.values():
            both, i, j = np.intersect1d(at, to, assume_unique=True, return_indices=True)
            if len(both):
                out.append((both, x[i].astype(np.int64), y[j].astype(np.int64)))
    return out


def smith_waterman_scores(a: Sequence[str], b: Sequence[str], similarity: np.ndarray, gap: float = 1.0) -> np.ndarray:
    """Best local alignment scores with linear gaps of each ``a`` with its ``b``; a step of the recursion is one for all pairs of the same lengths.

    Along a row a gap costs the same for each letter, so the recursion from the left is a running maximum.
    """
    out = np.zeros(len(a))
    for at, x, y in _pairs_by_length(a, b):
        above, best = np.zeros((len(at), y.shape[1] + 1)), np.zeros(len(at))
        slope = gap * np.arange(y.shape[1] + 1)
        for i in range(x.shape[1]):
            row = np.zeros_like(above)
            row[:, 1:] = np.maximum(np.maximum(above[:, :-1] + similarity[x[:, i, None], y], above[:, 1:] - gap), 0)
            row = np.maximum.accumulate(row + slope, axis=1) - slope
            best, above = np.maximum(best, row.max(1)), row
        out[at] = best
    return out


def smith_waterman(a: str, b: str, similarity: np.ndarray, gap: float = 1.0) -> float:
    """Best local alignment score with linear gaps."""
    return float(smith_waterman_scores([a], [b], similarity, gap)[0])


def needleman_wunsch_scores(a: Sequence[str], b: Sequence[str], similarity: np.ndarray, gap_open: float = 12.0, gap_extend: float = 1.0) -> np.ndarray:
    """Best global alignment scores with affine gaps (Gotoh, 1982) of each ``a`` with its ``b``, pairs of the same lengths at once.

    A gap along a row that is opened from another one costs no less than one gap from where the first
    began, so the best is a running maximum.  ValueError if opening a gap costs less than extending one.
    """
    if gap_open < gap_extend:
        raise ValueError("gap_open must not be below gap_extend")
    out = np.zeros(len(a))
    for at, x, y in _pairs_by_length(a, b):
        n = y.shape[1]
        reach = gap_open + gap_extend * (np.arange(n + 1) - 1.0)
        reach[0] = 0.0
        m = np.broadcast_to(-reach, (len(at), n + 1)).copy()
        up = np.full((len(at), n + 1), -1e18)
        slope = gap_extend * np.arange(n + 1)
        for i in range(x.shape[1]):
            up = np.maximum(m - gap_open, up - gap_extend)
            row = np.empty_like(m)
            row[:, 0] = -gap_open - gap_extend * i
            row[:, 1:] = np.maximum(m[:, :-1] + similarity[x[:, i, None], y], up[:, 1:])
            up[:, 0] = -1e18
            best = np.maximum.accumulate(row + slope, axis=1)[:, :-1] - slope[1:] - gap_open + gap_extend
            row[:, 1:] = np.maximum(row[:, 1:], best)
            m = row
        out[at] = m[:, -1]
    return out


def needleman_wunsch(a: str, b: str, similarity: np.ndarray, gap_open: float = 12.0, gap_extend: float = 1.0) -> float:
    """Best global alignment score with affine gaps."""
    return float(needleman_wunsch_scores([a], [b], similarity, gap_open, gap_extend)[0])


def embedder(spark: SparkSession, prototypes: DataFrame, sequence: str, metric: str = "squared", alignment: str = "gapblock", matrix: np.ndarray | None = None, positions: Sequence[int] = GAP_POSITIONS) -> Callable[[pd.Series], tuple[np.ndarray, np.ndarray]]:
    """For tasks: of a batch of sequences the distances of each distinct one to the prototypes, and the row of every sequence among them."""
    if alignment not in ("gapblock", "sw"):
        raise ValueError(f"unknown alignment {alignment!r}")
    if alignment == "sw" and matrix is not None:
        raise ValueError("sw takes no matrix")
    as_metric(F.lit(0.0), metric)
    shared = spark.sparkContext.broadcast((_collected(prototypes, sequence), substitution(matrix)))

    def embed(batch: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        refs, s = shared.value
        values, where = np.unique(batch.fillna("").to_numpy(str), return_inverse=True)
        if alignment == "gapblock":
            d = gapblock(list(values), refs, gram(s), positions)
        else:
            own, mine = smith_waterman_scores(refs, refs, s), smith_waterman_scores(list(values), list(values), s)
            met = smith_waterman_scores(np.repeat(values, len(refs)).tolist(), refs * len(values), s).reshape(len(values), len(refs))
            d = (mine[:, None] + own[None, :] - 2 * met).astype(np.float32)
        return np.sqrt(np.maximum(d, 0)) if metric == "sqrt" else d, where

    return embed


def sequence_distances(df: DataFrame, prototypes: DataFrame, sequence: str = "junction_aa", output: str = "d_seq", **kwargs) -> DataFrame:
    """``df`` with the distances of ``sequence`` to the prototypes, in their order, as ``array<float>``.

    ``prototypes`` has ``proto_idx`` and the sequence.  ``alignment`` is ``gapblock`` or ``sw`` (then
    distances come from local BLOSUM62 scores with gaps of 1, and ``matrix`` must not be given).
    A null sequence is the empty one.  Distinct sequences of a batch are scored once.
    """
    embed = embedder(df.sparkSession, prototypes, sequence, **kwargs)

    @F.pandas_udf("array<float>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            d, where = embed(batch)
            yield pd.Series(list(d[where]))

    return df.withColumn(output, scored(F.col(sequence)))


def _collected(prototypes: DataFrame, column: str) -> list[str]:
    rows = prototypes.select("proto_idx", column).orderBy("proto_idx").limit(MAX_PROTOTYPES + 1).collect()
    if len(rows) > MAX_PROTOTYPES:
        raise ValueError(f"more than {MAX_PROTOTYPES} prototypes")
    return [r[column] or "" for r in rows]


def vector_embed(df: DataFrame, prototypes: DataFrame, key: str, vector: str, metric: str = "squared") -> DataFrame:
    """``key, proto_idx, d``: distances of vectors to the prototypes (``proto_idx``, ``vector``), a row a pair."""
    require_columns(df, [key, vector])
    if len(prototypes.select("proto_idx").limit(MAX_PROTOTYPES + 1).collect()) > MAX_PROTOTYPES:
        raise ValueError(f"more than {MAX_PROTOTYPES} prototypes")
    p = prototypes.select("proto_idx", F.col(vector).alias("_proto"))
    return df.select(key, vector).join(F.broadcast(p)).select(key, "proto_idx", as_metric(l2sq(vector, "_proto"), metric).alias("d"))


def resolve_allele(name: Column, known: Column) -> Column:
    """The name in the array ``known`` that stands for an allele: itself, its allele 01, its bare gene, or null."""
    choices = [allele_with_default(name), allele_to_major(name), strip_allele(name)]
    return F.coalesce(*[F.when(F.array_contains(known, c), c) for c in choices])


#: Distances, 4 bytes each, of all alleles to all prototypes that are broadcast; beyond, arrays are joined by a shuffle.
MAX_BROADCAST_CELLS = 16 << 20


def _resolved(df: DataFrame, gene: str, names: list[str], output: str) -> DataFrame:
    """``df`` with the known allele that stands for ``gene``: each different name is resolved once, by a table of the names."""
    known = F.array(*map(F.lit, names))
    different = df.select(F.col(gene).alias("_gene")).distinct().withColumn(output, resolve_allele(F.col("_gene"), known))
    return df.join(different, F.col(gene).eqNullSafe(F.col("_gene")), "left").drop("_gene")


def germline_distances(df: DataFrame, distances: DataFrame, prototypes: DataFrame, gene: str, output: str) -> DataFrame:
    """``df`` with the distances of ``gene`` to every prototype's gene, in order, as ``array<float>``.

    ``distances`` has ``a, b, d`` for the alleles of one component.  A gene that does not resolve is at the
    largest distance from everything, another unresolved one and itself included.  The alleles and the
    prototypes are small tables of a species; what joins ``df`` is one array for each allele.
    """
    table = distances.select("a", "b", F.col("d").cast("float").alias("d"))
    names = [r["a"] for r in table.select("a").distinct().orderBy("a").limit(MAX_ALLELES + 1).collect()]
    if len(names) > MAX_ALLELES:
        raise ValueError(f"more than {MAX_ALLELES} alleles")
    most = float(table.agg(F.max("d")).first()[0])
    p, n = _resolved(prototypes.select("proto_idx", gene), gene, names, "b").select("proto_idx", "b"), prototypes.count()
    if n > MAX_PROTOTYPES:
        raise ValueError(f"more than {MAX_PROTOTYPES} prototypes")
    rows = table.select("a").distinct().join(F.broadcast(p)).join(table, ["a", "b"], "left")
    rows = rows.groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("proto_idx", F.coalesce("d", F.lit(most).cast("float")).alias("d")))), lambda r: r["d"]).alias(output))
    far = F.array_repeat(F.lit(most).cast("float"), n)
    rows = rows.withColumnRenamed("a", "_allele")
    if len(names) * n <= MAX_BROADCAST_CELLS:
        rows = F.broadcast(rows)
    out = _resolved(df, gene, names, "_allele").join(rows, "_allele", "left")
    return out.withColumn(output, F.coalesce(output, far)).drop("_allele")


def bake_germline(sequences: DataFrame) -> DataFrame:
    """``component, a, b, d`` from ``component, allele, seq``: distances of global alignments (gaps 12 and 1).

    Equal sequences are aligned once; the self join is within a component of one species' alleles.
    """
    distinct = sequences.select("component", "seq").distinct()
    pairs = distinct.join(distinct.withColumnRenamed("seq", "other"), "component").filter("seq <= other")

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        s = substitution()
        x, y = list(a), list(b)
        return pd.Series(needleman_wunsch_scores(x, x, s) + needleman_wunsch_scores(y, y, s) - 2 * needleman_wunsch_scores(x, y, s))

    scored = pairs.withColumn("d", distance("seq", "other"))
    both = scored.unionByName(scored.filter("seq < other").select("component", F.col("other").alias("seq"), F.col("seq").alias("other"), "d"))
    left = sequences.select("component", F.col("allele").alias("a"), "seq")
    right = sequences.select("component", F.col("allele").alias("b"), F.col("seq").alias("other"))
    return both.join(left, ["component", "seq"]).join(right, ["component", "other"]).select("component", "a", "b", "d")


def interleave(slots: Sequence[str], output: str = "embedding", metric: str = "squared") -> Column:
    """One vector ``[slot0, slot1, ...]`` for every prototype in turn, from the arrays of the slots."""
    zipped = F.arrays_zip(*slots)
    root = (lambda x: F.sqrt(F.greatest(x, F.lit(0.0))).cast("float")) if metric == "sqrt" else (lambda x: x.cast("float"))
    return F.flatten(F.transform(zipped, lambda z: F.array(*[root(z[s]) for s in slots]))).alias(output)


def clonotype_embed(df: DataFrame, prototypes: DataFrame, germline: DataFrame, mode: str = "vjcdr3", metric: str = "squared", **kwargs) -> DataFrame:
    """``df`` with ``embedding``: for every prototype its two germline distances and its junction distance.

    ``mode`` ``vjcdr3`` takes the components V and J, ``cdr123`` CDR1 and CDR2 (both by ``v_call``).
    ``germline`` has ``component, a, b, d``.  A prototype embedded has (0, 0, 0) in its own slot.
    """
    slots = {"vjcdr3": (("V", "v_call"), ("J", "j_call")), "cdr123": (("CDR1", "v_call"), ("CDR2", "v_call"))}
    if mode not in slots:
        raise ValueError(f"unknown mode {mode!r}; choose from {sorted(slots)}")
    require_columns(df, ["v_call", "j_call", "junction_aa"])
    have = {r[0] for r in germline.select("component").distinct().collect()}
    if missing := sorted({c for c, _ in slots[mode]} - have):
        raise ValueError(f"missing germline components: {missing}")
    out = df
    for i, (component, gene) in enumerate(slots[mode]):
        out = germline_distances(out, germline.filter(F.col("component") == component), prototypes, gene, f"_s{i}")
    out = sequence_distances(out, prototypes, output="_s2", **kwargs)
    return out.withColumn("embedding", interleave(["_s0", "_s1", "_s2"], metric=metric)).drop("_s0", "_s1", "_s2")


def paired_embed(chains: dict[str, DataFrame], key: str, embedding: str = "embedding") -> DataFrame:
    """One vector a key: the chains' vectors one after the other.  Keys must be the same in all chains."""
    if not chains:
        raise ValueError("no chains")
    names = list(chains)
    out = chains[names[0]].select(key, F.col(embedding).alias("_c0"), F.lit(True).alias("_h0"))
    for i, name in enumerate(names[1:], 1):
        out = out.join(chains[name].select(key, F.col(embedding).alias(f"_c{i}"), F.lit(True).alias(f"_h{i}")), key, "full")
    whole = F.lit(True)
    for i in range(len(names)):
        whole = whole & F.col(f"_h{i}").isNotNull()
    joined = F.concat(*[f"_c{i}" for i in range(len(names))])
    return out.select(key, F.when(whole, joined).otherwise(F.raise_error(F.lit("chains have different keys")).cast("array<float>")).alias(embedding))

