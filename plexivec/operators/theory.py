"""Checks of the theory: distances of embeddings against distances of sequences."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexivec.functions.names import mutate, mutate_places
from plexivec.functions.stats import exact_quantiles
from plexivec.functions.vectors import l2sq
from plexivec.operators.basis import fit_projection, transform
from plexivec.operators.embedding import MAX_PROTOTYPES, embedder, sequence_distances
from plexivec.operators.evaluate import spearman
from plexivec.operators.metric_index import Rows
from plexivec.operators.neighbors import PAIR_SUMS, TILE, _exact2, correlation, distance_corr, join_within, sums_of_pairs, weights_within
from plexivec.operators.strings import one_mismatch_counts
from plexivec.plans.batches import spread
from plexivec.plans.staging import staged

#: Rows whose embeddings are compared at once.
BATCH = 1024

def _pairs(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """All pairs of a small sample (a check, at most as many rows as prototypes)."""
    side = lambda x: df.select(F.col(key).alias(f"k{x}"), *[F.col(c).alias(f"{c}{x}") for c in columns])
    return side(1).join(side(2), F.col("k1") < F.col("k2"))


def distance_correlation(df: DataFrame, key: str, sequence: str, prototypes: DataFrame | None = None, **kwargs) -> DataFrame:
    """One row ``r, n_pairs``: correlation of the sequences' distances with those of their embeddings.

    Pairs are all rows with ``prototypes`` (rows of ``df``; all of them if none are named), each pair once.  Rows meet the
    prototypes, which are no more than a fixed number, where they are embedded: neither embeddings nor pairs are ever written or shuffled.
    """
    order = (df if prototypes is None else prototypes).select(F.col(key).alias("proto_idx"), sequence)
    embed = embedder(df.sparkSession, order, sequence, **kwargs)
    named = order.orderBy("proto_idx").limit(MAX_PROTOTYPES).toPandas()
    ids = named["proto_idx"].to_numpy()
    shared = df.sparkSession.sparkContext.broadcast((ids, named[sequence]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, names = shared.value
        e, where = embed(names)
        protos = e[where]
        first, out = np.sort(ids), []
        for x in batches:
            e, where = embed(x[sequence])
            for i in range(0, len(x), TILE):
                own, d = x[key].to_numpy()[i : i + TILE, None], e[where[i : i + TILE]].astype(float)
                known = (first[np.minimum(np.searchsorted(first, own), len(first) - 1)] == own) if len(first) else np.zeros(own.shape, bool)
                for j in range(0, len(ids), TILE):
                    to = slice(j, j + TILE)
                    pair = (own < ids[to]) | (~known & (own != ids[to]))
                    out.append(sums_of_pairs(d[:, to][pair], np.sqrt(_exact2(d, protos[to].astype(float))[pair])))
            if out:
                out = [pd.concat(out).sum().to_frame().T]
        yield from out

    return correlation(spread(df.select(key, sequence)).mapInPandas(run, PAIR_SUMS))


def mutation_drift(df: DataFrame, prototypes: DataFrame, sequence: str, max_mut: int = 8, n_rep: int = 3, seed: int = 0, **kwargs) -> DataFrame:
    """``k, mean, std``: how far ``k`` substitutions at different interior places move an embedding.

    Only a batch's embeddings exist, within its task; its distinct sequences are embedded once.
    """
    rows = spread(df.select(F.col(sequence).alias("old")).withColumn("row", F.monotonically_increasing_id()).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n_rep)))))
    seeded = F.concat_ws(":", F.lit(str(seed)), "old", F.col("row").cast("string"), F.col("rep").cast("string"))
    runs = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(max_mut))))
    embed = embedder(df.sparkSession, prototypes, sequence, **kwargs)

    @F.pandas_udf("double")
    def moved(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for old, new in batches:
            e, where = embed(pd.concat([old, new]))
            e, out = e.astype(float), np.empty(len(old))
            for a in range(0, len(old), BATCH):
                at = slice(a, a + BATCH)
                out[at] = np.sqrt(((e[where[: len(old)][at]] - e[where[len(old) :][at]]) ** 2).sum(1))
            yield pd.Series(out)

    out = runs.select("k", moved("old", mutate_places(F.col("old"), seeded, F.col("k"))).alias("d"))
    return out.groupBy("k").agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("std")).orderBy("k")


def prototype_correlation(df: DataFrame, one: DataFrame, other: DataFrame, key: str, sequence: str, **kwargs) -> DataFrame:
    """One row ``r``: correlation of all distances between rows under two sets of prototypes."""
    e = sequence_distances(sequence_distances(df.select(key, sequence), one, sequence, "x", **kwargs), other, sequence, "y", **kwargs)
    return distance_corr(staged(e, "theory"), key, "x", "y").select("r")


def neighbour_convergence(df: DataFrame, prototypes: DataFrame, key: str, sequence: str, n_components: int = 25, scales: Sequence[float] = (0.5, 1.0, 1.5, 2.0, 3.0), seed: int = 0) -> DataFrame:
    """``scale, radius, rho``: rank correlation of counts in balls with counts of sequences one letter away.

    The radius is a multiple of the median way that one substitution moves a row.  Equal sequences are one weighted point, and
    all radii are counted in one join.
    """
    changed = spread(df.select(key, sequence)).withColumn("_new", mutate(F.col(sequence), F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    e = sequence_distances(changed, prototypes, sequence, "e0")
    basis = fit_projection(e, "e0", n_components, key=key)
    e = sequence_distances(e, prototypes.select("proto_idx", F.col(sequence).alias("_new")), "_new", "e1")
    z = staged(transform(transform(e, basis, "e0", "z0"), basis, "e1", "z1").select(key, sequence, "z0", F.sqrt(l2sq("z0", "z1")).alias("moved")), "theory")
    r1 = exact_quantiles(z, F.col("moved"), [0.5])[0]
    kinds = z.groupBy(F.col(sequence).alias("_s")).agg(F.min(key).alias("_id"), F.first("z0").alias("v"), F.count("*").cast("double").alias("w"))
    kinds = staged(kinds, "kinds")
    radii = [r1 * scale for scale in scales]
    names = [f"n{i}" for i in range(len(radii))]

    def counted(x: Rows, y: Rows) -> pd.DataFrame:
        return pd.DataFrame({"_id": x["_id"]} | {c: weights_within(x["v"], y["v"], np.full(len(x["v"]), r * r), y["w"]) for c, r in zip(names, radii)})

    points = kinds.select("_id", "v", "w")
    met = join_within(points, points, counted, ", ".join(["_id bigint", *[f"{c} double" for c in names]]), max(radii))
    near = one_mismatch_counts(df, key, sequence, "near").withColumnRenamed(key, "_id")
    counts = met.groupBy("_id").agg(*[F.sum(c).alias(c) for c in names]).join(near, "_id").join(kinds.select("_id", "w"), "_id")
    # equal sequences have equal counts of both kinds, so rows go to the ranks as many times as there are of them
    counts = staged(counts.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("w").cast("int")))).select("near", *names), "counts")
    rows = [(float(scale), float(r), spearman(counts, c, "near").first()["rho"]) for scale, r, c in zip(scales, radii, names)]
    return df.sparkSession.createDataFrame(rows, "scale double, radius double, rho double")
