"""Density clustering of vectors, and scores of clusters against labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plexivec.functions.stats import exact_quantiles
from plexivec.operators.metric_index import Rows
from plexivec.operators.neighbors import ACROSS, BLOCK, TILE, ball_counts, check_backend, join_within, nearest, tiles_within
from plexivec.plans.components import components
from plexivec.plans.numbering import numbered
from plexivec.plans.staging import staged


def knee(sorted_values: np.ndarray, degree: int = 7) -> float | None:
    """Value at the knee of a convex, rising curve (Satopaa et al., 2011) after a polynomial fit; None if there is none."""
    n = len(sorted_values)
    if n < 3 or sorted_values[-1] <= sorted_values[0]:
        return None
    x = np.linspace(0, 1, n)
    y = np.polyval(np.polyfit(x, sorted_values, min(degree, n - 1)), x)
    y = (y - y.min()) / max(y.max() - y.min(), 1e-300)
    gap = x - y  # a convex rising curve lies below the diagonal, most at the knee
    peaks = [i for i in range(1, n - 1) if gap[i] >= gap[i - 1] and gap[i] > gap[i + 1]]
    return float(sorted_values[max(peaks, key=lambda i: gap[i])]) if peaks else None


def knee_of_column(df: DataFrame, value: str, degree: int = 7, direct: int = 2000) -> float | None:
    """``knee`` of all values in order, nulls left out: every value has its place, and the polynomial is fitted to all of them.

    Up to ``direct`` values are sorted on the driver.  More are numbered by a range sort; the fit is one aggregate
    of products with Chebyshev polynomials of the place, whose own products are such sums again.  The driver
    holds the coefficients, and the knee is where the slope of the polynomial is that of the diagonal.
    """
    v = staged(df.select(F.col(value).cast("double").alias("v")).filter("v is not null"), "curve")
    n = v.count()
    if n <= direct:
        return knee(np.sort(np.array([r[0] for r in v.collect()], float)), degree)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = numbered(v.repartitionByRange(parts, "v").sortWithinPartitions("v"), "i")
    x = F.col("i") * (2.0 / (n - 1)) - 1
    rows = placed.select("v", F.transform(F.array(*[F.lit(k) for k in range(2 * degree + 1)]), lambda k: F.cos(k * F.acos(F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0))))).alias("t"))
    sums = rows.agg(F.min("v").alias("low"), F.max("v").alias("high"), *[F.sum(F.col("t")[k]).alias(f"t{k}") for k in range(2 * degree + 1)], *[F.sum(F.col("t")[k] * F.col("v")).alias(f"y{k}") for k in range(degree + 1)]).first()
    if sums["high"] <= sums["low"]:
        return None
    pairs = [[(sums[f"t{i + j}"] + sums[f"t{abs(i - j)}"]) / 2 for j in range(degree + 1)] for i in range(degree + 1)]
    fit = np.polynomial.Chebyshev(np.linalg.solve(np.array(pairs), np.array([sums[f"y{k}"] for k in range(degree + 1)])))
    between = lambda f: [z.real for z in f.roots() if abs(z.imag) < 1e-9 and -1 < z.real < 1]
    ends = fit(np.array([-1.0, 1.0, *between(fit.deriv())]))
    gap = np.polynomial.Chebyshev([0.5, 0.5]) - (fit - ends.min()) / max(ends.max() - ends.min(), 1e-300)
    peaks = [z for z in between(gap.deriv()) if gap.deriv(2)(z) < 0]
    if not peaks:
        return None
    place = (max(peaks, key=gap) + 1) / 2 * (n - 1)
    at = max({int(place), min(int(place) + 1, n - 1)}, key=lambda i: gap(2.0 * i / (n - 1) - 1))
    return placed.filter(F.col("i") == at).first()["v"]


def estimate_eps(df: DataFrame, key: str, vector: str, k: int = 4) -> float:
    """Knee of the curve of distances to the ``k``-th nearest, the point itself counted; the median without a knee.

    Every row is a point of the curve.
    """
    d = staged(nearest(df, df, key, vector, k).filter(F.col("rank") == k).select(F.sqrt("d2").alias("d")), "kth")
    found = knee_of_column(d, "d")
    return found if found is not None else exact_quantiles(d, F.col("d"), [0.5])[0]


def spanning_links(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) that connect whatever the matrix of links between rows and columns connects, fewer than rows and columns together."""
    rows, columns = np.ones(linked.shape[0], bool), np.ones(linked.shape[1], bool)  # not yet met
    out = []
    for start in np.flatnonzero(linked.any(1)).tolist():
        if not rows[start]:
            continue
        rows[start], stack = False, [(True, start)]
        while stack:
            is_row, i = stack.pop()
            new = np.flatnonzero(linked[i] & columns if is_row else linked[:, i] & rows).tolist()
            (columns if is_row else rows)[new] = False
            out += [(i, j) if is_row else (j, i) for j in new]
            stack += [(not is_row, j) for j in new]
    return out


def forest_of_links(x: np.ndarray, y: np.ndarray, ids: np.ndarray, others: np.ndarray, r2: float) -> list[tuple[int, int]]:
    """Pairs of ids that connect whatever all pairs within the radius connect, fewer than rows; each with itself if both sides have it.

    Tiles of rows that are connected already are not looked at.
    """
    names, node = np.unique(np.concatenate([ids, others]), return_inverse=True)
    up, (one, other) = np.arange(len(names)), (node[: len(ids)], node[len(ids) :])
    out = [(int(i), int(i)) for i in np.intersect1d(ids, others)]

    def joined(i: int, j: int) -> bool:
        a, b = up[one[i : i + TILE]], up[other[j : j + ACROSS]]
        return bool((a == a[0]).all() and (b == a[0]).all())

    for i, j, inside in tiles_within(x, y, np.full(len(x), r2), joined):
        a, b = one[i : i + len(inside)], other[j : j + inside.shape[1]]
        while True:
            apart = inside & (up[a][:, None] != up[b][None, :])
            rows, columns = np.flatnonzero(apart.any(1)), np.flatnonzero(apart.any(0))
            if not len(rows):
                break
            new = list(zip(a[rows].tolist(), b[apart[rows].argmax(1)].tolist())) + list(zip(a[apart[:, columns].argmax(0)].tolist(), b[columns].tolist()))
            top = {int(r): int(r) for r in np.unique(up[np.array(new).ravel()])}

            def root(k: int) -> int:
                while top[k] != k:  # noqa: B023
                    top[k] = k = top[top[k]]  # noqa: B023
                return k

            for p, q in new:
                u, v = root(int(up[p])), root(int(up[q]))
                if u != v:
                    top[max(u, v)] = min(u, v)
                    out.append((int(names[p]), int(names[q])))
            ends = np.arange(len(names))
            ends[list(top)] = [root(k) for k in list(top)]
            up = ends[up]
    return out


def dbscan(df: DataFrame, key: str, vector: str, eps: float | None = None, min_samples: int = 3, k: int = 4, eps_factor: float = 0.4, backend: str = "kdtree", block: int = BLOCK) -> DataFrame:
    """``key, cluster``: the smallest core key of the cluster, -1 for noise.

    Core points have ``min_samples`` points within ``eps``, themselves counted; clusters are the components
    of core points within ``eps``; another point within ``eps`` of core points goes to the smallest cluster.
    There is never a row for each pair: core points are told by counts, a pair of blocks of core points gives a
    spanning forest of its links, and other points get the smallest cluster that a block has within ``eps``.
    Rows with a null vector are noise.
    """
    check_backend(backend)
    if eps is None:
        eps = estimate_eps(df, key, vector, k) * eps_factor
    r2 = float(eps) ** 2
    degree = ball_counts(df, df, key, vector, r2, output="_n", block=block, backend=backend)
    points = staged(df.select(F.col(key).alias("_id"), F.col(vector).alias("v")).join(degree.withColumnRenamed(key, "_id"), "_id").withColumn("core", F.col("_n") >= min_samples), "points")
    core = points.filter("core").select("_id", "v")

    def forest(x: Rows, y: Rows) -> pd.DataFrame:
        return pd.DataFrame(forest_of_links(x["v"], y["v"], x["_id"], y["_id"], r2), columns=["a", "b"])

    comp = components(join_within(core, core, forest, "a bigint, b bigint", float(eps), block, backend, once=True))
    labelled = staged(core.join(comp.select(F.col("node").alias("_id"), F.col("comp").alias("cluster")), "_id"), "labels")

    def least(x: Rows, y: Rows) -> pd.DataFrame:
        none, order = np.iinfo(np.int64).max, np.argsort(y["cluster"], kind="stable")
        named, best = y["cluster"][order], np.full(len(x["v"]), np.iinfo(np.int64).max)
        settled = lambda i, j: bool((best[i : i + TILE] <= named[j]).all())
        for i, j, inside in tiles_within(x["v"], y["v"][order], np.full(len(x["v"]), r2), settled):
            first = np.where(inside.any(1), named[j + inside.argmax(1)], none)
            best[i : i + len(inside)] = np.minimum(best[i : i + len(inside)], first)
        there = best < none
        return pd.DataFrame({"_id": x["_id"][there], "near": best[there]})

    others = points.filter("not core and v is not null").select("_id", "v")
    border = join_within(others, labelled, least, "_id bigint, near bigint", float(eps), block, backend).groupBy("_id").agg(F.min("near").alias("cluster"))
    found = labelled.select("_id", "cluster").unionByName(border)
    return points.select("_id").join(found, "_id", "left").select(F.col("_id").alias(key), F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))


def _from_pairs(points: DataFrame, key: str, pairs: DataFrame, min_samples: int) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy(F.col("a").alias("_id")).agg(F.count("*").alias("n"))
    core = points.select(F.col(key).alias("_id")).join(degree, "_id", "left").filter(F.coalesce("n", F.lit(0)) + 1 >= min_samples).select("_id")
    core = staged(core, "core")
    edges = pairs.join(core.withColumnRenamed("_id", "a"), "a").join(core.withColumnRenamed("_id", "b"), "b").select("a", "b")
    comp = components(edges)
    labelled = staged(core.join(comp, F.col("_id") == F.col("node"), "left").select("_id", F.coalesce("comp", "_id").alias("cluster")), "labels")
    border = both.join(labelled.withColumnRenamed("_id", "b"), "b").groupBy(F.col("a").alias("_id")).agg(F.min("cluster").alias("near"))
    out = points.join(labelled, F.col(key) == labelled["_id"], "left").drop("_id").join(border, F.col(key) == border["_id"], "left").drop("_id")
    return out.select(key, F.coalesce("cluster", "near", F.lit(-1).cast("long")).alias("cluster"))


def cluster(df: DataFrame, key: str, vector: str, method: str = "dbscan", **kwargs) -> DataFrame:
    """Clusters by method name, ``dbscan`` or ``hdbscan``; ValueError for one that is not there."""
    from plexivec.operators.hierarchy import hdbscan

    methods = {"dbscan": dbscan, "hdbscan": hdbscan}
    if method not in methods:
        raise ValueError(f"unknown method {method!r}; choose one of {sorted(methods)}")
    return methods[method](df, key, vector, **kwargs)


def cluster_hits(df: DataFrame, mask: str, key: str, vector: str, least: int = 5, **kwargs) -> DataFrame:
    """``key, cluster`` where only rows with a true ``mask`` are clustered; fewer than ``least`` of them stay -1."""
    hits = staged(df.filter(F.col(mask)).select(key, vector), "hits")
    if hits.count() < least:
        return df.select(key, F.lit(-1).cast("long").alias("cluster"))
    return df.select(key).join(dbscan(hits, key, vector, **kwargs), key, "left").select(key, F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))


def cluster_samples(distances: DataFrame, eps: float | None = None, min_samples: int = 3, k: int = 4) -> DataFrame:
    """``sample, cluster`` by DBSCAN on a long distance matrix (``id_a, id_b, dist``).

    ``eps`` is by default the median distance to the ``k``-th other sample, 1 if that is 0.
    """
    if eps is None:
        n = distances.select("id_a").distinct().count()
        rank = F.row_number().over(W.partitionBy("id_a").orderBy("dist", F.col("id_a") != F.col("id_b"), "id_b"))
        kth = distances.withColumn("r", rank).filter(F.col("r") == min(k, n - 1) + 1)
        eps = exact_quantiles(kth, F.col("dist"), [0.5])[0] or 1.0
    pairs = staged(distances.filter((F.col("id_a") < F.col("id_b")) & (F.col("dist") <= eps)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), "pairs")
    return _from_pairs(distances.select(F.col("id_a").alias("sample")).distinct(), "sample", pairs, min_samples)


def cluster_metrics(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """``label, n, f1, precision, recall, retention`` for every label.

    A cluster predicts its most frequent label, the smaller name on ties.  Precision is over rows in
    clusters with that prediction, recall over the label's clustered rows, retention is the clustered
    share of all its rows.  Noise is -1.
    """
    counts = df.groupBy(F.col(cluster).alias("c"), F.col(label).alias("l")).agg(F.count("*").alias("n"))
    best = counts.filter("c <> -1").withColumn("r", F.row_number().over(W.partitionBy("c").orderBy(F.desc("n"), "l"))).filter("r = 1").select("c", F.col("l").alias("says"))
    j = counts.join(best, "c", "left")
    truth = j.groupBy("l").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("c") != -1, F.col("n")).otherwise(0)).alias("kept"), F.sum(F.when(F.col("says") == F.col("l"), F.col("n")).otherwise(0)).alias("tp"))
    said = j.filter("says is not null").groupBy("says").agg(F.sum("n").alias("predicted"))
    t = truth.join(said, F.col("l") == F.col("says"), "left")
    share = lambda a, b: F.when(F.coalesce(F.col(b), F.lit(0)) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    t = t.withColumn("precision", share("tp", "predicted")).withColumn("recall", share("tp", "kept")).withColumn("retention", share("kept", "n"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return t.select(F.col("l").alias("label"), "n", f1.alias("f1"), "precision", "recall", "retention")
