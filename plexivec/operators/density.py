"""Finding locally over-dense records against a background."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexivec.functions.stats import benjamini_hochberg, binomial_tail, exact_quantiles, fisher_combine, gamma_tail, poisson_tail, running_sums, size_weight
from plexivec.operators.neighbors import ball_counts, check_backend, found_within, nearest
from plexivec.plans.skew import lookup_value
from plexivec.plans.staging import staged


def balloon_k(lambda0: float, n_obs: int, n_bg: int) -> int:
    """Background neighbours that fix a ball's radius: ``lambda0`` expected observed ones, rounded half to even."""
    return min(max(int(round(lambda0 * n_bg / max(n_obs - 1, 1))), 1), n_bg)


def neighbor_enrichment(obs: DataFrame, bg: DataFrame, key: str, vector: str, radius2: float | None = None, lambda0: float = 3.0, test: str = "poisson", pseudocount: float = 1.0, calibrate: str | None = "median", abundance: str | None = None, weight: str = "log1p", orphan: bool = True, backend: str = "kdtree", k_max: int = 96) -> DataFrame:
    """For every observed vector: is its ball fuller than the background lets expect?

    Returns ``key, n_obs, n_bg, expected, fold, pvalue, qvalue, radius`` and, with ``abundance``, ``score,
    p_breadth, p_size``.  With ``radius2`` all balls have that squared radius; else each reaches to the k-th
    background vector (``balloon_k``) and ``radius`` is the median one.  Balls include their border and not
    their centre.  ``calibrate`` scales expectations up so that their median is the observed one.
    With ``abundance`` the mass of a ball is a sum of size weights, tested by a gamma tail and, if
    ``orphan``, combined with the share of rows at least as abundant.

    ``backend`` is how neighbours are found: ``kdtree`` and ``exact`` agree, by the metric index and by all pairs;
    ``ann`` looks for the ``k_max`` nearest in a few cells and counts those within the radius, so counts may be too
    small, never too large, and takes a balloon's background as the k that set its radius.  It warns if a ball holds
    all ``k_max`` neighbours.
    """
    check_backend(backend)
    if test not in ("poisson", "binomial"):
        raise ValueError(f"unknown test {test!r}")
    if calibrate not in ("median", None):
        raise ValueError(f"unknown calibrate {calibrate!r}")
    if pseudocount <= 0:
        raise ValueError("pseudocount must be positive")
    if abundance:
        size_weight(F.lit(1.0), weight)
    n_obs, n_bg = obs.count(), bg.count()
    if not n_obs or not n_bg:
        raise ValueError("empty input")
    own = obs.select(F.col(key), F.col(vector), *([F.col(abundance).cast("double").alias("_a")] if abundance else []))
    if radius2 is None:
        k = balloon_k(lambda0, n_obs, n_bg)
        reach = nearest(own, bg, key, vector, k, backend=backend).filter(F.col("rank") == k).select(key, F.col("d2").alias("_r2"))
        own = staged(own.join(reach, key), "balls")
    else:
        own = own.withColumn("_r2", F.lit(float(radius2)))
    if backend == "ann":
        counts, full = found_within(own, own, key, vector, "_r2", min(k_max, n_obs), "n_obs")
        if full:
            warnings.warn(f"{full} balls hold all {k_max} neighbours looked for and are undercounted; raise k_max or choose another backend", stacklevel=2)
        counts = counts.withColumn("n_obs", F.col("n_obs") - 1)
        in_bg = own.select(key, F.lit(k).cast("long").alias("n_bg")) if radius2 is None else found_within(own, bg, key, vector, "_r2", min(k_max, n_bg), "n_bg")[0]
    else:
        counts = ball_counts(own, own, key, vector, radius_col="_r2", output="n_obs", backend=backend).withColumn("n_obs", F.col("n_obs") - 1)
        in_bg = ball_counts(own, bg, key, vector, radius_col="_r2", output="n_bg", backend=backend)
    rows = own.join(counts, key).join(in_bg, key)
    p_bg = (F.col("n_bg") + pseudocount) / (n_bg + pseudocount)
    rows = rows.withColumn("_raw", F.lit(float(max(n_obs - 1, 1))) * p_bg)
    radius = float(radius2) ** 0.5 if radius2 is not None else exact_quantiles(own, F.sqrt("_r2"), [0.5])[0]
    if abundance:
        rows = rows.withColumn("_g", size_weight(F.col("_a"), weight))
        mass = ball_counts(rows.select(key, vector, "_r2", "_g"), rows.select(key, vector, "_g"), key, vector, radius_col="_r2", weight_col="_g", output="_mass", backend="kdtree" if backend == "ann" else backend)
        rows = staged(rows.join(mass, key).withColumn("score", F.col("_mass") - F.col("_g")), "mass")
        mean, square = rows.agg(F.avg("_g"), F.avg(F.col("_g") * F.col("_g"))).first()
        rows = rows.withColumn("_mu", F.col("_raw") * F.lit(mean))
        factor = _level(rows, "score", "_mu") if calibrate else 1.0
        phi = square / mean
        rows = rows.withColumn("expected", F.col("_mu") * factor)
        rows = rows.withColumn("p_breadth", gamma_tail("score", F.greatest(F.col("expected") / phi, F.lit(1e-6)), F.lit(phi)))
        rows = rows.withColumn("fold", F.when(F.col("expected") > 0, F.col("score") / F.col("expected")).otherwise(1.0))
        rows = size_survival(rows, "_a", "p_size")
        rows = rows.withColumn("pvalue", fisher_combine(F.col("p_breadth"), F.col("p_size")) if orphan else F.col("p_breadth"))
    else:
        rows = staged(rows, "counts")
        factor = _level(rows, "n_obs", "_raw") if calibrate else 1.0
        rows = rows.withColumn("expected", F.col("_raw") * factor)
        tail = poisson_tail(F.col("n_obs"), F.col("expected")) if test == "poisson" else binomial_tail(F.col("n_obs"), F.lit(max(n_obs - 1, 1)), F.greatest(F.least(F.col("expected") / max(n_obs - 1, 1), F.lit(1.0)), F.lit(0.0)))
        rows = rows.withColumn("pvalue", tail).withColumn("fold", F.col("n_obs") / F.col("expected"))
    rows = benjamini_hochberg(rows.withColumn("radius", F.lit(radius)))
    extra = ["score", "p_breadth", "p_size"] if abundance else []
    return rows.select(key, "n_obs", "n_bg", "expected", "fold", "pvalue", "qvalue", "radius", *extra)


def _level(rows: DataFrame, seen: str, expected: str) -> float:
    """The factor, at least 1, that brings the median expectation to the median observed."""
    some = rows.filter(F.col(expected) > 0)
    s, e = (exact_quantiles(some, F.col(c), [0.5])[0] for c in (seen, expected))
    return max(s / e, 1.0) if e else 1.0


def size_survival(rows: DataFrame, size: str, output: str) -> DataFrame:
    """``rows`` with the share of rows whose ``size`` is at least theirs; counts of distinct sizes are ranked, not rows.  Rows without a size stay, without a share."""
    sizes = rows.filter(F.col(size).isNotNull()).groupBy(size).agg(F.count("*").alias("_n"))
    upto = staged(running_sums(sizes, [F.desc(size)], ["_n"]).select(size, "_n", F.col("_n_upto").alias("_more")), "sizes")
    total = upto.agg(F.max("_more")).first()[0]
    return lookup_value(rows, size, upto, "_n", total or 0).withColumn(output, F.col("_more") / F.lit(total)).drop("_more")


def enriched_mask(rows: DataFrame, alpha: float = 0.05, min_fold: float = 1.0, min_neighbors: int = 2) -> Column:
    """The rows that are hits: by q-value alone if there is a ``score``, else also by fold and neighbours."""
    hit = F.col("qvalue") < alpha
    if "score" in rows.columns:
        return hit
    return hit & (F.col("fold") > min_fold) & (F.col("n_obs") >= min_neighbors - 1)
