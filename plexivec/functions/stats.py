"""Test statistics as columns: tails of distributions, false-discovery rates, ranks."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from plexivec.plans.skew import lookup_value
from plexivec.plans.staging import staged


def size_weight(count: Column, weight: str) -> Column:
    """Weight of a clone by its size: ``distinct``, ``log1p`` or ``anscombe``."""
    kinds = {"distinct": F.lit(1.0), "log1p": F.log1p(count), "anscombe": F.sqrt(count + 0.375)}
    if weight not in kinds:
        raise ValueError(f"unknown weight {weight!r}; choose from {sorted(kinds)}")
    return kinds[weight]


#: Counts up to which logs of factorials come from a table (8 MB in a worker).
FACTORIALS = 1_000_000


def _apart(x: np.ndarray) -> np.ndarray:
    """``x`` with something tiny in place of 0."""
    return np.where(x == 0, 1e-300, x)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logs of the gamma function of positive numbers: Stirling's series from 10 on, to which smaller ones are raised."""
    x = np.asarray(x, float)
    raised = np.prod([np.where(x < 10, x + i, 1.0) for i in range(10)], axis=0)
    y = np.where(x < 10, x + 10, x)
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188 - z * 691 / 360360))))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(raised)


def gamma_parts(x: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Regularised lower and upper incomplete gamma, each without cancellation on its own side; NaN stays.

    A power series below ``shape`` + 1 and a continued fraction above run over the whole array; a number
    leaves the rounds when it no longer changes.
    """
    x, shape = (v.astype(float) for v in np.broadcast_arrays(x, shape))
    lower = np.where(np.isnan(x + shape), np.nan, np.where(np.isposinf(x), 1.0, 0.0))
    upper = 1 - lower
    with np.errstate(all="ignore"):
        front = np.exp(-x + shape * np.log(x) - log_gamma(shape))

    low = np.flatnonzero((x > 0) & (x < shape + 1))
    u, k, live = x[low], shape[low].copy(), np.arange(len(low))
    term = 1 / k
    total = term.copy()
    while len(live):
        k[live] += 1
        term[live] *= u[live] / k[live]
        total[live] += term[live]
        live = live[term[live] > 1e-16 * total[live]]
    lower[low] = np.minimum(1.0, total * front[low])
    upper[low] = 1 - lower[low]

    high = np.flatnonzero((x > 0) & (x >= shape + 1) & np.isfinite(x))
    k, b, live = shape[high], x[high] + 1 - shape[high], np.arange(len(high))
    c, d = np.full(len(high), 1e300), 1 / b
    h = d.copy()
    for n in range(1, 100_000):
        if not len(live):
            break
        a = -n * (n - k[live])
        b[live] += 2
        d[live] = 1 / _apart(a * d[live] + b[live])
        c[live] = _apart(b[live] + a / c[live])
        step = c[live] * d[live]
        h[live] *= step
        live = live[np.abs(step - 1) >= 1e-15]
    upper[high] = np.minimum(1.0, front[high] * h)
    lower[high] = 1 - upper[high]
    return lower, upper


def beta_head(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction, from the side where that converges, for whole arrays; NaN stays."""
    x, a, b = (v.astype(float) for v in np.broadcast_arrays(x, a, b))
    other = x > (a + 1) / (a + b + 2)
    u, p, q = np.where(other, 1 - x, x), np.where(other, b, a), np.where(other, a, b)
    out = np.where(np.isnan(x + a + b), np.nan, (u >= 1).astype(float))
    at = np.flatnonzero((u > 0) & (u < 1))
    u, p, q, live = u[at], p[at], q[at], np.arange(len(at))
    c, d = np.ones(len(at)), 1 / _apart(1 - (p + q) * u / (p + 1))
    h = d.copy()
    for m in range(1, 1_000_000):
        if not len(live):
            break
        before, v, r, t = h[live], u[live], p[live], q[live]
        for step in (m * (t - m) * v / ((r + 2 * m - 1) * (r + 2 * m)), -(r + m) * (r + t + m) * v / ((r + 2 * m) * (r + 2 * m + 1))):
            d[live] = 1 / _apart(1 + step * d[live])
            c[live] = _apart(1 + step / c[live])
            h[live] *= c[live] * d[live]
        live = live[np.abs(h[live] - before) > 1e-15 * np.abs(h[live])]
    front = log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(u) + q * np.log1p(-u)
    out[at] = np.minimum(1.0, np.exp(front) * h / p)
    return np.where(other, 1 - out, out)


@F.pandas_udf(DoubleType())
def _poisson(n: pd.Series, mean: pd.Series) -> pd.Series:
    k, m = n.to_numpy(float), mean.to_numpy(float)
    some = k > 0
    return pd.Series(np.where(some | np.isnan(k + m), gamma_parts(m, np.where(some, k, 1.0))[0] + 0 * k, 1.0))


@F.pandas_udf(DoubleType())
def _binomial(n: pd.Series, trials: pd.Series, p: pd.Series) -> pd.Series:
    k, t, q = (v.to_numpy(float) for v in (n, trials, p))
    out = np.where(np.isnan(k + t + q), np.nan, (k <= 0).astype(float))
    at = np.flatnonzero((k > 0) & (k <= t) & ~np.isnan(q))
    out[at] = beta_head(q[at], k[at], t[at] - k[at] + 1)
    return pd.Series(out)


def poisson_tail(n: Column, mean: Column) -> Column:
    """P(X >= n) for a Poisson variable; 1 at n = 0.  In logs, so that no mean is too large."""
    return _poisson(n.cast("double"), mean.cast("double"))


def binomial_tail(n: Column, trials: Column, p: Column) -> Column:
    """P(X >= n) for a binomial variable with ``trials`` and ``p`` in 0 .. 1."""
    return _binomial(n.cast("double"), trials.cast("double"), p.cast("double"))


def fisher_combine(p: Column, q: Column) -> Column:
    """Fisher's combination of two p-values: the upper tail of chi-square with 4 degrees in closed form."""
    half = -(F.log(F.greatest(p, F.lit(1e-300))) + F.log(F.greatest(q, F.lit(1e-300))))
    return F.exp(-half) * (1 + half)


@F.pandas_udf(DoubleType())
def gamma_tail(x: pd.Series, shape: pd.Series, scale: pd.Series) -> pd.Series:
    """P(X >= x) for a gamma variable."""
    return pd.Series(gamma_parts(x.to_numpy(float) / scale.to_numpy(float), shape.to_numpy(float))[1])


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    """P(Z <= z) for a standard normal variable."""
    x = z.to_numpy(float)
    lower, upper = gamma_parts(x * x / 2, np.full(len(x), 0.5))
    return pd.Series(np.where(x < 0, upper / 2, (1 + lower) / 2))


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series, degrees: pd.Series) -> pd.Series:
    """P(X >= x) for chi-square."""
    return pd.Series(gamma_parts(x.to_numpy(float) / 2, degrees.to_numpy(float) / 2)[1])


_log_factorials = [np.zeros(1)]


def _log_factorial(n: int) -> Callable[[np.ndarray], np.ndarray]:
    """Logs of factorials of 0 .. ``n``: from a table kept for the next batch, beyond ``FACTORIALS`` by Stirling's series."""
    if n > FACTORIALS:
        return lambda k: log_gamma(np.asarray(k) + 1.0)
    if len(_log_factorials[0]) <= n:
        size = max(n + 1, 2 * len(_log_factorials[0]))
        _log_factorials[0] = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, size)))])
    return _log_factorials[0].__getitem__


def _likely(logs: Callable[[np.ndarray], np.ndarray], low: int, high: int, mode: int) -> tuple[int, int]:
    """The ends of the run of places whose likelihood, rising to ``mode`` and falling after it, is not 0 in floats beside that at ``mode``."""
    if high - low < 10_000:
        return low, high
    least = float(logs(np.array([mode]))[0]) - 745
    ends = []
    for inside, outside in ((mode, low - 1), (mode, high + 1)):
        while abs(outside - inside) > 1:
            k = (inside + outside) // 2
            inside, outside = (k, outside) if float(logs(np.array([k]))[0]) >= least else (inside, k)
        ends.append(inside)
    return ends[0], ends[1]


@F.pandas_udf(DoubleType())
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided Fisher exact p of the table [[a, b], [c, d]]: all tables no more likely than this one.

    Different tables of a batch are computed once, and the likelihoods of all tables with the same margins
    at once.  Of wide margins only tables that are not too unlikely for a float are looked at, some standard
    deviations of them, so memory does not grow with the number of subjects.
    """
    cells = np.stack([x.to_numpy(np.int64) for x in (a, b, c, d)], 1)
    tables, where = np.unique(cells, axis=0, return_inverse=True)
    lf = _log_factorial(int(tables.sum(1).max(initial=0)))
    out = np.ones(len(tables))
    margins = np.stack([tables[:, 0] + tables[:, 1], tables[:, 0] + tables[:, 2], tables.sum(1)], 1)
    for r, s, n in np.unique(margins, axis=0).tolist():
        logs = lambda k, r=r, s=s, n=n: lf(s) - lf(k) - lf(s - k) + lf(n - s) - lf(r - k) - lf(n - s - r + k)
        low, high = _likely(logs, max(0, r + s - n), min(r, s), (r + 1) * (s + 1) // (n + 2))
        probs = logs(np.arange(low, high + 1))
        probs = np.exp(probs - probs.max())
        probs /= probs.sum()
        own = np.flatnonzero((margins == (r, s, n)).all(1))
        order = np.argsort(probs)
        upto = np.concatenate([[0.0], np.cumsum(probs[order])])
        place = tables[own, 0] - low
        mine = np.where((place >= 0) & (place < len(probs)), probs[np.clip(place, 0, len(probs) - 1)], 0.0)
        out[own] = np.minimum(1.0, upto[np.searchsorted(probs[order], mine * (1 + 1e-7), "right")])
    return pd.Series(out[where.ravel()])


def running_sums(df: DataFrame, order: list[Column], values: list[str]) -> DataFrame:
    """``df`` with ``<value>_upto`` for each value: its sum over all rows up to this one, equal ones included.

    Rows are range-partitioned, so that equal ones are together; each partition has its own running sum, and
    what the partitions before it add up to is a table of one row a partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("_part").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    ahead = totals.select(F.col("_part"), *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}") for v in values])
    out = ranged.join(F.broadcast(ahead), "_part")
    for v in values:
        out = out.withColumn(f"{v}_upto", F.sum(v).over(W.partitionBy("_part").orderBy(*order)) + F.col(f"_{v}"))
    return out.drop("_part", *[f"_{v}" for v in values])


def exact_quantiles(df: DataFrame, value: Column, at: list[float]) -> list[float | None]:
    """The quantiles ``at`` of the values that are not null, linear between neighbouring ones, by counts over a range sort; null without values.

    Distinct values are counted and ranked, so no task holds more than a partition of them.
    """
    counts = df.select(value.cast("double").alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    ranked = staged(running_sums(counts, [F.col("v")], ["n"]), "ranked")
    total = ranked.agg(F.max("n_upto")).first()[0]
    if not total:
        return [None] * len(at)
    places = [q * (total - 1) for q in at]
    wanted = sorted({int(p) for p in places} | {min(int(p) + 1, total - 1) for p in places})
    found: dict[int, float] = {}
    for k in range(0, len(wanted), 200):  # few numbers each, whatever the data
        some = wanted[k : k + 200]
        hit = ranked.agg(*[F.min(F.when(F.col("n_upto") > i, F.col("v"))).alias(f"q{i}") for i in some]).first()
        found |= {i: hit[f"q{i}"] for i in some}
    return [found[int(p)] + (p - int(p)) * (found[min(int(p) + 1, total - 1)] - found[int(p)]) for p in places]


def benjamini_hochberg(df: DataFrame, p: str = "pvalue", q: str = "qvalue") -> DataFrame:
    """``df`` with false-discovery rates: the least p * n / rank at this or a larger p-value, at most 1.

    Distinct p-values are ranked (ties share the largest rank, which leaves the minimum as it is); their
    running minimum is taken within partitions of the range sort and across partitions' minima.  Rows without a
    p-value stay, without a rate, and count for nothing.
    """
    counts = df.filter(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    here = running_sums(counts, [F.col("_p")], ["_n"]).withColumn("_rank", F.col("_n_upto"))
    total = here.agg(F.max("_rank")).first()[0] or 0
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    here = here.withColumn("_all", F.lit(total)).repartitionByRange(parts, "_p").withColumn("_part", F.spark_partition_id())
    here = staged(here.withColumn("_raw", F.col("_p") * F.col("_all") / F.col("_rank")), "raw")
    later = here.groupBy("_part").agg(F.min("_raw").alias("_least"))
    after = later.select("_part", F.min("_least").over(W.orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1)).alias("_after"))
    done = here.join(F.broadcast(after), "_part").withColumn("_down", F.min("_raw").over(W.partitionBy("_part").orderBy(F.desc("_p"))))
    qs = done.select(F.col("_p").alias(p), "_n", F.least(F.col("_down"), F.coalesce("_after", F.lit(1.0)), F.lit(1.0)).alias(q))
    return lookup_value(df.drop(q) if q in df.columns else df, p, qs, "_n", total)
