"""Scorers and survival statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plexivec.functions.names import FRAME, LEFT, RIGHT, tokens
from plexivec.functions.stats import chi2_tail, gamma_tail, normal_cdf, running_sums
from plexivec.functions.vectors import mean_vector
from plexivec.operators.basis import fit_projection, transform
from plexivec.plans.skew import lookup_value
from plexivec.plans.staging import staged


def _spectrum(df: DataFrame, score: Column, label: Column) -> DataFrame:
    return df.groupBy(score.alias("s")).agg(F.count_if(label).alias("p"), F.count_if(~label).alias("n"))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row ``auc``: chance that a positive scores above a negative, ties a half.

    Rows are counted by distinct score first; the running sum is over those.
    """
    s = running_sums(_spectrum(df, F.col(score), F.col(label).cast("boolean")), [F.col("s")], ["n"])
    below = F.col("n_upto") - F.col("n")
    won = s.select((F.col("p") * (below + F.col("n") / 2.0)).alias("w"), "p", "n").agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return won.select((F.col("w") / (F.col("p") * F.col("n"))).alias("auc"))


def average_rank(df: DataFrame, column: str, output: str) -> DataFrame:
    """``df`` with ranks from 1, ties with their mean rank; nulls stay and have none."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    r = staged(running_sums(counts, [F.col(column)], ["_n"]).select(column, "_n", (F.col("_n_upto") - (F.col("_n") - 1) / 2.0).alias(output)), "ranks")
    return lookup_value(df, column, r, "_n", r.agg(F.sum("_n")).first()[0] or 0)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``rho``; null if one of the columns is constant."""
    ranked = average_rank(average_rank(df, a, "_ra"), b, "_rb")
    return ranked.agg(F.try_divide(F.covar_pop("_ra", "_rb"), F.stddev_pop("_ra") * F.stddev_pop("_rb")).alias("rho"))


def held_out_auc(train: DataFrame, test: DataFrame, vector: str, label: str, pca_cols: int = 0) -> float:
    """AUC on ``test`` of a ridge logistic regression (C = 1) on standardised columns.

    The first ``pca_cols`` columns are replaced by the components that hold 90 % of their variance.
    """
    parts = [(c, F.slice(vector, 1, pca_cols) if c == "_pca" else F.slice(vector, pca_cols + 1, 1_000_000)) for c in (("_pca", "_rest") if pca_cols else ("_rest",))]
    for name, value in parts:
        a, b = train.withColumn(name, value), test.withColumn(name, value)
        if name == "_pca":
            basis = fit_projection(a, name, pca_cols, cap=None)
            k = int(np.searchsorted(np.cumsum(basis.variances) / basis.variances.sum(), 0.9) + 1)
            a, b = (transform(x, basis, name, "_z").withColumn(name, F.slice("_z", 1, k)).drop("_z") for x in (a, b))
        train, test = a, b
    value = array_to_vector(F.concat(*[n for n, _ in parts]))
    train, test = (x.select(value.alias("features"), F.col(label).cast("double").alias("label")) for x in (train, test))
    n = train.count()
    model = LogisticRegression(regParam=1.0 / n, standardization=True, maxIter=200).fit(train)
    scored = model.transform(test).select(vector_to_array("rawPrediction")[1].alias("s"), (F.col("label") > 0.5).alias("y"))
    return float(roc_auc(scored, "s", "y").first()[0])


def with_folds(df: DataFrame, key: str, label: str | None, n_splits: int, seed: int) -> DataFrame:
    """``df`` with ``fold``: within each label, if one is named, rows are dealt out by the order of a hash of the key.

    The order is a range sort over label, hash and key; a label's rows are numbered from its partitions' counts.
    """
    shuffled = df.withColumn("_hash", F.xxhash64(F.lit(seed), key)).withColumn("_one", F.lit(1))
    order = [*([F.col(label)] if label else []), F.col("_hash"), F.col(key)]
    rank = running_sums(shuffled, order, ["_one"])
    # a constant for each label moves its folds round, and leaves them as even
    return rank.withColumn("fold", ((F.col("_one_upto") - 1) % n_splits).cast("int")).drop("_hash", "_one", "_one_upto")


def cv_auc(df: DataFrame, key: str, vector: str, label: str, pca_cols: int = 0, n_splits: int = 5, n_repeats: int = 10, seed: int = 0) -> tuple[float, float]:
    """Mean and population deviation of the AUC over repeated stratified folds."""
    out = []
    for r in range(n_repeats):
        folded = with_folds(df, key, label, n_splits, seed + r).persist()
        out += [held_out_auc(folded.filter(F.col("fold") != k), folded.filter(F.col("fold") == k), vector, label, pca_cols) for k in range(n_splits)]
        folded.unpersist()
    return float(np.mean(out)), float(np.std(out))


def _won(stage: np.ndarray, event: np.ndarray, risk: np.ndarray, count: np.ndarray) -> tuple[int, int]:
    """Pairs of an event with a row of a later stage and a lower, or the same, risk; a tree of sums over the risks."""
    values, at = np.unique(risk, return_inverse=True)
    tree, here, won, tied, waiting, now = [0] * (len(values) + 1), [0] * len(values), 0, 0, [], None
    order = np.argsort(-stage, kind="stable")
    for s, e, k, c in zip(stage[order].tolist(), event[order].tolist(), at[order].tolist(), count[order].tolist()):
        if s != now:
            for j, n in waiting:
                here[j] += n
                j += 1
                while j < len(tree):
                    tree[j] += n
                    j += j & -j
            waiting, now = [], s
        waiting.append((k, c))
        if e:
            tied += c * here[k]
            while k:
                won += c * tree[k]
                k -= k & -k
    return won, tied


def concordance(df: DataFrame, time: str, event: str, risk: str, key: str, block: int = 20_000, grid: int = 256) -> DataFrame:
    """One row ``concordant, tied, comparable, cindex`` (Harrell; higher risk should fail earlier).

    A pair is comparable if the earlier one had the event, or both times are equal and just one had.
    Rows meet as counts by (time, event, risk), so repeated values cost nothing.  Times and risks are cut
    into at most about ``grid`` blocks: pairs that differ in both blocks are counted from the blocks'
    totals, pairs of one block of times or of risks in its task, so that no pair is ever a row.
    """
    g = df.groupBy(F.col(time).alias("t"), F.col(event).cast("boolean").alias("e"), F.col(risk).alias("r")).agg(F.count("*").alias("c")).filter("t is not null")
    g = staged(g.withColumn("e1", F.coalesce("e", F.lit(False))).withColumn("e0", F.coalesce(~F.col("e"), F.lit(False))), "counts")
    size = max(block, -(-g.count() // grid))
    times = running_sums(g.groupBy("t").agg(F.count("*").alias("n"), F.sum("c").alias("all"), F.sum(F.when(F.col("e1"), F.col("c")).otherwise(0)).alias("d"), F.sum(F.when(F.col("e0"), F.col("c")).otherwise(0)).alias("o")), [F.col("t")], ["n", "all"])
    total = F.lit(g.agg(F.sum("c")).first()[0])
    comparable = times.agg(F.sum(F.col("d") * (total - F.col("all_upto") + F.col("o")))).first()[0]
    risks = running_sums(g.filter("r is not null").groupBy("r").agg(F.count("*").alias("n")), [F.col("r")], ["n"])
    place = lambda x, v, at: x.select(v, F.col("n_upto").alias(at), F.expr(f"(n_upto - 1) div {size}").alias(f"b{at}"))
    rows = staged(g.join(place(times, "t", "i"), "t").join(place(risks, "r", "k"), "r").select("i", "bi", "k", "bk", F.col("e1").alias("e"), F.col("e0"), "c"), "placed")

    def in_times(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_won(2 * x["i"].to_numpy() + x["e0"].to_numpy(), x["e"].to_numpy(), x["k"].to_numpy(), x["c"].to_numpy())], columns=["won", "tied"])

    def in_risks(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_won(x["bi"].to_numpy(), x["e"].to_numpy(), x["k"].to_numpy(), x["c"].to_numpy())], columns=["won", "tied"])

    met = rows.groupBy("bi").applyInPandas(in_times, "won bigint, tied bigint").unionByName(rows.groupBy("bk").applyInPandas(in_risks, "won bigint, tied bigint"))
    won, tied = met.agg(F.coalesce(F.sum("won"), F.lit(0)), F.coalesce(F.sum("tied"), F.lit(0))).first()
    cells = rows.groupBy("bi", "bk").agg(F.sum("c").alias("c"), F.sum(F.when(F.col("e"), F.col("c")).otherwise(0)).alias("d")).collect()
    if cells:
        shape = max(r["bi"] for r in cells) + 1, max(r["bk"] for r in cells) + 1
        every, events = np.zeros(shape, object), np.zeros(shape, object)
        for r in cells:
            every[r["bi"], r["bk"]], events[r["bi"], r["bk"]] = r["c"], r["d"]
        upto = every[::-1].cumsum(0)[::-1].cumsum(1)  # this and later times, this and lower risks
        won += int((events[:-1, 1:] * upto[1:, :-1]).sum())
    row = (won, tied, comparable, (won + tied / 2.0) / comparable) if comparable else (None,) * 4
    return df.sparkSession.createDataFrame([row], "concordant bigint, tied bigint, comparable bigint, cindex double")


def logrank_table(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """``group, observed, expected`` over all event times.

    Rows are counted by time and group; only those counts are summed up over time.
    """
    c = df.groupBy(F.col(time).alias("t"), F.col(group).alias("g")).agg(F.count("*").alias("n"), F.count_if(F.col(event).cast("boolean")).alias("d"))
    times, groups = c.select("t").distinct(), c.select("g").distinct()
    grid = times.join(F.broadcast(groups)).join(c, ["t", "g"], "left").fillna(0, ["n", "d"])
    risk = F.sum("n").over(W.partitionBy("g").orderBy(F.desc("t")))
    grid = grid.withColumn("at_risk", risk)
    each = grid.groupBy("t").agg(F.sum("d").alias("dt"), F.sum("at_risk").alias("rt"))
    j = grid.join(each, "t").withColumn("e", F.when(F.col("rt") > 0, F.col("dt") * F.col("at_risk") / F.col("rt")).otherwise(0.0))
    return j.groupBy(F.col("g").alias("group")).agg(F.sum("d").alias("observed"), F.sum("e").alias("expected"))


def logrank(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """One row ``statistic, pvalue`` of the multivariate log-rank test; groups are few (a design)."""
    c = df.groupBy(F.col(time).alias("t"), F.col(group).alias("g")).agg(F.count("*").alias("n"), F.count_if(F.col(event).cast("boolean")).alias("d"))
    groups = [r[0] for r in c.select("g").distinct().orderBy("g").limit(101).collect()]
    if len(groups) > 100:
        raise ValueError("more than 100 groups")
    wide = c.groupBy("t").agg(F.sum("d").alias("d"), *[F.sum(F.when(F.col("g") == g, F.col("n")).otherwise(0)).alias(f"n{i}") for i, g in enumerate(groups)])
    later = W.orderBy(F.desc("t"))
    risk = [F.sum(f"n{i}").over(later).cast("double").alias(f"r{i}") for i in range(len(groups))]
    at = wide.select("d", *risk)
    total = sum((F.col(f"r{i}") for i in range(len(groups))), F.lit(0.0))
    k = F.when(total > 1, F.col("d") * (total - F.col("d")) / (total - 1)).otherwise(0.0)
    cov = [F.sum(k * F.col(f"r{i}") / total * (F.lit(float(i == j)) - F.col(f"r{j}") / total)).alias(f"v{i}_{j}") for i in range(len(groups) - 1) for j in range(len(groups) - 1)]
    v = at.filter("d > 0").agg(*cov).first()
    table = {r["group"]: r for r in logrank_table(df, time, event, group).collect()}
    u = np.array([table[g]["observed"] - table[g]["expected"] for g in groups[:-1]])
    m = len(u)
    stat = float(u @ np.linalg.pinv(np.array([v[f"v{i}_{j}"] for i in range(m) for j in range(m)]).reshape(m, m)) @ u)
    out = df.sparkSession.createDataFrame([(stat, float(m))], "statistic double, df double")
    return out.select("statistic", chi2_tail("statistic", "df").alias("pvalue"))


#: Events of one time that are handled together.
TIED = 1000


def cox_fit(df: DataFrame, time: str, event: str, vector: str, penalizer: float = 0.1, rounds: int = 25) -> np.ndarray:
    """Coefficients of a ridge Cox regression with Efron's ties, by Newton's method.

    Each round is one Spark job: sums over the risk set and over the events of every time, then running
    sums over times; of d events at one time the l-th sees the risk set less l/d of the events.  The driver
    gets a gradient and a matrix of covariates.
    """
    df = staged(df.select(time, event, vector), "risks")  # read in every round
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = len(df.select(vector).first()[0])
    beta = np.zeros(k)
    n = df.count()
    names = ["", *[str(i) for i in range(k)], *[f"{i}_{j}" for i in range(k) for j in range(i, k)]]
    value = {"": F.lit(1.0)} | {str(i): F.col(vector)[i] for i in range(k)} | {f"{i}_{j}": F.col(vector)[i] * F.col(vector)[j] for i in range(k) for j in range(i, k)}
    e = F.when(F.col(event).cast("boolean"), 1.0).otherwise(0.0)
    later = W.orderBy(F.desc("t"))
    for _ in range(rounds):
        risk = F.exp(sum((F.col(vector)[i] * float(b) for i, b in enumerate(beta)), F.lit(0.0)))
        by_time = df.groupBy(F.col(time).alias("t")).agg(F.sum(e).alias("d"), *[F.sum(e * value[str(i)]).alias(f"e{i}") for i in range(k)], *[F.sum(risk * value[m]).alias(f"s{m}") for m in names], *[F.sum(e * risk * value[m]).alias(f"f{m}") for m in names])
        cum = by_time.select("t", "d", *[f"e{i}" for i in range(k)], *[F.sum(f"s{m}").over(later).alias(f"s{m}") for m in names], *[f"f{m}" for m in names]).filter("d > 0")
        # times, and the events of one time by the thousand, are dealt to all tasks before there is a row for each event
        spread = cum.withColumn("_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("d").cast("long") - 1, F.lit(TIED).cast("long")))).repartition(parts, "t", "_first")
        tied = spread.withColumn("l", F.explode(F.sequence(F.col("_first"), F.least(F.col("_first") + TIED, F.col("d").cast("long")) - 1)))
        left = {m: F.col(f"s{m}") - F.col("l") / F.col("d") * F.col(f"f{m}") for m in names}
        mean = lambda i: left[str(i)] / left[""]
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        got = tied.agg(*[F.sum(F.col(f"e{i}") / F.col("d") - mean(i)).alias(f"g{i}") for i in range(k)], *[F.sum(left[f"{i}_{j}"] / left[""] - mean(i) * mean(j)).alias(f"h{i}_{j}") for i, j in pairs]).first()
        g = np.array([got[f"g{i}"] for i in range(k)]) / n - penalizer * beta
        h = np.zeros((k, k))
        for i, j in pairs:
            h[i, j] = h[j, i] = got[f"h{i}_{j}"] / n
        step = np.linalg.solve(h + penalizer * np.eye(k), g)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def cv_cindex(df: DataFrame, key: str, time: str, event: str, vector: str | None = None, n_splits: int = 5, seed: int = 0, penalizer: float = 0.1, base: str | None = None, n_pc: int = 0) -> float:
    """Mean concordance over shuffled folds of Cox regressions on the covariates; folds that fail are left out.

    Covariates are those of the array ``base`` and those of the array ``vector``; with ``n_pc`` a wider
    ``vector`` is projected to as many components, fitted on the fold's training rows.  Covariates that do
    not vary among those are left out.  Without any covariate, or if all folds fail, the result is NaN.
    """
    if base is None and vector is None:
        return float("nan")
    folded = with_folds(df, key, None, n_splits, seed).persist()
    width = len(df.select(vector).first()[0]) if vector else 0
    out = []
    for f in range(n_splits):
        parts = [folded.filter(F.col("fold") != f), folded.filter(F.col("fold") == f)]
        block = vector
        if n_pc and width > n_pc:
            fitted = fit_projection(parts[0], vector, n_pc)
            parts, block = [transform(x, fitted, vector, "_pc") for x in parts], "_pc"
        design = F.concat(*[F.col(c).cast("array<double>") for c in (base, block) if c])
        train, test = (x.withColumn("_x", design) for x in parts)
        n = len(train.select("_x").first()[0])
        spread = train.agg(*[F.stddev_samp(F.col("_x")[i]).alias(f"s{i}") for i in range(n)]).first()
        keep = [i for i in range(n) if (spread[i] or 0.0) > 1e-9]
        if not keep:
            continue
        train, test = (x.withColumn("_x", F.array(*[F.col("_x")[i] for i in keep])) for x in (train, test))
        try:
            beta = cox_fit(train, time, event, "_x", penalizer)
        except np.linalg.LinAlgError:
            continue
        risk = sum((F.col("_x")[i] * float(b) for i, b in enumerate(beta)), F.lit(0.0))
        c = concordance(test.withColumn("_risk", risk), time, event, "_risk", key).first()["cindex"]
        out += [] if c is None else [c]
    folded.unpersist()
    return float(np.mean(out)) if out else float("nan")


def _gev_terms(v: Column, mu: float, sigma: float, xi: float) -> tuple[Column, Column]:
    """Log density and distribution function of the generalised extreme value distribution."""
    s = (v - mu) / sigma
    if abs(xi) < 1e-6:
        t, inside = F.exp(-s), F.lit(True)
        log_t = -s
    else:
        inside = 1 + xi * s > 0
        log_t = F.when(inside, -F.log(F.greatest(1 + xi * s, F.lit(1e-300))) / xi)
        t = F.exp(log_t)
    density = F.when(inside, (xi + 1) * log_t - t - math.log(sigma)).otherwise(F.lit(-1e9))
    return density, F.when(inside, F.exp(-t)).otherwise(F.lit(0.0 if xi > 0 else 1.0))


def _fit_gev(counts: DataFrame, v: Column, weight: Column, mean: float, var: float, skew: float, rounds: int = 60) -> tuple[float, float, float]:
    """Maximum likelihood by Newton-like steps of a simplex whose corners are scored in one job a round."""
    sigma = math.sqrt(6 * var) / math.pi
    start = np.array([mean - 0.5772 * sigma, math.log(sigma), 0.1 if skew > 0 else -0.1])

    def score(points: list[np.ndarray]) -> np.ndarray:
        got = counts.agg(*[F.sum(weight * _gev_terms(v, float(p[0]), float(np.exp(p[1])), float(p[2]))[0]).alias(f"l{i}") for i, p in enumerate(points)]).first()
        return -np.array([float(x) for x in got])

    corners = [start] + [start + np.eye(3)[i] * (0.5 * sigma, 0.3, 0.2)[i] for i in range(3)]
    values = score(corners)
    for _ in range(rounds):
        order = np.argsort(values)
        corners, values = [corners[i] for i in order], values[order]
        if values[-1] - values[0] <= 1e-7 * abs(values[0]):
            break
        middle = np.mean(corners[:-1], 0)
        tries = [middle + t * (corners[-1] - middle) for t in (-2.0, -1.0, -0.5, 0.5)]
        shrunk = [corners[0] + 0.5 * (c - corners[0]) for c in corners[1:]]
        found = score(tries + shrunk)  # all that a round may need, in one job
        best = int(np.argmin(found[:4]))
        if found[best] < values[-1]:
            corners[-1], values[-1] = tries[best], found[best]
        else:
            corners, values = [corners[0], *shrunk], np.concatenate([values[:1], found[4:]])
    p = corners[int(np.argmin(values))]
    return float(p[0]), float(np.exp(p[1])), float(p[2])


def _ks(counts: DataFrame, cdf: Column, n: int) -> float:
    """Largest gap between a distribution function of ``v`` and the empirical one."""
    upto, before = F.col("n_upto") / F.lit(float(n)), (F.col("n_upto") - F.col("n")) / F.lit(float(n))
    return float(counts.agg(F.max(F.greatest(F.abs(cdf - upto), F.abs(cdf - before)))).first()[0])


def fit_distributions(df: DataFrame, value: str) -> pd.DataFrame:
    """``name, a, b, c, loglik, aic, ks`` of the normal, the gamma and the generalised extreme value distribution of the positive values.

    The normal is fitted by moments, the others by maximum likelihood: the gamma's shape (``a``; ``b`` is its
    scale) solves log(k) - digamma(k) = log(mean) - mean(log), and location, scale and shape of the third
    are searched for by sums over all values.  ``ks`` is the Kolmogorov-Smirnov statistic, from a running
    count of the distinct values.
    """
    from math import lgamma, log, pi, sqrt

    rows = df.select(F.col(value).cast("double").alias("v")).filter("v > 0")
    counts = staged(running_sums(rows.groupBy("v").agg(F.count("*").alias("n")), [F.col("v")], ["n"]), "values")
    v, weight = F.col("v"), F.col("n")
    n = counts.agg(F.sum("n")).first()[0]
    mean, mlog = counts.select((F.sum(v * weight) / n).alias("m"), (F.sum(F.log(v) * weight) / n).alias("l")).first()
    var, third = counts.select((F.sum((v - mean) ** 2 * weight) / n).alias("s"), (F.sum((v - mean) ** 3 * weight) / n).alias("t")).first()
    s = log(mean) - mlog
    k = (3 - s + sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    digamma = lambda z: (lgamma(z + 1e-5) - lgamma(z - 1e-5)) / 2e-5
    for _ in range(20):
        f = log(k) - digamma(k) - s
        slope = 1 / k - (digamma(k + 1e-3) - digamma(k - 1e-3)) / 2e-3
        k = max(k - f / slope, k / 2)
    theta = mean / k
    mu, sigma, xi = _fit_gev(counts, v, weight, mean, var, third)
    likelihood, gev = _gev_terms(v, mu, sigma, xi)
    z = (v - mean) / sqrt(2 * var)
    fits = [
        ("normal", mean, sqrt(var), None, -n / 2 * (log(2 * pi * var) + 1), _ks(counts, normal_cdf(z * sqrt(2.0)), n)),
        ("gamma", k, theta, None, n * ((k - 1) * mlog - mean / theta - k * log(theta) - lgamma(k)), _ks(counts, 1 - gamma_tail(v, F.lit(k), F.lit(theta)), n)),
        ("gev", mu, sigma, xi, counts.agg(F.sum(likelihood * weight)).first()[0], _ks(counts, gev, n)),
    ]
    return pd.DataFrame([(name, a, b, c, ll, 2 * (2 + (c is not None)) - 2 * ll, ks) for name, a, b, c, ll, ks in fits], columns=["name", "a", "b", "c", "loglik", "aic", "ks"])


def _one_a_sequence(df: DataFrame, key: str, sequence: str, columns: dict[str, str]) -> DataFrame:
    """``_s, _k`` and ``columns`` by new name: of rows with one sequence the one with the largest key."""
    cols = [F.col(key).alias("_k"), *[F.col(c).alias(n) for n, c in columns.items()]]
    return df.groupBy(F.col(sequence).alias("_s")).agg(F.max_by(F.struct(*cols), F.col(key)).alias("x")).select("_s", "x.*")


def _accuracies(j: DataFrame, aggs: list[Column]) -> DataFrame:
    """One row of ``aggs`` and of how well ``_r`` gives ``_s`` back."""
    aggs = [*aggs, F.avg((F.col("_s") == F.col("_r")).cast("double")).alias("exact_match"), F.avg(F.levenshtein("_s", "_r").cast("double")).alias("mean_edit"), mean_vector("_same").alias("pos_acc")]
    j = j.withColumn("_same", F.zip_with(tokens(F.col("_s")), tokens(F.col("_r")), lambda a, b: (a == b).cast("double")))
    anchors = F.filter("pos_acc", lambda x, i: (i < LEFT) | (i >= FRAME - RIGHT))
    middle = F.filter("pos_acc", lambda x, i: (i >= LEFT) & (i < FRAME - RIGHT))
    share = lambda a, n: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
    out = j.agg(*aggs)
    return out.withColumn("token_acc", share(F.col("pos_acc"), FRAME)).withColumn("anchor_acc", share(anchors, LEFT + RIGHT)).withColumn("middle_acc", share(middle, FRAME - LEFT - RIGHT))


def reconstruction(df: DataFrame, key: str, sequence: str, recon: str) -> DataFrame:
    """``codec_losslessness`` without the collisions of codes, which need a search of neighbours."""
    return _accuracies(_one_a_sequence(df, key, sequence, {"_r": recon}), [F.count("*").alias("n")])


def codec_losslessness(df: DataFrame, key: str, sequence: str, code: str, recon: str | None = None, eps: float = 1e-6) -> DataFrame:
    """One row ``n, collision_rate, ceiling`` and, with ``recon``, ``exact_match, mean_edit, token_acc, anchor_acc, middle_acc, pos_acc``.

    Of rows with one sequence the one with the largest key counts.  A collision is another distinct sequence
    with its code within ``eps``.  Accuracies compare token frames place by place: all places, the anchors
    at both ends, the middle, and an array of each place's.
    """
    from plexivec.operators.neighbors import pairs_within

    one = _one_a_sequence(df, key, sequence, {"_c": code} | ({"_r": recon} if recon else {}))
    hit = pairs_within(one, "_k", "_c", eps * eps).select(F.explode(F.array("a", "b")).alias("_k")).distinct().withColumn("_hit", F.lit(1.0))
    j = one.join(hit, "_k", "left")
    rate = F.avg(F.coalesce("_hit", F.lit(0.0)))
    aggs = [F.count("*").alias("n"), rate.alias("collision_rate"), (1 - rate).alias("ceiling")]
    if recon:
        return _accuracies(j, aggs)
    return j.agg(*aggs)
