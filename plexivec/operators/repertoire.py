"""Condensing samples, weighted sets of records, into fixed-width vectors, and comparing them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plexivec.functions.stats import size_weight
from plexivec.functions.vectors import dot, l2sq, mean_vector, subtract, upper_triangle

BLOCKS = ("mean", "diversity", "second")


def sample_weights(df: DataFrame, sample: str, count: str, weight: str = "log1p") -> DataFrame:
    """``df`` with ``w``: size weights that sum to 1 in every sample.

    The sample totals are aggregated and joined, so a large sample is never in one task.  A sample whose
    counts sum to nothing raises "degenerate repertoire".
    """
    g = size_weight(F.col(count).cast("double"), weight)
    totals = df.groupBy(F.col(sample).alias("_s")).agg(F.sum(g).alias("_g"), F.sum(F.col(count)).alias("_a"))
    checked = totals.withColumn("_g", F.when((F.col("_a") > 0) & (F.col("_g") > 0), F.col("_g")).otherwise(F.raise_error(F.lit("degenerate repertoire")).cast("double"))).drop("_a")
    return df.join(checked, F.col(sample) == F.col("_s")).withColumn("w", g / F.col("_g")).drop("_s", "_g")


def hill(df: DataFrame, sample: str, count: str) -> DataFrame:
    """``sample, d0, d1, d2``: Hill numbers of the raw counts; rows with count 0 are left out."""
    a = F.col(count).cast("double")
    s = df.filter(F.col(count) > 0).groupBy(sample).agg(F.count("*").alias("n"), F.sum(a).alias("t"), F.sum(a * F.log(a)).alias("l"), F.sum(a * a).alias("q"))
    return s.select(sample, F.col("n").cast("double").alias("d0"), F.exp(F.log("t") - F.col("l") / F.col("t")).alias("d1"), (F.col("t") * F.col("t") / F.col("q")).alias("d2"))


def descriptor(df: DataFrame, sample: str, count: str, weight: str = "log1p") -> DataFrame:
    """``sample, log_mass, log_neff, simpson, n_eff, diversity``."""
    g = size_weight(F.col(count).cast("double"), weight)
    s = df.groupBy(sample).agg(F.sum(F.col(count).cast("double")).alias("a"), F.sum(g).alias("g"), F.sum(g * g).alias("gg"))
    simpson = F.col("gg") / (F.col("g") * F.col("g"))
    return s.select(sample, F.log1p("a").alias("log_mass"), (-F.log(simpson)).alias("log_neff"), simpson.alias("simpson"), (1 / simpson).alias("n_eff"), F.exp(-F.log(simpson)).alias("diversity"))


def sample_coverage(df: DataFrame, sample: str, count: str) -> DataFrame:
    """``sample, coverage``: Good-Turing coverage of the counts (Chao and Jost, 2012)."""
    s = df.filter(F.col(count) > 0).groupBy(sample).agg(F.sum(count).cast("double").alias("n"), F.count_if(F.col(count) == 1).cast("double").alias("f1"), F.count_if(F.col(count) == 2).cast("double").alias("f2"))
    rest = (F.col("n") - 1) * F.col("f1")
    return s.select(sample, F.when(F.col("f1") == 0, 1.0).otherwise(1 - F.col("f1") / F.col("n") * rest / F.greatest(rest + 2 * F.col("f2"), F.lit(1e-300))).alias("coverage"))


def coverage_hill(df: DataFrame, sample: str, count: str, level: float) -> DataFrame:
    """``sample, d0, d1, d2``: Hill numbers at a common coverage, by rarefaction or extrapolation of the counts.

    A sample is handed over as its spectrum, one row for each distinct count, so that its size does not
    matter (Chao et al., 2014; order 0 beyond the sample by Chao1, orders 1 and 2 up to twice its size).
    """
    spectrum = df.filter(F.col(count) > 0).groupBy(sample, F.col(count).cast("long").alias("x")).agg(F.count("*").alias("f"))
    kind = spectrum.schema[sample].dataType.simpleString()

    def run(x: pd.DataFrame) -> pd.DataFrame:
        d = _at_coverage(x["x"].to_numpy(float), x["f"].to_numpy(float), level)
        return pd.DataFrame({sample: [x[sample].iloc[0]], "d0": [d[0]], "d1": [d[1]], "d2": [d[2]]})

    return spectrum.groupBy(sample).applyInPandas(run, f"{sample} {kind}, d0 double, d1 double, d2 double")


def _at_coverage(x: np.ndarray, f: np.ndarray, level: float) -> tuple[float, float, float]:
    from math import lgamma

    n = float((x * f).sum())
    f1, f2 = float(f[x == 1].sum()), float(f[x == 2].sum())
    lf = np.vectorize(lambda v: lgamma(v + 1))
    full = 1 - f1 / n * ((n - 1) * f1 / max((n - 1) * f1 + 2 * f2, 1e-300)) if f1 else 1.0

    def covered(m: float) -> float:
        if m >= n:
            a = (n - 1) * f1 / max((n - 1) * f1 + 2 * f2, 1e-300)
            return 1 - f1 / n * a ** (m - n + 1) if f1 else 1.0
        ok = n - x >= m
        miss = np.where(ok, np.exp(lf(np.maximum(n - x, 0)) - lf(np.maximum(n - x - m, 0)) - lf(n - 1) + lf(n - 1 - m)), 0)
        return float(1 - (x / n * f * miss).sum())

    lo, hi = 1.0, n if level <= full else 2 * n
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if covered(mid) < level else (lo, mid)
    m = hi
    if m >= n:
        f0 = (n - 1) / n * (f1 * f1 / (2 * f2) if f2 else f1 * (f1 - 1) / 2)
        s = f.sum()
        d0 = s + f0 * (1 - (1 - f1 / (n * f0 + f1)) ** (m - n)) if f0 else s
        p = x / n
        return float(d0), float(np.exp(-(f * p * np.log(p)).sum())), float(1 / ((f * x * (x - 1)).sum() / (n * (n - 1)) * (m - 1) / m + 1 / m))
    # a row of the spectrum alone: what it gives to each sum does not need the counts of the smaller sample side by side
    m = max(1.0, round(m))
    lnm = lf(n) - lf(m) - lf(n - m)
    d0 = entropy = square = 0.0
    for xi, fi in zip(x, f):
        for lo in range(int(max(1, xi + m - n)), int(min(xi, m)) + 1, 1 << 16):
            k = np.arange(lo, min(lo + (1 << 16), int(min(xi, m)) + 1))
            p = fi * np.exp(lf(xi) - lf(k) - lf(xi - k) + lf(n - xi) - lf(m - k) - lf(n - xi - m + k) - lnm)
            d0, entropy, square = d0 + p.sum(), entropy - (p * k / m * np.log(k / m)).sum(), square + (p * (k / m) ** 2).sum()
    return float(d0), float(np.exp(entropy)), float(1 / square)


def sample_embedding(df: DataFrame, sample: str, count: str, features: str | None = None, features2: str | None = None, weight: str = "log1p", blocks: Sequence[str] = BLOCKS, coverage: float | None = None, n_eigs: int | None = None) -> DataFrame:
    """One row a sample: ``n_eff`` and the blocks asked for.

    ``mean``: weighted mean of ``features``.  ``diversity``: logs of the Hill numbers and the coverage.
    ``second``: upper triangle of the weighted second moment of ``features2``, or its largest ``n_eigs``
    eigenvalues in falling order.  All are sums, combined before the shuffle.
    """
    if unknown := set(blocks) - set(BLOCKS):
        raise ValueError(f"unknown blocks {sorted(unknown)}")
    w = sample_weights(df, sample, count, weight)
    aggs = [(1 / F.sum(F.col("w") * F.col("w"))).alias("n_eff")]
    if "mean" in blocks:
        aggs.append(mean_vector(features, F.col("w")).alias("mean"))
    if "second" in blocks:
        w = w.withColumn("_second", upper_triangle(features2))
        aggs.append(mean_vector("_second", F.col("w")).alias("second"))
    out = w.groupBy(sample).agg(*aggs)
    if "second" in blocks and n_eigs:

        @F.pandas_udf("array<double>")
        def eigenvalues(v: pd.Series) -> pd.Series:
            def one(x: np.ndarray) -> np.ndarray:
                d = int((np.sqrt(8 * len(x) + 1) - 1) / 2)
                m = np.zeros((d, d))
                m[np.triu_indices(d)] = x
                return np.linalg.eigvalsh(m + np.triu(m, 1).T)[::-1][:n_eigs]

            return v.map(one)

        out = out.withColumn("second", eigenvalues("second"))
    if "diversity" in blocks:
        h = hill(df, sample, count) if coverage is None else coverage_hill(df, sample, count, coverage)
        c = sample_coverage(df, sample, count).withColumn("coverage", F.lit(1.0) if coverage is None else F.col("coverage"))
        out = out.join(h.join(c, sample).select(sample, F.array(F.log("d0"), F.log("d1"), F.log("d2"), "coverage").alias("diversity")), sample)
    return out


def stacked(embeddings: DataFrame) -> Column:
    """The blocks of ``sample_embedding`` that are there, one after the other; ValueError without any.

    Rows whose blocks are not as wide as the first row's raise "widths differ".
    """
    there = [b for b in BLOCKS if b in embeddings.columns]
    if not there:
        raise ValueError(f"no blocks among {embeddings.columns}")
    first = embeddings.select(*[F.size(b) for b in there]).first()
    same = F.lit(True)
    for b, width in zip(there, first or [0] * len(there)):
        same = same & (F.size(b) == width)
    return F.when(same, F.concat(*there)).otherwise(F.raise_error(F.lit("widths differ")).cast("array<double>"))


def decode_metrics(vector: Sequence[float]) -> dict[str, float]:
    """Names for a ``descriptor`` vector (log mass, log effective size, Simpson): the log mass is also the infiltration, Simpson's index the clonality."""
    log_mass, log_neff, simpson = (float(x) for x in list(vector)[:3])
    return {"log_mass": log_mass, "log_neff": log_neff, "simpson": simpson, "mass": float(np.expm1(log_mass)), "n_eff": float(np.exp(log_neff)), "infiltration": log_mass, "clonality": simpson, "diversity": float(np.exp(log_neff))}


def mmd(mean_a: Column, neff_a: Column, mean_b: Column, neff_b: Column, unbiased: bool = False) -> Column:
    """Maximum mean discrepancy of two kernel means; unbiased: self-similarities are taken out.

    An effective size of 1 or less has no unbiased estimate: it raises "single-clonotype".
    """
    if not unbiased:
        return F.sqrt(F.greatest(l2sq(mean_a, mean_b), F.lit(0.0)))
    own = lambda m, n: F.when(n > 1, (dot(m, m) - 1 / n) / (1 - 1 / n)).otherwise(F.raise_error(F.lit("single-clonotype repertoire")).cast("double"))
    return F.sqrt(F.greatest(own(mean_a, neff_a) + own(mean_b, neff_b) - 2 * dot(mean_a, mean_b), F.lit(0.0)))


def mmd_matrix(embeddings: DataFrame, sample: str, unbiased: bool = False, block: int = 256) -> DataFrame:
    """``id_a, id_b, dist`` for all ordered pairs, 0 on the diagonal.

    The result has a row for every pair; the work is dealt out in pairs of blocks of samples.
    """
    n = max(1, -(-embeddings.count() // block))
    part = F.pmod(F.xxhash64(sample), F.lit(n))
    side = lambda x: embeddings.select(F.col(sample).alias(f"id_{x}"), F.col("mean").alias(f"_m{x}"), F.col("n_eff").alias(f"_n{x}"), part.alias(f"_p{x}"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    pairs = side("a").withColumn("_pb", every).join(side("b").withColumn("_pa", every), ["_pa", "_pb"])
    d = F.when(F.col("id_a") == F.col("id_b"), 0.0).otherwise(mmd(F.col("_ma"), F.col("_na"), F.col("_mb"), F.col("_nb"), unbiased))
    return pairs.select("id_a", "id_b", d.alias("dist"))


def stratified_mmd(embeddings: DataFrame, sample: str, alleles: str) -> DataFrame:
    """``id_a, id_b, dist``: biased discrepancy where the two share an allele, else NaN; without alleles NaN throughout."""
    d = mmd_matrix(embeddings, sample)
    sets = embeddings.select(sample, alleles)
    d = d.join(sets.toDF("id_a", "_ha"), "id_a").join(sets.toDF("id_b", "_hb"), "id_b")
    return d.select("id_a", "id_b", F.when(F.arrays_overlap("_ha", "_hb"), F.col("dist")).otherwise(F.lit(float("nan"))).alias("dist"))


def witness(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """One row ``witness``: difference of the unweighted means of the samples' kernel means."""
    a, b = (x.agg(mean_vector("mean").alias(c)) for x, c in ((positive, "a"), (negative, "b")))
    return a.join(F.broadcast(b)).select(subtract("a", "b").alias("witness"))


def class_witness(candidates: DataFrame, features: str, key: str, direction: DataFrame, top: int = 30) -> DataFrame:
    """The ``top`` candidates by ``score`` along the witness, ties by key; all their columns stay."""
    scored = candidates.join(F.broadcast(direction)).withColumn("score", dot(features, "witness")).drop("witness")
    return scored.orderBy(F.desc("score"), key).limit(top)


def centroid_atypicality(df: DataFrame, key: str, group: str, vector: str) -> DataFrame:
    """``key, group, atypicality``: 1 minus the cosine to the mean of the own group."""
    centers = df.groupBy(F.col(group).alias("_g")).agg(mean_vector(vector).alias("_c"))
    j = df.join(centers, F.col(group) == F.col("_g"))
    size = lambda c: F.sqrt(dot(c, c)) + 1e-9
    return j.select(key, group, (1 - dot(vector, "_c") / (size(vector) * size("_c"))).alias("atypicality"))


def kmer_profile(df: DataFrame, sample: str, sequence: str, k: int = 3, weight: str | None = None) -> DataFrame:
    """``sample, kmer, frequency``: weighted shares of the k-mers of a sample's sequences; k-mers that are absent have no row."""
    w = F.col(weight) if weight else F.lit(1.0)
    s = F.col(sequence)
    grams = F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: F.substring(s, i, F.lit(k)))
    rows = df.filter(F.length(s) >= k).select(sample, w.alias("_w"), F.explode(grams).alias("kmer"))
    counts = rows.groupBy(sample, "kmer").agg(F.sum("_w").alias("_c"))
    total = counts.groupBy(F.col(sample).alias("_s")).agg(F.sum("_c").alias("_t"))
    return counts.join(total, F.col(sample) == F.col("_s")).select(sample, "kmer", (F.col("_c") / F.col("_t")).alias("frequency"))


def downsample(df: DataFrame, sample: str, key: str, count: str, reads: int, seed: int = 0) -> DataFrame:
    """``df`` with ``count`` of ``reads`` reads drawn without replacement in every sample.

    Reads are numbered within their record and ordered by a hash; only as many as are drawn meet in a task
    (Spark limits ranks before the shuffle).
    """
    one = df.select(sample, key, F.explode(F.sequence(F.lit(1), F.col(count).cast("int"))).alias("_i"))
    drawn = one.withColumn("_r", F.row_number().over(W.partitionBy(sample).orderBy(F.xxhash64(F.lit(seed), sample, key, "_i"), key, "_i"))).filter(F.col("_r") <= reads)
    return df.drop(count).join(drawn.groupBy(sample, key).agg(F.count("*").alias(count)), [sample, key])




def kmer_matrix(df: DataFrame, sample: str, sequence: str, k: int = 3, weight: str | None = None) -> tuple[DataFrame, list[str]]:
    """``sample, x``: a sample's shares of all k-mers that any sample has, zeros included, and these k-mers in order.

    The vocabulary has at most (letters) ** k entries, whatever the number of sequences.  Samples without a k-mer have zeros.
    """
    shares = kmer_profile(df, sample, sequence, k, weight)
    words = [r[0] for r in shares.select("kmer").distinct().orderBy("kmer").collect()]
    own = shares.groupBy(sample).agg(F.map_from_entries(F.collect_list(F.struct("kmer", "frequency"))).alias("_m"))
    every = df.select(sample).distinct().join(own, sample, "left")
    kinds = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    return every.select(sample, F.transform(kinds, lambda w: F.coalesce(F.try_element_at("_m", w), F.lit(0.0))).alias("x")), words
