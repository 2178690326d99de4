"""Fitted coordinate systems: scaling, projection, random features; and their identity.

Vectors may be compared only within one basis.  A basis is a small record of parameters (its size depends
on the dimensions, not on the data) with a fingerprint over all of them, which two-sided operators check.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexivec.functions.names import mutate
from plexivec.functions.stats import exact_quantiles
from plexivec.functions.vectors import l2sq, mean_vector


@dataclass(frozen=True)
class Basis:
    """Mean, scale and loadings of a projection, and the random features on top of it."""

    mean: np.ndarray
    scale: np.ndarray
    loadings: np.ndarray  # dimensions x components
    variances: np.ndarray
    omega: np.ndarray | None = None
    phase: np.ndarray | None = None
    omega2: np.ndarray | None = None
    phase2: np.ndarray | None = None
    meta: dict = field(default_factory=dict)

    def record(self) -> dict:
        arrays = {k: None if v is None else np.asarray(v).tolist() for k, v in self.__dict__.items() if k != "meta"}
        return arrays | {"meta": self.meta}

    @property
    def fingerprint(self) -> str:
        """16 hex digits over all parameters."""
        return hashlib.sha256(json.dumps(self.record(), sort_keys=True).encode()).hexdigest()[:16]

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the record as one JSON line, with its fingerprint."""
        line = json.dumps({"fingerprint": self.fingerprint} | self.record())
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str, expect: str | None = None, verify: bool = True) -> Basis:
        """Read a record; ValueError if its fingerprint is not its own or not the one expected."""
        found = json.loads(spark.read.text(path).first()[0])
        said = found.pop("fingerprint")
        basis = Basis(**{k: v if k == "meta" or v is None else np.array(v) for k, v in found.items()})
        if verify and (said != basis.fingerprint or expect not in (None, said)):
            raise ValueError("basis fingerprint mismatch")
        return basis


def same_basis(a: DataFrame, b: DataFrame, column: str) -> None:
    """ValueError if two vector columns carry the fingerprints of different bases."""
    x, y = (df.schema[column].metadata.get("basis") for df in (a, b))
    if x != y:
        raise ValueError(f"vectors of different bases: {x} and {y}")


def fit_projection(df: DataFrame, vector: str, n_components: int = 50, scale: bool = True, cap: int | None = None, seed: int = 0, key: str | None = None) -> Basis:
    """Standardise (population deviation, 0 as 1), then principal components, signs with the largest loading positive.

    Moments are summed by Spark, one matrix a partition; the driver gets a dimensions x dimensions
    matrix.  All rows count, unless the caller sets ``cap``: then beyond it a sample by the hash of ``key``
    is used, about ``cap`` rows.
    """
    rows = df.select(F.col(vector).alias("v"), *([F.col(key).alias("k")] if key else []))
    n = rows.count()
    if n == 0:
        raise ValueError("empty input")
    if cap is not None and n > cap:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit(seed), "k" if key else "v"), F.lit(1 << 30)) < int(cap / n * (1 << 30)))

    center = np.array(rows.agg(mean_vector("v").alias("m")).first()[0])  # sums of what is left are free of cancellation

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for x in batches:
            if len(x):
                v = np.stack(x["v"].to_numpy()).astype(float) - center
                one = np.concatenate([np.ones((len(v), 1)), v], 1)
                total = one.T @ one if total is None else total + one.T @ one
        if total is not None:
            yield pd.DataFrame({"row": np.arange(len(total)), "m": list(total)})

    summed = rows.select("v").mapInPandas(moments, "row int, m array<double>").groupBy("row").agg(Summarizer.sum(array_to_vector("m")).alias("m")).orderBy("row").collect()
    m = np.array([r["m"].toArray() for r in summed])
    count = m[0, 0]
    shift = m[0, 1:] / count
    mean = center + shift
    cov = m[1:, 1:] / count - np.outer(shift, shift)
    # rounding of the values themselves: what a constant column may differ from its mean
    noise = (count * np.finfo(float).eps * np.abs(mean)) ** 2
    constant = np.diag(cov) <= noise
    cov[constant, :] = cov[:, constant] = 0.0
    dev = np.sqrt(np.diag(cov)) if scale else np.ones(len(mean))
    dev = np.where(constant, 1.0, dev)
    values, vectors = np.linalg.eigh(cov / np.outer(dev, dev))
    k = int(min(n_components, count, len(mean)))
    order = np.argsort(values)[::-1][:k]
    loadings = vectors[:, order]
    loadings = loadings * np.sign(loadings[np.abs(loadings).argmax(0), np.arange(k)])
    return Basis(mean, dev, loadings, values[order], meta={"n_components": k, "seed": seed, "vector": vector})


def random_features(dim: int, n: int, length_scale: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies (dim x n) of a Gaussian kernel, then phases, drawn in this order."""
    rng = np.random.default_rng(seed)
    return rng.standard_normal((dim, n)) / length_scale, rng.uniform(0, 2 * np.pi, n)


def with_random_features(basis: Basis, length_scale: float, n: int = 2048, n_second: int = 128, n_eigs: int | None = None, seed: int = 0) -> Basis:
    """The basis with random features for kernel means, and others (the next seed) for second moments."""
    if length_scale <= 0:
        raise ValueError("non-positive radius")
    if n_eigs is not None and not 0 < n_eigs <= n_second:
        raise ValueError("n_eigs must be in 1 .. n_second")
    k = basis.loadings.shape[1]
    omega, phase = random_features(k, n, length_scale, seed)
    omega2, phase2 = random_features(k, n_second, length_scale, seed + 1) if n_second else (None, None)
    return Basis(basis.mean, basis.scale, basis.loadings, basis.variances, omega, phase, omega2, phase2, basis.meta | {"length_scale": float(length_scale), "n_eigs": n_eigs})


def _spread(rows: np.ndarray, places: np.ndarray, n: int) -> list[np.ndarray | None]:
    """A list of ``n`` places with the rows in theirs and None elsewhere."""
    out: list[np.ndarray | None] = [None] * n
    for i, row in zip(places.tolist(), rows):
        out[i] = row
    return out


def transform(df: DataFrame, basis: Basis, vector: str, output: str = "z", features: str | None = None, features2: str | None = None) -> DataFrame:
    """``df`` with the projected vector and, if named, its random features; Arrow batches, one matrix product each.

    Columns of these names are replaced.  A null vector has null results.
    """
    shared = df.sparkSession.sparkContext.broadcast(basis)
    wanted = [output] + [c for c in (features, features2) if c]

    @F.pandas_udf(", ".join(f"{c} array<double>" for c in wanted))
    def projected(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        b = shared.value
        for v in batches:
            there = np.flatnonzero(v.notna().to_numpy())
            x = np.stack(v.to_numpy()[there]).astype(float) if len(there) else np.zeros((0, len(b.mean)))
            z = (x - b.mean) / b.scale @ b.loadings
            out = pd.DataFrame({c: pd.Series([None] * len(v), dtype=object) for c in wanted})
            out[output] = _spread(z, there, len(v))
            for name, o, p in ((features, b.omega, b.phase), (features2, b.omega2, b.phase2)):
                if name:
                    out[name] = _spread(np.sqrt(2 / len(p)) * np.cos(z @ o + p), there, len(v))
            yield out

    out = df.withColumn("_p", projected(F.col(vector)))
    for c in wanted:
        out = out.withColumn(c, F.col(f"_p.{c}")).withMetadata(c, {"basis": basis.fingerprint})
    return out.drop("_p")


def calibrate_radius(df: DataFrame, embed, basis: Basis, sequence: str = "junction_aa", quantile: float = 0.5, seed: int = 0) -> float:
    """Quantile of how far one substitution moves a record; ``embed`` adds ``embedding`` to a frame of sequences."""
    changed = df.withColumn("_row", F.xxhash64(*df.columns)).withColumn("_new", mutate(F.col(sequence), F.concat_ws(":", F.lit(str(seed)), F.col("_row").cast("string"))))
    old = transform(embed(changed), basis, "embedding", "_z0")
    new = transform(embed(old.drop("embedding").withColumn(sequence, F.col("_new"))), basis, "embedding", "_z1")
    r = exact_quantiles(new, F.sqrt(l2sq("_z0", "_z1")), [quantile])[0]
    if not r or r <= 0:
        raise ValueError("non-positive radius")
    return float(r)


def fit_density_space(obs: DataFrame, bg: DataFrame, vector: str, n_components: int = 50, output: str = "z", cap: int | None = None, seed: int = 0) -> tuple[Basis, DataFrame, DataFrame]:
    """One basis fitted on observed and background vectors together, and both of them in it.

    Nothing is held at once: the fit is sums over both frames, and projecting is a map over batches.  With
    ``cap`` the fit takes about as many rows, in proportion to the two frames.
    """
    basis = fit_projection(obs.select(vector).unionByName(bg.select(vector)), vector, n_components, cap=cap, seed=seed)
    return basis, transform(obs, basis, vector, output), transform(bg, basis, vector, output)


def fit_repertoire_space(pool: DataFrame, embed, n_components: int, n_rff: int = 2048, n_rff_second: int = 128, n_eigs: int | None = None, length_scale: float | None = None, sequence: str = "junction_aa", cap: int | None = None, seed: int = 0) -> Basis:
    """One projection and one set of random features for the pooled records of all samples; counts play no part.

    ``embed`` adds ``embedding`` to a frame.  Without ``length_scale`` the kernel is as wide as one
    substitution moves a record (``calibrate_radius``), so that it tells single mutations apart.
    """
    if n_eigs is not None and not 0 < n_eigs <= n_rff_second:
        raise ValueError("n_eigs must be in 1 .. n_rff_second")
    basis = fit_projection(embed(pool), "embedding", n_components, cap=cap, seed=seed)
    scale = calibrate_radius(pool, embed, basis, sequence, seed=seed) if length_scale is None else length_scale
    return with_random_features(basis, scale, n_rff, n_rff_second, n_eigs, seed)


def fit_repertoire_spaces(pool: DataFrame, embeds: dict, n_components: dict[str, int], locus: str = "locus", min_clonotypes: int = 50, **kwargs) -> dict[str, Basis]:
    """A basis of its own for every locus of ``embeds`` with at least ``min_clonotypes`` pooled rows; others are left out."""
    sizes = {r[0]: r[1] for r in pool.filter(F.col(locus).isin(list(embeds))).groupBy(locus).count().collect()}
    return {name: fit_repertoire_space(pool.filter(F.col(locus) == name), embed, n_components[name], **kwargs) for name, embed in embeds.items() if sizes.get(name, 0) >= min_clonotypes}
