"""From samples to subjects: fusing chains, channels, batch correction, incidence."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexivec.functions.stats import benjamini_hochberg, fisher_exact, running_sums
from plexivec.functions.vectors import mean_vector, subtract
from plexivec.operators.basis import Basis, fit_projection, transform
from plexivec.operators.repertoire import BLOCKS, class_witness, sample_embedding, witness
from plexivec.operators.strings import one_mismatch_pairs
from plexivec.plans.components import components
from plexivec.plans.numbering import numbered, with_permuted
from plexivec.plans.staging import staged


@dataclass
class ChannelSpec:
    """Ordered channels of a matrix: names with their column numbers."""

    channels: dict[str, list[int]] = field(default_factory=dict)
    attributable: frozenset[str] = frozenset()

    @property
    def names(self) -> list[str]:
        return list(self.channels)

    @property
    def width(self) -> int:
        return sum(map(len, self.channels.values()))

    def __contains__(self, name: str) -> bool:
        return name in self.channels

    def __getitem__(self, name: str) -> list[int]:
        if name not in self.channels:
            raise ValueError(f"unknown channel {name!r}; there are {self.names}")
        return self.channels[name]

    def columns(self, names: Sequence[str]) -> list[int]:
        """Column numbers of several channels, in order."""
        return sorted(c for n in names for c in self[n])

    def complement(self, drop: Sequence[str]) -> list[int]:
        return self.columns([n for n in self.names if n not in drop])


class ChannelBuilder:
    """Joins frames of vectors, one a subject, to one matrix with named channels."""

    def __init__(self, subjects: DataFrame, key: str) -> None:
        self.key, self.frame = key, subjects.select(key)
        self.parts: list[tuple[str, str, int]] = []
        self.marked: set[str] = set()

    def add(self, name: str, frame: DataFrame, vector: str, width: int, attributable: bool = False) -> ChannelBuilder:
        """Add a block; blocks of one name are one channel, and a mark once set stays."""
        column = f"_b{len(self.parts)}"
        self.frame = self.frame.join(frame.select(self.key, F.col(vector).alias(column)), self.key, "left")
        self.parts.append((name, column, width))
        if attributable:
            self.marked.add(name)
        return self

    def build(self, standardize: bool = True, impute: bool = True) -> tuple[DataFrame, ChannelSpec]:
        """``key, x`` and the channels; holes get the column's median, then columns are standardised."""
        channels: dict[str, list[int]] = {}
        at = 0
        for name, _, width in self.parts:
            channels.setdefault(name, []).extend(range(at, at + width))
            at += width
        hole = lambda c, w: F.coalesce(F.col(c), F.array_repeat(F.lit(None).cast("double"), w))
        out = self.frame.select(self.key, F.concat(*[hole(c, w) for _, c, w in self.parts]).alias("x"))
        if impute:
            out = impute_median(out, "x", at)
        if standardize:
            out = zscore(out, "x")
        return out, ChannelSpec(channels, frozenset(self.marked))


def impute_median(df: DataFrame, vector: str, width: int) -> DataFrame:
    """Nulls and NaN become the exact median of the finite values at their place, 0 if there are none."""
    medians = vector_medians(df, vector, width)
    row = F.array(*[F.lit(m) for m in medians])
    return df.withColumn(vector, F.zip_with(vector, row, lambda x, m: F.coalesce(_finite(x), m)))


def _finite(x: Column) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def vector_medians(df: DataFrame, vector: str, width: int) -> list[float]:
    """Exact median of the finite values at every place, 0 if there are none: counts by place and value, ranked by a range sort."""
    cells = df.select(F.posexplode(F.slice(vector, 1, width)).alias("i", "v")).select("i", _finite(F.col("v").cast("double")).alias("v")).filter("v is not null")
    ranked = staged(running_sums(cells.groupBy("i", "v").agg(F.count("*").alias("n")), [F.col("i"), F.col("v")], ["n"]), "medians")
    totals = ranked.groupBy("i").agg(F.sum("n").alias("all"), F.max("n_upto").alias("last"))
    rank = F.col("n_upto") - (F.col("last") - F.col("all"))
    at = lambda place: F.min(F.when(rank >= place, F.col("v")))
    middle = ranked.join(F.broadcast(totals), "i").groupBy("i").agg(at(F.floor((F.col("all") + 1) / 2)).alias("a"), at(F.floor((F.col("all") + 2) / 2)).alias("b"))
    found = {r["i"]: (r["a"] + r["b"]) / 2 for r in middle.collect()}
    return [found.get(i, 0.0) for i in range(width)]


def zscore(df: DataFrame, vector: str) -> DataFrame:
    """Columns minus their mean, divided by their population deviation; a constant column becomes 0."""
    v = array_to_vector(vector)
    stats = df.agg(Summarizer.mean(v).alias("_mean"), Summarizer.variance(v).alias("_var"), F.count("*").alias("_n"))
    from pyspark.ml.functions import vector_to_array

    stats = stats.select(vector_to_array("_mean").alias("_mean"), F.transform(vector_to_array("_var"), lambda x: F.sqrt(x * (F.col("_n") - 1) / F.col("_n"))).alias("_sd"))
    # a deviation that rounding explains is that of a constant column
    stats = stats.withColumn("_sd", F.zip_with("_sd", "_mean", lambda s, m: F.when(s > 1e-12 + 1e-13 * F.abs(m), s).otherwise(0.0)))
    scaled = F.zip_with(subtract(vector, "_mean"), "_sd", lambda x, s: F.when(s > 0, x / s).otherwise(0.0))
    return df.join(F.broadcast(stats)).withColumn(vector, scaled).drop("_mean", "_sd")


def residualize(df: DataFrame, vector: str, group: str) -> DataFrame:
    """``df`` with the group's mean taken off; means are aggregated and joined, groups may be of any size."""
    means = df.groupBy(F.col(group).alias("_g")).agg(mean_vector(vector).alias("_m"))
    return df.join(means, F.col(group).eqNullSafe(F.col("_g"))).withColumn(vector, subtract(vector, "_m")).drop("_g", "_m")


def correct_batch(df: DataFrame, key: str, vector: str, batch: str, covariates: str | None = None, n_clusters: int = 8, theta: float = 1.0, sigma: float = 0.1, max_iter: int = 10, ridge: float = 1.0, seed: int = 0) -> DataFrame:
    """Batch effects removed within soft clusters (after Korsunsky et al., 2019).

    With one cluster or ``theta`` 0 this is ``residualize``.  Else cosine k-means (Spark's) gives centres; in
    each round memberships are weighted towards clusters where a batch is rare, and a ridge regression per
    cluster on batch (and covariates, which stay) is taken off.  Rounds are map tasks and sums: a few
    matrices of cluster x batch size reach the driver.
    """
    if n_clusters <= 1 or theta <= 0:
        return residualize(df, vector, batch)
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer

    names = [r[0] for r in df.select(batch).distinct().orderBy(batch).limit(10_001).collect()]
    if len(names) > 10_000:
        raise ValueError("more than 10000 batches")
    where = {b: i for i, b in enumerate(names)}
    center = np.array(df.agg(mean_vector(vector).alias("m")).first()[0])
    unit = Normalizer(inputCol="_c", outputCol="_u").transform(df.withColumn("_c", array_to_vector(F.transform(vector, lambda x, i: x - F.array(*[F.lit(float(c)) for c in center])[i]))))
    centers = np.array(KMeans(k=n_clusters, featuresCol="_u", distanceMeasure="cosine", seed=seed).fit(unit.select("_u")).clusterCenters())
    centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    cols = [F.col(key).alias("key"), F.col(vector).alias("x"), F.col(batch).alias("b"), (F.col(covariates) if covariates else F.array().cast("array<double>")).alias("c")]
    rows = staged(df.select(*cols), "batches")  # read in every round
    observed = np.ones((len(centers), len(names)))
    expected = np.ones_like(observed)

    def memberships(x: pd.DataFrame, weight: np.ndarray, cs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = np.stack(x["x"].to_numpy()).astype(float)
        b = x["b"].map(where).to_numpy(int)
        u = v - center
        u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
        r = np.exp(-2 * (1 - u @ cs.T) / sigma) * weight.T[b]
        return v, b, r / np.maximum(r.sum(1, keepdims=True), 1e-300)

    def pooled(weight: np.ndarray, what: Callable) -> np.ndarray:
        def run(batches):
            total = None
            for x in batches:
                if len(x):
                    t = what(x, *memberships(x, weight, centers))
                    total = t if total is None else total + t
            if total is not None:
                yield pd.DataFrame({"v": [total.ravel()]})

        return np.array(rows.mapInPandas(run, "v array<double>").agg(mean_vector("v").alias("m"), F.count("*").alias("n")).select(F.transform("m", lambda m: m * F.col("n"))).first()[0])

    for _ in range(3):  # memberships and their diversity weights
        weight = (expected / np.maximum(observed, 1e-9)) ** theta
        observed = pooled(weight, lambda x, v, b, r: np.stack([r[b == i].sum(0) for i in range(len(names))], 1)).reshape(observed.shape)
        expected = observed.sum(1, keepdims=True) * observed.sum(0, keepdims=True) / max(observed.sum(), 1e-12)
    weight = (expected / np.maximum(observed, 1e-9)) ** theta
    n_batch = max(len(names) - 1, 0)

    def design(x: pd.DataFrame, b: np.ndarray) -> np.ndarray:
        cov = np.stack(x["c"].to_numpy()).astype(float).reshape(len(x), -1)
        return np.concatenate([np.ones((len(x), 1)), np.eye(len(names))[b][:, 1:], cov], 1)

    dims, n_cov = len(center), len(rows.first()["c"])
    width = 1 + n_batch + n_cov
    beta = np.zeros((len(centers), n_batch, dims))

    def moved(x: pd.DataFrame, b: np.ndarray, r: np.ndarray, beta: np.ndarray) -> np.ndarray:
        return np.einsum("nk,nb,kbd->nd", r, design(x, b)[:, 1 : 1 + n_batch], beta)

    penalty = np.diag([0.0] + [ridge] * n_batch + [0.0] * n_cov) + 1e-9 * np.eye(width)
    for _ in range(max_iter):  # regressions on what the rounds before have left

        def sums(x: pd.DataFrame, v: np.ndarray, b: np.ndarray, r: np.ndarray, beta: np.ndarray = beta) -> np.ndarray:
            d, left = design(x, b), v - moved(x, b, r, beta)
            return np.concatenate([np.concatenate([(d * r[:, [k]]).T @ d, (d * r[:, [k]]).T @ left], 1) for k in range(r.shape[1])], 0)

        m = pooled(weight, sums).reshape(len(centers), width, width + dims)
        step = np.stack([np.linalg.solve(k[:, :width] + penalty, k[:, width:]) for k in m])[:, 1 : 1 + n_batch]
        beta = beta + step
        if np.abs(step).max() < 1e-6:
            break

    def corrected(batches):
        for x in batches:
            if len(x):
                v, b, r = memberships(x, weight, centers)
                yield pd.DataFrame({"_k": x["key"], "_x": list(v - moved(x, b, r, beta))})

    kind = df.schema[key].dataType.simpleString()
    fixed = rows.mapInPandas(corrected, f"_k {kind}, _x array<double>")
    return df.drop(vector).join(fixed, F.col(key) == F.col("_k")).withColumnRenamed("_x", vector).drop("_k")


@dataclass(frozen=True)
class DonorSpace:
    """What turns donors into rows that can be compared: the loci's bases and the columns' statistics."""

    loci: tuple[str, ...]
    id_pca: int
    min_clones: int
    bases: dict[str, Basis | None]
    medians: list[float]
    means: list[float]
    deviations: list[float]
    spec: ChannelSpec
    coverage: bool = True
    extra_widths: dict[str, int] = field(default_factory=dict)

    def transform(self, cloud: DataFrame, donors: DataFrame, donor: str, locus: str, count: str, features: str, extra: dict[str, tuple[DataFrame, str, int]] | None = None) -> DataFrame:
        """``donor, x`` of other donors, by the stored parameters only.

        A locus without an identity at fitting has none here; a missing chain gets the stored medians.
        ``extra`` must have the channels of the fit, of the same widths; ValueError if not.
        """
        if (got := {name: width for name, (_, _, width) in (extra or {}).items()}) != self.extra_widths:
            raise ValueError(f"extra channels are {self.extra_widths}, not {got}")
        raw = _blocks(cloud, donors, donor, locus, count, features, self.loci, self.min_clones, self.bases, None, self.coverage, extra)[0]
        row = lambda v: F.array(*[F.lit(float(x)) for x in v])
        filled = F.zip_with("x", row(self.medians), lambda x, m: F.when(x.isNull() | F.isnan(x), m).otherwise(x))
        centred = F.zip_with(filled, row(self.means), lambda x, m: x - m)
        return raw.withColumn("x", F.zip_with(centred, row(self.deviations), lambda x, s: x / s))

    def save(self, spark: SparkSession, path: str) -> None:
        """Write all parameters as one JSON line, bases with their fingerprints."""
        record = {k: getattr(self, k) for k in ("loci", "id_pca", "min_clones", "medians", "means", "deviations", "coverage", "extra_widths")}
        record |= {"channels": self.spec.channels, "attributable": sorted(self.spec.attributable)}
        record["bases"] = {k: None if b is None else b.record() | {"fingerprint": b.fingerprint} for k, b in self.bases.items()}
        spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str, verify: bool = True) -> DonorSpace:
        """Read the parameters; ValueError if a basis is not the one that was saved."""
        r = json.loads(spark.read.text(path).first()[0])
        spec = ChannelSpec(r.pop("channels"), frozenset(r.pop("attributable")))
        bases = {}
        for name, b in r.pop("bases").items():
            said = b.pop("fingerprint") if b else None
            bases[name] = Basis(**{k: v if k == "meta" or v is None else np.array(v) for k, v in b.items()}) if b else None
            if verify and b and bases[name].fingerprint != said:
                raise ValueError("basis fingerprint mismatch")
        return DonorSpace(bases=bases, spec=spec, **r | {"loci": tuple(r["loci"])})


def _blocks(cloud: DataFrame, donors: DataFrame, donor: str, locus: str, count: str, features: str, loci: Sequence[str], min_clones: int, bases: dict, id_pca: int | None = None, coverage: bool = True, extra: dict[str, tuple[DataFrame, str, int]] | None = None) -> tuple[DataFrame, ChannelSpec]:
    """The blocks of all donors side by side, with holes; with ``id_pca`` the bases are fitted into ``bases``."""
    build = ChannelBuilder(donors, donor)
    for name in loci:
        own = cloud.filter(F.col(locus) == name)
        enough = own.groupBy(donor).agg(F.count("*").alias("n")).filter(F.col("n") >= min_clones).select(donor)
        own = own.join(enough, donor)
        e = sample_embedding(own, donor, count, features, blocks=("mean", "diversity"))
        if id_pca is not None:
            bases[name] = fit_projection(e, "mean", id_pca) if e.count() > id_pca else None
        if bases[name] is not None:
            build.add(f"{name}:identity", transform(e, bases[name], "mean", "z"), "z", bases[name].loadings.shape[1], True)
        build.add(f"{name}:diversity", e, "diversity", 4)
        if coverage:
            build.add(f"{name}:coverage", own.groupBy(donor).agg(F.array(F.log1p(F.sum(count).cast("double"))).alias("mass")), "mass", 1)
    for name, (frame, vector, width) in (extra or {}).items():
        build.add(name, frame, vector, width)
    return build.build(standardize=False, impute=False)


def fit_donors(cloud: DataFrame, donors: DataFrame, donor: str, locus: str, count: str, features: str, loci: Sequence[str], id_pca: int = 8, min_clones: int = 5, coverage: bool = True, extra: dict[str, tuple[DataFrame, str, int]] | None = None, standardize: bool = True) -> DonorSpace:
    """Fit the blocks ``locus:identity``, ``locus:diversity``, ``locus:coverage`` of donors.

    A chain with fewer than ``min_clones`` clones leaves holes, filled with the columns' medians.  The
    identity of a locus is the projection of its kernel means to ``id_pca`` components; with no more donors
    than that it has none.  ``extra`` adds the caller's channels, a frame with the donor's vector, the
    vector's column and width for each name.  Columns are standardised (population deviation, 0 as 1)
    unless ``standardize`` is false.
    """
    if not loci:
        raise ValueError("no loci")
    bases: dict[str, Basis | None] = {}
    raw, spec = _blocks(cloud, donors, donor, locus, count, features, loci, min_clones, bases, id_pca, coverage, extra)
    raw = staged(raw, "donors")
    x = [F.col("x")[i] for i in range(spec.width)]
    first = vector_medians(raw, "x", spec.width)
    filled = [F.coalesce(v, F.lit(float(first[i]))) for i, v in enumerate(x)]
    stats = raw.agg(*[F.avg(v).alias(f"a{i}") for i, v in enumerate(filled)], *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(filled)]).first()
    w = spec.width
    means = list(stats[:w]) if standardize else [0.0] * w
    noise = [1e-9 * max(abs(m or 0.0), 1e-3) for m in stats[:w]]  # what rounding leaves of a constant column
    scales = [s if standardize and s and s > least else 1.0 for s, least in zip(stats[w:], noise)]
    widths = {name: width for name, (_, _, width) in (extra or {}).items()}
    return DonorSpace(tuple(loci), id_pca, min_clones, bases, list(first), means, scales, spec, coverage, widths)


def row_permutations(df: DataFrame, vector: str, seed: int = 0) -> Callable[[DataFrame, int], DataFrame]:
    """A function of (frame, round) to ``df`` with ``vector`` of another row in each row; rows are numbered once."""
    own = numbered(df, "_number")
    n = own.count()
    return lambda _, i: with_permuted(own, "_number", vector, n, (seed << 32) + i).drop("_number")


def stack_embeddings(embeddings: DataFrame, output: str = "x") -> tuple[DataFrame, ChannelSpec]:
    """``embeddings`` with its blocks in one vector, as they are, and the channels ``mean``, ``diversity``, ``second`` that are there.

    ``mean`` can be traced to records.  ValueError without rows, or if rows differ in their blocks or widths.
    """
    there = [b for b in BLOCKS if b in embeddings.columns]
    if not there:
        raise ValueError(f"no blocks among {embeddings.columns}")
    sizes = embeddings.agg(F.count("*").alias("n"), *[f(F.coalesce(F.size(b), F.lit(-1))).alias(f"{b}_{k}") for b in there for k, f in (("lo", F.min), ("hi", F.max))]).first()
    if not sizes["n"]:
        raise ValueError("no embeddings")
    if odd := [b for b in there if sizes[f"{b}_lo"] != sizes[f"{b}_hi"]]:
        raise ValueError(f"rows differ in {odd}")
    there = [b for b in there if sizes[f"{b}_hi"] >= 0]
    starts = np.cumsum([0, *[sizes[f"{b}_hi"] for b in there]]).tolist()
    spec = ChannelSpec({b: list(range(x, y)) for b, x, y in zip(there, starts, starts[1:])}, frozenset({"mean"} & set(there)))
    return embeddings.withColumn(output, F.concat(*there)), spec


def channel_report(df: DataFrame, spec: ChannelSpec, scorer: Callable[[DataFrame, list[int]], float], base: float | None = None, mode: str = "in", permuted: Callable[[DataFrame, int], DataFrame] | None = None, n_permutations: int = 0, seed: int = 0, vector: str = "x", channels: Sequence[str] | None = None) -> DataFrame:
    """Score of every channel alone (``in``), of all but it (``out``) or both, and their ranks.

    ``scorer(df, columns)`` is a Spark job of the caller's.  ``delta`` is the score over ``base``, ``delta_out``
    what the full score loses without the channel.  With ``n_permutations`` p-values count how often
    frames from ``permuted(df, round)`` score as well; without it the rows' ``vector`` is dealt to other rows by a
    permutation that ``seed`` and round give.  All channels share the permutations.  ``channels``
    restricts and orders the report; the full score is then that of their union.
    """
    if mode not in ("in", "out", "both"):
        raise ValueError(f"unknown mode {mode!r}")
    names = spec.names if channels is None else list(channels)
    if not names:
        raise ValueError("no channels")
    full = scorer(df, spec.columns(names))
    rows = []
    for name in names:
        score = scorer(df, spec[name])
        rest = spec.columns([n for n in names if n != name])
        without = (full - (scorer(df, rest) if rest else base or 0.0)) if mode != "in" else None
        rows.append([name, len(spec[name]), float(score), None if base is None else float(score - base), without, name in spec.attributable])
    ps = [None] * len(rows)
    if n_permutations:
        better = [0] * len(rows)
        if permuted is None:
            permuted = row_permutations(df, vector, seed)
        for i in range(n_permutations):
            other = permuted(df, i)
            for j, r in enumerate(rows):
                better[j] += scorer(other, spec[r[0]]) >= r[2]
        ps = [(1 + b) / (1 + n_permutations) for b in better]
    by = [r[4] if mode == "out" else r[2] for r in rows]
    rank = np.empty(len(rows), int)
    rank[np.argsort(-np.array(by), kind="stable")] = np.arange(1, len(rows) + 1)
    table = [(*r, int(k), p) for r, k, p in zip(rows, rank, ps)]
    return df.sparkSession.createDataFrame(table, "channel string, n_columns int, score double, delta double, delta_out double, attributable boolean, rank int, pvalue double").orderBy("rank")


def report_summary(report: DataFrame, full: float, base: float | None = None) -> tuple[str, float | None]:
    """The best channel of a report, and what all channels together gain over ``base``."""
    return report.filter("rank = 1").first()["channel"], None if base is None else float(full - base)


def channel_drivers(spec: ChannelSpec, channel: str, positive: DataFrame, negative: DataFrame, candidates: DataFrame, features: str, key: str, top: int = 30) -> DataFrame:
    """The records that drive a channel: ``class_witness`` with the channel's name; ValueError if it cannot be traced to records."""
    spec[channel]
    if channel not in spec.attributable:
        raise ValueError(f"channel {channel!r} is not attributable")
    return class_witness(candidates, features, key, witness(positive, negative), top).withColumn("channel", F.lit(channel))


def merge_one_mismatch(df: DataFrame, feature: str) -> DataFrame:
    """``df`` with sequences that are linked by single mismatches under one name, the smallest of them."""
    pairs = one_mismatch_pairs(df, feature)
    names = pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct()
    ids = staged(names.withColumn("node", F.monotonically_increasing_id()), "features")
    a, b = ids.toDF("a", "na"), ids.toDF("b", "nb")
    comp = components(pairs.join(a, "a").join(b, "b").select(F.col("na").alias("a"), F.col("nb").alias("b")))
    named = comp.join(ids, "node")
    least = named.groupBy("comp").agg(F.min("s").alias("_name"))
    new = named.join(least, "comp").select(F.col("s").alias("_s"), "_name")
    return df.join(new, F.col(feature) == F.col("_s"), "left").withColumn(feature, F.coalesce("_name", feature)).drop("_s", "_name")


def incidence_biomarkers(df: DataFrame, feature: str, subject: str, positive: str, min_incidence: int = 3, match: str = "exact") -> DataFrame:
    """``feature, n_pos, n_neg, odds_ratio, pvalue, qvalue, direction``: Fisher's test of who carries a feature.

    With ``match`` ``1mm`` sequences that are linked by single mismatches are one feature.
    """
    if match not in ("exact", "1mm"):
        raise ValueError(f"unknown match {match!r}")
    if match == "1mm":
        df = merge_one_mismatch(df, feature)
    subjects = df.select(subject, positive).distinct()
    total = {r[0]: r[1] for r in subjects.groupBy(positive).count().collect()}
    pos, neg = total.get(True, 0), total.get(False, 0)
    seen = df.select(feature, subject, positive).distinct().groupBy(feature).agg(F.count_if(positive).alias("n_pos"), F.count_if(~F.col(positive)).alias("n_neg")).filter(F.col("n_pos") + F.col("n_neg") >= min_incidence)
    a, b = F.col("n_pos"), F.col("n_neg")
    odds = (a + 0.5) * (neg - b + 0.5) / ((pos - a + 0.5) * (b + 0.5))
    out = seen.withColumn("odds_ratio", odds).withColumn("pvalue", fisher_exact(a, b, pos - a, neg - b)).withColumn("direction", F.when(odds > 1, "positive").otherwise("negative"))
    return benjamini_hochberg(out)
